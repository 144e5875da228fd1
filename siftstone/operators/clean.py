"""Cleaning of measured activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.cleaning import to_nanomolar
from siftstone.operators.frames import keep_least
from siftstone.operators.stats import quartile_fence
from siftstone.plans.lineage import shared_checkpoint


def present(*columns: str) -> Column:
    """None of the columns is null. A NaN is a value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column has one of the values; a list of more than 100 goes through a semi-join."""
    if len(values) <= 100:
        return df.filter(F.col(column).isin(*values))
    return df.join(df.sparkSession.createDataFrame([(v,) for v in values], [column]), column, "left_semi")


def clean_activity(df: DataFrame, key: str, value: str, unit: str, kind: str, kinds: tuple[str, ...] | None = ("IC50", "Ki", "EC50"), structure: str | None = None) -> DataFrame:
    """key, structure, nanomolar, kind and unit (lower case): one row for each structure (key, if none is given).

    Rows that lack a value are dropped, values go to nanomolar, the least one of each structure stays,
    then values that are not positive and those beyond the quartile fence go. The order matters: a
    structure with a reading of zero goes as a whole.
    """
    structure = structure or key
    names = list(dict.fromkeys((key, structure)))
    rows = df.filter(present(*names, value, unit, kind))
    if kinds is not None:
        rows = rows.filter(F.col(kind).isin(*kinds))
    rows = rows.select(*names, to_nanomolar(F.col(value), F.col(unit)).alias("nanomolar"), F.col(kind).alias("kind"), F.lower(F.col(unit)).alias("unit")).filter("nanomolar IS NOT NULL")
    others = [c for c in ("kind", "unit", *names) if c != structure]
    least = shared_checkpoint(keep_least(rows, structure, "nanomolar", *others).filter("nanomolar > 0"))
    return quartile_fence(least, "nanomolar").select(*names, "nanomolar", "kind", "unit")
