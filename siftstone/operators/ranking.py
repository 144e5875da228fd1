"""Ranking of candidates by desirability, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.reporting import colour, number_text, parameter_colour
from siftstone.functions.scoring import COMPONENTS, REQUIRED, Desirability, weighted_geometric_mean
from siftstone.operators.clean import present

COMPOSITE = "Composite_Score"


def with_desirability(df: DataFrame, components: Sequence[Desirability] = COMPONENTS, metrics: dict[str, Column] | None = None) -> DataFrame:
    """df with a column for each component and the composite. metrics: expressions for metrics that are no columns."""
    metrics = metrics or {}
    parts = {c.name: c.column(metrics.get(c.metric)) for c in components}
    scored = df.withColumns(parts)
    return scored.withColumn(COMPOSITE, weighted_geometric_mean([(F.col(c.name), c.weight) for c in components]))


def rank_candidates(df: DataFrame, required: Sequence[str] = REQUIRED, components: Sequence[Desirability] = COMPONENTS) -> DataFrame:
    """Rows with all required metrics (NaN counts as there), scored."""
    return with_desirability(df.filter(present(*required)), components)


def top(df: DataFrame, k: int, score: str, *ties: str, nan_last: bool = False) -> DataFrame:
    """The k rows with the highest score, then the smallest ties. NaN is the highest value, unless nan_last."""
    value = F.when(~F.isnan(score), F.col(score)) if nan_last else F.col(score)
    return df.orderBy(value.desc_nulls_last(), *ties).limit(k)


def breakdown(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Long form: key, component and value."""
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select(key, "x.*")


def parameter_table(df: DataFrame, key: str, rows: dict[str, int | None] | Sequence[tuple[str, int | None, float, float, bool]]) -> DataFrame:
    """Long form: key, parameter, text and colour.

    rows: places by column, coloured by the parameters' own ranges; or column, places, good edge, bad edge,
    and whether small is good.
    """
    if isinstance(rows, dict):
        cells = [F.struct(F.lit(c).alias("parameter"), number_text(F.col(c), p).alias("text"), parameter_colour(F.col(c), c).alias("colour")) for c, p in rows.items()]
        return df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")
    cells = [F.struct(F.lit(c).alias("parameter"), number_text(F.col(c), p).alias("text"), colour(F.col(c), good, bad, down).alias("colour")) for c, p, good, bad, down in rows]
    return df.select(key, F.explode(F.array(*cells)).alias("x")).select(key, "x.*")
