"""Whole-table operators: dense row numbers, top fractions, splits, samples, capped unions and overrides.

Row numbers never go through one task: rows are dealt by ranges of the order key, each range is sorted
by itself, and its first number comes from the sizes of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.plans.lineage import shared_checkpoint

_PLACE = (1 << 33) - 1


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_number", start: int = 1) -> DataFrame:
    """df with numbers from start on in the order given, without gaps. Give an order without ties for the same numbers each time."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = shared_checkpoint(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(_PLACE))
    sizes = {r[0]: r[1] for r in held.groupBy(part.alias("p")).count().collect()}  # one row for each partition
    first, seen = [], start
    for p in range(max(sizes, default=-1) + 1):
        first.append(seen)
        seen += sizes.get(p, 0)
    base = F.element_at(F.array(*map(F.lit, first)), (part + 1).cast("int")) if first else F.lit(start)
    return held.withColumn(name, (base + place).cast("long")).drop("__at")


def positional_ids(df: DataFrame, order: Sequence[Column], prefix: str, name: str) -> DataFrame:
    """A text column prefix0, prefix1, ... in the order given."""
    return number_rows(df, order, name, 0).withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string")))


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    return number_rows(df, order, name)


def top_fraction(df: DataFrame, order: Sequence[Column], share: float) -> DataFrame:
    """The first max(1, floor(n * share)) rows in the order given."""
    keep = max(1, int(df.count() * share))
    return number_rows(df, order, "__n").filter(F.col("__n") <= keep).drop("__n")


def end_slices(df: DataFrame, order: Sequence[Column], parts: int = 4, name: str = "slice") -> DataFrame:
    """Rows before n // parts as 'low' and from (parts - 1) * n // parts on as 'high', with their place in the slice from 0."""
    n = df.count()
    low, high = n // parts, (parts - 1) * n // parts
    numbered = number_rows(df, order, "__n", 0).filter((F.col("__n") < low) | (F.col("__n") >= high))
    return numbered.withColumn(name, F.when(F.col("__n") < low, "low").otherwise("high")).withColumn("place", F.when(F.col("__n") < low, F.col("__n")).otherwise(F.col("__n") - high)).drop("__n")


def preference_pairs(df: DataFrame, key: str, score: str, parts: int = 4) -> DataFrame:
    """Pairs of a row of the highest and one of the lowest slice, dealt by place, if the first has the higher score."""
    cut = end_slices(df, [F.col(score), F.col(key)], parts)
    side = lambda kind, k, s: cut.filter(F.col("slice") == kind).select("place", F.col(key).alias(k), F.col(score).alias(s))
    pairs = side("high", "chosen", "chosen_score").join(side("low", "rejected", "rejected_score"), "place")
    return pairs.filter("chosen_score > rejected_score").drop("place")


def seeded_key(key: Column, seed: int) -> Column:
    """md5 of 'seed|key': an order that looks random and is the same everywhere."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, all) rows, those with the smallest seeded keys."""
    return df.orderBy(seeded_key(F.col(key), seed), key).limit(n)


def hash_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42, name: str = "is_train") -> DataFrame:
    """df with a column that is true for the first floor(n * (1 - test_share)) rows in seeded order."""
    n_train = int(df.count() * (1 - test_share))
    return number_rows(df, [seeded_key(F.col(key), seed), F.col(key)], "__n").withColumn(name, F.col("__n") <= n_train).drop("__n")


def group_budget_split(df: DataFrame, group: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """group, n and in_test: whole groups go to the test side in seeded order while they fit in floor(rows * test_share).

    A group that does not fit is passed over, and later ones may still fit. Which groups fit depends on
    all before them, so the sizes of the groups (not the rows) pass in order through one running sum; a
    task holds one batch of them, and sorts by spilling.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    budget = int(df.count() * test_share)

    def deal(batches):
        used = 0
        for batch in batches:
            taken = []
            for n in batch.column(1).to_pylist():
                taken.append(used + n <= budget)
                used += n if taken[-1] else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.bool_())], names=[group, "n", "in_test"])

    held = sizes.repartition(1).sortWithinPartitions(seeded_key(F.col(group), seed), group)
    schema = T.StructType([*sizes.schema.fields, T.StructField("in_test", T.BooleanType())])
    return held.mapInArrow(deal, schema)


def union_distinct_capped(first: DataFrame, second: DataFrame, order: Sequence[Column], cap: int) -> DataFrame:
    """Rows of first and the first cap rows of second in the order given, each once."""
    return first.union(second.orderBy(*order).limit(cap)).distinct()


def override_union(base: DataFrame, better: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: those of better where it has the key, else those of base."""
    left, right = base.select(key, F.col(value).alias("__base")), better.select(key, F.col(value).alias("__better"))
    return left.join(right, key, "full").select(key, F.coalesce("__better", "__base").alias(value))


def cascade(df: DataFrame, key: str, cheap, precise, share: float = 0.1, name: str = "score") -> DataFrame:
    """Scores all rows by cheap and the lowest share of them again by precise, whose scores count. Both map a DataFrame to key and name."""
    fast = shared_checkpoint(cheap(df).select(key, name))
    best = top_fraction(fast, [F.col(name), F.col(key)], share)
    return override_union(fast, precise(df.join(best.select(key), key, "left_semi")).select(key, name), key, name)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """df with value from table by key, or default. A key that table has twice gives its smallest value, not two rows."""
    return df.join(table.groupBy(key).agg(F.min(value).alias(value)), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def ordered_distinct(df: DataFrame, column: str, position: str, cap: int) -> DataFrame:
    """The first cap different values of column, with the position where each one stands first."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(position).alias(position)).orderBy(position).limit(cap)


def keep_least(df: DataFrame, key: str, value: str, *ties: str) -> DataFrame:
    """One row for each key: the one with the least value, then the least ties. Combined before it is dealt, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in (key, value, *ties)]
    best = F.min(F.struct(value, *ties, *rest)).alias("__row")
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"__row.{c}").alias(c) for c in (value, *ties, *rest)))


def concat_columns(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side, by an explicit key; a name that clashes gets the number of its table."""
    out, seen = frames[0], set(frames[0].columns)
    for number, frame in enumerate(frames[1:], 2):
        renamed = rename_clashes(frame, seen - {key}, f"t{number}_", key)
        out, seen = out.join(renamed, key, "left"), seen | set(renamed.columns)
    return out


def rename_clashes(df: DataFrame, taken: set[str], prefix: str, key: str) -> DataFrame:
    """df with prefix before each name (the key aside) that is taken."""
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c in taken and c != key})


def first_of(df: DataFrame, name: str, *alternatives: str) -> DataFrame:
    """df with name, filled from the columns of other names that it has, the first that is not null; these are dropped."""
    there = [c for c in (name, *alternatives) if c in df.columns]
    if not there:
        raise ValueError(f"the table has none of {', '.join((name, *alternatives))}")
    value = F.coalesce(*there) if len(there) > 1 else F.col(there[0])
    return df.withColumn("__value", value).drop(*there).withColumnRenamed("__value", name)


def drop_present(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(c for c in names if c in df.columns))


def select_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def union_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is null."""
    if not frames:
        raise ValueError("there is no table to put together")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
