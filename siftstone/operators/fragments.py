"""Scores of molecules by the fragments they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.scoring import RARE_FRAGMENT


def fragment_table(rows: DataFrame, score: str = "score", fragments: str = "fragments") -> DataFrame:
    """fragment and score from rows of a score and an array of the fragments that have it. One that stands under several scores has the highest."""
    return rows.select(F.explode(fragments).alias("fragment"), F.col(score).cast("double").alias("score")).groupBy("fragment").agg(F.max("score").alias("score"))


def fragment_scores(counts: DataFrame, table: DataFrame, key: str, fragment: str = "fragment", count: str = "count", default: float = RARE_FRAGMENT) -> DataFrame:
    """key, fragment_score (the mean by count over a molecule's fragments) and kinds (its different fragments).

    Rows of one fragment are added up before the join. table has fragment and score, each fragment once
    (`fragment_table`); those that it lacks score default. Its size is not known beforehand, so the
    engine decides by its statistics whether it is broadcast; a fragment that most molecules have is a
    skewed key of one row on the right, which adaptive execution splits. Null keys, fragments and
    counts, and counts of 0, are left out.
    """
    each = counts.select(F.col(key), F.col(fragment).alias("fragment"), F.col(count).cast("double").alias("n")).filter(F.col(key).isNotNull() & F.col("fragment").isNotNull() & (F.col("n") > 0))
    each = each.groupBy(key, "fragment").agg(F.sum("n").alias("n"))
    scored = each.join(table.select("fragment", "score"), "fragment", "left").withColumn("score", F.coalesce("score", F.lit(default)))
    return scored.groupBy(key).agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("fragment_score"), F.count("*").alias("kinds"))
