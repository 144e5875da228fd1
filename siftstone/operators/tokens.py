"""Vocabularies and token sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.operators.frames import number_rows
from siftstone.plans.lineage import shared_checkpoint

#: Tokens that come first in every vocabulary (fixed values).
SPECIALS = ("<pad>", "<bos>", "<eos>")


def vocabulary(df: DataFrame, tokens: Column, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """token and index: the specials, then all different tokens in byte order."""
    own = df.select(F.explode(tokens).alias("token")).filter(F.col("token").isNotNull() & ~F.col("token").isin(*specials)).distinct()
    first = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, index long")
    return first.unionByName(number_rows(own, [F.col("token")], "index", len(specials)).select("token", "index"))


def _numbered(df: DataFrame) -> DataFrame:
    """df with a number for each row, written so that a row keeps it in every use: keys may repeat."""
    return shared_checkpoint(df.withColumn("__row", F.monotonically_increasing_id()))


def encode(df: DataFrame, key: str, tokens: Column, words: DataFrame, max_len: int, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """key and ids: begin, the indices of the tokens, end, and padding up to max_len; what is longer is cut, its end stays.

    Only tokens that can be in the result are looked up. A token that is not in words becomes the padding.
    """
    pad, bos, eos = range(3)
    seq = _numbered(df.select(F.col(key), F.slice(tokens, 1, max_len - 2).alias("t")))
    found = seq.select("__row", F.posexplode("t").alias("at", "token")).join(words, "token", "left").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("index", F.lit(pad)).alias("i")))).alias("x"))
    body = F.coalesce(F.transform("x", lambda s: s["i"].cast("long")), F.array().cast("array<long>"))
    ids = F.concat(F.array(F.lit(bos).cast("long")), body, F.array(F.lit(eos).cast("long")))
    return seq.select("__row", key).join(found, "__row", "left").select(key, F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.lit(max_len) - F.size(ids))).alias("ids"))


def decode(df: DataFrame, key: str, ids: str, words: DataFrame, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """key and tokens (the specials left out), one row for each row of df."""
    known = words.filter(F.col("index") >= len(specials))
    df = _numbered(df.select(key, ids))
    x = df.select("__row", F.posexplode(ids).alias("at", "index")).join(known, "index").groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("x"))
    return df.select("__row", key).join(x, "__row", "left").select(key, F.coalesce(F.transform("x", lambda s: s["token"]), F.array().cast("array<string>")).alias("tokens"))
