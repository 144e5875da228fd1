"""Seeded choices from arrays of logits as column expressions: multinomial, top-k and top-p."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seeded_uniform(key: Column, seed: int) -> Column:
    """A number from 0 up to 1 that depends on seed and key only: the first 52 bits of md5 of 'seed|key'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def choose(logits: Column, u: Column, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> Column:
    """The place (from 0) of a choice among logits by their softmax: where u, from 0 up to 1, falls in the running sum of the shares, the highest first (of equal ones the first).

    top_k: only the k highest; top_p: only the highest up to the one that brings their sum to top_p or more.
    A null or NaN logit is never chosen; null for no logits or a null u.
    """
    if temperature <= 0 or top_k is not None and top_k < 1 or top_p is not None and not 0 < top_p <= 1:
        raise ValueError("temperature must be over 0, top_k 1 or more, top_p over 0 and up to 1")
    entries = F.transform(logits, lambda x, i: F.struct((-x.cast("double") / temperature).alias("down"), i.alias("at")))
    entries = F.array_sort(F.filter(entries, lambda e: e["down"].isNotNull() & ~F.isnan(e["down"])))
    if top_k is not None:
        entries = F.slice(entries, 1, top_k)
    weights = _let(entries, lambda es: F.transform(es, lambda e: F.struct(F.exp(F.get(es, F.lit(0))["down"] - e["down"]).alias("w"), e["at"].alias("at"))))

    def pick(ws: Column) -> Column:
        zero = F.lit(0.0)
        total = F.aggregate(ws, zero, lambda s, e: s + e["w"])
        if top_p is not None:  # entries whose sum before them is short of top_p
            total = _let(total, lambda t: F.aggregate(ws, zero, lambda s, e: F.when(s < t * top_p, s + e["w"]).otherwise(s)))

        def walk(target: Column) -> Column:
            start = F.struct(zero.alias("sum"), F.lit(-1).alias("at"))
            step = lambda a, e: F.when(a["sum"] > target, a).otherwise(F.struct((a["sum"] + e["w"]).alias("sum"), e["at"].alias("at")))
            return F.aggregate(ws, start, step, lambda a: a["at"])

        return _let(total * u, walk)

    return _let(weights, lambda ws: F.when((F.size(ws) > 0) & u.isNotNull(), pick(ws)))
