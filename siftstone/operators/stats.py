"""Quantiles, fences, correlations, metrics and reports. Every pass over rows is a sum that is combined before it is dealt."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bracket with so many rows or fewer is looked up in one exact aggregate.
EXACT_ROWS = 200_000
#: Columns whose correlations are one aggregate, at most; columns of a block, and rows of a matrix that are dealt together.
MANY_COLUMNS, BLOCK_COLUMNS, STRIPE = 24, 512, 64


def nth_value(df: DataFrame, column: str, k: int, exact_rows: int = EXACT_ROWS):
    """Value number k (from 0) of a column in ascending order without nulls, or None if it has fewer.

    Nothing is sorted as a whole: approximate quantiles around the place give a bracket, counts say how
    many rows are below it, and the bracket is narrowed until it is small or holds a single value.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    if not 0 <= k < n:
        return None
    while n > exact_rows:
        share = (k + 0.5) / n
        low, high = rows.agg(F.percentile_approx("v", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000)).first()[0]
        below, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high and below <= k < below + within:
            return low
        if not below <= k < below + within or within == n:
            break  # the estimate missed, or cannot be narrowed: the exact aggregate below has the last word
        rows, k, n = rows.filter(F.col("v").between(low, high)), k - below, within
    return rows.agg(F.expr(f"percentile_disc({(k + 0.5) / n}D) WITHIN GROUP (ORDER BY v)")).first()[0]


def nearest_quantile(df: DataFrame, column: str, q: float):
    """The value whose place from 0 is floor((n - 1) * q + 0.5)."""
    n = df.filter(F.col(column).isNotNull()).count()
    return nth_value(df, column, int((n - 1) * q + 0.5)) if n else None


def nearest_quantiles(df: DataFrame, column: str, shares: Sequence[float], exact_rows: int = EXACT_ROWS) -> list:
    """The values whose places from 0 are floor((n - 1) * share + 0.5), all at once, exact; None without values.

    One pass counts and sketches (mergeable, a fixed size), one counts what lies below and inside the
    bracket that the sketch gives for each share, and one looks the values up in the brackets. A bracket
    that misses its place or stays large is narrowed on its own by `nth_value`.
    """
    rows = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    sketch = F.expr("kll_sketch_agg_double(CASE WHEN isnan(v) THEN NULL ELSE v END, 4096)")
    n, nan, found = rows.agg(F.count("*"), F.count_if(F.isnan("v")), sketch).first()
    if not n:
        return [None] * len(shares)
    places = [int((n - 1) * q + 0.5) for q in shares]
    if n <= exact_rows or nan:
        return [nth_value(df, column, k, exact_rows) for k in places] if nan or len(shares) > 1000 else list(rows.agg(*(F.expr(f"percentile_disc({(k + 0.5) / n}D) WITHIN GROUP (ORDER BY v)") for k in places)).first())
    ends = [min(1.0, max(0.0, (k + 0.5) / n + d)) for k in places for d in (-0.002, 0.002)]
    spark = df.sparkSession
    edges = spark.createDataFrame([(bytes(found),)], "s binary").select(*(F.expr(f"kll_sketch_get_quantile_double(s, {e!r}D)") for e in ends)).first()
    brackets = [(low, high) for low, high in zip(edges[::2], edges[1::2])]
    v = F.col("v")
    counts = rows.agg(*(c for low, high in brackets for c in (F.count_if(v < low), F.count_if(v.between(low, high))))).first()
    out, asked = [None] * len(places), []
    for i, (k, (low, high), below, within) in enumerate(zip(places, brackets, counts[::2], counts[1::2])):
        if not below <= k < below + within or low != high and within > exact_rows:
            out[i] = nth_value(df, column, k, exact_rows)
        elif low == high:
            out[i] = low
        else:
            asked.append((i, F.expr(f"percentile_disc({(k - below + 0.5) / within}D) WITHIN GROUP (ORDER BY v) FILTER (WHERE v BETWEEN {low!r}D AND {high!r}D)")))
    if asked:
        for (i, _), value in zip(asked, rows.agg(*(c for _, c in asked)).first()):
            out[i] = value
    return out


def quartile_fence(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows within reach times the distance of the quartiles beyond them, edges included. The two quartiles are plain numbers in the filter, which a scan can use."""
    low, high = nearest_quantiles(df, column, [0.25, 0.75])
    if low is None:
        return df.limit(0)
    return df.filter(F.col(column).between(low - reach * (high - low), high + reach * (high - low)))


def _guarded_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; 0 if a column is constant, or if a value is NaN."""
    spread = (F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0)
    return F.when(spread, 0.0).otherwise(F.coalesce(F.nanvl(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)), F.lit(0.0)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, corr of the upper triangle. A null makes a column's correlations 0, as a NaN does, and so does a constant column.

    Few columns are one aggregate, more of them are sums of products by blocks of columns (`cross_correlations`).
    """
    if len(columns) > MANY_COLUMNS:
        names, blocks = list(columns), [list(columns[i : i + BLOCK_COLUMNS]) for i in range(0, len(columns), BLOCK_COLUMNS)]
        rows = [cross_correlations(df, a, b) for i, a in enumerate(blocks) for b in blocks[i:]]
        place = lambda c: F.array_position(F.lit(names), F.col(c))
        return reduce(DataFrame.union, rows).filter(place("column_a") < place("column_b"))
    wide = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.agg(*(_guarded_corr(F.col(a), F.col(b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def summed_stripes(df: DataFrame, *keys: str) -> DataFrame:
    """stripe and sums: the arrays of float64 of equal keys added up, one after the other as they come."""

    def add(batches):
        now, total = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["stripe", "salt", "sums"])
        for batch in batches:
            for stripe, salt, sums in zip(*(c.to_pylist() for c in batch.columns)):
                key = (stripe, salt if "salt" in keys else 0)
                if key != now:
                    if now is not None:
                        yield row()
                    now, total = key, np.zeros(len(sums) // 8)
                total = total + np.frombuffer(sums)
        if now is not None:
            yield row()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, "stripe int, salt int, sums binary")


def cross_correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """column_a, column_b and corr (Pearson; 0 for a constant column and one with a null or NaN) of each of left with each of right, in one pass over these columns.

    A task adds up products of its rows as one matrix, left x right, which bounds its memory; matrices
    are added up by stripes of STRIPE columns, first within 64 parts of the tasks. Values are taken
    relative to the first row's, so sums of large numbers lose nothing and a constant column is exactly 0.
    """
    left, right = list(left), list(right)
    both = list(dict.fromkeys(left + right))
    numbers = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(both)))
    first = numbers.limit(1).collect()
    shift = np.array([0.0 if v is None or not np.isfinite(v) else v for v in first[0]]) if first else np.zeros(len(both))
    at_a, at_b = ([both.index(c) for c in side] for side in (left, right))
    stripes = range(0, len(left), STRIPE)

    def products(batches):
        from pyspark import TaskContext

        n, cross, sums, squares = 0, np.zeros((len(left), len(right))), np.zeros(len(both)), np.zeros(len(both))
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = np.column_stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in part.columns]) - shift
                n, sums, squares = n + len(x), sums + x.sum(axis=0), squares + (x * x).sum(axis=0)
                cross += x[:, at_a].T @ x[:, at_b]
        if n:
            a, b = (np.stack([sums[at], squares[at]]) for at in (at_a, at_b))
            values = [np.concatenate([cross[s : s + STRIPE].ravel(), a[:, s : s + STRIPE].ravel(), b.ravel(), [n]]).tobytes() for s in stripes]
            salt = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([salt] * len(values), pa.int32()), pa.array(values, pa.binary())], names=["stripe", "salt", "sums"])

    def correlations(batches):
        for batch in batches:
            for stripe, _, sums in zip(*(c.to_pylist() for c in batch.columns)):
                own, v = left[stripe * STRIPE : (stripe + 1) * STRIPE], np.frombuffer(sums)
                n, p, q = v[-1], len(own), len(right)
                cross, (sa, qa), (sb, qb) = v[: p * q].reshape(p, q) / n, v[p * q : p * q + 2 * p].reshape(2, p) / n, v[p * q + 2 * p : -1].reshape(2, q) / n
                spread = np.sqrt(np.maximum(qa - sa * sa, 0))[:, None] * np.sqrt(np.maximum(qb - sb * sb, 0))
                with np.errstate(invalid="ignore", divide="ignore"):
                    corr = np.nan_to_num((cross - sa[:, None] * sb) / spread, nan=0.0, posinf=0.0, neginf=0.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, q)), pa.array(right * p), pa.array(np.clip(corr.ravel(), -1, 1))], names=["column_a", "column_b", "corr"])

    added = summed_stripes(summed_stripes(numbers.mapInArrow(products, "stripe int, salt int, sums binary"), "stripe", "salt"), "stripe")
    return added.mapInArrow(correlations, "column_a string, column_b string, corr double")


def select_uncorrelated(df: DataFrame, columns: Sequence[str], limit: float = 0.95, block: int = BLOCK_COLUMNS) -> list[str]:
    """Columns, in the order given, whose correlation with each one kept before is under limit in size. Columns with a null and constant ones stay.

    block columns at a time are held against each other and those kept; only pairs at limit or more come
    to the driver. A pass over the rows for each block.
    """
    kept: list[str] = []
    for at in range(0, len(columns), block):
        own = list(columns[at : at + block])
        alike: dict[str, set[str]] = {}
        if len(kept) + len(own) > 1:
            pairs = cross_correlations(df, own, kept + own) if len(columns) > MANY_COLUMNS else correlation_matrix(df, own)
            for r in pairs.filter(F.abs("corr") >= limit).collect():
                alike.setdefault(r.column_a, set()).add(r.column_b)
                alike.setdefault(r.column_b, set()).add(r.column_a)
        for c in own:
            if not alike.get(c, set()) & set(kept):
                kept.append(c)
    return kept


def regression_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """n, rmse and r2 (0 if the truth is constant), in one pass."""
    x = df.select(truth.cast("double").alias("y"), predicted.cast("double").alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")
    one = x.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("mse"), F.var_pop("y").alias("var"))
    return one.select("n", F.sqrt("mse").alias("rmse"), F.when(F.col("var") == 0, 0.0).otherwise(F.lit(1.0) - F.try_divide("mse", "var")).alias("r2"))


def standardise(df: DataFrame, column: str, name: str = "z", epsilon: float = 1e-8) -> DataFrame:
    """(x - mean) / (population deviation + epsilon). The two numbers are one row of sums, joined by broadcast."""
    one = df.agg(F.avg(column).alias("__mean"), F.stddev_pop(column).alias("__dev"))
    return df.crossJoin(F.broadcast(one)).withColumn(name, (F.col(column) - F.col("__mean")) / (F.col("__dev") + epsilon)).drop("__mean", "__dev")


def histogram(df: DataFrame, column: str, low: float, width: float) -> DataFrame:
    """bucket (from 0 at low) and n, for buckets with rows."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - low) / width).alias("bucket")).agg(F.count("*").alias("n"))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def generation_metrics(df: DataFrame, value: str, valid: Column, means: Sequence[str] = ()) -> DataFrame:
    """total, valid, unique, validity, uniqueness, diversity and means over valid rows; shares of nothing are 0.

    Different values are counted by grouping, not in one task's set.
    """
    ok = F.coalesce(valid, F.lit(False))
    per_value = df.select(F.col(value).alias("v"), ok.alias("ok"), *means).groupBy("v", "ok").agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in means), *(F.count(m).alias(f"{m}__n") for m in means))
    good = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), c)), F.lit(0))
    one = per_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), good(F.col("n")).alias("valid"), F.count_if(F.col("ok") & F.col("v").isNotNull()).alias("unique"), *(share(good(F.col(m)), good(F.col(f"{m}__n"))).alias(f"mean_{m}") for m in means))
    return one.select("total", "valid", "unique", share(F.col("valid"), F.col("total")).alias("validity"), share(F.col("unique"), F.col("total")).alias("uniqueness"), share(F.col("unique"), F.col("valid")).alias("diversity"), *(f"mean_{m}" for m in means))


def pass_rates(df: DataFrame, predicates: dict[str, Column], whole: str = "all") -> DataFrame:
    """rule, passed, percent: a row for each predicate and one for all of them together, in one pass. A null predicate does not hold."""
    hold = {k: F.coalesce(p, F.lit(False)) for k, p in predicates.items()}
    every = F.lit(True)
    for p in hold.values():
        every = every & p
    hold |= {whole: every}
    one = df.agg(F.count("*").alias("n"), *(F.count_if(p).alias(f"c{i}") for i, p in enumerate(hold.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("passed"), (share(F.col(f"c{i}"), F.col("n")) * 100).alias("percent")) for i, k in enumerate(hold)))).alias("x")).select("x.*")


def score_summary(df: DataFrame, score: Column, cut: float = -7.0) -> DataFrame:
    """n, mean, best (least) and number at cut or less."""
    return df.agg(F.count(score).alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("best_score"), F.count_if(score <= cut).alias("at_cut"))


def outcome_counts(df: DataFrame, ok: Column, *groups: str) -> DataFrame:
    """total, succeeded and failed, for each group if any are named. A null outcome is a failure."""
    good = F.coalesce(ok, F.lit(False))
    return df.groupBy(*groups).agg(F.count("*").alias("total"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def kept_percent(rows: DataFrame, kept: DataFrame, value: str) -> DataFrame:
    """total rows, the different values among those kept, and these in percent of the total (0 of nothing)."""
    different = kept.filter(F.col(value).isNotNull()).select(value).distinct().agg(F.count("*").alias("kept"))
    one = rows.agg(F.count("*").alias("total")).crossJoin(F.broadcast(different))  # one row each
    return one.select("total", "kept", (share(F.col("kept"), F.col("total")) * 100).alias("percent"))


def centroid(df: DataFrame, group: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    return df.groupBy(group).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(z).alias("cz"), F.count("*").alias("n"))


def mean_vector(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean of each place of the vectors of a group, as an array."""
    places = df.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    return places.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


def table_fingerprint(df: DataFrame, column: str, group_values: int = 1 << 16) -> DataFrame:
    """sha256 over a tree of digests of the values of a column, and n: the same for any order of rows.

    Each group's digest is over its sorted values; the group is a part of a value's own digest, so
    groups are even and none has all rows (a value that repeats is one entry with its count). There are
    256 groups, and 256 times as many until one has about group_values values or fewer; digests of 256
    groups at a time are put together until one is left.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")).select(F.sha2(F.concat_ws("\n", "v", F.col("n").cast("string")), 256).alias("d"), "n")
    digits = 2
    if (most := df.agg(F.approx_count_distinct(column)).first()[0]) > 256 * group_values:
        while most > 16**digits * group_values:
            digits += 2
    groups, joined = values.withColumn("g", F.substring("d", 1, digits)), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d")
    for size in range(digits, 0, -2):
        groups = groups.groupBy(F.substring("g", 1, size).alias("g")).agg(joined, F.sum("n").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def sorted_digest(df: DataFrame, column: str, separator: str = "\n", chunk_bytes: int = 1 << 20) -> DataFrame:
    """digest (sha256 of all values that are not null, sorted by their bytes and joined by separator) and n.

    Values are sorted over ranges and joined to chunks there; a digest of one text has an order, so the
    chunks then pass one after the other through one task, which holds one of them at a time. For
    tables whose text is too long for that there is `table_fingerprint`.
    """

    def join(batches):
        from pyspark import TaskContext

        part, seq, texts, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([separator.join(texts)]), pa.array([len(texts)], pa.int64())], names=["part", "seq", "text", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                texts.append(value)
                size += len(value) + 1
                if size >= chunk_bytes:
                    yield chunk()
                    seq, texts, size = seq + 1, [], 0
        if texts:
            yield chunk()

    def digest(batches):
        sha, n = hashlib.sha256(), 0
        for batch in batches:
            for text, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sha.update((separator if n else "").encode() + text.encode())
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], names=["digest", "n"])

    values = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL")
    chunks = values.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(join, "part int, seq int, text string, n long")
    nothing = df.sparkSession.createDataFrame([(-1, 0, "", 0)], "part int, seq int, text string, n long")  # an empty table has a digest too
    return chunks.union(nothing).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(digest, "digest string, n long")
