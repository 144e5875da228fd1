"""Similarity joins over packed fingerprints, and nearest neighbours of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.similarity import bit_total, set_bits, tanimoto
from siftstone.operators.frames import hash_sample
from siftstone.plans.lineage import shared_checkpoint

#: Vectors in a block, and queries that are held against one at a time.
BLOCK_ROWS, QUERY_ROWS = 4096, 256
#: Fingerprints in a block, rows of one that are held against another at a time, and pairs that are written at a time.
PRINT_ROWS, TILE_ROWS, PAIR_ROWS = 2048, 64, 1 << 16
#: Tasks that blocks of fingerprints meet in, about; and how much more work a pair of a join is than a pair of words held against each other.
MEETINGS, JOIN_COST = 576, 200


def _sides(left: DataFrame, right: DataFrame, left_id: str, right_id: str, bits: str) -> tuple[DataFrame, DataFrame]:
    """(l, fp) and (r, fp) of the rows with a fingerprint."""
    return tuple(df.select(F.col(i).alias(name), F.col(bits).alias("fp")).filter("fp IS NOT NULL") for df, i, name in ((left, left_id, "l"), (right, right_id, "r")))


def _different(rows: DataFrame, *more: Column) -> DataFrame:
    """fp, n (bits), id and many of the different fingerprints with a bit, written to the shared folder. more: sums by fingerprint that id and many come from; without them they are 0 and true."""
    found = rows.groupBy("fp").agg(*more) if more else rows.select("fp", F.lit(0).cast("long").alias("id"), F.lit(True).alias("many")).distinct()
    return shared_checkpoint(found.withColumn("n", bit_total(F.col("fp"))).filter("n > 0"))


def _prefixes(da: DataFrame, db: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(fa, na, la, bit) and (fb, nb, lb, bit): each fingerprint beside each bit of its prefix, rare ones of the right side first, and how many bits it has from that one on."""
    counts = db.select(F.explode(set_bits(F.col("fp"))).alias("bit")).groupBy("bit").count()
    rare = F.broadcast(counts.agg(F.map_from_entries(F.collect_list(F.struct("bit", "count"))).alias("rare")))  # one entry for each bit of a fingerprint

    def prefixes(df: DataFrame) -> DataFrame:
        ranked = F.array_sort(F.transform(set_bits(F.col("fp")), lambda x: F.struct(F.coalesce(F.element_at("rare", x), F.lit(0)).alias("c"), x.alias("bit"))))
        size = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
        return df.crossJoin(rare).select("fp", "n", F.posexplode(F.slice(ranked, F.lit(1), size)).alias("at", "x")).select("fp", "n", (F.col("n") - F.col("at")).alias("left"), F.col("x.bit").alias("bit"))

    return prefixes(da).toDF("fa", "na", "la", "bit"), prefixes(db).toDF("fb", "nb", "lb", "bit")


def _on_bits(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """fa, fb and similarity of the similar ones of `_prefixes`."""
    enough = F.least("la", "lb") >= (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9
    sizes = F.col("nb").between(F.ceil(F.col("na") * least - 1e-9), F.floor(F.col("na") / least + 1e-9))
    return x.join(y, "bit").filter(sizes & enough).select("fa", "fb", tanimoto(F.col("fa"), F.col("fb")).alias("similarity")).filter(F.col("similarity") >= least - 1e-12).distinct()


def _pairs_on_bits(da: DataFrame, db: DataFrame, least: float) -> tuple[DataFrame, DataFrame] | None:
    """The prefixes of both sides if joining them is less work than holding all fingerprints against each other, or None. In 64 bits every bit is a common one."""
    (m, words), (n, other) = (df.agg(F.count("*"), F.coalesce(F.max(F.size("fp")), F.lit(0))).first() for df in (da, db))
    words = max(words, other)
    if words < 2:
        return None
    x, y = _prefixes(da, db, least)
    met = x.groupBy("bit").count().join(y.groupBy("bit").agg(F.count("*").alias("other")), "bit").agg(F.coalesce(F.sum(F.col("count").cast("double") * F.col("other")), F.lit(0.0))).first()[0]
    return (x, y) if met * JOIN_COST <= m * n * words else None


def _lists(words: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.view(np.int64).ravel()))


def _fingerprint_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Fingerprints (fp, n, id, many) as blocks of at most PRINT_ROWS of a like number of bits and the same width."""

    def pack(batches):
        for batch in batches:
            fp, ids, many = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            size, words = pc.list_value_length(fp).to_numpy(), fp.flatten().to_numpy().view(np.uint64)
            first = np.cumsum(size) - size
            for width in np.unique(size).tolist():
                own = np.flatnonzero(size == width)
                for at in range(0, len(own), PRINT_ROWS):
                    part = own[at : at + PRINT_ROWS]
                    values = [[width], *([x.tobytes()] for x in (words[first[part][:, None] + np.arange(width)], ids[part], many[part]))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["width", "fps", "ids", "many"])

    dealt = rows.repartitionByRange(parts, "n", "fp").sortWithinPartitions("n", "fp").select("fp", "id", "many")
    return shared_checkpoint(dealt.mapInArrow(pack, "width int, fps binary, ids binary, many binary"))


def _block_pairs(da: DataFrame, db: DataFrame, ranges: int) -> DataFrame:
    """Each block of the left beside each one of the right; the right ones of a left block follow each other. ranges: of the left side, at most; together about MEETINGS tasks, however many blocks there are."""
    parts = [-(-df.count() // PRINT_ROWS) or 1 for df in (da, db)]
    p = min(parts[0], ranges)
    q = min(parts[1], max(1, MEETINGS // p))
    name = lambda df, end: df.toDF(*(c + end for c in df.columns))
    return name(_fingerprint_blocks(da, p), "_a").hint("shuffle_replicate_nl").crossJoin(name(_fingerprint_blocks(db, q), "_b"))


def _met(batches):
    """(words, ids, many) of the left and the right block of each pair of them that is of one width."""
    for batch in batches:
        for k in range(batch.num_rows):
            (width, *one), (other, *two) = ([batch.column(at)[k] for at in range(low, low + 4)] for low in (0, 4))
            if width.as_py() == other.as_py():
                yield tuple((np.frombuffer(f.as_buffer(), np.uint64).reshape(-1, width.as_py()), np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(m.as_buffer(), bool)) for f, i, m in (one, two))


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, similarity) of the pairs of least or more, a bounded tile of all pairs at a time."""
    na, nb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    if nb.max() < least * na.min() - 1e-9 or na.max() < least * nb.min() - 1e-9:
        return
    needed = np.ceil(least / (1 + least) * (na + nb.min()) - 1e-9).astype(np.uint16)
    columns = [np.ascontiguousarray(b[:, w]) for w in range(b.shape[1])]
    for at in range(0, len(a), TILE_ROWS):
        tile = a[at : at + TILE_ROWS]
        both = np.bitwise_count(tile[:, :1] & columns[0])
        if len(columns) > 1:
            both = both.astype(np.uint16)
            for w in range(1, len(columns)):
                both += np.bitwise_count(tile[:, w : w + 1] & columns[w])
        i, j = np.divmod(np.flatnonzero(both >= needed[at : at + TILE_ROWS, None].astype(both.dtype)), len(b))
        common = both[i, j].astype(np.int64)
        share = common / (na[at + i] + nb[j] - common)
        ok = share >= least - 1e-12
        if ok.any():
            yield at + i[ok], j[ok], share[ok]


def _pairs_in_blocks(da: DataFrame, db: DataFrame, least: float) -> DataFrame:
    """fa, fb and similarity of the similar fingerprints: all are held against all, block by block."""

    def run(batches):
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([*(_lists(np.concatenate([h[i] for h in held])) for i in (0, 1)), pa.array(np.concatenate([h[2] for h in held]))], names=["fa", "fb", "similarity"])
        for (a, _, _), (b, _, _) in _met(batches):
            if held and held[-1][0].shape[1] != a.shape[1]:
                yield flush()
                held, size = [], 0
            for i, j, share in _alike(a, b, least):
                held.append((a[i], b[j], share))
                size += len(share)
                if size > PAIR_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return _block_pairs(da, db, 24).mapInArrow(run, "fa array<long>, fb array<long>, similarity double")


def _known_in_blocks(da: DataFrame, db: DataFrame, least: float) -> DataFrame:
    """fp and id of the left fingerprints that are similar to one of the right with several ids, or with another id. A left one that has met such a one meets no further block of its task."""

    def run(batches):
        last, state = None, None

        def found():
            words, ids, open_ = state
            done = np.ones(len(ids), bool)
            done[open_] = False
            return pa.RecordBatch.from_arrays([_lists(words[done]), pa.array(ids[done])], names=["fp", "id"])

        for (a, ids, _), (b, others, many) in _met(batches):
            now = (a.tobytes(), ids.tobytes())
            if now != last:
                if state:
                    yield found()
                last, state = now, [a.copy(), ids.copy(), np.arange(len(a))]
            open_ = state[2]
            if len(open_):
                seen = np.zeros(len(open_), bool)
                for i, j, _ in _alike(a[open_], b, least):
                    seen[i[many[j] | (others[j] != ids[open_[i]])]] = True
                state[2] = open_[~seen]
        if state:
            yield found()

    return _block_pairs(da, db, MEETINGS).mapInArrow(run, "fp array<long>, id long").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, bits: str = "bits", least: float = 0.9) -> DataFrame:
    """left_id, right_id and similarity of all pairs with a Tanimoto similarity of least or more.

    Prefix filtering, without loss: with bits in one order for both sides, two sets this similar share
    one of their first n - ceil(least * n) + 1 bits. Bits are ordered by how many of the right rows have
    them, so rows meet on rare bits. Where two meet on their first common bit, all others that they share
    stand behind it in both: a pair with too few bits left there is passed over. Where bits are so common that
    this is more work than to hold all fingerprints against each other, blocks of them meet in tasks, of
    which each holds two blocks. Different fingerprints meet once; ids of equal ones are joined after that. Rows without bits are similar to nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be over 0, up to 1")
    a, b = _sides(left, right, left_id, right_id, bits)
    da, db = _different(a), _different(b)
    on_bits = _pairs_on_bits(da, db, least)
    found = _on_bits(*on_bits, least) if on_bits else _pairs_in_blocks(da, db, least)
    return a.join(found, F.col("fp") == F.col("fa")).select("l", "fb", "similarity").join(b, F.col("fp") == F.col("fb")).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "similarity")


def _numbers(a: DataFrame, b: DataFrame) -> tuple[Column, Column]:
    """The ids l and r as longs: themselves, or hashes of those that are no whole numbers."""
    whole = all(isinstance(df.schema[i].dataType, T.IntegralType) for df, i in ((a, "l"), (b, "r")))
    return tuple(F.col(i).cast("long") if whole else F.xxhash64(F.col(i).cast("string")) for i in ("l", "r"))


def novel(left: DataFrame, right: DataFrame, left_id: str, right_id: str, bits: str = "bits", most: float = 0.9, skip_same: bool = False) -> DataFrame:
    """Rows of left without a row of right at a similarity of most or more; skip_same: a row of the same id does not count."""
    if not 0 < most <= 1:
        raise ValueError("the least similarity must be over 0, up to 1")
    a, b = _sides(left, right, left_id, right_id, bits)
    if skip_same:
        own, other = _numbers(a, b)
        a, b = a.filter("l IS NOT NULL").withColumn("id", own), b.filter("r IS NOT NULL")
        da = shared_checkpoint(a.select("fp", "id", F.lit(False).alias("many")).distinct().withColumn("n", bit_total(F.col("fp"))).filter("n > 0"))
        db = _different(b, F.min(other).alias("id"), (F.min(other) < F.max(other)).alias("many"))
    else:
        a = a.withColumn("id", F.lit(0).cast("long"))
        da, db = _different(a), _different(b)
    if _pairs_on_bits(da, db, most):
        pairs = similar_pairs(left, right, left_id, right_id, bits, most)
        known = (pairs.filter(F.col(left_id) != F.col(right_id)) if skip_same else pairs).select(left_id).distinct()
    else:
        known = a.join(_known_in_blocks(da, db, most), ["fp", "id"]).select(F.col("l").alias(left_id)).distinct()
    return left.join(known, left_id, "left_anti")


def diversity(df: DataFrame, key: str, bits: str = "bits", sample: int = 500, seed: int = 42) -> DataFrame:
    """n_pairs and mean_similarity over all pairs of a seeded sample of min(sample, n) rows; 0 without pairs."""
    few = hash_sample(df.select(F.col(key).alias("k"), F.col(bits).alias("fp")), "k", sample, seed)
    other = F.broadcast(few.toDF("k2", "fp2"))  # sample rows at most
    return few.join(other, F.col("k") < F.col("k2")).agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(tanimoto(F.col("fp"), F.col("fp2"))), F.lit(0.0)).alias("mean_similarity"))


def nearest(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, vector: str, block_rows: int = BLOCK_ROWS, skip_same: bool = False) -> DataFrame:
    """query_id, row_id and similarity of the row with the highest cosine similarity (6 places; then the smallest id).

    Queries and rows are packed in blocks of a bounded size where they are; each block of queries meets each
    block of rows in a task, which keeps the best of them, and the bests are combined. No vector goes
    through the driver. Null ids, null vectors and those of length zero are left out. skip_same: a row
    of the query's own id is no answer to it; a query without another row has none.
    """

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ids, vectors = part.column(0).to_numpy(), np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                size = np.linalg.norm(vectors, axis=1)
                ids, vectors = ids[size > 0], vectors[size > 0] / size[size > 0, None]
                order = np.argsort(ids, kind="stable")
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids[order], vectors[order])], names=["ids", "vectors"])

    def best(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # blocks are read where they lie: a batch holds many pairs of them
                q, x, r, y = (c[k].as_buffer() for c in batch.columns)
                ids, own = np.frombuffer(q, np.int64), np.frombuffer(r, np.int64)
                vectors, others = np.frombuffer(x).reshape(len(ids), -1), np.frombuffer(y).reshape(len(own), -1).T
                for low in range(0, len(ids), QUERY_ROWS):
                    some = ids[low : low + QUERY_ROWS]
                    alike = vectors[low : low + QUERY_ROWS] @ others
                    np.round(alike, 6, out=alike)
                    if skip_same:
                        alike[some[:, None] == own] = -np.inf
                    at = alike.argmax(axis=1)
                    top = alike[np.arange(len(some)), at]
                    ok = top > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(some[ok]), pa.array(own[at][ok]), pa.array(top[ok])], names=["q", "r", "s"])

    blocks = lambda df, i: df.select(F.col(i).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").mapInArrow(pack, "ids binary, vectors binary")
    met = blocks(queries, query_id).toDF("q", "x").crossJoin(blocks(rows, row_id).toDF("r", "y"))
    top = met.mapInArrow(best, "q long, r long, s double").groupBy("q").agg(F.max(F.struct("s", (-F.col("r")).alias("r"))).alias("x"))
    return top.select(F.col("q").alias(query_id), (-F.col("x.r")).alias(row_id), F.col("x.s").alias("similarity"))
