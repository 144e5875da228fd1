"""Nearest neighbours by lists of vectors around centres.

Centres are learned on a bounded sample; every row stands in the list of its nearest centre. In a list, rows
are ordered by their closeness to the centre and cut into blocks, so a block is a ring: it knows the least
and the greatest closeness it holds, and with that the best similarity any query can find in it. A search
looks into a few lists of each query first. An exact search then looks into each further list whose rings
could hold something better, and into no other one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.frames import hash_sample
from siftstone.plans.lineage import shared_checkpoint

#: Rows that centres are learned on, at most, and the number of lists, at most.
SAMPLE, MOST_LISTS = 20_000, 1024
#: Share of the sample's rows that must find their nearest one in the lists a search looks into.
RECALL = 0.97
#: Rows in a block, and queries that meet it at a time.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: Queries of a block that are held against one of rows at a time.
_TILE = 256
#: Similarities are compared to six places: a ring is passed over only if it is worse by more than this.
MARGIN = 2e-6
_BLOCKS = "list int, low double, high double, ids binary, vectors binary"


def _units(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length one of the rows (id, vector) whose vector has a length that is over 0 and finite."""
    vectors = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else np.empty((0, 1))
    size = np.linalg.norm(vectors, axis=1)
    ok = np.isfinite(size) & (size > 0)
    return batch.column(0).to_numpy()[ok], vectors[ok] / size[ok, None]


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False)))


def learn_centres(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centres of length one: the mean direction of what is nearest to each, beginning with rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)]
    for _ in range(rounds):
        at = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def needed_probes(sample: np.ndarray, centres: np.ndarray, share: float = RECALL, queries: int = 500) -> int:
    """How many lists a search must look into so that share of some rows of the sample find their nearest one in it."""
    asked = sample[np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int)]
    alike = asked @ sample.T
    alike[alike > 1 - 1e-9] = -np.inf  # the row itself and its copies
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    own = (sample @ centres.T).argmax(axis=1)[alike.argmax(axis=1)]
    return int(np.quantile((order == own[:, None]).argmax(axis=1), share, method="higher")) + 1


def best_possible(closeness: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest similarity that a query of this closeness to a centre can have with a row whose closeness to it is from low to high."""
    q, near, far = (np.arccos(np.clip(x, -1, 1)) for x in (closeness, high, low))
    return np.cos(np.maximum(0, np.maximum(near - q, q - far)))


@dataclass(frozen=True)
class VectorIndex:
    """centres (lists x places), the blocks of all rows (list, low and high closeness, ids and vectors), and how many lists a search looks into unless it is told."""

    centres: np.ndarray
    blocks: DataFrame
    probes: int = 1

    @staticmethod
    def build(rows: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 42) -> VectorIndex:
        """An index of every row with an id and a vector without nulls, of a finite length over 0.

        lists: the square root of the number of rows, up to MOST_LISTS. Rows are dealt by ranges of list,
        closeness and id, so a list with most of the rows is many blocks in many tasks, and equal vectors
        are told apart by id. Repeated ids are rows of their own. The blocks are written to the shared folder.
        probes is measured on the sample.
        """
        known = _rows(rows, id_col, vector_col)
        few = hash_sample(known, "id", sample, seed).collect()  # at most sample rows
        picked = np.array([r.v for r in few] or [[0.0]], np.float64)
        size = np.linalg.norm(picked, axis=1)
        picked = picked[np.isfinite(size) & (size > 0)] / size[np.isfinite(size) & (size > 0), None]
        lists = min(lists or int(min(MOST_LISTS, max(1.0, known.count() ** 0.5))), max(1, len(picked)))
        centres = learn_centres(picked, lists) if len(picked) else np.zeros((1, 1))

        def assign(batches):
            for batch in batches:
                ids, vectors = _units(batch)
                if len(ids):
                    near = vectors @ centres.T
                    at = near.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(near[np.arange(len(ids)), at]), pa.array(ids), pa.array([v.tobytes() for v in vectors], pa.binary())], names=["list", "near", "id", "v"])

        placed = known.mapInArrow(assign, "list int, near double, id long, v binary")
        return VectorIndex(centres, shared_checkpoint(_pack(placed, BLOCK_ROWS)), needed_probes(picked, centres) if len(picked) else 1)

    def write(self, path: str) -> None:
        spark = self.blocks.sparkSession
        self.blocks.write.parquet(f"{path}/blocks")
        spark.createDataFrame([(i, c.tolist(), self.probes) for i, c in enumerate(self.centres)], "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{path}/centres")

    @staticmethod
    def load(spark, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path}/centres").collect())
        return VectorIndex(np.array([r.centre for r in rows]), spark.read.schema(_BLOCKS).parquet(f"{path}/blocks"), rows[0].probes)

    def search(self, queries: DataFrame, id_col: str, vector_col: str, probes: int | None = None, exact: bool = False, skip_same: bool = False, names: tuple[str, str] = ("query_id", "row_id")) -> DataFrame:
        """query_id, row_id and similarity of the row with the highest cosine similarity (6 places; then the smallest id).

        Looks into the probes lists (None: as many as were measured) whose centres are closest to a query; exact: then into all others
        that could hold a row as good as the one found. Queries are dealt by list too and meet blocks as
        blocks; no vector goes through the driver. skip_same: a row of the query's own id is no answer.
        A query whose lists have no row for it is left out if not exact.
        """
        centres, probes = self.centres, probes or self.probes
        asked = _rows(queries, id_col, vector_col)

        def first(batches):
            for batch in batches:
                ids, vectors = _units(batch)
                if len(ids):
                    near = vectors @ centres.T
                    n = min(probes, len(centres))
                    lists = np.argpartition(-near, n - 1, axis=1)[:, :n]
                    yield _asked(ids, vectors, np.full(len(ids), -2.0), near, np.repeat(np.arange(len(ids)), n), lists.ravel())

        schema = "list int, near double, id long, v binary, least double"
        found = self._meet(asked.mapInArrow(first, schema), skip_same)
        if exact:
            found = shared_checkpoint(found)
            rings = {r.list: (r.low, r.high) for r in self.blocks.groupBy("list").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row for each list
            there = np.array(sorted(rings), int)
            low, high = (np.array([rings[i][side] for i in there.tolist()]) for side in (0, 1))

            def rest(batches):
                for batch in batches:
                    best = batch.column(2).fill_null(-2.0).to_numpy()
                    keep = dict(zip(batch.column(0).to_pylist(), best.tolist()))
                    ids, vectors = _units(batch.select([0, 1]))
                    if len(ids) and len(there):
                        near = vectors @ centres.T
                        n = min(probes, len(centres))
                        seen = np.zeros(near.shape, bool)
                        np.put_along_axis(seen, np.argpartition(-near, n - 1, axis=1)[:, :n], True, axis=1)
                        least = np.array([keep[i] for i in ids.tolist()])
                        could = (best_possible(near[:, there], low, high) >= least[:, None] - MARGIN) & ~seen[:, there]
                        row, at = np.nonzero(could)
                        if len(row):
                            yield _asked(ids, vectors, least, near, row, there[at])

            best = found.select(F.col("q").alias("id"), "s").groupBy("id").agg(F.max("s").alias("s"))
            again = self._meet(asked.join(best, "id", "left").select("id", "v", "s").mapInArrow(rest, schema), skip_same)
            found = found.union(again)
        top = found.groupBy("q").agg(F.max(F.struct("s", (-F.col("r")).alias("r"))).alias("x"))
        return top.select(F.col("q").alias(names[0]), (-F.col("x.r")).alias(names[1]), F.col("x.s").alias("similarity"))

    def _meet(self, asked: DataFrame, skip_same: bool) -> DataFrame:
        """q, r and s: the best row of each query in each block it meets. Blocks of queries meet those of rows in their list; a ring that cannot be as good as what a query has is not looked into."""

        def best(batches):
            for batch in batches:
                for k in range(batch.num_rows):  # blocks are read where they lie: a batch holds many pairs of them
                    low, high = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    rows, vectors, near, least, q, x = (c[k].as_buffer() for c in batch.columns[2:])
                    near, least, q = np.frombuffer(near), np.frombuffer(least), np.frombuffer(q, np.int64)
                    some = np.flatnonzero(best_possible(near, np.array(low), np.array(high)) >= least - MARGIN)
                    ids = np.frombuffer(rows, np.int64)
                    asked_, others = np.frombuffer(x).reshape(len(q), -1), np.frombuffer(vectors).reshape(len(ids), -1).T
                    for first in range(0, len(some), _TILE):
                        part = some[first : first + _TILE]
                        alike = asked_[part] @ others
                        np.round(alike, 6, out=alike)
                        if skip_same:
                            alike[q[part, None] == ids] = -np.inf
                        at = alike.argmax(axis=1)  # ids of a block ascend
                        top = alike[np.arange(len(part)), at]
                        ok = top > -np.inf
                        yield pa.RecordBatch.from_arrays([pa.array(q[part][ok]), pa.array(ids[at][ok]), pa.array(top[ok])], names=["q", "r", "s"])

        met = self.blocks.join(_pack(asked, QUERY_ROWS).drop("low", "high").withColumnsRenamed({"ids": "q", "vectors": "x"}), "list")
        return met.select("low", "high", "ids", "vectors", "near", "least", "q", "x").mapInArrow(best, "q long, r long, s double")


def _asked(ids, vectors, least, near, row, lists) -> pa.RecordBatch:
    """A query for each pair of row and list: list, closeness, id, vector and the similarity that it has already."""
    texts = [v.tobytes() for v in vectors]
    return pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(near[row, lists]), pa.array(ids[row]), pa.array([texts[i] for i in row.tolist()], pa.binary()), pa.array(least[row])], names=["list", "near", "id", "v", "least"])


def _pack(placed: DataFrame, most: int) -> DataFrame:
    """Rows (list, near, id, v, and least of queries) as blocks of at most most rows of one list that are alike in closeness; ids of a block ascend."""
    with_least = "least" in placed.columns
    schema = _BLOCKS + (", near binary, least binary" if with_least else "")

    def pack(batches):
        held: list[tuple] = []

        def block():
            held.sort(key=lambda r: r[2])
            near = np.array([r[1] for r in held])
            values = [[held[0][0]], [near.min()], [near.max()], [np.array([r[2] for r in held], np.int64).tobytes()], [b"".join(r[3] for r in held)]]
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            if with_least:
                values += [[near.tobytes()], [np.array([r[4] for r in held], np.float64).tobytes()]]
                kinds += [pa.binary(), pa.binary()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) >= most):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return placed.repartitionByRange("list", "near", "id").sortWithinPartitions("list", "near", "id").mapInArrow(pack, schema)
