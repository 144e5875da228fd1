"""Small graphs, many in one task: rows are dealt and sorted by graph, and each batch of whole graphs is worked on in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siftstone.plans.lineage import shared_checkpoint

#: Rows (nodes and edges) up to which a task holds a graph; larger ones go through rounds of joins.
WHOLE = 4096
#: What a row is.
EDGE, NODE, NULL_NODE = 0, 1, 2
ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
Work = Callable[[np.ndarray, pa.Table], tuple[np.ndarray, list[pa.Array]]]


def can_be_small(graph: Sequence[str], *columns: tuple[DataFrame, str]) -> bool:
    """Whether tables have columns of graph and whole numbers in the columns named; what has not goes through rounds of joins."""
    return bool(graph) and all(isinstance(df.schema[c].dataType, IntegralType) for df, c in columns)


def graph_rows(graph: Sequence[str], edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None, node: str = "node", more: Sequence[str] = ()) -> DataFrame:
    """graph, a (the smaller end), b, is and more, columns that edges and nodes both have. Loops and edges without a graph or an end are left out; a node is a row with itself at both ends."""
    usable = F.col(a) != F.col(b)
    for g in graph:
        usable &= F.col(g).isNotNull()
    ends = [F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"), F.lit(EDGE).alias("is")]
    rows = edges.filter(usable).select(*graph, *ends, *more)
    if nodes is None:
        return rows
    own = F.coalesce(F.col(node).cast("long"), F.lit(0))
    return rows.union(nodes.select(*graph, own.alias("a"), own.alias("b"), F.when(F.col(node).isNull(), NULL_NODE).otherwise(NODE).alias("is"), *more))


def taken_apart(rows: DataFrame, graph: Sequence[str], *more: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, node, more) and edges (graph, a, b, more) of rows of graphs."""
    nodes = rows.filter(F.col("is") != EDGE).select(*graph, F.when(F.col("is") == NODE, F.col("a")).alias("node"), *more)
    return nodes, rows.filter(F.col("is") == EDGE).select(*graph, "a", "b", *more)


def through_tasks(rows: DataFrame, graph: Sequence[str], work: Work, fields: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What work makes of the graphs of up to WHOLE rows, and the rows of larger ones as they came (None: there are none).

    A task holds one Arrow batch and at most WHOLE rows before it. work(g, table) gets whole graphs, numbered from 0, and
    returns the numbers of the rows that it keeps and for each of these the fields (long or array<long>).

    Rows are counted by a window (it spills those of a large graph), as Spark keeps the rows of a window in one task. A repartition
    by graph is no such promise: it is left out over a union of tables that lie by graph already, and each of these is then coalesced on its own.
    """
    fields, whole = fields or {}, WHOLE
    names = [*rows.columns, *fields, "large"]
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{k}` {v}" for k, v in fields.items()] + ["large boolean"]

    def give(table: pa.Table, made: list[pa.Array] | None) -> Iterator[pa.RecordBatch]:
        n = table.num_rows
        more = [pa.nulls(n, ARROW[t]) for t in fields.values()] if made is None else made
        yield from pa.table([*table.columns, *more, pa.array(np.full(n, made is None))], names=names).combine_chunks().to_batches()

    def finish(table: pa.Table, g: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, made = work(g, table)
        yield from give(table.take(pa.array(at)), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last graph so far
        for batch in batches:
            table = pa.Table.from_batches([batch])
            large = pc.greater(table.column("__size"), whole)
            table = table.drop_columns(["__size"])
            yield from give(table.filter(large), None)
            table = table.filter(pc.invert(large))
            if not table.num_rows:
                continue
            table = pa.concat_tables([kept, table]) if kept is not None else table
            g = _numbers(table.select(list(graph)))
            last = int(np.searchsorted(g, g[-1]))
            if last:
                yield from finish(table.slice(0, last), g[:last])
            kept = table.slice(last)
        if kept is not None:
            yield from finish(kept, _numbers(kept.select(list(graph))))

    sized = rows.withColumn("__size", F.count("*").over(Window.partitionBy(*graph))).sortWithinPartitions(*graph)
    done = shared_checkpoint(sized.mapInArrow(run, ", ".join(columns)))
    rest = done.filter("large").select(*rows.columns)
    return done.filter("NOT large").select(*rows.columns, *fields), None if rest.isEmpty() else rest


def _numbers(keys: pa.Table) -> np.ndarray:
    """Numbers of the graphs of sorted rows, from 0."""
    new = np.zeros(keys.num_rows, dtype=np.int64)
    for c in keys.columns:
        ids = pa.concat_arrays(c.chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= ids[1:] != ids[:-1]
    return np.cumsum(new)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _places(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a and of b among all nodes of all graphs, in the order of graph and node; and the graph of each place."""
    values = np.concatenate([a, b])
    low, high = int(values.min()), int(values.max())
    span = high - low + 1
    if span * (int(g[-1]) + 1) < 2**62:
        ranks = values - low
    else:
        distinct, ranks = np.unique(values, return_inverse=True)
        span = len(distinct)
    keys, places = np.unique(np.concatenate([g, g]) * span + ranks, return_inverse=True)
    return places[: len(a)], places[len(a) :], keys // span


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest place that can be reached from each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        moved = label.copy()
        np.minimum.at(moved, label[x], low)
        np.minimum.at(moved, label[y], low)
        while not np.array_equal(jumped := moved[moved], moved):
            moved = jumped
        if np.array_equal(moved, label):
            return label
        label = moved


def cycles(g: np.ndarray, table: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
    """Work: nodes, edges and components of each graph with a node."""
    kind, n = _column(table, "is"), int(g[-1]) + 1
    x, y, owner = _places(g, _column(table, "a"), _column(table, "b"))
    known = np.zeros(len(owner), dtype=bool)
    known[x[kind == NODE]] = True
    edges = np.unique(x[kind == EDGE] * len(owner) + y[kind == EDGE])
    ex, ey = edges // len(owner), edges % len(owner)
    label = _least(len(owner), ex, ey)
    count = lambda of: np.bincount(of, minlength=n)
    nodes = count(owner[known]) + np.minimum(count(g[kind == NULL_NODE]), 1)
    found = np.flatnonzero(nodes)
    parts = count(owner[known & (label == np.arange(len(owner)))])
    return np.searchsorted(g, found), [pa.array(c[found].astype(np.int64)) for c in (nodes, count(owner[ex]), parts)]


def _core(x: np.ndarray, y: np.ndarray, n: int, double: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges x, y (each once) lie on rings or between them or are double and hold on to these; and which of n places these have."""
    at = np.arange(len(x))
    while len(at):
        ends = np.bincount(np.concatenate([x[at], y[at]]), minlength=n)
        left = at[(ends[x[at]] > 1) & (ends[y[at]] > 1)]
        if len(left) == len(at):
            break
        at = left
    inside = np.zeros(n, dtype=bool)
    inside[x[at]] = inside[y[at]] = True
    kept = np.zeros(len(x), dtype=bool)
    kept[at] = True
    if double is not None:
        kept |= double & (inside[x] | inside[y])
        inside[x[kept]] = inside[y[kept]] = True
    return kept, inside


def _once(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """The first of each run of rows in order that are equal in columns."""
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order[new]


def scaffolds(double: int | None) -> Work:
    """Work: keeps the edges of rings and linkers, and those of kind double that hold on to them (None: not)."""

    def work(g: np.ndarray, table: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
        x, y, owner = _places(g, _column(table, "a"), _column(table, "b"))
        kind = _column(table, "value")
        once = _once(np.lexsort((kind, y, x)), x, y)
        kept, _ = _core(x[once], y[once], len(owner), None if double is None else kind[once] == double)
        return once[kept], []

    return work


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hash_longs(seed: np.ndarray | int, *values: np.ndarray | int) -> np.ndarray:
    """XXH64 of longs one after another, each with the hash before it as its seed, as in F.xxhash64 (whose first seed is 42)."""
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.atleast_1d(np.asarray(seed, dtype=np.int64)).view(np.uint64)
    for value in values:
        v = np.atleast_1d(np.asarray(value, dtype=np.int64)).view(np.uint64)
        h = turn((h + _P5 + np.uint64(8)) ^ (turn(v * _P2, 31) * _P1), 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _bags(values: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """Count, sums of the low and high 31 bits and xor of values by of (sorted, 0 to n - 1)."""
    count = np.bincount(of, minlength=n).astype(np.int64)
    some = np.flatnonzero(count)
    start = np.searchsorted(of, some)
    out = [count]
    for f, v in ((np.add, values & 0x7FFFFFFF), (np.add, (values.view(np.uint64) >> np.uint64(33)).view(np.int64)), (np.bitwise_xor, values)):
        sums = np.zeros(n, dtype=np.int64)
        if len(some):
            sums[some] = f.reduceat(v, start)
        out.append(sums)
    return out


def _hashes(first: np.ndarray, known: np.ndarray, x: np.ndarray, y: np.ndarray, kind: np.ndarray, radius: int) -> list[np.ndarray]:
    """Hashes by radius of all places; first and known say how places begin and which of them are nodes, kind is the hash of an edge's kind."""
    both = known[x] & known[y]
    x, y, kind = x[both], y[both], kind[both]
    node, other, kind = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([kind, kind])
    order = np.argsort(node, kind="stable")
    node, other, kind = node[order], other[order], kind[order]
    out = [first]
    for r in range(1, radius + 1):
        bags = _bags(hash_longs(42, kind, out[-1][other]), node, len(first))
        alone = hash_longs(42, r, out[-1])
        out.append(np.where(bags[0] > 0, hash_longs(alone, *bags), alone))
    return out


def _coloured(g: np.ndarray, table: pa.Table, radius: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The first row of each node, its graph, and its hashes by radius. value: of a node the hash of its start, of an edge that of its kind."""
    kind, h = _column(table, "is"), _column(table, "value")
    x, y, owner = _places(g, _column(table, "a"), _column(table, "b"))
    nodes, edges = np.flatnonzero(kind == NODE), np.flatnonzero(kind == EDGE)
    edges = edges[_once(np.lexsort((h[edges], y[edges], x[edges])), x[edges], y[edges], h[edges])]
    row = np.full(len(owner), -1)
    row[x[nodes][::-1]] = nodes[::-1]
    lone = np.flatnonzero(kind == NULL_NODE)
    lone = lone[np.unique(g[lone], return_index=True)[1]]
    row, owner = np.concatenate([row, lone]), np.concatenate([owner, g[lone]])
    known = row >= 0
    hashes = _hashes(np.where(known, h[row], 0), known, x[edges], y[edges], h[edges], radius)
    return row[known], owner[known], [v[known] for v in hashes]


def surroundings(radius: int) -> Work:
    """Work: hashes (array<long>, by radius) of each node."""

    def work(g: np.ndarray, table: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
        rows, _, hashes = _coloured(g, table, radius)
        return rows, [_lists(hashes)]

    return work


def surrounding_kinds(radius: int) -> Work:
    """Work: numbers of different hashes (array<long>, by radius) of each graph with a node."""

    def work(g: np.ndarray, table: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
        _, owner, hashes = _coloured(g, table, radius)
        found = np.unique(owner)
        kinds = [np.bincount(owner[_once(np.lexsort((h, owner)), owner, h)], minlength=int(g[-1]) + 1)[found] for h in hashes]
        return np.searchsorted(g, found), [_lists(kinds)]

    return work


def _lists(columns: list[np.ndarray]) -> pa.Array:
    n, k = len(columns[0]), len(columns)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(np.stack(columns, axis=1).astype(np.int64).ravel()))


def scaffold_bags(radius: int, double: int) -> Work:
    """Work: of each graph with a node the bag (n, low, high, x) of the surroundings of its scaffold's nodes in the scaffold. value: of a node the hash of its start, of an edge its kind."""

    def work(g: np.ndarray, table: pa.Table) -> tuple[np.ndarray, list[pa.Array]]:
        what, value = _column(table, "is"), _column(table, "value")
        x, y, owner = _places(g, _column(table, "a"), _column(table, "b"))
        edges = np.flatnonzero(what == EDGE)
        edges = edges[_once(np.lexsort((value[edges], y[edges], x[edges])), x[edges], y[edges])]
        kept, inside = _core(x[edges], y[edges], len(owner), value[edges] == double)
        edges, nodes = edges[kept], np.flatnonzero(what == NODE)[::-1]
        first, known = np.zeros(len(owner), dtype=np.int64), np.zeros(len(owner), dtype=bool)
        first[x[nodes]], known[x[nodes]] = value[nodes], True
        known &= inside
        last = _hashes(first, known, x[edges], y[edges], hash_longs(42, value[edges]), radius)[-1]
        bags = _bags(last[known], owner[known], int(g[-1]) + 1)
        found = np.unique(g[what != EDGE])
        return np.searchsorted(g, found), [pa.array(c[found]) for c in bags]

    return work
