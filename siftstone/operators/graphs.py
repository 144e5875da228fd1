"""Graphs as tables of edges: components, leaves taken off again and again, and hashes of surroundings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siftstone.operators import small_graphs as small
from siftstone.plans.lineage import shared_checkpoint


def both_ways(edges: DataFrame, graph: Sequence[str], a: str = "a", b: str = "b", *more: str) -> DataFrame:
    """Each edge once in each direction: the columns of graph, node, other and more."""
    there = edges.select(*graph, F.col(a).alias("node"), F.col(b).alias("other"), *more)
    return there.union(edges.select(*graph, F.col(b).alias("node"), F.col(a).alias("other"), *more))


def component_labels(nodes: DataFrame, edges: DataFrame, graph: Sequence[str] = (), node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """graph, node and label (the smallest node that can be reached) of all graphs at once.

    Edges are turned into stars: larger neighbours are hung on the smallest node beside a node, then the
    smaller ones, until nothing moves. The rounds grow with the logarithm of the size of a component.
    Each is two joins by (graph, node), dealt evenly however large a single graph is, and is written to
    the shared folder. Loops, repeats and edges with an end that is no node change nothing for the others.
    """
    node_, keys = F.col(node), [*graph, "a", "b"]
    now = shared_checkpoint(edges.filter(F.col(a) != F.col(b)).select(*graph, F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        both = both_ways(now, graph)
        least = both.groupBy(*graph, "node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
        hung = both.filter("other > node").join(least, [*graph, "node"]).select(*graph, F.col("other").alias("a"), F.col("m").alias("b")).distinct()
        least = hung.groupBy(*graph, "a").agg(F.min("b").alias("m"))
        moved = hung.join(least, [*graph, "a"]).filter("b > m").select(*graph, F.col("b").alias("a"), F.col("m").alias("b"))
        after = shared_checkpoint(moved.union(least.select(*graph, "a", F.col("m").alias("b"))).distinct())
        if after.count() == now.count() and after.join(now, keys, "left_anti").isEmpty():
            break
        now = after
    known = nodes.select(*graph, node_.alias("node")).distinct()
    return known.join(now.select(*graph, F.col("a").alias("node"), F.col("b").alias("label")), [*graph, "node"], "left").withColumn("label", F.coalesce("label", "node"))


def without_leaves(edges: DataFrame, graph: Sequence[str] = (), a: str = "a", b: str = "b", kept: Sequence[str] = ()) -> DataFrame:
    """The edges (graph, a, b and kept) left when nodes with one edge are taken off again and again: what lies on rings and between them.

    Loops and repeated edges count once, as one edge or none. A round counts edges by node, which is
    combined before it is dealt, and is written to the shared folder; there are as many rounds as the
    longest chain that hangs on a ring has nodes. Trees vanish.
    """
    once = edges.filter(F.col(a) != F.col(b)).select(*graph, F.least(a, b).alias(a), F.greatest(a, b).alias(b), *kept).dropDuplicates([*graph, a, b])
    now = shared_checkpoint(once)
    while True:
        inner = both_ways(now, graph, a, b).groupBy(*graph, "node").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        left = now.join(inner.withColumnRenamed("node", a), [*graph, a], "left_semi").join(inner.withColumnRenamed("node", b), [*graph, b], "left_semi")
        left = shared_checkpoint(left.select(*graph, a, b, *kept))
        if left.count() == now.count():
            return left
        now = left


def cycle_counts(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """graph, n_nodes, n_edges, n_components and n_cycles (independent ones: edges - nodes + components). Loops and repeated edges are not counted.

    Graphs of up to small_graphs.WHOLE rows are counted whole in a task, larger ones by rounds of joins.
    """
    if not small.can_be_small(graph, (nodes, node), (edges, a), (edges, b)):
        return _cycle_counts_by_rounds(nodes, edges, graph, node, a, b)
    counts = ["n_nodes", "n_edges", "n_components"]
    done, rest = small.through_tasks(small.graph_rows(graph, edges, a, b, nodes, node), graph, small.cycles, dict.fromkeys(counts, "long"))
    done = done.select(*graph, *counts, (F.col("n_edges") - F.col("n_nodes") + F.col("n_components")).alias("n_cycles"))
    return done if rest is None else done.union(_cycle_counts_by_rounds(*small.taken_apart(rest, graph), graph, "node", "a", "b"))


def _cycle_counts_by_rounds(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], node: str, a: str, b: str) -> DataFrame:
    labels = component_labels(nodes, edges, graph, node, a, b)
    sizes = labels.groupBy(*graph).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("node") == F.col("label")).alias("n_components"))
    once = edges.filter(F.col(a) != F.col(b)).select(*graph, F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct().groupBy(*graph).agg(F.count("*").alias("n_edges"))
    n_edges = F.coalesce("n_edges", F.lit(0))
    return sizes.join(once, list(graph), "left").select(*graph, "n_nodes", n_edges.alias("n_edges"), "n_components", (n_edges - F.col("n_nodes") + F.col("n_components")).alias("n_cycles"))


def _bag(value: Column) -> list[Column]:
    """Sums that describe a bag of 64-bit numbers whatever its order; they are combined before they are dealt, so a node with very many neighbours is no hot task."""
    return [F.count(value).alias("__n"), F.sum(value.bitwiseAND(F.lit((1 << 31) - 1))).alias("__low"), F.sum(F.shiftrightunsigned(value, 33)).alias("__high"), F.bit_xor(value).alias("__xor")]


def surroundings(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], start: Column, radius: int, node: str = "node", a: str = "a", b: str = "b", kind: str | None = None) -> DataFrame:
    """graph, node, radius and hash: of each node its start value, then 1 to radius times a hash of its own hash and those of its neighbours with the kinds of the edges.

    start is an expression over nodes. Nodes whose surroundings are the same have the same hash (64 bits;
    the neighbours enter as a bag). Repeated nodes and edges count once. Graphs of up to small_graphs.WHOLE rows
    are hashed whole in a task, larger ones by a join for each radius.
    """
    begun, linked, of_type = _hashed(nodes, edges, graph, start, node, a, b, kind)
    if not small.can_be_small(graph, (nodes, node), (edges, a), (edges, b)):
        return surroundings_by_rounds(begun, linked, graph, radius)
    done, rest = small.through_tasks(small.graph_rows(graph, linked, "a", "b", begun, "node", ["value"]), graph, small.surroundings(radius), {"hashes": "array<long>"})
    own = F.when(F.col("is") == small.NODE, F.col("a")).cast(of_type).alias("node")
    done = done.select(*graph, own, F.posexplode("hashes").alias("radius", "hash")).select(*graph, "node", "hash", "radius")
    if rest is None:
        return done
    return done.union(surroundings_by_rounds(*small.taken_apart(rest, graph, "value"), graph, radius).withColumn("node", F.col("node").cast(of_type)))


def surrounding_kinds(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], start: Column, radius: int, node: str = "node", a: str = "a", b: str = "b", kind: str | None = None) -> DataFrame:
    """graph, radius and kinds: how many different hashes the surroundings of a graph's nodes have at 0 to radius."""
    begun, linked, _ = _hashed(nodes, edges, graph, start, node, a, b, kind)
    by_rounds = lambda n, e: surroundings_by_rounds(n, e, graph, radius).groupBy(*graph, "radius").agg(F.count_distinct("hash").alias("kinds"))
    if not small.can_be_small(graph, (nodes, node), (edges, a), (edges, b)):
        return by_rounds(begun, linked)
    done, rest = small.through_tasks(small.graph_rows(graph, linked, "a", "b", begun, "node", ["value"]), graph, small.surrounding_kinds(radius), {"found": "array<long>"})
    done = done.select(*graph, F.posexplode("found").alias("radius", "kinds"))
    return done if rest is None else done.union(by_rounds(*small.taken_apart(rest, graph, "value")))


def _hashed(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], start: Column, node: str, a: str, b: str, kind: str | None) -> tuple[DataFrame, DataFrame, DataType]:
    """Nodes (graph, node, value) with the hash of their start, edges (graph, a, b, value) with that of their kind, and the type of node."""
    edge_kind = F.col(kind) if kind else F.lit(0)
    begun = nodes.select(*graph, F.col(node).alias("node"), F.xxhash64(start).alias("value"))
    return begun, edges.select(*graph, F.col(a).alias("a"), F.col(b).alias("b"), F.xxhash64(edge_kind).alias("value")), begun.schema["node"].dataType


def surroundings_by_rounds(nodes: DataFrame, edges: DataFrame, graph: Sequence[str], radius: int) -> DataFrame:
    """graph, node, hash and radius from what _hashed gives."""
    keys = [*graph, "node"]
    once = edges.filter("a <> b").select(*graph, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("value").alias("__kind")).distinct()
    links = shared_checkpoint(both_ways(once, graph, "a", "b", "__kind"))
    now = shared_checkpoint(nodes.select(*keys, F.col("value").alias("hash")).dropDuplicates(keys))
    out = now.withColumn("radius", F.lit(0))
    for r in range(1, radius + 1):
        beside = links.join(now.select(*graph, F.col("node").alias("other"), F.col("hash").alias("__h")), [*graph, "other"])
        bags = beside.groupBy(*keys).agg(*_bag(F.xxhash64("__kind", "__h")))
        now = shared_checkpoint(now.join(bags, keys, "left").select(*keys, F.xxhash64(F.lit(r).cast("long"), "hash", "__n", "__low", "__high", "__xor").alias("hash")))
        out = out.union(now.withColumn("radius", F.lit(r)))
    return out


def folded_bits(hashes: DataFrame, graph: Sequence[str], value: str = "hash", bits: int = 2048) -> DataFrame:
    """graph and bits: the hashes of a graph folded to an array of 64-bit words, one aggregate that is combined before it is dealt."""
    at = F.pmod(F.col(value), F.lit(bits))
    word, mask = F.floor(at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    rows = hashes.select(*graph, word.alias("__word"), mask.alias("__mask"))
    words = [F.coalesce(F.bit_or(F.when(F.col("__word") == w, F.col("__mask"))), F.lit(0)).cast("long") for w in range(-(-bits // 64))]
    return rows.groupBy(*graph).agg(F.array(*words).alias("bits"))
