"""A prefix trie of conversations by refinement of classes.

All conversations start in one class. Turn by turn, a class splits into those that go on alike; one that
holds a single conversation is retired, as all that follows in it is a chain without branches, which its
length alone gives. Classes that are left are dealt by a digest of the turns so far, so no text is
shuffled after its digest has been made, and a round looks at the conversations still in a class of two
or more. A round splits by several turns, twice as many as the round before it, up to BLOCK.

A class is named by its smallest conversation, and a conversation that names its class names all later
ones of it. So what a node needs from its subtree folds back by sums over its own members: the bytes
that a conversation shares below the node, and whether it names a leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.llm.columns import shared_checkpoint

#: Turns of a conversation that one round splits by, at most.
BLOCK = 64
#: Bytes of ids in one row of those that are joined for a digest.
ID_BYTES = 1 << 18
_PLACE = (1 << 33) - 1


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, at (from 1, in the order of turn with nulls first, then role, then text), key (digest of role and text) and size (UTF-8 bytes of the text).

    Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out.
    Rows are dealt by ranges, so a conversation can be spread over many tasks; places in it come from
    the sizes of the ranges before (one number for each range goes through the driver).
    """
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    held = shared_checkpoint(dealt.select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("place")))
    part, before, first = F.shiftright("place", 33), 0, []
    sizes = {r[0]: r[1] for r in held.groupBy(part.alias("p")).count().collect()}
    for p in range(max(sizes, default=-1) + 1):
        first.append(before)
        before += sizes.get(p, 0)
    base = F.element_at(F.array(*(F.lit(v).cast("long") for v in first or [0])), (part + 1).cast("int"))
    counted = held.withColumn("number", base + F.col("place").bitwiseAND(F.lit(_PLACE)))
    firsts = counted.groupBy("conv_id").agg(F.min("number").alias("first"))
    return counted.join(firsts, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("at"), "key", "size")


def with_shared_heads(numbered: DataFrame, head: Column, donor: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations whose first turns are taken from another one: the first head turns (at most most) of conversation donor, then their own after the first head ones.

    A donor that is not there gives no turns. A conversation that gives to itself stays as it is.
    lengths: conv_id and total, with a row for conversations that are left without turns too.
    """
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"head": head.cast("long"), "donor": donor})
    donors = own.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    given = F.least("head", F.coalesce("donor_n", F.lit(0)))
    plans = shared_checkpoint(own.join(donors, "donor", "left").select("conv_id", "donor", "head", given.alias("given"), (given + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("total")))
    kept = numbered.join(plans, "conv_id").filter(F.col("at") > F.col("head")).select("conv_id", (F.col("at") - F.col("head") + F.col("given")).alias("at"), "key", "size")
    heads = numbered.filter(F.col("at") <= most).withColumnRenamed("conv_id", "donor")
    taken = plans.filter("given > 0").select("conv_id", "donor", "given").join(heads, "donor").filter(F.col("at") <= F.col("given")).select("conv_id", "at", "key", "size")
    return shared_checkpoint(kept.union(taken)), plans.select("conv_id", "total")


def _refine(turns: DataFrame, lengths: DataFrame, members: int, first: int, block: int) -> DataFrame:
    """conv_id, at, path, size, rep (the smallest member of the class) and n (its members) for each place of a conversation in a class of two or more, the root (at 0) included."""
    empty = F.unhex(F.lit(""))
    shared = [lengths.select("conv_id", F.lit(0).cast("long").alias("at"), empty.alias("path"), F.lit(0).cast("long").alias("size"), F.lit(first).cast("long").alias("rep"), F.lit(members).cast("long").alias("n"))]
    active, left, depth, width = shared[0].select("conv_id", "path"), turns, 0, 1
    while True:
        here = left.filter(F.col("at") <= depth + width).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "size"))).alias("next"))  # at most width entries
        start = F.array(F.struct("path", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("size")))
        step = lambda done, x: F.concat(done, F.array(F.struct(F.unhex(F.sha2(F.concat(F.element_at(done, -1)["path"], x["key"]), 256)).alias("path"), x["at"].alias("at"), x["size"].alias("size"))))
        paths = active.join(here, "conv_id").select("conv_id", F.explode(F.slice(F.aggregate("next", start, step), F.lit(2), F.lit(width))).alias("x")).select("conv_id", "x.*")
        paths = shared_checkpoint(paths)
        classes = paths.groupBy("at", "path").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
        found = shared_checkpoint(paths.join(classes, ["at", "path"]).select("conv_id", "at", "path", "size", "rep", "n"))
        if found.isEmpty():
            break
        shared.append(found)
        depth, width = depth + width, min(2 * width, block)
        active = found.filter(F.col("at") == depth).select("conv_id", "path")
        left = shared_checkpoint(left.filter(F.col("at") > depth).join(active.select("conv_id"), "conv_id", "left_semi"))
    out = shared[0]
    for rows in shared[1:]:
        out = out.union(rows)
    return out


def joined_digests(rows: DataFrame, keys: list[str], value: str, name: str, id_bytes: int = ID_BYTES) -> DataFrame:
    """keys and name: the sha256 of the values of a key in ascending order, joined by commas.

    Values are sorted over ranges of key and value, so a key with very many of them is spread over
    tasks that make texts of about id_bytes; these few rows then pass in order through one digest.
    """

    def cut(batches):
        now, texts, size, order = None, [], 0, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(now, kinds)), pa.array([order], pa.int64()), pa.array([",".join(texts)])], names=[*keys, "first", "ids"])

        kinds = []
        for batch in batches:
            kinds = [c.type for c in batch.columns[:-1]]
            columns = [c.to_pylist() for c in batch.columns]
            for *key, v in zip(*columns):
                if now is not None and (key != now or size >= id_bytes):
                    yield row()
                    now = None
                if now is None:
                    now, texts, size, order = key, [], 0, v
                texts.append(str(v))
                size += len(texts[-1]) + 1
        if now is not None:
            yield row()

    def digest(batches):
        now, sha, kinds = None, None, []
        done: list = []

        def out():
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*(d[0] for d in done)), kinds)), pa.array([d[1] for d in done])], names=[*keys, name])

        for batch in batches:
            kinds = [c.type for c in batch.columns[: len(keys)]]
            for *key, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    sha.update(b"," + text.encode())
                    continue
                if now is not None:
                    done.append((now, sha.hexdigest()))
                    if len(done) >= 4096:
                        yield out()
                        done.clear()
                now, sha = key, hashlib.sha256(text.encode())
        if now is not None:
            done.append((now, sha.hexdigest()))
            yield out()

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    chosen = rows.select(*keys, F.col(value).cast("long"))
    cuts = chosen.repartitionByRange(*chosen.columns).sortWithinPartitions(*chosen.columns).mapInArrow(cut, f"{kinds}, first long, ids string")
    return cuts.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{kinds}, {name} string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations: turns (conv_id, at from 1, key, size) and lengths (conv_id, total).

    A node is a sequence of turns that at least one conversation begins with; the root has none. For each
    one: conv_id (its smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves,
    saved_tokens and ends_sha256 (over the members that end there). Conversations without turns are
    members of the root. No conversations give no rows.
    """
    known = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    nobody = F.sha2(F.lit(""), 256)
    if known.n > 1:
        shared = shared_checkpoint(_refine(turns, lengths, known.n, known.first, block))
    else:
        shared = turns.sparkSession.createDataFrame([], "conv_id long, at long, path binary, size long, rep long, n long")

    # of each conversation: where it stands last in a class of several, and from where on it names its class
    marks = shared.groupBy("conv_id").agg(F.max(F.struct("at", "rep")).alias("last"), F.min(F.when(F.col("rep") == F.col("conv_id"), F.col("at"))).alias("own"))
    marks = lengths.join(marks, "conv_id", "left").select("conv_id", "total", F.coalesce("last.at", F.lit(-1)).alias("last"), F.col("last.rep").alias("last_rep"), "own")
    marks = shared_checkpoint(marks.withColumn("own", F.coalesce("own", F.col("last") + 1)))

    placed = shared.join(marks, "conv_id")
    ends = shared_checkpoint(placed.filter(F.col("at") == F.col("total")).select("at", "path", "conv_id", "rep", "n"))
    leaves = ends.groupBy("at", "path", "n").agg(F.count("*").alias("n_ends"), F.min("rep").alias("conv_id")).filter("n = n_ends").select("conv_id", F.lit(True).alias("leaf"))

    along = Window.partitionBy("conv_id").orderBy(F.col("at").desc())
    below = F.sum(F.when(F.col("rep") == F.col("conv_id"), 0).otherwise(F.col("size"))).over(along)
    placed = placed.withColumns({"below": below, "above": F.lead("rep").over(along)}).join(leaves, "conv_id", "left")
    names_leaf = (F.col("last") < F.col("total")) | F.coalesce("leaf", F.lit(False))
    names_child = (F.col("at") >= F.col("own") - 1) & (F.col("at") < F.col("total"))  # it names the class that follows
    nodes = placed.groupBy("at", "path").agg(
        F.min("rep").alias("conv_id"), F.min("above").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if(names_child).alias("n_children"), F.count_if(names_leaf).alias("n_leaves"), F.sum("below").alias("saved_tokens")
    )
    digests = joined_digests(ends, ["at", "path"], "conv_id", "ends_sha256")
    nodes = nodes.join(digests, ["at", "path"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    branching = nodes.withColumnRenamed("at", "depth").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody)).select(columns)

    chains = marks.filter(F.col("last") < F.col("total")).withColumn("depth", F.explode(F.sequence(F.col("last") + 1, F.col("total"))))
    one, end = F.lit(1).cast("long"), F.col("depth") == F.col("total")
    chains = chains.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("last") + 1, F.col("last_rep")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(end, 0).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    return branching.union(chains)
