"""Near copies of texts by the Jaccard similarity of their sets of word shingles, without loss.

Prefix filter: with shingles in one order for all texts, two sets of a similarity of least or more share
one of the first n - ceil(least * n) + 1 shingles of each. The order is by how often a shingle's bucket
occurs, rare ones first, so texts meet on rare shingles; a passage that very many texts have brings them
together only where little else is left. Candidates are verified by their whole sets, if parity bits, which
bound a difference from below, leave them open. In a group of texts
that share a shingle, the first and the last are held against all others; after that only texts not yet
linked are, so a large group of near copies is not written out pair by pair. Of two texts that meet on a
shingle, what they can still share stands behind it in both: a pair with too little left there, or whose
64 bits of parity differ in too many, is passed over before it is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import giving_back, pack, shared_checkpoint, text_bytes, unpack
from siftstone.llm.components import connected_components
from siftstone.llm.decontaminate import seed_hashes

WIDTH, LEAST = 5, 0.8
#: The table of frequencies has a fixed size, however many shingles there are.
_BUCKET_BITS, _CHUNKS = 20, 64
_MEMO, _FLUSH, _ROWS = 1 << 20, 1 << 20, 256
_MEMBER_SCHEMA = "key long, node long, n int, behind int, odd long"
_MEMBER = [c.split()[0] for c in _MEMBER_SCHEMA.split(", ")]


class Shingler:
    """The sorted, different hashes of a text's runs of width words (of all words if there are fewer), in lower case; words' hashes are kept in a bounded memo."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words, known = text.lower().split(), self.known
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > _MEMO:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxh64_intdigest(w, 1)
        return np.unique(seed_hashes(np.array([known[w] for w in words], np.uint64), "1" * min(self.width, len(words))))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least or more; two empty sets have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _levels(docs: DataFrame, width: int) -> bytes:
    """For each bucket of shingles, the bits of the number of its occurrences, packed."""

    def count(batches):
        shingles, total, held, size = Shingler(width), np.zeros(1 << _BUCKET_BITS, np.int64), [], 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                held.append(shingles(text))
                size += len(held[-1])
                if size > _FLUSH:
                    total += np.bincount((np.concatenate(held) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), minlength=len(total))
                    held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([pack(x) for x in np.split(total, _CHUNKS)])], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack(counts, np.int64) for counts in table["counts"].to_pylist())
        bits = np.ceil(np.log2(total + 1)).astype(np.uint8)
        return pa.table({"chunk": table["chunk"][:1], "bits": pa.array([bits.tobytes()])})

    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    rows = counted.groupBy("chunk").applyInArrow(add, "chunk int, bits binary").collect()  # a fixed size: one byte for each bucket
    return pack(b"".join(bytes(r.bits) for r in sorted(rows))) if rows else pack(bytes(1 << _BUCKET_BITS))


def _keys(docs: DataFrame, width: int, least: float) -> DataFrame:
    """key, node (doc_id), n (shingles), behind (those from the key on) and odd (64 bits of parity) for each shingle of the prefix of each text; texts without shingles have one key, zero."""
    packed = _levels(docs, width)

    def explode(batches):
        shingles, levels = Shingler(width), unpack(packed, np.uint8)
        held, nodes, sizes, odds, size = [], [], [], [], 0

        def emit():
            n = np.array([len(x) for x in held])
            all_sizes = np.repeat(np.array(sizes, np.int32), n)
            place = np.arange(len(all_sizes)) - np.repeat(np.cumsum(n) - n, n)
            arrays = [np.concatenate(held).view(np.int64), np.repeat(np.array(nodes, np.int64), n), all_sizes, np.maximum(all_sizes - place, 0).astype(np.int32), np.repeat(np.array(odds, np.uint64).view(np.int64), n)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=_MEMBER)

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                own = shingles(text)
                order = np.argsort(levels[(own >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)], kind="stable")
                held.append(own[order[: prefix_length(len(own), least)]] if len(own) else np.zeros(1, np.uint64))
                nodes.append(node), sizes.append(len(own)), odds.append(np.bitwise_xor.reduce(parity_bits(own)))
                size += len(held[-1])
                if size > _FLUSH:
                    yield emit()
                    held, nodes, sizes, odds, size = [], [], [], [], 0
        if held:
            yield emit()

    return docs.mapInArrow(giving_back(explode), _MEMBER_SCHEMA)


def _groups(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole runs of equal values in the first column; a run may go on over batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (cut or held[0][0][0] != columns[0][0]):
            yield tuple(np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns]))
            held = []
        elif cut:
            yield tuple(c[:cut] for c in columns)
        held.append([c[cut:] for c in columns])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _could_be(one: tuple, others: tuple, least: float) -> np.ndarray:
    """False only for texts (n, behind, odd) that can't be similar to one if the shingle that they meet on is the first they share; a pair that shares an earlier one meets there."""
    (n, behind, odd), (m, other_behind, other_odd) = one, others
    sizes = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
    enough = np.minimum(behind, other_behind) >= least / (1 + least) * (n + m) - 1e-9
    return sizes & enough & (np.bitwise_count(odd ^ other_odd) <= (1 - least) / (1 + least) * (n + m) + 1e-9)


def _stars(grouped: DataFrame, least: float, last: bool) -> DataFrame:
    """The first member of each group (the last one) with each other one of another component."""

    def star(batches):
        for key, node, n, behind, odd, label in _groups(batches):
            odd = odd.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            centre = np.repeat(starts + sizes - 1 if last else starts, sizes)
            open_ = (label != label[centre]) & _could_be((n, behind, odd), (n[centre], behind[centre], odd[centre]), least)
            yield _pairs(node[open_], node[centre[open_]])

    return grouped.mapInArrow(star, "a long, b long").distinct()


def _rest(grouped: DataFrame, least: float) -> DataFrame:
    """Pairs of members of different components in each group that could be similar; its first and last member are not among them."""

    def pairs(batches):
        for key, node, n, behind, odd, label in _groups(batches):
            odd = odd.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for low, size in zip(starts.tolist(), np.diff(np.r_[starts, len(key)]).tolist()):
                high = low + size - 1
                if size < 4 or (label[low:high] == label[low]).all() and label[high] == label[low]:
                    continue
                # a member with less behind it than it needs beside a text of its least size meets nobody here
                able = np.flatnonzero(behind[low + 1 : high] >= least * n[low + 1 : high] - 1e-9) + low + 1
                for k, i in enumerate(able[:-1].tolist()):
                    at = able[k + 1 :]
                    at = at[(label[at] != label[i]) & _could_be((n[i], behind[i], odd[i]), (n[at], behind[at], odd[at]), least)]
                    if len(at):
                        yield _pairs(np.full(len(at), node[i]), node[at])

    return grouped.mapInArrow(pairs, "a long, b long").distinct()


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """64-bit words of one bit for each remainder of the hashes, set if an odd number of shingles has it; as many bits, a power of two, as there are shingles or more.

    Shingles that two sets share cancel out: two sets differ in at least as many shingles as their bits do.
    """
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def may_be_similar(a: np.ndarray, b: np.ndarray, n: int, m: int, least: float) -> bool:
    """False only if sets of n and m shingles with these parity bits can't have a Jaccard similarity of least or more."""
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(folded ^ b).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-9


def _prints(rows: DataFrame, width: int) -> DataFrame:
    """node, n (shingles), whole (a digest of them) and bits (their parity) of each row."""

    def run(batches):
        from xxhash import xxh3_128_digest

        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                sets = [shingles(x) for x in text_bytes(part.column(1))]
                whole, bits = [xxh3_128_digest(x.tobytes()) for x in sets], [parity_bits(x).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int32()), pa.array(whole, pa.binary()), pa.array(bits, pa.binary())], names=["node", "n", "whole", "bits"])

    return rows.mapInArrow(giving_back(run), "node long, n int, whole binary, bits binary")


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs whose sets are similar: those with one and the same set by its digest; of the others, those that parity bits leave, by their whole sets."""

    def look(batches):
        for batch in batches:
            a, b, n, m, whole, other, bits, other_bits = (c.to_pylist() for c in batch.columns)
            same = [x == y for x, y in zip(whole, other)]
            said = [s or may_be_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), k, l, least) for s, x, y, k, l in zip(same, bits, other_bits, n, m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.bool_())], names=["a", "b", "same"]).filter(pa.array(said, pa.bool_()))

    def shingle(batches):
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(x).tobytes() for x in text_bytes(part.column(1))], pa.binary())], names=["node", "shingles"])

    def check(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in zip(a, b)], pa.bool_()))

    sides = pairs.join(prints.toDF("a", "n", "whole", "bits"), "a").join(prints.toDF("b", "m", "other", "other_bits"), "b")
    looked = shared_checkpoint(sides.select("a", "b", "n", "m", "whole", "other", "bits", "other_bits").mapInArrow(look, "a long, b long, same boolean").groupBy("a", "b").agg(F.bool_or("same").alias("same")))
    equal, open_ = looked.filter("same").select("a", "b"), looked.filter("not same").select("a", "b")
    if open_.isEmpty():
        return equal
    nodes = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shared_checkpoint(rows.join(nodes, "node", "left_semi").mapInArrow(shingle, "node long, shingles binary"))
    both = open_.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return equal.union(both.mapInArrow(check, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """node and component (the smallest id that can be reached over pairs of texts with a similarity of least or more) for each id that is in such a pair.

    Null and empty texts are copies of each other. Rows with a null id are left out. Of an id that is
    repeated, each row's text can make a pair. No pair is lost, but for those that an equal hash of 64
    bits hides; an empty table gives an empty table.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity must be over 0, up to 1")
    rows = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).filter("node is not null")

    def several(batches):
        for columns in _groups(batches):
            key = columns[0]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            keep = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], names=_MEMBER)

    in_runs = lambda df: df.repartition("key").sortWithinPartitions("key", "node")
    grouped = shared_checkpoint(in_runs(_keys(rows, width, least)).mapInArrow(several, _MEMBER_SCHEMA))
    prints = shared_checkpoint(_prints(rows, width))
    alone = grouped.withColumn("label", F.col("node"))
    links = shared_checkpoint(_verified(_stars(alone, least, False).union(_stars(alone, least, True)).distinct(), prints, rows, width, least))
    labels = connected_components(links, "a", "b")
    labelled = grouped.join(labels, "node", "left").select(*_MEMBER, F.coalesce("component", "node").alias("label"))
    links = shared_checkpoint(links.union(_verified(_rest(in_runs(labelled), least), prints, rows, width, least)))
    return connected_components(links, "a", "b")
