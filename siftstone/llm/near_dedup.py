"""Near duplicates by SimHash fingerprints: Golay-code fuzzy hashing finds the pairs, a bit count verifies them.

A fingerprint of 64 bits is cut into three segments of 21, 21 and 22 bits. If two fingerprints differ
in at most four bits, the two segments with the fewest errors have at most two errors each (with three
in either, the third would have three too, nine in all; and 3 + 2 is over four). Each segment within
two errors shares a Golay key, so one of the three pairs of segments shares a combined key of 24 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import shared_checkpoint
from siftstone.llm.components import connected_components
from siftstone.llm.golay import INDEX_BITS, nearby_indices
from siftstone.llm.near_copies import LEAST, WIDTH, near_copies
from siftstone.llm.simhash import fingerprints

#: (lowest bit, bits) of each segment; four errors at most can be guaranteed with three of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 4
_ROWS = 1 << 13
#: Groups of one key with more fingerprints than this are split by blocks of bits before they are compared.
_LARGE = 2048


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of prints, key) for all keys of each fingerprint; a key has 24 bits and the number of its pair of segments."""
    indices = [nearby_indices(((prints >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.uint32)) for low, n in SEGMENTS]
    rows, keys = [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, n_a), (b, n_b) = indices[i], indices[j]
        keep = (np.arange(a.shape[1]) < n_a[:, None])[:, :, None] & (np.arange(b.shape[1]) < n_b[:, None])[:, None, :]
        key = (a[:, :, None].astype(np.int64) << INDEX_BITS) | b[:, None, :] | (number << 2 * INDEX_BITS)
        rows.append(np.nonzero(keep)[0])
        keys.append(key[keep])
    return np.concatenate(rows), np.concatenate(keys)


def _spanning_links(prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within max_bits that join the same fingerprints as all such links do, fewer than there are fingerprints.

    A search from each fingerprint looks only at those not reached yet, so in a dense group one look takes nearly all.
    """
    found, left, open_prints = [], prints[1:], [prints[0]]
    while len(left):
        if not open_prints:
            open_prints, left = [left[0]], left[1:]
        at = open_prints.pop()
        near = np.bitwise_count(left ^ at) <= max_bits
        if near.any():
            reached, left = left[near], left[~near]
            found.append((np.full(len(reached), at), reached))
            open_prints.extend(reached)
    return found


def _block_links(prints: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of a large group without holding each fingerprint against each other one.

    Of max_bits + 1 blocks of the 64 bits, two fingerprints that link agree in one at least: every link lies
    within a run of equal values of some block, so the runs' spanning links join what all links do.
    """
    edges, found = np.linspace(0, 64, max_bits + 2).astype(int), []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        block = (prints >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        sizes = np.diff(np.r_[starts, len(block)])
        for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            found += _spanning_links(prints[order[at : at + n]], max_bits)
    return found


def _links_of_groups(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    two = starts[sizes == 2]
    two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits]
    found = [(prints[two], prints[two + 1])]
    for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        found += (_block_links if n > _LARGE else _spanning_links)(prints[at : at + n], max_bits)
    a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a and b (a < b as signed longs): verified links between fingerprints of the column fp that differ in max_bits bits or fewer.

    Two fingerprints are connected by these links just if they are by all such pairs. Each group of
    one key gives fewer links than it has members: a large group of near copies is not written out pair by pair.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys guarantee up to {MAX_BITS} bits")

    def explode(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), _ROWS):
                part = values[at : at + _ROWS]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def verify(batches):
        def links(keys, values):
            a, b = (x.view(np.int64) for x in _links_of_groups(keys, values.view(np.uint64), max_bits))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []  # the key at the end of a batch may go on in the next one
        for batch in batches:
            keys, values = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if held and (cut or held[0][0][0] != keys[0]):
                held.append((keys[:cut], values[:cut]))
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held = []
            elif cut:
                yield links(keys[:cut], values[:cut])
            held.append((keys[cut:], values[cut:]))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    keyed = prints.select("fp").distinct().mapInArrow(explode, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row for each row of docs.

    component_id is the smallest doc_id that can be reached over links between fingerprints that
    differ in max_bits bits or fewer. Null and empty texts have fingerprint zero and are linked like
    others. Copies count once: equal fingerprints are one node, named by its smallest doc_id. Rows
    that repeat a doc_id keep a row each. A null doc_id is kept, names no component and passes no
    link on by itself. An empty table gives an empty table.
    """
    prints = shared_checkpoint(fingerprints(docs, id_col, text_col, width))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    links = fingerprint_links(prints, max_bits)
    edges = links.join(nodes.select(F.col("fp").alias("a"), F.col("node").alias("src")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("node").alias("dst")), "b")
    joined = nodes.join(connected_components(edges), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(joined, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """The rows of docs whose doc_id names its component: one document of each group of texts linked by a Jaccard similarity of least or more of their shingles. Rows that repeat a doc_id stay or go together; rows without one stay."""
    gone = near_copies(docs, width=width, least=least).filter("node <> component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti")


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs whose doc_id names its component of `near_duplicates`: one document of each group of linked fingerprints. Rows that repeat a doc_id stay or go together; rows without one stay."""
    gone = near_duplicates(docs, width=width, max_bits=max_bits).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
