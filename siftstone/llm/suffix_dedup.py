"""Removal of repeated passages: every byte that a string of 50 bytes covers which also starts in a document with a smaller id.

Where a repeat can be is found first, without loss. Texts are cut into anchors (anchors.py); an anchor
whose K bytes stand in one document only has no repeat. Anchors are dealt by ranges of their hash, once
for each chunk of documents and each different surrounding: copies within a chunk are one, so a passage
that a third of all documents share is a row for each chunk. An anchor whose whole surrounding also
stands in a document with a smaller id is repeated as a whole. What is left are the edges of repeats:
surroundings that agree in part. They are dealt by the 33 bytes or more that all windows of one side of
the anchor have in common, and in each group Burrows-Wheeler transforms of shards are merged (bwt.py),
whose intervals of 50 common bytes are the repeated windows. An anchor with very many different
surroundings is dealt window by window instead, so that no group grows with the corpus.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.llm.anchors import K, WIDTH, find_anchors, hash_rows
from siftstone.llm.anchors import _mix as mix
from siftstone.llm.bwt import repeated_windows
from siftstone.llm.columns import MIB, bucket_count, chunk_documents, id_column, pack, text_volume, unpack

#: Windows whose anchor starts this far in or less have at least WIDTH - RIGHT bytes from the anchor on.
RIGHT = (WIDTH - K) // 2
#: An anchor with more different surroundings is dealt window by window.
HOT = 20_000
#: Shards of a merge, and bytes of strings in one.
SHARDS, BATCH_BYTES = 8, MIB // 2
#: Bytes of text in a chunk, and those whose anchors and edges make a bucket of about the same size.
CHUNK_BYTES, BUCKET_BYTES, EDGE_BUCKET_BYTES = 4 * MIB, 6 * MIB, 3 * MIB
_SLICE = 1 << 14
_EDGE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("anchor", "<u4"), ("base", "u1"), ("size", "u1")])
_PART = np.dtype([("anchor", "<u4"), ("base", "u1"), ("mask", "<u8")])


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their bytes sorted by place, which packs better."""
    return pack(x.view(np.uint8).reshape(-1, 8).T)


def _from_planes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(unpack(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


class ChunkAnchors:
    """Anchors of a chunk, and their classes: anchors with the same K bytes in the same surrounding, in order of the hash."""

    def __init__(self, row: dict):
        self.ids, self.lens, self.raw = unpack(row["ids"], np.int64), unpack(row["lens"], np.int64), unpack(row["texts"])
        self.doc, self.at, self.lo, self.hi, key, whole = find_anchors(self.raw, self.lens)
        key, whole = mix(key) >> np.uint64(16), whole >> np.uint64(16)  # anchors have the least hashes: mixed anew, they are spread evenly
        order = np.lexsort((whole, key))
        key, whole = key[order], whole[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])] if len(key) else np.empty(0, bool)
        first = np.flatnonzero(new)
        self.cls = np.empty(len(key), np.int64)
        self.cls[order] = np.cumsum(new) - 1
        owner = self.ids[self.doc[order]]
        self.key, self.whole = key[first], whole[first]
        self.least = np.minimum.reduceat(owner, first) if len(first) else owner
        self.most = np.maximum.reduceat(owner, first) if len(first) else owner


def _table(columns: dict, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_BLOB = pa.schema([("bucket", pa.int32()), ("chunk_id", pa.int64()), ("kind", pa.int32()), ("data", pa.list_(pa.binary()))])
_BLOB_SQL = "bucket int, chunk_id long, kind int, data array<binary>"
_DECIDED, _EDGES, _PARTS = 0, 1, 2


def _blobs(rows: list[tuple]) -> pa.Table:
    return _table(dict(zip(_BLOB.names, zip(*rows))) if rows else {n: [] for n in _BLOB.names}, _BLOB)


def _runs(bucket: np.ndarray):
    """(bucket, slice) of each run of equal buckets."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(bucket)].tolist()):
        yield int(bucket[a]), slice(a, b)


def _bucket(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Buckets by ranges of the key, of which the lowest bits beyond 32 don't count."""
    return (key >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)


def _classes(table: pa.Table, buckets: int) -> pa.Table:
    """The classes of a chunk, a row for each bucket that has some."""
    rows = []
    for row in table.to_pylist():
        c = ChunkAnchors(row)
        for b, s in _runs(_bucket(c.key, 48, buckets)):
            data = [_planes(np.diff(c.key[s], prepend=np.uint64(0))), _planes(c.whole[s]), _planes(c.least[s]), _planes(c.most[s] - c.least[s])]
            rows.append((b, row["chunk_id"], _DECIDED, data))
    return _blobs(rows)


def _decide(table: pa.Table) -> pa.Table:
    """For each class of each chunk: the smallest document that has it, and what to do: 0 nothing more, 1 compare surroundings, 2 compare windows."""
    rows = table.to_pylist()
    parts = [[np.cumsum(_from_planes(r["data"][0], np.uint64)), _from_planes(r["data"][1], np.uint64), _from_planes(r["data"][2], np.int64), _from_planes(r["data"][3], np.int64)] for r in rows]
    key, whole, least, spread = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((whole, key))
    k, w, low = key[order], whole[order], least[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_class = new_key | np.r_[True, w[1:] != w[:-1]]
    first_class, first_key = np.flatnonzero(new_class), np.flatnonzero(new_key)
    of_class, key_of_class = np.cumsum(new_class) - 1, (np.cumsum(new_key) - 1)[first_class]
    class_least = np.minimum.reduceat(low, first_class)
    classes = np.bincount(key_of_class, minlength=len(first_key))
    key_start = np.flatnonzero(np.r_[True, key_of_class[1:] != key_of_class[:-1]])
    edge = (np.maximum.reduceat(class_least, key_start) > np.minimum.reduceat(class_least, key_start)) & (classes > 1)
    todo = np.where(edge, np.where(classes > HOT, 2, 1), 0)[key_of_class]
    smallest, what = np.empty(len(key), np.int64), np.empty(len(key), np.uint8)
    smallest[order], what[order] = class_least[of_class], todo[of_class]
    out, at = [], 0
    for row, part in zip(rows, parts):
        s = slice(at, at := at + len(part[0]))
        out.append((row["bucket"], row["chunk_id"], _DECIDED, [_planes(least[s] - smallest[s]), pack(what[s])]))
    return _blobs(out)


def _decisions(chunk: ChunkAnchors, rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r for r in rows if r["kind"] == _DECIDED), key=lambda r: r["bucket"])
    less = np.concatenate([_from_planes(r["data"][0], np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    what = np.concatenate([unpack(r["data"][1], np.uint8) for r in rows]) if rows else np.empty(0, np.uint8)
    return chunk.least - less, what


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one run after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _hashes(text: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of the size bytes at each place; equal hashes of different bytes only bring edges together that share nothing."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), _SLICE):
        out[i : i + _SLICE] = hash_rows(text[at[i : i + _SLICE, None] + np.arange(size)], salt)
    return out


def _edge_table(c: ChunkAnchors, text: np.ndarray, picked: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the picked anchors, and where each one's text begins."""
    at, lo, hi = c.at[picked], c.lo[picked], c.hi[picked]
    cut = np.maximum(lo, at - RIGHT)
    end = np.minimum(hi, cut - 1)
    right = np.flatnonzero((todo == 1) & (cut <= hi))  # these windows have the bytes up to WIDTH - RIGHT from the anchor
    left = np.flatnonzero((todo == 1) & (lo <= end))  # these have more than RIGHT bytes before it
    hot = np.flatnonzero(todo == 2)
    window, hot = _spread(lo[hot], hi[hot] - lo[hot] + 1), np.repeat(hot, hi[hot] - lo[hot] + 1)
    of, begin = np.concatenate((right, left, hot)), np.concatenate((cut[right], lo[left], window))
    edges = np.empty(len(of), _EDGE)
    edges["key"] = np.concatenate((_hashes(text, at[right], WIDTH - RIGHT, 1), _hashes(text, at[left] - RIGHT - 1, RIGHT + 1 + K, 2), _hashes(text, window, WIDTH, 3)))
    edges["doc"], edges["anchor"], edges["base"] = c.ids[c.doc[picked[of]]], picked[of], begin - lo[of]
    edges["size"] = np.concatenate((hi[right], end[left], window)) + WIDTH - begin
    return edges, begin


def _edges(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """Surroundings to compare, dealt by what their windows have in common; a bit for each anchor that is repeated as a whole goes along to the end."""
    rows, decided = [], right.to_pylist()
    for row in left.to_pylist():
        c = ChunkAnchors(row)
        smallest, what = _decisions(c, decided)
        owner, least = c.ids[c.doc], smallest[c.cls]
        todo = np.where(owner == least, what[c.cls], 0)
        rows.append((row["chunk_id"] * 2654435761 % 4294967291 % buckets, row["chunk_id"], _DECIDED, [pack(np.packbits(owner > least))]))
        text, picked = np.frombuffer(c.raw, np.uint8), np.flatnonzero(todo)
        edges, begin = _edge_table(c, text, picked, todo[picked])
        order = np.argsort(edges["key"], kind="stable")
        edges, begin = edges[order], begin[order]
        for b, s in _runs(_bucket(edges["key"], 64, buckets)):
            rows.append((b, row["chunk_id"], _EDGES, [pack(edges[s]), pack(text[_spread(begin[s], edges["size"][s].astype(np.int64))])]))
    return _blobs(rows)


def _compare(table: pa.Table) -> pa.Table:
    """Which windows of each edge are repeats, from merged transforms of the edges of one bucket."""
    rows = table.to_pylist()
    out = [(r["bucket"], r["chunk_id"], _DECIDED, r["data"]) for r in rows if r["kind"] == _DECIDED]
    rows = [r for r in rows if r["kind"] == _EDGES]
    if not rows:
        return _blobs(out)
    tables = [unpack(r["data"][0], _EDGE) for r in rows]
    edges, chunk = np.concatenate(tables), np.repeat(np.arange(len(rows)), [len(t) for t in tables])
    texts = []
    for r, t in zip(rows, tables):
        raw, ends = unpack(r["data"][1]), np.cumsum(t["size"], dtype=np.int64)
        texts += [raw[e - n : e] for e, n in zip(ends.tolist(), t["size"].tolist())]
    order = np.argsort(edges["key"], kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(edges["key"][order]) != 0])
    several = np.maximum.reduceat(edges["doc"][order], starts) > np.minimum.reduceat(edges["doc"][order], starts)
    masks = np.zeros(len(edges), np.uint64)
    batch, size = [], 0
    stops = np.r_[starts[1:], len(order)]
    for a, b in zip(starts[several].tolist(), stops[several].tolist()):
        batch.append(order[a:b])
        size += int(edges["size"][order[a:b]].sum())
        if size >= BATCH_BYTES:
            _mark(np.concatenate(batch), edges, chunk, texts, masks)
            batch, size = [], 0
    if batch:
        _mark(np.concatenate(batch), edges, chunk, texts, masks)
    for i, r in enumerate(rows):
        hit = np.flatnonzero((chunk == i) & (masks > 0))
        if len(hit):
            part = np.empty(len(hit), _PART)
            part["anchor"], part["base"], part["mask"] = edges["anchor"][hit], edges["base"][hit], masks[hit]
            out.append((0, r["chunk_id"], _PARTS, [pack(part)]))
    return _blobs(out)


def _mark(batch: np.ndarray, edges: np.ndarray, chunk: np.ndarray, texts: list[bytes], masks: np.ndarray) -> None:
    """Sets the masks of a batch of edges that has all edges of its keys. Equal texts are one string, of the smallest document."""
    owner: dict[bytes, int] = {}
    shard: dict[bytes, int] = {}
    docs = edges["doc"][batch].tolist()
    for i, doc, c in zip(batch.tolist(), docs, chunk[batch].tolist()):
        text = texts[i]
        if doc < owner.get(text, doc + 1):
            owner[text] = doc
            shard[text] = c % SHARDS
    shards: list[list[bytes]] = [[] for _ in range(SHARDS)]
    for text, s in shard.items():
        shards[s].append(text)
    strings = [x for s in shards for x in s]
    found = repeated_windows(shards, np.array([owner[x] for x in strings], np.int64), WIDTH)
    bits, at = {}, 0
    for text in strings:
        n = len(text) - WIDTH + 1
        bits[text] = int.from_bytes(np.packbits(found[at : at + n], bitorder="little").tobytes(), "little")
        at += len(text)
    for i, doc in zip(batch.tolist(), docs):
        text = texts[i]
        masks[i] = (1 << (len(text) - WIDTH + 1)) - 1 if doc > owner[text] else bits[text]


@dataclass
class _Finished:
    chunk: ChunkAnchors
    covered: np.ndarray

    def kept(self) -> list[bytes]:
        left = np.frombuffer(self.chunk.raw, np.uint8)[~self.covered].tobytes()
        ends = np.cumsum(self.chunk.lens - self.removed())
        return [left[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())] if len(ends) else []

    def of_whole_characters(self) -> _Finished:
        """The same with all bytes of a character covered if one is: what is left is whole characters."""
        text = np.frombuffer(self.chunk.raw, np.uint8)
        first = np.flatnonzero(text & 0xC0 != 0x80)
        if not len(first):
            return self
        return _Finished(self.chunk, np.repeat(np.logical_or.reduceat(self.covered, first), np.diff(np.r_[first, len(text)])))

    def _by_doc(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        ends = np.cumsum(self.chunk.lens)
        return sums[ends] - sums[ends - self.chunk.lens]

    def removed(self) -> np.ndarray:
        return self._by_doc(self.covered)

    def spans(self) -> np.ndarray:
        begins = self.covered.copy()
        begins[1:] &= ~self.covered[:-1]
        ends = np.cumsum(self.chunk.lens)
        firsts = (ends - self.chunk.lens)[self.chunk.lens > 0]
        begins[firsts] = self.covered[firsts]
        return self._by_doc(begins)


def _finish(row: dict, said: list[dict]) -> _Finished:
    c = ChunkAnchors(row)
    change = np.zeros(len(c.raw) + 1, np.int32)
    for r in said:
        if r["kind"] == _DECIDED:
            whole = np.flatnonzero(np.unpackbits(unpack(r["data"][0], np.uint8), count=len(c.doc)))
            np.add.at(change, c.lo[whole], 1)
            np.add.at(change, c.hi[whole] + WIDTH, -1)
        if r["kind"] == _PARTS:
            part = unpack(r["data"][0], _PART)
            first = c.lo[part["anchor"]] + part["base"]
            for bit in range(WIDTH - K + 1):
                at = first[(part["mask"] >> np.uint64(bit)) & np.uint64(1) > 0] + bit
                np.add.at(change, at, 1)
                np.add.at(change, at + WIDTH, -1)
    return _Finished(c, np.cumsum(change[:-1], dtype=np.int32) > 0)


def _repeats(docs: DataFrame, finish, schema, id_col: str, text_col: str, carry: bool) -> DataFrame:
    volume = text_volume(docs, text_col)
    buckets, edge_buckets = bucket_count(volume, BUCKET_BYTES), bucket_count(volume, EDGE_BUCKET_BYTES)
    chunks = chunk_documents(docs, id_col, text_col, CHUNK_BYTES, carry=carry)
    by_chunk = chunks.groupBy("chunk_id")
    classes = by_chunk.applyInArrow(lambda t: _classes(t, buckets), _BLOB_SQL)
    decided = classes.groupBy("bucket").applyInArrow(_decide, _BLOB_SQL)
    edges = by_chunk.cogroup(decided.groupBy("chunk_id")).applyInArrow(lambda a, b: _edges(a, b, edge_buckets), _BLOB_SQL)
    compared = edges.groupBy("bucket").applyInArrow(_compare, _BLOB_SQL)
    return by_chunk.cogroup(compared.groupBy("chunk_id")).applyInArrow(finish, schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes, one row for each row of docs.

    Texts are UTF-8 bytes (null: empty) and strings never cross documents. Rows that repeat a doc_id do
    not remove each other's bytes; a null doc_id is larger than any other. Texts of fewer than 50 bytes
    keep all. An empty table gives an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            f = _finish(row, right.to_pylist())
            sums = [hashlib.sha256(x).hexdigest() for x in f.kept()]
            out.append(pa.Table.from_arrays([id_column(f.chunk.ids), pa.array(f.chunk.lens), pa.array(f.removed()), pa.array(f.spans()), pa.array(sums, pa.string())], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return _repeats(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col, text_col, False)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes taken out of the text; a character that loses a byte goes as a whole. Null texts become empty. All other columns stay."""
    names = docs.columns

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            f = _finish(row, right.to_pylist()).of_whole_characters()
            rest = pa.ipc.open_stream(unpack(row["rest"])).read_all()
            texts = pa.array([x.decode("utf-8", "replace") for x in f.kept()], pa.string())
            out.append(pa.Table.from_arrays([texts if n == text_col else rest[n] for n in names], names=names))
        return pa.concat_tables(out) if out else None

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema])
    return _repeats(docs, finish, schema, id_col, text_col, True)
