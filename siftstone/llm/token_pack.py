"""Token ids in fixed-width bit packing.

Each id takes the fewest bits that hold every id of the vocabulary. Files are Parquet tables of blocks:
a block holds the ids of some whole documents as one run of bits (the lowest bit first), the documents'
ids and where each one ends, so that one document can be unpacked without its neighbours. Rows come in
ascending order of doc_id over the files; part numbers the files' tasks and start counts ids within one.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftstone.llm.columns import NO_ID, id_array, id_column, shared_folder

BLOCK_IDS = 1 << 16
END_ID = 0
_MEMO, _TEXTS = 1 << 20, 128
#: Punctuation that may be cut off behind a letter or digit below _LATIN.
_TAIL, _LATIN = string.punctuation, "\u0250"
#: White space other than a space and a newline, and those two beside each other.
_ODD = ["  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
BLOCK_SCHEMA = "part int, block int, first_id long, last_id long, start long, n_ids long, bits int, doc_ids binary, doc_ends binary, payload binary"


def vocabulary_bits(size: int) -> int:
    """Bits for ids below size."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of bits bits each, one after the other from the lowest bit of the first byte; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    if not len(ids):
        return b""
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    word, shift, values = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), ids.astype(np.uint64)
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.add.reduceat(values << shift, first)
    over = shift + np.uint64(bits) > 64
    words[word[over] + 1] += values[over] >> (np.uint64(64) - shift[over])
    return words.astype("<u8").tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """Ids start to end (uint32) of packed data, reading only the bytes that hold them."""
    if end <= start:
        return np.empty(0, np.uint32)
    low = start * bits // 64
    raw = data[8 * low : -(-end * bits // 8)]
    words = np.frombuffer(raw + bytes(16 - len(raw) % 8), "<u8")
    at = np.arange(start, end, dtype=np.uint64) * np.uint64(bits) - np.uint64(64 * low)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    values = words[word] >> shift
    over = shift + np.uint64(bits) > 64
    values[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return (values & np.uint64((1 << bits) - 1)).astype(np.uint32)


def is_odd(text: str) -> bool:
    """White space at either end, beside other white space, or other than a space and a newline; an empty text."""
    return not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD)


class Encoder:
    """A byte-level BPE tokenizer with a bounded memo.

    Its pre-tokenizer never joins a space before a word to what stands before the space, nor a newline
    between words to either word. So texts are cut there and each different piece is encoded once. Pieces
    new to the memo are encoded together, one text of all that follow a space and one of those that
    don't, and told apart by the ids that start with a space or are a newline. Punctuation behind a letter
    or digit is never joined to it either, so a piece's ids are those of its stem and of its tail. Texts
    where white space meets white space, or with special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        space, newline = (self.tokenizer.encode(x, add_special_tokens=False).tokens[0] for x in (" ", "\n"))
        self.spaced, self.newline = np.zeros(self.size, bool), self.tokenizer.token_to_id(newline)
        self.spaced[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith(space)]] = True
        # the library's own memo of words serves whole texts; new pieces are never in it
        self.unseen = Tokenizer.from_str(self.tokenizer.to_str())
        if hasattr(self.unseen.model, "_resize_cache"):
            self.unseen.model._resize_cache(0)
        self.memo, self.times = {"\0": b"", "\0\n": np.array([self.newline], "<u4").tobytes()}, 0

    def _forget(self) -> None:
        """Keeps the half of a full memo that was learned first, as frequent words come early; each eighth time nothing but the two pieces that are always there."""
        self.times += 1
        self.memo = dict(islice(self.memo.items(), _MEMO // 2 if self.times % 8 else 2))

    def _whole(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _remember(self, pieces: set[str]) -> None:
        """Puts pieces that are not in the memo there, and stems and tails of theirs."""
        memo, tailed, fresh = self.memo, [], set()
        for piece in pieces:
            stem = piece.rstrip(_TAIL)
            if len(stem) < len(piece) and stem and stem[-1] < _LATIN and stem[-1].isalnum():
                tail = "\0" + piece[len(stem) :]
                tailed.append((piece, stem, tail))
                fresh.add(stem), fresh.add(tail)
            else:
                fresh.add(piece)
        if fresh := fresh.difference(memo):
            self._learn(list(fresh))
        memo.update((p, memo[stem] + memo[tail]) for p, stem, tail in tailed)

    def _learn(self, fresh: list[str]) -> None:
        after_space = [p for p in fresh if p[0] != "\0"]
        first = [p for p in fresh if p[0] == "\0"]
        if after_space:
            ids = self._whole(" " + " ".join(after_space), self.unseen)
            cuts = (4 * np.flatnonzero(self.spaced[ids])).tolist() + [4 * len(ids)]
            data = ids.tobytes()
            self.memo.update((p, data[a:b]) for p, a, b in zip(after_space, cuts, cuts[1:]))
        if first:  # a zero byte stands before a piece that had no space before it
            ids = self._whole("\n".join(p[1:] for p in first), self.unseen)
            ends = (4 * np.flatnonzero(ids == self.newline)).tolist() + [4 * len(ids)]
            data = ids.tobytes()
            self.memo.update((p, data[a:b]) for p, a, b in zip(first, [0] + [e + 4 for e in ends], ends))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | None] = []
        for text in texts:
            pieces = text.replace("\n", " \0\n \0").split(" ")
            pieces[0] = "\0" + pieces[0]
            odd = "\0" in text or is_odd(text) or any(s in text for s in self.special)
            cut.append(None if odd else pieces)
        fresh = set().union(*(x for x in cut if x)).difference(self.memo)
        if len(self.memo) + 3 * len(fresh) > _MEMO:
            self._forget()
            fresh = set().union(*(x for x in cut if x)).difference(self.memo)
        if fresh:
            self._remember(fresh)
        look_up = self.memo.__getitem__
        return [self._whole(t).tobytes() if x is None else b"".join(map(look_up, x)) for t, x in zip(texts, cut)]


@lru_cache(maxsize=1)
def lasting_encoder(path: str, changed: int) -> Encoder:
    """One encoder for all tasks of a worker, so what is learned in one task serves the next; its memo is as bounded as before."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encodes every whole text (null: empty), each followed by end_id, and writes the blocks to path in ascending order of the id; a null id comes last.

    Texts are dealt by ranges of the id once; ids are made and packed where they are written.
    """

    def encode(batches):
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), lasting_encoder(tokenizer_path, os.stat(tokenizer_path).st_mtime_ns)
        bits, end = vocabulary_bits(encoder.size), np.array([end_id], "<u4").tobytes()
        block = start = 0
        ids, parts, sizes = [], [], []

        def emit():
            nonlocal block, start, ids, parts, sizes
            values, ends = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(np.array(sizes, "<i8") // 4)
            row = [part, block, ids[0], ids[-1], start, len(values), bits, np.array(ids, "<i8").tobytes(), ends.astype("<i8").tobytes(), pack_bits(values, bits)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            block, start, ids, parts, sizes = block + 1, start + len(values), [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "block", "first_id", "last_id", "start", "n_ids", "bits", "doc_ids", "doc_ends", "payload"])

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part_of = batch.slice(at, _TEXTS)
                texts = [t or "" for t in part_of.column(1).to_pylist()]
                for doc, data in zip(id_array(part_of.column(0)).tolist(), encoder(texts)):
                    ids.append(doc), parts.append(data + end), sizes.append(len(data) + len(end))
                    held += len(data) + len(end)
                    if held >= 4 * block_ids:
                        yield emit()
                        held = 0
        if ids:
            yield emit()

    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of its ids as little-endian unsigned 32-bit integers) from the files."""

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, ends = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_ends"], "<i8")
                values = unpack_bits(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                starts = np.r_[0, ends[:-1]].astype(np.int64)
                sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [id_column(docs), pa.array(starts + row["start"] + row["before"]), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row for each task that wrote, so the running sum is over few rows
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    running = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = parts.select("part", F.coalesce(running, F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(before), "part").mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that has its id), unpacking no other one. Blocks' first and last ids prune the scan."""
    found = []
    for row in spark.read.schema(BLOCK_SCHEMA).parquet(path).filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "block").toLocalIterator():
        docs, ends = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.doc_ends, "<i8")
        for i in np.flatnonzero(docs == doc_id).tolist():
            found.append(unpack_bits(row.payload, row.bits, int(ends[i - 1]) if i else 0, int(ends[i])))
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
