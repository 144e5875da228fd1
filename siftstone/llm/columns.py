"""Small helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIB = 1 << 20
#: A null doc_id sorts after every other one.
NO_ID = np.iinfo(np.int64).max
#: Rows of an Arrow batch that are turned into Python texts at a time.
_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that setCheckpointDir or spark.checkpoint.dir names. Only a session on one machine may leave it out: a folder of one machine would tear data apart on a cluster."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or "/tmp/siftstone-checkpoints"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def giving_back(run):
    """run, a map of Arrow batches, and after its last one the memory that its task has freed is given back to the machine. Spark keeps Python workers for later tasks: without this, those that are idle hold what they needed most."""

    def outer(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without this call
            ctypes.CDLL(None).malloc_trim(0)

    return outer


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as make it none of those taken (upper and lower case count as one)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def id_array(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def pack(data: bytes | np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def unpack(data: bytes, dtype=None):
    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return pack(sink.getvalue().to_pybytes())


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 * MIB, carry: bool = False, then=None, schema: str | None = None) -> DataFrame:
    """One row for every run of about chunk_bytes of whole texts, as they stand in a partition:
    chunk_id, n_docs, doc ids, byte lengths and the texts, packed, and with carry all other columns
    (an Arrow stream, packed). A text is never cut. Each chunk
    depends only on its own input split, so a task that is run again makes the same chunks. then, if
    given, maps the chunks' batches to batches of schema in the same Python worker."""

    def make(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, lens, texts, rest, size = [], [], [], [], 0

        def emit():
            nonlocal seq, ids, lens, texts, rest, size
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 24) + seq], pa.int64()),
                    pa.array([sum(map(len, ids))], pa.int64()),
                    pa.array([pack(np.concatenate(ids))], pa.binary()),
                    pa.array([pack(np.concatenate(lens))], pa.binary()),
                    pa.array([pack(b"".join(texts))], pa.binary()),
                    pa.array([_stream(rest) if carry else None], pa.binary()),
                ],
                names=["chunk_id", "n_docs", "ids", "lens", "texts", "rest"],
            )
            seq, ids, lens, texts, rest, size = seq + 1, [], [], [], [], 0
            return row

        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            all_ids, all_texts = id_array(batch.column(0)), text_bytes(batch.column(1))
            sizes = np.fromiter(map(len, all_texts), np.int64, len(all_texts))
            start = 0
            for i, n in enumerate(sizes):
                size += int(n) + 64  # many empty texts make chunks too
                if size >= chunk_bytes:
                    ids.append(all_ids[start : i + 1]), lens.append(sizes[start : i + 1])
                    texts.extend(all_texts[start : i + 1])
                    rest.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield emit()
            if start < len(sizes):
                ids.append(all_ids[start:]), lens.append(sizes[start:])
                texts.extend(all_texts[start:])
                rest.append(batch.slice(start))
        if ids:
            yield emit()

    others = [c for c in docs.columns if c != text_col] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias(free_name("__id", others)), F.col(text_col).cast("string").alias(free_name("__text", others)), *others)
    if then is not None:
        return rows.mapInArrow(giving_back(lambda batches: then(make(batches))), schema)
    return rows.mapInArrow(giving_back(make), "chunk_id long, n_docs long, ids binary, lens binary, texts binary, rest binary")


def open_chunk(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """Doc ids and texts of a chunk's row."""
    ids, lens, raw = unpack(row["ids"], np.int64), unpack(row["lens"], np.int64), unpack(row["texts"])
    ends = np.cumsum(lens)
    return ids, [raw[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())]


def text_volume(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def bucket_count(volume: int, bucket_bytes: int, least: int = 64) -> int:
    """Buckets of hashed keys so that each one holds what bucket_bytes of text give, however large the input."""
    return max(least, math.ceil(volume / bucket_bytes))
