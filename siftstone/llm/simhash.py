"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import text_bytes

SEED = 42
_ROWS = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words (the whole sequence if there are fewer), words in lower case, joined by a space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1)).tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; of none, zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _ROWS):
        part = np.ascontiguousarray(hashes[i : i + _ROWS], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and the fingerprint as a signed long. A null or empty text has fingerprint zero."""

    def score(batches):
        for batch in batches:
            prints = [majority_bits(shingle_hashes(x, width)) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(score, "doc_id long, fp long")
