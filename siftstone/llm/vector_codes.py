"""Product codes of vectors: each part of a vector becomes the number of the nearest entry of the part's codebook.

Everything is in whole numbers. A component x counts as floor(256 * x); distances come from norms and
int64 matrix products, and the first of equally near entries is taken, so codes and codebooks are the
same however rows are dealt. Codebooks (parts x entries x places) are all that goes through the driver:
their size does not grow with the table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances to all entries are held at a time.
BLOCK = 2048
#: Scaled components below this in size cannot overflow int64 in any product or sum of a vector; others are reckoned with Python's integers.
SAFE = 1 << 24
#: A component beyond this in size counts as infinite: sums of it would leave a decimal of 38 places.
LARGEST = 1e24


def _integers(column: pa.Array, parts: int, width: int | None, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, scaled whole components) of the vectors that can be coded, for each length that is a multiple of parts (width: of this length only)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes[(sizes > 0) & (sizes % parts == 0)]).tolist():
        if width in (None, n):
            rows = np.flatnonzero(sizes == n)
            flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, n)
            with np.errstate(invalid="ignore"):
                ok = np.isfinite(x).all(axis=1) & (np.abs(x) <= LARGEST).all(axis=1)
            x = np.floor(x[ok] * scale)
            x = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if x.size and np.abs(x).max() >= SAFE else x.astype(np.int64)
            out.append((rows[ok], x))
    return out


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: the number of the nearest row of book (squared Euclidean distance; the first of equally near ones) and the distance."""
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    far = (book * book).sum(axis=1) - 2 * (x @ book.T)
    at = np.argmin(far, axis=1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def _all_parts(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and total squared distances."""
    parts, _, wide = books.shape
    codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), object if object in (x.dtype, books.dtype) else np.int64)
    for p in range(parts):
        codes[:, p], far = nearest_entries(x[:, p * wide : (p + 1) * wide], books[p])
        error = error + far
    return codes, error


def _book_array(books: list) -> np.ndarray:
    small = all(abs(v) < SAFE for part in books for entry in part for v in entry)
    return np.array(books, np.int64 if small else object)


def _first_rows(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int, width: int | None, scale: int) -> list:
    """The codable rows with the smallest ids (nulls last; then by vector): each task sends on its own first ones only."""

    def least(batches):
        best: list = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, x in _integers(batch.column(1), parts, width, scale):
                best += [((ids[r] is None, ids[r] or 0), v.tolist()) for r, v in zip(rows.tolist(), x)]
            best = sorted(best)[:entries]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in best]), pa.array([k[1] for k, _ in best], pa.int64()), pa.array([list(map(str, v)) for _, v in best])], names=["no_id", "id", "x"])

    found = vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(least, "no_id boolean, id long, x array<string>")
    wide = F.transform("x", lambda v: v.cast("decimal(38,0)"))
    return [[int(v) for v in r.x] for r in found.orderBy("no_id", "id", wide).limit(entries).collect()]


@dataclass(frozen=True)
class VectorCodec:
    """books[part][entry] is a list of whole numbers, scale times the components. Without entries (an empty table) no vector can be coded."""

    books: list
    scale: int = SCALE

    @staticmethod
    def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> VectorCodec:
        """Codebooks that begin as the parts of the first vectors by id and are moved to the means of what is nearest to each entry, rounds times.

        Vectors that are null, empty, or hold a null, NaN or infinite component (or one beyond LARGEST) are
        left out, and so are those whose length is not that of the first vector by id, or no multiple of
        parts. Null ids come last; rows that repeat count each; equal ids are ordered by vector. Fewer
        rows than entries make smaller codebooks. An entry that is nearest to nothing stays. Each task adds
        up what it has before sums are dealt by part and entry. Only the two columns named are read, so
        other ones can have any name.
        """
        if not 0 < entries <= 256:
            raise ValueError("entries must be 1 to 256: a code has one byte for each part")
        first = _first_rows(vectors, id_col, vector_col, parts, entries, None, scale)
        if len({len(v) for v in first}) > 1:
            first = _first_rows(vectors, id_col, vector_col, parts, entries, len(first[0]), scale)
        wide = len(first[0]) // parts if first else 0
        codec = VectorCodec([[v[p * wide : (p + 1) * wide] for v in first] for p in range(parts)], scale)
        for _ in range(rounds if first else 0):
            codec = codec._moved(vectors, vector_col)
        return codec

    @property
    def width(self) -> int:
        return sum(len(part[0]) for part in self.books if part)

    def _moved(self, vectors: DataFrame, vector_col: str) -> VectorCodec:
        parts, width, scale, wide = len(self.books), self.width, self.scale, len(self.books[0][0])
        shared = vectors.sparkSession.sparkContext.broadcast(_book_array(self.books))  # parts x entries x places numbers, whatever the table

        def add_up(batches):
            books = shared.value
            sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for _, x in _integers(batch.column(0), parts, width, scale):
                    for block in (x[at : at + BLOCK] for at in range(0, len(x), BLOCK)):
                        codes = _all_parts(block, books)[0]
                        own = np.zeros(books.shape, block.dtype)
                        for p in range(parts):
                            np.add.at(own[p], codes[:, p], block[:, p * wide : (p + 1) * wide])
                            counts[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                        sums = sums + own
            part, entry = (a.tolist() for a in np.nonzero(counts))
            if part:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
                values = [part, entry, [int(counts[p, e]) for p, e in zip(part, entry)], [[int(v) for v in sums[p, e]] for p, e in zip(part, entry)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "entry", "n", "sums"])

        found = vectors.select(vector_col).mapInArrow(add_up, "part int, entry int, n long, sums array<decimal(38,0)>")
        totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(wide))).alias("sums"))
        books = [[list(entry) for entry in part] for part in self.books]
        for r in totals.collect():  # at most one row for each entry
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]
        shared.unpersist()
        return VectorCodec(books, scale)

    def encode(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: str | None = None) -> DataFrame:
        """id, code (two hex digits for each part) and error (squared distance to what the code stands for, scaled; null beyond a long) of the vectors that `fit` does not leave out, and the column keep."""
        parts, width, scale = len(self.books), self.width, self.scale
        shared = vectors.sparkSession.sparkContext.broadcast(_book_array(self.books))

        def code(batches):
            books = shared.value
            for batch in batches:
                for rows, x in _integers(batch.column(1), parts, width, scale) if width else ():
                    for at in range(0, len(x), BLOCK):
                        codes, error = _all_parts(x[at : at + BLOCK], books)
                        texts, n = codes.tobytes().hex(), 2 * parts
                        rest = batch.take(pa.array(rows[at : at + BLOCK]))
                        errors = [int(e) if e < 1 << 63 else None for e in error]
                        columns = [rest.column(0), pa.array([texts[i : i + n] for i in range(0, len(texts), n)], pa.string()), pa.array(errors, pa.int64()), *rest.columns[2:]]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "code", "error", "kept"][: len(columns)])

        chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), *([F.col(keep).alias("kept")] if keep else []))
        schema = "id long, code string, error long" + (f", kept {chosen.schema['kept'].dataType.simpleString()}" if keep else "")
        coded = chosen.mapInArrow(code, schema)
        return coded.select(F.col("id").alias(id_col), "code", "error", *([F.col("kept").alias(keep)] if keep else []))

    def decode(self, coded: DataFrame, code_col: str = "code", name: str = "approximation") -> DataFrame:
        """coded with the vector that each code stands for."""
        books = F.array(*(F.array(*(F.array(*(F.lit(v / self.scale) for v in entry)) for entry in part)) for part in self.books))
        byte = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
        return coded.withColumn(name, F.concat(*(F.get(F.get(books, F.lit(p)), byte(p)) for p in range(len(self.books)))))

    def digest(self) -> str:
        """sha256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(v) for part in self.books for entry in part for v in entry).encode()).hexdigest()


def with_group_error(coded: DataFrame, group: str, name: str = "label_error") -> DataFrame:
    """coded with the error added up over equal values of group, nulls together: one row for each value is joined to all rows, a join that adaptive execution splits where a value is common."""
    sums = coded.groupBy(F.col(group).alias("__group")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias(name))
    return coded.join(sums, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")
