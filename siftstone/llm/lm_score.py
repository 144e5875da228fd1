"""Log-likelihood of whole documents under a gated recurrent language model, beside a unigram base.

Words are counted over all documents to learn from. The most frequent ones have numbers of their own in
the recurrent model; the others are in classes by their shape, which the model predicts like words, and
P(word | class) comes from the counts of all of them, with one count added for each and for one unseen
word. The recurrent model starts from a bounded sample and then passes once over every document to
learn from, in every partition beside each other; the partitions' weights are averaged.

Counts meet documents chunk by chunk: each chunk of documents asks for the counts of its different
words, a block for each range of word hashes, so a frequent word is asked for once by a chunk.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import MIB, bucket_count, chunk_documents, id_column, open_chunk, pack, shared_checkpoint, text_bytes, text_volume, unpack
from siftstone.llm.gru import Gru, classes_by_mass

#: Words with numbers of their own and their classes, classes of other words, size of the state.
VOCABULARY, CLASSES, SHAPES, HIDDEN = 1024, 32, 16, 16
#: The first pass: so many documents, passes, streams, and learning rates at the start and end; then those of the pass over all.
SAMPLE_DOCS, SAMPLE_PASSES, SAMPLE_STREAMS, SAMPLE_RATES = 400, 3, 32, (4e-3, 2e-3)
STREAMS, RATES = 512, (3e-3, 2e-4)
#: The token at the end of each text; no word has a newline.
END = b"\n"
_HELD = 1 << 20
#: Texts that are numbered at a time, and which bytes are letters or digits.
_ROWS, _ALNUM = 128, np.array([bytes([b]).isalnum() for b in range(256)])
#: Weights are averaged so many rows at a time, in so many levels: one row is left of any 31-bit number of partitions.
_FAN, _LEVELS = 32, 7
_COUNTS = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def shape(word: bytes) -> int:
    """Class of a word by its length, its last character, and whether all of it is ASCII."""
    return 4 * min(3, len(word) // 4) + 2 * (word[-1:].isalnum() or word[-1] > 127) + (not word.isascii())


def _symbols(texts: list[bytes], own: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of texts, own's or len(own) + shape(), and how many each text has."""
    split = [words_of(t) for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    out = np.fromiter(map(own.get, chain.from_iterable(split), repeat(-1)), np.int32, int(lens.sum()))
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    apart = np.flatnonzero(np.diff((raw == 32) | (raw - np.uint8(9) < 5)))  # where words begin and end
    begins, ends, high = apart[::2] + 1, apart[1::2], raw > 127  # a word's first and last byte
    last, wide = raw[ends], np.cumsum(high, dtype=np.int32)
    shapes = 4 * np.minimum(3, (ends - begins + 1) // 4) + 2 * (_ALNUM[last] | high[ends]) + (wide[ends] > wide[begins - 1])
    other = out < 0
    out[other] = len(own) + shapes[other]
    return out, lens


class _Numbers(dict):
    """Numbers of words. A word that is not known is given the next one when it is first asked for."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.n_own = len(own)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def others(self) -> list[bytes]:
        """Words that were not known, in the order in which they first came."""
        return list(islice(self, self.n_own, None))


def _by_bucket(words: list[bytes], buckets: int):
    """(bucket, places of words) for all buckets that have words."""
    of = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0]) if len(order) else order
    for a, b in zip(starts.tolist(), np.r_[starts[1:], len(order)].tolist()):
        yield int(of[order[a]]), order[a:b]


def count_words(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """bucket, words (joined by spaces, packed) and counts (packed): all different words of docs, and END once for each row."""

    def emit(counts: dict[bytes, int]):
        words, numbers, rows = list(counts), np.fromiter(counts.values(), np.int64, len(counts)), []
        for bucket, at in _by_bucket(words, buckets):
            rows.append((bucket, pack(b" ".join([words[i] for i in at.tolist()])), pack(numbers[at])))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTS)], schema=_COUNTS)

    def count(batches):
        from collections import Counter

        held: Counter = Counter()
        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                held.update(words_of(raw))
            held[END] += batch.num_rows
            if len(held) > _HELD:
                yield emit(held)
                held = Counter()
        if held:
            yield emit(held)

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for row in table.to_pylist():
            for word, n in zip(unpack(row["words"]).split(b" "), unpack(row["counts"], np.int64).tolist()):
                total[word] = total.get(word, 0) + n
        return pa.Table.from_pydict({"bucket": [table["bucket"][0].as_py()], "words": [pack(b" ".join(total))], "counts": [pack(np.fromiter(total.values(), np.int64, len(total)))]}, schema=_COUNTS)

    blocks = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, words binary, counts binary")
    return blocks.groupBy("bucket").applyInArrow(add, "bucket int, words binary, counts binary")


@dataclass(frozen=True)
class LanguageModel:
    """words: of the vocabulary, by class; shape_counts and shape_words: tokens and different words of each shape outside the vocabulary.

    tokens and different: N and V over all documents learned from; counts: every word's count, by bucket.
    """

    words: tuple[bytes, ...]
    word_counts: np.ndarray
    classes: np.ndarray
    shape_counts: np.ndarray
    shape_words: np.ndarray
    tokens: int
    different: int
    end_count: int
    weights: bytes
    counts: DataFrame
    buckets: int

    @staticmethod
    def _network(word_counts, classes, shape_counts, end_count) -> Gru:
        n = int(classes.max(initial=-1)) + 1
        return Gru(np.r_[word_counts, shape_counts, end_count].astype(float), np.r_[classes, n + np.arange(SHAPES + 1)], HIDDEN)

    @staticmethod
    def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
        """Learns from all rows of docs; null texts are empty. An empty table gives the model of no words: every score is of END alone or of unseen words."""
        buckets = bucket_count(text_volume(docs, text_col), 16 * MIB)
        counts = shared_checkpoint(count_words(docs, text_col, buckets))
        words, numbers, shapes = _statistics(counts)
        end_count = shapes.pop("end")
        order = np.argsort([-n for n in numbers], kind="stable")
        words, numbers = [words[i] for i in order], np.array([numbers[i] for i in order], np.int64)
        classes = np.unique(classes_by_mass(numbers, CLASSES), return_inverse=True)[1] if len(words) else np.empty(0, np.int64)
        in_shape = np.array([shape(w) for w in words], np.int64)
        shape_counts = shapes["counts"] - np.bincount(in_shape, numbers, SHAPES).astype(np.int64)
        shape_words = shapes["words"] - np.bincount(in_shape, minlength=SHAPES)
        total, different = int(shapes["counts"].sum()) + end_count, int(shapes["words"].sum()) + (end_count > 0)
        network = lambda: LanguageModel._network(numbers, classes, shape_counts, end_count)
        sample = docs.select(F.xxhash64(id_col).alias("at"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).orderBy("at", "id").limit(SAMPLE_DOCS).select("text").repartition(1)
        first = _learn(sample, network, words, None, SAMPLE_PASSES, SAMPLE_STREAMS, SAMPLE_RATES)
        start = _average(first) or pack(network().weights())
        weights = _average(_learn(docs.select(F.col(text_col).cast("string")), network, words, start, 1, STREAMS, RATES)) or start
        return LanguageModel(tuple(words), numbers, classes, shape_counts, shape_words, total, different, end_count, weights, counts, buckets)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 16 * MIB) -> DataFrame:
        """doc_id, n_tokens, n_known, base_score, score, one row for each row of docs. Texts are read whole; null texts are empty, and have END alone."""
        own = {w: i for i, w in enumerate(self.words)}
        buckets, counts = self.buckets, self.counts
        schema = pa.schema([("bucket", pa.int32()), ("chunk_id", pa.int64()), ("data", pa.binary())])
        sql = "bucket int, chunk_id long, data binary"
        plain = {f: getattr(self, f) for f in ("word_counts", "classes", "shape_counts", "shape_words", "tokens", "different", "end_count", "weights")}
        result = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

        def numbered(raw: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
            """Numbers of each text's words, and the different words outside the vocabulary, which come after it."""
            number = _Numbers(own)
            return [number.of(words_of(x)) for x in raw], number.others()

        def other_words(raw: list[bytes]) -> list[bytes]:
            found: dict[bytes, None] = {}
            for x in raw:
                found.update(dict.fromkeys(words_of(x)))
            return [w for w in found if w not in own]

        def ask(table: pa.Table) -> pa.Table:
            rows = []
            for row in table.to_pylist():
                words = other_words(open_chunk(row)[1])
                rows += [(b, row["chunk_id"], pack(b" ".join([words[i] for i in at.tolist()]))) for b, at in _by_bucket(words, buckets)]
            return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
            number: dict[bytes, int] = {}
            for row in known.to_pylist():
                number.update(zip(unpack(row["words"]).split(b" "), unpack(row["counts"], np.int64).tolist()))
            rows = [(r["bucket"], r["chunk_id"], pack(np.array([number.get(w, 0) for w in unpack(r["data"]).split(b" ")], np.int64))) for r in asked.to_pylist()]
            return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            m, out = _Plain(**plain), []
            for row in left.to_pylist():
                ids, raw = open_chunk(row)
                texts, words = numbered(raw)
                answers = {r["bucket"]: r["data"] for r in right.to_pylist()}
                count = np.zeros(len(words), np.int64)
                for b, at in _by_bucket(words, buckets):
                    count[at] = unpack(answers[b], np.int64)
                out.append(m.score(ids, texts, words, count, result))
            return pa.concat_tables(out) if out else result.empty_table()

        by_chunk = chunk_documents(docs, id_col, text_col, chunk_bytes).groupBy("chunk_id")
        asked = by_chunk.applyInArrow(ask, sql).groupBy("bucket")
        answers = asked.cogroup(counts.groupBy("bucket")).applyInArrow(answer, sql).groupBy("chunk_id")
        return by_chunk.cogroup(answers).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")


@dataclass(frozen=True)
class _Plain:
    """What scoring needs in a task."""

    word_counts: np.ndarray
    classes: np.ndarray
    shape_counts: np.ndarray
    shape_words: np.ndarray
    tokens: int
    different: int
    end_count: int
    weights: bytes

    def score(self, ids, texts, words, count, schema) -> pa.Table:
        """texts: numbers of their words, those of the vocabulary first, then words, which have these counts."""
        network = LanguageModel._network(self.word_counts, self.classes, self.shape_counts, self.end_count)
        network.load(unpack(self.weights, np.float32))
        n_own = len(self.word_counts)
        shapes = _symbols([b" ".join(words)], {})[0]
        counts = np.r_[self.word_counts, count]
        base = np.log10(counts + 1.0)
        in_shape = np.r_[np.zeros(n_own), np.log10((count + 1.0) / (self.shape_counts + self.shape_words + 1.0)[shapes])]
        symbol = np.r_[np.arange(n_own), n_own + shapes].astype(np.int32)
        rows, symbols = [], []
        for at in texts:
            rows.append((len(at) + 1, int((counts[at] > 0).sum()) + (self.end_count > 0), base[at].sum() + np.log10(self.end_count + 1.0), in_shape[at].sum()))
            symbols.append(symbol[at])
        n, known, sums, inside = (np.array(x) for x in zip(*rows))
        likely = network.score(symbols) / np.log(10) + inside
        return pa.Table.from_arrays([id_column(ids), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(sums - n * np.log10(self.tokens + self.different + 1.0)), pa.array(likely)], schema=schema)


def _statistics(counts: DataFrame) -> tuple[list[bytes], list[int], dict]:
    """The most frequent words (ties: by bytes) with their counts, and tokens and different words of each shape. END is apart."""

    def top(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, n = unpack(row["words"]).split(b" "), unpack(row["counts"], np.int64)
                end = [i for i, w in enumerate(words) if w == END]
                plain = [i for i, w in enumerate(words) if w != END and w]
                shapes = np.array([shape(words[i]) for i in plain], np.int64)
                best = sorted(plain, key=lambda i: (-n[i], words[i]))[:VOCABULARY]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in best] + [None], pa.binary()), pa.array([int(n[i]) for i in best] + [int(n[end].sum())], pa.int64())]
                    + [pa.array([None] * len(best) + [x.astype(np.int64).tolist()], pa.list_(pa.int64())) for x in (np.bincount(shapes, n[plain], SHAPES), np.bincount(shapes, minlength=SHAPES))],
                    names=["word", "n", "counts", "words"],
                )

    found = counts.mapInArrow(top, "word binary, n long, counts array<long>, words array<long>")
    best = found.filter("word is not null").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    sums = found.filter("word is null").agg(F.sum("n").alias("end"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("counts", "words") for i in range(SHAPES)]).first()
    shapes = {c: np.array([sums[f"{c}{i}"] or 0 for i in range(SHAPES)], np.int64) for c in ("counts", "words")}
    return [bytes(r.word) for r in best], [r.n for r in best], shapes | {"end": sums["end"] or 0}


def _learn(texts: DataFrame, network, words: list[bytes], start: bytes | None, passes: int, streams: int, rates: tuple[float, float]) -> DataFrame:
    """One row of weights for each partition that had texts, times the number of words it learned from."""

    def run(batches):
        from pyspark import TaskContext

        model, own, seen = None, {w: i for i, w in enumerate(words)}, 0
        for batch in batches:
            if model is None:
                model = network()
                if start:
                    model.load(unpack(start, np.float32))
            if not batch.num_rows:
                continue
            found = [_symbols(text_bytes(batch.column(0).slice(at, _ROWS)), own) for at in range(0, batch.num_rows, _ROWS)]
            lens = np.concatenate([n for _, n in found])
            ends, begins = np.cumsum(lens), np.zeros(int(lens.sum()) + len(lens), bool)
            flat = np.insert(np.concatenate([x for x, _ in found]), ends, np.int32(model.end))
            begins[ends - lens + np.arange(len(lens))] = True
            for k in range(passes):
                a, b = (rates[0] + (rates[1] - rates[0]) * x / passes for x in (k, k + 1))
                model.train(flat, begins, a, b, streams)
            seen += len(flat)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([float(seen)]), pa.array([pack(model.weights().astype(np.float64) * seen)], pa.binary())], names=["part", "n", "weights"])

    return texts.mapInArrow(run, "part int, n double, weights binary")


def _average(learned: DataFrame) -> bytes | None:
    """Mean of the rows' weights, added up as a tree: _FAN neighbours at a time, so that no task holds more than a few rows."""

    def add(table: pa.Table) -> pa.Table:
        total, n = 0.0, 0.0
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            total, n = total + unpack(row["weights"], np.float64), n + row["n"]
        return pa.Table.from_pydict({"part": pa.array([row["part"] // _FAN], pa.int32()), "n": [n], "weights": pa.array([pack(total)], pa.binary())})

    for _ in range(_LEVELS):
        learned = learned.groupBy(F.floor(F.col("part") / _FAN)).applyInArrow(add, "part int, n double, weights binary")
    row = learned.first()
    return pack((unpack(row.weights, np.float64) / row.n).astype(np.float32)) if row else None


def score_held_out(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[LanguageModel, DataFrame]:
    """A model of the rows that are not held out, and the scores of all rows."""
    model = LanguageModel.fit(docs.filter(~held_out), id_col, text_col)
    return model, model.score(docs, id_col, text_col)
