"""A supervised text classifier on subword embeddings.

Each word gives itself and its character n-grams as features, and each pair of neighbouring words one
more, all hashed into a fixed number of rows of an embedding table. A text is the average of its
features' vectors; a softmax layer over that average gives the classes. Vectors and layer are learned by stochastic gradient descent in numpy, in one task,
on a bounded sample of labelled rows; scoring runs wherever the rows are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import giving_back, pack, text_bytes, unpack

#: The bound on what is learned from: so many labelled rows, those with the smallest hash of the id.
TRAIN_DOCS = 4000
BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 16, 6, 0.5
NGRAMS = (3, 4)
#: How often a pair of words counts; a word has some ten features.
PAIR_WEIGHT = 3
#: Two marks stand for n-grams whatever their words: a word after itself, and a word in a line that the text has had before.
SAME, AGAIN, MARK_WEIGHT = b"\0same", b"\0again", 5
_MEMO = 1 << 19


def word_features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Rows of the table for a word: the word, and the n-grams of its characters between < and >. A mark is one row."""
    if word[:1] == b"\0":
        return [zlib.crc32(word) % buckets]
    chars = "<" + word.decode("utf-8", "replace") + ">"
    grams = [chars[i : i + n] for n in NGRAMS for i in range(len(chars) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace"), n) % buckets for n, g in [(1, chars), *((2, g) for g in grams)]]


def word_hash(word: bytes) -> int:
    return zlib.crc32(word)


def pair_rows(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Rows of the table for each word and the one after it, from the words' hashes (unsigned, 64 bits)."""
    mixed = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def text_marks(raw: bytes, words: list[bytes]) -> list[bytes]:
    """The marks of a text."""
    lines, again = set(), 0
    for line in raw.split(b"\n"):
        if line in lines:
            again += len(line.split())
        lines.add(line)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [SAME] * (MARK_WEIGHT * same) + [AGAIN] * (MARK_WEIGHT * again)


def text_features(raw: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a text uses and the weight of each; weights add up to one (to zero for a text without words)."""
    words = raw.split()
    known: dict[bytes, list[int]] = {}
    rows: list[int] = []
    for word in words + text_marks(raw, words):
        if word not in known:
            known[word] = word_features(word, buckets)
        rows += known[word]
    pairs = pair_rows(np.fromiter(map(word_hash, words), np.uint64, len(words)), buckets)
    at, n = np.unique(np.concatenate([np.array(rows, np.int64), np.repeat(pairs, PAIR_WEIGHT)]), return_counts=True)
    return at, (n / max(1, n.sum())).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis."""
    odds = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


class _Scorer:
    """Scores texts with a bounded memo of words; one for each task. Only how the other classes stand against class 1 matters: a column for each of them."""

    def __init__(self, weights: bytes, biases: tuple[float, ...]):
        table = unpack(weights, np.float32).astype(np.float64).reshape(-1, len(biases))
        others = [k for k in range(len(biases)) if k != 1]
        self.columns, self.biases = [table[:, k] - table[:, 1] for k in others], [biases[k] - biases[1] for k in others]
        self.buckets = len(table)
        self._clear(_MEMO)

    def _clear(self, room: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.sums, self.sizes, self.hashes = [np.zeros(room) for _ in self.columns], np.zeros(room), np.zeros(room, np.uint64)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Probability of class 1 for each text."""
        logits = np.array([self._logits(x) for x in texts], float).reshape(-1, len(self.biases))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(logits).sum(axis=1))

    def _logits(self, raw: bytes) -> list[float]:
        words = raw.split()
        marks = text_marks(raw, words)
        fresh = set(words + marks).difference(self.numbers)
        if len(self.numbers) + len(fresh) > len(self.sizes):  # full: start anew, with room for this text
            fresh = set(words + marks)
            self._clear(max(_MEMO, len(fresh)))
        for word in fresh:
            at = word_features(word, self.buckets)
            k = self.numbers[word] = len(self.numbers)
            self.sizes[k], self.hashes[k] = len(at), word_hash(word)
            for sums, column in zip(self.sums, self.columns):
                sums[k] = column[at].sum()
        at = np.fromiter(map(self.numbers.__getitem__, words + marks), np.int64, len(words) + len(marks))
        pairs = pair_rows(self.hashes[at[: len(words)]], self.buckets)
        n = max(1.0, self.sizes[at].sum() + PAIR_WEIGHT * len(pairs))
        return [(sums[at].sum() + PAIR_WEIGHT * column[pairs].sum()) / n + bias for sums, column, bias in zip(self.sums, self.columns, self.biases)]


@dataclass(frozen=True)
class SubwordClassifier:
    """weights: of each class for each table row (vector times layer); biases of the classes; n_train: rows learned from."""

    weights: bytes
    biases: tuple[float, ...]
    n_train: int

    @property
    def bias(self) -> float:
        """Of class 1 against class 0."""
        return self.biases[1] - self.biases[0]

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", train_docs: int = TRAIN_DOCS, seed: int = 11, classes: int = 2) -> SubwordClassifier:
        """Learns from the texts of docs and the labels (0 to classes - 1) of their ids in labels.

        The train_docs labels with the smallest hash of the id are used, other labels and null ones
        are not; all classes weigh the same. Without rows of each class every class is equally likely.
        No step moves a text's vector or the layer by more than 1, so weights stay finite whatever the texts.
        """
        at = F.xxhash64("id")
        bounded = labels.filter(F.col(label_col).isin(*range(classes))).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(at, "id", "label").limit(train_docs)
        found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(bounded), "id").orderBy(at, "id", "label").limit(train_docs)

        def train(batches):
            texts, labels = [], []
            for batch in batches:
                texts += [text_features(x) for x in text_bytes(batch.column(0))]
                labels += batch.column(1).to_pylist()
            y, rng = np.array(labels, np.int64), np.random.default_rng(seed)
            table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
            layer, bias = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
            count = np.bincount(y, minlength=classes)
            if count.all():
                weight = (len(y) / (classes * count)).astype(np.float32)
                steps, done = EPOCHS * len(y), 0
                for _ in range(EPOCHS):
                    for i in rng.permutation(len(y)):
                        at, w = texts[i]
                        hidden = w @ table[at]
                        wrong = -softmax(hidden @ layer + bias)
                        wrong[y[i]] += 1
                        wrong *= weight[y[i]] * np.float32(RATE * (1 - done / steps))
                        step, turn = min(50.0, len(at)) * (layer @ wrong), np.outer(hidden, wrong)
                        table[at] += np.outer(w, step / max(1.0, np.linalg.norm(step) * (w @ w))).astype(np.float32)
                        layer += (turn / max(1.0, np.linalg.norm(turn))).astype(np.float32)
                        bias += wrong * np.float32(0.1)
                        done += 1
            yield pa.RecordBatch.from_arrays([pa.array([pack((table @ layer).astype(np.float32))], pa.binary()), pa.array([bias.astype(float).tolist()], pa.list_(pa.float64())), pa.array([len(y)], pa.int64())], names=["weights", "biases", "n"])

        model = found.select("text", "label").repartition(1).mapInArrow(giving_back(train), "weights binary, biases array<double>, n long").first()
        if model is None:
            return SubwordClassifier(pack(np.zeros((BUCKETS, classes), np.float32)), (0.0,) * classes, 0)
        return SubwordClassifier(bytes(model.weights), tuple(model.biases), model.n)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score, the probability of class 1, for each row of docs. Null and empty texts get the score of the bias."""
        weights, biases = self.weights, self.biases

        def run(batches):
            scorer = _Scorer(weights, biases)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(text_bytes(batch.column(1))))], names=["doc_id", "score"])

        return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: SubwordClassifier, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text the model scores at threshold or more, with all their columns. Rows are scored in place: nothing is joined or shuffled."""
    weights, biases = model.weights, model.biases

    def run(batches):
        scorer = _Scorer(weights, biases)
        for batch in batches:
            keep = scorer(text_bytes(batch.column(batch.schema.get_field_index("text")))) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(giving_back(run), docs.schema)
