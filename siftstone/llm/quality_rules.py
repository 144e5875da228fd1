"""Quality rules as a short-circuit cascade.

Every rule is a cheap test of one text. A bounded sample tells what each rule costs and what it
rejects; rules then run in the order of rejections per second among what the rules before have let
through, and a text's first rejection ends its evaluation. The verdict does not depend on the order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.columns import text_bytes

SAMPLE_DOCS = 1000
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_CONTINUATION = bytes(range(0x80, 0xC0))
_LOWER, _UPPER = bytes(range(ord("a"), ord("z") + 1)), bytes(range(ord("A"), ord("Z") + 1))


class Text:
    """A text with its parts, each made when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    def word_chars(self) -> int:
        """Code points in words: all bytes but white space and those that continue a code point."""
        return len(self.raw.translate(None, _CONTINUATION + b" \t\n\v\f\r"))

    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those of them that equal an earlier line."""
        lines = [x for x in self.raw.split(b"\n") if x.strip()]
        return len(lines), len(lines) - len(set(lines))

    def repeat_words(self, width: int = WINDOW) -> int:
        """Words in windows of 8 words that are found twice or more in the text, the first one included."""
        n = len(self.words)
        if n <= width:
            return 0
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, n)
        step, distinct = 1, len(numbers)
        while step < width:  # number the runs of 2, 4 and 8 words
            pairs = ids[:-step] * distinct + ids[step:]
            found, ids = np.unique(pairs, return_inverse=True)
            distinct = len(found)
            if distinct == len(pairs):
                return 0
            step *= 2
        again = np.flatnonzero(np.bincount(ids)[ids] > 1)
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + width, -1)
        return int((np.cumsum(edges) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _symbols(t: Text) -> bool:
    return 10 * t.count(SYMBOLS) > t.word_chars()


def _shouting(t: Text) -> bool:
    upper = t.count(_UPPER)
    return 2 * upper > upper + t.count(_LOWER)


def _exclaiming(t: Text) -> bool:
    return 2 * t.count(b"!?") > len(t.words)


def _duplicate_lines(t: Text) -> bool:
    lines, again = t.lines()
    return again >= 3 and 10 * again > 3 * lines


def _word_length(t: Text) -> bool:
    return not 2 * len(t.words) <= t.word_chars() <= 15 * len(t.words)


def _list_like(t: Text) -> bool:
    """Half of the words or more stand beside a bar or a bullet."""
    return 4 * len(re.findall(rb"(?:^|\s)(?:[|\-*]|\xe2\x80\xa2)(?=\s|$)", t.raw)) > len(t.words)


def _digits(t: Text) -> bool:
    return 2 * t.count(b"0123456789") > t.word_chars()


def _stutter(t: Text) -> bool:
    """Half of the words or more equal the word before."""
    return 2 * sum(map(bytes.__eq__, t.words, t.words[1:])) > len(t.words)


RULES = (
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("duplicate_lines", _duplicate_lines),
    Rule("word_length", _word_length),
    Rule("list_like", _list_like),
    Rule("digits", _digits),
    Rule("stutter", _stutter),
)


def rank_rules(rejected: np.ndarray, cost: np.ndarray) -> list[int]:
    """Order of the rules: again and again the one with the most rejections, among texts that are still in, for its cost.

    rejected: texts by rules; cost: seconds of each rule for a text. Ties go to the cheaper rule, then to the first.
    """
    left, order, open_rules = np.ones(len(rejected), bool), [], list(range(len(cost)))
    while open_rules:
        best = min(open_rules, key=lambda r: (-(rejected[left, r].sum() / max(cost[r], 1e-12)), cost[r], r))
        order.append(best)
        open_rules.remove(best)
        left &= ~rejected[:, best]
    return order


@dataclass(frozen=True)
class QualityCascade:
    """rules in the order in which they run, and what the sample said of each: (name, share rejected, seconds a text)."""

    rules: tuple[Rule, ...]
    estimates: tuple[tuple[str, float, float], ...] = field(default=())

    @staticmethod
    def fit(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> QualityCascade:
        """Estimates on about sample_docs rows, those with the smallest hashes of id and text; an empty table leaves the rules as they stand.

        Rows are picked by a bound on the hash and measured where they are: only verdicts and times travel.
        """

        def measure(batches):
            for batch in batches:
                rows = []
                for raw in text_bytes(batch.column(1)):
                    said, took = [], []
                    for rule in rules:
                        began = time.perf_counter()
                        said.append(bool(rule.rejects(Text(raw))))
                        took.append(time.perf_counter() - began)
                    rows.append((said, took))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.bool_())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["at", "said", "took"])

        n = docs.count()
        bound = int(min(1.0, sample_docs / max(1, n)) * (1 << 32))
        text = F.col(text_col).cast("string")
        at = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 32)
        sample = docs.select(at.alias("at"), text.alias("text")).filter(F.col("at") < bound)
        rows = sample.mapInArrow(measure, "at long, said array<boolean>, took array<double>").orderBy("at", "said").limit(2 * sample_docs).collect()
        if not rows:
            return QualityCascade(tuple(rules))
        said, took = np.array([r.said for r in rows]), np.array([r.took for r in rows])
        cost = np.median(took, axis=0)
        order = rank_rules(said, cost)
        return QualityCascade(tuple(rules[r] for r in order), tuple((rules[r].name, float(said[:, r].mean()), float(cost[r])) for r in order))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
        """One row for each row of docs: doc_id, text statistics, base_failed, kept, the rule that rejected it and the rules that ran.

        Null texts are empty. Texts that fail the base limits (few words, or too many in repeated
        windows) are not kept, and no rule runs on them. An empty table gives an empty table.
        """
        rules = self.rules

        def judge(batches):
            for batch in batches:
                rows = []
                for raw in text_bytes(batch.column(1)):
                    t = Text(raw)
                    n, repeats = len(t.words), t.repeat_words()
                    failed = n < min_words or 100 * repeats > max_repeat_percent * n
                    ran, by = 0, "base" if failed else None
                    if not failed:
                        for rule in rules:
                            ran += 1
                            if rule.rejects(t):
                                by = rule.name
                                break
                    rows.append((n, t.word_chars(), t.count(SYMBOLS), t.lines()[1], repeats, failed, by is None, by, ran))
                columns = list(zip(*rows)) or [()] * 9
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by", "rules_run"])

        return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
            judge,
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string, rules_run int",
        )
