import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm.gru import Gru, classes_by_mass
from siftstone.llm.lm_score import LanguageModel, score_held_out
from siftstone.llm.queries import op1_lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(UPPER)) + ["\n"]


def brute(rows):
    counts = collections.Counter(w for i, t, out in rows if not out for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, _ in rows]


def small(hidden=6):
    counts = np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 9.0])
    return Gru(counts, np.array([0, 0, 1, 1, 1, 2, 2, 2, 3, 4]), hidden)


def test_probabilities_add_up_to_one():
    g = small()
    g.load(np.random.default_rng(0).standard_normal(g.weights().size))
    state = np.random.default_rng(1).standard_normal((1, 6)).astype(np.float32)
    assert np.exp(g.log_prob(np.repeat(state, 10, axis=0), np.arange(10))).sum() == pytest.approx(1, abs=1e-5)


def test_state_is_carried_over_windows_and_texts_do_not_mix():
    g = small()
    g.load(np.random.default_rng(2).standard_normal(g.weights().size))
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n) for n in (0, 40, 7, 1, 40, 129)]
    whole = g.score(texts, window=500)
    assert np.allclose(whole, g.score(texts, window=3, beside=2), atol=1e-3)
    for t, got in zip(texts, whole):
        state, total, word = np.zeros((1, 6), np.float32), 0.0, np.array([g.end])
        for w in [*t, g.end]:
            state = g._step(word, state)[0]
            word = np.array([w])
            total += g.log_prob(state, word)[0]
        assert got == pytest.approx(total, abs=1e-3)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    for name in Gru.NAMES:
        g = small()
        g.load(rng.standard_normal(g.weights().size) * 0.5)
        before, after = rng.integers(0, 10, (2, 5, 3))
        fresh = np.zeros((5, 3), bool)
        fresh[2, 1] = True
        state = rng.standard_normal((3, 6)).astype(np.float32)
        got = {}
        g._update = lambda grads, scale, rate: got.update({k: v.copy() for k, v in grads.items()})
        g._learn(before, after, fresh, state, 0)
        x = getattr(g, name)
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(6)]:
            old, losses = x[at], []
            for d in (1e-2, -1e-2):
                x[at] = old + d
                losses.append(g._learn(before, after, fresh, state, 0)[1])
            x[at] = old
            assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(got_first(got, name, g, before, after, fresh, state, at), abs=2e-2)


def got_first(got, name, g, before, after, fresh, state, at):
    g._learn(before, after, fresh, state, 0)
    return got[name][at]


def test_training_lowers_the_loss():
    words = np.tile(np.array([0, 3, 7, 9]), 500).astype(np.int32)
    starts = np.tile(np.array([True, False, False, False]), 500)
    g = small()
    first = g.train(words, starts, 2e-2, 2e-2, 4)
    for _ in range(3):
        last = g.train(words, starts, 2e-2, 2e-2, 4)
    assert last < 0.1 * first
    assert classes_by_mass(np.array([100, 50, 10, 1, 1]), 3).tolist() == sorted(classes_by_mass(np.array([100, 50, 10, 1, 1]), 3).tolist())


def test_whole_table(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n, want = brute([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs])
    got = {r.doc_id: r for r in op1_lm_scoring(spark, sf).collect()}
    assert len(got) == len(want) and {r.train_tokens for r in got.values()} == {n}
    for doc, size, known, base in want:
        r = got[doc]
        assert (r.n_tokens, r.n_known) == (size, known) and r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 7 == 2)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.95 * len(held)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 311}" for i in range(30000))
    rows = [(1, None), (2, ""), (3, "One TWO one"), (3, "One TWO one"), (None, "two É é"), (4, long), (5, "\t\n"), (6, "nobody knows these")]
    docs = spark.createDataFrame([(i, t, 1, 0.5, i == 6) for i, t in rows], "doc_id long, text string, n_tokens long, score double, out boolean")
    out = F.coalesce(F.col("out"), F.lit(False))
    model, scored = score_held_out(docs, out)
    n, want = brute([(i, t, i == 6) for i, t in rows])
    assert model.tokens == n
    got = sorted((tuple(r)[:4] for r in scored.collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want, key=str)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want, key=str)])
    assert score_held_out(docs.filter("false"), out)[1].collect() == []
    none = LanguageModel.fit(docs.filter("false")).score(docs).collect()
    assert len(none) == len(rows) and all(r.base_score == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)
