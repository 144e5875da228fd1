"""op1: words are numbered by arrays, and probabilities of few long texts are worked out together."""

import random

import numpy as np

from siftstone.llm import lm_score
from siftstone.llm.gru import Gru

PARTS = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\0", b"a", b"Z", b"9", b".", b"ab", b"longerword", "é".encode(), "　".encode(), "\x85".encode()]


def test_numbers_are_those_of_words_one_by_one():
    rng, own = random.Random(1), {b"a": 0, b"ab": 1, b"z": 2}
    for _ in range(2000):
        texts = [b"".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(5))]
        got, lens = lm_score._symbols(texts, own)
        want = [[own.get(w, len(own) + lm_score.shape(w)) for w in lm_score.words_of(t)] for t in texts]
        assert lens.tolist() == [len(w) for w in want] and got.tolist() == sum(want, []), texts


def test_new_words_are_numbered_as_they_come():
    number = lm_score._Numbers({b"a": 0, b"b": 1})
    assert number.of([b"x", b"a", b"y", b"x"]).tolist() == [2, 0, 3, 2] and number.of([b"z", b"y"]).tolist() == [4, 3]
    assert number.others() == [b"x", b"y", b"z"]


def test_a_long_text_takes_few_rounds_of_the_softmax(monkeypatch):
    g = Gru(np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 9.0]), np.array([0, 0, 1, 1, 1, 2, 2, 2, 3, 4]), 6)
    g.load(np.random.default_rng(2).standard_normal(g.weights().size))
    rng, rounds, inner = np.random.default_rng(3), [], Gru._by_class
    texts = [rng.integers(0, 9, n) for n in (4000, 3, 0, 700)]
    monkeypatch.setattr(Gru, "_by_class", lambda self, words: rounds.append(len(words)) or inner(self, words))
    whole = g.score(texts)
    assert len(rounds) <= 2 and sum(rounds) == sum(len(t) + 1 for t in texts)  # before, one round for every 16 places
    assert np.allclose(whole, g.score(texts, window=3, beside=2), atol=1e-2)
