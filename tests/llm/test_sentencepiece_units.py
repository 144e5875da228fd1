"""op9: units are numbered by one sort of their keys, a block of text at a time."""

import numpy as np

from siftstone.llm import sentencepiece_lattice as lattice


def test_first_places_and_numbers():
    rng = np.random.default_rng(1)
    for n, different in ((1, 1), (7, 3), (5000, 40), (5000, 1 << 40)):
        keys = rng.integers(0, different, n).astype(np.uint64) << np.uint64(20)
        first, number = lattice._first_and_number(keys)
        seen = list(dict.fromkeys(keys.tolist()))
        assert keys[first].tolist() == seen and [seen[k] for k in number] == keys.tolist()


def test_units_do_not_depend_on_blocks(monkeypatch):
    texts = [b"one two  three\tone", b"", b"x" * 9000 + b" two " + b"x" * 9000, "é two\nthree".encode() * 50]
    whole = lattice.ChunkUnits(texts)
    assert b"".join(whole.texts()[k] for k in whole.number) == whole.raw and len(set(whole.texts())) == len(whole.texts())
    for size in (64, 1 << 13):
        monkeypatch.setattr(lattice, "_PIECE", size)
        assert lattice.ChunkUnits(texts).number.tolist() == whole.number.tolist()
