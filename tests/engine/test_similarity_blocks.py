"""Fingerprints and vectors that meet block by block, against all pairs."""

import numpy as np
import pytest

from siftstone.operators import similarity as search


def table(spark, prints, name="a"):
    return spark.createDataFrame([(i, [int(w) for w in p.view(np.int64)]) for i, p in enumerate(prints)], f"{name} long, bits array<long>")


def shares(x, y):
    both = np.bitwise_count(x[:, None] & y[None]).sum(axis=2, dtype=int)
    either = np.bitwise_count(x[:, None] | y[None]).sum(axis=2, dtype=int)
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


@pytest.fixture()
def prints():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, (700, 1), dtype=np.uint64) | rng.integers(0, 1 << 63, (700, 1), dtype=np.uint64)
    return np.concatenate([x, x[:40], x[40:90] ^ np.uint64(5), np.zeros((2, 1), np.uint64)])


@pytest.mark.parametrize("least", [0.5, 0.75, 1.0])
def test_common_bits_meet_in_blocks(spark, prints, least, monkeypatch):
    monkeypatch.setattr(search, "PRINT_ROWS", 100)
    monkeypatch.setattr(search, "TILE_ROWS", 7)
    monkeypatch.setattr(search, "PAIR_ROWS", 50)
    monkeypatch.setattr(search, "_on_bits", None)  # a join by bits would make nearly all pairs of these
    a, b = table(spark, prints), table(spark, prints[::-1].copy(), "b")
    alike = shares(prints, prints[::-1])
    found = {(r.a, r.b): r.similarity for r in search.similar_pairs(a, b, "a", "b", least=least).collect()}
    assert found == {(i, j): alike[i, j] for i, j in np.argwhere(alike >= least - 1e-12).tolist()}
    novel = {r.a for r in search.novel(a, b, "a", "b", most=least).collect()}
    assert novel == set(np.flatnonzero(~(alike >= least - 1e-12).any(axis=1)).tolist())


def test_same_ids_do_not_count_in_blocks(spark, prints, monkeypatch):
    monkeypatch.setattr(search, "PRINT_ROWS", 100)
    monkeypatch.setattr(search, "_on_bits", None)
    alike = shares(prints, prints)
    np.fill_diagonal(alike, 0)
    want = set(np.flatnonzero(~(alike >= 0.8).any(axis=1)).tolist())
    for number in ("a", "concat('x', a)"):
        a = table(spark, prints).selectExpr(f"{number} AS a", "bits")
        found = {r.a for r in search.novel(a, a.withColumnRenamed("a", "b"), "a", "b", most=0.8, skip_same=True).collect()}
        assert found == {i if number == "a" else f"x{i}" for i in want}
    # an id whose other row has another fingerprint, a null id, and widths that differ
    odd = spark.createDataFrame([(1, [7]), (1, [15]), (2, [1 << 40]), (None, [7]), (3, [1 << 40, 0])], "a long, bits array<long>")
    assert {r.a for r in search.novel(odd, odd.withColumnRenamed("a", "b"), "a", "b", most=0.7, skip_same=True).collect()} == {1, 2, 3, None}


def test_rare_bits_are_still_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    few = np.zeros((400, 64 * 32), np.uint8)
    for row in few:
        row[rng.choice(few.shape[1], 8, replace=False)] = 1
    few[200:] = few[:200]
    few[200:, :3] ^= 1
    prints = np.packbits(few, axis=1, bitorder="little").view(np.uint64)
    monkeypatch.setattr(search, "_pairs_in_blocks", None)
    monkeypatch.setattr(search, "JOIN_COST", 4)
    a = table(spark, prints)
    alike = shares(prints, prints)
    assert {(r.a, r.b) for r in search.similar_pairs(a, a.withColumnRenamed("a", "b"), "a", "b", least=0.9).collect()} == set(map(tuple, np.argwhere(alike >= 0.9 - 1e-12).tolist()))
    monkeypatch.undo()
    monkeypatch.setattr(search, "_on_bits", None)
    monkeypatch.setattr(search, "JOIN_COST", 1e12)
    assert {(r.a, r.b) for r in search.similar_pairs(a, a.withColumnRenamed("a", "b"), "a", "b", least=0.5).collect()} == set(map(tuple, np.argwhere(alike >= 0.5 - 1e-12).tolist()))


@pytest.mark.parametrize("same", [False, True])
def test_nearest_a_few_queries_of_a_block_at_a_time(spark, same, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROWS", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 8)).round(1)
    v[100:] = v[:50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "q long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    alike = np.round(u @ u.T, 6)
    if same:
        np.fill_diagonal(alike, -np.inf)
    found = {r.q: r.r for r in search.nearest(df, df.withColumnRenamed("q", "r"), "q", "r", "v", block_rows=64, skip_same=same).collect()}
    assert found == dict(enumerate(alike.argmax(axis=1).tolist()))
