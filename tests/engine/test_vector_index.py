"""The index against all pairs: exact answers, and the recall of a few lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators.vector_index import VectorIndex, best_possible

SCHEMA = "id long, v array<float>"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA).repartition(5)


def brute(queries, rows, skip_same=False):
    units = lambda xs: np.array([np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for _, v in xs])
    alike = np.round(units(queries) @ units(rows).T, 6)
    out = {}
    for k, (q, _) in enumerate(queries):
        found = [(alike[k, j], -r) for j, (r, _) in enumerate(rows) if not (skip_same and r == q)]
        if found:
            s, r = max(found)
            out[q] = (-r, s)
    return out


def answers(df):
    return {r.query_id: (r.row_id, r.similarity) for r in df.collect()}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    return np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16)) * 0.4, rng.normal(size=(300, 16)), np.tile(centres[0], (150, 1))])


def test_exact_search_equals_all_pairs(spark, vectors, tmp_path):
    rows = list(enumerate(vectors.tolist()))
    index = VectorIndex.build(table(spark, vectors), "id", "v", lists=20)
    assert sum(len(r.ids) // 8 for r in index.blocks.collect()) == len(rows)
    asked = table(spark, vectors).filter("id % 7 = 0")
    want = brute([r for r in rows if r[0] % 7 == 0], rows, True)
    assert answers(index.search(asked, "id", "v", probes=2, exact=True, skip_same=True)) == want
    index.write(str(tmp_path / "index"))
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    assert answers(again.search(asked, "id", "v", probes=1, exact=True, skip_same=True)) == want
    others = np.random.default_rng(4).normal(size=(40, 16))
    assert answers(index.search(table(spark, others, 5000), "id", "v", probes=3, exact=True)) == brute(list(enumerate(others.tolist(), 5000)), rows)


def recall(spark, folder, vector="embedding"):
    x = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", vector)
    index = VectorIndex.build(x, "vec_id", vector)
    asked = x.filter("vec_id % 50 = 0")
    few, all_ = (answers(index.search(asked, "vec_id", vector, exact=exact, skip_same=True)) for exact in (False, True))
    return sum(few.get(q, (None, None))[1] == s for q, (_, s) in all_.items()) / len(all_), len(all_)


def test_recall_of_a_few_lists(spark):
    for sf in ("sf0.01", "sf0.1"):
        share, n = recall(spark, f"/root/testdata/{sf}")
        assert n in (10, 40) and share >= 0.9


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 0.1]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    index = VectorIndex.build(df, "id", "v")
    assert answers(index.search(df, "id", "v", exact=True)) == {1: (1, 1.0), 7: (1, 1.0), 8: (8, 1.0)}
    assert answers(index.search(df, "id", "v", exact=True, skip_same=True)) == {1: (7, 1.0), 7: (1, 1.0), 8: (1, -0.707107)}
    alone = VectorIndex.build(df.filter("id = 8"), "id", "v")
    assert answers(alone.search(df.filter("id = 8"), "id", "v", exact=True, skip_same=True)) == {}
    empty = VectorIndex.build(df.limit(0), "id", "v")
    assert answers(empty.search(df.limit(0), "id", "v", exact=True)) == {}
    assert answers(index.search(df.limit(0), "id", "v")) == {}


def test_rings_bound_what_they_hold():
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, rows, queries = unit(rng.normal(size=8)), unit(rng.normal(size=(500, 8))), unit(rng.normal(size=(500, 8)))
    near = rows @ centre
    for low, high in ((-1, 1), (-0.2, 0.1), (0.3, 0.5)):
        ring = rows[(near >= low) & (near <= high)]
        assert (best_possible(queries @ centre, np.array(float(low)), np.array(float(high))) >= (queries @ ring.T).max(axis=1) - 1e-12).all()
