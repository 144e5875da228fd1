"""Small graphs whole in a task: as many passes whatever their shape, and the same results as larger graphs have by rounds of joins."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.operators import graphs, molecules, small_graphs

BONDS = "mol long, a int, b int, kind int"
ATOMS = "mol long, atom int, element string"


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(5)
    atoms, bonds = [(None, 1, "C"), (None, 2, "N"), (500, None, "C"), (501, None, None), (501, 1, "O")], [(None, 1, 2, 1), (501, None, 1, 1), (501, 1, 7, None)]
    for m in range(40):
        n = rng.randint(1, 12)
        atoms += [(m, i, "CNO"[i % 3]) for i in range(1, n + 1) if rng.random() < 0.97]
        bonds += [(m, rng.randint(1, n), rng.randint(1, n), rng.choice([1, 2, 3, None])) for _ in range(rng.randint(0, n + 2))]
    tail = [(200, i, i % 6 + 1, 1) for i in range(1, 7)] + [(200, i, i + 1, 1) for i in range(6, 12)]
    atoms += [(200, i, "C") for i in range(1, 13)]
    return spark.createDataFrame(atoms, ATOMS).repartition(3), spark.createDataFrame(bonds + tail, BONDS).repartition(3)


def results(atoms, bonds):
    around = (atoms, bonds, ["mol"], F.col("element"), 2, "atom")
    return {
        "rings": lambda: molecules.ring_counts(atoms, bonds),
        "bonds": lambda: molecules.scaffold_bonds(bonds),
        "keys": lambda: molecules.scaffold_keys(atoms, bonds, radius=2),
        "around": lambda: graphs.surroundings(*around, kind="kind"),
        "kinds": lambda: graphs.surrounding_kinds(*around, kind="kind"),
    }


def plain(found):
    return {k: (df.dtypes, sorted(map(tuple, df.collect()), key=repr)) for k, df in ((k, make()) for k, make in found.items())}


def test_small_and_large_graphs_agree(spark, some, monkeypatch):
    whole = plain(results(*some))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(small_graphs, "WHOLE", 9)
    try:
        assert plain(results(*some)) == whole and all(rows for _, rows in whole.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_side_chains_and_radius_take_one_pass(some, monkeypatch):
    passes, real = [], type(some[0]).checkpoint
    monkeypatch.setattr(type(some[0]), "checkpoint", lambda df, *a, **k: passes.append(1) or real(df, *a, **k))
    for name, make in results(*some).items():
        make().collect()
        assert len(passes) == 1, name
        passes.clear()


def test_hashes_are_those_of_columns(spark):
    rows = [(0, 1), (-5, 2**62), (2**63 - 1, -(2**63)), (42, 42)]
    want = [r.h for r in spark.createDataFrame(rows, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    a, b = (np.array(c, dtype=np.int64) for c in zip(*rows))
    assert small_graphs.hash_longs(42, a, b).tolist() == want
