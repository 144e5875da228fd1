"""Molecules of tables whose shuffles are coalesced each on its own: the atoms and bonds of one still meet in one task."""

import duckdb
import pytest

from siftstone.plans.oracle import SQL
from siftstone.plans.queries import QUERIES

#: Small parts, so that a few thousand rows are coalesced as large tables are.
COALESCED = {
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8000",
}


@pytest.fixture
def coalesced(spark):
    before = {k: spark.conf.get(k) for k in COALESCED}
    for k, v in COALESCED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["atom_surroundings", "ring_counts", "scaffold_groups"])
def test_atoms_and_bonds_meet(name, coalesced, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    wanted = duck.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    found = QUERIES[name](coalesced, sf_dir).select(names).collect()
    assert sorted(map(tuple, found)) == sorted(wanted.fetchall())
