"""Each query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from siftstone.plans.oracle import SQL
from siftstone.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {"greedy_feature_select", "linear_fit_score", "coef_top20"}


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    return repr(float(x)) if isinstance(x, float) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_each_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    wanted = duck.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert found == rows_of(names, wanted.fetchall())
    assert found[1], "a query without rows shows nothing"
