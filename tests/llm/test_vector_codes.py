"""Codebooks and codes against whole numbers of plain Python."""

import hashlib
import math

import duckdb
import pytest
from siftstone.llm.queries import OP13_SQL, op13_vector_codes
from siftstone.llm.vector_codes import VectorCodec, with_group_error

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codebooks, and code and error of each kept row in order."""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    wide = len(ok[0][1]) // parts if ok else 0
    cut = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[cut(v, p) for _, v in ok[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v in ok:
                groups[near(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(g) for x in zip(*g)] if g else e for g, e in zip(groups, books[p])])
        books = new
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in ok]
    return books, sorted(coded, key=str)


def coded(codec, df):
    return sorted(((r.vec_id, r.code, r.error) for r in codec.encode(df).collect()), key=str)


def test_the_query_equals_sql_and_plain_numbers(spark, sf_dir):
    found = {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op13_vector_codes(spark, sf_dir).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert found == set(con.execute(OP13_SQL).fetchall()) and len(found) == 500
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    books, want = brute(rows)
    assert sorted((f[:3] for f in found), key=str) == want
    assert {f[4] for f in found} == {hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()}


def test_odd_vectors_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [((i * 37 + k * 11) % 23 - 11) / 7 for k in range(32)], i % 3) for i in range(100)]
    rows += [(200, None, 1), (201, [], 1), (202, [1.0] * 31 + [None], 1), (203, [nan] * 32, 1), (204, [-inf] * 32, 1), (205, [0.5] * 31, 1), (206, [0.5] * 48, 1)]
    rows += [(None, [-0.001] * 32, None), (3, rows[3][1], None), (3, rows[3][1], 0), (3, [0.25] * 32, 1), (207, [1e9] * 32, None), (208, [-3e20] * 32, 1)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", code string, error int").repartition(5)
    codec = VectorCodec.fit(df)
    books, want = brute(rows)
    assert codec.books == books
    want = [(i, c, e if e < 1 << 63 else None) for i, c, e in want]
    assert coded(codec, df) == want
    back = {r.vec_id: r.approximation for r in codec.decode(codec.encode(df)).collect()}
    some = next(r for r in want if r[0] == 50)
    assert back[50] == [x / 256 for p in range(16) for x in books[p][int(some[1][2 * p : 2 * p + 2], 16)]]


def test_errors_by_label_nulls_together(spark):
    rows = [(i, [float(i + k) for k in range(16)], None if i % 4 == 0 else i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    codec = VectorCodec.fit(df, entries=4, rounds=1)
    out = with_group_error(codec.encode(df, keep="label"), "label").collect()
    assert len(out) == 80
    for r in out:
        assert r.label_error == sum(x.error for x in out if x.label == r.label)


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, None, 0)], [(2, [1.0] * 16, 0)], [(2, [1.0] * 16, 0), (2, [1.0] * 16, 0)]):
        df = spark.createDataFrame(rows, SCHEMA)
        codec = VectorCodec.fit(df)
        books, want = brute(rows)
        assert codec.books == books and coded(codec, df) == want
    with pytest.raises(ValueError):
        VectorCodec.fit(df, entries=257)
