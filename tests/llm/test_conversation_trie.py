"""The trie of conversations against plain dictionaries of prefixes."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from siftstone.llm.conversation_trie import joined_digests, numbered_turns, prefix_trie, with_shared_heads
from siftstone.llm.queries import OP11_SQL, op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, head=lambda c: zlib.crc32(str(c).encode()) % 9, donor=lambda c: c - c % 5):
    own = {}
    for c, t, r, x, *_ in sorted(((c, t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        own.setdefault(c, []).append((r, x))
    return {c: own.get(donor(c), [])[: head(c)] + turns[head(c) :] for c, turns in own.items()}


def brute(convs):
    """Nodes of the trie as tuples in the order of the columns."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        bytes_ = (len(own) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += bytes_
            leaves[path[:d]] += children[path] == 0
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
    parent = lambda p: min(members[p[:-1]]) if p else None
    return {(min(m), len(p), parent(p), len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()}


def nodes(df):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()]


def trie(spark, rows, schema=SCHEMA, most=8, head=None, donor=None, block=64):
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 9 if head is None else head
    return nodes(prefix_trie(*with_shared_heads(numbered_turns(spark.createDataFrame(rows, schema)), head, c - F.pmod(c, F.lit(5)) if donor is None else donor, most), block=block))


def test_the_query_equals_sql_and_plain_dictionaries(spark, sf_dir):
    found = nodes(op11_conversation_trie(spark, sf_dir))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = brute(rebuilt(rows))
    assert len(found) == len(wanted) and set(found) == wanted
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert set(con.execute(OP11_SQL).fetchall()) == wanted


def test_nulls_ties_empty_and_long_texts_and_clashing_columns(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{t} {'x' * (t % 3)}", 7, "p") for c in range(-7, 30) for t in range(c % 13)]
    rows += [(40, None, None, None, 7, "p"), (40, None, None, "b", 7, "p"), (40, None, "a", None, 7, "p"), (40, 1, "", "", 7, "p"), (40, 1, "", "", 7, "p"), (None, 1, "user", "lost", 7, "p")]
    rows += [(41, 0, "user", "é" * 200_000, 7, "p"), (42, 0, "user", "é" * 200_000, 7, "p"), (42, 0, "user", "é" * 200_000, 7, "p")]
    found = trie(spark, rows, SCHEMA + ", at long, path string")
    wanted = brute(rebuilt(rows))
    assert len(found) == len(wanted) and set(found) == wanted


@pytest.mark.parametrize("rows", [[], [(3, 0, "user", "alone")], [(5, 0, "user", "a"), (5, 1, "user", "b")], [(None, 0, "user", "nobody")], [(7, 0, "user", "same"), (9, 0, "user", "same")]])
def test_few_rows(spark, rows):
    found = trie(spark, rows)
    assert sorted(found, key=str) == sorted(brute(rebuilt(rows)), key=str)


def test_deep_shared_paths_in_small_blocks(spark):
    rows = [(c, t, "user", f"{t}" if t < 9 * c else f"{c} {t}") for c in range(6) for t in range(40 + c)] + [(c, t, "user", str(t)) for c in (10, 11, 12) for t in range(45)]
    same = {"head": F.lit(0), "donor": F.col("conv_id")}
    wanted = brute(rebuilt(rows, lambda c: 0, lambda c: c))
    for block in (7, 64):
        assert set(trie(spark, rows, block=block, **same)) == wanted


def test_ids_of_a_hot_end_pass_in_pieces(spark):
    rows = spark.range(3000).select(F.lit(4).alias("k"), ((F.col("id") * 7919) % 3000).alias("v")).union(spark.range(3).select(F.lit(5), "id")).repartition(7)
    got = {r.k: r.d for r in joined_digests(rows, ["k"], "v", "d", id_bytes=50).collect()}
    want = lambda n: hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert got == {4: want(3000), 5: want(3)}
