import hashlib
from unittest import mock

import numpy as np
from siftstone.llm import suffix_dedup
from siftstone.llm.anchors import WIDTH, find_anchors
from siftstone.llm.bwt import repeated_windows
from siftstone.llm.suffix_dedup import remove_repeats, repeated_bytes

SCHEMA = "doc_id long, text string, n_bytes long, chunk_id string"


def brute(rows):
    order = sorted((2**63 if i is None else i, n) for n, (i, _) in enumerate(rows))
    first, out = {}, {}
    texts = [(t or "").encode() for _, t in rows]
    for i, n in order:
        for k in range(len(texts[n]) - WIDTH + 1):
            w = texts[n][k : k + WIDTH]
            first[w] = min(first.get(w, i), i)
    for i, n in order:
        text, gone = texts[n], np.zeros(len(texts[n]), bool)
        for k in range(len(text) - WIDTH + 1):
            if first[text[k : k + WIDTH]] < i:
                gone[k : k + WIDTH] = True
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out[n] = (rows[n][0], len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(out.values(), key=str)


def got(df):
    return sorted((tuple(r) for r in repeated_bytes(df).collect()), key=str)


def random_rows(seed, docs=60, size=700):
    rng = np.random.default_rng(seed)
    def words(n):
        return " ".join("".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(n))
    passages = [words(25) for _ in range(4)]
    rows = []
    for i in range(docs):
        text = words(rng.integers(0, size // 4))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(4)]
            a = rng.integers(0, len(p) // 2)
            p = p[a : a + rng.integers(30, len(p))]
            at = rng.integers(0, len(text) + 1)
            text = text[:at] + p + text[at:]
        rows.append((int(i * 37 % 101), text))
    rows += [rows[3], (200, rows[3][1]), (201, rows[4][1][:-5] + "zz"), (202, "ab" * 300), (203, "ab" * 200 + "c" * 200), (204, "c" * 49), (205, "c" * 50), (206, None), (207, ""), (None, rows[5][1]), (None, rows[5][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def test_random_texts_match_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert got(frame(spark, rows).repartition(3)) == brute(rows)


def test_hot_anchors_and_small_merges_match_brute_force(spark):
    rows = random_rows(3)
    with mock.patch.object(suffix_dedup, "HOT", 2):
        # workers import the module anew, so the limit is tried on the steps themselves
        chunk = suffix_dedup.ChunkAnchors
        import pyarrow as pa
        from siftstone.llm.columns import pack
        def row(part, n):
            texts = [(t or "").encode() for _, t in part]
            return {"chunk_id": n, "ids": pack(np.array([2**63 - 1 if i is None else i for i, _ in part])), "lens": pack(np.array([len(t) for t in texts])), "texts": pack(b"".join(texts))}
        chunks = [row(rows[i::3], i) for i in range(3)]
        table = lambda c: pa.Table.from_pylist([c])
        def regroup(tables, column):
            every = [r for t in tables for r in t.to_pylist()]
            return {k: pa.Table.from_pylist([r for r in every if r[column] == k], suffix_dedup._BLOB) for k in {r[column] for r in every}}
        decided = regroup([suffix_dedup._decide(t) for t in regroup([suffix_dedup._classes(table(c), 5) for c in chunks], "bucket").values()], "chunk_id")
        with mock.patch.object(suffix_dedup, "BATCH_BYTES", 500):
            compared = regroup([suffix_dedup._compare(t) for t in regroup([suffix_dedup._edges(table(c), decided[c["chunk_id"]], 4) for c in chunks], "bucket").values()], "chunk_id")
        out = []
        for c in chunks:
            f = suffix_dedup._finish(c, compared[c["chunk_id"]].to_pylist())
            out += zip([None if i == 2**63 - 1 else i for i in f.chunk.ids.tolist()], f.chunk.lens.tolist(), f.removed().tolist(), f.spans().tolist(), [hashlib.sha256(k).hexdigest() for k in f.kept()])
        assert chunk and sorted(out, key=str) == brute(rows)


def test_real_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_very_long_texts_are_cut_into_pieces_without_loss():
    rng = np.random.default_rng(8)
    long = rng.integers(97, 123, 1_300_000).astype(np.uint8).tobytes()
    texts = [b"x" * 60, long, b"", long[400_000:600_000]]
    doc, at, lo, hi, key, whole = find_anchors(b"".join(texts), np.array([len(t) for t in texts]))
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo.tolist(), hi.tolist())])
    starts = np.cumsum([0] + [len(t) for t in texts])
    assert sorted(windows.tolist()) == [w for s, t in zip(starts.tolist(), texts) for w in range(s, s + len(t) - WIDTH + 1)]
    assert len(set(key[doc == 3].tolist()) - set(key[doc == 1].tolist())) == 0 and ((lo <= at) & (at <= hi + 34)).all()


def test_merged_transforms_find_common_windows():
    rng = np.random.default_rng(9)
    for _ in range(20):
        strings = ["".join(rng.choice(list("ab"), rng.integers(4, 30))).encode() for _ in range(12)]
        owners = rng.integers(0, 6, 12)
        found = repeated_windows([strings[:3], [], strings[3:8], strings[8:]], owners, 8)
        want = [any(o2 < o and x in s2 for s2, o2 in zip(strings, owners)) if len(x := s[i : i + 8]) == 8 else False for s, o in zip(strings, owners) for i in range(len(s))]
        assert found.tolist() == want


def test_removal_keeps_columns_and_empty_tables(spark):
    rows = random_rows(4)
    docs = frame(spark, rows)
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r.doc_id: len(r.text.encode()) for r in out.collect()}
    want = {i: n - gone for i, n, gone, *_ in brute(rows)}
    assert all(want[i] - 8 * 6 <= kept[i] <= want[i] for i in kept if i is not None)
    assert repeated_bytes(docs.filter("false")).collect() == [] and remove_repeats(docs.filter("false")).collect() == []


def test_characters_that_lose_a_byte_go_as_a_whole(spark):
    # the passage between é (c3 a9) and è (c3 a8) repeats with its neighbours' shared bytes: a9 of é and ©, c3 of é and è
    middle = "0123456789" * 6
    rows = [(1, f"begin ©{middle}é end"), (2, f"other é{middle}è rest"), (3, f"ê{middle}ê")]
    texts = {r.doc_id: r.text for r in remove_repeats(frame(spark, rows)).collect()}
    assert texts == {1: rows[0][1], 2: "other  rest", 3: "ê"}


def test_columns_named_as_the_operator_names_its_own(spark):
    from siftstone.llm.suffix_dedup import remove_repeats

    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, 9, "x", f"one {passage}"), (2, 8, None, f"two {passage}"), (3, 7, "z", None)], "doc_id long, __id long, __text string, text string")
    out = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert remove_repeats(docs).columns == docs.columns
    assert {i: (r["__id"], r["__text"]) for i, r in out.items()} == {1: (9, "x"), 2: (8, None), 3: (7, "z")}
    assert out[1].text == f"one {passage}" and out[2].text.startswith("two") and passage not in out[2].text
