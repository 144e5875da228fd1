from itertools import combinations

import numpy as np

from siftstone.llm.decontaminate import MASKS, SPAN, LeakFinder, drop_leaks, find_leaks, tokens

SCHEMA = "doc_id long, text string, item_id long, matched string"


def brute(docs, items, span=SPAN, share=0.8):
    """Items found in each document: every shift of every item is tried."""
    found = {}
    for doc, text in docs:
        d, hits = tokens((text or "").encode()), set()
        for item, own in items:
            t = tokens((own or "").encode())
            w = min(span, len(t))
            for shift in range(-len(t), len(d) + 1):
                same = [0 <= i + shift < len(d) and d[i + shift] == t[i] for i in range(len(t))]
                inside = [0 <= i + shift < len(d) for i in range(len(t))]
                if w and any(all(inside[i : i + w]) and sum(same[i : i + w]) >= share * w for i in range(len(t) - w + 1)):
                    hits.add(item)
        found[doc] = hits
    return found


def test_masks_find_twelve_tokens_with_any_two_substitutions():
    spans = [{o + i for i, c in enumerate(m) if c == "1"} for m in MASKS for o in range(SPAN - len(m) + 1)]
    assert all(any(not s & {a, b} for s in spans) for a, b in combinations(range(SPAN), 2))


def test_items_up_to_twelve_tokens_are_found_with_any_allowed_substitutions():
    for n in range(1, SPAN + 1):
        item = [f"w{i}" for i in range(n)]
        find = LeakFinder([(7, " ".join(item).encode())], SPAN, 0.8)
        for k in range(n + 1):
            for gone in combinations(range(n), min(k, 3)):
                text = " ".join(["a", "b"] + ["zz" if i in gone else w for i, w in enumerate(item)] + ["c"])
                assert (find(text.encode())[0] == 1) == (n - len(gone) >= 0.8 * n), (n, gone)


def test_real_documents_match_brute_force(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    words = {w for r in bench.collect() for w in tokens(r.text.encode())}
    near = [(i, t) for i, t in texts if sum(w in words for w in tokens(t.encode())) >= 8 and len(t) < 2000]
    want = brute(near, [(r.item_id, r.text) for r in bench.collect()])
    got = {r.doc_id: r for r in find_leaks(docs, bench).collect()}
    assert len(got) == len(texts)
    assert {i for i, _ in near if got[i].contaminated} == {i for i, h in want.items() if h}
    blocks = {r.doc_id: r for r in find_leaks(docs, bench, block_tokens=500).collect()}
    assert blocks == got
    assert drop_leaks(docs, bench).count() == sum(not r.contaminated for r in got.values())


def test_substitutions_and_short_items(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    item, short = [word() for _ in range(30)], ["Tiny", "item", "here"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item).upper()), (3, " ".join(short)), (4, None), (5, ""), (None, "some unnamed thing")], "item_id long, text string")
    docs = [(0, None), (1, ""), (2, "x " + " ".join(item)), (3, "they say tiny, ITEM here!"), (4, "tiny item there")]
    n = 10
    for at in combinations(range(9, 21), 2):  # a fragment of 12 words with two substitutions
        docs.append((n, " ".join([word() for _ in range(5)] + ["zz" if i in at else item[i] for i in range(9, 21)] + [word()])))
        n += 1
    docs += [(200, " ".join(item[:11])), (201, " ".join([word() for _ in range(20000)] + item)), (201, "some unnamed thing"), (None, " ".join(item))]
    rows = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], SCHEMA)
    got = find_leaks(rows, bench).collect()
    assert len(got) == len(docs)
    by = {(r.doc_id, r.item_id): r for r in got}
    assert all((i, 1) in by for i in range(10, n)) and by[2, 1].matched == 30 and by[2, 1].start == 1 and by[2, 1].n_items == 1
    assert (3, 3) in by and (4, None) in by and (200, None) in by and (201, 1) in by and (None, 1) in by and (0, None) in by
    kept = drop_leaks(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 200]
    assert not any(r.contaminated for r in find_leaks(rows, bench.filter("false")).collect())
    assert find_leaks(rows.filter("false"), bench).collect() == []


def test_blocks_of_items_change_nothing(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(words[20 * (i % 10) : 20 * (i % 10) + 15])) for i in range(30)]
    docs = [(i, " ".join(words[7 * i : 7 * i + 60])) for i in range(40)] + [(1, "again"), (None, items[3][1]), (50, None)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, find_leaks(docs, bench).collect()))
    assert sorted(map(str, find_leaks(docs, bench, block_tokens=60).collect())) == whole and any("contaminated=True, n_items=2" in r for r in whole)


def test_repetitive_texts_match_brute_force_in_time_in_proportion():
    import time

    rng = np.random.default_rng(9)
    texts = [["a"] * 60, ["a", "b"] * 30, ["a", "b", "c"] * 20, ["a"] * 30 + ["b"] * 30, list("ab" * 10) + ["a"] * 20 + list("abc" * 8), ["x", *["a"] * 13, "y"], list("abcdefghi" * 6)]
    texts += [list(rng.choice(list("ab"), 40)) for _ in range(6)] + [list(rng.choice(list("abc"), 25)) for _ in range(6)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    find = LeakFinder([(i, t.encode()) for i, t in items], SPAN, 0.8)
    docs = [(i, " ".join(["z"] * int(rng.integers(0, 4)) + t + list(rng.choice(list("abz"), 30)))) for i, t in enumerate(texts)]
    want = brute(docs, items)
    for i, text in docs:
        assert find(text.encode())[0] == len({items[k][1] for k in want[i]}), i
    find = LeakFinder([(1, b"word " * 500), (2, b"a b " * 250)], SPAN, 0.8)
    began = time.time()
    assert find(b"word " * 50_000)[:2] == (1, 1) and find(b"a b " * 25_000)[:2] == (1, 2)
    assert time.time() - began < 30
    for n in (2000, 20000):
        hits = find.index.candidates(np.full(n, find.index.tokens[0][0]))
        assert len(hits) <= n + 500


def test_repeated_items_are_one(spark):
    items = [(i, "The same, question here today!") for i in range(500, 0, -1)] + [(None, "the same question here today"), (0, "..."), (7, "another short question of six words")]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(7)
    docs = spark.createDataFrame([(1, "was it the same question here today"), (2, "another short question of six words")], "doc_id long, text string")
    assert {r.doc_id: (r.n_items, r.item_id) for r in find_leaks(docs, bench).collect()} == {1: (1, 1), 2: (1, 7)}
