from itertools import combinations

import numpy as np
from xxhash import xxh64_intdigest

from siftstone.llm.components import connected_components
from siftstone.llm.golay import LENGTH, nearby_indices
from siftstone.llm.near_dedup import deduplicate, fingerprint_links, golay_keys, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long"


def brute(rows, width=4, most=4):
    prints = {}
    for i, text in rows:
        words = bytes(text or "", "utf-8").lower().split()
        shingles = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
        hashes = [xxh64_intdigest(s, 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= most and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {i: (f"{prints[i]:016x}", label[i]) for i in prints}


def test_words_within_two_bits_share_a_golay_key():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << LENGTH, 3000).astype(np.uint32)
    idx, n = nearby_indices(words)
    assert set(n.tolist()) <= {1, 6}
    for flip in [(), *[(i,) for i in range(LENGTH)], *combinations(range(LENGTH), 2)]:
        other, m = nearby_indices(words ^ np.uint32(sum(1 << i for i in flip)))
        valid = (np.arange(6) < n[:, None])[:, :, None] & (np.arange(6) < m[:, None])[:, None, :]
        assert ((idx[:, :, None] == other[:, None, :]) & valid).any(axis=(1, 2)).all()


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        rows, keys = golay_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_spanning_links_join_what_all_links_join(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 6)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            b = int(b) ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(1, 5), replace=False))
            prints.add(b)
    links = [(r.a, r.b) for r in fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 4 and a < b for a, b in links)
    def groups(pairs):
        label = {p: p for p in prints}
        for _ in range(len(prints)):
            before = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if label == before:
                return label
    assert groups(links) == groups([(a, b) for a, b in combinations(sorted(prints), 2) if (a ^ b).bit_count() <= 4])


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {x: x for e in edges for x in e if x is not None and None not in e}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {k: v for k, v in label.items() if k in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_real_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()} == want


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (9, "one TWO"), (5, long), (6, long + " end"), (6, long), (7, "a b c d"), (8, "café Été x y z")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, 2) for i, t in rows] + [(None, "one two", None, None, None, 1, 2)], SCHEMA)
    got = near_duplicates(docs).collect()
    assert len(got) == 11
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert found[1] == found[2] == found[3] == ("0" * 16, 1)
    assert found[4] == found[9] and found[9][1] == found[None][1] == 4 and found[6][1] == 5
    want = brute((i, t) for i, t in rows if i != 6)
    assert {k: found[k] for k in want} == want
    assert near_duplicates(docs.filter("false")).collect() == []
    kept = deduplicate(docs)
    assert kept.columns[0] == "doc_id" and set(kept.columns) == set(docs.columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 7, 8]


def test_large_groups_of_one_key_are_split_without_loss():
    import time

    from siftstone.llm.near_dedup import _LARGE, _block_links, _links_of_groups, _spanning_links

    def labels(links, prints):
        label = {p: p for p in prints.tolist()}

        def root(x):
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        for a, b in links:
            for x, y in zip(np.broadcast_to(a, len(b)).tolist(), b.tolist()):
                label[max(root(x), root(y))] = min(root(x), root(y))
        return {p: root(p) for p in label}

    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [seeds]
    for _ in range(9):  # chains and bunches of fingerprints a few bits apart
        base = np.concatenate(flips)[rng.integers(0, sum(map(len, flips)), 250)]
        for k in range(int(rng.integers(1, 6))):
            base = base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64))
        flips.append(base)
    prints = np.unique(np.concatenate(flips))
    assert len(prints) > _LARGE
    assert labels(_block_links(prints, 4), prints) == labels(_spanning_links(prints, 4), prints)
    a, b = _links_of_groups(np.zeros(len(prints), np.int64), prints, 4)
    assert labels([(a, b)], prints) == labels(_spanning_links(prints, 4), prints) and (np.bitwise_count(a ^ b) <= 4).all()
    many = np.unique(rng.integers(0, 1 << 63, 300_000, dtype=np.uint64))  # one key that a great many share
    began = time.time()
    _block_links(many, 4)
    assert time.time() - began < 120
