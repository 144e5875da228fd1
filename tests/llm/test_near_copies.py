from itertools import combinations

import numpy as np
import pytest

from siftstone.llm.near_copies import near_copies
from siftstone.llm.near_dedup import deduplicate


def brute(rows, width=5, least=0.8):
    """Component of each id over pairs of texts whose shingles have a Jaccard similarity of least or more."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label, links


def linked(label):
    size = {c: sum(c == x for x in label.values()) for c in set(label.values())}
    return {i: c for i, c in label.items() if size[c] > 1}


def changed_copies(seed):
    """Texts of several lengths with copies in which words are changed, two lines that many share, and chains of copies."""
    rng = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    common, texts = words(40), []
    for n in (3, 6, 12, 25, 60, 200, 500):
        for _ in range(4):
            base = words(n) + (common if rng.random() < 0.4 else [])
            texts.append(base)
            for share in (0.005, 0.01, 0.02, 0.03, 0.05):
                copy = texts[-1 if rng.random() < 0.5 else -2 if len(texts) > 1 else -1].copy()
                for at in rng.integers(0, len(copy), max(1, round(share * len(copy)))):
                    copy[at] = f"w{rng.integers(0, 3000)}"
                texts.append(copy)
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_copies_match_brute_force(spark, seed):
    rows = changed_copies(seed)
    want, links = brute(rows)
    assert len(links) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.node: r.component for r in near_copies(docs).collect()} == linked(want)
    assert {r.doc_id for r in deduplicate(docs).collect()} == {i for i, c in want.items() if i == c}


def test_real_documents_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want, _ = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.node: r.component for r in near_copies(docs).collect()} == linked(want)


def test_a_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(np.random.default_rng(3).integers(0, 100, 400))]
    want, _ = brute(rows)
    got = {r.node: r.component for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked(want)


def test_texts_that_share_a_line_and_are_no_copies_make_no_pairs(spark):
    """The pairs looked at grow with the texts, whether the line is rarer than the texts' own words or not."""
    from siftstone.llm import near_copies as module

    line, made = [f"c{i}" for i in range(40)], {}
    for own in ("rare", "common"):
        for n in (200, 400):
            words = (lambda i, k: f"o{i}-{k}") if own == "rare" else (lambda i, k: f"o{(i * 7 + k * k * 13) % 60}")
            rows = [(i, " ".join(line + [words(i, k) for k in range(8)])) for i in range(n)]
            docs = spark.createDataFrame(rows, "node long, text string")
            members = module._keys(docs, 5, 0.8).withColumn("label", module.F.col("node")).repartition("key").sortWithinPartitions("key", "node")
            made[own, n] = module._rest(members, 0.8).count()
            if own == "common" and n == 200:
                want, _ = brute(rows)
                assert {r.node: r.component for r in near_copies(docs.withColumnRenamed("node", "doc_id")).collect()} == linked(want)
    assert made["rare", 200] == made["rare", 400] == 0
    assert made["common", 400] < 0.1 * 400 * 399 / 2
