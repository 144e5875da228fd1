import re

import numpy as np

from siftstone.llm.quality_rules import RULES, QualityCascade, Text, rank_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_whole_table_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QualityCascade.fit(docs).apply(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        passes = not any(rule.rejects(Text(texts[r.doc_id].encode())) for rule in RULES)
        assert r.kept == (passes and not r.base_failed)


def test_good_labels_are_kept_and_bad_ones_rejected(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = QualityCascade.fit(docs).apply(docs).join(labels, "doc_id").filter("n_words >= 20").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.9 * sum(r.quality == 0 for r in rows)


def test_rank_prefers_rejections_per_cost_among_what_is_left():
    rejected = np.array([[1, 1, 0], [1, 1, 0], [1, 0, 0], [0, 0, 1]], bool)
    assert rank_rules(rejected, np.array([1.0, 0.5, 1.0])) == [1, 0, 2]
    assert rank_rules(rejected, np.array([0.1, 0.5, 1.0])) == [0, 2, 1]
    assert rank_rules(np.zeros((0, 2), bool), np.array([2.0, 1.0])) == [1, 0]


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(60000))
    texts = [None, "", " \n\t ", "a b", "x y\n\nx y\n", "one two three four five six seven eight " * 3, "one two three four five six seven eight", long, "# " * 30, "é\u00a0ü"]
    docs = spark.createDataFrame([(i, t, i, True) for i, t in enumerate(texts)] + [(4, texts[4], 0, None), (None, "a", None, None)], "doc_id long, text string, n_words long, kept boolean")
    got = QualityCascade.fit(docs).apply(docs).collect()
    assert len(got) == 12
    for r in got:
        text = "a" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(text)
    empty = docs.filter("false")
    assert QualityCascade.fit(empty).apply(empty).collect() == []
