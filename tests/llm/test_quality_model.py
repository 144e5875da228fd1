import zlib

import numpy as np
from pyspark.sql import functions as F

from siftstone.llm.columns import unpack
from siftstone.llm.quality_model import SubwordClassifier, keep_good, softmax, text_features
from siftstone.llm.queries import op7_quality_classifier


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = op7_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    own = [r for r in got if r.held_out]
    assert len(own) > 60 and sum(r.predicted == r.quality for r in own) >= 0.95 * len(own)
    assert sum(r.predicted for r in own if r.quality == 1) >= 0.98 * sum(r.quality for r in own)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_fit_and_score_are_repeatable_and_handle_odd_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = SubwordClassifier.fit(docs, labels.withColumn("label", F.col("quality")))
    again = SubwordClassifier.fit(docs.repartition(5), labels.withColumn("label", F.col("quality")).repartition(3))
    assert model == again and model.n_train == 87
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "w" * 300000, 0.5), (3, "The of", 0.5), (None, "THE!! OF!!", 0.5), (4, " ".join(f"w{i}" for i in range(30000)), 0.1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = model.score(odd).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (1, 2)} == {1 / (1 + 2.718281828459045 ** -model.bias)}
    kept = keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= 0.7 for r in got)
    assert model.score(odd.filter("false")).collect() == []


def test_without_both_classes_every_score_is_one_half(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)], [(1, None)], [(9, 0)]):
        model = SubwordClassifier.fit(docs, spark.createDataFrame(labels, "doc_id long, label int"))
        assert [r.score for r in model.score(docs).collect()] == [0.5, 0.5]


def test_scores_are_those_of_the_features_and_of_a_softmax(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = SubwordClassifier.fit(docs, labels.withColumn("label", F.col("quality")))
    table = unpack(model.weights, np.float32).reshape(-1, 2).astype(float)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in model.score(docs).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        at, weight = text_features((text or "").encode())
        assert abs(softmax(weight.astype(float) @ table[at] + model.biases)[1] - got[k]) < 1e-5


def test_three_classes(spark):
    kinds = ("red green blue", "one two three", "cat dog cow")
    docs = spark.createDataFrame([(i, f"{kinds[i % 3]} {i}") for i in range(90)], "doc_id long, text string")
    model = SubwordClassifier.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 as int) as label"), classes=3)
    got = model.score(docs).collect()
    assert len(model.biases) == 3 and all((r.score > 0.7) == (r.doc_id % 3 == 1) for r in got)


def test_a_word_that_fills_every_text_does_not_make_training_diverge(spark):
    words = np.random.default_rng(5)
    rows = [(i, "same " * 900 + " ".join(f"w{w}" for w in words.integers(0, 300, 40)) + (" fine" if i % 8 else " SPAM!!") * 40, int(i % 8 > 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = SubwordClassifier.fit(docs, docs.select("doc_id", "label"))
    assert np.isfinite(unpack(model.weights, np.float32)).all() and np.isfinite(model.biases).all()
    assert all((r.score >= 0.7) == bool(r.label) for r in model.score(docs).join(docs.select("doc_id", "label"), "doc_id").collect())
