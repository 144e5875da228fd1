"""The pipeline's near_dedup links SimHash fingerprints, as named."""

import corpus_pipeline as pipeline
import test_near_dedup


def test_near_dedup_is_by_fingerprints(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in pipeline.near_dedup(spark, docs, sf_dir).collect()}
    label = test_near_dedup.brute([(r.doc_id, r.text) for r in docs.collect()], width=5)
    assert kept == {i for i, (_, c) in label.items() if c == i}
