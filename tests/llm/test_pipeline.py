"""Each stage on its own input against a plain version, and the run as a whole."""

import public_tokenizers
import test_decontaminate
import test_near_copies
import test_near_dedup
import test_suffix_dedup
from sentencepiece import SentencePieceProcessor

import corpus_pipeline as pipeline
from siftstone.llm.decontaminate import tokens
from siftstone.llm.quality_model import SubwordClassifier
from siftstone.llm.queries import training_labels


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "near_dedup", "passage_dedup", "decontamination", "tokenization"]
    stage, seen, inputs = dict(pipeline.STAGES), docs, {}
    for name in names:
        inputs[name] = {r.doc_id: r for r in seen.collect()}
        seen = stage[name](spark, seen, sf_dir)
        if name != "tokenization":
            assert seen.dtypes == docs.dtypes
            seen = spark.createDataFrame(seen.collect(), docs.schema)
    text = lambda name: {i: r.text for i, r in inputs[name].items()}

    scores = SubwordClassifier.fit(docs, training_labels(spark, sf_dir)).score(docs).collect()
    good = {r.doc_id for r in scores if r.score >= 0.7}
    assert inputs["near_dedup"] == {i: r for i, r in inputs["quality"].items() if i in good} and 0 < len(good) < len(scores)

    label = test_near_dedup.brute(list(text("near_dedup").items()), width=5)
    assert set(inputs["passage_dedup"]) == {i for i, (_, c) in label.items() if c == i}

    plain = test_suffix_dedup.brute(list(text("passage_dedup").items()))
    removed = {r[0]: r[2] for r in plain}
    left = text("decontamination") if len(inputs["decontamination"]) == len(removed) else None
    assert left is not None and all(len(text("passage_dedup")[i].encode()) - n - 3 * 2 <= len(left[i].encode()) <= len(text("passage_dedup")[i].encode()) - n for i, n in removed.items() if n < 200)
    assert all(r.n_chars == len(r.text) for r in inputs["decontamination"].values())

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = {w for _, t in bench for w in tokens(t.encode())}
    near = [(i, t) for i, t in left.items() if sum(w in words for w in tokens(t.encode())) >= 8 and len(t) < 2000]
    leaks = {i for i, hit in test_decontaminate.brute(near, bench).items() if hit}
    assert {i for i, _ in near} - leaks == {i for i, _ in near} & set(inputs["tokenization"])

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = {i: library.encode(t) for i, t in text("tokenization").items()}
    assert {r.doc_id: r.ids for r in seen.collect()} == wanted
    assert {r.doc_id: r.ids for r in pipeline.run(spark, sf_dir).collect()} == wanted


def test_empty_and_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "web", 0), (1, "", "en", "web", 0), (2, "word " * 50000, "en", "web", 250000)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in pipeline.STAGES:
            found = stage(spark, docs, sf_dir).collect()
            assert len(found) <= len(rows) and (name != "tokenization" or len(found) == len(rows))


def without_repeats(texts, width=50):
    """Each text without the characters of which a byte lies in a width-byte string that also starts in a text with a smaller id."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = texts[i].encode()
        strings = [data[k : k + width] for k in range(len(data) - width + 1)]
        gone = bytearray(len(data))
        for k, s in enumerate(strings):
            if s in seen:
                gone[k : k + width] = b"\x01" * width
        seen.update(strings)
        at, kept = 0, []
        for c in texts[i]:
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        out[i] = "".join(kept)
    return out


def test_stages_with_near_copies_by_shingles(spark, sf_dir):
    """near_dedup against all pairs of 5-word shingle sets at a Jaccard similarity of 0.8, passage_dedup character by character, and what follows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(pipeline.STAGES)
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = spark.createDataFrame(stage["quality"](spark, docs, sf_dir).collect(), docs.schema)
    single = spark.createDataFrame(stage["near_dedup"](spark, good, sf_dir).collect(), docs.schema)
    label, links = test_near_copies.brute(list(text(good).items()))
    assert links and set(text(single)) == {i for i, c in label.items() if c == i}

    cut = spark.createDataFrame(stage["passage_dedup"](spark, single, sf_dir).collect(), docs.schema)
    assert text(cut) == without_repeats(text(single)) != text(single)

    clean = text(stage["decontamination"](spark, cut, sf_dir))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    words = {w for _, t in bench for w in tokens(t.encode())}
    near = [(i, t) for i, t in text(cut).items() if sum(w in words for w in tokens(t.encode())) >= 8 and len(t) < 2000]
    leaks = {i for i, hit in test_decontaminate.brute(near, bench).items() if hit}
    assert {i for i, _ in near} - leaks == {i for i, _ in near} & set(clean)

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in pipeline.run(spark, sf_dir).collect()} == {i: library.encode(t) for i, t in clean.items()}


def test_further_columns_stay_whatever_their_names(spark, sf_dir):
    F = test_near_copies.near_copies.__globals__["F"]
    names = ["node", "key", "component", "__id", "__text", "row", "label", "score", "item_id", "chunk_id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
