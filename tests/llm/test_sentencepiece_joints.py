"""op9: words are cut off what no piece joins to them, so that fewer different units are asked for, with fewer substrings each."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from siftstone.llm import sentencepiece_lattice as lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
#: Digits, no character of which any piece joins to another, stand next to spaces, words and long characters.
TEXTS = ["word. word, word", "a1b22  3 4   5é6\n7\t8", "日1本🙂2🙂", "  .  ,x", "x" * 70 + "1" + "x" * 70, "1" * 100, "don't.Stop,now;then", ""]


@pytest.fixture(scope="module")
def table():
    return lattice.PieceTable.load(PATH, lattice.MERGES)


def test_no_piece_and_no_character_is_cut(table):
    joints = table.joints()
    for text in (p for p in table.pieces if p.strip()):
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
        assert not joints[raw[:-1] * 256 + raw[1:]].any()
    for units in (lattice.ChunkUnits([t.encode()], joints).texts() for t in TEXTS):
        assert all(u.decode() for u in units)
    assert lattice.ChunkUnits([b"word. word, word"], joints).texts() == [b" word", b".", b","]


def test_a_word_is_asked_for_once_whatever_follows_it(spark, table):
    docs = spark.createDataFrame([(0, "reanation reanation. reanation, reanation;")], "doc_id long, text string")
    none = lattice.CommonUnits.of(spark.createDataFrame([], "unit string, n long"), table)
    asked = [r.unit for r in lattice._ask(docs, none, table.joints(), "doc_id", "text", 1000).collect()]
    assert sorted(asked) == sorted([" reanation", ".", ",", ";"])


def test_ids_are_those_of_the_library(spark, table):
    library = SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: (r.n_tokens, r.ids_crc32, r.text_sha256) for r in lattice.encode_digests(docs, table, chunk_bytes=60).collect()}
    ids = [np.array(library.encode(t), "<u4") for t in TEXTS]
    assert found == {i: (len(x), zlib.crc32(x.tobytes()), hashlib.sha256(t.encode()).hexdigest()) for i, (x, t) in enumerate(zip(ids, TEXTS))}


def test_places_ask_only_for_sizes_that_begin_as_they_do(spark, table):
    known = {p: (i, s) for p, i, s in table.lattice()}
    heads = dict(lattice._heads(table))
    assert all(len(p) < lattice.HEAD or len(p) in heads[p[: lattice.HEAD]] for p in known)
    units = [" international", "ab", "abc", " thth", "izationization", "naïveté", "日本語", " Überstraße"]
    found = {r.unit: r.path for r in lattice.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()}
    for unit in units:
        path = found.get(unit, [-1 - k for k in range(len(unit))])
        assert [p if p >= 0 else unit[-1 - p] for p in path] == lattice.merges(unit, known, table.longest)


def test_long_units_have_keys_of_all_their_bytes():
    long = [b"x" * n + b"y" * m for n in (7, 8, 9, 63, 64, 65, 200) for m in (0, 1, 8)]
    units = lattice.ChunkUnits(long * 2)
    assert len(units.texts()) == len(set(long)) and [units.texts()[k][1:] for k in units.number] == long * 2


def test_digests_of_sliced_batches(table):
    ids = pa.array([[5], [], table.ids[:3], None], pa.list_(pa.int32())).slice(1, 2)
    row = lattice.digest(table)(pa.RecordBatch.from_arrays([pa.array([1, 2]), ids], names=["doc_id", "ids"])).to_pylist()
    text = "".join(table.pieces[:3])
    assert [r["n_tokens"] for r in row] == [0, 3]
    assert [r["text_sha256"] for r in row] == [hashlib.sha256(t.encode()).hexdigest() for t in ("", text[1:] if text[:1] == " " else text)]
