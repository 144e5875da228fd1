import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from siftstone.llm.queries import op9_sentencepiece
from siftstone.llm.sentencepiece_lattice import MERGES, UNIT_BYTES, ChunkUnits, PieceTable, best_path, decode, encode, encode_digests, encode_units, fold_unit, merges

SCHEMA = "doc_id long, text string, lang string, unit string, path string, number int"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return PieceTable.load(PATH, MERGES)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def test_each_piece_is_made_of_two_of_higher_scores(table):
    known = {p: (i, s) for p, i, s in table.lattice()}
    for piece, (number, score) in known.items():
        if len(piece) > 1:
            parts = {piece[k:m] for k in range(len(piece)) for m in range(k + 1, len(piece) + 1)}
            higher = {p: known[p] for p in parts if p in known and known[p][1] > score}
            assert len(merges(piece, higher, table.longest)) == 2, piece
            assert merges(piece, known, table.longest) == [number]


def test_runs_of_spaces(table, library):
    single = table.single()
    known = {p: (i, s) for p, i, s in table.lattice()}
    for n in range(1, 200):
        for word in ("a", "the", "9", "x1,"):
            path = [i for p in fold_unit(" " * n + word, table, known) for i in (single[p] if isinstance(p, str) else [p])]
            assert path == library.encode(" " * (n - 1) + word)


TEXTS = ["The quick  brown fox", "", None, " leading", "trailing   ", "\n\n a\tb\r\nc", "naïve café — ﬁﬂ½ 日本語テキスト", "🙂🙃 x🙂", "don't \"quote\" <|im_end|>", "a" * 300, "x" * (UNIT_BYTES + 50) + "🙂 end", "   ", " " * 17 + "x" + " " * 40 + "🙂" + " " * 31, "\x01\x02", "der die das ñandú"]


def test_ids_are_those_of_the_library_and_texts_come_back(spark, table, library):
    rows = [(i, t, "en", None, "p", 1) for i, t in enumerate(TEXTS)] + [(1, "again", None, None, None, None), (None, "no id", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = encode(docs, table, chunk_bytes=200)
    found = sorted((r.doc_id is None, r.doc_id, r.ids) for r in encoded.collect())
    wanted = sorted((r[0] is None, r[0], library.encode(r[1] or "")) for r in rows)
    assert found == wanted
    texts = sorted((r.doc_id is None, r.doc_id, r.text) for r in decode(encoded, table).collect())
    assert texts == sorted((r[0] is None, r[0], r[1] or "") for r in rows)


def test_a_small_table_of_common_units_changes_nothing(spark, table, library):
    rows = list(enumerate(TEXTS + ["the quick fox the fox", "the dog the end"])) + [(1, "the the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted((i, library.encode(t or "")) for i, t in rows)
    for most in (0, 1, 3, 10):
        assert sorted((r.doc_id, r.ids) for r in encode(docs, table, chunk_bytes=100, most_common=most).collect()) == wanted


def test_units_of_a_chunk():
    texts = [(t or "").encode() for t in TEXTS] * 2 + [b"y" * (1 << 20) + b" z\n\n  end"]
    units = ChunkUnits(texts)
    every, at = units.texts(), 0
    for text, n in zip(texts, units.counts.tolist()):
        own = [every[k] for k in units.number[at : at + n].tolist()]
        assert own == (re.findall(rb"[\n\t]| *[^ \n\t]+| +", b" " + text) if text else [])
        at += n
    assert at == len(units.number) and len(set(every)) == len(every) and len(ChunkUnits([b"", b""]).number) == 0


def test_literal_space_signs_come_back(spark, table):
    texts = ["a▁b", "▁", "▁▁ x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.text for r in decode(encode(docs, table), table).collect()) == sorted(texts)


def test_fold_equals_trying_all_paths(spark):
    pieces = {" ": (1, -3.0), "a": (2, -1.0), "ab": (3, -2.0), "b": (4, -1.0), "ba": (5, -1.5), " ab": (6, -4.0), "bab": (7, -2.0)}
    table = PieceTable(tuple(pieces), tuple(i for i, _ in pieces.values()), tuple(s for _, s in pieces.values()), tuple(range(100, 356)))

    def every(unit):
        if not unit:
            yield 0.0, ()
        for n in range(1, min(3, len(unit)) + 1):
            hit = pieces.get(unit[:n]) or ((-1, table.unknown_score) if n == 1 else None)
            if hit:
                for score, rest in every(unit[n:]):
                    yield score + hit[1], (hit[0], *rest)

    units = [" abab", "baba", "a", " ", "cab", "abcba", " babab", "ccc"]
    found = {r.unit: r.path for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), table).collect()}
    score = {i: s for i, s in pieces.values()}
    for unit in units:
        best = max(s for s, _ in every(unit))
        assert sum(score.get(p, table.unknown_score) for p in found[unit]) == pytest.approx(best)
        local = best_path(unit, pieces, table.longest, table.unknown_score)
        assert [p if p >= 0 else unit[-1 - p] for p in found[unit]] == local


def test_empty_table(spark, table):
    assert encode_digests(spark.createDataFrame([], SCHEMA), table).collect() == []


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op9_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id: r.text_sha256 for r in found} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()} and len(found) == len(docs)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in docs.items() for x in [library.encode(t)]}
