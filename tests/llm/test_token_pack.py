import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftstone.llm.queries import op6_token_packing
from siftstone.llm.token_pack import Encoder, pack_bits, read_document, read_tokens, unpack_bits, vocabulary_bits, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", " a", "a ", "a  b", "a   b", "a\nb", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", "\n", "a\tb", "a\n\tb", "a\n\t b", "a\u00a0b", "a \u00a0b\n\u00a0 c", "x<|endoftext|>y", "a\n <|endoftext|> b", "it's we'll\nI'm", "\0", "a \0b", "naïve 日本語 😀\nПривет, мир", "12 34\n5,6", "\x1ca b", "a\r\nb"]


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 7, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert unpack_bits(data, bits, 0, n).tolist() == ids.tolist()
        for a, b in [(n // 3, n // 2), (n // 2, n), (0, n // 5), (n, n)]:
            assert unpack_bits(data, bits, a, b).tolist() == ids[a:b].tolist()
    assert [vocabulary_bits(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_memo_gives_the_library_s_ids(sf_dir):
    import pyarrow.parquet as pq

    plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = ODD + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    for text, ids in zip(texts, encoder(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_a_full_memo_is_forgotten(monkeypatch):
    from siftstone.llm import token_pack

    monkeypatch.setattr(token_pack, "_MEMO", 10)
    plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in ["a b c d e", "e f g h\ni j k l", "a b x\ny", " z"] * 2:
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


MIXED = ["x y\tz", "x  y\tz", "y\tz\tv w\n\n", "x  y\u00a0z", " a\tb", "a\tb ", "a\n\nb\u2003c", "\na\x0bb", "a\u0085b  c", "a \nb\x1cc", "x  y\tz\nq  r\u3000s", "\x1f", "\t", "\n\t\n"]


def test_deviations_that_cancel_out():
    plain, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(["a", "bc", "'s", "12", ",", " ", " ", "\n", "\t", "\u00a0", "\u200b", "\x1c", "\u180e", "\ufeff"], rng.integers(1, 12))) for _ in range(5000)]
    for text in MIXED + made:
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(encoder(MIXED + made)) == len(MIXED) + len(made)


def test_files(spark, tmp_path, sf_dir):
    rows = [(i * 7 % 29, t, None) for i, t in enumerate(ODD)] + [(3, "again", None), (None, "no id", None), (50, None, None), (51, "long text " * 30000, None)]
    path = str(tmp_path / "tokens")
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string, start long"), path, PATH, block_ids=500)
    plain = Tokenizer.from_file(PATH)
    want, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in read_tokens(spark, path).collect()), key=key) == want
    found = read_document(spark, path, 51)
    assert len(found) == 1 and found[0].tolist() == plain.encode("long text " * 30000, add_special_tokens=False).ids + [0]
    assert len(read_document(spark, path, 3)) == 2 and read_document(spark, path, 77) == []


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_tokens(spark, path).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    plain, want, start = Tokenizer.from_file(PATH), [], 0
    for doc in sorted(docs):
        ids = plain.encode(docs[doc] or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, op6_token_packing(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
