"""Base spans against the patterns as they are written, additions on planted cases, time on long texts."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F
from siftstone.llm.personal_data import KINDS, PersonalData, calibrated_threshold, find_spans, span_text
from siftstone.llm.queries import op12_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    """The base's spans."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


ODD = [
    None, "", "a@b.c", "a@b.c_d@e.f", "a@b", "a.b@c.d.@e.f", "x@y.z@p.q", "@a.b", "..%@-.-", "ä1@b.c é@x.y", "😀 a@b.c 😀 1.2.3.4 😀", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0255.1.1.001", "1.2.3", "300.1.2.3.4", "1.2.3.4\n5.6.7.8",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "1 2", "7 ", "41111111111111110", "+1 (826) 555-4081 190.137.223.204", "+1", "+12", "+1 2", "++1 22 33 44 55+", "+1234567", "+12345678", "+123456789012345", "+1234567890123456",
    "+1 (826) 555-4081-", "+1.2.3.4.5.6.7.8", "0" * 17, "- 4 1 - 1", "a@b.c" * 7, "1.1.1.1 " * 300, "+1 (826) 555-4081, " * 300 + "x@y.zz",
]


def spans(df):
    return {r.doc_id: (r.base, r.found) for r in df.select("doc_id", span_text("base").alias("base"), span_text("found").alias("found")).collect()}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return PersonalData.fit(docs)


def test_base_spans_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(ODD)], "doc_id long, text string, x string, found int").repartition(3)
    found = spans(PersonalData().find(docs))
    assert {i: b for i, (b, _) in found.items()} == {i: joined(brute(t)) for i, t in enumerate(ODD)}
    assert all(b == f for b, f in found.values())
    assert PersonalData().find(docs).columns == ["doc_id", "text", "x", "found", "base"]


def test_the_query_over_whole_texts(spark, sf_dir):
    got = {r.doc_id: r for r in op12_personal_data(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        base = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert set(joined(base).split(",")) <= set(got[i].spans.split(","))


def test_additions_where_runs_of_digits_meet(spark, model):
    cards = ["4845168114407329", "4417744280351547", "4929348385146306"]
    assert all(map(luhn, cards)) and not luhn("7086638319846192") and not luhn("9807915762804490")
    cases = {
        f"au 7086638319846192 {cards[0]} de": {cards[0]},
        f"au {cards[0]} {cards[1]} {cards[2]} de": set(cards),
        "Des +1 (826) 555-4081 190.137.223.204 du": {"190.137.223.204", "+1 (826) 555-4081"},
        f"un +1 (487) 555-7209 {cards[1]} un": {"+1 (487) 555-7209", cards[1]},
        "is jane.roe [at] mail7.example [dot] com or": {"jane.roe [at] mail7.example [dot] com"},
        "on +1 (132) 555-1352 Bebelich": {"+1 (132) 555-1352"},
        "a 7086638319846192 9807915762804490 b": set(),
        "clean words, 12 of them, at (noon) 3.14 and 555-7209.": set(),
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for i, (_, found) in spans(model.find(docs)).items():
        text = list(cases)[i]
        got = {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in found.split(",") if s)}
        assert got == cases[text], text


def test_additions_leave_the_base_and_do_not_overlap(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = 0
    for base, found in spans(model.find(docs)).values():
        base, found = ([tuple(s.split(":")) for s in x.split(",") if s] for x in (base, found))
        assert set(base) <= set(found)
        for k in KINDS:
            own = sorted((int(a), int(b)) for kind, a, b in found if kind == k)
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        more += len(found) - len(base)
    assert more > 0


def test_long_texts_take_time_in_proportion(spark, model):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "a.b%" * 250_000 + "@", "+1" * 300_000, "(" * 1_000_000, "word " * 200_000 + "x@y.zz", "a@" * 300_000, "4845168114407329 " * 20_000, "a@b.cc " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    found = spans(model.find(docs))
    assert time.time() - began < 150
    assert found[7] == ("email:1000000:1000006",) * 2
    assert found[9][0] == "" and found[9][1].count("card") == 20_000
    assert found[10][0] == joined(("email", 7 * i, 7 * i + 6) for i in range(20_000))


def test_plans_have_no_python(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = model.find(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_redaction(spark, model):
    docs = spark.createDataFrame([(1, "écris à a.b@c.de, +1 (826) 555-4081 190.137.223.204."), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in model.redact(docs).collect()}
    assert got == {1: "écris à [email], [phone] [ip].", 2: None, 3: "nothing"}


def test_models_of_tables_without_examples(spark):
    for rows in ([], [(1, None), (None, "")], [(1, "a@b.cc"), (1, "a@b.cc")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = PersonalData.fit(docs).find(docs).select(span_text("found").alias("f")).collect()
        assert sorted(r.f for r in found) == sorted(joined(brute(t)) for _, t in rows)


def test_a_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert PersonalData.fit(docs, rounds=2) == PersonalData.fit(docs.repartition(5), rounds=2)


def test_thresholds_pool_bins_that_fall():
    assert calibrated_threshold([(10, 0, 5), (50, 5, 10), (60, 4, 10), (90, 10, 10)]) == 90
    assert calibrated_threshold([(10, 9, 10), (50, 0, 1)]) is None
    assert calibrated_threshold([(80, 30, 30), (90, 28, 30)]) == 80


def test_positions_count_code_points(spark):
    text = "😀é" * 300 + "+1 22 33 44 55 " * 700
    row = spark.createDataFrame([(text,)], "t string").select(find_spans(F.col("t"), r"\+[0-9 ]+[0-9]", r"\+").alias("s")).first().s
    assert [(s.start, s.end) for s in row] == [m.span() for m in re.finditer(r"\+[0-9 ]+[0-9]", text)]
