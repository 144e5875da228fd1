"""op12 learns from every document and every proposal."""

import time

from siftstone.llm import personal_data
from siftstone.llm.personal_data import PersonalData


def counted(rows):
    return {(r.kind, tuple(r.x), r.right, r.held_out): r.n for r in rows.collect()}


def test_documents_with_very_many_proposals_are_learned_from(spark):
    texts = ["a@b.cc " * 20_000, "x 4845168114407329 y " * 1_200, "+1 (826) 555-4081 190.137.223.204, " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = counted(PersonalData.labelled(docs))
    assert time.time() - began < 60
    total = lambda kind, right: sum(n for (k, _, r, _), n in found.items() if k == kind and r == right)
    assert total("email", 1) == 20_000 and total("card", 1) >= 1_200


def test_parts_change_no_verdict(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "+1 (826) 555-4081 190.137.223.204, 4845168114407329 4417744280351547 a@b.c " * 40), (2, "4111 1111 1111 1111 +12345678 " * 30)], "doc_id long, text string")
    whole = counted(PersonalData.labelled(docs))
    monkeypatch.setattr(personal_data, "SPANS", 3)
    assert counted(PersonalData.labelled(docs)) == whole and whole
