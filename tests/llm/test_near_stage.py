"""The near-duplicate stage keeps one text of each group where ids repeat or are null."""

import random

from tallyforge.llm import neardup


def test_stage_keeps_one_text_of_each_group(spark):
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    alone, twins = [text() for _ in range(6)], [text() for _ in range(3)]
    rows = [(None, t) for t in alone[:4]] + [(7, t) for t in alone[4:]] + [(i, t) for t in twins for i in (None, 5, 9)]
    rows += [(None, None), (None, ""), (3, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x["doc_id"], x["text"]) for x in neardup.stage_near_dedup(spark, d, "").collect()), key=str)
    want = [(None, t) for t in alone[:4]] + [(7, t) for t in alone[4:]] + [(5, t) for t in twins] + rows[-3:]
    assert got == sorted(want, key=str)
    ids = {x["component_id"] for x in neardup.near_duplicate_groups(d.filter("doc_id is null or doc_id = 5"), k=5).filter("doc_id = 5").collect()}
    assert ids == {5}
