"""Reports of a round on small cases."""

from concordia.operators import audit, rounds


def test_law_mentions():
    text = "3065 sayılı Kanunun 17 nci maddesi ve aynı Kanunun 13 üncü maddesi ile GVK'nın 94 üncü, Harçlar Kanununun 57 nci maddesi; kanun yok"
    assert [(k, n) for _, _, k, n in rounds.law_mentions(text)][:3] == [("number", "3065"), ("back", "3065"), ("name", "193")]
    assert all(text[s:e] for s, e, _, _ in rounds.law_mentions(text)) and rounds.law_mentions(None) == []


def test_salvage(spark):
    broken = '```json [{"a": 1}, {"a": 2}, {"a": 2}, {"a": 2}, {"a": '
    rows = spark.createDataFrame([(broken,), ("[]",), (None,)], "x string")
    got = [(r.salvaged, r.repeats) for r in rounds.salvage(rows, "x").collect()]
    assert got == [('[{"a": 1}, {"a": 2}]', 2), (None, 0), (None, 0)]


def test_endpoint_ranges(spark):
    docs = spark.createDataFrame([(1, "maddeler 94-97 ve 3 ila 5"), (2, "5-9 var"), (3, "1-4")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "193", "94"), (1, "193", "97"), (1, "193", "3"), (1, "193", "4"), (1, "193", "5"), (2, "193", "5"), (2, "193", "9"), (2, "213", "5"), (2, "213", "9"), (3, "193", "1")], "doc_id long, law_no string, article string")
    assert [tuple(r) for r in rounds.endpoint_ranges(docs, rows).collect()] == [(1, "193", 94, 97)]


def test_replay_packs(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 5, 6, 20, 1, 1, 1))], "doc_id long, ordinal int, n int")
    assert [r["pack"] for r in rounds.replay_packs(rows, 12, 2).orderBy("ordinal").collect()] == [0, 0, 1, 2, 3, 3, 4]


def test_triage(spark):
    rows = spark.createDataFrame([("a law 193 in 5 here", "law 193 in 5", "193", "5"), ("a law 193 here", "law 193", "213", ""), ("a", "b", "1", ""), ("bu Kanunun 5 inci", "bu Kanunun 5 inci", "213", "mükerrer 5"), ("law 193", "law 193", "193", "5"), ("Kanunun267 inci", "Kanunun267 inci", "", "267")], "text string, source_text string, law_no string, article string")
    assert [r.kind for r in audit.triage(rows).collect()] == ["candidate_addition", "label_inconsistent_with_span", "ungrounded", "candidate_addition", "label_inconsistent_with_span", "label_inconsistent_with_span"]


def test_article_findings(spark):
    cases = [("5", "193 sayılı Kanunun 5 inci maddesi", None), ("5", "aynı madde", "anaphoric"), ("267", "Kanununun267 inci maddesi", "glued_to_preceding_word"), ("5", "madde 6 ve 7", "other_article_number"), ("5", "(2) numaralı bent", "sub_part_number"), ("mükerrer 5", "x", None)]
    rows = spark.createDataFrame([(a, q) for a, q, _ in cases], "article string, span string")
    assert [r[0] for r in rows.select(audit.article_finding(rows.article, rows.span)).collect()] == [w for _, _, w in cases]
