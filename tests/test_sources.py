"""File sources that the driver's tables have no counterpart of."""

import json

from concordia.operators import rounds, text
from concordia.sources import documents


def test_universe_baseline_and_statuses(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a.json").write_text("[1, 2, 2, 7]")
    (tmp_path / "u/b.json").write_text('[{"doc_id": 7, "x": 1}, {"doc_id": 9}, {"other": 1}]')
    assert sorted(r.doc_id for r in documents.universe(spark, str(tmp_path / "u")).collect()) == [1, 2, 7, 9]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"method": "m", "core": {"precision": 0.5, "recall": 1.0, "f1": 2 / 3}}]}))
    assert [tuple(r) for r in documents.baseline(spark, str(tmp_path / "r.json")).collect()] == [("m", 0.5, 1.0, 2 / 3)]
    (tmp_path / "p.json").write_text(json.dumps([{"doc_id": 1}, {"doc_id": "x"}, {"doc_id": 2, "status": "error"}, {"doc_id": 3, "status": "success"}]))
    assert {r.status: r.n for r in documents.prediction_statuses(spark, str(tmp_path / "p.json")).collect()} == {"success": 2, "unusable_id": 1, "error": 1}


def test_last_block_wins_by_file_and_place(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": 1, "status": "error"}, {"doc_id": 2, "status": "error"}, {"doc_id": 2, "status": "success"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"doc_id": 1, "status": "late"}]))
    got = {r.doc_id: (r.status, r.blocks) for r in documents.predictions(spark, str(tmp_path / "*.json")).collect()}
    assert got == {1: ("late", 2), 2: ("success", 2)}


def test_endpoint_range_of_the_one_bare_law(spark):
    docs = spark.createDataFrame([(1, "94 ila 97")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, "193", "94"), (1, "193", "97"), (1, "213", "94"), (1, "213", "95"), (1, "213", "97")], "doc_id long, law_no string, article string")
    assert [tuple(r) for r in rounds.endpoint_ranges(docs, rows).collect()] == [(1, "193", 94, 97)]


def test_mentions_are_where_they_stand(spark):
    t = "12 a 7, 2020x3"
    rows = spark.createDataFrame([(1, t), (2, "none"), (3, None)], "doc_id long, text string")
    got = text.numbered_mentions(rows, "[0-9]+").orderBy("ordinal").collect()
    assert [(r.ordinal, r.mention) for r in got] == [(0, "12"), (1, "7"), (2, "2020"), (3, "3")] and all(t[r.start :].startswith(r.mention) for r in got)
