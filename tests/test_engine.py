"""The library without its corpus operators: spellings, comparison cases, and every query against its SQL."""

import hashlib
import hmac
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from concordia.functions import normalize
from concordia.operators import compare, metrics, records, text
from concordia.plans import queries
from concordia.sources import archives, documents
from concordia.streaming import reviews

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("raw,want", [("6/b", "6"), ("6/4-a", "6"), ("6 (2)", "6"), ("6-a", "6"), ("-1/1", "1"), ("• 1", "1"), ("5/A-1", "5/A"), ("94-96", "94 ila 96"), ("32/A", "32/A"), ("32/a", "32"), ("(17)", "(17)"), ("geçiçi 3", "geçici 3"), ("Mük. 20", "mükerrer 20"), ("229 ve müteakip maddelerinde", "229"), ("5'inci maddesi", "5"), ("madde 7", "7"), ("", ""), (None, "")])
def test_article(raw, want):
    assert normalize.article(raw) == want and normalize.article(want) == want


def test_numbers_and_names():
    assert [normalize.law_number(x) for x in ("0193", "0000", "2012/3305", "yok", None, "193.0")] == ["193", "0", "2012/3305", "", "", "193"]
    assert normalize.law_name("G.V.K.") == normalize.law_name("gvk") == "Gelir Vergisi Kanunu"
    assert normalize.reference("", "6183 sayılı Kanun", "51")[0] == "6183"
    assert normalize.spelt_articles("94 ila mükerrer 95") == ["94", "95", "mükerrer 95"]
    assert normalize.one_edit("abc", "abxc") and normalize.one_edit("abc", "axc") and not normalize.one_edit("ab", "ba") and normalize.one_edit("a", "a")


VUK, GVK, KVK = "Vergi Usul Kanunu", "Gelir Vergisi Kanunu", "Kurumlar Vergisi Kanunu"
CASES = [
    ([("193", "", "94")], [("", GVK, "94")], (1, 0, 0)),
    ([("193", "", "94")], [("", "GVK", "94")], (1, 0, 0)),
    ([("5422", KVK, ""), ("5520", KVK, "14")], [("", KVK, "14"), ("5422", "", "")], (1, 1, 1)),
    ([("193", "", "94")], [("0193", "", "94")], (1, 0, 0)),
    ([("3065", "", "13")], [("3065", "", "13/a")], (1, 0, 0)),
    ([("5520", "", "32/A")], [("5520", "", "32/a")], (0, 1, 1)),
    ([("193", "", "94 ila 96")], [("193", "", "94-96")], (3, 0, 0)),
    ([("3065", "", "")], [("3065", "", "(17)")], (0, 1, 1)),
    ([("193", "", "94")], [("193", "", ""), ("193", "", "94")], (1, 0, 0)),
    ([("193", "", ""), ("193", "", "94")], [("193", "", "94")], (1, 0, 0)),
    ([("6770", "", "")], [("6770", "", ""), ("6770", "", "5")], (1, 1, 0)),
    ([("193", "", "94")], [("193", "", "")], (0, 1, 1)),
    ([("213", VUK, "5")], [("213", GVK, "5")], (1, 0, 0)),
    ([("193", "", str(i)) for i in range(50)], [("193", "", str(i)) for i in range(40)] + [("213", "", str(i)) for i in range(20)], (40, 20, 10)),
    ([], [("", "", "5")], (0, 1, 0)),
]


def test_comparison_cases(spark):
    rows = [(k, side, i, *r) for k, (a, b, _) in enumerate(CASES) for side, x in (("reference", a), ("candidate", b)) for i, r in enumerate(x)]
    rows += [(99, "reference", 0, "492", "", "57"), (99, "candidate", 0, "", "Harçlar Kanunu", "57"), (99, "context", 0, "492", "Harçlar Kanunu", "57")]
    df = spark.createDataFrame(rows, "doc_id long, side string, pos long, kanun_no string, kanun_ad string, madde string")
    got = {r.doc_id: (r.tp, r.fp, r.fn) for r in compare.by_document(compare.compare_lists(compare.spell(df))).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(CASES)} | {99: (1, 0, 0)}


def test_agreement_case(spark):
    """Expert {A,B},{A}; annotator {A},{A}: 2 found, 1 missed. Two raters at chance: kappa 0."""
    bits = spark.createDataFrame([(1, "a", 1, 0, 1), (1, "b", 0, 0, 1), (2, "a", 1, 0, 1)], "doc_id long, law string, x int, y int, truth int")
    r = metrics.rater_scores(bits, ("x", "y")).where("rater = 'x'").first()
    assert (r.tp, r.fp, r.fn, r.precision, round(r.f1, 9), r.only_correct) == (2, 0, 1, 1.0, 0.8, 2)
    chance = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "a int, b int")
    k = metrics.kappa(chance, "a", "b").first()
    assert (k["items"], k.agreement, k.kappa) == (4, 0.5, 0.0)
    assert metrics.kappa(chance.limit(0), "a", "b").first().kappa is None


def test_percentiles(spark):
    r = metrics.distribution(spark.range(1, 11).selectExpr("cast(id as double) v"), "v").first()
    assert (r.p50, r.p90, r.p95, r.measured) == (5, 9, 10, 10)


def test_staged_counts():
    assert records.staged_counts([("1", "n", "5"), ("2", "", "6"), ("", "m", "7")], [("", "m", "7"), ("2", "k", "6"), ("1", "n", "5"), ("9", "", "1")]) == (3, 1, 0)


def test_tail_run(spark):
    rows = spark.createDataFrame([(["a"] + ["b"] * 12,), (["b", "a"],), ([],)], "w array<string>")
    got = [tuple(r) for r in rows.select(text.stuck_tail(F.col("w")), text.tail_run(F.col("w"))).collect()]
    assert got == [(True, 12), (False, 1), (False, 0)]


def test_pseudonym(spark):
    key = b"k" * 40
    got = spark.range(3).select("id", normalize.pseudonym(F.col("id"), key).alias("p")).collect()
    assert all(r.p == "dq_" + hmac.new(key, str(r.id).encode(), hashlib.sha256).hexdigest() for r in got)
    with pytest.raises(ValueError):
        normalize.pseudonym(F.lit("x"), b"short")


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.json", "﻿" + json.dumps({"documents": [{"evrakId": "1", "document_id": "2"}, {"evrakId": "3"}, {"other": 1}]}))
        z.writestr("a.jsonl", '{"document_id": "4", "annotation": {"is_completed": true}}\n\n')
    rows = archives.read_archives(spark, str(tmp_path))
    assert [(r.entry_name, r.record_index) for r in rows.orderBy("entry_name", "record_index").collect()] == [("a.jsonl", 0), ("b.json", 0), ("b.json", 1), ("b.json", 2)]
    known = {r.doc_key: (r.id_conflict, r.completed) for r in archives.annotation_records(rows).collect()}
    assert known == {"1": (True, None), "3": (False, None), "4": (False, True)}
    assert archives.audit_archives(spark, str(tmp_path)).first().json_entries == 2
    for bad in ("../x.json", "/x.json", "a/../../b.json"):
        with pytest.raises(archives.ArchiveError):
            archives.entry_name(bad)


def test_documents(spark, tmp_path):
    (tmp_path / "doc_7.json").write_text(json.dumps({"text": "t", "references": [{"kanun_no": "193", "madde": "1"}, {"kanun_no": "213", "status": "draft"}]}))
    assert [(r.doc_id, r.kanun_no) for r in documents.ground_truth(spark, str(tmp_path)).collect()] == [(7, "193")]
    assert documents.ground_truth(spark, str(tmp_path), drafts=True).count() == 2
    (tmp_path / "p.json").write_text(json.dumps([{"doc_id": 1, "status": "error"}, {"doc_id": "x"}, {"doc_id": 1, "references": []}]))
    assert [(r.doc_id, r.status, r.blocks) for r in documents.predictions(spark, str(tmp_path / "p.json")).collect()] == [(1, "success", 2)]
    rows = spark.createDataFrame([(1, "a", "gold"), (2, "b", "silver")], "doc_id long, text string, release_trust string")
    documents.write_release(rows, str(tmp_path / "release"))
    assert documents.verify_release(spark, str(tmp_path / "release"), "doc_id long, text string").count() == 0
    documents.write_jsonl(rows, str(tmp_path / "lines"))
    assert documents.jsonl(spark, str(tmp_path / "lines"), "doc_id long, text string").count() == 2


def test_stream_folds_like_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = reviews.event_stream(spark, str(tmp_path / "in"), events.schema, 1)
    fold = lambda df: reviews.review_states(df, "user_id", ("ts", "event_id"), "event_type", "value")
    q = fold(stream).writeStream.format("memory").queryName("states").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((r.user_id, r.state, r.versions, round(r.seconds or 0, 6)) for r in df.collect())
    assert rows(spark.table("states")) == rows(fold(events))
    seen = []
    q = reviews.predict_stream(stream, lambda df: df.select("event_id"), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sum(seen) == events.count()


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    number = lambda r: tuple(plain(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else plain(x) for x in r)
    assert sorted(map(number, got.select(*names).collect())) == sorted(map(number, want.select(*names).fetchall()))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
