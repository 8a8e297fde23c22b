"""Queries over whole tables, against brute force."""

from collections import Counter

from concordia.operators import records, text
from concordia.plans import queries

SF = "/root/testdata/sf0.001"


def test_whole_tables(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").collect()
    n, known = Counter(r.o_custkey for r in o), {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    problem = lambda k: "duplicate" if n[k] > 1 else "not_in_pool" if k not in known else "unusable" if known[k] % 7 == 0 else None
    assert {r.o_orderkey: r.problem for r in queries.QUERIES["pool_join"](spark, SF).collect()} == {r.o_orderkey: problem(r.o_custkey) for r in o}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert queries.QUERIES["folded_texts"](spark, SF).count() == docs.count()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert queries.QUERIES["spelt_references"](spark, SF).count() == lines.select("l_orderkey").distinct().count()


def test_evidence_by_every_mode(spark):
    docs = spark.createDataFrame([(1, "He  said &amp; did “this”."), (2, "HE SAID & DID 'this'"), (3, "he said, did this!"), (4, "hesaid did this"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", 'said & did "this"'), ("b", "he said did this"), ("c", ""), ("d", None), ("e", "  said & did  “this” ")], "item_id string, q string")
    got = {(r.doc_id, r.item_id): r["mode"] for r in text.evidence_pairs(docs, items, 2).collect()}
    assert got == {(1, "a"): "folded", (1, "e"): "exact", (1, "b"): "loose", (2, "a"): "loose", (2, "e"): "loose", (2, "b"): "loose", (3, "a"): "loose", (3, "b"): "loose", (3, "e"): "loose", (4, "a"): "loose", (4, "e"): "loose"}  # "hesaid" holds "said"
    rows = docs.crossJoin(items).select("doc_id", "item_id", text.evidence_mode("q", "text").alias("mode")).where("mode IS NOT NULL")
    assert {(r.doc_id, r.item_id): r["mode"] for r in rows.collect()} == got


def test_numbered(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS a", "id AS b").repartition(5)
    got = [tuple(r) for r in records.numbered(rows, ("a", "b"), "place").orderBy("place").collect()]
    assert [r[:2] for r in got] == sorted(r[:2] for r in got) and [r[2] for r in got] == list(range(1, 5001))
    assert records.numbered(rows.limit(0), ("a", "b"), "place").count() == 0
