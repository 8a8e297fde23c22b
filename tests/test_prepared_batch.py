"""A pool row is read before it meets its records, and a manifest goes through its batch once."""

from pyspark.sql import functions as F

from concordia.operators import workflow as flow
from concordia.operators.preparation import REFERENCE


def _batch(spark):
    notes = spark.createDataFrame([(k, "e", i, i % 2 == 0) for i, k in enumerate(["a", "b", "b", None, "c", "d", "x", "e"])], "doc_key string, entry_name string, record_index long, completed boolean")
    pool = spark.createDataFrame([("a", "<p>text &amp more</p>", None), ("b", "b", "b"), ("c", "c", None), ("c", "c", None), ("d", "<p> </p>", ""), ("e", None, "a pdf"), (None, "n", None)], "doc_key string, html string, pdf string")
    return flow.prepared(notes.withColumn("raw", F.lit(None).cast(REFERENCE)), pool)


def test_rows(spark):
    got = {(r.doc_key, r.reason): (r.status, r.channel, r.text, r.text_sha256[:4]) for r in _batch(spark).collect()}
    empty = ("missing", "", "e3b0")
    assert got[("a", None)][:3] == ("ready", "htmlText", "text & more") and got[("e", None)][:3] == ("ready", "pdfText", "a pdf")
    assert got[("b", "duplicate_annotation")][1] == got[("c", "ambiguous_pool")][1] == "htmlText"
    assert [got[k] for k in ((None, "missing_id"), ("x", "not_in_pool"), ("d", "no_text"))] == [("quarantined", *empty)] * 3


def test_manifest_reads_once(spark):
    out = flow.manifest(_batch(spark))
    assert {(r.kind, r.value): r.n for r in out.collect() if r.kind != "warning"} == {("status", "ready"): 2, ("status", "duplicate_annotation"): 2, ("status", "ambiguous_pool"): 1, ("status", "missing_id"): 1, ("status", "not_in_pool"): 1, ("status", "no_text"): 1, ("channel", "htmlText"): 4, ("channel", "pdfText"): 1, ("channel", "missing"): 3}
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    assert any("regexp_replace" in line for line in lines) and not any("Union" in line for line in lines)
    for i, line in enumerate(lines):
        below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert "regexp_replace" not in line or not any("Join" in x for x in lines[i + 1 : below])
