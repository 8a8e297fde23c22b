"""Queries of ``operators.workflow`` and of reports that stand alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normalize import marked_text
from ..operators import rounds
from ..operators import workflow as flow
from ..streaming import reviews
from .backbone import cited, table
from .preparation import BODY_SQL, RAW_SQL, WARNED_SQL, _raw_lists
from .registry import query


def _batch(spark, d):
    """Orders as annotation records, pages as the pool."""
    k = F.col("doc_id")
    key = F.when(k % 10 == 0, F.lit(None).cast("string")).when(k % 23 == 0, F.lit("p1")).otherwise(F.concat(F.lit("p"), k % 4000))
    notes = _raw_lists(spark, d).select(key.alias("doc_key"), F.lit("e").alias("entry_name"), k.alias("record_index"), "raw", (k % 9 != 0).alias("completed"))
    p = table(spark, d, "pages")
    i = F.col("page_id")
    one = p.select(F.concat(F.lit("p"), i).alias("doc_key"), F.when(i % 3 != 0, F.col("html")).alias("html"), F.when(i % 5 != 0, F.lit("a pdf")).alias("pdf"))
    return flow.prepared(notes, one.union(one.where(F.col("doc_key").endswith("7"))), marked_text)


BATCH_SQL = WARNED_SQL + f""", n AS (SELECT DISTINCT doc_id, there FROM i), k AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN 'p1' ELSE 'p' || doc_id % 4000 END AS key, doc_id % 9 <> 0 AS completed FROM n),
g AS (SELECT key, count(*) AS records FROM k WHERE key IS NOT NULL GROUP BY 1), q AS (SELECT 'p' || page_id AS key, CASE WHEN page_id % 10 = 7 THEN 2 ELSE 1 END AS pooled, CASE WHEN page_id % 3 <> 0 AND {BODY_SQL} <> '' THEN 'htmlText' WHEN page_id % 5 <> 0 THEN 'pdfText' ELSE 'missing' END AS channel FROM pages),
b AS (SELECT doc_id, completed, CASE WHEN k.key IS NULL THEN 'missing_id' WHEN records > 1 THEN 'duplicate_annotation' WHEN pooled IS NULL THEN 'not_in_pool' WHEN pooled > 1 THEN 'ambiguous_pool' WHEN channel = 'missing' THEN 'no_text' END AS reason, coalesce(channel, 'missing') AS channel FROM k LEFT JOIN g ON g.key = k.key LEFT JOIN q ON q.key = k.key),
w1 AS (SELECT DISTINCT doc_id, code FROM w UNION SELECT doc_id, 'annotation_incomplete' FROM b WHERE NOT completed)"""


@query(BATCH_SQL + " SELECT kind, value, count(*) AS n FROM (SELECT 'status' AS kind, coalesce(reason, 'ready') AS value FROM b UNION ALL SELECT 'channel', channel FROM b UNION ALL SELECT 'warning', code FROM w1) GROUP BY 1, 2")
def prepared_batch(spark, d):
    """A batch prepared from records and a pool, as its manifest counts it."""
    return flow.manifest(_batch(spark, d))


@query("WITH j AS (SELECT l_orderkey AS doc_id, max(l_suppkey) AS verdict FROM lineitem GROUP BY 1) SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority WHEN o_custkey % 3 = 0 THEN 'imported' ELSE 'unknown' END AS annotator, o_orderstatus AS status, c_mktsegment AS prediction, cast(verdict AS VARCHAR) AS verdict FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN j ON j.doc_id = o_orderkey")
def review_page(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").alias("doc_id")
    c = F.col("o_custkey")
    docs = o.select(k, F.when(c % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("annotator"), F.when(c % 3 == 0, "imported").alias("imported"))
    pred = o.select(k, c.alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("prediction")), "c_custkey").drop("c_custkey")
    judge = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_suppkey").cast("string").alias("verdict"))
    return flow.review_page(docs, o.select(k, F.col("o_orderstatus").alias("status")), pred, judge, True)


@query("SELECT c_custkey, sha256('{\"a_name\":\"' || c_name || '\",\"b\":' || CASE WHEN c_custkey % 2 = 0 THEN cast(c_nationkey AS VARCHAR) ELSE 'null' END || ',\"key\":' || c_custkey || '}') AS fingerprint FROM customer")
def record_fingerprints(spark, d):
    row = {"key": F.col("c_custkey"), "a_name": F.col("c_name"), "b": F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))}
    return table(spark, d, "customer").select("c_custkey", flow.fingerprint(row).alias("fingerprint"))


@query(RAW_SQL + ", n AS (SELECT doc_id, count(*) AS n FROM i WHERE there GROUP BY 1) SELECT doc_id, n + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS refs, CASE WHEN doc_id % 3 = 0 THEN 'added' ELSE 'no_exact_evidence' END AS why FROM n")
def closing_formulas(spark, d):
    from ..operators.preparation import normalized_list

    rows = _raw_lists(spark, d).where("raw IS NOT NULL").withColumn("refs", normalized_list(F.col("raw")))
    said = F.when(F.col("doc_id") % 3 == 0, "… 213 sayılı Vergi Usul Kanununun 413 üncü maddesine göre …").otherwise("no formula 413")
    refs, why = flow.with_closing(F.col("refs"), said)
    return rows.select("doc_id", F.size(refs).cast("long").alias("refs"), why.alias("why"))


@query(RAW_SQL + " SELECT doc_id, count(*) AS raw, count_if(NOT (coalesce(kanun_no, '') = '2' AND coalesce(madde, '') = '1')) AS kept FROM i WHERE there GROUP BY 1")
def prediction_views(spark, d):
    from ..operators.preparation import normalized_list

    rows = _raw_lists(spark, d).where("raw IS NOT NULL").select("doc_id", normalized_list(F.col("raw")).alias("references"))
    both = flow.prediction_views(rows, (("2", "1"),))
    return both.select("doc_id", F.size("raw_references").cast("long").alias("raw"), F.size("references").cast("long").alias("kept"))


@query("SELECT o_orderkey % 5 AS form, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS items, CASE o_orderkey % 5 WHEN 1 THEN 3 ELSE 0 END AS repeats, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def salvaged_outputs(spark, d):
    """Whole arrays, arrays that repeat their last object, ones that break off, and nothing to save."""
    forms = ('[{"a": 1}, {"a": 2}]', '```json [{"a": 1}, {"a": 2}, {"a": 2}, {"a": 2}, {"a": 2}, {"a": ', '[{"a": 1}, {"a"', "[]", "no array")
    k = (F.col("o_orderkey") % 5).alias("form")
    rows = table(spark, d, "orders").select(k, F.element_at(F.array(*map(F.lit, forms)), (k + 1).cast("int")).alias("x"))
    out = rounds.salvage(rows, "x")
    return out.groupBy("form", F.json_array_length("salvaged").alias("items"), "repeats").agg(F.count("*").alias("n"))


@query("SELECT doc_id, '193' AS law_no, 94 AS first, 97 AS last FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL")
def endpoint_ranges(spark, d):
    """Texts that write 94-97; a third of the lists hold both ends and nothing between, a third one between, a third the ends of two laws."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(k, F.lit("maddeler 94-97 uyarınca").alias("text"))
    row = lambda law, article: F.struct(F.lit(law).alias("law_no"), F.lit(article).alias("article"))
    ends = [row("193", "94"), row("193", "97")]
    lists = F.when(k % 3 == 0, F.array(*ends)).when(k % 3 == 1, F.array(*ends, row("193", "95"))).otherwise(F.array(*ends, row("213", "94"), row("213", "97")))
    return rounds.endpoint_ranges(docs, docs.select("doc_id", F.explode(lists).alias("r")).select("doc_id", "r.*"))


@query("SELECT event_type AS batch_id, count(*) AS changes FROM events WHERE user_id % 4 = 0 AND event_id % 3 = 0 GROUP BY 1")
def green_escalations(spark, d):
    """Batches of which an audited document's list was changed."""
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("batch_id"), F.when(F.col("event_id") % 3 == 0, "changed").otherwise("kept").alias("action"))
    return reviews.escalations(e, e.where("doc_id % 4 = 0").select("doc_id").distinct(), "doc_id")


@query()
def placed_highlights(spark, d):
    """Segments to mark in a text: places of its references, overlaps merged, with how many meet there."""
    from ..operators.citations import locate
    from ..operators.text import segments

    spans = locate(cited(spark, d)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end")
    return segments(spans, "doc_id")
