"""Queries of ``operators.evaluation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import metrics
from .backbone import CITED_SQL, cited, lists, lists_sql, table
from .queries import METHODS_SQL, RATERS, _by_doc
from .registry import query

UNIVERSE_SQL = """WITH g AS (SELECT DISTINCT o_custkey AS id FROM orders), p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0)
SELECT id AS doc_id, CASE WHEN id NOT IN (SELECT id FROM g) THEN 'no_gold' WHEN id NOT IN (SELECT id FROM p) THEN 'no_prediction' ELSE 'evaluated' END AS state FROM w"""


@query(UNIVERSE_SQL)
def evaluation_universe(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    gold = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"))
    return ev.universe(gold, c.where("doc_id % 3 <> 0"), c.where("doc_id % 5 <> 0"))


@query(CITED_SQL + ", s AS (SELECT *, CASE WHEN pos % 2 = 0 THEN 'reference' ELSE 'candidate' END AS side, CASE WHEN law_no <> '' THEN law_no WHEN law_name = 'Gelir Vergisi Kanunu' THEN '193' WHEN law_name = 'Vergi Usul Kanunu' THEN '213' WHEN law_name = 'Harçlar Kanunu' THEN '492' ELSE '' END AS n FROM cited) SELECT side, count_if((n = '213' AND article = '12') OR (n = '193' AND article = '5')) AS ignored FROM s GROUP BY 1")
def ignored_articles(spark, d):
    rows = cited(spark, d).withColumn("side", F.when(F.col("pos") % 2 == 0, "reference").otherwise("candidate"))
    return ev.drop_ignored(rows, (("213", "12"), ("193", "5")))[1]


STATUS_SQL = ", s AS (SELECT *, ['approved', 'draft', ''][pos % 3 + 1] AS status, CASE WHEN pos % 4 < 2 THEN 'existing' ELSE 'new' END AS origin FROM (SELECT doc_id, pos, law_no, law_name, CASE WHEN pos % 2 = 0 THEN article ELSE '5' END AS article, source_text FROM cited UNION ALL SELECT doc_id, pos + 6, law_no, law_name, CASE WHEN pos % 3 = 0 THEN '' ELSE article END, source_text FROM cited))"


def _status_rows(spark, d):
    rows = cited(spark, d).drop("text")
    p, a = F.col("pos"), F.col("article")
    twice = rows.withColumn("article", F.when(p % 2 == 0, a).otherwise("5")).unionByName(rows.withColumn("article", F.when(p % 3 == 0, "").otherwise(a)).withColumn("pos", p + 6))
    return twice.withColumns({"status": F.element_at(F.array(*map(F.lit, ("approved", "draft", ""))), (p % 3 + 1).cast("int")), "origin": F.when(p % 4 < 2, "existing").otherwise("new")})


SCORE_SQL = "CASE status WHEN 'approved' THEN 2 WHEN '' THEN 0 ELSE 1 END"


@query(CITED_SQL + STATUS_SQL + f""", m AS (SELECT *, article <> '' AND (law_no <> '' OR law_name <> '') AS core, ({SCORE_SQL}, cast(source_text <> '' AS INT), -pos) AS r FROM s),
w AS (SELECT *, max(r) OVER x AS best, min(pos) OVER x AS first FROM m WINDOW x AS (PARTITION BY doc_id, law_no, law_name, article))
SELECT doc_id, CASE WHEN core THEN first ELSE pos END AS pos, law_no, law_name, article, status FROM w WHERE NOT core OR r = best""")
def core_set_view(spark, d):
    return ev.core_view(_status_rows(spark, d)).select("doc_id", "pos", "law_no", "law_name", "article", "status")


@query(CITED_SQL + STATUS_SQL + f""", m AS (SELECT *, article <> '' AND (law_no <> '' OR law_name <> '') AS core, ({SCORE_SQL}, cast(source_text <> '' AS INT), -pos) AS r FROM s),
w AS (SELECT *, max(r) OVER (PARTITION BY doc_id, law_no, law_name, article) AS best FROM m), c AS (SELECT doc_id, count(*) AS b, count_if(NOT core OR r = best) AS a FROM w GROUP BY 1)
SELECT count(*) AS docs, cast(sum(b) AS BIGINT) AS rows_before, cast(sum(a) AS BIGINT) AS rows_after, cast(sum(b - a) AS BIGINT) AS removed, count_if(a <> b) AS changed_docs FROM c""")
def view_summary(spark, d):
    rows = _status_rows(spark, d)
    return ev.view_summary(rows, ev.core_view(rows))


FATE_SQL = STATUS_SQL + f""", f AS (SELECT *, CASE WHEN law_no <> '' THEN 'no:' || law_no WHEN lower(law_name) NOT IN ('', 'kanun', 'kanunu') THEN 'name:' || regexp_replace(upper(law_name), '[^A-Z0-9]+', '', 'g') END AS fam,
 ({SCORE_SQL}, cast(origin = 'existing' AS INT), CASE WHEN law_no <> '' AND law_name <> '' THEN 3 WHEN law_no <> '' THEN 2 WHEN law_name <> '' THEN 1 ELSE 0 END, cast(article <> '' AS INT), cast(source_text <> '' AS INT), -pos) AS r FROM s),
g AS (SELECT *, bool_or(article <> '') OVER x AS specific, max(CASE WHEN article = '' THEN r END) OVER x AS general FROM f WINDOW x AS (PARTITION BY doc_id, fam)),
h AS (SELECT *, CASE WHEN fam IS NOT NULL AND article = '' AND specific THEN 'generic' WHEN fam IS NOT NULL AND article = '' AND r < general THEN 'generic_duplicate' END AS fate0 FROM g),
z AS (SELECT *, coalesce(fate0, CASE WHEN r < max(r) OVER (PARTITION BY doc_id, law_no, law_name, article, fate0 IS NULL) THEN 'duplicate' END, 'kept') AS fate FROM h)"""


@query(CITED_SQL + FATE_SQL + " SELECT doc_id, fate, count(*) AS n, cast(sum(pos) AS BIGINT) AS places FROM z GROUP BY 1, 2")
def legacy_compaction(spark, d):
    return ev.legacy_compaction(_status_rows(spark, d)).groupBy("doc_id", "fate").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))


@query(CITED_SQL + FATE_SQL + " SELECT count_if(fate = 'generic') AS dropped_generic_due_to_specific, count_if(fate = 'generic_duplicate') AS collapsed_generic_only_duplicates, count_if(fate = 'duplicate') AS collapsed_same_reference_duplicates, count_if(fate <> 'kept' AND origin = 'existing') AS removed_existing_rows, count_if(fate = 'kept' AND origin = 'new') AS added_new_rows FROM z")
def compaction_summary(spark, d):
    return ev.compaction_summary(ev.legacy_compaction(_status_rows(spark, d)))


@query(CITED_SQL + """, k AS (SELECT law_no <> '' AND lower(law_name) NOT IN ('', 'kanun', 'kanunu') AS given, CASE law_no WHEN '193' THEN 'Gelir Vergisi Kanunu' WHEN '213' THEN 'Vergi Usul Kanunu' WHEN '492' THEN 'Harçlar Kanunu' WHEN '5520' THEN 'Kurumlar Vergisi Kanunu' END AS official, CASE law_name WHEN 'Gelir Vergisi Kanunu' THEN '193' WHEN 'Vergi Usul Kanunu' THEN '213' WHEN 'Harçlar Kanunu' THEN '492' END AS number, law_no, law_name FROM cited)
SELECT name_fits, number_fits, count(*) AS n FROM (SELECT CASE WHEN given THEN law_name = official END AS name_fits, CASE WHEN given THEN law_no = number END AS number_fits FROM k) GROUP BY 1, 2""")
def name_consistency(spark, d):
    a, b = ev.name_consistency(F.col("law_no"), F.col("law_name"))
    return cited(spark, d).groupBy(a.alias("name_fits"), b.alias("number_fits")).agg(F.count("*").alias("n"))


EVALUATE_SQL = lists_sql() + ", docs AS (SELECT o_orderkey AS doc_id FROM orders), " + ", ".join(f"""x_{m} AS (SELECT doc_id, cast(sum(r AND NOT rr AND c) AS BIGINT) AS tp, cast(sum(c AND NOT (r AND NOT rr) AND NOT cr) AS BIGINT) AS fp, cast(sum(r AND NOT rr AND NOT c) AS BIGINT) AS fn FROM (SELECT doc_id, bool_or(side = 'reference') AS r, bool_or(side = '{m}') AS c, bool_or(side = 'reference' AND redundant) AS rr, bool_or(side = '{m}' AND redundant) AS cr FROM c WHERE side IN ('reference', '{m}') GROUP BY doc_id, law, article) GROUP BY 1)""" for m in RATERS) + ", e AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM docs LEFT JOIN x_{m} USING (doc_id)" for m in RATERS) + """),
t AS (SELECT method, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn, count(*) AS docs, count_if(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END >= 0.8) AS passed FROM e GROUP BY 1),
v AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, passed / docs AS accuracy FROM t)"""


def _results(spark, d):
    rows = lists(spark, d)
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("evaluated").alias("state"))
    return ev.evaluate(rows, RATERS, docs, 0.8)


@query(EVALUATE_SQL + " SELECT method, tp, fp, fn, docs, passed, precision, recall, f1, accuracy, cast(0.8 AS DOUBLE) AS threshold, row_number() OVER (ORDER BY f1 DESC, method) AS rank FROM v")
def evaluate_methods(spark, d):
    """The whole evaluator for each method's lists, best first."""
    return ev.ranked(_results(spark, d), (), (F.desc("f1"), F.col("method")))


@query(EVALUATE_SQL + " SELECT method, 'core' AS metric, printf('%.6f', precision) AS precision, printf('%.6f', recall) AS recall, printf('%.6f', f1) AS f1, cast(tp AS VARCHAR) AS tp, cast(fp AS VARCHAR) AS fp, cast(fn AS VARCHAR) AS fn, '' AS accuracy, '' AS threshold, '' AS passed, '' AS failed, docs FROM v UNION ALL SELECT method, 'docwise', '', '', '', '', '', '', printf('%.6f', accuracy), '0.800000', cast(passed AS VARCHAR), cast(docs - passed AS VARCHAR), docs FROM v")
def evaluation_report(spark, d):
    return ev.report(_results(spark, d))


@query("SELECT o_orderpriority, CASE WHEN n <> 1 THEN 'not_one' WHEN NOT fit THEN 'not_eligible' WHEN mine < best THEN 'outranked' END AS problem FROM (SELECT o_orderpriority, count_if(o_orderkey % 97 = 1) AS n, bool_and(CASE WHEN o_orderkey % 97 = 1 THEN o_orderstatus <> 'P' END) AS fit, max(CASE WHEN o_orderkey % 97 = 1 THEN o_totalprice END) AS mine, max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS best FROM orders GROUP BY 1) WHERE n <> 1 OR NOT fit OR mine < best")
def selection_problems(spark, d):
    o = table(spark, d, "orders")
    return ev.selection_problems(o, F.col("o_orderstatus") != "P", (F.col("o_totalprice"),), "o_orderpriority", F.col("o_orderkey") % 97 == 1)


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_nationkey DESC, length(c_name), c_custkey) AS rank FROM customer")
def prompt_ranking(spark, d):
    """By score, recall, the shorter prompt."""
    c = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", "c_nationkey", "c_name")
    return ev.ranked(c, ("c_mktsegment",), (F.desc("c_acctbal"), F.desc("c_nationkey"), F.length("c_name"), F.col("c_custkey"))).select("c_mktsegment", "c_custkey", "rank")


@query("WITH a AS (SELECT c_custkey AS k, c_acctbal AS o, c_acctbal + c_custkey % 7 * 100 AS n FROM customer WHERE c_custkey % 3 <> 0) SELECT k AS checkpoint, o AS old, n AS new, n - o AS change, k = (SELECT k FROM a ORDER BY o DESC, k LIMIT 1) AS best_before, k = (SELECT k FROM a ORDER BY n DESC, k LIMIT 1) AS best_now FROM a")
def rescored_checkpoints(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("checkpoint"), F.col("c_acctbal").alias("score"))
    new = c.where("checkpoint % 3 <> 0").withColumn("score", F.col("score") + F.col("checkpoint") % 7 * 100)
    return ev.rescored(c, new, "checkpoint", "score")


@query("SELECT max(n_chars) AS longest, (SELECT min(c) FROM (VALUES (1024), (8192), (65536), (1048576)) t(c) WHERE c >= (SELECT max(n_chars) FROM documents)) AS chosen FROM documents")
def sequence_length(spark, d):
    return ev.sequence_length(table(spark, d, "documents"), "n_chars", (1024, 8192, 65536, 1048576))


@query(METHODS_SQL + "SELECT p.method, p.f1 - b.f1 AS delta, p.f1 > b.f1 AS improves FROM p, p b WHERE b.method = 'candidate' AND p.method <> 'candidate'")
def improves_base(spark, d):
    """Whether a method's test score is above the base method's: the gate of a release."""
    results = _results(spark, d).select("method", "f1")
    base = results.where("method = 'candidate'").select(F.col("f1").alias("base"))
    return results.where("method <> 'candidate'").join(F.broadcast(base), F.lit(True)).select("method", (F.col("f1") - F.col("base")).alias("delta"), (F.col("f1") > F.col("base")).alias("improves"))


@query()
def table_interval(spark, d):
    """The documents' bootstrap interval of F1 of one list: 10,000 resamples."""
    return metrics.interval_of(metrics.bootstrap_scores(_by_doc(spark, d)))


@query()
def unpaired_interval(spark, d):
    """The change of F1 between two batches of different documents, each resampled on its own."""
    docs = _by_doc(spark, d)
    return metrics.unpaired_delta(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))
