"""Queries of ``operators.assembly``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as asm
from ..operators import compare
from .backbone import CITED_SQL, cited, lists, lists_sql, table, verdicts_sql
from .queries import BITS_SQL, PR_SQL, RATERS, ROUTE_SQL, _bits, _by_doc, _routed
from .registry import query

REVIEWS_SQL = "r AS (SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'RED' WHEN 'P' THEN 'YELLOW' ELSE 'GREEN' END AS bucket, o_custkey % 10 = 2 AS audit, CASE WHEN o_custkey % 3 = 0 OR o_custkey % 10 = 2 THEN 'finalized' WHEN o_custkey % 50 = 0 THEN 'deferred' ELSE 'pending' END AS status FROM orders)"


def _records(spark, d):
    c = F.col("o_custkey")
    bucket = F.when(F.col("o_orderstatus") == "F", "RED").when(F.col("o_orderstatus") == "P", "YELLOW").otherwise("GREEN")
    status = F.when((c % 3 == 0) | (c % 10 == 2), "finalized").when(c % 50 == 0, "deferred").otherwise("pending")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), bucket.alias("bucket"), (c % 10 == 2).alias("audit"), status.alias("status"), F.lit(False).alias("escalated"), "o_orderdate", "o_custkey")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, max_by(l_partkey, (l_linenumber, l_partkey)) AS prediction FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY 1),
j AS (SELECT l_orderkey AS doc_id, max_by(l_suppkey, (l_linenumber, l_suppkey)) AS verdict FROM lineitem WHERE l_suppkey % 4 <> 0 GROUP BY 1),
s AS (SELECT user_id AS doc_id, sum(value) AS seconds FROM events WHERE value >= 0 GROUP BY 1)
SELECT o_orderkey AS doc_id, o_orderstatus AS review, prediction, verdict, round(seconds, 4) AS seconds, o_custkey % 10 = 2 AS audit, o_custkey % 40 = 1 AS pilot FROM orders LEFT JOIN p ON p.doc_id = o_orderkey LEFT JOIN j ON j.doc_id = o_orderkey LEFT JOIN s ON s.doc_id = o_orderkey""")
def round_records(spark, d):
    o, li, e = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "events")
    doc = F.col("o_orderkey").alias("doc_id")
    pred = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("created"), F.col("l_returnflag").alias("generation"), F.when(F.col("l_linestatus") == "O", "success").otherwise("error").alias("status")).agg(F.max("l_partkey").alias("prediction"))
    judge = li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("created"), (F.col("l_suppkey") % 4 != 0).alias("valid")).agg(F.max("l_suppkey").alias("verdict"))
    flags = {"audit": o.where("o_custkey % 10 = 2").select(doc), "pilot": o.where("o_custkey % 40 = 1").select(doc)}
    out = asm.round_records(o.select(doc), o.select(doc, F.col("o_orderstatus").alias("review")), pred, judge, e.select(F.col("user_id").alias("doc_id"), F.col("value").alias("seconds")), flags, "N")
    return out.withColumn("seconds", F.round("seconds", 4))


SCOPED_SQL = f"WITH {REVIEWS_SQL}, s AS (SELECT doc_id, bucket, 'reviewed' AS scope, CASE WHEN status = 'finalized' THEN 'expert' END AS truth_source FROM r UNION ALL SELECT doc_id, bucket, 'batch', CASE WHEN status = 'finalized' THEN 'expert' WHEN bucket = 'GREEN' AND (SELECT coalesce(bool_and(status = 'finalized') FILTER (audit), true) FROM r) THEN 'consensus' END FROM r)"


@query(SCOPED_SQL + " SELECT scope, truth_source, bucket, count(*) AS docs FROM s GROUP BY 1, 2, 3")
def scoped_truth(spark, d):
    parts = [asm.scoped_truth(_records(spark, d), s).withColumn("scope", F.lit(s)) for s in ("reviewed", "batch")]
    return parts[0].unionByName(parts[1]).groupBy("scope", "truth_source", "bucket").agg(F.count("*").alias("docs"))


@query(f"WITH {REVIEWS_SQL}, a AS (SELECT *, doc_id % 40 = 1 AS changed FROM r WHERE audit OR bucket = 'YELLOW') SELECT sample, finalized, deferred, pending, changed, CASE WHEN changed > 0 THEN 'escalation_required' WHEN finalized = sample THEN 'passed' ELSE 'pending' END AS state FROM (SELECT count(*) AS sample, count_if(status = 'finalized') AS finalized, count_if(status = 'deferred') AS deferred, count_if(status = 'pending') AS pending, count_if(status = 'finalized' AND changed) AS changed FROM a)")
def green_audit(spark, d):
    return asm.green_audit(_records(spark, d).where("audit OR bucket = 'YELLOW'").withColumn("changed", F.col("doc_id") % 40 == 1))


@query(BITS_SQL + ", t AS (SELECT doc_id, truth, candidate, model, judge, unnest(['all', CASE WHEN o_orderdate < TIMESTAMP '1995-06-17' THEN 'before_lock' ELSE 'after_lock' END]) AS block FROM k JOIN orders ON o_orderkey = doc_id), u AS (" + " UNION ALL ".join(f"SELECT block, '{r}' AS rater, truth, {r} AS bit FROM t" for r in RATERS) + "), s AS (SELECT block, rater, cast(count_if(bit = 1 AND truth = 1) AS BIGINT) AS tp, cast(count_if(bit = 1 AND truth = 0) AS BIGINT) AS fp, cast(count_if(bit = 0 AND truth = 1) AS BIGINT) AS fn FROM u GROUP BY 1, 2) SELECT *, " + PR_SQL.format(e="1.0") + " FROM s")
def error_blocks(spark, d):
    decided = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("decided_at"))
    return asm.error_blocks(_bits(spark, d), RATERS, decided, "1995-06-17")


TABLE_SQL = lists_sql().replace("r AS (", "r0 AS (", 1).replace("i AS (SELECT *, 'no:' || law_no AS law FROM r)", "r AS (SELECT * FROM r0 WHERE NOT (law_no = '213' AND article = '4')), i AS (SELECT *, 'no:' || law_no AS law FROM r)")


@query(TABLE_SQL + ", " + ", ".join(f"""b_{m} AS (SELECT doc_id, law, article, bool_or(side = 'reference') AS r, bool_or(side = '{m}') AS c, bool_or(side = 'reference' AND redundant) AS rr, bool_or(side = '{m}' AND redundant) AS cr FROM c WHERE side IN ('reference', '{m}') GROUP BY ALL),
s_{m} AS (SELECT cast(sum(cast(r AND NOT rr AND c AS INT)) AS BIGINT) AS tp, cast(sum(cast(c AND NOT (r AND NOT rr) AND NOT cr AS INT)) AS BIGINT) AS fp, cast(sum(cast(r AND NOT rr AND NOT c AS INT)) AS BIGINT) AS fn, cast(sum(cast(cr AND NOT (r AND NOT rr) AS INT)) AS BIGINT) AS subsumed_rows FROM b_{m}),
w_{m} AS (SELECT count_if(NOT (law_no = '213' AND article = '4')) AS written_rows, count_if(law_no = '213' AND article = '4') AS policy_dropped, count(DISTINCT doc_id) AS documents, count(DISTINCT CASE WHEN NOT (law_no = '213' AND article = '4') THEN (doc_id, law_no, article) END) AS dist FROM r0 WHERE side = '{m}')""" for m in RATERS) + " " + " UNION ALL ".join(f"SELECT '{m}' AS source, documents, written_rows, policy_dropped, written_rows - dist AS duplicate_rows, subsumed_rows, tp + fp AS written_references, tp + fn AS truth_references, tp, fp, fn, {PR_SQL.format(e='1.0')} FROM s_{m}, w_{m}" for m in RATERS))
def reference_tables(spark, d):
    """A line for each source; documents are those in which it wrote anything."""
    rows = compare.identify(compare.align(lists(spark, d).repartition("doc_id")))
    return asm.reference_tables(rows, RATERS, (("213", "4"),))


@query("""WITH m AS (SELECT c_mktsegment AS candidate, avg(c_acctbal) / 10000 AS f1, avg(c_nationkey) / 25 AS docwise, max(c_acctbal) / 10000 AS recall, count(*) AS n, count_if(c_custkey % 30 = 0) AS truncated FROM customer GROUP BY 1)
SELECT candidate, array_to_string(list_filter([CASE WHEN truncated > 0 THEN 'truncation_zero' END, CASE WHEN f1 <= 0.45 THEN 'f1_above_base' END, CASE WHEN docwise < 0.48 THEN 'docwise_not_below_base' END, CASE WHEN recall < 0.99 - 0.005 THEN 'recall_drop_vs_base' END, CASE WHEN f1 <= 0.44 THEN 'f1_above_g0' END, CASE WHEN docwise <= 0.47 THEN 'docwise_above_g0' END], lambda x: x IS NOT NULL), ',') AS failed, truncated = 0 AND f1 > 0.45 AND docwise >= 0.48 AND recall >= 0.985 AND f1 > 0.44 AND docwise > 0.47 AS promote FROM m""")
def promotion_gates(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("candidate")).agg((F.avg("c_acctbal") / 10000).alias("augmented_f1"), (F.avg("c_nationkey") / 25).alias("augmented_docwise"), (F.max("c_acctbal") / 10000).alias("augmented_recall"), F.count("*").alias("coverage"), F.count_if(F.col("c_custkey") % 30 == 0).alias("truncated"))
    fixed = {"base_f1": 0.45, "base_docwise": 0.48, "base_recall": 0.99, "canonical_f1": -1.0, "canonical_recall": -1.0, "g0_f1": 0.44, "g0_docwise": 0.47, "ci_lower": 0.0, "runaway": 0}
    m = m.withColumns({**{k: F.lit(v) for k, v in fixed.items()}, "parsed": F.col("coverage"), "expected": F.col("coverage")})
    return asm.promotion_gates(m).select("candidate", F.array_join("failed", ",").alias("failed"), "promote")


@query(verdicts_sql() + ", x AS (SELECT o_orderpriority AS model, cast(sum(tp + fp) AS BIGINT) AS predicted, count_if(tp + fp = 0 AND fn > 0) AS empty_answers FROM d JOIN orders ON o_orderkey = doc_id GROUP BY 1) SELECT *, predicted <= 0 OR empty_answers >= 3 AS collapsed FROM x")
def collapse_gate(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("model"))
    return asm.collapse_gate(_by_doc(spark, d).join(o, "doc_id"), ("model",))


@query("SELECT o_orderpriority AS round, count(*) AS docs, count_if(o_orderstatus <> 'F') AS successes, count_if(o_orderstatus = 'F') AS errors, count_if(o_custkey % 9 = 0) AS truncations, count_if(o_orderstatus = 'F' AND o_custkey % 9 <> 0) AS parse_failures FROM orders GROUP BY 1")
def output_states(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("round"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"), (F.col("o_custkey") % 9 == 0).alias("truncated"))
    return asm.status_metrics(rows, ("round",))


@query(CITED_SQL + ", q AS (SELECT doc_id, law_no, article, source_text, min(pos) AS p FROM cited WHERE source_text <> '' GROUP BY ALL), l AS (SELECT doc_id, law_no, article, string_agg(source_text, '|' ORDER BY p) AS quotes FROM q GROUP BY 1, 2, 3), g AS (SELECT doc_id, law_no, article, min(pos) AS pos FROM cited GROUP BY 1, 2, 3) SELECT doc_id, law_no, article, pos, coalesce(quotes, '') AS quotes FROM g LEFT JOIN l USING (doc_id, law_no, article)")
def merged_gold(spark, d):
    out = asm.merged_gold(cited(spark, d).withColumn("law", F.col("law_no")))
    return out.select("doc_id", F.col("law").alias("law_no"), "article", "pos", F.array_join("quotes", "|").alias("quotes"))


@query("WITH c AS (SELECT o_orderpriority AS round, CASE o_custkey % 4 WHEN 0 THEN cast(o_custkey AS VARCHAR) WHEN 1 THEN '' ELSE 'd' || o_custkey END AS doc_id FROM orders), f AS (SELECT doc_id, min(round) AS first, count(*) AS n FROM c GROUP BY 1) SELECT problem, count(*) AS n FROM (SELECT CASE WHEN doc_id = '' THEN 'unusable' WHEN regexp_matches(doc_id, '^[0-9]+$') THEN 'numeric' WHEN doc_id IN (SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 8 = 2) OR (n > 1 AND round > first) THEN 'already_there' END AS problem FROM c JOIN f USING (doc_id)) WHERE problem IS NOT NULL GROUP BY 1")
def training_problems(spark, d):
    c = F.col("o_custkey")
    cleaned = table(spark, d, "orders").select(F.col("o_orderpriority").alias("round"), F.when(c % 4 == 0, c.cast("string")).when(c % 4 == 1, "").otherwise(F.concat(F.lit("d"), c)).alias("doc_id"))
    canonical = table(spark, d, "customer").where("c_custkey % 8 = 2").select(F.concat(F.lit("d"), "c_custkey").alias("doc_id"))
    return asm.training_problems(canonical, cleaned).groupBy("problem").agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('split:' || c_custkey)) AS n FROM customer WHERE c_custkey % 7 <> 0) SELECT c.c_custkey AS doc_id, CASE WHEN n <= 50 THEN 'test' WHEN n <= 80 THEN 'validation' ELSE 'train' END AS split FROM customer c LEFT JOIN h USING (c_custkey)")
def exact_split(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    return asm.exact_split(c, 50, 30, "split", F.col("doc_id") % 7 == 0)


@query("SELECT count_if(s > 1) AS in_two, count_if(s = 0) AS uncovered, count_if(NOT e) AS strangers FROM (SELECT id, sum(s) AS s, bool_or(e) AS e FROM (SELECT o_custkey AS id, 1 AS s, false AS e FROM orders UNION ALL SELECT c_custkey, 0, true FROM customer WHERE c_custkey % 9 <> 0) GROUP BY 1)")
def split_check(spark, d):
    return asm.split_check(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")), table(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("doc_id")))


@query("SELECT c_custkey AS doc_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def remainder_batch(spark, d):
    return asm.remainder(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment"), table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id")))


@query("WITH l AS (SELECT sha256(o_orderkey || chr(10) || o_orderstatus) AS h FROM orders), g AS (SELECT substr(h, 1, 6) AS b, h || ':' || count(*) AS h, count(*) AS n FROM l GROUP BY l.h), a AS (SELECT b, sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM g GROUP BY 1), c AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM a GROUP BY 1) SELECT cast(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, ',' ORDER BY b)) AS fingerprint FROM c")
def prediction_fingerprint(spark, d):
    return asm.set_fingerprint(table(spark, d, "orders"), "o_orderkey", F.col("o_orderstatus"))


@query(lists_sql() + ", n AS (SELECT o_orderkey AS doc_id, count(r.side) AS n FROM orders LEFT JOIN r ON r.doc_id = o_orderkey AND side = 'reference' GROUP BY 1) SELECT CASE WHEN n = 0 THEN 'zero' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS band, o_orderpriority AS annotator, count(*) AS docs FROM n JOIN orders ON o_orderkey = doc_id GROUP BY 1, 2")
def pool_strata(spark, d):
    n = lists(spark, d).where("side = 'reference'").groupBy("doc_id").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("annotator"))
    return o.join(n, "doc_id", "left").groupBy(asm.reference_band(F.coalesce("n", F.lit(0))).alias("band"), "annotator").agg(F.count("*").alias("docs"))


BUCKET_SQL = "CASE WHEN NOT ready OR NOT parsed OR truncated OR NOT safe THEN 'QUARANTINE' WHEN fp > 0 OR fn > 0 THEN 'RED' ELSE 'GREEN' END"
ALL_BUCKETS = ("GREEN", "RED", "QUARANTINE")


@query(verdicts_sql() + ROUTE_SQL + f", z AS (SELECT {BUCKET_SQL} AS a, CASE WHEN ready AND parsed AND safe AND NOT truncated AND fn = 0 THEN 'GREEN' ELSE {BUCKET_SQL} END AS b FROM x), e AS (SELECT unnest(['GREEN', 'RED', 'QUARANTINE']) AS k) SELECT p.k AS before, q.k AS after, count(z.a) AS n FROM e p CROSS JOIN e q LEFT JOIN z ON z.a = p.k AND z.b = q.k GROUP BY 1, 2")
def policy_reroute(spark, d):
    """A second routing that forgives extra references, against the first."""
    first = _routed(spark, d)
    again = first.withColumn("bucket", F.when((F.col("bucket") == "RED") & (F.col("fn") == 0), "GREEN").otherwise(F.col("bucket")))
    return asm.transitions_of(first, again, ALL_BUCKETS)


@query(verdicts_sql() + ROUTE_SQL + f", e AS (SELECT unnest(['GREEN', 'YELLOW', 'RED', 'QUARANTINE']) AS bucket), z AS (SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM x GROUP BY 1) SELECT bucket, coalesce(n, 0) AS docs FROM e LEFT JOIN z USING (bucket)")
def routing_distribution(spark, d):
    from ..operators.metrics import action_counts

    return action_counts(_routed(spark, d).select("bucket"), "bucket", ("GREEN", "YELLOW", "RED", "QUARANTINE")).withColumnRenamed("n", "docs")


@query("SELECT key, n, accepted FROM (SELECT user_id AS key, count(*) AS n, count(*) AS accepted FROM events GROUP BY 1)")
def versioned_writes(spark, d):
    """Writes that expect the version they find, each followed by one that is late and refused."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    good = e.select(F.col("user_id").alias("key"), seq.alias("k"))
    both = good.select("key", (2 * F.col("k")).alias("seq"), F.col("k").alias("expected")).union(good.select("key", 2 * F.col("k") + 1, F.col("k")))
    return asm.versioned(both).groupBy("key").agg((F.count("*") / 2).cast("long").alias("n"), F.count_if("accepted").alias("accepted"))


@query("SELECT tier IN ('expert_adjudicated', 'consensus') AS eligible, problem, count(*) AS n FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'expert_adjudicated' WHEN 'O' THEN 'consensus' ELSE 'unreviewed' END AS tier, o_custkey % 6 <> 0 AS training FROM orders) t, LATERAL (SELECT CASE WHEN tier <> 'unreviewed' AND NOT training THEN 'missing' WHEN tier = 'unreviewed' AND training THEN 'not_eligible' END AS problem) WHERE problem IS NOT NULL GROUP BY 1, 2")
def release_problems(spark, d):
    o = table(spark, d, "orders")
    tier = F.when(F.col("o_orderstatus") == "F", "expert_adjudicated").when(F.col("o_orderstatus") == "O", "consensus").otherwise("unreviewed")
    out = asm.release_problems(o.select(F.col("o_orderkey").alias("doc_id"), tier.alias("tier")), o.where("o_custkey % 6 <> 0").select(F.col("o_orderkey").alias("doc_id")))
    return out.groupBy((F.col("problem") == "missing").alias("eligible"), "problem").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT o_custkey AS k, count(*) AS n, min(o_orderstatus) AS st FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1) SELECT problem, count(*) AS n FROM (SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'several' WHEN c_custkey % 5 = 0 THEN 'text' WHEN st = 'P' THEN 'policy' END AS problem FROM customer LEFT JOIN p ON k = c_custkey) GROUP BY 1")
def sealed_predictions(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 5 == 0, "other").otherwise("same").alias("text_sha256"), F.lit("p").alias("policy"))
    pred = table(spark, d, "orders").where("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("doc_id"), F.lit("same").alias("text_sha256"), F.when(F.col("o_orderstatus") == "P", "q").otherwise("p").alias("policy"))
    return asm.sealed_predictions(docs, pred).groupBy("problem").agg(F.count("*").alias("n"))


@query(lists_sql() + " SELECT doc_id, law_no, string_agg(DISTINCT article, ',' ORDER BY article) AS articles, '[\"b1\",\"' || doc_id || '\"]' AS training_id FROM r WHERE side = 'reference' GROUP BY 1, 2")
def laws_and_articles(spark, d):
    out = asm.laws_and_articles(lists(spark, d).where("side = 'reference'"))
    return out.select("doc_id", "law_no", F.array_join("articles", ",").alias("articles"), asm.training_id(F.lit("b1"), F.col("doc_id")).alias("training_id"))


@query(CITED_SQL + """, d AS (SELECT DISTINCT doc_id FROM cited), k AS (SELECT doc_id, count_if(law_no = '193' AND article = '5') AS hits, count_if(law_no = '213' AND article = '12') AS gone, count(*) AS n, bool_or(law_no = '999' AND article = '1') AS x FROM cited GROUP BY 1)
SELECT doc_id, n - hits + cast(hits > 0 AS INT) - gone AS refs, array_to_string(list_filter([CASE WHEN hits = 0 THEN '0' END, CASE WHEN gone = 0 THEN '1' END, '2'], lambda y: y IS NOT NULL), ',') AS stale FROM k""")
def ordered_corrections(spark, d):
    """In every list: 193/5 becomes 999/1, 213/12 goes, and a range is filled whose ends no list holds."""
    rows = cited(spark, d).select("doc_id", "pos", "law_no", "law_name", "article", "source_text")
    none = F.lit(None)
    fix = lambda seq, kind, law, article, new=(None, None, None), ends=(None, None): F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(law).alias("law_no"), F.lit(article).alias("article"), *[(none if v is None else F.lit(v)).cast("string").alias(c) for v, c in zip(new, ("new_law_no", "new_law_name", "new_article"), strict=True)], *[(none if v is None else F.lit(v)).cast("int").alias(c) for v, c in zip(ends, ("low", "high"), strict=True)])
    todo = F.array(fix(0, "replace", "193", "5", ("999", "N", "1")), fix(1, "remove", "213", "12"), fix(2, "range", "777", "", ends=(1, 4)))
    fixes = rows.select("doc_id").distinct().select("doc_id", F.explode(todo).alias("f")).select("doc_id", "f.*")
    return asm.apply_in_order(rows, fixes).select("doc_id", F.size("refs").cast("long").alias("refs"), F.array_join("stale", ",").alias("stale"))
