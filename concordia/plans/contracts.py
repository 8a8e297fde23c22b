"""Queries of ``operators.contracts``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare
from ..operators import contracts as con
from .backbone import lists, lists_sql, table
from .registry import query


@query("""WITH d AS (SELECT c_custkey AS id, count(*) AS n, bool_or(c_custkey % 31 = 0) AS empty FROM (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 17 = 0) GROUP BY 1),
s AS (SELECT c_custkey AS id, count(*) AS s, bool_or(c_custkey % 3 = 0) AS train FROM (SELECT c_custkey FROM customer WHERE c_custkey % 19 <> 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 23 = 0) GROUP BY 1),
e AS (SELECT unnest(range(1, 121)) AS id), x AS (SELECT coalesce(e.id, d.id, s.id) AS doc_id, e.id AS due, n, empty, s, train FROM e FULL JOIN d ON d.id = e.id FULL JOIN s ON s.id = coalesce(e.id, d.id))
SELECT doc_id, problem FROM (SELECT doc_id, CASE WHEN due IS NULL THEN 'beyond_range' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN empty THEN 'no_text' WHEN s IS NULL THEN 'no_split' WHEN s > 1 THEN 'two_splits' WHEN doc_id IN (2, 3) AND NOT train THEN 'exemplar_held_out' END AS problem FROM x) WHERE problem IS NOT NULL""")
def corpus_problems(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"))
    docs = c.where("doc_id % 13 <> 0").union(c.where("doc_id % 17 = 0")).withColumn("text", F.when(F.col("doc_id") % 31 != 0, "t"))
    splits = c.where("doc_id % 19 <> 0").union(c.where("doc_id % 23 = 0")).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "train").otherwise("test"))
    return con.corpus_problems(docs, splits, 120, (2, 3))


@query("""WITH l AS (SELECT o_custkey AS round, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey, ['prepared', 'predicted', 'judged', 'x'][o_orderkey % 4 + 1] AS stage FROM orders),
p AS (SELECT *, CASE stage WHEN 'prepared' THEN 1 WHEN 'predicted' THEN 2 WHEN 'judged' THEN 3 ELSE 0 END AS place FROM l), q AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY round ORDER BY seq), 0) AS before FROM p)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN place = 0 THEN 'unknown' WHEN o_orderkey % 7 = 0 THEN 'no_artifact' WHEN place <> before + 1 THEN 'out_of_turn' END AS problem FROM q) WHERE problem IS NOT NULL GROUP BY 1""")
def stage_problems(spark, d):
    k = F.col("o_orderkey")
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("round"), k.alias("seq"), F.element_at(F.array(*map(F.lit, ("prepared", "predicted", "judged", "x"))), (k % 4 + 1).cast("int")).alias("stage"), F.when(k % 7 != 0, "sha").alias("artifact"))
    return con.stage_problems(log).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT batch, generation, 'M' || lpad(cast(k - 1 AS VARCHAR), 2, '0') AS expected, count(*) AS n FROM (SELECT 'R' || lpad(cast(c_nationkey AS VARCHAR), 2, '0') AS batch, c_nationkey AS k, 'M' || lpad(cast(c_custkey % 25 AS VARCHAR), 2, '0') AS generation FROM customer WHERE c_nationkey > 0) WHERE generation <> 'M' || lpad(cast(k - 1 AS VARCHAR), 2, '0') GROUP BY 1, 2, 3")
def generation_problems(spark, d):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    c = table(spark, d, "customer").where("c_nationkey > 0").select(F.concat(F.lit("R"), two(F.col("c_nationkey"))).alias("batch"), F.concat(F.lit("M"), two(F.col("c_custkey") % 25)).alias("generation"))
    return con.generation_problems(c.union(spark.sql("SELECT 'pilot', 'M00'"))).groupBy("batch", "generation", "expected").agg(F.count("*").alias("n"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'id' WHEN o_orderstatus = 'P' THEN 'status' WHEN o_orderstatus = 'F' AND o_custkey % 5 = 0 THEN 'no_list' WHEN o_orderstatus = 'O' AND o_custkey % 5 <> 0 AND o_custkey % 4 > 0 THEN 'list_of_error' END AS problem FROM orders) WHERE problem IS NOT NULL GROUP BY 1")
def prediction_problems(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "error").otherwise("odd")
    rows = table(spark, d, "orders").select(F.when(k % 9 == 0, F.concat(k, F.lit("x"))).otherwise(k.cast("string")).alias("doc_id"), status.alias("status"), F.when(c % 5 != 0, c % 4).alias("n_references"))
    return con.prediction_problems(rows).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT fields, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN o_custkey % 5 = 0 THEN 'tp' END, CASE WHEN o_custkey % 7 - 1 < 0 THEN 'fp' END) AS fields FROM orders) WHERE fields <> '' GROUP BY 1")
def count_problems(spark, d):
    c = F.col("o_custkey")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(c % 5 != 0, c).alias("tp"), (c % 7 - 1).alias("fp"), F.lit(0).alias("fn"))
    return con.count_problems(rows).groupBy("fields").agg(F.count("*").alias("n"))


@query("SELECT how, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'only_a' WHEN c_custkey % 13 = 0 THEN 'changed' END AS how FROM customer UNION ALL SELECT 'only_b') WHERE how IS NOT NULL GROUP BY 1")
def state_difference(spark, d):
    """A table and its snapshot, of which some rows were lost, some changed, and one is new."""
    a = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    b = a.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = a.limit(1).select(F.lit(-1).cast("long").alias("c_custkey"), "c_name", "c_acctbal")
    return con.state_difference(a, b.union(new), ("c_custkey",)).groupBy("how").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) <= 3 AS kept FROM customer")
def newest_snapshots(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.struct("c_acctbal", "c_custkey").alias("time"))
    return con.newest(c, "c_nationkey", "time", 3).select("c_custkey", "kept")


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'historical_' || CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END WHEN c_custkey % 5 = 0 THEN 'duplicate_cluster' WHEN c_custkey % 7 = 0 THEN 'reference_validation_failed' WHEN c_custkey % 2 = 0 THEN 'incomplete_annotation' END AS category FROM customer) GROUP BY 1")
def classified_pool(spark, d):
    i = F.col("c_custkey")
    docs = table(spark, d, "customer").select(i.alias("doc_id"), F.sha2(i.cast("string"), 256).alias("text_sha256"), F.md5(i.cast("string")).alias("raw_hash"), F.when(i % 2 == 1, True).alias("completed"))
    splits = docs.where("doc_id % 3 = 0").select("text_sha256", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))
    out = con.classified(docs, splits, docs.where("doc_id % 5 = 0").select("raw_hash"), docs.where("doc_id % 7 = 0").select("raw_hash", F.lit("reference_validation_failed").alias("reason")))
    return out.groupBy("category").agg(F.count("*").alias("n"))


PLAN_SQL = "CASE WHEN o_custkey % 5 = 0 THEN 'judge' WHEN o_custkey % 3 = 0 THEN '{other}' WHEN o_custkey % 2 = 0 THEN 'reuse' ELSE 'judge' END"


@query(f"SELECT locked, plan, count(*) AS n FROM (SELECT false AS locked, {PLAN_SQL.format(other='judge')} AS plan FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT true, {PLAN_SQL.format(other='refuse')} FROM orders WHERE o_orderstatus <> 'O') GROUP BY 1, 2")
def judge_plans(spark, d):
    """What is reused, judged again, or refused, before and after the judge is locked."""
    o = table(spark, d, "orders").withColumn("bucket", F.when(F.col("o_orderstatus") == "F", "RED").when(F.col("o_orderstatus") == "P", "YELLOW").otherwise("GREEN"))
    docs = con.judge_required(o).select(F.col("o_orderkey").alias("doc_id"), F.lit("p").alias("prediction_sha256"), "o_custkey")
    results = docs.where("o_custkey % 5 <> 0").select("doc_id", F.when(F.col("o_custkey") % 3 == 0, "old").otherwise("now").alias("instrument"), "prediction_sha256", (F.col("o_custkey") % 2 == 0).alias("valid"))
    parts = [con.judge_plan(docs.drop("o_custkey"), results, "now", locked).withColumn("locked", F.lit(locked)) for locked in (False, True)]
    return parts[0].union(parts[1]).groupBy("locked", "plan").agg(F.count("*").alias("n"))


@query("SELECT verdict, attempts, error, count(*) AS n FROM (SELECT ['A', 'TIE', NULL, NULL][doc_id % 4 + 1] AS verdict, [1, 1, 3, 3][doc_id % 4 + 1] AS attempts, [NULL, NULL, 'verdict MAYBE', 'ValueError'][doc_id % 4 + 1] AS error FROM documents) GROUP BY 1, 2, 3")
def judged_documents(spark, d):
    """A judge that answers, answers in small letters, answers out of contract, or fails, by the document."""

    def judge(row):
        if row["doc_id"] % 4 == 3:
            raise ValueError(row["doc_id"])
        return ("A", "tie", "maybe")[row["doc_id"] % 4]

    return con.judged(table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id")), judge).groupBy("verdict", "attempts", "error").agg(F.count("*").alias("n"))


@query("SELECT mapping, candidate_a, count(*) AS n FROM (SELECT CASE WHEN b THEN 'A=human,B=model' ELSE 'A=model,B=human' END AS mapping, CASE WHEN b THEN 'human' ELSE 'model' END AS candidate_a FROM (SELECT instr('02468ace', right(sha256('blind:' || doc_id), 1)) > 0 AS b FROM documents)) GROUP BY 1, 2")
def blind_candidates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("human").alias("human"), F.lit("model").alias("model"))
    return con.blind(rows, "blind").groupBy("mapping", "candidate_a").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment AS rule, count(DISTINCT c_nationkey) AS documents, count(*) AS corrections, count_if(c_custkey % 4 IN (0, 3)) AS range, count_if(c_custkey % 4 = 1) AS replace, count_if(c_custkey % 4 = 2) AS remove FROM customer GROUP BY 1")
def correction_counts(spark, d):
    k = F.col("c_custkey") % 4
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("rule"), F.col("c_nationkey").alias("doc_id"), F.when(k == 1, "replace").when(k == 2, "remove").when(k == 3, "range").alias("kind"))
    return con.correction_counts(rows)


@query("SELECT c_name AS variant, c_acctbal AS f1 FROM customer WHERE c_nationkey = 7 AND c_custkey % 2 = 0 ORDER BY c_acctbal DESC, c_custkey % 10 DESC, length(c_name), c_name LIMIT 1")
def stage_two_winner(spark, d):
    c = table(spark, d, "customer")
    scores = c.select(F.col("c_name").alias("variant"), F.col("c_nationkey").alias("update"), F.col("c_acctbal").alias("f1"), (F.col("c_custkey") % 10).alias("recall"), F.length("c_name").alias("prompt_length"))
    return con.stage_two_winner(scores, 7, c.select(F.col("c_name").alias("variant"), (F.col("c_custkey") % 2 == 0).alias("passed"))).select("variant", "f1")


@query("SELECT c_mktsegment AS view, count(*) AS updates, max(c_custkey) AS last_update, max_by(c_custkey, (c_acctbal, c_nationkey, -c_custkey)) AS best_update, max(c_acctbal) AS best_f1 FROM customer GROUP BY 1")
def view_curves(spark, d):
    return con.view_curves(table(spark, d, "customer").select(F.col("c_mktsegment").alias("view"), F.col("c_custkey").alias("update"), F.col("c_acctbal").alias("f1"), F.col("c_nationkey").alias("recall")))


@query(lists_sql() + """, p AS (SELECT doc_id, law, article, coalesce(max(copies) FILTER (side = 'candidate'), 0) > 0 AS a, coalesce(max(copies) FILTER (side = 'model'), 0) > 0 AS b, bool_or(redundant) AS subsumed FROM c WHERE side IN ('candidate', 'model') GROUP BY ALL)
SELECT shown, count(*) AS n FROM (SELECT CASE WHEN NOT (a AND b) AND subsumed THEN 'excused' WHEN a AND b THEN 'same' WHEN a THEN 'only_a' ELSE 'only_b' END AS shown FROM p) GROUP BY 1""")
def display_statuses(spark, d):
    rows = compare.difference(compare.align(lists(spark, d).repartition("doc_id")), "candidate", "model")
    a, b, sub = F.col("copies_a") > 0, F.col("copies_b") > 0, F.col("subsumed")
    status = F.when(sub & ~(a & b), "same").otherwise(F.col("status"))  # a covered law row is no difference
    return rows.groupBy(con.display_status(status, a, b, sub).alias("shown")).agg(F.count("*").alias("n"))
