"""Queries of ``operators.windows``, of plain table scans, and of scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import windows as win
from ..sources import tables
from .backbone import CITED_SQL, cited, table
from .registry import query

WIN_SQL = CITED_SQL + """, d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda w: w <> '') AS w FROM cited), n AS (SELECT doc_id, w, len(w) AS n FROM d),
o AS (SELECT doc_id, w, n, unnest(range(0, cast(greatest(0, ceil((n - 64) / 48.0)) AS INT) + 1)) AS ordinal FROM n WHERE n > 0),
b AS (SELECT doc_id, ordinal, ordinal * 48 AS start, least(ordinal * 48 + 64, n) AS e, n <= 64 AS native, array_to_string(w[ordinal * 48 + 1 : least(ordinal * 48 + 64, n)], ' ') AS body FROM o),
q AS (SELECT doc_id, pos, source_text AS q FROM cited WHERE doc_id % 5 <> 0),
s AS (SELECT b.doc_id, ordinal, native, body, list_sort(list(pos) FILTER (q <> '' AND contains(body, q))) AS seen, count(pos) AS listed FROM b LEFT JOIN q USING (doc_id) GROUP BY 1, 2, 3, 4),
v AS (SELECT doc_id, ordinal, native, body, coalesce(seen, []) AS seen, listed FROM s)"""


def _view(spark, d):
    rows = cited(spark, d)
    refs = rows.where("doc_id % 5 <> 0").select("doc_id", "pos", F.array("source_text").alias("quotes"))
    return refs, win.seen_by(win.windowed(rows.groupBy("doc_id").agg(F.first("text").alias("text")), 64, 16), refs)


@query(WIN_SQL + " SELECT doc_id, cast(ordinal AS INT) AS ordinal, native, sha256(body) AS body, array_to_string(seen, ',') AS seen FROM v")
def window_view(spark, d):
    return _view(spark, d)[1].select("doc_id", "ordinal", "native", F.sha2("body", 256).alias("body"), F.array_join(F.transform("seen", lambda x: x.cast("string")), ",").alias("seen"))


@query(WIN_SQL + " SELECT doc_id, why, count(*) AS n FROM (SELECT doc_id, CASE WHEN len(seen) > 0 THEN 'positive' WHEN native THEN 'native' WHEN listed = 0 AND cast('0x' || substr(sha256('neg:' || doc_id || ':' || ordinal), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.25 THEN 'negative' END AS why FROM v) WHERE why IS NOT NULL GROUP BY 1, 2")
def training_windows(spark, d):
    return win.kept(_view(spark, d)[1], 0.25, "neg").groupBy("doc_id", "why").agg(F.count("*").alias("n"))


@query(WIN_SQL + " SELECT doc_id, pos FROM q WHERE (doc_id, pos) NOT IN (SELECT doc_id, unnest(seen) FROM v)")
def unseen_references(spark, d):
    return win.unseen(*_view(spark, d))


@query(CITED_SQL + " SELECT doc_id, min(CASE WHEN source_text <> '' AND contains(text, source_text) THEN instr(text, source_text) - 1 END) AS first FROM cited GROUP BY 1")
def first_quotes(spark, d):
    rows = cited(spark, d).groupBy("doc_id").agg(F.first("text").alias("text"), F.collect_list("source_text").alias("q"))
    return rows.select("doc_id", win.first_quote(F.col("text"), F.col("q")).alias("first"))


@query("WITH s AS (SELECT doc_id, n_chars % 40 AS a, n_chars % 40 + 9 AS b FROM documents) SELECT doc_id, a // 5 AS first, least((b - 1) // 5, 9) AS last, greatest(a // 5 - 2, 0) AS start, least(least((b - 1) // 5, 9) + 1 + 2, 10) AS \"end\" FROM s")
def token_ranges(spark, d):
    """Ten tokens of five characters each."""
    offsets = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 5).alias("start"), (i * 5 + 5).alias("end")))
    a = F.col("n_chars") % 40
    rows = table(spark, d, "documents").select("doc_id", win.token_range(offsets, a, a + 9).alias("r"))
    wide = win.expanded(F.col("r.first"), F.col("r.last") + 1, 2, F.lit(10))
    return rows.select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"), wide["start"].cast("long").alias("start"), wide["end"].cast("long").alias("end"))


@query("WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, min(l_suppkey % 5) AS r, bool_or(l_partkey % 13 = 0) AS bad FROM lineitem GROUP BY 1, 2), m AS (SELECT doc_id, r, min(ordinal) AS p FROM w GROUP BY 1, 2), f AS (SELECT doc_id, bool_or(bad) AS failed FROM w GROUP BY 1) SELECT doc_id, failed, CASE WHEN NOT failed THEN string_agg('r' || r, ',' ORDER BY p) END AS refs FROM m JOIN f USING (doc_id) GROUP BY 1, 2")
def joined_windows(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min(F.col("l_suppkey") % 5).alias("r"), F.bool_or(F.col("l_partkey") % 13 == 0).alias("bad"))
    out = win.joined(li.select("doc_id", "ordinal", F.when(F.col("bad"), "error").otherwise("success").alias("status"), F.array(F.concat(F.lit("r"), "r")).alias("refs")))
    return out.select("doc_id", "failed", F.array_join("refs", ",").alias("refs"))


@query(CITED_SQL + " SELECT how, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'located' WHEN source_text <> '' AND contains(text, source_text) THEN 'verbatim' ELSE 'dropped' END AS how FROM cited) GROUP BY 1")
def raw_arm(spark, d):
    rows = cited(spark, d).withColumn("spans", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return win.training_arms(rows, F.col("text")).groupBy("how").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, cast(ceil(count(*) / 8) AS BIGINT) * 3 AS updates FROM orders GROUP BY 1")
def optimizer_updates(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(win.updates(F.count("*"), 8, 3).alias("updates"))


# --- scans -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def listed_documents(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return tables.listed(o, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_orderkey").select("o_orderkey", "o_custkey", "place")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def point_lookups(spark, d):
    return tables.lookup(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


@query("SELECT DISTINCT l_returnflag AS generation, l_linestatus AS status FROM lineitem")
def prediction_generations(spark, d):
    return tables.distinct_values(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("generation"), F.col("l_linestatus").alias("status")))


@query("SELECT event_type, count(value) AS measured, round(sum(value), 4) AS total FROM events GROUP BY 1")
def counter_scan(spark, d):
    """Counters that a table keeps as JSON."""
    e = table(spark, d, "events").select("event_type", F.to_json(F.struct(F.col("value").alias("seconds"), F.lit("x").alias("other"))).alias("counters"))
    rows = tables.counters(e, "counters", ("seconds",))
    return rows.groupBy("event_type").agg(F.count("seconds").alias("measured"), F.round(F.sum("seconds"), 4).alias("total"))


@query("SELECT CASE WHEN o_orderkey % 4 = 3 THEN 'unusable' ELSE 'list' END AS state, count(*) AS n, cast(sum(CASE WHEN o_orderkey % 4 < 3 THEN 2 END) AS BIGINT) AS refs, max(CASE WHEN o_orderkey % 4 < 3 THEN cast(o_custkey AS VARCHAR) END) AS number FROM orders GROUP BY 1")
def payload_lists(spark, d):
    """Lists that a pool keeps as JSON, as JSON in a string, or as a Python literal; and something else."""
    k = F.col("o_orderkey") % 4
    js = F.concat(F.lit('[{"kanun_no": "'), F.col("o_custkey"), F.lit('", "madde": null}, {"kanun_no": "a\'b"}]'))
    py = F.concat(F.lit("[{'kanun_no': '"), F.col("o_custkey"), F.lit("', 'madde': None}, {'kanun_no': \"a'b\", 'x': True}]"))
    raw = F.when(k == 0, js).when(k == 1, F.to_json(F.struct(js.alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(js.alias("s")))) - 6)).when(k == 2, py).otherwise("{'a': 1}")
    rows = table(spark, d, "orders").select(tables.payload_list(raw).alias("refs"))
    state = F.when(F.col("refs").isNull(), "unusable").otherwise("list")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("refs").isNotNull(), F.size("refs"))).alias("refs"), F.max(F.col("refs")[0]["kanun_no"]).alias("number"))


@query("SELECT user_id, min(ts) AS earliest, max(ts) AS latest, count(*) AS events FROM events GROUP BY 1")
def event_bounds(spark, d):
    return tables.bounds(table(spark, d, "events"), "user_id", "ts")


@query("SELECT year(o_orderdate) AS round, round(avg(o_totalprice), 4) AS value FROM orders WHERE year(o_orderdate) >= 1995 GROUP BY 1")
def learning_curve(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("round")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    return tables.curve(o, "round", 1995)


# --- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, 'E-' || doc_id || '/2' AS ruling, trim(regexp_replace(substr(t, greatest(0, 2 - 13) + 1, least(length(t), 5 + 14) - greatest(0, 2 - 13)), '\\s+', ' ', 'g')) AS snippet FROM (SELECT doc_id, 'Sayı : E-' || doc_id || '/2  01.02.2020 ' || coalesce(source, '') AS t FROM documents)")
def ruling_numbers(spark, d):
    t = F.concat(F.lit("Sayı : E-"), F.col("doc_id"), F.lit("/2  01.02.2020 "), F.coalesce("source", F.lit("")))
    return table(spark, d, "documents").select("doc_id", scalars.ruling_number(t).alias("ruling"), scalars.snippet(t, 2, 5).alias("snippet"))


@query(CITED_SQL + " SELECT coalesce(nullif(law_no, ''), nullif(law_name, ''), '?') || CASE WHEN article <> '' THEN '/' || article ELSE '' END AS name, coalesce(nullif(law_no, ''), nullif(law_name, ''), 'kanun belirtilmemiş') || ' · madde ' || coalesce(nullif(article, ''), '—') AS label, count(*) AS n FROM cited GROUP BY 1, 2")
def reference_labels(spark, d):
    no, name, a = F.col("law_no"), F.col("law_name"), F.col("article")
    return cited(spark, d).groupBy(scalars.display_name(no, name, a).alias("name"), scalars.reference_label(no, name, a).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN user_id % 3 <> 0 THEN cast(user_id AS DOUBLE) END AS number, CASE WHEN user_id % 3 <> 0 THEN cast(round(user_id / 10.0 * 1000000000) AS BIGINT) END AS bytes, count(*) AS n FROM events GROUP BY 1, 2")
def coerced_numbers(spark, d):
    raw = F.when(F.col("user_id") % 3 == 0, "n/a").otherwise(F.col("user_id").cast("string"))
    gb = F.when(F.col("user_id") % 3 != 0, (F.col("user_id") / 10).cast("string"))
    return table(spark, d, "events").groupBy(scalars.number(raw).alias("number"), scalars.bytes_of_gb(gb).alias("bytes")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 60 END AS seconds FROM events")
def seconds_on_page(spark, d):
    ts = F.col("ts").cast("timestamp")
    opened = F.when(F.col("event_id") % 2 == 0, ts - F.expr("INTERVAL 1 MINUTE")).otherwise(ts + F.expr("INTERVAL 1 HOUR"))
    return table(spark, d, "events").select("event_id", scalars.seconds_on_page(opened, ts).alias("seconds"))
