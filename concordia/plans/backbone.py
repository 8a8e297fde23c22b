"""Reference lists carried by the star tables, in Spark; ``LISTS_SQL`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lists(spark: SparkSession, sf_dir: str, ranges: bool = False, names: bool = False) -> DataFrame:
    """doc_id, side (reference, candidate, judge, model), pos, law_no, name_key, article."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    number = (193 + 20 * (F.col("l_partkey") % 5)).cast("string")
    article = F.when(F.col("l_linenumber") % 5 == 0, "").otherwise((F.col("l_suppkey") % 13).cast("string"))
    if ranges:
        article = F.when(F.col("l_linenumber") % 6 == 0, "3 ila 6").otherwise(article)
    name = F.concat(F.lit("n"), (F.col("l_partkey") % 3).cast("string"))
    blank = (F.col("l_partkey") % 11 == 0) if names else F.lit(False)
    sides = F.array(
        F.when(F.col("l_linenumber") % 7 != 0, "reference"),
        F.when(F.col("l_returnflag") != "R", "candidate"),
        F.when(F.col("l_linestatus") != "O", "model"),
        F.when(F.col("l_suppkey") % 4 != 0, "judge"),
    )
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos"), F.when(blank, "").otherwise(number).alias("law_no"), (name if names else F.lit("")).alias("name_key"), article.alias("article"), F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("side"))
    if ranges:
        first, last = (F.regexp_extract("article", r"^(\d+) ila (\d+)$", k) for k in (1, 2))
        spelt = F.when(first != "", F.transform(F.sequence(F.try_to_number(first, F.lit("99")).cast("int"), F.try_to_number(last, F.lit("99")).cast("int")), lambda n: n.cast("string"))).otherwise(F.array("article"))
        rows = rows.withColumn("article", F.explode(spelt))
    return rows


def lists_sql(ranges: bool = False, names: bool = False) -> str:
    """``WITH r AS (...), c AS (...)``: rows, and claims with the redundant flag, where numbers are all written."""
    article = "CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE cast(l_suppkey % 13 AS VARCHAR) END"
    if ranges:
        article = f"unnest(CASE WHEN l_linenumber % 6 = 0 THEN ['3', '4', '5', '6'] ELSE [{article}] END)"
    number = "cast(193 + 20 * (l_partkey % 5) AS VARCHAR)"
    number = f"CASE WHEN l_partkey % 11 = 0 THEN '' ELSE {number} END" if names else number
    name = "'n' || cast(l_partkey % 3 AS VARCHAR)" if names else "''"
    each = " UNION ALL ".join(f"SELECT *, '{s}' AS side FROM base WHERE {w}" for s, w in (("reference", "l_linenumber % 7 <> 0"), ("candidate", "l_returnflag <> 'R'"), ("model", "l_linestatus <> 'O'"), ("judge", "l_suppkey % 4 <> 0")))
    return f"""WITH base AS (SELECT l_orderkey AS doc_id, cast(l_linenumber AS BIGINT) AS pos, {number} AS law_no, {name} AS name_key, {article} AS article, l_linenumber, l_returnflag, l_linestatus, l_suppkey FROM lineitem),
r AS ({each}),
i AS (SELECT *, 'no:' || law_no AS law FROM r),
f AS (SELECT doc_id, side, law, article, min(pos) AS pos, count(*) AS copies FROM i GROUP BY ALL),
c AS (SELECT *, article = '' AND max(cast(article <> '' AS INT)) OVER (PARTITION BY doc_id, side, law) = 1 AS redundant FROM f)"""


VERDICTS_SQL = """,
b AS (SELECT doc_id, law, article, coalesce(bool_or(side = '{r}'), false) AS r, coalesce(bool_or(side = '{c}'), false) AS c,
  coalesce(bool_or(side = '{r}' AND redundant), false) AS rr, coalesce(bool_or(side = '{c}' AND redundant), false) AS cr
  FROM c WHERE side IN ('{r}', '{c}') GROUP BY ALL),
v AS (SELECT doc_id, law, article, cast(r AND NOT rr AND c AS BIGINT) AS tp, cast(r AND NOT rr AND NOT c AS BIGINT) AS fn,
  cast(c AND NOT (r AND NOT rr) AND NOT cr AS BIGINT) AS fp, cast(rr AS BIGINT) AS excused_reference, cast(cr AND NOT (r AND NOT rr) AS BIGINT) AS excused_candidate FROM b),
d AS (SELECT doc_id, cast(sum(tp) AS BIGINT) AS tp, cast(sum(fp) AS BIGINT) AS fp, cast(sum(fn) AS BIGINT) AS fn, cast(sum(excused_reference) AS BIGINT) AS excused_reference, cast(sum(excused_candidate) AS BIGINT) AS excused_candidate FROM v GROUP BY 1)
"""


def verdicts_sql(ranges: bool = False, reference: str = "reference", candidate: str = "candidate") -> str:
    return lists_sql(ranges) + VERDICTS_SQL.format(r=reference, c=candidate)


NUMBERS, NAMES, ARTICLES = ("193", "213", "492", "", "5520"), ("Gelir Vergisi Kanunu", "Vergi Usul Kanunu", "", "Harçlar Kanunu", "Kanun"), ("5", "12", "mükerrer 20", "", "94")
TAIL = " 193 sayılı Kanunun 5 inci maddesi aynı Kanunun 12 nci maddesinde Kanunun94 üncü madde (2) fıkra"
QUOTES = ("193 sayılı Kanunun 5 inci maddesi", "aynı Kanunun 12 nci maddesinde", "Kanunun94 üncü madde (2) fıkra", "vergi 7 nci bent 213")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with quotes, six a document: doc_id, pos, law_no, law_name, article, source_text and the document's text."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")).alias("t"))
    rows = docs.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    i, p = F.col("doc_id"), F.col("pos")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    k = (i + p) % 6
    quote = F.when(k == 0, "").when(k == 1, F.trim(F.substring("t", 3, 40))).otherwise(pick(QUOTES, k + 2))
    whole = F.when(i % 2 == 0, F.concat("t", F.lit(TAIL))).otherwise(F.col("t"))
    return rows.select("doc_id", p.cast("long").alias("pos"), pick(NUMBERS, i + p).alias("law_no"), pick(NAMES, 3 * i + p).alias("law_name"), pick(ARTICLES, i + 2 * p).alias("article"), quote.alias("source_text"), whole.alias("text"))


def _pick_sql(words: tuple[str, ...], n: str) -> str:
    return f"[{', '.join(repr(w) for w in words)}][({n}) % {len(words)} + 1]"


CITED_SQL = f"""WITH t0 AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
cited AS (SELECT doc_id, cast(p AS BIGINT) AS pos, {_pick_sql(NUMBERS, "doc_id + p")} AS law_no, {_pick_sql(NAMES, "3 * doc_id + p")} AS law_name, {_pick_sql(ARTICLES, "doc_id + 2 * p")} AS article,
  CASE (doc_id + p) % 6 WHEN 0 THEN '' WHEN 1 THEN trim(substring(t, 3, 40)) ELSE {_pick_sql(QUOTES, "(doc_id + p) % 6 + 2")} END AS source_text,
  CASE WHEN doc_id % 2 = 0 THEN t || '{TAIL}' ELSE t END AS text FROM t0, (SELECT unnest(range(0, 6)) AS p))"""
