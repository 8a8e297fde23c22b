"""Queries of ``operators.audit``, on references that the documents table carries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, citations, text
from .backbone import CITED_SQL, cited
from .registry import query

ALONE = "{n} <> '' AND regexp_matches(source_text, '(^|[^\\p{{L}}\\p{{N}}_])' || {n} || '($|[^\\p{{L}}\\p{{N}}_])')"
GROUNDED = "source_text <> '' AND contains(text, source_text)"
SHAPED = "list_concat(regexp_extract_all(source_text, '(?i)([0-9]+)\\s*(?:inci|ıncı|uncu|üncü|nci|ncı|ncu|ncü)\\s*madde', 1), regexp_extract_all(source_text, '(?i)madde\\s*([0-9]+)', 1))"
OFFICIAL = "CASE law_no WHEN '193' THEN 'Gelir Vergisi Kanunu' WHEN '213' THEN 'Vergi Usul Kanunu' WHEN '492' THEN 'Harçlar Kanunu' WHEN '5520' THEN 'Kurumlar Vergisi Kanunu' END"
FOUND = CITED_SQL + f""", f AS (SELECT *, NOT ({GROUNDED}) AS ungrounded, coalesce(law_name <> '' AND law_name <> {OFFICIAL}, false) AS name_conflict,
 CASE WHEN regexp_matches(article, '^[0-9]+$') AND NOT ({ALONE.format(n="article")}) THEN CASE WHEN NOT regexp_matches(source_text, '[0-9]') THEN 'anaphoric' WHEN list_contains({SHAPED}, article) THEN 'glued_to_preceding_word' WHEN len({SHAPED}) > 0 THEN 'other_article_number' ELSE 'sub_part_number' END END AS article_absent FROM cited)"""


@query(FOUND + " SELECT doc_id, count(*) AS reference_count, count_if(ungrounded) AS ungrounded, count_if(name_conflict) AS name_conflicts, count(article_absent) AS articles_absent FROM f GROUP BY 1")
def audit_references(spark, d):
    n = lambda c: F.count_if(F.col(c))
    return audit.findings(cited(spark, d)).groupBy("doc_id").agg(F.count("*").alias("reference_count"), n("ungrounded").alias("ungrounded"), n("name_conflict").alias("name_conflicts"), F.count("article_absent").alias("articles_absent"))


@query(FOUND + " SELECT article_absent, count(*) AS n FROM f GROUP BY 1")
def absent_articles(spark, d):
    return audit.findings(cited(spark, d)).groupBy("article_absent").agg(F.count("*").alias("n"))


@query(CITED_SQL + " SELECT law_no, article, count(*) AS groups, cast(sum(copies) AS BIGINT) AS copies FROM (SELECT doc_id, law_no, article, source_text, count(*) AS copies FROM cited GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2")
def duplicate_rows(spark, d):
    rows = cited(spark, d).withColumn("law", F.col("law_no"))
    return audit.duplicate_rows(rows).groupBy(F.col("law").alias("law_no"), "article").agg(F.count("*").alias("groups"), F.sum("copies").alias("copies"))


LEADING = "regexp_extract(article, '[0-9]+')"


@query(CITED_SQL + f""" SELECT kind, count(*) AS n FROM (SELECT CASE WHEN NOT ({GROUNDED}) THEN 'ungrounded'
 WHEN (law_no <> '' AND NOT ({ALONE.format(n="law_no")}) AND NOT regexp_matches(source_text, '(?i)(aynı|anılan|mezkur|mezkûr|söz konusu|bu)\\s+kanun')) OR ({LEADING} <> '' AND NOT ({ALONE.format(n=LEADING)})) THEN 'label_inconsistent_with_span' ELSE 'candidate_addition' END AS kind FROM cited) GROUP BY 1""")
def extra_triage(spark, d):
    return audit.triage(cited(spark, d)).groupBy("kind").agg(F.count("*").alias("n"))


@query(CITED_SQL + f" SELECT doc_id, count_if(source_text <> '') AS quotes, count_if({GROUNDED}) AS found, count_if({GROUNDED}) / count_if(source_text <> '') AS coverage FROM cited WHERE source_text = '' OR ({GROUNDED}) GROUP BY 1 HAVING count_if(source_text <> '') > 0")
def evidence_coverage(spark, d):
    """Coverage of quotes that are exact or empty, by document."""
    rows = cited(spark, d).where((F.col("source_text") == "") | audit.grounded(F.col("source_text"), F.col("text")))
    return text.coverage(rows).where("quotes > 0")


@query()
def located_references(spark, d):
    """Where each text cites its references: the best span, and how many there are."""
    rows = citations.locate(cited(spark, d))
    return rows.select("doc_id", "pos", F.size("spans").alias("places"), F.get("spans", F.lit(0))["start"].alias("start"), F.get("spans", F.lit(0))["end"].alias("end"))


@query()
def attached_spans(spark, d):
    """Quotes for references without one, and those that no place was found for."""
    placed, refused = citations.attached(cited(spark, d))
    return placed.select("doc_id", "pos", F.size("quotes").alias("quotes")).unionByName(refused.select("doc_id", "pos", F.lit(0).alias("quotes")))


@query(CITED_SQL + ", t AS (SELECT DISTINCT doc_id, text FROM cited WHERE doc_id % 2 = 0) SELECT doc_id, count(*) AS docs, cast(1 AS BIGINT) AS laws FROM t GROUP BY 1")
def named_laws(spark, d):
    """The one numbered law that the even documents' last sentence names."""
    docs = cited(spark, d).where("doc_id % 2 = 0").select("doc_id", "text").distinct()
    found = citations.laws_table(docs).where("numbered").groupBy("doc_id").agg(F.count("*").alias("laws"))
    return docs.groupBy("doc_id").agg(F.count("*").alias("docs")).join(found, "doc_id")
