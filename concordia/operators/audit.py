"""Checks of a reference list against itself and its document's text. Rows: doc_id, pos, law_no, law_name, article, source_text, text; texts
are clean (``normalize.clean_text``) and spellings are those of ``normalize``. All checks are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions as d

WORD = r"[\p{L}\p{N}_]"
ORDINAL_ARTICLE = r"(?i)([0-9]+)\s*(?:inci|ıncı|uncu|üncü|nci|ncı|ncu|ncü)\s*madde"
ARTICLE_ORDINAL = r"(?i)madde\s*([0-9]+)"
BACK = r"(?i)(aynı|anılan|mezkur|mezkûr|söz konusu|bu)\s+kanun"


def stands_alone(number: Column, span: Column) -> Column:
    """A number as a token of its own, not glued to a letter or another digit."""
    return (number != "") & F.regexp_like(span, F.concat(F.lit(f"(^|[^{WORD[1:-1]}])"), number, F.lit(f"($|[^{WORD[1:-1]}])")))


def grounded(span: Column, text: Column) -> Column:
    return (span != "") & F.contains(text, span)


def canonical_name(number: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in d.LAW_BY_NUMBER.items() for x in pair]), number)


def article_finding(article: Column, span: Column) -> Column:
    """Why a plainly numbered article is not in its quote as a token: the quote has no number, glues it to a word, names another article,
    or has other numbers only. Null: it is there, or the article is no plain number."""
    shaped = F.concat(F.regexp_extract_all(span, F.lit(ORDINAL_ARTICLE), 1), F.regexp_extract_all(span, F.lit(ARTICLE_ORDINAL), 1))
    absent = article.rlike("^[0-9]+$") & ~stands_alone(article, span)
    kind = F.when(~span.rlike("[0-9]"), "anaphoric").when(F.array_contains(shaped, article), "glued_to_preceding_word").when(F.size(shaped) > 0, "other_article_number").otherwise("sub_part_number")
    return F.when(absent, kind)


def findings(rows: DataFrame) -> DataFrame:
    """The rows with ungrounded, name_conflict and article_absent (a class or null)."""
    official = canonical_name(F.col("law_no"))
    conflict = F.coalesce((F.col("law_name") != "") & (F.col("law_name") != official), F.lit(False))
    return rows.withColumns({"ungrounded": ~grounded(F.col("source_text"), F.col("text")), "name_conflict": conflict, "article_absent": article_finding(F.col("article"), F.col("source_text"))})


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, law, article, source_text, copies) of identities that are written twice or more with one quote."""
    return rows.groupBy("doc_id", "law", "article", "source_text").agg(F.count("*").alias("copies")).where("copies > 1")


def triage(extra: DataFrame) -> DataFrame:
    """Why a candidate's extra reference is one: its quote is not in the text; the quote lacks its law's number, without pointing back to
    a law, or its article's leading number; or it is an addition, which may well be right."""
    span = F.col("source_text")
    law_absent = (F.col("law_no") != "") & ~stands_alone(F.col("law_no"), span)
    leading = F.regexp_extract("article", "[0-9]+", 0)
    article_absent = (leading != "") & ~stands_alone(leading, span)
    back = F.regexp_like(span, F.lit(BACK))
    kind = F.when(~grounded(span, F.col("text")), "ungrounded").when((law_absent & ~back) | article_absent, "label_inconsistent_with_span").otherwise("candidate_addition")
    return extra.withColumn("kind", kind)
