"""Verbs over whole batches: preparing one, the page a reviewer sees, views and summaries that are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import html_to_text
from .preparation import channel, internal_ids, list_warnings, normalized_list, warning_codes


def prepared(annotations: DataFrame, pool: DataFrame, read: Callable[[Column], Column] = html_to_text) -> DataFrame:
    """A batch from annotation records and a pool: internal_id, doc_key, status (ready or quarantined), reason, channel, text, text_sha256,
    references, warnings (codes).

    annotations: doc_key, entry_name, record_index, raw (array of references, null: none), completed; pool: doc_key, html, pdf. A record is
    quarantined for the first of: no id, several records, no pool row, several pool rows, no text. ``read`` makes the HTML's text; each pool row
    is read once, before it meets its records, and brings its channel without its text where only that is asked for.
    """
    named = internal_ids(annotations, "doc_key")
    records = annotations.where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.count("*").alias("records"))
    one = pool.where("doc_key IS NOT NULL").select("doc_key", channel(F.col("html"), F.col("pdf"), read).alias("c")).select("doc_key", "c.channel", "c.text")
    one = one.withColumn("text_sha256", F.sha2("text", 256))
    pooled = one.groupBy("doc_key").agg(F.count("*").alias("pooled"), *[F.first(c).alias(c) for c in ("channel", "text", "text_sha256")])
    rows = named.join(records, "doc_key", "left").join(pooled, "doc_key", "left")
    rows = rows.withColumns({"channel": F.coalesce("channel", F.lit("missing")), "text": F.coalesce("text", F.lit("")), "text_sha256": F.coalesce("text_sha256", F.sha2(F.lit(""), 256))})
    reason = F.when(F.col("doc_key").isNull(), "missing_id").when(F.col("records") > 1, "duplicate_annotation").when(F.col("pooled").isNull(), "not_in_pool").when(F.col("pooled") > 1, "ambiguous_pool").when(F.col("channel") == "missing", "no_text")
    codes = warning_codes(list_warnings(F.col("raw")))
    codes = F.when(F.coalesce("completed", F.lit(True)), codes).otherwise(F.sort_array(F.array_append(codes, F.lit("annotation_incomplete"))))
    return rows.select("internal_id", "doc_key", F.when(reason.isNull(), "ready").otherwise("quarantined").alias("status"), reason.alias("reason"), "channel", "text", "text_sha256", normalized_list(F.col("raw")).alias("references"), codes.alias("warnings"))


def manifest(batch: DataFrame) -> DataFrame:
    """What a batch's manifest counts: a row for each status, channel and warning code."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    rows = F.concat(F.array(one("status", F.coalesce("reason", "status")), one("channel", F.col("channel"))), F.transform("warnings", lambda code: one("warning", code)))
    return batch.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.value").agg(F.count("*").alias("n"))


def review_page(documents: DataFrame, reviews: DataFrame, predictions: DataFrame, judges: DataFrame, show_judge: bool) -> DataFrame:
    """Documents beside their review, prediction and, if it may be seen, the judge's verdict; without a name of its own the annotator is the
    imported one. documents: doc_id, annotator, imported; the others have a row a document at most."""
    rows = documents.join(reviews, "doc_id", "left").join(predictions, "doc_id", "left").join(judges, "doc_id", "left")
    rows = rows.withColumn("annotator", F.coalesce(F.nullif(F.col("annotator"), F.lit("")), "imported", F.lit("unknown"))).drop("imported")
    return rows if show_judge else rows.withColumn("verdict", F.lit(None).cast("string"))


def fingerprint(row: dict[str, Column]) -> Column:
    """sha256 of a flat record as canonical JSON: names in order, no blanks; nulls are written."""
    fields = F.struct(*[c.alias(n) for n, c in sorted(row.items())])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


#: the closing formula of rulings and the reference that it stands for
CLOSING = ("213", "Vergi Usul Kanunu", "413")
CLOSING_PATTERN = r"213 sayılı Vergi Usul Kanununun 413\S* (?:üncü )?maddesi\S*"


def with_closing(refs: Column, text: Column) -> tuple[Column, Column]:
    """(the list with the closing formula's reference, why): added only where the text writes it and the list lacks it; the quote is the text's."""
    number, name, article = CLOSING
    span = F.regexp_extract(text, CLOSING_PATTERN, 0)
    there = F.exists(refs, lambda r: (r["kanun_no"] == number) & (r["madde"] == article))
    new = F.struct(F.lit(number).alias("kanun_no"), F.lit(name).alias("kanun_ad"), F.lit(article).alias("madde"), span.alias("source_text"))
    why = F.when(there, "already_present").when(span == "", "no_exact_evidence").otherwise("added")
    return F.when(why == "added", F.array_append(refs, new)).otherwise(refs), why


def prediction_views(predictions: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Predictions with their raw list and the list without the pairs that a policy removes."""
    hit = lambda r: F.array_contains(F.array(*[F.lit(f"{n}\n{a}") for n, a in pairs]), F.concat_ws("\n", r["kanun_no"], r["madde"])) if pairs else F.lit(False)
    return predictions.withColumns({"raw_references": F.col("references"), "references": F.filter("references", lambda r: ~hit(r))})


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file, to a new folder that is complete once ``_SUCCESS`` is there."""
    rows.coalesce(1).write.mode("errorifexists").json(path)
