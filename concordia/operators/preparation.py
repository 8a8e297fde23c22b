"""Preparation of documents and their raw lists: shapes, warnings, channels, attributions, ids, and checks of what models and judges wrote.

Lists are arrays of structs; all of it is built-in expressions but the cleaning of texts and the parsing of model output.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import clean_text, html_to_text
from .records import numbered

FIELDS = ("kanun_no", "kanun_ad", "madde", "source_text")
DECIDING = FIELDS[:3]
#: greatest lengths of what is sent on
LIMITS = {"kanun_no": 64, "kanun_ad": 512, "madde": 64, "source_text": 4000}
REFERENCE = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in FIELDS]))


def normalized_list(raw: Column) -> Column:
    """Trimmed fields, empty for null; a null list is empty."""
    return F.coalesce(F.transform(raw, lambda r: F.struct(*[F.coalesce(F.trim(r[f].cast("string")), F.lit("")).alias(f) for f in FIELDS])), F.array().cast(REFERENCE))


def list_warnings(raw: Column) -> Column:
    """(code, reference_index, field): one for a list that is not there, or one for each null field."""
    kind = "array<struct<code:string,reference_index:int,field:string>>"
    one = lambda code, i, f: F.struct(F.lit(code).alias("code"), i.alias("reference_index"), F.lit(f).alias("field"))
    each = lambda r, i: F.filter(F.array(*[F.when(r[f].isNull(), one("reference_null_field", i, f)) for f in FIELDS]), lambda x: x.isNotNull())
    missing = F.array(one("current_references_missing_or_null", F.lit(None).cast("int"), None)).cast(kind)
    return F.coalesce(F.flatten(F.transform(raw, each)).cast(kind), missing)


def warning_codes(warnings: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(warnings, lambda w: w["code"])))


def explained(warnings: Column) -> Column:
    """Warnings by field as (level, field, rows): the rows' 1-based numbers in order; attention before information. Quotes decide nothing, so
    warnings on them are silent."""
    levels = F.create_map(*[F.lit(x) for f, level in (("madde", "attention"), ("kanun_no", "info"), ("kanun_ad", "info")) for x in (f, level)])
    known = F.filter(warnings, lambda w: w["field"].isin(*DECIDING))
    by = lambda f: F.sort_array(F.array_distinct(F.transform(F.filter(known, lambda w: w["field"] == f), lambda w: w["reference_index"] + 1)))
    notes = F.array(*[F.struct(F.element_at(levels, F.lit(f)).alias("level"), F.lit(f).alias("field"), by(f).alias("rows")) for f in ("madde", "kanun_no", "kanun_ad")])
    return F.filter(notes, lambda n: F.size(n["rows"]) > 0)


def deciding_fields(refs: Column) -> Column:
    """The three fields that decide, without the quote: what a judge may see."""
    return F.transform(refs, lambda r: F.struct(*[r[f].alias(f) for f in DECIDING]))


def distinct_fields(refs: Column) -> Column:
    """Deciding fields without exact repeats, order kept."""
    return F.array_distinct(deciding_fields(refs))


def final_references(refs: Column, policy: tuple[tuple[str, str], ...] = ()) -> Column:
    """What an expert submitted, but for rows that are all blank and those that the policy removes; rows without a law stay."""
    blank = lambda r: F.concat_ws("", *[F.trim(r[f]) for f in FIELDS]) == ""
    dropped = lambda r: F.array_contains(F.array(*[F.lit(f"{n}\n{a}") for n, a in policy]), F.concat_ws("\n", r["kanun_no"], r["madde"])) if policy else F.lit(False)
    return F.filter(normalized_list(refs), lambda r: ~blank(r) & ~dropped(r))


def clipped(refs: Column) -> tuple[Column, Column]:
    """Fields cut to their greatest lengths, and whether any was cut."""
    cut = F.transform(refs, lambda r: F.struct(*[F.substring(r[f], 1, n).alias(f) for f, n in LIMITS.items()]))
    any_cut = F.exists(refs, lambda r: F.greatest(*[F.coalesce(F.length(r[f]) > n, F.lit(False)) for f, n in LIMITS.items()]))
    return cut, F.coalesce(any_cut, F.lit(False))


def channel(html: Column, pdf: Column, read: Callable[[Column], Column] = html_to_text, clean: Callable[[Column], Column] = clean_text) -> Column:
    """struct(channel, text): the HTML's text if there is any, else the PDF's, else nothing; quotes play no part. ``read`` makes the HTML's
    text, ``clean`` the PDF's."""
    h, p = read(html), clean(pdf)
    return F.when(F.coalesce(F.length(h), F.lit(0)) > 0, F.struct(F.lit("htmlText").alias("channel"), h.alias("text"))).when(F.coalesce(F.length(p), F.lit(0)) > 0, F.struct(F.lit("pdfText").alias("channel"), p.alias("text"))).otherwise(F.struct(F.lit("missing").alias("channel"), F.lit("").alias("text")))


def text_digest(*candidates: Column) -> Column:
    """sha256 of the first text that is not empty once cleaned; null without one."""
    return F.sha2(F.coalesce(*[F.nullif(clean_text(c), F.lit("")) for c in candidates]), 256)


def attribution(completed_by: Column, last_editor: Column, edit_count: Column) -> Column:
    """struct(completed_by, last_editor, edit_count) without what is empty or negative; null if nothing is left."""
    by, editor, n = (F.nullif(F.trim(completed_by), F.lit("")), F.nullif(F.trim(last_editor), F.lit("")), F.when(edit_count >= 0, edit_count))
    return F.when(F.coalesce(by, editor, n.cast("string")).isNotNull(), F.struct(by.alias("completed_by"), editor.alias("last_editor"), n.alias("edit_count")))


def attributed(documents: DataFrame, records: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their attribution, failures): each document needs exactly one record, with an attribution; an import with failures
    is to be refused as a whole."""
    one = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("records"), F.first(value).alias(value))
    both = documents.join(one, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("records", F.coalesce("records", F.lit(0)))
    good = (F.col("records") == 1) & F.col(value).isNotNull()
    return both.where(good).drop("records"), both.where(~good).select(key, "records")


def restricted(rows: DataFrame, subset: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the subset, the subset's ids that have none): the second must be empty for a run to go on."""
    ids = subset.select(key).where(F.col(key).isNotNull()).distinct()
    return rows.join(ids, key, "left_semi"), ids.join(rows.select(key), key, "left_anti")


def internal_ids(rows: DataFrame, key: str) -> DataFrame:
    """``internal_id`` d000001 and so on in the order of ``key``; rows without one come by their pseudo key, which sorts by its own text."""
    pseudo = F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit("__missing__:"), F.col("entry_name"), F.lit(":"), F.col("record_index").cast("string")))
    placed = numbered(rows.withColumn("__order", pseudo).withColumn("__tie", F.xxhash64(*rows.columns)), ("__order", "__tie"), "__n")
    return placed.withColumn("internal_id", F.format_string("d%06d", "__n")).drop("__order", "__tie", "__n")


def broken_files(rows: DataFrame, required: tuple[str, ...] = ("internal_id", "text")) -> DataFrame:
    """(internal_id, problem) of prepared rows that miss a required column's value or whose text is not what their digest says."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ","))).when(F.sha2(F.col("text"), 256) != F.col("text_sha256"), "text_hash")
    return rows.select("internal_id", problem.alias("problem")).where("problem IS NOT NULL")


#: measures of a run that may leave the machine
OPERATIONAL = ("total_seconds", "output_tokens", "input_tokens", "peak_memory_gb")


def safe_operational(rows: DataFrame, fields: tuple[str, ...] = OPERATIONAL) -> DataFrame:
    """The listed measures only; those that are no finite number are null."""
    kept = [c for c in fields if c in rows.columns]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c))
    return rows.select("doc_id", *[finite(c).alias(c) for c in kept])


def stale(beat: Column, now: Column, seconds: int) -> Column:
    """A heartbeat that is missing or older than ``seconds``."""
    return beat.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(beat) > seconds)


VERDICTS = ("A", "B", "TIE", "NEITHER")


def judge_results(rows: DataFrame) -> DataFrame:
    """Rows with the upper-case verdict, verified and unverified quotes, and ``problem`` where the contract is broken: an unknown verdict, or
    lists that are not there. rows: doc_id, text (clean), verdict, errors_a, errors_b, evidence, reasons. A quote that is not in the text is set
    apart; the verdict stands."""
    verdict = F.upper("verdict")
    problem = F.when(verdict.isNull() | ~verdict.isin(*VERDICTS), "verdict").when(F.col("errors_a").isNull() | F.col("errors_b").isNull(), "candidate_errors").when(F.col("evidence").isNull() | F.col("reasons").isNull(), "lists")
    spans = F.filter(F.col("evidence"), lambda s: F.trim(s) != "")
    there = lambda s: F.contains(F.col("text"), F.trim(F.regexp_replace(s, "\\s+", " ")))
    return rows.withColumns({"verdict": verdict, "problem": problem, "verified": F.filter(spans, there), "unverified": F.filter(spans, lambda s: ~there(s))})


def parsed_output(value: str | None) -> str | None:
    """The JSON array of references that a model wrote, with or without a code fence, around other text, or under ``references``; null if
    there is none or one of its items is no object."""
    lines = (value or "").strip().splitlines()
    if lines and lines[0].startswith("```"):
        lines = lines[1:-1] if lines[-1].strip() == "```" and len(lines) > 1 else lines[1:]
    text = "\n".join(lines).strip()
    for piece in (text, text[text.find("[") : text.rfind("]") + 1] if "[" in text else ""):
        try:
            payload = json.loads(piece)
        except ValueError:
            continue
        if isinstance(payload, dict) and isinstance(payload.get("references"), list):
            payload = payload["references"]
        if not isinstance(payload, list) or not all(isinstance(x, dict) for x in payload):
            return None
        trimmed = [{f: str("" if x.get(f) is None else x[f]).strip() for f in FIELDS} for x in payload]
        return json.dumps(trimmed, ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def parse_output(values: pd.Series) -> pd.Series:
    return values.map(parsed_output)


def model_lists(raw: Column) -> Column:
    """``parse_output`` as an array of references; null where the output could not be read."""
    return F.from_json(parse_output(raw), REFERENCE)
