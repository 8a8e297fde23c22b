"""Reports of a review round: error triage, expert workload, carried decisions, judges, survivors, ranges, replay packs, law mentions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dimensions as d
from ..functions.normalize import fold
from .metrics import ratio


def error_attribution(claimed: DataFrame, raters: tuple[str, ...], expert: str) -> DataFrame:
    """correct, missed, spurious for each rater and document; null for a rater who has no list there (not zero).

    claimed: ``compare.claims`` rows; a rater's list exists in a document if any row of that side does.
    """
    known = claimed.where((F.col("law") != "unknown") & ~F.col("redundant"))
    flag = lambda s: F.max((F.col("side") == s).cast("int"))
    bits = known.groupBy("doc_id", "law", "article").agg(*[flag(s).alias(s) for s in (*raters, expert)])
    n = lambda c: F.sum(c.cast("long"))
    t = F.col(expert) == 1
    per = bits.groupBy("doc_id").agg(*[F.struct(n(t & (F.col(r) == 1)).alias("correct"), n(t & (F.col(r) == 0)).alias("missed"), n(~t & (F.col(r) == 1)).alias("spurious"), F.max(r).alias("has")).alias(r) for r in raters])
    rows = per.select("doc_id", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("x")) for r in raters])).alias("y")).select("doc_id", "y.rater", "y.x.*")
    return rows.select("doc_id", "rater", *[F.when(F.col("has") == 1, F.col(c)).alias(c) for c in ("correct", "missed", "spurious")])


def workload(reviews: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Documents, required reviews and their rate, deferred, carried, and nearest-rank percentiles of the measured seconds."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN {seconds} >= 0 THEN {seconds} END)")
    out = reviews.agg(F.count("*").alias("docs"), n(F.col("required")).alias("required"), n(F.col("status") == "deferred").alias("deferred"), n(F.col("carried")).alias("carried"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))
    return out.withColumn("rate", ratio(F.col("required"), F.col("docs"), None))


def same_batch(a: DataFrame, b: DataFrame, key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """Documents by which two batches differ, and how: only_a, only_b or changed. Decisions carry over only if there are none."""
    both = a.select(key, F.lit(1).alias("s"), digest).union(b.select(key, F.lit(2), digest))
    sides = both.groupBy(key).agg(F.max(F.when(F.col("s") == 1, F.col(digest))).alias("x"), F.max(F.when(F.col("s") == 2, F.col(digest))).alias("y"), F.max(F.when(F.col("s") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("s") == 2, 1).otherwise(0)).alias("b"))
    how = F.when(F.col("b") == 0, "only_a").when(F.col("a") == 0, "only_b").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return sides.select(key, how.alias("how")).where("how IS NOT NULL")


def judge_scores(rows: DataFrame) -> DataFrame:
    """Of judged documents: verdicts, exact sets, unverified span rate and retries, one row a verdict. rows: verdict, exact, spans,
    unverified, attempts."""
    n = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy("verdict").agg(F.count("*").alias("docs"), n(F.col("exact")).alias("exact"), F.sum("spans").alias("spans"), F.sum("unverified").alias("unverified"), F.sum(F.col("attempts") - 1).alias("retries"))
    return out.withColumn("unverified_rate", ratio(F.col("unverified"), F.col("spans"), None))


def survivors(rows: DataFrame, key: tuple[str, ...], order: tuple[Column, ...], position: str = "pos") -> DataFrame:
    """One row an identity: the best by ``order`` (greatest), at the first position that the identity had."""
    rest = [c for c in rows.columns if c not in key and c != position]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order, -F.col(position))).alias("b"), F.min(position).alias(position))
    return best.select(*key, position, *[f"b.{c}" for c in rest])


def endpoint_ranges(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Ranges ``a-b`` or ``a ila b`` that a text writes of which a list holds, for exactly one law, both ends and nothing between:
    doc_id, law_no, first, last."""
    marks = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![0-9/.-])([0-9]{1,4}\s*(?:-|–|ila)\s*[0-9]{1,4})(?![0-9/.-])"), 1))).alias("m"))
    ends = marks.select("doc_id", F.regexp_extract("m", "^([0-9]+)", 1).cast("int").alias("first"), F.regexp_extract("m", "([0-9]+)$", 1).cast("int").alias("last"))
    ends = ends.where(F.col("last") - F.col("first") > 1).where(F.col("last") - F.col("first") < d.WIDEST_RANGE).distinct()
    held = rows.where(F.col("article").rlike("^[0-9]{1,4}$")).groupBy("doc_id", "law_no").agg(F.collect_set(F.col("article").cast("int")).alias("held"))
    within = ends.join(held, "doc_id").where(F.array_contains("held", F.col("first")) & F.array_contains("held", F.col("last")))
    bare = within.where(~F.exists("held", lambda x: (x > F.col("first")) & (x < F.col("last"))))
    by = bare.groupBy("doc_id", "first", "last").agg(F.count("*").alias("laws"), F.first("law_no").alias("law_no"))
    return by.where("laws = 1").select("doc_id", "law_no", "first", "last")


def replay_packs(rows: DataFrame, limit: int, most: int = 10) -> DataFrame:
    """Greedy packs, by document, of windows in order: up to ``limit`` tokens and ``most`` windows a pack. rows: doc_id, ordinal, n."""

    def pack(sizes: pd.Series) -> pd.Series:
        def one(x):
            out, number, total, held = [], 0, 0, 0
            for n in x:
                if held and (total + n > limit or held == most):
                    number, total, held = number + 1, 0, 0
                total, held = total + n, held + 1
                out.append(number)
            return out

        return sizes.map(one)

    packed = F.pandas_udf(pack, T.ArrayType(T.IntegerType()))
    lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "n"))).alias("w"))
    numbered = lists.select("doc_id", "w", packed(F.transform("w", lambda x: x["n"])).alias("p"))
    return numbered.select("doc_id", F.explode(F.arrays_zip("w", "p")).alias("x")).select("doc_id", "x.w.ordinal", "x.w.n", F.col("x.p").alias("pack"))


def salvaged(value: str | None) -> tuple[str | None, int]:
    """The complete objects of a JSON array that breaks off or repeats its last one: (array, objects dropped as repeats)."""
    text, at, found = value or "", (value or "").find("["), []
    reader = json.JSONDecoder()
    while 0 <= at < len(text):
        if (at := next((i for i in range(at, len(text)) if text[i] == "{"), -1)) < 0:
            break
        try:
            item, at = reader.raw_decode(text, at)
        except ValueError:
            break
        found.append(item)
    if not found:
        return None, 0
    kept = len(found)
    while kept > 1 and found[kept - 1] == found[kept - 2]:
        kept -= 1
    return json.dumps(found[:kept], ensure_ascii=False), len(found) - kept


def salvage(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``salvaged`` (a JSON array or null) and ``repeats``."""
    kind = T.StructType([T.StructField("salvaged", T.StringType()), T.StructField("repeats", T.IntegerType())])

    @F.pandas_udf(kind)
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([salvaged(v) for v in values], columns=["salvaged", "repeats"])

    return rows.withColumn("__s", read(F.col(column))).select(*rows.columns, "__s.*")


_NAMED = sorted({*d.ALIASES, *(n.casefold() for n in d.ALIASES.values())}, key=len, reverse=True)
_LAW_OF = {fold(a): n for a, n in d.ALIASES.items()} | {fold(n): n for n in d.ALIASES.values()}
_MENTION = re.compile(r"(?P<number>(?<!\d)\d{1,4})\s*say[ıi]l[ıi]|(?P<back>(?<!\w)(?:aynı|anılan|mezkur|söz konusu|bu)\s+kanun\w*)|(?<!\w)(?P<name>" + "|".join(map(re.escape, _NAMED)) + r")(?:['’]?(?:n?[uıiü]n?|[dn][ae]n?|na|ne))?(?!\w)", re.I)


def law_mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, law number) of the laws a text names: by number, by name or acronym, or by pointing back to the one before."""
    out, last = [], ""
    for m in _MENTION.finditer(text or ""):
        if m["number"]:
            kind, law = "number", m["number"].lstrip("0") or "0"
        elif m["back"]:
            kind, law = "back", last
        else:
            kind, law = "name", d.NUMBER_BY_NAME.get(_LAW_OF.get(fold(m["name"]), ""), "")
        if kind == "back" and not law:
            continue
        last = law or last
        out.append((m.start(), m.end(), kind, law))
    return out


def find_law_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, law_no for each mention."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("law_no", T.StringType())]))

    @F.pandas_udf(kind)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start", "end", "kind", "law_no"), x, strict=True)) for x in law_mentions(t)])

    return docs.select("doc_id", F.explode(scan(F.coalesce("text", F.lit("")))).alias("m")).select("doc_id", "m.*")
