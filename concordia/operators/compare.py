"""Comparison of reference lists: alignment of names to numbers, identities, and one verdict a reference.

Input is long: a row for each reference with doc_id, side, pos and its spelling (law_no, name_key, article; empty strings, no
nulls). All steps cluster by doc_id: one shuffle brings a document's lists together, and what follows reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dimensions as d
from ..functions.normalize import name_key, spell_reference

def spell(rows: DataFrame) -> DataFrame:
    """Raw references (kanun_no, kanun_ad, madde) in one spelling, ranges as a row for each article."""
    spelt = rows.withColumn("__s", spell_reference(F.col("kanun_no").cast("string"), F.col("kanun_ad").cast("string"), F.col("madde").cast("string")))
    out = spelt.select(*rows.columns, "__s.law_no", "__s.law_name", "__s.name_key", F.posexplode("__s.articles").alias("in_range", "article"))
    return out


def _lookup(table: dict[str, object], key: Column, kind: str) -> Column:
    """A small fixed table as a map literal."""
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if kind == "array" else F.lit(v))]
    return F.element_at(F.create_map(*entries), key)


VALID = {name_key(n): v for n, v in d.NUMBERS_BY_NAME.items()}
DEFAULT = {name_key(n): v for n, v in d.NUMBER_BY_NAME.items()}


def align(rows: DataFrame, valid: dict | None = None, default: dict | None = None) -> DataFrame:
    """Adds ``number``: the written one, or the only one that the name stands for in the document's lists and the fixed tables."""
    valid, default = VALID if valid is None else valid, DEFAULT if default is None else default
    w = Window.partitionBy("doc_id", "name_key")
    written = F.array_distinct(F.collect_list(F.when((F.col("law_no") != "") & (F.col("name_key") != ""), F.col("law_no"))).over(w))
    known = _lookup(valid, F.col("name_key"), "array") if valid else F.lit(None).cast("array<string>")
    usual = _lookup(default, F.col("name_key"), "") if default else F.lit(None).cast("string")
    usual_list = F.when(usual.isNotNull(), F.array(usual)).otherwise(F.array().cast("array<string>"))
    seen = F.array_intersect("__w", known)
    candidates = F.when(known.isNull(), F.array_union("__w", usual_list)).when(F.size(seen) == 0, usual_list).otherwise(seen)
    out = rows.withColumn("__w", written).withColumn("__c", candidates)
    number = F.when(F.col("law_no") != "", F.col("law_no")).when((F.col("name_key") != "") & (F.size("__c") == 1), F.col("__c")[0]).otherwise("")
    return out.withColumn("number", number).withColumn("n_candidates", F.when(F.col("name_key") == "", 0).otherwise(F.size("__c"))).drop("__w", "__c")


def identify(rows: DataFrame) -> DataFrame:
    """Adds the identity: law (no:N, name:K or unknown), law_key (K without a number) and the article."""
    law = F.when(F.col("number") != "", F.concat(F.lit("no:"), "number")).when(F.col("name_key") != "", F.concat(F.lit("name:"), "name_key")).otherwise("unknown")
    return rows.withColumn("law", law)


def claims(rows: DataFrame) -> DataFrame:
    """One row an identity and list (the first written) with ``redundant``: a law alone beside an article of it in the list."""
    first_row = F.struct("pos", "law_no", "name_key")
    first = rows.groupBy("doc_id", "side", "law", "article").agg(F.min("pos").alias("pos"), F.count("*").alias("copies"), F.min_by(F.col("law_no") != "", first_row).alias("numbered"), F.min_by("name_key", first_row).alias("name_key"))
    of_law = Window.partitionBy("doc_id", "side", "law")
    beside = F.max(F.col("article") != "").over(of_law)
    return first.withColumn("redundant", (F.col("article") == "") & (F.col("law") != "unknown") & beside)


def drop_policy(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Rows without the (number, article) pairs that a policy removes from all lists alike."""
    hit = F.lit(False)
    for number, article in pairs:
        hit = hit | ((F.col("law_no") == number) & (F.col("article") == article))
    return rows.where(~hit)


def verdicts(claimed: DataFrame, reference: str = "reference", candidate: str = "candidate") -> DataFrame:
    """doc_id, law, article, verdict as flags tp, fp, fn, excused_reference, excused_candidate for each identity.

    A full outer join on the identity, done as one aggregation over both lists. An excused law row of the truth that a candidate
    also has, not redundant there, is extra; a row without any law is unread in the truth and extra in the candidate.
    """
    on = lambda side, c: F.max(F.when(F.col("side") == side, c))
    both = claimed.where(F.col("side").isin(reference, candidate)).groupBy("doc_id", "law", "article").agg(
        F.coalesce(on(reference, F.lit(True)), F.lit(False)).alias("r"),
        F.coalesce(on(candidate, F.lit(True)), F.lit(False)).alias("c"),
        F.coalesce(on(reference, F.col("redundant")), F.lit(False)).alias("rr"),
        F.coalesce(on(candidate, F.col("redundant")), F.lit(False)).alias("cr"),
        on(reference, F.col("numbered")).alias("r_numbered"),
        on(candidate, F.col("numbered")).alias("c_numbered"),
        on(reference, F.col("name_key")).alias("r_name"),
        on(candidate, F.col("name_key")).alias("c_name"),
    )
    known, truth = F.col("law") != "unknown", F.col("r") & ~F.col("rr")
    return both.withColumns({
        "tp": (known & truth & F.col("c")).cast("long"),
        "fn": (known & truth & ~F.col("c")).cast("long"),
        "fp": (F.col("c") & (~known | (~truth & ~F.col("cr")))).cast("long"),
        "excused_reference": (known & F.col("rr")).cast("long"),
        "excused_candidate": (known & F.col("cr") & ~truth).cast("long"),
    })


def verdicts_by_method(claimed: DataFrame, methods: tuple[str, ...], reference: str = "reference") -> DataFrame:
    """``verdicts``' flags of several candidates against one reference, with ``method``: one aggregation over all lists."""
    on = lambda side, c: F.coalesce(F.bool_or(F.when(F.col("side") == side, c)), F.lit(False))
    both = claimed.where(F.col("side").isin(reference, *methods)).groupBy("doc_id", "law", "article").agg(
        on(reference, F.lit(True)).alias("r"), on(reference, F.col("redundant")).alias("rr"),
        *[F.struct(F.lit(m).alias("method"), on(m, F.lit(True)).alias("c"), on(m, F.col("redundant")).alias("cr")).alias(m) for m in methods],
    )
    rows = both.select("doc_id", "law", "article", "r", "rr", F.explode(F.array(*methods)).alias("x")).select("doc_id", "law", "article", "r", "rr", "x.*").where("r OR c")
    known, truth, c, cr = F.col("law") != "unknown", F.col("r") & ~F.col("rr"), F.col("c"), F.col("cr")
    flags = {"tp": known & truth & c, "fn": known & truth & ~c, "fp": c & (~known | (~truth & ~cr)), "excused_reference": known & F.col("rr"), "excused_candidate": known & cr & ~truth}
    return rows.select("method", "doc_id", "law", "article", *[f.cast("long").alias(n) for n, f in flags.items()])


def compare_lists(rows: DataFrame, reference: str = "reference", candidate: str = "candidate", aligned: bool = False, tables: tuple | None = None) -> DataFrame:
    """``verdicts`` of spelt rows; every side's rows take part in the alignment, so further lists are context."""
    rows = rows if aligned else align(rows.repartition("doc_id"), *(tables or (None, None)))
    return verdicts(claims(identify(rows)), reference, candidate)


def by_document(verdict_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, excused counts, agree and similarity of each document (and of each of ``by``)."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "excused_reference", "excused_candidate")]
    out = verdict_rows.groupBy(*by, "doc_id").agg(*sums)
    whole = F.col("tp") + F.col("fp") + F.col("fn")
    return out.withColumns({"agree": (F.col("fp") == 0) & (F.col("fn") == 0), "similarity": F.when(whole == 0, 1.0).otherwise(F.col("tp") / whole)})


def diagnostics(claimed: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """The counters of a comparison, summed over all documents, in one row."""
    known, article = F.col("law") != "unknown", F.col("article") != ""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    sides = []
    for side, name in (("reference", "gold"), ("candidate", "prediction")):
        here = F.col("side") == side
        sides += [count(here & known).alias(f"eligible_{name}"), count(here & known & article).alias(f"eligible_{name}_article"), count(here & known & ~article).alias(f"eligible_{name}_law"), count(here & ~known).alias(f"no_law_{name}"), F.coalesce(F.sum(F.when(here, F.col("copies") - 1)), F.lit(0)).alias(f"repeated_{name}")]
    tp = F.col("tp") == 1
    matched = verdict_rows.agg(
        count(tp & article).alias("matched_article"), count(tp & ~article).alias("matched_law"),
        count(tp & F.col("r_numbered") & F.col("c_numbered")).alias("matched_by_number"),
        count(tp & ~(F.col("r_numbered") & F.col("c_numbered"))).alias("matched_by_name"),
        count(tp & (F.col("r_name") != "") & (F.col("c_name") != "") & (F.col("r_name") != F.col("c_name"))).alias("name_conflicts"),
        count(F.col("excused_reference") == 1).alias("excused_gold"), count(F.col("excused_candidate") == 1).alias("excused_prediction"),
    )
    return claimed.agg(*sides).join(F.broadcast(matched), F.lit(True))  # one row beside one row


def match_rates(verdict_rows: DataFrame) -> DataFrame:
    """Of the truth's references: matched, and matched by numbers that both sides wrote."""
    tp, truth = F.col("tp") == 1, (F.col("tp") + F.col("fn")) == 1
    share = lambda c: F.when(F.count_if(truth) > 0, F.count_if(c) / F.count_if(truth))
    return verdict_rows.agg(share(tp & F.col("r_numbered") & F.col("c_numbered")).alias("by_number"), share(tp).alias("matched"))


def difference(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Identities of two lists: status same, only_a or only_b, with each side's copies and whether it is subsumed there."""
    c = claims(identify(rows))
    on = lambda side, x: F.max(F.when(F.col("side") == side, x))
    out = c.where(F.col("side").isin(a, b)).groupBy("doc_id", "law", "article").agg(F.coalesce(on(a, F.col("copies")), F.lit(0)).alias("copies_a"), F.coalesce(on(b, F.col("copies")), F.lit(0)).alias("copies_b"), F.coalesce(F.max("redundant"), F.lit(False)).alias("subsumed"))
    status = F.when((F.col("copies_a") > 0) & (F.col("copies_b") > 0), "same").when(F.col("copies_a") > 0, "only_a").otherwise("only_b")
    return out.withColumn("status", status)


def compact(rows: DataFrame) -> DataFrame:
    """The list without repeated identities and without laws beside an article of theirs: the first row of each stays."""
    return claims(identify(rows)).where("NOT redundant").select("doc_id", "side", "pos", "law", "article")


def conflicting_laws(rows: DataFrame) -> DataFrame:
    """doc_id, conflict: in one of its lists some number carries more than one particular name."""
    names = rows.groupBy("doc_id", "side", "law_no").agg(F.count_distinct(F.when((F.col("law_no") != "") & (F.col("name_key") != ""), F.col("name_key"))).alias("n"))
    return names.groupBy("doc_id").agg((F.max("n") > 1).alias("conflict"))


def route(compared: DataFrame, conflicts: DataFrame, ready: Column, parsed: Column, truncated: Column | None = None, safe: Column | None = None) -> DataFrame:
    """bucket and reasons of each document: unusable ones to QUARANTINE, contradictory ones to RED, disagreeing ones to RED, else GREEN;
    only the reasons of the first of these that holds."""
    truncated, safe = F.lit(False) if truncated is None else truncated, F.lit(True) if safe is None else safe
    rows = compared.join(conflicts, "doc_id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    said = lambda *pairs: F.array_join(F.filter(F.array(*[F.when(c, w) for c, w in pairs]), lambda x: x.isNotNull()), ",")
    unusable = ~ready | ~parsed | truncated | ~safe
    bucket = F.when(unusable, "QUARANTINE").when(F.col("conflict") | ~F.col("agree"), "RED").otherwise("GREEN")
    gates = said((~ready, "preparation_hard_error"), (~parsed, "model_processing_error"), (truncated, "model_output_truncated"), (~safe, "safe_text_missing"))
    differs = said((F.col("fn") > 0, "missing_core_reference"), (F.col("fp") > 0, "extra_or_different_core_reference"))
    reasons = F.when(unusable, gates).when(F.col("conflict"), "conflicting_law_identity").when(~F.col("agree"), differs).otherwise("normalized_law_article_set_equal")
    return rows.withColumns({"bucket": bucket, "reasons": reasons})
