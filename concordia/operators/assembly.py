"""A round put together: its records, truths, tables, gates, training sets and corrections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dimensions as d
from .compare import claims, drop_policy, verdicts_by_method
from .metrics import precision_recall
from .sampling import hash_order


def round_records(documents: DataFrame, reviews: DataFrame, predictions: DataFrame, judges: DataFrame, events: DataFrame, flags: dict[str, DataFrame], generation: str) -> DataFrame:
    """A row for each document with its review, its successful prediction of the generation, its judge's valid verdict, the seconds spent on it,
    and one boolean for each named set of documents. All are left joins on doc_id, each side made unique first."""
    ok = predictions.where((F.col("generation") == generation) & (F.col("status") == "success")).groupBy("doc_id").agg(F.max_by("prediction", "created").alias("prediction"))
    valid = judges.where("valid").groupBy("doc_id").agg(F.max_by("verdict", "created").alias("verdict"))
    spent = events.where("seconds >= 0").groupBy("doc_id").agg(F.sum("seconds").alias("seconds"))
    out = documents
    for side in (reviews, ok, valid, spent):
        out = out.join(side, "doc_id", "left")
    for name, ids in flags.items():
        out = out.join(ids.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def scoped_truth(records: DataFrame, scope: str) -> DataFrame:
    """doc_id, truth_source (expert, consensus or null) under a scope. ``reviewed``: finalized reviews only. ``batch``: also unreviewed GREEN
    documents, if no audit is open and nothing escalated. records: doc_id, status, bucket, audit, escalated."""
    if scope not in ("reviewed", "batch"):
        raise ValueError(f"unknown scope {scope!r}")
    passed = records.agg((~F.coalesce(F.bool_or("escalated"), F.lit(False)) & F.coalesce(F.bool_and(F.when(F.col("audit"), F.col("status") == "finalized")), F.lit(True))).alias("__passed"))
    source = F.when(F.col("status") == "finalized", "expert")
    if scope == "batch":
        source = source.when((F.col("bucket") == "GREEN") & F.col("__passed"), "consensus")
    return records.join(F.broadcast(passed), F.lit(True)).withColumn("truth_source", source).drop("__passed")  # one row beside each


def green_audit(sample: DataFrame, escalated: bool = False) -> DataFrame:
    """One row: how the audit of a GREEN sample stands. sample: status, changed (the final list differs, null before)."""
    n = lambda c: F.count_if(c)
    status = F.col("status")
    out = sample.agg(F.count("*").alias("sample"), n(status == "finalized").alias("finalized"), n(status == "deferred").alias("deferred"), n(status == "pending").alias("pending"), n((status == "finalized") & F.col("changed")).alias("changed"))
    return out.withColumn("state", F.when(F.lit(escalated) | (F.col("changed") > 0), "escalation_required").when(F.col("finalized") == F.col("sample"), "passed").otherwise("pending"))


def error_blocks(bits: DataFrame, raters: tuple[str, ...], decided: DataFrame, locked_at) -> DataFrame:
    """block (all, before_lock, after_lock), rater, documents, tp, fp, fn and ratios: decisions apart by whether they came before the judge
    was locked (all of them, without a lock). decided: doc_id, decided_at."""
    before = F.lit(True) if locked_at is None else F.col("decided_at") < F.lit(locked_at)
    blocks = F.array(F.lit("all"), F.when(before, "before_lock").otherwise("after_lock"))
    each = F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("bit")) for r in raters])
    rows = bits.join(decided, "doc_id").select("doc_id", "truth", F.explode(each).alias("x"), blocks.alias("blocks")).select("doc_id", "truth", "x.*", F.explode("blocks").alias("block"))
    n = lambda c: F.sum(c.cast("long"))
    b, t = F.col("bit") == 1, F.col("truth") == 1
    out = rows.groupBy("block", "rater").agg(n(b & t).alias("tp"), n(b & ~t).alias("fp"), n(~b & t).alias("fn"))
    return out.withColumns(precision_recall(1.0))


def reference_tables(rows: DataFrame, sources: tuple[str, ...], policy: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """A line for each source: rows it wrote and the policy dropped, repeats, law rows covered by an article, references, and how they fare
    against the truth. rows: all sides' identified rows, clustered by doc_id; every step but the last sums stays with a document."""
    hit = F.lit(False)
    for number, article in policy:
        hit = hit | ((F.col("law_no") == number) & (F.col("article") == article))
    own = rows.where(F.col("side").isin(*sources)).groupBy("doc_id", "side", "law", "article", hit.alias("hit")).agg(F.count("*").alias("n"))
    kept = lambda c: F.coalesce(F.sum(F.when(~F.col("hit"), c)), F.lit(0))
    by_doc = own.groupBy("doc_id", "side").agg(kept(F.col("n")).alias("w"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("d"), kept(F.lit(1)).alias("k"))
    written = by_doc.groupBy(F.col("side").alias("source")).agg(F.count("*").alias("documents"), F.sum("w").alias("written_rows"), F.sum("d").alias("policy_dropped"), F.sum("k").alias("__distinct"))
    scored = verdicts_by_method(claims(drop_policy(rows, policy)), sources)
    scored = scored.groupBy(F.col("method").alias("source")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.sum("excused_candidate").alias("subsumed_rows"))
    out = written.join(scored, "source", "left").fillna(0, ["tp", "fp", "fn", "subsumed_rows"])
    out = out.withColumns({"duplicate_rows": F.col("written_rows") - F.col("__distinct"), "written_references": F.col("tp") + F.col("fp"), "truth_references": F.col("tp") + F.col("fn")})
    return out.withColumns(precision_recall(1.0)).drop("__distinct")


def promotion_gates(m: DataFrame) -> DataFrame:
    """The gates of a candidate, by name, with those that fail. m: one row a candidate, columns base_*, canonical_*, augmented_* and g0_* of
    f1, docwise and recall, and ci_lower, coverage, parsed, truncated, runaway, expected."""
    c = F.col
    gates = {
        "coverage": c("coverage") == c("expected"), "parse": c("parsed") == c("expected"), "truncation_zero": c("truncated") == 0, "runaway_zero": c("runaway") == 0,
        "f1_above_base": c("augmented_f1") > c("base_f1"), "interval_nonnegative": c("ci_lower") >= 0, "docwise_not_below_base": c("augmented_docwise") >= c("base_docwise"),
        "recall_drop_vs_base": c("augmented_recall") >= c("base_recall") - 0.005, "f1_drop_vs_canonical": c("augmented_f1") >= c("canonical_f1") - 0.005,
        "recall_drop_vs_canonical": c("augmented_recall") >= c("canonical_recall") - 0.005, "f1_above_g0": c("augmented_f1") > c("g0_f1"), "docwise_above_g0": c("augmented_docwise") > c("g0_docwise"),
    }
    failed = F.filter(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]), lambda x: x.isNotNull())
    return m.withColumn("failed", failed).withColumn("promote", F.size("failed") == 0)


#: empty answers on documents with references that make a collapse
COLLAPSE = 3


def collapse_gate(by_doc: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """predicted references, empty answers on documents that have some, and whether the model collapsed."""
    empty = (F.col("tp") + F.col("fp") == 0) & (F.col("fn") > 0)
    out = by_doc.groupBy(*by).agg(F.sum(F.col("tp") + F.col("fp")).alias("predicted"), F.count_if(empty).alias("empty_answers"))
    return out.withColumn("collapsed", (F.col("predicted") <= 0) | (F.col("empty_answers") >= COLLAPSE))


def status_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents by state of their output: errors that are no truncations failed to parse. rows: status, truncated."""
    error = F.col("status") == "error"
    out = rows.groupBy(*by).agg(F.count("*").alias("docs"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(error).alias("errors"), F.count_if("truncated").alias("truncations"), F.count_if(error & F.col("truncated")).alias("__both"))
    return out.withColumn("parse_failures", F.col("errors") - F.col("__both")).drop("__both")


def merged_gold(rows: DataFrame) -> DataFrame:
    """Each identity of a document once, at its first row's place, with the distinct quotes of all its rows in order."""
    quotes = F.transform(F.array_sort(F.collect_list(F.when(F.col("source_text") != "", F.struct("pos", "source_text")))), lambda x: x["source_text"])
    return rows.groupBy("doc_id", "law", "article").agg(F.min("pos").alias("pos"), F.array_distinct(quotes).alias("quotes"))


def training_problems(canonical: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(round, doc_id, problem) of cleaned documents that must not join the canonical training set: no id, one that reads as a number, or one
    that is there already or in an earlier round. canonical: doc_id; cleaned: round, doc_id."""
    i = F.col("doc_id")
    own = cleaned.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("round").alias("first"))
    rows = cleaned.join(own, "doc_id", "left").join(canonical.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().withColumn("known", F.lit(True)), "doc_id", "left")
    problem = F.when(i.isNull() | (i == ""), "unusable").when(F.trim(i).rlike("^[+-]*[0-9]+$"), "numeric").when(F.col("known") | ((F.col("n") > 1) & (F.col("round") > F.col("first"))), "already_there")
    return rows.select("round", "doc_id", problem.alias("problem")).where("problem IS NOT NULL")


def exact_split(rows: DataFrame, test: int, validation: int, namespace: str, forced: Column | None = None, key: str = "doc_id") -> DataFrame:
    """``split`` with exactly ``test`` and ``validation`` rows, the least hashes first; ``forced`` rows are for training. Only as many rows as
    are held out are ever sorted: a top-k, sent back to all rows."""
    eligible = rows if forced is None else rows.where(~forced)
    held = eligible.select(F.col(key).alias("__k"), hash_order(namespace, key).alias("__h")).orderBy("__h").limit(test + validation)
    place = F.row_number().over(Window.orderBy("__h"))
    held = held.withColumn("__split", F.when(place <= test, "test").otherwise("validation")).drop("__h")
    return rows.join(F.broadcast(held), F.col(key) == F.col("__k"), "left").withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__k", "__split")


def split_check(rows: DataFrame, every: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows in two splits, rows of ``every`` in none, and split rows that are not of ``every``."""
    flags = rows.select(key, F.lit(1).alias("s"), F.lit(0).alias("e")).union(every.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.sum("s").alias("s"), F.max("e").alias("e"))
    return flags.agg(F.count_if(F.col("s") > 1).alias("in_two"), F.count_if(F.col("s") == 0).alias("uncovered"), F.count_if(F.col("e") == 0).alias("strangers"))


def remainder(pool: DataFrame, dealt: DataFrame, key: str = "doc_id") -> DataFrame:
    """What no batch took."""
    return pool.join(dealt.select(key), key, "left_anti")


def set_fingerprint(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """rows and a fingerprint of (key, payload) that does not depend on order: digests of buckets by the hash's own digits, of buckets of
    those, down to one, so no row ever holds more than a few thousand digests where a level has 4096 buckets."""
    leaves = rows.select(F.sha2(F.concat_ws("\n", F.col(key).cast("string"), payload), 256).alias("h"))
    level = leaves.groupBy(F.substring("h", 1, 6).alias("b"), "h").agg(F.count("*").alias("n")).select("b", F.concat_ws(":", "h", F.col("n").cast("string")).alias("h"), "n")
    for digits in (6, 3):
        level = level.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h"), F.sum("n").alias("n"))
    return level.agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256).alias("fingerprint"))


def reference_band(count: Column) -> Column:
    n = count.cast("int")
    return F.when(n.isNull(), "unknown").when(n == 0, "zero").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")


def transitions_of(before: DataFrame, after: DataFrame, every: tuple[str, ...]) -> DataFrame:
    """How documents move between buckets when they are routed again: all pairs, zeros included."""
    from .records import transitions

    both = before.select("doc_id", F.col("bucket").alias("before")).join(after.select("doc_id", F.col("bucket").alias("after")), "doc_id")
    return transitions(both, "before", "after", every)


def versioned(events: DataFrame) -> DataFrame:
    """Writes to keyed rows, with ``accepted``: a write counts if it expects the version that the accepted writes before it left. As a refused
    write leaves the version as it is, each key is folded in order. events: key, seq, expected."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def fold(expected: pd.Series) -> pd.Series:
        def one(values):
            version, out = 0, []
            for e in values:
                out.append(e == version)
                version += e == version
            return out

        return expected.map(one)

    lists = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "expected"))).alias("w"))
    folded = lists.select("key", "w", fold(F.transform("w", lambda x: x["expected"])).alias("a"))
    return folded.select("key", F.explode(F.arrays_zip("w", "a")).alias("x")).select("key", "x.w.seq", "x.w.expected", F.col("x.a").alias("accepted"))


ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("law_no", "law_name", "article", "source_text")])
FIX = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("law_no", "article", "new_law_no", "new_law_name", "new_article")], T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])


def corrected(rows: list[dict], fixes: list[dict]) -> tuple[list[dict], list[int]]:
    """The list after the fixes in their order, and the places of fixes that did not apply.

    ``range``: the articles between two that the list holds follow the lower one, but for those held already. ``remove`` drops every row of
    a law and article; ``replace`` puts another there instead of the first, unless the list holds it."""
    rows, stale = [dict(r) for r in rows], []
    at = lambda law, article: [i for i, r in enumerate(rows) if (r["law_no"], r["article"]) == (law, article)]
    for k, fix in enumerate(fixes):
        law = fix["law_no"]
        if fix["kind"] == "range":
            low, high = at(law, str(fix["low"])), at(law, str(fix["high"]))
            if not (low and high):
                stale.append(k)
                continue
            held = {r["article"] for r in rows if r["law_no"] == law}
            name = rows[low[0]]["law_name"]
            new = [{"law_no": law, "law_name": name, "article": str(n), "source_text": ""} for n in range(fix["low"] + 1, fix["high"]) if str(n) not in held]
            rows[low[0] + 1 : low[0] + 1] = new
            continue
        hits = at(law, fix["article"])
        if not hits:
            stale.append(k)
            continue
        rows = [r for i, r in enumerate(rows) if i not in hits]
        if fix["kind"] == "replace" and not at(fix["new_law_no"], fix["new_article"]):
            rows.insert(hits[0], {"law_no": fix["new_law_no"], "law_name": fix["new_law_name"] or "", "article": fix["new_article"], "source_text": ""})
    return rows, stale


def apply_in_order(rows: DataFrame, fixes: DataFrame) -> DataFrame:
    """doc_id, refs and stale of each document: ``corrected`` lists. rows: doc_id, pos and a reference's fields; fixes: doc_id, seq and a fix's.
    A list is one document's and short; each fix depends on those before it, so documents are folded in Arrow batches."""
    out = T.StructType([T.StructField("refs", T.ArrayType(ROW)), T.StructField("stale", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(out)
    def fold(refs: pd.Series, todo: pd.Series) -> pd.DataFrame:
        done = [corrected(list(r), list(f) if f is not None else []) for r, f in zip(refs, todo, strict=True)]
        return pd.DataFrame({"refs": [r for r, _ in done], "stale": [s for _, s in done]})

    gather = lambda df, order, kind: df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*kind.names).alias("x")))), lambda y: y["x"]).alias("l"))
    both = gather(rows, "pos", ROW).withColumnRenamed("l", "r").join(gather(fixes, "seq", FIX).withColumnRenamed("l", "f"), "doc_id", "left")
    return both.select("doc_id", fold("r", "f").alias("o")).select("doc_id", "o.*")


#: release tiers whose documents may be trained on
ELIGIBLE = ("expert_adjudicated", "consensus")


def release_problems(layers: DataFrame, training: DataFrame) -> DataFrame:
    """Documents in which a release's training file and its eligible layers differ: missing or not_eligible."""
    eligible = layers.where(F.col("tier").isin(*ELIGIBLE)).select("doc_id")
    one = eligible.join(training, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("problem"))
    return one.union(training.join(eligible, "doc_id", "left_anti").select("doc_id", F.lit("not_eligible")))


def sealed_predictions(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """Documents with their one prediction, and ``problem`` where a seal is broken: none or several, another document's text, another policy."""
    one = predictions.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text_sha256").alias("seen_sha256"), F.first("policy").alias("seen_policy"))
    rows = documents.join(one, "doc_id", "left")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several").when(F.col("seen_sha256") != F.col("text_sha256"), "text").when(F.col("seen_policy") != F.col("policy"), "policy")
    return rows.withColumn("problem", problem)


def laws_and_articles(rows: DataFrame) -> DataFrame:
    """(doc_id, law_no, articles): the sorted distinct articles of each numbered law of a list."""
    return rows.where("law_no <> ''").groupBy("doc_id", "law_no").agg(F.sort_array(F.collect_set("article")).alias("articles"))


def training_id(batch: Column, doc: Column) -> Column:
    """A document's identity beyond its batch: a JSON pair."""
    return F.to_json(F.array(batch.cast("string"), doc.cast("string")))


def names_of_policy(policy: str) -> tuple[tuple[str, str], ...]:
    """The pairs that a policy removes; an unknown one raises."""
    if policy not in d.POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    return d.POLICIES[policy]


def policy_fingerprint(policy: str) -> str:
    """sha256 of a policy's name and pairs, in canonical JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps({"policy": policy, "pairs": names_of_policy(policy)}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
