"""The evaluator: its universe of documents, views of lists, scores of methods, and the choices made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dimensions as d
from .compare import align, by_document, claims, identify, verdicts_by_method
from .metrics import f1, precision_recall, ratio


def universe(gold: DataFrame, predictions: DataFrame, wanted: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key and ``state`` of each document that the evaluation has to account for: evaluated, no_gold (wanted but without a truth: left out),
    or no_prediction (evaluated against an empty list). Without ``wanted`` all documents with a truth are meant."""
    ids = lambda df, flag: df.select(key, *[F.lit(f == flag).alias(f) for f in ("gold", "predicted", "wanted")])
    every = ids(gold, "gold").union(ids(predictions, "predicted")).union(ids(gold if wanted is None else wanted, "wanted"))
    flags = every.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in ("gold", "predicted", "wanted")]).where("wanted")
    return flags.select(key, F.when(~F.col("gold"), "no_gold").when(~F.col("predicted"), "no_prediction").otherwise("evaluated").alias("state"))


def drop_ignored(rows: DataFrame, ignored: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame]:
    """(rows without the ignored law and article pairs, their counts by side): both sides alike; a row without a number goes by its law's
    name. rows: side, law_no, law_name, article."""
    numbers = F.create_map(*[F.lit(x) for pair in d.NUMBER_BY_NAME.items() for x in pair])
    number = F.coalesce(F.nullif(F.col("law_no"), F.lit("")), F.element_at(numbers, F.col("law_name")), F.lit(""))
    hit = F.lit(False)
    for law, article in ignored:
        hit = hit | ((number == law) & (F.col("article") == article))
    marked = rows.withColumn("__hit", hit)
    return marked.where("NOT __hit").drop("__hit"), marked.groupBy("side").agg(F.count_if("__hit").alias("ignored"))


def _score(status: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return F.when(s == "approved", 2).when(s != "", 1).otherwise(0)


def core_view(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The core-set view: of rows with one law and article the one with the best status, then a quote, then the first; it takes the first
    one's place. Rows without article or law stay as they are. rows: by, pos, law_no, law_name, article, status, source_text."""
    core = (F.col("article") != "") & ((F.col("law_no") != "") | (F.col("law_name") != ""))
    same = Window.partitionBy(*by, "law_no", "law_name", "article")
    rank = F.struct(_score(F.col("status")), (F.col("source_text") != "").cast("int"), -F.col("pos"))
    marked = rows.withColumns({"__core": core, "__best": F.max(rank).over(same), "__first": F.min("pos").over(same)})
    kept = marked.where(~F.col("__core") | (rank == F.col("__best")))
    return kept.withColumn("pos", F.when(F.col("__core"), F.col("__first")).otherwise(F.col("pos"))).drop("__core", "__best", "__first")


def view_summary(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, rows before and after, rows removed, and documents whose list changed."""
    counts = before.groupBy(key).agg(F.count("*").alias("b")).join(after.groupBy(key).agg(F.count("*").alias("a")), key, "left").withColumn("a", F.coalesce("a", F.lit(0)))
    return counts.agg(F.count("*").alias("docs"), F.sum("b").alias("rows_before"), F.sum("a").alias("rows_after"), F.sum(F.col("b") - F.col("a")).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed_docs"))


#: names that name no law of their own
GENERIC = ("", "kanun", "kanunu")


def legacy_compaction(rows: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows with ``fate``: kept, generic (a law alone beside an article of it), generic_duplicate (one of several law rows, not the best) or
    duplicate (not the best of one law, name and article).

    The best has the best status, then comes from the existing list, then names its law most fully, then has an article, a quote, the
    first place. rows: by, pos, law_no, law_name, article, status, origin, source_text.
    """
    number, name, article = F.col("law_no"), F.col("law_name"), F.col("article")
    family = F.when(number != "", F.concat(F.lit("no:"), number)).when(~F.lower(name).isin(*GENERIC), F.concat(F.lit("name:"), F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "")))
    full = F.when((number != "") & (name != ""), 3).when(number != "", 2).when(name != "", 1).otherwise(0)
    rank = F.struct(_score(F.col("status")), (F.col("origin") == "existing").cast("int"), full, (article != "").cast("int"), (F.col("source_text") != "").cast("int"), -F.col("pos"))
    marked = rows.withColumns({"__f": family, "__r": rank})
    of_law = Window.partitionBy(*by, "__f")
    marked = marked.withColumns({"__specific": F.max(article != "").over(of_law), "__general": F.max(F.when(article == "", F.col("__r"))).over(of_law)})
    law_row = F.col("__f").isNotNull() & (article == "")
    fate = F.when(law_row & F.col("__specific"), "generic").when(law_row & (F.col("__r") < F.col("__general")), "generic_duplicate")
    marked = marked.withColumn("fate", fate)
    survivors = Window.partitionBy(*by, "law_no", "law_name", "article", F.col("fate").isNull())
    best = F.max("__r").over(survivors)
    return marked.withColumn("fate", F.coalesce("fate", F.when(F.col("__r") < best, "duplicate"), F.lit("kept"))).drop("__f", "__r", "__specific", "__general")


def compaction_summary(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    fate, existing = F.col("fate"), F.col("origin") == "existing"
    return rows.agg(n(fate == "generic").alias("dropped_generic_due_to_specific"), n(fate == "generic_duplicate").alias("collapsed_generic_only_duplicates"), n(fate == "duplicate").alias("collapsed_same_reference_duplicates"), n((fate != "kept") & existing).alias("removed_existing_rows"), n((fate == "kept") & ~existing).alias("added_new_rows"))


def name_consistency(number: Column, name: Column) -> tuple[Column, Column]:
    """Whether a row's name is that of its number, and its number that of its name; null where one is not known."""
    names = F.create_map(*[F.lit(x) for pair in d.LAW_BY_NUMBER.items() for x in pair])
    numbers = F.create_map(*[F.lit(x) for pair in d.NUMBER_BY_NAME.items() for x in pair])
    given = (number != "") & ~F.lower(name).isin(*GENERIC)
    return F.when(given, name == F.element_at(names, number)), F.when(given, number == F.element_at(numbers, name))


def evaluate(rows: DataFrame, methods: tuple[str, ...], docs: DataFrame, threshold: float = 1.0) -> DataFrame:
    """A line for each method: documents, micro counts and ratios, and how many documents reach ``threshold``. rows: all sides' lists, aligned and
    compared once for all methods; docs: the universe; documents without rows count as empty against empty."""
    claimed = claims(identify(align(rows.repartition("doc_id"))))
    scored = by_document(verdicts_by_method(claimed, methods), ("method",))
    due = docs.where("state <> 'no_gold'").select("doc_id", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    per = due.join(scored, ["doc_id", "method"], "left").fillna(0, ["tp", "fp", "fn"])
    score = f1(F.col("tp"), F.col("fp"), F.col("fn"), 1.0)
    out = per.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("docs"), F.count_if(score >= threshold).alias("passed"))
    return out.withColumns(precision_recall()).withColumns({"accuracy": ratio(F.col("passed"), F.col("docs")), "threshold": F.lit(threshold)})


def report(results: DataFrame) -> DataFrame:
    """Two lines a method, as a table of texts: the core metric and the documents' accuracy."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit("")
    core = {"metric": F.lit("core"), "precision": six("precision"), "recall": six("recall"), "f1": six("f1"), "tp": text("tp"), "fp": text("fp"), "fn": text("fn"), "accuracy": none, "threshold": none, "passed": none, "failed": none}
    docwise = {**dict.fromkeys(core, none), "metric": F.lit("docwise"), "accuracy": six("accuracy"), "threshold": six("threshold"), "passed": text("passed"), "failed": (F.col("docs") - F.col("passed")).cast("string")}
    lines = [results.select("method", *[v.alias(k) for k, v in part.items()], "docs") for part in (core, docwise)]
    return lines[0].unionByName(lines[1])


def selection_problems(rows: DataFrame, eligible: Column, keys: tuple[Column, ...], by: str, chosen: Column) -> DataFrame:
    """Groups whose chosen row is not eligible, or is outranked by an eligible one, or that chose no row or several."""
    key = F.struct(*keys)
    out = rows.groupBy(by).agg(F.count_if(chosen).alias("chosen"), F.bool_and(F.when(chosen, eligible)).alias("fit"), F.max(F.when(chosen, key)).alias("mine"), F.max(F.when(eligible, key)).alias("best"))
    problem = F.when(F.col("chosen") != 1, "not_one").when(~F.col("fit"), "not_eligible").when(F.col("mine") < F.col("best"), "outranked")
    return out.select(by, problem.alias("problem")).where("problem IS NOT NULL")


def ranked(rows: DataFrame, by: tuple[str, ...], keys: tuple[Column, ...]) -> DataFrame:
    """``rank`` from 1 in the order of ``keys`` within each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys)))


def rescored(old: DataFrame, new: DataFrame, key: str, score: str) -> DataFrame:
    """key, old, new, change, and whether the row is the best one by the old and by the new score (ties: the least key)."""
    both = old.select(key, F.col(score).alias("old")).join(new.select(key, F.col(score).alias("new")), key)
    best = both.agg(F.max_by(key, F.struct("old", -F.col(key))).alias("__o"), F.max_by(key, F.struct("new", -F.col(key))).alias("__n"))
    out = both.join(F.broadcast(best), F.lit(True))  # one row beside each
    return out.select(key, "old", "new", (F.col("new") - F.col("old")).alias("change"), (F.col(key) == F.col("__o")).alias("best_before"), (F.col(key) == F.col("__n")).alias("best_now"))


def sequence_length(lengths: DataFrame, value: str, candidates: tuple[int, ...]) -> DataFrame:
    """The longest length, and the least candidate that holds it (null if none does)."""
    longest = lengths.agg(F.max(value).alias("longest"))
    fitting = F.filter(F.array(*[F.lit(c) for c in sorted(candidates)]), lambda c: c >= F.col("longest"))
    return longest.withColumn("chosen", F.get(fitting, F.lit(0)))
