"""Aggregates over verdicts and raters: precision, agreement, distributions, resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n: Column, d: Column, empty: float | None = 0.0) -> Column:
    return F.when(d == 0, F.lit(empty).cast("double")).otherwise(n / d)


def f1(tp: Column, fp: Column, fn: Column, empty: float = 0.0) -> Column:
    """2 tp / (2 tp + fp + fn), the harmonic mean of precision and recall; ``empty`` without any reference."""
    return ratio(2.0 * tp, 2 * tp + fp + fn, empty)


def precision_recall(empty: float = 0.0) -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return {"precision": ratio(tp, tp + fp, empty), "recall": ratio(tp, tp + fn, empty), "f1": f1(tp, fp, fn, empty)}


def corpus_metrics(by_doc: DataFrame, by: tuple[str, ...] = (), empty: float = 0.0) -> DataFrame:
    """Micro sums and their ratios; one row, or one by group."""
    return by_doc.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], F.count("*").alias("docs")).withColumns(precision_recall(empty))


def f1_distribution(by_doc: DataFrame) -> DataFrame:
    """Documents' F1 (1.0 where there is nothing to find and nothing was found): counts, mean, median and two order statistics.

    The order statistics come from counts by distinct F1 value, a small table, not from a sort of all documents.
    """
    doc = by_doc.select(f1(F.col("tp"), F.col("fp"), F.col("fn"), 1.0).alias("v"))
    values = doc.groupBy("v").agg(F.count("*").alias("n"))
    upto, whole = Window.orderBy("v"), Window.partitionBy()
    placed = values.withColumn("last", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole)).withColumn("first", F.col("last") - F.col("n"))

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("first") <= index) & (index < F.col("last")), F.col("v")))

    n = F.col("total")
    half = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return placed.agg(
        F.coalesce(F.sum(F.when(F.col("v") == 1.0, F.col("n"))), F.lit(0)).alias("perfect"), F.coalesce(F.sum(F.when(F.col("v") == 0.0, F.col("n"))), F.lit(0)).alias("zero"),
        F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), half.alias("median"),
        at(F.greatest(F.lit(0), F.floor(n * 0.25) - 1)).alias("p25"), at(F.least(n - 1, F.floor(n * 0.75))).alias("p75"),
    )


def docwise_accuracy(by_doc: DataFrame, threshold: float = 1.0) -> DataFrame:
    score = f1(F.col("tp"), F.col("fp"), F.col("fn"), 1.0)
    return by_doc.agg(F.count("*").alias("docs"), F.count_if(score >= threshold).alias("passed")).withColumn("accuracy", ratio(F.col("passed"), F.col("docs")))


def deltas(metrics: DataFrame, baseline: DataFrame, key: str = "method", names: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    base = baseline.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in names])
    return metrics.join(base, F.col(key) == F.col("__k"), "left").select(key, *names, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_delta") for c in names])


# --- raters --------------------------------------------------------------------------------------------------------


def rater_bits(claimed: DataFrame, raters: tuple[str, ...], expert: str) -> DataFrame:
    """Each identity of a document with one flag a rater and ``truth`` for the expert: the item universe of agreement."""
    known = claimed.where((F.col("law") != "unknown") & ~F.col("redundant") & F.col("side").isin(*raters, expert))
    flag = lambda s: F.max(F.when(F.col("side") == s, 1).otherwise(0))
    return known.groupBy("doc_id", "law", "article").agg(*[flag(r).alias(r) for r in raters], flag(expert).alias("truth"))


def rater_scores(bits: DataFrame, raters: tuple[str, ...]) -> DataFrame:
    """rater, tp, fp, fn, precision, recall, f1, only_correct; one scan, a row a rater."""
    rows = bits.select("doc_id", "truth", F.explode(F.array(*[F.struct(F.lit(r).alias("rater"), F.col(r).alias("bit"), sum((F.col(o) for o in raters if o != r), F.lit(0)).alias("others")) for r in raters])).alias("x")).select("doc_id", "truth", "x.*")
    n = lambda c: F.sum(c.cast("long"))
    b, t = F.col("bit") == 1, F.col("truth") == 1
    out = rows.groupBy("rater").agg(n(b & t).alias("tp"), n(b & ~t).alias("fp"), n(~b & t).alias("fn"), n(b & t & (F.col("others") == 0)).alias("only_correct"))
    return out.withColumns(precision_recall(1.0))


def kappa(bits: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two flags; null without items or when chance alone agrees."""
    x, y = F.col(a), F.col(b)
    sums = bits.agg(F.count("*").alias("items"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("pa"), F.avg(y).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return sums.select("items", "agreement", F.when((F.col("items") > 0) & (chance < 1), (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def fleiss(bits: DataFrame, raters: tuple[str, ...]) -> DataFrame:
    k = len(raters)
    yes = sum((F.col(r) for r in raters), F.lit(0))
    sums = bits.agg(F.count("*").alias("items"), F.avg((yes * (yes - 1) + (k - yes) * (k - yes - 1)) / float(k * (k - 1))).alias("agreement"), F.avg(yes / float(k)).alias("p"))
    chance = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return sums.select("items", "agreement", F.when((F.col("items") > 0) & (chance < 1), (F.col("agreement") - chance) / (1 - chance)).alias("kappa"))


def complementarity(bits: DataFrame, a: str, b: str, judge: str) -> DataFrame:
    """Who found the expert's references, and who shares an error."""
    x, y, z, t = (F.col(c) == 1 for c in (a, b, judge, "truth"))
    n = lambda c: F.sum(c.cast("long"))
    out = bits.agg(n(t).alias("truth"), n(t & x).alias("found_a"), n(t & y).alias("found_b"), n(t & z).alias("found_judge"), n(t & x & y).alias("both"), n(t & (x | y)).alias("either"), n(t & ~x & ~y).alias("neither"), n(t & ~x & ~y & ~z).alias("none_of_three"), n(~t & x & y).alias("wrong_in_both"))
    return out.withColumn("union_recall", ratio(F.col("either"), F.col("truth"), None))


def edit_distance(bits: DataFrame, a: str, b: str, has: DataFrame) -> DataFrame:
    """Each document's fewest edits from a rater's list to the expert's, and whose list it is (ties: the first rater's). A rater without a
    list (has: doc_id, has_a, has_b) is not a candidate; without either, both columns are null."""
    apart = lambda r, h: F.when(F.bool_or(h), F.sum((F.col(r) != F.col("truth")).cast("long")))
    by = bits.join(has, "doc_id").groupBy("doc_id").agg(apart(a, "has_a").alias("da"), apart(b, "has_b").alias("db"))
    closest = F.when(F.col("da").isNull() & F.col("db").isNull(), None).when(F.col("da").isNull() | (F.col("db") < F.col("da")), b).otherwise(a)
    return by.select("doc_id", F.least("da", "db").alias("distance"), closest.alias("closest"))


# --- operations ----------------------------------------------------------------------------------------------------


def distribution(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """measured, unusable (NaN and infinities; nulls are skipped), mean, least, most, total and nearest-rank percentiles of a measure,
    rounded to 4 places."""
    raw = F.col(value).cast("double")
    v = F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __v)")
    rounded = [F.round(x, 4).alias(n) for x, n in ((F.avg("__v"), "mean"), (F.min("__v"), "least"), (F.max("__v"), "most"), (F.sum("__v"), "total"))]
    rounded += [F.round(rank(p), 4).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.95, 0.99)]
    return rows.withColumn("__v", v).groupBy(*by).agg(F.count("__v").alias("measured"), (F.count(value) - F.count("__v")).alias("unusable"), *rounded)


def action_counts(rows: DataFrame, column: str, every: tuple[str, ...]) -> DataFrame:
    """Counts of all values in ``every``, also those that do not occur."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in every], f"{column} string")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def trend(rounds: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """A measure by round with its change since the round before."""
    w = Window.partitionBy(by).orderBy(order)
    return rounds.withColumn("before", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("before"))


def best_candidate(rows: DataFrame, eligible: Column, keys: tuple[Column, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The eligible row with the lexicographically greatest keys, a struct ``best``."""
    return rows.where(eligible).groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(*keys)).alias("best"))


def bootstrap_delta(by_doc: DataFrame, draws: int = 200, seed: str = "42") -> DataFrame:
    """Paired bootstrap of F1 differences between two methods, in one pass.

    by_doc: doc_id and tp, fp, fn of methods a and b. Instead of drawing documents in turn, each document gets for every draw a
    Poisson(1) weight from a hash of (seed, draw, doc_id): independent of partitioning and with a partial aggregate a draw.
    """
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    steps, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum((F.when(F.col("u") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    rows = by_doc.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("u", u).withColumn("w", weight)
    sums = rows.groupBy("draw").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in ("a_tp", "a_fp", "a_fn", "b_tp", "b_fp", "b_fn")])
    fa, fb = (f1(F.col(f"{m}_tp"), F.col(f"{m}_fp"), F.col(f"{m}_fn")) for m in "ab")
    return sums.select("draw", (fb - fa).alias("delta"))


def bootstrap_resamples(by_doc: DataFrame, draws: int = 10_000, seed: int = 42, block: int = 100) -> DataFrame:
    """(draw, delta) of resamples with replacement, as many documents each as there are; F1 is 0 where nothing is found or missed.

    Documents with equal counts are drawn together, by multinomial counts: the law of drawing documents in turn. Draws come in blocks
    with seeds of their own; what is sent to them is one row for each distinct six counts.
    """
    counts = ("a_tp", "a_fp", "a_fn", "b_tp", "b_fp", "b_fn")
    rows = by_doc.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts]).groupBy(*counts).agg(F.count("*").alias("n")).orderBy(*counts).collect()
    values, n = np.array([r[:6] for r in rows], np.int64).reshape(-1, 6), np.array([r.n for r in rows], np.int64)

    def draw(parts):
        for pdf in parts:
            for k in pdf["id"]:
                size = min(block, draws - k * block)
                times = np.random.default_rng([seed, k]).multinomial(n.sum(), n / n.sum(), size)
                tp, fp, fn = (times @ values[:, [i, i + 3]] for i in range(3))
                f = 2 * tp / np.maximum(1, 2 * tp + fp + fn)
                yield pd.DataFrame({"draw": np.arange(size, dtype=np.int32) + 1 + k * block, "delta": f[:, 1] - f[:, 0]})

    return by_doc.sparkSession.range(-(-draws // block) if rows else 0).mapInPandas(draw, "draw int, delta double")


def interval(deltas_: DataFrame) -> DataFrame:
    """Mean, 2.5 and 97.5 % (linear), and the verdict."""
    out = deltas_.agg(F.avg("delta").alias("mean"), F.expr("percentile(delta, 0.025)").alias("low"), F.expr("percentile(delta, 0.975)").alias("high"))
    return out.withColumn("verdict", F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("inconclusive"))


def bootstrap_scores(by_doc: DataFrame, draws: int = 10_000, seed: int = 42, block: int = 100) -> DataFrame:
    """(draw, f1) of resamples of documents with replacement; as ``bootstrap_resamples``, of one method."""
    rows = by_doc.select(*[F.col(c).alias(f"{m}_{c}") for m in "ab" for c in ("tp", "fp", "fn")])
    both = bootstrap_resamples(rows.withColumns({f"a_{c}": F.lit(0) for c in ("tp", "fp", "fn")}), draws, seed, block)
    return both.select("draw", F.col("delta").alias("f1"))


def interval_of(scores: DataFrame, value: str = "f1") -> DataFrame:
    """Mean and the linear 2.5 and 97.5 % quantiles."""
    return scores.agg(F.avg(value).alias("mean"), F.expr(f"percentile({value}, 0.025)").alias("low"), F.expr(f"percentile({value}, 0.975)").alias("high"))


def unpaired_delta(before: DataFrame, after: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Change of F1 from one batch to another of different documents: the point, the interval over draws that resample each batch on its own, the
    share of draws above 0 and the verdict."""
    a, b = bootstrap_scores(before, draws, seed), bootstrap_scores(after, draws, seed + 1).withColumnRenamed("f1", "now")
    deltas_ = a.join(b, "draw").select((F.col("now") - F.col("f1")).alias("delta"))
    point = [df.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select(f1(F.col("tp"), F.col("fp"), F.col("fn")).alias(n)) for df, n in ((before, "was"), (after, "is"))]
    out = deltas_.agg(F.expr("percentile(delta, 0.025)").alias("low"), F.expr("percentile(delta, 0.975)").alias("high"), (F.count_if(F.col("delta") > 0) / float(draws)).alias("above_zero"))
    out = out.join(F.broadcast(point[0]), F.lit(True)).join(F.broadcast(point[1]), F.lit(True))  # one row each
    verdict = F.when(F.col("low") > 0, "improved").when(F.col("high") < 0, "regressed").otherwise("inconclusive")
    return out.select((F.col("is") - F.col("was")).alias("delta"), "low", "high", "above_zero", verdict.alias("verdict"))
