"""Contracts of a project's tables: each check returns the rows that break it, so an empty result is a pass."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import hash_order

STAGES = ("prepared", "predicted", "judged", "reviewed", "released", "composed", "trained", "selected", "measured", "sealed")


def corpus_problems(docs: DataFrame, splits: DataFrame, size: int, exemplars: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, problem) of a corpus of ids 1 to ``size``: missing, repeated, beyond the range, without text, in no split or in several; and
    exemplars that are not in training."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"))
    dealt = splits.groupBy("doc_id").agg(F.count("*").alias("s"), F.bool_or(F.col("split") == "train").alias("train"))
    every = docs.sparkSession.range(1, size + 1).withColumnRenamed("id", "doc_id").withColumn("due", F.lit(True))
    rows = every.join(ids, "doc_id", "full_outer").join(dealt, "doc_id", "full_outer")
    problem = (
        F.when(F.col("due").isNull(), "beyond_range").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("empty"), "no_text")
        .when(F.col("s").isNull(), "no_split").when(F.col("s") > 1, "two_splits").when(F.col("doc_id").isin(*exemplars) & ~F.col("train"), "exemplar_held_out")
    )
    return rows.select("doc_id", problem.alias("problem")).where("problem IS NOT NULL")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file of a folder."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_hash(manifest: DataFrame) -> DataFrame:
    """One hash of a manifest's names and hashes, in the order of names. A manifest has a row a file, so it is small."""
    lines = F.array_sort(F.collect_list(F.concat_ws("  ", "sha256", "name")))
    return manifest.agg(F.count("*").alias("files"), F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def stage_problems(log: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(round, seq, problem) of a round's stage log: a stage that is unknown, comes without its artifact, or is not the one after the stage
    before it (the first stage begins a round). log: round, seq, stage, artifact."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    before = F.coalesce(F.lag("place").over(Window.partitionBy("round").orderBy("seq")), F.lit(0))
    rows = log.withColumn("place", place).withColumn("before", before)
    problem = F.when(F.col("place") == 0, "unknown").when(F.coalesce("artifact", F.lit("")) == "", "no_artifact").when(F.col("place") != F.col("before") + 1, "out_of_turn")
    return rows.select("round", "seq", problem.alias("problem")).where("problem IS NOT NULL")


def generation_problems(rows: DataFrame) -> DataFrame:
    """Batches ``R0k`` that were handled with another model than ``M0(k-1)``. rows: batch, generation; other names are free."""
    number = F.regexp_extract("batch", "^R([0-9]{2})$", 1).try_cast("int")
    expected = F.concat(F.lit("M"), F.lpad((number - 1).cast("string"), 2, "0"))
    return rows.withColumn("expected", F.when(number.isNotNull(), expected)).where("expected IS NOT NULL AND generation <> expected")


def prediction_problems(rows: DataFrame) -> DataFrame:
    """(doc_id, problem) of prediction rows: an id that is no whole number, an unknown status, a success without a list, an error with one.
    rows: doc_id (text), status, n_references (null: no list)."""
    status, n = F.col("status"), F.col("n_references")
    problem = F.when(F.col("doc_id").isNull() | ~F.col("doc_id").rlike("^[0-9]+$"), "id").when(status.isNull() | ~status.isin("success", "error"), "status").when((status == "success") & n.isNull(), "no_list").when((status == "error") & (n > 0), "list_of_error")
    return rows.select("doc_id", problem.alias("problem")).where("problem IS NOT NULL")


def count_problems(rows: DataFrame, columns: tuple[str, ...] = ("tp", "fp", "fn")) -> DataFrame:
    """(doc_id, fields) with counts that are absent or negative."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.array_join(bad, ",").alias("fields")).where("fields <> ''")


def state_difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys by which two states of one table differ: only_a, only_b or changed. A snapshot is good if there are none."""
    rest = [c for c in a.columns if c not in keys]
    side = lambda df, s: df.select(*keys, F.lit(s).alias("s"), F.xxhash64(*rest).alias("h"))
    both = side(a, 1).union(side(b, 2)).groupBy(*keys).agg(F.max(F.when(F.col("s") == 1, F.col("h"))).alias("x"), F.max(F.when(F.col("s") == 2, F.col("h"))).alias("y"))
    how = F.when(F.col("y").isNull(), "only_a").when(F.col("x").isNull(), "only_b").when(F.col("x") != F.col("y"), "changed")
    return both.select(*keys, how.alias("how")).where("how IS NOT NULL")


def newest(rows: DataFrame, by: str, time: str, keep: int) -> DataFrame:
    """Rows with ``kept``: the newest ``keep`` of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time)))
    return rows.withColumn("kept", place <= keep)


def classified(docs: DataFrame, splits: DataFrame, overlaps: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Documents with ``category``, the first lookup that answers: the historical split of the same text, a cluster of duplicates, a
    quarantine's reason, an incomplete annotation; null is an error. docs: doc_id, text_sha256, raw_hash, completed."""
    one = lambda df, key, value: df.groupBy(key).agg(F.first(value).alias(value))
    out = docs.join(one(splits, "text_sha256", "split"), "text_sha256", "left").join(overlaps.select("raw_hash").distinct().withColumn("overlap", F.lit(True)), "raw_hash", "left").join(one(quarantined, "raw_hash", "reason"), "raw_hash", "left")
    category = F.when(F.col("split").isNotNull(), F.concat(F.lit("historical_"), "split")).when(F.col("overlap"), "duplicate_cluster").when(F.col("reason").isNotNull(), F.col("reason")).when(~F.coalesce("completed", F.lit(False)), "incomplete_annotation")
    return out.withColumn("category", category).drop("split", "overlap", "reason")


def judge_required(docs: DataFrame, escalated: bool = False) -> DataFrame:
    """Documents that need a judge: those that the lists disagree on, and all GREEN ones of an escalated batch."""
    return docs.where(F.col("bucket").isin("RED", "YELLOW", *["GREEN"] * escalated))


def judge_plan(documents: DataFrame, results: DataFrame, instrument: str, locked: bool) -> DataFrame:
    """What a judge has to do for each document: ``reuse`` a valid result of this instrument and this prediction, ``judge``, or, once the
    judge is locked, ``refuse`` where a result of another instrument or prediction is there. documents: doc_id, prediction_sha256; results: doc_id,
    instrument, prediction_sha256, valid."""
    best = results.groupBy("doc_id").agg(F.max_by(F.struct("instrument", "prediction_sha256", "valid"), F.struct((F.col("instrument") == instrument).cast("int"), "valid")).alias("r"))
    rows = documents.join(best, "doc_id", "left")
    same = (F.col("r.instrument") == instrument) & (F.col("r.prediction_sha256") == F.col("prediction_sha256"))
    plan = F.when(F.col("r").isNull(), "judge").when(same & F.col("r.valid"), "reuse").when(~same, F.lit("refuse" if locked else "judge")).otherwise("judge")
    return rows.select("doc_id", plan.alias("plan"))


JUDGED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("verdict", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())])


def judged(rows: DataFrame, judge: Callable[[dict], str], attempts: int = 3) -> DataFrame:
    """doc_id, verdict, attempts and the last error: a judge is asked up to ``attempts`` times for a verdict that keeps the contract. ``judge``
    is sent to the executors; rows: doc_id and what it reads."""
    from .preparation import VERDICTS

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                verdict, error, used = None, None, 0
                while verdict is None and used < attempts:
                    used += 1
                    try:
                        said = str(judge(row)).upper()
                        verdict, error = (said, None) if said in VERDICTS else (None, f"verdict {said}")
                    except Exception as e:  # noqa: BLE001  a provider may fail in any way; the failure is the row's result
                        error = type(e).__name__
                out.append((row["doc_id"], verdict, used, error))
            yield pd.DataFrame(out, columns=JUDGED.names)

    return rows.mapInPandas(run, JUDGED)


def blind(rows: DataFrame, namespace: str) -> DataFrame:
    """Candidates under blind names: which one is A goes by a bit of a hash of the document. rows: doc_id, human, model."""
    bit = F.conv(F.right(hash_order(namespace), F.lit(1)), 16, 10).cast("int") % 2 == 0
    return rows.withColumns({"candidate_a": F.when(bit, F.col("human")).otherwise(F.col("model")), "candidate_b": F.when(bit, F.col("model")).otherwise(F.col("human")), "mapping": F.when(bit, "A=human,B=model").otherwise("A=model,B=human")})


def correction_counts(decisions: DataFrame) -> DataFrame:
    """By rule: documents, corrections, and how many of each kind."""
    kinds = ("range", "replace", "remove")
    return decisions.groupBy("rule").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("corrections"), *[F.count_if(F.coalesce("kind", F.lit("range")) == k).alias(k) for k in kinds])


def stage_two_winner(scores: DataFrame, update: int, stage_one: DataFrame) -> DataFrame:
    """The best variant at a fixed update, of those that stage one let through: by F1, recall, the shorter prompt, the name."""
    rows = scores.where(F.col("update") == update).join(stage_one.where("passed").select("variant").distinct(), "variant", "left_semi")
    return rows.orderBy(F.desc("f1"), F.desc("recall"), "prompt_length", "variant").limit(1)


def view_curves(scores: DataFrame) -> DataFrame:
    """For each view: updates scored, the last, and the best by F1, recall and the earliest update."""
    best = F.max_by(F.struct("update", "f1"), F.struct("f1", "recall", -F.col("update")))
    return scores.groupBy("view").agg(F.count("*").alias("updates"), F.max("update").alias("last_update"), best.alias("b")).select("view", "updates", "last_update", F.col("b.update").alias("best_update"), F.col("b.f1").alias("best_f1"))


def display_status(status: Column, a: Column, b: Column, subsumed: Column) -> Column:
    """A comparison row's status as shown: one that agrees only because a law row is covered by an article is excused."""
    return F.when((status == "same") & ~(a & b) & subsumed, "excused").otherwise(status)
