"""JSON sources and sinks: ground truth folders, prediction arrays, JSONL, release layers and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "struct<kanun_no:string,kanun_ad:string,madde:string,source_text:string,status:string>"


def ground_truth(spark: SparkSession, path: str, drafts: bool = False) -> DataFrame:
    """doc_id (of the file name), pos and the fields of each approved row (a blank status is approved; drafts on request)."""
    docs = spark.read.schema(f"text string, references array<{REFERENCE}>").option("multiLine", True).option("pathGlobFilter", "doc_*.json").json(path)
    docs = docs.select(F.regexp_extract(F.col("_metadata.file_name"), r"doc_(\d+)\.json$", 1).cast("long").alias("doc_id"), F.posexplode_outer("references").alias("pos", "r"))
    status = F.coalesce(F.nullif(F.lower(F.trim("r.status")), F.lit("")), F.lit("approved"))
    keep = status.isin("approved", "draft") if drafts else status == "approved"
    return docs.where(F.col("r").isNull() | keep).select("doc_id", "pos", *[F.coalesce(F.trim(f"r.{c}"), F.lit("")).alias(c) for c in ("kanun_no", "kanun_ad", "madde", "source_text")])


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """The last block of each integer doc_id in a file's order, with how often the id came."""
    schema = f"doc_id string, status string, references array<{REFERENCE}>, operational map<string,string>, _corrupt_record string"
    # a file of one array is read by one task, in its order; files come by their names
    rows = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("place", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    rows = rows.where(F.col("doc_id").rlike("^-?[0-9]+$")).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("status", F.coalesce("status", F.lit("success")))
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("status", "references", "operational"), "place").alias("b"), F.count("*").alias("blocks")).select("doc_id", "b.*", "blocks")


def prediction_statuses(spark: SparkSession, path: str) -> DataFrame:
    """How many blocks have each status, and how many have an id that is no whole number."""
    rows = spark.read.schema("doc_id string, status string, _corrupt_record string").option("multiLine", True).json(path)
    state = F.when(~F.coalesce(F.col("doc_id").rlike("^-?[0-9]+$"), F.lit(False)), "unusable_id").otherwise(F.coalesce("status", F.lit("success")))
    return rows.groupBy(state.alias("status")).agg(F.count("*").alias("n"))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """The distinct document ids that files name: arrays of numbers, or of objects with doc_id."""
    lists = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("v"))
    each = lists.select(F.explode("v").alias("x"))
    number = F.coalesce(F.get_json_object("x", "$.doc_id"), F.col("x"))
    return each.select(number.try_cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """method, precision, recall and f1 of a stored report: a JSON array of results."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<results:array<struct<method:string,core:struct<precision:double,recall:double,f1:double>>>>").alias("v"))
    return rows.select(F.explode("v.results").alias("r")).select("r.method", "r.core.*")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines by schema; unreadable ones are kept whole in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_release(rows: DataFrame, path: str, layer: str = "release_trust") -> DataFrame:
    """Layers as JSON partitions, and their manifest: rows and an order-free digest a layer."""
    rows.write.mode("errorifexists").partitionBy(layer).json(f"{path}/layers")
    body = F.sha2(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c != layer])), 256)
    manifest = rows.groupBy(layer).agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(body, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))
    manifest.write.json(f"{path}/manifest")
    return manifest


def verify_release(spark: SparkSession, path: str, schema: str, layer: str = "release_trust") -> DataFrame:
    """Layers whose rows or digest differ from the manifest; empty when the release is whole."""
    rows = spark.read.schema(f"{schema}, {layer} string").json(f"{path}/layers")
    body = F.sha2(F.to_json(F.struct(*[c for c in sorted(rows.columns) if c != layer])), 256)
    now = rows.groupBy(layer).agg(F.count("*").alias("rows_now"), F.sum(F.conv(F.substring(body, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest_now"))
    manifest = spark.read.schema(f"{layer} string, rows long, digest string").json(f"{path}/manifest")
    both = manifest.join(now, layer, "full_outer")
    return both.where("NOT (rows <=> rows_now AND digest <=> digest_now)")


def report_rows(metrics: DataFrame) -> DataFrame:
    """Report lines with six decimals."""
    return metrics.select("method", *[F.format_string("%.6f", c).alias(c) for c in ("precision", "recall", "f1")])


def training_chat(rows: DataFrame, system: str) -> DataFrame:
    """One chat example a row: system, user, assistant."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(F.to_json(F.struct(F.array(message("system", F.lit(system)), message("user", F.col("text")), message("assistant", F.col("answer"))).alias("messages"))).alias("value"))


def write_manifest(path: str, manifest: dict) -> None:
    """A small JSON file on the driver, in place at once or not at all."""
    import os

    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
