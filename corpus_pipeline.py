"""Five stages over ``documents``: toxicity, n-gram Jaccard join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them in order, writes each result as Parquet in the
shared folder and reads it again for the next. All stages but the last return the columns of their input, whatever their names.

Defined results: null and empty texts are neither toxic (but as the model's prior says), near copies of anything nor contaminated; they
have no words, so the mix takes them as it takes others of no words: not at all. Rows with a null doc_id are kept by the second stage and mixed by
their texts. Of rows that repeat a doc_id one is kept. Texts are read whole. Without labels nothing is toxic, without benchmark nothing
contaminated; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import decontaminate, jaccard_join, mixing, queries, sharding, toxicity
from concordia.llm.common import shared_base, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled documents, rejects go."""
    model = queries.toxicity_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles and a similarity of 0.8, the document with the least id stays."""
    return jaccard_join.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make up a twentieth or more go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.where(~decontaminate.contaminated()).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each copy."""
    mixed = mixing.mix(docs, keep=True).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row along the Hilbert curve."""
    return sharding.shard(docs).drop("hilbert")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("sharding", shard_documents),
]

#: trained models and the mix's fill are not expressible in SQL
ORACLE_SQL = None


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint folder."""
    base = shared_base(spark.sparkContext)
    return f"{base.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
