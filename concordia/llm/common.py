"""Helpers that several corpus operators share: inputs, samples, checkpoints and Arrow stages."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, renamed and cast, so that extra columns or clashing names never matter.

    ``need(df, doc_id="long", text="string")`` picks by exact name; a missing column becomes null.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def shared_base(context: SparkContext) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; a temporary one where that is unset and all is on one machine, as in
    tests."""
    if base := context.getConf().get("spark.checkpoint.dir"):
        return base
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def lasting(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_base(sc))
    return df.checkpoint(eager=True)


def key_crc(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of a document."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(rows: DataFrame, stratum: str, each: int, key: str = "doc_id", total: int | None = None) -> tuple[DataFrame, dict]:
    """About ``each`` rows of every stratum, chosen by a hash of ``key``, and the strata's full counts; with ``total``, fewer of each where there
    are so many strata that together they would exceed it.

    Strata with no more rows than that come whole; the rest by a hash threshold, so that the sample does not depend on
    partitioning and no group is ever sorted or collected. At most 1.5 times as many rows of a stratum are returned in
    expectation terms. The strata's counts are collected: labels, languages.
    """
    counts = {r[stratum]: r["n"] for r in rows.groupBy(stratum).agg(F.count("*").alias("n")).collect()}
    if total is not None and counts:
        each = max(1, min(each, total // len(counts)))
    kind = rows.schema[stratum].dataType
    shares = [(v, min(1.0, each / n)) for v, n in counts.items()]
    schema = StructType([StructField("__v", kind), StructField("__share", DoubleType())])
    table_ = rows.sparkSession.createDataFrame(shares, schema)
    unit = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(20240607)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(small(table_), F.col(stratum).eqNullSafe(F.col("__v"))).where(unit < F.col("__share"))
    return sample.select(*[rows[c] for c in rows.columns]), counts


def by_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with state that is built once a task: ``make()`` returns the function applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            if step is None:
                step = make()
            yield step(batch)

    return df.mapInArrow(run, schema)


MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words given as bytes, remembered up to a bound."""

    BOUND = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mix64(words[i : i + m] + np.uint64(i + 1))
    return mix64(out)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A broadcast hint while ``df`` (narrow rows, already written) has at most ``most_rows``; beyond that the join is left to the
    optimizer, which shuffles and splits skewed keys."""
    return F.broadcast(df) if df.count() <= most_rows else df


def with_row(df: DataFrame, keep: bool, **columns: str) -> DataFrame:
    """``need`` columns and, with ``keep``, all columns of ``df`` as one struct ``row``, so that no name can clash with another."""
    have = set(df.columns)
    picked = [(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
    return df.select(*picked, *[F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] * keep)


def with_text(df: DataFrame, keep: bool) -> DataFrame:
    """``with_row`` of doc_id and the text, which travels once: where ``row`` holds it as a string, there is no column of its own."""
    rows = with_row(df, keep, doc_id="long", text="string")
    return rows.drop("text") if keep and dict(df.dtypes).get("text") == "string" else rows


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ``with_text``."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def added_schema(rows: DataFrame, without: str, more: str) -> StructType:
    """The fields of ``rows`` but for ``without``, followed by those of a DDL text."""
    return StructType([f for f in rows.schema.fields if f.name != without] + StructType.fromDDL(more).fields)
