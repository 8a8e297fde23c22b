"""The review event log as a stream: current state, seconds on page, and micro-batch prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def review_states(events: DataFrame, key: str, order: tuple[str, ...], state: str, seconds: str) -> DataFrame:
    """The same fold for a stream (update or complete mode) and a table."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("versions"), F.sum(F.when(F.col(seconds) >= 0, F.col(seconds))).alias("seconds"))


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """An addition: counts by event time with a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def escalations(events: DataFrame, audited: DataFrame, key: str, action: str = "changed") -> DataFrame:
    """Batches of which an audited document was changed: a stream-static join."""
    return events.where(F.col("action") == action).join(audited, key).groupBy("batch_id").agg(F.count("*").alias("changes"))


def predict_stream(documents: DataFrame, predict: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """What is pending now, in micro-batches: predict and push; a restart goes on from the checkpoint."""

    def batch(df: DataFrame, number: int) -> None:
        write(predict(df), number)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
