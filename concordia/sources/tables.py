"""Scans of the tables that a project keeps: listings, lookups by key, counters and lists kept as text."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import numbered


def listed(rows: DataFrame, equal: dict[str, object], order: str) -> DataFrame:
    """Rows with the given values, with their ``place`` in the order of a unique column."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return numbered(rows, (order,), "place")


def lookup(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the given keys, each once: one semi join in place of a query a key."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def distinct_values(rows: DataFrame) -> DataFrame:
    return rows.distinct()


def counters(rows: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Named numbers out of a JSON column; null where one is absent or no number."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    parsed = rows.withColumn("__c", F.from_json(column, schema))
    return parsed.select(*[c for c in rows.columns if c != column], *[F.col(f"__c.{n}").alias(n) for n in names])


def payload_text(value: str | None) -> str | None:
    """A list of objects as JSON, from JSON, from JSON inside a JSON string, or from a Python literal; null for anything else."""
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(value or "")
            found = json.loads(found) if isinstance(found, str) else found
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if isinstance(found, list) and all(isinstance(x, dict) for x in found):
            return json.dumps(found, ensure_ascii=False)
        return None
    return None


@F.pandas_udf(T.StringType())
def _payload(values: pd.Series) -> pd.Series:
    return values.map(payload_text)


def payload_list(column: Column) -> Column:
    return F.from_json(_payload(column), "array<struct<kanun_no:string,kanun_ad:string,madde:string,source_text:string>>")


def bounds(events: DataFrame, key: str, time: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(time).alias("earliest"), F.max(time).alias("latest"), F.count("*").alias("events"))


def curve(rounds: DataFrame, column: str, first: int) -> DataFrame:
    """The rounds from the first that was measured on."""
    return rounds.where(F.col(column) >= first)
