"""Keyed records: joins with quarantine, upserts, event folds, corrections, fingerprints, contracts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_or_quarantine(left: DataFrame, pool: DataFrame, key: str, usable: Column) -> DataFrame:
    """Left rows with their pool row, and ``problem``: no id, repeated id, no pool row, several, or not usable; in that order.

    Counts of both sides are taken by key in one aggregate before the join, so a repeated key never multiplies rows and null ids, however
    many, meet nowhere.
    """
    one = pool.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("in_pool"), F.first(F.struct(*[F.col(c) for c in pool.columns if c != key])).alias("pool"))
    twice = left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__l")).agg(F.count("*").alias("in_left")).where("in_left > 1")
    out = left.join(one, F.col(key) == F.col("__k"), "left").drop("__k").join(twice, F.col(key) == F.col("__l"), "left").drop("__l")
    out = out.withColumn("in_left", F.coalesce("in_left", F.lit(1)))
    problem = F.when(F.col(key).isNull(), "missing_id").when(F.col("in_left") > 1, "duplicate").when(F.col("in_pool").isNull(), "not_in_pool").when(F.col("in_pool") > 1, "ambiguous").when(~usable, "unusable")
    return out.withColumn("problem", problem)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last version of each key over both tables."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in both.columns if c not in keys]), order).alias("v")).select(*keys, "v.*")


def fold_events(events: DataFrame, key: str, order: tuple[str, ...], state: str, seconds: str) -> DataFrame:
    """Each key's current state, versions and summed non-negative seconds: partial aggregates, no sort."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("versions"), F.sum(F.when(F.col(seconds) >= 0, F.col(seconds))).alias("seconds"))


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One correction a row: kind ``remove`` drops it, ``replace`` sets ``value``; a correction that meets no row is an error row
    with kind ``stale``."""
    c = corrections.select(*[F.col(k).alias(f"__{k}") for k in key], "kind", F.col("value").alias("__v"))
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"__{k}"))
    out = rows.withColumn("__here", F.lit(True)).join(c, same, "full_outer")
    kept = out.where(F.col("kind").isNull() | (F.col("kind") != "remove") | F.col("__here").isNull())
    picked = [F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in key]
    return kept.select(*picked, F.when(F.col("__here").isNull(), None).when(F.col("kind") == "replace", F.col("__v")).otherwise(F.col("value")).alias("value"), F.when(F.col("__here").isNull(), "stale").when(F.col("kind") == "replace", "replaced").otherwise("kept").alias("kind"))


def id_set_digest(rows: DataFrame, key: str) -> DataFrame:
    """A digest of a set of ids that does not depend on order: 16 million pieces, by the id's own hash, are digested first, then 4096 pieces of
    those, then these."""
    ids = rows.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    level = ids.groupBy(F.substring(F.sha2("id", 256), 1, 6).alias("piece")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("id")), ","), 256).alias("h"), F.count("*").alias("n"))
    join = lambda: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "h"))), lambda x: x["h"]), ","), 256)
    level = level.groupBy(F.substring("piece", 1, 3).alias("top")).agg(join().alias("h"), F.sum("n").alias("n")).withColumnRenamed("top", "piece")
    return level.agg(F.sum("n").alias("ids"), join().alias("digest"))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """only_a, only_b, common: one aggregation over both id columns."""
    both = a.select(F.col(key).alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(key), F.lit(0), F.lit(1)))
    flags = both.groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return flags.agg(*[F.count_if(F.expr(e)).alias(n) for e, n in (("a > b", "only_a"), ("b > a", "only_b"), ("a = 1 AND b = 1", "common"))])


def transitions(rows: DataFrame, before: str, after: str, every: tuple[str, ...]) -> DataFrame:
    """Counts of all pairs of buckets, zeros included."""
    names = rows.sparkSession.createDataFrame([(a, b) for a in every for b in every], f"{before} string, {after} string")
    counts = rows.groupBy(before, after).agg(F.count("*").alias("n"))
    return names.join(counts, [before, after], "left").select(before, after, F.coalesce("n", F.lit(0)).alias("n"))


def unblind(rows: DataFrame, verdict: str = "verdict", mapping: str = "mapping") -> DataFrame:
    """Who a blind verdict A or B means, by a mapping such as ``A=human,B=model``; TIE and NEITHER stay."""
    return rows.withColumn("winner", F.when(F.col(verdict).isin("A", "B"), F.element_at(F.str_to_map(F.col(mapping), F.lit(","), F.lit("=")), F.col(verdict))).otherwise(F.col(verdict)))


def review_priority(escalated: bool = False) -> Column:
    """Pilot 0, RED and QUARANTINE 1, YELLOW 2, audited GREEN 3, any GREEN of an escalated batch 4; null: no review is required."""
    bucket = F.col("bucket")
    p = F.when(F.col("pilot"), 0).when(bucket.isin("RED", "QUARANTINE"), 1).when(bucket == "YELLOW", 2).when(F.col("audit"), 3)
    return p.when(bucket == "GREEN", 4) if escalated else p


def review_queue(rows: DataFrame, escalated: bool = False, key: str = "doc_id") -> DataFrame:
    """Documents that require a review and have no final one, with priority and position; deferred ones last within a priority.

    rows: key, bucket, pilot, audit, status. Positions come from sorted ranges and counts by range: no task sees more than its range.
    """
    queue = rows.withColumn("priority", review_priority(escalated)).where("priority IS NOT NULL AND status <> 'finalized'")
    return numbered(queue.withColumn("late", (F.col("status") == "deferred").cast("int")), ("priority", "late", key), "position").drop("late")


def numbered(rows: DataFrame, order: tuple[str, ...], name: str, first: int = 1) -> DataFrame:
    """``name``: the row's place in ``order`` (a total one), from ``first``. Ranges are counted by their greatest key, as a second evaluation may cut
    them elsewhere: a row's place is the rows of lesser ranges and its place in its own."""
    key = F.struct(*order)
    sample = rows.select(key.alias("k")).sample(False, 0.01, 7).limit(20_000).select("k").distinct().orderBy("k").collect()
    cuts = [r.k for r in sample][:: max(1, len(sample) // 64)]
    kind = rows.select(key.alias("k")).schema["k"].dataType
    edges = rows.sparkSession.createDataFrame([(i + 1, k) for i, k in enumerate(cuts)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("k", kind)]))
    bounds = edges.agg(F.sort_array(F.collect_list(F.struct("k", "i"))).alias("edges"))
    placed = rows.join(F.broadcast(bounds), F.lit(True)).withColumn("__part", F.size(F.filter("edges", lambda e: e["k"] <= key))).drop("edges")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # 65 rows at most
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within + (first - 1)).drop("__part", "__before")


Row = tuple[str, str, str]


def _take(free: list[Row], wanted: list) -> bool:
    """Removes the first free row that meets the first of ``wanted`` that any row meets."""
    for test in wanted:
        for k, row in enumerate(free):
            if test(row):
                del free[k]
                return True
    return False


def staged_counts(gold: list[Row], candidates: list[Row]) -> tuple[int, int, int]:
    """tp, fp, fn of the older greedy matching of (number, name, article) rows, in row order: equal triples first; then gold rows
    with only a number, against rows with only that number, else any row with it; then the same for names."""
    free, left = list(candidates), []
    for g in gold:
        if not (g[0] and g[1] and _take(free, [lambda c, g=g: c == g])):
            left.append(g)
    for field in (0, 1):
        rest = []
        for g in left:
            same = lambda c, g=g: c[field] == g[field] and c[2] == g[2]  # noqa: E731, B023
            mine = g[field] and not g[1 - field]
            if not (mine and _take(free, [lambda c: same(c) and not c[1 - field], same])):  # noqa: B023
                rest.append(g)
        left = rest
    return len(gold) - len(left), len(free), len(left)


COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("tp", "fp", "fn")])


def staged_matching(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``staged_counts`` by document. Later stages depend on what earlier ones took, so lists are gathered by document (they are
    short) and matched in Arrow batches of many documents."""

    @F.pandas_udf(COUNTS)
    def match(gold: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        triples = lambda x: [(r["law_no"], r["name_key"], r["article"]) for r in x]
        return pd.DataFrame([staged_counts(triples(g), triples(c)) for g, c in zip(gold, candidates, strict=True)], columns=["tp", "fp", "fn"])

    row = F.struct("pos", "law_no", "name_key", "article")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, row)))
    return rows.groupBy(key).agg(side("reference").alias("g"), side("candidate").alias("c")).select(key, match("g", "c").alias("m")).select(key, "m.*")
