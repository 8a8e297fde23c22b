"""Seeded samples, splits, strata and deals. Orders come from hashes of ids, so they do not depend on partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(namespace: str, key: str = "doc_id") -> Column:
    return F.sha2(F.concat_ws(":", F.lit(namespace), F.col(key).cast("string")), 256)


def hash_sample(rows: DataFrame, n: int, namespace: str, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows of least hash: a top-k, not a sort."""
    return rows.withColumn("h", hash_order(namespace, key)).orderBy("h").limit(n).drop("h")


def hash_split(rows: DataFrame, parts: dict[str, int], namespace: str, key: str = "doc_id") -> DataFrame:
    """``split`` by hash thresholds in proportion to ``parts``: a projection, no shuffle."""
    whole, edge = sum(parts.values()), 0
    point = F.conv(F.substring(hash_order(namespace, key), 1, 8), 16, 10).cast("long") * F.lit(whole)
    out = F.lit(list(parts)[-1])
    marks = []
    for name, n in parts.items():
        edge += n
        marks.append((name, edge))
    for name, edge in reversed(marks[:-1]):
        out = F.when(point < F.lit(edge * (1 << 32)), name).otherwise(out)
    return rows.withColumn("split", out)


def least_hashes(rows: DataFrame, n: int, stratum: str, namespace: str, key: str = "doc_id") -> DataFrame:
    """The ``n`` rows of least hash of each stratum, with their ``turn`` from 1.

    A stratum may hold any share of the rows, so only rows below a hash threshold are ranked, about four times as many as are wanted; where
    that proves too few for some stratum, which is unlikely in the extreme, all are.
    """
    h = hash_order(namespace, key)
    counts = rows.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    point = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(1 << 32)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy("h"))
    ranked = lambda df: df.withColumn("h", h).withColumn("turn", turn).where(F.col("turn") <= n).drop("h")
    near = rows.join(counts, F.col(stratum).eqNullSafe(F.col("__s"))).where(point < (4.0 * n + 64) / F.col("__n")).drop("__s", "__n")
    out = ranked(near)
    got = out.groupBy(F.col(stratum).alias("__g")).agg(F.count("*").alias("__k"))
    short = counts.join(got, F.col("__s").eqNullSafe(F.col("__g")), "left").where(F.coalesce("__k", F.lit(0)) < F.least(F.col("__n"), F.lit(n)))
    return out if short.isEmpty() else ranked(rows)


def round_robin(rows: DataFrame, n: int, stratum: str, namespace: str, key: str = "doc_id") -> DataFrame:
    """``n`` rows dealt one stratum after the other in hash order: rank within the stratum first, then the stratum's name."""
    return least_hashes(rows, n, stratum, namespace, key).orderBy("turn", stratum).limit(n)


def audit_size(rows: DataFrame, share: float = 0.1, least: int = 30) -> int:
    """ceil(10 %) of the rows, at least 30, at most all."""
    n = rows.count()
    return min(n, max(-(-n * int(share * 1000) // 1000), least))


def pilot(rows: DataFrame, bucket: str, buckets: tuple[str, ...], each: int, refill: tuple[str, ...], namespace: str, key: str = "doc_id") -> DataFrame:
    """``each`` rows a bucket in hash order; what a bucket lacks comes from the others in turn, in ``refill``'s order."""
    ranked = least_hashes(rows.where(F.col(bucket).isin(*buckets)), each * len(buckets), bucket, namespace, key)
    first = ranked.where(F.col("turn") <= each)
    lacking = len(buckets) * each - first.count()
    order = sum((F.when(F.col(bucket) == b, i).otherwise(0) for i, b in enumerate(refill)), F.lit(0))
    rest = ranked.where(F.col("turn") > each).orderBy("turn", order).limit(max(0, lacking))
    return first.unionByName(rest)


def quartiles(rows: DataFrame, value: str) -> DataFrame:
    """Exclusive quartile cuts, interpolated at (n + 1) p, from counts of distinct values; one row q1, q2, q3."""
    values = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = values.withColumn("last", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda i: F.max(F.when((F.col("last") - F.col("n") < i) & (i <= F.col("last")), F.col("v")))
    cuts = []
    for k in (1, 2, 3):
        place = (F.col("total") + 1) * k / 4.0
        j = F.least(F.greatest(F.floor(place), F.lit(1)), F.greatest(F.col("total") - 1, F.lit(1)))
        cuts.append((j, place))
    out = placed.agg(*[at(j).alias(f"lo{i}") for i, (j, _) in enumerate(cuts)], *[at(F.least(j + 1, F.col("total"))).alias(f"hi{i}") for i, (j, _) in enumerate(cuts)], *[F.max(p - j).alias(f"w{i}") for i, (j, p) in enumerate(cuts)])
    return out.select(*[(F.col(f"lo{i}") * (1 - F.col(f"w{i}")) + F.col(f"hi{i}") * F.col(f"w{i}")).alias(f"q{i + 1}") for i in range(3)])


def deal_batches(rows: DataFrame, batches: int, size: int, strata: tuple[str, ...], namespace: str, key: str = "doc_id") -> DataFrame:
    """Balanced batches: the rarest stratum first, each row to the batch with fewest of its stratum, then fewest rows.

    Each choice depends on all before it, so one task deals; its input is bounded, as at most ``batches * size`` rows, picked by
    hash, are dealt.
    """
    chosen = hash_sample(rows, batches * size, f"{namespace}:pool", key).withColumn("__s", F.concat_ws("|", *[F.col(c).cast("string") for c in strata])).withColumn("__h", hash_order(namespace, key))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        count = pdf["__s"].value_counts()
        pdf = pdf.assign(__n=pdf["__s"].map(count)).sort_values(["__n", "__s", "__h"])
        total, held, out = [0] * batches, [{} for _ in range(batches)], []
        for s in pdf["__s"]:
            b = min((b for b in range(batches) if total[b] < size), key=lambda b: (held[b].get(s, 0), total[b], b))
            total[b] += 1
            held[b][s] = held[b].get(s, 0) + 1
            out.append(b + 1)
        return pd.DataFrame({key: pdf[key], "batch": out})

    return chosen.withColumn("__g", F.lit(0)).groupBy("__g").applyInPandas(deal, f"{key} {dict(rows.dtypes)[key]}, batch int")
