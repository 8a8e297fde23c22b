"""Sharding (8): Hilbert-curve ordering of documents by several metadata dimensions, cut into runs of equal counts.

Dimensions: source and language (ranks by their rows' cumulative share, so that a common value gets a wide stretch), the
logarithm of the size, and doc_id between its least and greatest. Rows with equal texts are one group and take the source, language
and doc_id of its least row, so all of them fall in one cell. Each is quantised to ``BITS`` bits; the Hilbert index of the cell
orders the rows (ties: text checksum and hash, source with language, doc_id), so files made of runs can be pruned by any of the
dimensions, but for copies that differ from their group's least row. A shard is a run: position * shards // rows. Law: ``rows``, counts
differ by at most one; rows with equal texts lie together, within them those of one source and language; only a run's cut parts them.

Positions come from a range partitioning and counts by partition; no task sees more than its range, however many rows share
a cell. Defined results: null doc_id sorts first and counts as the least; null source or language is the first value; null text has size 1;
texts of any length count with all their bytes; repeated rows have neighbouring slots; other columns are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_arrow, lasting, need, small

BITS = 10
RANGE_ROWS = 2_000_000  # rows of a range partition at most, about: tables of any size get as many ranges


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of integer points, (rows, dimensions), by the transpose method on whole columns."""
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            high = (x[k] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | (((x[k] ^ flip) >> bit) & 1)
    return index


def _ranks(rows: DataFrame, column: str) -> DataFrame:
    """Each value's middle in the cumulative share of rows, times 2**BITS; a window over one row a value, pre-aggregated."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.col(column).asc_nulls_first())
    middle = F.sum("n").over(w) - F.col("n") / 2
    return n.select(F.col(column).alias(f"{column}_value"), F.floor(middle / F.sum("n").over(Window.partitionBy()) * (1 << BITS)).cast("int").alias(f"{column}_cell"))


def order_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, hilbert and position (gapless from 0 in curve order), for each row."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = need(docs, doc_id="long", text="string", source="string", lang="string")
    rows = lasting(rows.select("doc_id", "source", "lang", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("text_hash"), F.xxhash64(F.isnull("source"), "source", "lang").alias("origin")))
    least, most, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    least, span = least or 0, max(1, (most or 0) - (least or 0) + 1)
    # the least row of each group of equal texts stands for all of them; null ids and values come first
    text = ["size", "text_crc32", "text_hash"]
    groups = rows.groupBy(*text).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    copies = lasting(groups.where("n > 1").drop("n"))
    own = F.coalesce("first", F.struct("doc_id", "source", "lang"))
    cells = rows.join(small(copies), text, "left").select("doc_id", *text, "origin", own["doc_id"].alias("place_id"), own["source"].alias("source"), own["lang"].alias("lang"))
    for c in ("source", "lang"):
        r = _ranks(rows, c)
        cells = cells.join(r, cells[c].eqNullSafe(r[f"{c}_value"]), "left")
    top = F.lit((1 << BITS) - 1)
    size_cell = F.least(F.floor(F.log2("size") * (1 << BITS) / 40).cast("int"), top)
    id_cell = F.least(F.floor((F.coalesce("place_id", F.lit(least)) - F.lit(least)) / F.lit(float(span)) * (1 << BITS)).cast("int"), top)
    cells = cells.select("doc_id", *text, "origin", F.least("source_cell", top).alias("c0"), F.least("lang_cell", top).alias("c1"), size_cell.alias("c2"), id_cell.alias("c3"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            points = np.stack([batch.column(f"c{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], 1)
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(hilbert_index(points))], names=["doc_id", "size", "text_crc32", "text_hash", "origin", "hilbert"])

        return step

    curve = by_arrow(cells, make, "doc_id long, size long, text_crc32 long, text_hash long, origin long, hilbert long")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // RANGE_ROWS)
    key = ["hilbert", "text_crc32", "text_hash", "origin", "doc_id", "size"]
    # written once: the ranges come from a sample, so a second evaluation could cut elsewhere
    ranged = lasting(curve.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("place", F.monotonically_increasing_id()))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return ranged.withColumn("part", part).join(F.broadcast(before), "part").select("doc_id", "size", "text_crc32", "hilbert", (F.col("before") + within).alias("position"))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law of keys) and hilbert, for each row."""
    placed = order_documents(docs)
    total = placed.agg(F.count("*")).first()[0]
    number = F.expr(f"cast((position * {shards}) div {max(1, total)} as int)")
    # the first position of shard s is ceil(s * total / shards)
    first = F.expr(f"cast((shard * {total}L + {shards - 1}) div {shards} as bigint)")
    return placed.withColumn("shard", number).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def bounds(docs: DataFrame, sharded: DataFrame) -> DataFrame:
    """What a reader prunes files by: for each shard its rows and the least and greatest source, language, size and doc_id of its documents.
    docs: with unique doc_ids; sharded: of ``shard``."""
    d = need(docs, doc_id="long", source="string", lang="string").withColumnRenamed("doc_id", "__d")
    both = sharded.join(d, sharded["doc_id"] == F.col("__d"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("source", "lang", "size", "doc_id") for name, f in (("least", F.min), ("most", F.max))]
    return both.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Documents as Parquet, a folder a shard, in curve order within each: runs of the curve, whose files' statistics prune scans by any of
    the dimensions. docs: with unique doc_ids. A reader that filters by shard, source, language, size or doc_id skips most files."""
    placed = lasting(shard(docs, shards).select(F.col("doc_id").alias("__d"), "shard", "slot"))
    rows = docs.join(placed, docs["doc_id"].cast("long").eqNullSafe(F.col("__d"))).drop("__d")
    per = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(max(per, shards), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
