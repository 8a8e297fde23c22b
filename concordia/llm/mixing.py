"""Mixing sources to target weights (3): Pareto order sampling of documents with unequal inclusion probabilities, in words.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at ``cap`` times
its source's words and the excess goes to the others by weight.

Within a source, a document is expected min(cap, l * w) times. Its weight w grows with its size, 2 ** (tilt * b) for sizes from
2 ** b words (long documents hold more context for their words), and l is set so that the expected words are the target; with a
tilt of 0 all documents of a source are alike. The whole part of that expectation are certain copies; the fraction is the
document's inclusion probability p. For the fraction, documents are ranked by Pareto's ranking variable, the odds of a uniform number
u (a hash of doc_id and seed) over the odds of p, and taken in that order up to the first that exceeds the source's remaining words.
The gap, of less than that document's size, is closed by up to ``GAP_DOCS`` of the next ``GAP_AMONG`` documents: the only step besides the
order, and so the only one that favours a document for its size.

The order is never sorted as a whole. Words are summed by up to ``RANGES`` ranges of v = q / (1 + q), q the ranking variable, then by finer
ranges of the one range in which a source reaches its target; only that finer range's documents, about ``RANGE_ROWS`` or fewer (the
density of v is at most 1 around the cut, where v is near 1/2), meet in one task. The windows run over one row a source, a size
band of a source, or a range of a source.

Defined results: rows alike in source, doc_id and size are decided together (a null doc_id: those alike in text); null or empty
texts have size 0 and take 0; a source without words has target 0; ties of the ranking variable go by id; extra columns are ignored
(or kept in ``row``, whatever their names); texts of any length are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, need, small

WEIGHTS = (5, 2, 1)
RANGES, RANGE_ROWS = 1024, 2048
TILT = 0.1
GAP_DOCS, GAP_AMONG = 2, 64


def words(text: Column) -> Column:
    """The number of runs of characters that are no ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def unit_of(doc_id: Column, text: Column) -> Column:
    """What rows are decided by: the id's text, or a hash of the text without one."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def uniform(unit: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of the unit."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), unit)), 1, 12), 16, 10).cast("double")
    return (h + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """source, docs, source_size, target from (source, size) rows. The windows run over one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    # Water filling: the sources that stop at their cap are those of least cap / weight. With the first k of that order capped,
    # the others share what is left by weight; the right k is the least for which nobody else is above its cap.
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    total, heavy = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    level = (total - F.lit(cap) * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))) / (heavy - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    by = by.withColumn("level", level)
    # the first level that its own source does not exceed
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), F.col("source").isNull().alias("z"), "source", "level"))).over(Window.partitionBy())
    target = F.least(F.col("source_size") * F.lit(cap), F.col("weight") * F.coalesce(water["level"], F.lit(0.0)))
    return by.select("source", "docs", "source_size", target.cast("double").alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def _band(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def expectations(sizes: DataFrame, plan: DataFrame, cap: float, tilt: float) -> DataFrame:
    """(es, eb, whole, p, rest, ranges): of each size band of a source the certain copies and the inclusion probability of its documents, and
    the source's words that certain copies leave to the draw."""
    bands = sizes.groupBy("source", _band(F.col("size")).alias("band")).agg(F.sum("size").alias("words")).where("words > 0")
    bands = bands.join(plan.select(F.col("source").alias("s"), "target", F.least(F.lit(RANGES), F.ceil(F.col("docs") / RANGE_ROWS)).cast("long").alias("ranges")), _same(bands["source"], F.col("s"))).drop("s")
    bands = bands.withColumn("w", F.pow(F.lit(2.0), F.col("band") * F.lit(tilt)))
    # Water filling over the few bands: with the heaviest ones at the cap, l is what the others need to reach the target.
    by = Window.partitionBy("source")
    before = by.orderBy(F.col("band").desc() if tilt >= 0 else F.col("band").asc()).rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(cap)
    weighed = (F.col("w") * F.col("words")).cast("decimal(38,6)")  # exact sums, in whatever order: reruns agree
    load = (F.sum(weighed).over(by) - F.coalesce(F.sum(weighed).over(before), F.lit(0))).cast("double")
    bands = bands.withColumn("l", (F.col("target") - capped) / load)
    bands = bands.withColumn("l", F.max_by(F.when(F.col("l") * F.col("w") <= F.lit(cap * (1 + 1e-12)), F.col("l")), F.when(F.col("l") * F.col("w") <= F.lit(cap * (1 + 1e-12)), F.col("w"))).over(by))
    copies = F.least(F.lit(cap), F.coalesce(F.col("l") * F.col("w"), F.lit(cap)))
    bands = bands.withColumn("copies", F.greatest(copies, F.lit(0.0))).withColumn("whole", F.floor(F.col("copies") + 1e-9).cast("long"))
    bands = bands.withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    rest = F.greatest(F.max("target").over(by) - F.sum(F.col("whole") * F.col("words")).over(by), F.lit(0.0))
    return bands.select(F.col("source").alias("es"), F.col("band").alias("eb"), "whole", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(0.0).alias("p"), rest.alias("rest"), "ranges")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's last range: its documents in Pareto order up to the first that does not fit; then, up to ``GAP_DOCS`` times, of the
    ``GAP_AMONG`` that come next the one that ends nearest to the target, if it ends nearer than without."""
    pdf = pdf.sort_values(["q", "unit", "size"], kind="stable").reset_index(drop=True)
    left, sizes = float(pdf["left"].iloc[0]), pdf["words"].tolist()
    n = next((i for i, upto in enumerate(pdf["words"].cumsum().tolist()) if upto > left), len(sizes))
    picked, near = list(range(n)), list(range(n, min(len(sizes), n + GAP_AMONG)))
    left -= sum(sizes[:n])
    for _ in range(GAP_DOCS):
        best = min(near, key=lambda i: abs(left - sizes[i]), default=None)
        if best is None or abs(left - sizes[best]) >= left:
            break
        picked.append(best)
        near.remove(best)
        left -= sizes[best]
    return pdf.loc[sorted(picked), ["source", "unit", "size"]]


def _cut(sums: DataFrame, place: str, left: str) -> DataFrame:
    """(cs, cut, left): by source the range in which ``left`` words are reached, and what is left there."""
    upto = Window.partitionBy("source").orderBy(place)
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    last = sums.where((F.col("before") <= F.col(left)) & (F.col("before") + F.col("words") > F.col(left)))
    return last.groupBy(F.col("source").alias("cs")).agg(F.min(place).alias("cut"), F.min_by(F.col(left) - F.col("before"), place).alias("left"), F.min_by("docs", place).alias("docs"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = 3.0, seed: int = 0, keep: bool = False, tilt: float = TILT) -> DataFrame:
    """doc_id, size, source_size, target, copies (how often the mix takes the document), for each row; ``keep`` adds ``row``, a struct of
    all columns of ``docs``."""
    base = need(docs, doc_id="long", text="string", source="string")
    rows = lasting(base.select("source", unit_of(F.col("doc_id"), F.col("text")).alias("unit"), words(F.col("text")).alias("size")))
    plan = lasting(targets(rows, weights, cap))
    expected = lasting(expectations(rows, plan, cap, tilt))
    odds = lambda x: x / (1 - x)

    def ranked(x: DataFrame) -> DataFrame:
        """Rows with their band's numbers, the ranking variable q and the range r that it falls in."""
        out = x.join(small(expected), _same(x["source"], expected["es"]) & (_band(x["size"]) == expected["eb"]) & (x["size"] > 0), "left").drop("es", "eb")
        out = out.withColumn("q", F.when(F.col("p") > 0, odds(uniform(F.col("unit"), seed)) / odds(F.least("p", F.lit(1 - 1e-12)))))
        out = out.withColumn("v", F.col("q") / (1 + F.col("q")) * F.col("ranges"))
        return out.withColumn("r", F.least(F.floor("v"), F.col("ranges") - 1).cast("long"))

    drawn = ranked(rows).where("p > 0")
    sums = drawn.groupBy("source", "r").agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.first("rest").alias("rest"))
    first = lasting(_cut(sums, "r", "rest").withColumnRenamed("left", "left1").withColumn("parts", F.ceil(F.col("docs") / RANGE_ROWS).cast("long")).drop("docs"))
    part = F.least(F.floor((F.col("v") - F.col("r")) * F.col("parts")), F.col("parts") - 1).cast("long")
    inside = drawn.join(small(first), _same(drawn["source"], first["cs"]) & (drawn["r"] == first["cut"])).drop("cs").withColumn("part", part)
    fine = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count("*").alias("docs"), F.first("left1").alias("left1"))
    second = lasting(_cut(fine, "part", "left1").select(F.col("cs").alias("fs"), F.col("cut").alias("fine"), "left"))
    few = inside.join(small(second), _same(inside["source"], second["fs"]) & (inside["part"] == second["fine"]))
    few = few.groupBy("source", "unit", "size").agg(F.sum("size").alias("words"), F.first("q").alias("q"), F.first("left").alias("left"))
    picked = lasting(few.groupBy("source").applyInPandas(_fill, "source string, unit string, size long"))
    picked = picked.select(F.col("source").alias("ps"), F.col("unit").alias("pu"), F.col("size").alias("pz"), F.lit(1).alias("extra"))
    # every row again, with its source's few numbers and the few documents of the last ranges
    cuts = plan.join(first, _same(plan["source"], first["cs"]), "left").drop("cs")
    cuts = cuts.join(second, _same(cuts["source"], second["fs"]), "left").select(F.col("source").alias("qs"), "source_size", "target", F.coalesce("cut", F.lit(RANGES)).alias("cut"), F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("fine", F.lit(0)).alias("fine"))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * keep
    text = F.col("text").cast("string")
    every = ranked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), unit_of(F.col("doc_id").cast("long"), text).alias("unit"), words(text).alias("size"), *whole))
    every = every.join(small(lasting(cuts)), _same(every["source"], F.col("qs"))).drop("qs").withColumn("part", part)
    every = every.join(small(picked), _same(every["source"], F.col("ps")) & (every["unit"] == F.col("pu")) & (every["size"] == F.col("pz")), "left")
    before = (F.col("r") < F.col("cut")) | ((F.col("r") == F.col("cut")) & (F.col("part") < F.col("fine")))
    extra = F.when(F.col("p") > 0, F.when(before, 1).otherwise(F.coalesce("extra", F.lit(0)))).otherwise(0)
    return every.select("doc_id", "size", "source_size", "target", (F.coalesce("whole", F.lit(0)) + extra).alias("copies"), *["row"] * keep)
