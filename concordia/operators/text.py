"""Text location and training views: evidence, mentions, spans, token windows, repeated tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import clean, fold_clean, folded, loose, loose_folded


def mode_of(quote: str | None, text: str | None) -> str | None:
    """How a quote occurs in its document's text: exact, folded, loose or null, the first that does."""
    q, t = clean(quote), clean(text)
    if not q:
        return None
    if q in t:
        return "exact"
    if folded(q) in folded(t):
        return "folded"
    return "loose" if loose(q) and loose(q) in loose(t) else None


@F.pandas_udf(T.StringType())
def evidence_mode(source: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([mode_of(q, t) for q, t in zip(source, text, strict=True)], dtype=object)


#: each mode's form, made from the form before it
MODES = (("exact", clean), ("folded", fold_clean), ("loose", loose_folded))


def evidence_pairs(docs: DataFrame, items: DataFrame, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, mode) of every quote ``q`` that occurs in a ``text``, whole, by the first mode that holds.

    Quotes go to the tasks in blocks of ``block``, each block as one automaton a mode, which finds all its quotes in one pass over a
    text; so the work is in the texts and the hits, whatever the number of quotes.
    """
    import ahocorasick

    quotes = [(r[0], r[1]) for r in items.select("item_id", "q").where("q IS NOT NULL").toLocalIterator()]
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, mode string"

    def find(part):
        def run(frames):
            machines, spelt = [], [q for _, q in part]
            for name, form in MODES:
                by: dict[str, list] = {}
                spelt = [form(q) for q in spelt]
                for (item, _), q in zip(part, spelt, strict=True):
                    if q:
                        by.setdefault(q, []).append(item)
                machine = ahocorasick.Automaton()
                for q, owners in by.items():
                    machine.add_word(q, owners)
                if by:
                    machine.make_automaton()
                machines.append((name, form, machine if by else None))
            for pdf in frames:
                out = []
                for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    seen: dict = {}
                    for name, form, machine in machines:
                        text = form(text)
                        for _, owners in machine.iter(text) if machine else ():
                            for item in owners:
                                seen.setdefault(item, name)
                    out += [(doc, item, name) for item, name in seen.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "mode"])

        return docs.select("doc_id", "text").mapInPandas(run, schema)

    parts = [find(quotes[k : k + block]) for k in range(0, len(quotes), block)]
    found = docs.sparkSession.createDataFrame([], schema)
    for p in parts:
        found = found.union(p)
    return found


def coverage(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """The share of a document's non-empty quotes that occur in it; 0 without any."""
    given = F.trim("source_text") != ""
    out = rows.groupBy(by).agg(F.count_if(given).alias("quotes"), F.count_if(given & evidence_mode(F.col("source_text"), F.col("text")).isNotNull()).alias("found"))
    return out.withColumn("coverage", F.when(F.col("quotes") == 0, 0.0).otherwise(F.col("found") / F.col("quotes")))


def numbered_mentions(rows: DataFrame, pattern: str, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(doc, ordinal, start, mention) of a pattern; ``by`` is unique. What stands between two matches is a piece of the split text, so places are
    running sums of lengths: linear in a text's mentions."""
    pieces = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    found = rows.select(by, F.regexp_extract_all(text, F.lit(f"({pattern})"), 1).alias("m"), pieces.alias("gap"))
    each = found.select(by, F.posexplode(F.arrays_zip("m", F.slice("gap", 1, F.size("m")).alias("gap"))).alias("ordinal", "x")).select(by, "ordinal", "x.m", "x.gap")
    upto = Window.partitionBy(by).orderBy("ordinal")
    start = F.sum(F.col("gap") + F.length("m")).over(upto) - F.length("m")
    return each.select(by, "ordinal", start.cast("int").alias("start"), F.col("m").alias("mention"))


def law_in_force(events: DataFrame, by: str, place: str, law: str) -> DataFrame:
    """Adds ``in_force``: the last law mentioned at or before each place."""
    w = Window.partitionBy(by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("in_force", F.last(law, ignorenulls=True).over(w))


def segments(spans: DataFrame, by: str) -> DataFrame:
    """Overlapping spans (start, end) as disjoint segments with their depth, equal neighbours merged.

    A sweep: +1 at starts, -1 at ends, running sum; then gaps and islands. Sorting by document only, no pairs of spans.
    """
    marks = spans.select(by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(by, "x.at", "x.d")
    steps = marks.groupBy(by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(by).orderBy("at")
    depth = steps.withColumn("depth", F.sum("d").over(w)).withColumn("end", F.lead("at").over(w))
    changed = depth.withColumn("new", (F.coalesce(F.lag("depth").over(w), F.lit(-1)) != F.col("depth")).cast("int")).withColumn("island", F.sum("new").over(w))
    return changed.where("depth > 0").groupBy(by, "island").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.max("depth").alias("depth")).drop("island")


def token_windows(rows: DataFrame, n_tokens: str, window: int, overlap: int, by: str = "doc_id") -> DataFrame:
    """Intervals of ``window`` tokens overlapping by ``overlap``; the last one ends with the text; texts without tokens have none."""
    step = window - overlap
    count = F.greatest(F.lit(0), F.ceil((F.col(n_tokens) - window) / step)).cast("int")
    starts = F.when(F.col(n_tokens) > 0, F.transform(F.sequence(F.lit(0), count), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    out = rows.select(by, n_tokens, F.posexplode(starts).alias("ordinal", "start"))
    return out.select(by, "ordinal", "start", F.least(F.col("start") + window, F.col(n_tokens)).cast("int").alias("end"))


def sees(windows: DataFrame, spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """Windows with the number of spans that lie wholly inside."""
    s = spans.select(F.col(by).alias("__d"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col(by) == F.col("__d")) & (F.col("__s") >= F.col("start")) & (F.col("__e") <= F.col("end"))
    return windows.join(s, inside, "left").groupBy(by, "ordinal", "start", "end").agg(F.count("__d").alias("seen"))


def _once(items: Column, f) -> Column:
    """``f`` of a lambda's variable, so that the expression ``items`` is evaluated once a row, not at each use."""
    return F.transform(F.array(items), f)[0]


def stuck_tail(items: Column, least: int = 12) -> Column:
    """A list whose last ``least`` items are all alike."""
    return _once(items, lambda w: F.when(F.size(w) >= least, F.size(F.array_distinct(F.slice(w, -least, least))) == 1).otherwise(False))


def tail_run(items: Column) -> Column:
    """How many equal items the list ends with."""

    def run(w: Column) -> Column:
        n = F.size(w)
        # (position, place of the last item that differs from the list's last one), folded over the items themselves
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("other"))
        step = lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when(x != F.try_element_at(w, n), a["i"] + 1).otherwise(a["other"]).alias("other"))
        return F.when(n > 0, n - F.aggregate(w, start, step)["other"]).otherwise(0)

    return _once(items, run)
