"""Training and inference by windows of tokens: bodies, what each window sees, which are kept, and lists put together again.

Tokens are words between blanks unless other offsets are given. All is built-in expressions; a window's references are found inside its
document's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import hash_order
from .text import token_windows


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\r\\n]+"), lambda w: w != "")


def windowed(docs: DataFrame, window: int, overlap: int) -> DataFrame:
    """doc_id, ordinal, start, end, native (the whole document in one window) and body of every window; documents without words have none."""
    rows = docs.select("doc_id", words_of(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    cut = token_windows(rows.select("doc_id", "n"), "n", window, overlap)
    body = F.array_join(F.slice("w", F.col("start") + 1, F.col("end") - F.col("start")), " ")
    return cut.join(rows, "doc_id").select("doc_id", "ordinal", "start", "end", (F.col("n") <= window).alias("native"), body.alias("body"))


def seen_by(windows: DataFrame, refs: DataFrame) -> DataFrame:
    """The windows with ``seen``: the sorted places of the references of which any quote is in the body. refs: doc_id, pos, quotes."""
    lists = refs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "quotes"))).alias("refs"))
    both = windows.join(lists, "doc_id", "left")
    sees = lambda r: F.exists(r["quotes"], lambda q: (q != "") & F.contains(F.col("body"), q))
    found = F.transform(F.filter("refs", sees), lambda r: r["pos"])
    return both.withColumn("seen", F.coalesce(found, F.array().cast("array<bigint>"))).withColumn("listed", F.coalesce(F.size("refs"), F.lit(0))).drop("refs")


def kept(view: DataFrame, negative_share: float, namespace: str) -> DataFrame:
    """The windows to train on: those that see a reference, native ones, and of documents without any reference a share of windows by hash.
    A window that sees nothing of a document with references says nothing and goes."""
    point = F.conv(F.substring(hash_order(namespace, "__w"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = view.withColumn("__w", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")))
    why = F.when(F.size("seen") > 0, "positive").when(F.col("native"), "native").when((F.col("listed") == 0) & (point < negative_share), "negative")
    return rows.withColumn("why", why).where("why IS NOT NULL").drop("__w")


def unseen(refs: DataFrame, view: DataFrame) -> DataFrame:
    """References that no window of their document sees: what a view must answer for."""
    held = view.select("doc_id", F.explode("seen").alias("pos")).distinct()
    return refs.select("doc_id", "pos").join(held, ["doc_id", "pos"], "left_anti")


def token_range(offsets: Column, start: Column, end: Column) -> Column:
    """struct(first, last) of the tokens that a stretch of characters touches; nulls where it touches none. offsets: array of (start, end)."""
    inside = F.transform(offsets, lambda t, i: F.when((t["start"] < end) & (t["end"] > start), i))
    return F.struct(F.array_min(inside).alias("first"), F.array_max(inside).alias("last"))


def expanded(start: Column, end: Column, by: int, n: Column) -> Column:
    """An interval with ``by`` tokens more at both ends, within the text."""
    return F.struct(F.greatest(start - by, F.lit(0)).alias("start"), F.least(end + by, n).alias("end"))


def first_quote(text: Column, quotes: Column) -> Column:
    """The least place (from 0) at which any quote stands in a text; null if none does."""
    return F.array_min(F.transform(quotes, lambda q: F.when((q != "") & F.contains(text, q), F.instr(text, q) - 1)))


def joined(windows: DataFrame) -> DataFrame:
    """Documents' lists from their windows' answers: doc_id, failed, refs (each once, in order). A window that failed fails its document.
    windows: doc_id, ordinal, status, refs (array of text)."""
    lists = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "refs"))), lambda x: x["refs"]))
    out = windows.groupBy("doc_id").agg(F.bool_or(F.col("status") != "success").alias("failed"), F.array_distinct(lists).alias("refs"))
    return out.withColumn("refs", F.when(~F.col("failed"), F.col("refs")))


def training_arms(refs: DataFrame, text: Column) -> DataFrame:
    """Where each raw reference's span comes from: the locator, else its quote word for word, else nowhere (dropped). refs: spans, source_text."""
    how = F.when(F.size("spans") > 0, "located").when((F.trim("source_text") != "") & F.contains(text, F.trim("source_text")), "verbatim").otherwise("dropped")
    return refs.withColumn("how", how)


def updates(documents: Column, accumulation: int, epochs: int = 1) -> Column:
    """Optimizer updates of a run."""
    return F.ceil(documents / accumulation).cast("long") * epochs
