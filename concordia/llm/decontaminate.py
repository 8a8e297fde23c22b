"""Benchmark decontamination (5): a broadcast hash set of the benchmark's word windows, scanned over every text.

Normalised words are lower-cased (A-Z) runs of ASCII letters, digits and any non-ASCII character. A window is ``n`` words in
a row of an item, or all its words if it has fewer. The windows' 64-bit hashes form a sorted array; a text's rolling window
hashes are looked up in it, and each hit is verified word by word before it counts.

The set is broadcast only while the benchmark has at most ``max_words`` words. Beyond that bound the windows of both sides meet
in a join on two hashes, which stand for their words there, and the hit windows come back as positions; the results are the same.

Defined results: null or empty texts have no words and are clean; texts of any length are scanned whole; items without words or with
a null id never occur; repeated items count once; a window of several items counts for each; repeated documents get equal rows; other
columns are ignored, or kept in ``row`` whatever their names; with an empty benchmark everything is clean; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, added_schema, by_arrow, mix64, need, ngram_hashes, texts_of, with_row, with_text

#: bytes to blanks but for letters and digits, which are lower-cased, and all bytes of non-ASCII characters
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: the same words, as a pattern
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Windows:
    """The windows of all items, by length: sorted hashes with the item and word at which each begins, and the items' words in one array."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = 13):
        hashes, self.names, texts, self.by_length = WordHashes(), [], [], {}
        starts, found, at = [], {}, 0
        for item, text in sorted(set(items)):
            words = words_of(text)
            if not words:
                continue
            size = min(n, len(words))
            h = ngram_hashes(hashes.of(words), size)
            found.setdefault(size, []).append((h, np.full(len(h), len(self.names), np.int32), np.arange(at, at + len(h), dtype=np.int32)))
            self.names.append(item)
            starts.append(np.cumsum([0] + [len(w) + 1 for w in words[:-1]]) + sum(map(len, texts)))
            texts.append(b" ".join(words) + b" ")
            at += len(words)
        self.text = b"".join(texts)
        self.starts = np.concatenate([*starts, [len(self.text)]]).astype(np.int64) if starts else np.zeros(1, np.int64)
        for size, parts in found.items():
            h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, item, h))
            self.by_length[size] = h[order], item[order], place[order]

    def scan(self, words: list[bytes], hashed: np.ndarray) -> tuple[np.ndarray | None, set[str]]:
        """Which words are inside an occurring window (None: none), and the items that occur. A hit of hashes counts once its words are
        found to be equal."""
        hit, items = None, set()
        for size, (known, owner, place) in self.by_length.items():
            grams = ngram_hashes(hashed, size)
            if not len(grams):
                continue
            first = np.searchsorted(known, grams)
            first[first == len(known)] = 0
            same: dict[int, list[tuple[bytes, int]]] = {}
            for i in np.flatnonzero(known[first] == grams).tolist():
                window = b" ".join(words[i : i + size]) + b" "
                k = int(first[i])
                if k not in same:
                    last = int(np.searchsorted(known, known[k], "right"))
                    same[k] = [(self.text[self.starts[p] : self.starts[p + size]], o) for p, o in zip(place[k:last].tolist(), owner[k:last].tolist(), strict=True)]
                if owners := {o for w, o in same[k] if w == window}:
                    hit = np.zeros(len(words), bool) if hit is None else hit
                    hit[i : i + size] = True
                    items |= owners
        return hit, {self.names[o] for o in items}


def load_windows(benchmark: DataFrame, n: int = 13, max_words: int = 2_000_000) -> Windows | None:
    """The windows, or None if the benchmark has more than ``max_words`` words, counted as they are split. At the bound they take about
    40 bytes a word, 80 MB, on the driver and in each Python worker."""
    items = need(benchmark, item_id="string", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    if words > max_words:
        return None
    return Windows([(r[0], bytes(r[1])) for r in items.select("item_id", F.col("text").cast("binary")).collect()], n)


def spans_of(hit: np.ndarray | None) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))) if hit is not None else []
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, max_words: int = 2_000_000, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items that occur) and spans (word ranges that are hit), by row; ``keep`` adds
    ``row``, a struct of all columns of ``docs``."""
    windows = load_windows(benchmark, n, max_words)
    if windows is None:
        return _by_join(with_row(docs, keep, doc_id="long", text="binary"), benchmark, n)
    rows = with_text(docs, keep)
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def make():
        scan, hashes = shared.value.scan, WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, found, spans = [], [], [], []
            for text in texts_of(batch).cast(pa.binary()):
                words = words_of(text.as_py())
                hit, items = scan(words, hashes.of(words))
                n_words.append(len(words))
                n_hit.append(0 if hit is None else int(hit.sum()))
                found.append(sorted(items))
                spans.append(spans_of(hit))
            kept = [batch.column("row")] if keep else []
            out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, SPANS)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, *out], names=["doc_id", *["row"] * keep, "n_words", "n_hit", "items", "spans"])

        return step

    return by_arrow(rows, make, added_schema(rows, "text", FOUND))


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _windows_of(rows: DataFrame, key: str, n: int, lengths: list[int] | None) -> DataFrame:
    """key, at, len and two hashes of every window of each text (binary): of the given lengths, or of n or all its words."""

    def run(batches):
        one, two = WordHashes(), WordHashes()
        for batch in batches:
            for i in range(0, len(batch), 64):
                parts = []
                for k, t in zip(batch.column(0)[i : i + 64].to_pylist(), batch.column(1)[i : i + 64], strict=True):
                    words = words_of(t.as_py())
                    hashed = one.of(words)
                    for size in lengths or [min(n, len(words)) or n]:
                        h = ngram_hashes(hashed, size)
                        g = ngram_hashes(mix64(hashed + np.uint64(0x51ED27)), size)
                        parts.append((np.full(len(h), 0, object) if not len(h) else np.array([k] * len(h), object), np.arange(len(h), dtype=np.int32), np.full(len(h), size, np.int32), h, g))
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].tolist(), pa.string()), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3].view(np.int64)), pa.array(columns[4].view(np.int64))], names=[key, "at", "len", "h", "g"])

    return rows.mapInArrow(run, f"{key} string, at int, len int, h long, g long")


def _by_join(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The way for a benchmark that is too large to broadcast: windows meet in a join on their length and two hashes of 64 bits, which
    stand for their words. Documents are known by a hash of their text, so copies are looked up once."""
    items = need(benchmark, item_id="string", text="binary").where("item_id IS NOT NULL")
    wanted = _windows_of(items.select("item_id", "text"), "item_id", n, None).select("len", "h", "g", "item_id").distinct()
    lengths = sorted(r[0] for r in wanted.select("len").distinct().collect()) or [n]
    body = F.coalesce("text", F.lit(b""))
    named = rows.withColumn("text_id", F.sha2(body, 256)).withColumn("text", body)
    texts = named.groupBy("text_id").agg(F.first("text").alias("text"))
    hits = _windows_of(texts, "text_id", n, lengths).join(wanted, ["len", "h", "g"])
    per = hits.groupBy("text_id").agg(F.collect_set("item_id").alias("items"), F.collect_set(F.struct("at", "len")).alias("hits"))
    out = named.join(per, "text_id", "left").drop("text_id")
    fields = [f for f in rows.schema.names if f != "text"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, found, spans = [], [], [], []
            for text, items, hits in zip(batch.column("text"), batch.column("items").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                size = len(words_of(text.as_py()))
                hit = np.zeros(size, bool) if hits else None
                for h in hits or ():
                    hit[h["at"] : h["at"] + h["len"]] = True
                n_words.append(size), n_hit.append(int(hit.sum()) if hits else 0), found.append(sorted(items or ())), spans.append(spans_of(hit))
            cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array(spans, SPANS)]
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], *cols], names=[*fields, "n_words", "n_hit", "items", "spans"])

        return step

    return by_arrow(out, make, added_schema(rows, "text", FOUND))


def contaminated() -> Column:
    """The rule on find_contamination's columns: some word is hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span of words."""
    raw = text.encode()
    marks, starts, ends, inside = raw.translate(NORMAL), [], [], False
    for i, c in enumerate(marks + b" "):
        if (c != 32) != inside:
            (ends if inside else starts).append(i)
            inside = not inside
    for a, b in sorted(spans, reverse=True):
        raw = raw[: starts[a]] + raw[ends[b - 1] :]
    return raw.decode()


def items_digest(items: str = "items") -> Column:
    return F.sha2(F.array_join(F.sort_array(items), ","), 256)
