"""N-gram Jaccard join (4): T-occurrence search with DivideSkip, in blocks around pivots of rare shingles.

A text's set holds its distinct word shingles as 64-bit hashes. Texts with equal sets are one class; only classes are compared.

1. Rarity. One pass over all texts counts every shingle in a sketch (a counter for about 32 bytes of text, ``LEAST_BITS`` to ``MOST_BITS``
   bits; tasks' sketches are summed chunk by chunk); a shingle's level is the logarithm of its counter. Level, then hash, is one order
   over all shingles, rare ones first. The order is exact to use however coarse it is; a coarser one only makes larger blocks.
2. Blocks. Linked sets of sizes a <= b share ceil(t * b) shingles or more, so each has a common shingle among its first
   n - ceil(t * n) + 1 in that order. Sets that show a shingle there join the block of the shingle's pivot, the least class showing it: a
   linked pair always shares a block, and a block never reaches beyond one pivot, as candidates are not chained. The sets that show a
   shingle part where a size is too far above the next smaller one for any link across. Passages that many texts share come last in
   the order, so they seldom form blocks. A shingle that the sketch finds common is dealt by salt, and its pivots are partial minima
   by band of sizes. Each set also has counters of its shingles by cell, about one byte for 4 shingles: the sum of two sets' lesser
   counters bounds their overlap, and a set that could reach the threshold with no other of its block leaves it before sets move.
3. Search. In a block, inverted lists of set numbers by shingle are built. For a set and the least overlap T that a partner needs,
   DivideSkip heap-merges the short lists, skipping ahead where T - L hits are out of reach, and looks the candidates up in the L
   long lists by binary search; L is the number of least estimated cost. Reached overlaps are compared with
   100 * overlap >= percent * union. Sets that are already in one component need no further link: the pivot asks first, then the sets
   outside the largest component, each only if sizes and cells leave it a possible partner.
   A block of over ``BLOCK_DOCS`` sets or ``BLOCK_SHINGLES`` shingles is dealt in chunks, each with the pivot. After components of their links are known, sets outside
   the pivot's component ask the other chunks too. There are no caps; the costly case is a block of n sets near each other but not
   linked, whose chunks all meet: n * n / ``BLOCK_DOCS`` searches' worth of lists.
4. Connected components of the links give each class, and so each document, its component.

Defined results: null or empty texts, or texts without words, have the empty set and link with nothing (component: their own id);
rows that repeat a doc_id are one node in the links and get a row each; a null doc_id is returned with a null
component; other columns are ignored, whatever their names; texts of any length are read whole; links are by 64-bit hashes;
ties in the order fall by hash, which changes no result; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, by_arrow, lasting, mix64, need, ngram_hashes, small, with_row
from .graph import connected_components

PERCENT = 90
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 2_000_000
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 22, 14
HOT_ROWS = 1000  # rows of a shingle, beyond what the sketch's noise accounts for, that share a task


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the text's ``n``-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(hashes.of(words), min(n, len(words))))


def class_of(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix64(s).sum().astype(np.int64)), int(mix64(s + np.uint64(0x1234567)).sum().astype(np.int64))


def cells_of(s: np.ndarray) -> bytes | None:
    """How many of a set's shingles fall in each cell, in bytes; a power of two of cells, one for 4 shingles or fewer. None if a
    counter overflows."""
    k = 16
    while k * 4 < len(s):
        k *= 2
    counts = np.bincount((s & np.uint64(k - 1)).astype(np.int64), minlength=k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def possible(sizes: np.ndarray, cells: list[bytes | None], percent: int) -> np.ndarray:
    """A mask of a block's sets: those that by sizes and cells could be similar enough to another one."""
    keep = np.zeros(len(sizes), bool)
    if any(c is None for c in cells):
        return ~keep
    width = np.array([len(c) for c in cells])
    for k in np.unique(width):
        own, wide = np.flatnonzero(width == k), np.flatnonzero(width == 2 * k)
        near = np.concatenate([own, wide])
        table = np.array([np.frombuffer(cells[i], np.uint8).astype(np.uint16) for i in own] + [np.frombuffer(cells[i], np.uint8).reshape(2, k).sum(0, dtype=np.uint16) for i in wide])
        for row, i in enumerate(own):
            close = np.flatnonzero((np.minimum(sizes[near], sizes[i]) * 100 >= percent * np.maximum(sizes[near], sizes[i])) & (near != i))
            least = -(-percent * (sizes[i] + sizes[near[close]]) // (100 + percent))
            got = close[np.minimum(table[close], table[row]).sum(1, dtype=np.int64) >= least]
            keep[near[got]] = True
            keep[i] |= len(got) > 0
    return keep


def _bucket(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """The sketch's width for a table: by the bytes of its texts, within bounds that tasks can hold (16 MB of counters, 4 MB of levels)."""
    size = need(docs, text="string").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // 32).bit_length()))


def scan(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """One pass over the texts: doc_id, n_shingles, class and cells of each row; and, in rows with ``chunk``, each task's sketch in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch, waiting, tokens = WordHashes(), np.zeros(1 << bits, np.uint32), [], 0
        names = ["doc_id", "n_shingles", "c1", "c2", "cells", "chunk", "counts"]

        def add(buckets: list[np.ndarray]) -> None:
            which, times = np.unique(np.concatenate(buckets), return_counts=True)
            sketch[which] += times.astype(np.uint32)

        for batch in batches:
            size, one, two, cells = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), hashes, n)
                a, b = class_of(s) if len(s) else (None, None)
                size.append(len(s)), one.append(a), two.append(b), cells.append(cells_of(s))
                waiting.append(_bucket(s, bits).astype(np.uint32))
                tokens += len(s)
                if tokens > 1 << 19:
                    add(waiting)
                    waiting, tokens = [], 0
            none = pa.nulls(len(size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(cells, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if waiting:
            add(waiting)
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(sketch.reshape(-1, 1 << CHUNK_BITS)) if p.any()]
        if parts:
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(parts), pa.binary()), pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=names)

    rows = need(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("b"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, cells binary, chunk int, counts binary")


def level(counts: np.ndarray) -> np.ndarray:
    """Counters on a logarithmic scale, in a byte."""
    return np.minimum(255, np.round(4 * np.log2(1.0 + counts))).astype(np.uint8)


def rarity(scanned: DataFrame, bits: int) -> np.ndarray:
    """The summed sketch as levels: a table of 1 << bits bytes."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # 128 KB a chunk, 256 chunks at most
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(k, np.zeros(1 << CHUNK_BITS, np.uint64))
                sums[k] += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([level(x).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "levels"])

    table = np.zeros((1 << bits - CHUNK_BITS, 1 << CHUNK_BITS), np.uint8)
    parts = scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    for k, levels in parts.mapInArrow(add, "chunk int, levels binary").collect():
        table[k] = np.frombuffer(bytes(levels), np.uint8)
    return table.ravel()


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a linked set must show one too: the first in the order of rarity."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    key = (levels[_bucket(s, len(levels).bit_length() - 1)].astype(np.uint64) << np.uint64(56)) | (mix64(s) >> np.uint64(8))
    return s[np.argpartition(key, n - 1)[:n]] if n < len(s) else s


def shown(docs: DataFrame, levels: np.ndarray, n: int, percent: int) -> DataFrame:
    """(token, salt, n, c1): what each class, with its size n, shows. A common shingle's rows are dealt by a salt above 0; copies in a batch show once."""
    counts = 2.0 ** (np.arange(256) / 4.0) - 1  # by level
    mean = float((np.bincount(levels, minlength=256) * counts).sum() / max(1, len(levels)))
    salts = np.maximum(0, np.ceil((counts - 8 * mean) / HOT_ROWS) - 1).astype(np.int64)
    bits = len(levels).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((levels, salts))

    def make():
        hashes, (rank, salted) = WordHashes(), shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: set[int] = set()
            tokens, salt, size, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for t in batch.column(0):
                s = shingle_set(t.as_py(), hashes, n)
                if not len(s) or (c := class_of(s)[0]) in seen:
                    continue
                seen.add(c)
                p = prefix(s, rank, percent)
                tokens.append(p)
                size.append(np.full(len(p), len(s), np.int64))
                owner.append(np.full(len(p), c, np.int64))
                parts = salted[rank[_bucket(p, bits)]]
                salt.append(np.where(parts > 0, 1 + (c & 0xFFFFFFF) % np.maximum(parts + 1, 1), 0))
            columns = [np.concatenate(tokens).view(np.int64), np.concatenate(salt).astype(np.int32), np.concatenate(size), np.concatenate(owner)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "salt", "n", "c1"])

        return step

    rows = need(docs, doc_id="long", text="string").where("doc_id IS NOT NULL").select(F.col("text").cast("binary").alias("b"))
    return by_arrow(rows, make, "token long, salt int, n long, c1 long")


def members(rows: DataFrame, percent: int) -> DataFrame:
    """(p, x): each class x of the block of pivot p, with p itself; classes are named by their first hash."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token, salt, size and class. A run ends where one of the first two changes or the size leaps; its first row is
        its pivot, which is carried over batches."""
        last, pivot = None, 0
        for batch in batches:
            token, salt, n, c = (batch.column(k).to_numpy() for k in range(4))
            if not len(token):
                continue
            new = last is None or (token[0], salt[0]) != last[:2] or last[2] * 100 < percent * n[0]
            head = np.concatenate([[new], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (n[:-1] * 100 < percent * n[1:])])
            at = np.maximum.accumulate(np.where(head, np.arange(len(token)), -1))
            p = np.where(at >= 0, c[at], pivot)
            keep = (p != c) | (salt > 0)
            last, pivot = (token[-1], salt[-1], n[-1]), p[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, salt, n, p, c)], names=["token", "salt", "n", "p", "x"])

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "c1")
    found = lasting(dealt.mapInArrow(runs, "token long, salt int, n long, p long, x long"))
    # a common shingle's rows: sets in one band of sizes, or in neighbouring ones, are in a band's group together
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100) * (1 + 1e-9)))
    hot = found.where("salt > 0").select("token", "x", F.explode(F.array(band, band + 1)).alias("band"))
    pivots = hot.groupBy("token", "band").agg(F.min("x").alias("m"))
    pairs = found.where("salt = 0").select("p", "x").union(hot.join(pivots, ["token", "band"]).where("m <> x").select("m", "x")).distinct()
    pairs = lasting(pairs)
    return pairs.union(pairs.select("p", F.col("p").alias("x")).distinct())


def thinned(named: DataFrame, percent: int) -> DataFrame:
    """Blocks (p, c1, node, n) of ``named`` (with cells) without the sets that can be linked with no other set of their block; blocks of
    over ``BLOCK_DOCS`` stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []

        def kept():
            mask = possible(np.array([r[3] for r in rows], np.int64), [r[4] for r in rows], percent) if len(rows) > 1 else [False]
            return [r[:4] for r, k in zip(rows, mask, strict=True) if k]

        def send():
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["p", "c1", "node", "n"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("p", "c1", "node", "n", "cells")], strict=True):
                if row[0] != now:
                    out += kept() if rows else []
                    now, rows = row[0], []
                rows.append(row)
            yield send()
            out = []
        out += kept() if rows else []
        yield send()

    docs = lasting(named.groupBy("p").agg(F.count("*").alias("docs")).where(F.col("docs") > BLOCK_DOCS).select(F.col("p").alias("whole")))
    marked = named.join(small(docs), F.col("p") == F.col("whole"), "left")
    schema = "p long, c1 long, node long, n long"
    light = marked.where("whole IS NULL").drop("whole").repartition("p").sortWithinPartitions("p", "node").mapInArrow(run, schema)
    return light.union(marked.where("whole IS NOT NULL").select("p", "c1", "node", "n"))


class Index:
    """Inverted lists of a block's sets: for every shingle the ascending numbers of the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.lists = tokens[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.start, self.end = tokens[head], head, np.concatenate([head[1:], [len(tokens)]])

    def lists_of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lists of a set's shingles that occur here, the shortest list first."""
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == s]
        at = at[np.argsort(self.end[at] - self.start[at], kind="stable")]
        return self.start[at], self.end[at]


def merge_skip(lists: list[list[int]], least: int) -> tuple[list[int], list[int]]:
    """Members of at least ``least`` of the ascending lists, and how many hold them: a heap of the lists' heads. Where the least head
    has too few, ``least - 1`` heads are taken off and their lists jump to the next head, as nothing before it can have enough."""
    heads, at = [(x[0], k) for k, x in enumerate(lists)], [0] * len(lists)
    heapq.heapify(heads)
    found, counts = [], []
    while len(heads) >= least:
        member, taken = heads[0][0], []
        while heads and heads[0][0] == member:
            taken.append(heapq.heappop(heads)[1])
        if len(taken) >= least:
            found.append(member)
            counts.append(len(taken))
            target = member + 1
        else:
            while len(taken) < least - 1:
                taken.append(heapq.heappop(heads)[1])
            target = heads[0][0] if heads else member + 1
        for k in taken:
            at[k] = bisect_left(lists[k], target, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heads, (lists[k][at[k]], k))
    return found, counts


PROBE = 0.05  # a step of a probe, done for all candidates at once, against a step of the heap


def long_lists(lengths: np.ndarray, least: int) -> int:
    """L: how many of the longest lists are probed. Of all choices, the one with the least estimate of merged members plus probes of the
    candidates, which are at most the merged members over the hits they need."""
    most = min(least - 1, len(lengths) - 1)
    if most <= 0:
        return 0
    merged = np.cumsum(lengths)[::-1][: most + 1].astype(np.float64)  # by L = 0, 1, ...
    longs = np.arange(most + 1)
    return int(np.argmin(merged + PROBE * merged / (least - longs) * longs * np.log2(lengths[-1] + 1.0)))


def search(index: Index, s: np.ndarray, wanted: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Numbers of the index's sets, among those ``wanted`` (a mask; other members are left out of the lists), that are similar enough to
    ``s``."""
    size = len(s)
    low = -(-percent * size // 100)
    least = -(-percent * (size + low) // (100 + percent))  # the overlap that the smallest partner needs
    starts, ends = index.lists_of(s)
    if len(starts) < least:
        return np.empty(0, np.int64)
    n_long = long_lists(ends - starts, least)
    n_short = len(starts) - n_long
    short = (index.lists[a:b] for a, b in zip(starts[:n_short].tolist(), ends[:n_short].tolist(), strict=True))
    found, count = merge_skip([x for x in (part[wanted[part]].tolist() for part in short) if x], least - n_long)
    found, count = np.array(found, np.int64), np.array(count, np.int64)
    if len(found):
        other = index.sizes[found]
        keep = (other * 100 >= percent * size) & (size * 100 >= percent * other)
        found, count, other = found[keep], count[keep], other[keep]
    if not len(found):
        return found
    need_ = -(-percent * (size + other) // (100 + percent))
    for i in range(n_long):
        part = index.lists[starts[n_short + i] : ends[n_short + i]]
        at = np.searchsorted(part, found)
        at[at == len(part)] = 0
        count = count + (part[at] == found)
        keep = count + (n_long - 1 - i) >= need_
        if not keep.all():
            found, count, other, need_ = found[keep], count[keep], other[keep], need_[keep]
            if not len(found):
                return found
    return found[100 * count >= percent * (size + other - count)]


def link_block(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, first: int = 0, component: np.ndarray | None = None, asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the block's links. ``component`` gives components that are known; the set ``first`` asks before the others,
    then all sets (of ``asks``, a mask) that are outside the largest component."""
    index = Index(sets)
    cells = 16
    while cells * 2 < np.median(index.sizes):
        cells *= 2
    table = np.stack([np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) for s in sets]).astype(np.int32)
    component = np.arange(len(ids)) if component is None else np.unique(component, return_inverse=True)[1]
    asks = np.ones(len(ids), bool) if asks is None else asks
    links, largest = [], -1
    for i in [first, *(k for k in range(len(ids)) if k != first)]:
        if not asks[i] or component[i] == largest:
            continue
        wanted, size = component != component[i], index.sizes[i]
        if not wanted.any():
            break
        near = np.flatnonzero(wanted & (index.sizes * 100 >= percent * size) & (size * 100 >= percent * index.sizes))
        least = -(-percent * (size + index.sizes[near]) // (100 + percent))
        wanted[:] = False
        wanted[near[np.minimum(table[near], table[i]).sum(1) >= least]] = True
        if not wanted.any():
            continue
        for j in search(index, sets[i], wanted, percent).tolist():
            if component[j] != component[i]:
                links.append((int(ids[i]), int(ids[j])))
                component[component == component[j]] = component[i]
        largest = int(np.bincount(component).argmax())
    return links


def packed_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """``chosen`` (node, tasks) with each node's set as bytes; a doc_id's rows that are of another class are left out by c1."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t.as_py(), hashes, n) for t in batch.column("b")]
            same = pa.array([len(s) > 0 and class_of(s)[0] == c for s, c in zip(sets, batch.column("c1").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("node"), batch.column("tasks"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tasks", "shingles"])
            return out.filter(same)

        return step

    kind = chosen.schema["tasks"].dataType.simpleString()
    texts = need(docs, doc_id="long", text="string").select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("b"))
    rows = texts.join(small(lasting(chosen)), "node").select("node", "tasks", "b", "c1")
    return by_arrow(rows, make, f"node long, tasks {kind}, shingles binary")


TASK = "p long, chunk int, pivot boolean, asks boolean, component long"


def search_tasks(packed: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b): links of each task (p, chunk). Rows of a task are neighbours in a sorted partition and are held one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def links():
            ids = np.array([r[0] for r in rows], np.int64)
            known = None if rows[0][4] is None else np.array([r[4] for r in rows], np.int64)
            first = next((i for i, r in enumerate(rows) if r[2]), 0)
            found = link_block(ids, [np.frombuffer(r[1], np.uint64) for r in rows], percent, first, known, np.array([r[3] for r in rows], bool))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("p", "chunk", "node", "shingles", "pivot", "asks", "component")]
            for p, chunk, *row in zip(*columns, strict=True):
                if now != (p, chunk) and rows:
                    yield links()
                    rows = []
                now = p, chunk
                if not rows or row[:2] != rows[-1][:2]:  # a row that repeats doc_id and text stands once
                    rows.append(row)
        if rows:
            yield links()

    tasks = packed.select("node", "shingles", F.explode("tasks").alias("t")).select("t.*", "node", "shingles")
    return tasks.repartition(partitions, "p", "chunk").sortWithinPartitions("p", "chunk", "node").mapInArrow(run, "a long, b long")


def find_links(docs: DataFrame, blocks: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between the classes' first documents, a spanning forest by block."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = blocks.join(classes, blocks["x"] == classes["c1"]).select("p", F.col("x").alias("c1"), F.col("rep").alias("node"), "n", "cells")
    named = lasting(thinned(lasting(named), percent))
    chunks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large = named.groupBy("p").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).select("p", chunks.alias("chunks"))
    large = lasting(large.where("chunks > 1"))
    placed = named.join(small(large), "p", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = lasting(placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int")).withColumn("pivot", F.col("p") == F.col("c1")))
    task = lambda chunk, asks, component: F.struct("p", chunk.alias("chunk"), "pivot", asks.alias("asks"), component.alias("component"))
    everywhere = F.sequence(F.lit(0), F.col("chunks") - 1)
    mine = task(F.col("own"), F.lit(True), F.lit(None).cast("long"))
    tasks = F.when(F.col("pivot"), F.transform(everywhere, lambda k: task(k, F.lit(True), F.lit(None).cast("long")))).otherwise(F.array(mine))
    by_node = lambda rows: rows.groupBy("node", "c1").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))  # noqa: E731  a class is in as many blocks as it shows shingles at most
    links = lasting(search_tasks(packed_sets(docs, by_node(placed.select("node", "c1", tasks.alias("tasks"))), n), percent, partitions))
    if large.isEmpty():
        return links
    groups = lasting(connected_components(links))
    wide = placed.where("chunks > 1").join(small(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))
    home = lasting(wide.where("pivot").groupBy("p").agg(F.min("component").alias("home")))
    wide = wide.join(small(home), "p").withColumn("outside", F.col("component") != F.col("home"))
    tasks = F.transform(everywhere, lambda k: task(k, F.col("outside") & (k != F.col("own")), F.col("component")))
    only = F.when(F.col("outside"), tasks).otherwise(F.filter(tasks, lambda t: t["chunk"] == F.col("own")))
    again = search_tasks(packed_sets(docs, by_node(wide.select("node", "c1", only.alias("tasks"))), n), percent, partitions)
    return lasting(links.union(again))


def linked_components(docs: DataFrame, n: int = 3, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    bits = sketch_bits(docs)
    scanned = lasting(scan(docs, n, bits))
    rows = scanned.where("chunk IS NULL").select("doc_id", "n_shingles", "c1", "c2", "cells")
    classes = lasting(rows.where("c1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_shingles").alias("n"), F.first("cells").alias("cells")))
    copies = lasting(classes.where("rep <> last").select("c1", "c2", "rep"))
    mapped = lasting(rows.join(small(copies), ["c1", "c2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    links = find_links(docs, members(shown(docs, rarity(scanned, bits), n, percent), percent), classes.select("c1", "rep", "n", "cells"), n, percent)
    # a doc_id that is repeated with other texts joins their classes
    repeated = mapped.groupBy("doc_id").agg(F.min("rep").alias("one"), F.max("rep").alias("other")).where("one <> other").select("doc_id")
    links = links.union(mapped.join(small(lasting(repeated)), "doc_id").select("doc_id", "rep"))
    groups = connected_components(links).select(F.col("node").alias("g"), "component")
    out = mapped.join(small(groups), F.col("rep") == F.col("g"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 3, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one with the least doc_id (of rows that repeat that id, the one of least hash); documents with
    null id stay. The columns are those of ``docs``, whatever their names."""
    found = lasting(linked_components(docs, n, percent))
    drop = lasting(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = with_row(docs, True, doc_id="long").join(small(drop, 2_000_000), "doc_id", "left_anti")
    twice = lasting(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return kept.select("row.*")
    one = kept.join(small(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(small(twice), "doc_id", "left_anti").select("row.*").union(one.select("row.*"))
