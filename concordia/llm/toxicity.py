"""Toxicity (1): bags of character n-grams, averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (3 to 6 letters, with marks at both ends), a passage's vector
the mean over its ``SPAN`` whitespace tokens and PAD empty ones, which keep short passages near the prior; a linear softmax reads
it, and a text is as toxic as its most toxic passage, however long it is. Embeddings and softmax are trained together by Adam on
whole texts, whose passages meet in a noisy-or, the smooth form of that maximum; the n-grams' vectors start at their log odds
between the classes, shrunk towards 0 where few texts hold them. A misspelt or unseen word shares the vectors of the n-grams that
it keeps. A run of over ``LONG`` letters (scripts without blanks, glued words) counts as a token every ``LONG - 5`` letters, so that all
of its n-grams are read. As all layers are linear, a trained model needs one number per n-gram to score, and a word's share of the score can be
remembered.

Defined results: a null or empty text, or one without letters, scores as an empty passage; texts of any length are read whole, about
``CHARS`` characters of a batch at a time; a score of 0.5 is predicted 1; repeated rows get equal
scores; other columns are ignored, or kept in ``row`` whatever their names; an empty table gives an empty table; without any labelled row of both classes every score is the share of label 1 (0 if none).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_schema, bounded_sample, by_arrow, mix64, need, sigmoid, texts_of, with_text

LETTERS = re.compile(r"[^\W\d_]+")
LONG = 40
SPAN = 32
PAD = 8
FLOOR = 0.03
SCALE = 200.0  # a passage's mean dilutes one word's vector: the scale keeps its margin in reach
START, GAIN, SHRINK = 4.0, 1.0, 6.0  # an empty passage's first margin below 0; size and shrinkage of the n-grams' first vectors


def tokens_of(text: str | None) -> list[str]:
    tokens = (text or "").lower().split()
    if max(map(len, tokens), default=0) <= LONG:
        return tokens
    return [piece for token in tokens for piece in (pieces(token) if len(token) > LONG else (token,))]


def pieces(token: str) -> list[str]:
    """A token with a run of over ``LONG`` letters as its runs, long ones in pieces that share 5 letters, so that every n-gram is in
    one; a line break, which no token holds, stands where a run goes on."""
    runs = LETTERS.findall(token)
    if max(map(len, runs), default=0) <= LONG:
        return [token]
    out = []
    for run in runs:
        last = max(0, -(-(len(run) - LONG) // (LONG - 5)))
        for k in range(last + 1):
            at = k * (LONG - 5)
            out.append("\n" * (k > 0) + run[at : at + LONG] + "\n" * (k < last))
    return out


def grams(tokens: list[str], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the tokens' n-grams, one token after the other, and how many each has. An n-gram is over letters only, with
    marks at both ends of a run of letters, but none where a line break says that the run goes on."""
    sizes = np.zeros(len(tokens), np.int64)
    points = np.frombuffer(" ".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.int32), sizes
    letter = (points >= 97) & (points <= 122) | (points >= 65) & (points <= 90)
    high = np.flatnonzero(points >= 128)
    if len(high):
        values, at = np.unique(points[high], return_inverse=True)
        letter[high] = np.array([LETTERS.fullmatch(chr(v)) is not None for v in values.tolist()])[at]
    edges = np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]  # runs of letters
    if not len(first):
        return np.empty(0, np.int32), sizes
    # the runs side by side, each with a mark before and after; 0 where the run goes on
    length = last - first + 2
    begin = np.cumsum(length) - length
    run = np.repeat(np.arange(len(first)), length)
    place = np.arange(len(run)) - begin[run]
    marked = points[np.clip(first[run] + place - 1, 0, len(points) - 1)].astype(np.uint64)
    breaks = np.concatenate([points == 10, [False]])
    marked[begin] = np.where(breaks[first - 1] & (first > 0), 0, 60)
    marked[begin + length - 1] = np.where(breaks[last], 0, 62)
    spaces = np.cumsum(points == 32)
    token_of = np.concatenate([[0], spaces])[first]
    zero = np.concatenate([[0], np.cumsum(marked == 0)])
    owner, found = [], []
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(marked), np.uint64)
        for n in range(1, 7):
            at = np.arange(len(marked) - n + 1)
            rolled = rolled[: len(at)] * np.uint64(0x9E3779B97F4A7C15) + marked[n - 1 :] + np.uint64(1)
            if n >= 3:
                good = at[(run[at] == run[at + n - 1]) & (zero[at + n] == zero[at])]
                found.append((mix64(rolled[good] + np.uint64(n)) & np.uint64(mask)).astype(np.int32))
                owner.append(token_of[run[good]])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner, minlength=len(tokens))


class SubwordModel:
    """``table``: one number per n-gram bucket, the projection of its embedding on the softmax' class difference; ``bias``: the
    margin of an empty passage; slope and offset turn the largest margin of a text into log odds."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def scorer(self):
        """``margins(texts)`` of a list of texts; a token's share of a margin is found once and remembered, up to ``KNOWN`` tokens."""
        table, mask, shares = self.table, len(self.table) - 1, {}

        def margins(texts: list[str | None]) -> np.ndarray:
            out, at = np.zeros(len(texts)), 0
            while at < len(texts):  # about CHARS characters at a time
                tokens, sizes = [], []
                first, size = at, 0
                while at < len(texts) and (at == first or size < CHARS):
                    more = tokens_of(texts[at])
                    tokens += more
                    sizes.append(len(more))
                    size += len(texts[at] or "")
                    at += 1
                if len(shares) > KNOWN:
                    shares.clear()
                if fresh := list(set(tokens).difference(shares)):
                    for k in range(0, len(fresh), PIECE):
                        part = fresh[k : k + PIECE]
                        g, n = grams(part, mask)
                        shares.update(zip(part, (np.bincount(np.repeat(np.arange(len(n)), n), table[g], len(n)) / np.maximum(n, 1)).tolist(), strict=True))
                out[first:at] = _tops(np.fromiter(map(shares.__getitem__, tokens), np.float64, len(tokens)), np.array(sizes))
            return self.slope * (self.bias + out) + self.offset

        return margins


KNOWN, CHARS, PIECE = 150_000, 1 << 20, 10_000


def _tops(shares: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The largest mean of each text's passages of ``SPAN`` tokens and PAD empty ones, 0 at least; texts are given one after the other."""
    passages = -(-sizes // SPAN)
    text = np.repeat(np.arange(len(sizes)), passages)
    if not len(text):
        return np.zeros(len(sizes))
    offset = np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages)
    starts = (np.cumsum(sizes) - sizes)[text] + offset * SPAN
    n = np.minimum(SPAN, sizes[text] - offset * SPAN)
    top = np.zeros(len(sizes))
    np.maximum.at(top, text, np.add.reduceat(shares, starts) / (n + PAD))
    return top


def _flat(which: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words ``which``, one after the other, and the place in ``which`` that each belongs to."""
    n = sizes[which]
    owner = np.repeat(np.arange(len(which), dtype=np.int32), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(starts[which], n) + offset], owner


def _sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of y on z, by Newton's method with a little ridge on the slope."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        g = np.array([((p - y) * w * z).sum() + 1e-3 * (a - 1), ((p - y) * w).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return (a, b) if a > 0 else (1.0, 0.0)


def _log_odds(tokens: list[np.ndarray], y: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, buckets: int) -> np.ndarray:
    """Each n-gram's log odds between texts of label 1 and of label 0, shrunk by SHRINK times its variance over its square."""
    seen = np.full((2, buckets), 0.5)
    for words, label in zip(tokens, y, strict=True):
        seen[int(label), np.unique(_flat(np.unique(words), sizes, starts, flat)[0])] += 1
    odds = np.log(seen[1] / ((y == 1).sum() + 1)) - np.log(seen[0] / ((y == 0).sum() + 1))
    return odds * np.maximum(0, 1 - SHRINK * (1 / seen).sum(0) / np.maximum(odds * odds, 1e-9))


def train(texts: list[str], labels: list[int], weights: list[float], *, bits: int = 18, dim: int = 4, epochs: int = 12, steps: int = 150, batch: int = 192, rate: float = 0.02, seed: int = 7) -> SubwordModel:
    """Fit on whole texts, both classes with equal weight, over ``epochs`` or as many as make ``steps`` batches; then slope and offset are set on every fifth text, which the fit left
    out, by ``weights`` that restore the classes' shares."""
    y, sw = np.asarray(labels, np.float64), np.asarray(weights, np.float64)
    share = float((y * sw).sum() / sw.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return SubwordModel(np.zeros(1 << bits), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    mask, vocabulary, tokens = (1 << bits) - 1, {}, []
    for text in texts:
        found = tokens_of(text) or [""]
        tokens.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in found), np.int32, len(found)))
    every = list(vocabulary)
    found = [grams(every[k : k + PIECE], mask) for k in range(0, len(every), PIECE)]
    flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    del every, found
    starts = np.cumsum(sizes) - sizes
    del vocabulary
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fitted = order[::5], np.concatenate([order[i::5] for i in range(1, 5)])
    if len(set(y[held])) < 2 or len(set(y[fitted])) < 2:
        held = fitted = order
    emb, out, bias = rng.normal(0, 0.02, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.5, (dim, 2)), np.array([START / 2, -START / 2])
    emb[np.bincount(flat, minlength=1 << bits) == 0] = 0
    toward = out[:, 1] - out[:, 0]
    emb += (GAIN * _log_odds([tokens[i] for i in fitted], y[fitted], sizes, starts, flat, 1 << bits)[:, None] * toward / (toward @ toward)).astype(np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    balance = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * len(fitted)
    parts = []
    for at in np.array_split(rng.permutation(fitted), max(1, len(fitted) // batch)):
        lengths = np.array([len(tokens[i]) for i in at])
        passages = -(-lengths // SPAN)
        first = np.cumsum(passages) - passages
        passage_of = np.concatenate([f + np.arange(n) // SPAN for f, n in zip(first, lengths, strict=True)]).astype(np.int32)
        words, word_of = np.unique(np.concatenate([tokens[i] for i in at]), return_inverse=True)
        part = (SCALE / (np.bincount(passage_of) + PAD)).astype(np.float32)[:, None]
        parts.append((at, np.repeat(np.arange(len(at), dtype=np.int32), passages), passage_of, word_of.astype(np.int32), part, words.astype(np.int32)))
    epochs = max(epochs, -(-steps // len(parts)))
    t, mean, n_mean = 0, [np.zeros_like(p) for p in (emb, out, bias)], 0
    for epoch in range(epochs):
        pace = rate * (1.0 - 0.8 * epoch / epochs)
        for at, doc_of, passage_of, word_of, part, words in parts:
            t += 1
            gram, owner = _flat(words, sizes, starts, flat)  # found anew each time: kept, they would be most of the memory
            inverse = (1.0 / np.maximum(sizes[words], 1))[:, None].astype(np.float32)
            word = _sum(owner, emb[gram], len(words)) * inverse
            passage = _sum(passage_of, word[word_of], len(part)) * part
            z = passage @ out + bias
            m = z[:, 1] - z[:, 0]
            # a text is clean if all its passages are: -log of that chance is the sum of their softplus margins
            clean = np.bincount(doc_of, np.logaddexp(0, m), len(at))
            dclean = np.where(y[at] == 1, -1 / np.expm1(np.clip(clean, 1e-6, 50)), 1.0) * balance[at] / len(at)
            dm = dclean[doc_of] * sigmoid(m)
            dz = np.stack([-dm, dm], 1)
            dword = _sum(word_of, ((dz @ out.T) * part)[passage_of], len(words)) * inverse
            grads = (_sum(gram, dword[owner], 1 << bits), passage.T @ dz + 1e-4 * out, dz.sum(0))
            for param, grad, (m1, m2) in zip((emb, out, bias), grads, state, strict=True):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                # a floor under the divisor: an n-gram that is rarely seen moves by less than a common one
                param -= (pace * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + FLOOR * np.sqrt(m2.max() / (1 - 0.99**t)) + 1e-12)).astype(param.dtype)
        if epoch >= epochs // 2:  # the model is the mean of the later epochs' ends, which steadies it
            n_mean += 1
            for kept, param in zip(mean, (emb, out, bias), strict=True):
                kept += (param - kept) / n_mean
    emb, out, bias = mean
    model = SubwordModel((emb @ (out[:, 1] - out[:, 0])).astype(np.float64) * SCALE, float(bias[1] - bias[0]))
    margin = model.scorer()
    slope, offset = _platt(margin([texts[i] for i in held]), y[held], sw[held] / sw[held].mean())
    return SubwordModel(model.table, model.bias, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, *, rows_each: int = 2000, max_chars: int = 12_000, **options) -> SubwordModel:
    """Fit on labelled documents: at most about ``rows_each`` of each class, with texts of up to ``max_chars`` characters.

    labels: doc_id and label (0, 1; null is no label; a repeated id counts once, with its largest label). Both bounds are for
    training alone. The sample's ids are few, so they are broadcast to the scan of the documents.
    """
    known = need(labels, doc_id="long", label="int").where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample, counts = bounded_sample(known, "label", rows_each)
    texts = need(docs, doc_id="long", text="string").where(F.length("text") <= max_chars)
    got = sorted(tuple(r) for r in texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label").collect())
    have = [sum(r[2] == k for r in got) for k in (0, 1)]
    weights = [counts.get(r[2], 0) / have[r[2]] for r in got]
    return train([r[1] for r in got], [r[2] for r in got], weights, **options)


def score(docs: DataFrame, model: SubwordModel, keep: bool = False) -> DataFrame:
    """doc_id, score and predicted, a row for each row; whole texts. ``keep`` adds ``row``, a struct of all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_text(docs, keep)

    def make():
        margins = shared.value.scorer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            z = sigmoid(margins(texts_of(batch).to_pylist()))
            kept = [batch.column("row")] if keep else []
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, pa.array(z), pa.array((z >= 0.5).astype(np.int32))], names=["doc_id", *["row"] * keep, "score", "predicted"])

        return step

    return by_arrow(rows, make, added_schema(rows, "text", "score double, predicted int"))
