"""Language ID (9): error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1. One binary logistic classifier per bit, on a text's hashed 1- to 3-byte n-grams,
predicts the codeword; the language whose codeword loses least, with each bit's loss weighted by how well that bit did on
held-back training texts, is chosen. A text is flagged as ambiguous when the two best codewords lose nearly alike.

Defined results: a null text or one without a letter is ``und`` with score 0; empty tables give empty tables; repeated rows get
equal results; texts of any length are counted whole, in memory of their own size; where losses tie, the language first by name wins;
other columns are ignored, or kept in ``row`` whatever their names; with one known language it is predicted for every text with a letter; with none, ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_schema, bounded_sample, by_arrow, need, sigmoid, with_row

LETTER = regex.compile(r"\p{L}")
BUCKETS = 1 << 13


def counts(text: str) -> np.ndarray:
    """Square roots of the shares of a text's hashed n-grams; the whole text, blanks folded to one byte before and after."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    b[b < 65] = 32  # digits, blanks and punctuation tell nothing
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:] + np.uint32(1)
    ids = [(x * np.uint32(2654435761)) >> np.uint32(32 - 13) for x in (b, two + np.uint32(1 << 17), three + np.uint32(1 << 25))]
    n = sum(np.bincount(x, minlength=BUCKETS) for x in ids)
    return np.sqrt(n / max(1, len(b))).astype(np.float32)


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """``n`` codewords far apart: of many random matrices the one whose least distance is greatest, each bit splitting the set."""
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        for k in range(bits):  # a bit that all languages share would predict nothing
            if n > 1 and abs(m[:, k].sum()) == n:
                m[rng.integers(n), k] *= -1
        least = min((int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if least > most:
            best, most = m, least
    return best


class CodeModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of counts: the language's number, a score from the losses' softmax, and whether it is ambiguous."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        rest = np.sort(loss, 1)
        close = (rest[:, 1] - rest[:, 0] < 0.1 * self.trust.sum()) if loss.shape[1] > 1 else np.zeros(len(x), bool)
        return best, p[np.arange(len(x)), best], close


def train(texts: list[str], langs: list[str], *, bits: int | None = None, steps: int = 120, rate: float = 0.1) -> CodeModel:
    languages = sorted(set(langs))
    n = len(languages)
    bits = bits or max(15, 5 * int(np.ceil(np.log2(max(2, n)))))
    code = codewords(n, bits) if n else np.zeros((0, bits))
    if n < 2:
        return CodeModel(languages, code, np.zeros((BUCKETS, bits), np.float32), np.zeros(bits), np.ones(bits))
    x = np.stack([counts(t) for t in texts])
    which = np.array([languages.index(v) for v in langs])
    y = (code[which] > 0).astype(np.float64)
    balance = 1.0 / np.bincount(which, minlength=n)[which]
    held = np.arange(len(x)) % 5 == 4
    if not held.any() or held.all():
        held[:] = False
    w, b = np.zeros((BUCKETS, bits)), np.zeros(bits)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    xs, ys, bs = x[~held], y[~held], (balance[~held] / balance[~held].sum())[:, None]
    for t in range(1, steps + 1):
        d = (sigmoid(xs @ w + b) - ys) * bs
        for p, g, (m, v) in zip((w, b), (xs.T @ d + 1e-5 * w, d.sum(0)), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    at = held if held.any() else ~held
    good = (((x[at] @ w + b) > 0) == (y[at] > 0)).mean(0)
    trust = np.maximum(good - 0.5, 0.01) * 2
    return CodeModel(languages, code, w.astype(np.float32), b, trust)


def fit(docs: DataFrame, *, rows_each: int = 400, rows_total: int = 6000, max_chars: int = 30_000, **options) -> CodeModel:
    """Fit on at most about ``rows_each`` documents of every language (doc_id, text, lang; null lang is none), fewer where all languages
    together would exceed ``rows_total`` (32 KB of counts each), of up to ``max_chars`` characters; the bounds are for training alone."""
    known = need(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    sample, _ = bounded_sample(known, "lang", rows_each, total=rows_total)
    got = sorted((r[0], r[1], r[2]) for r in sample.collect() if r[0] is not None and LETTER.search(r[1]))
    return train([r[1] for r in got], [r[2] for r in got], **options)


def predict(docs: DataFrame, model: CodeModel, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous, for each row; ``keep`` adds ``row``, a struct of all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_row(docs, keep, doc_id="long", text="string")

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores, close = ["und"] * len(batch), np.zeros(len(batch)), np.zeros(len(batch), bool)
            block, where = [], []

            def flush():
                if block:
                    best, p, near = m.decode(np.stack(block))
                    for i, k in zip(where, best.tolist(), strict=True):
                        names[i] = m.languages[k]
                    scores[where], close[where] = p, near
                    block.clear(), where.clear()

            for i, t in enumerate(batch.column("text")):
                text = t.as_py()
                if text and m.languages and LETTER.search(text):
                    block.append(counts(text))
                    where.append(i)
                    if len(block) == 500:
                        flush()
            flush()
            kept = [batch.column("row")] if keep else []
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, pa.array(names, pa.string()), pa.array(scores), pa.array(close)], names=["doc_id", *["row"] * keep, "lang_pred", "score", "ambiguous"])

        return step

    return by_arrow(rows, make, added_schema(rows, "text", "lang_pred string, score double, ambiguous boolean"))
