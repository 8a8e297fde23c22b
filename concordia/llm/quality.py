"""Quality classifier (7): a linear-chain conditional random field over a text's lines.

Each line gets a few binned features of its own and of its neighbours; the chain's two states are good and bad. Emissions and
transitions are trained in numpy by the gradient of the exact likelihood (forward-backward). Labels are of documents: the lines
of a good document are good; a line of a bad document is bad if a first model without chain, fitted with all lines of bad
documents as bad, finds it more likely bad than not, and its worst line always is. A document's quality comes from the
length-weighted mean of its lines' marginals, by a logistic curve of that one number fitted on the documents.

Defined results: a null or empty text is one empty line; a long text has any number of lines, taken whole, in about 150 bytes a line
beside the text; texts are scored together up to ``LINES`` lines; repeated rows get equal scores; a score of 0.5 is predicted 1; other
columns are ignored, or kept in ``row`` whatever their names; without rows of both classes every score is the share of label 1 (0 if
there are none); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_schema, bounded_sample, by_arrow, need, sigmoid, with_row

UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOL, BAR, END = b"%$#&*!@^~<>{}[]\\=_+`", b"|", b".!?:;"
N_RAW = 9
EDGES = (
    (1, 4, 16, 40, 100, 250, 800),  # bytes
    (0.05, 0.15, 0.3, 0.6),  # upper case
    (0.02, 0.1, 0.3),  # digits
    (0.005, 0.02, 0.05, 0.1, 0.2),  # symbols
    (0.005, 0.02, 0.08),  # bars
    (0.1, 0.25, 0.4, 0.6, 0.8, 0.95),  # distinct words
    (2.5, 4, 6, 9, 14),  # bytes a word
    (0.5, 1.5),  # earlier copies of the line: none, one, more
    (0.5,),  # ends like a sentence
)
WIDTH = sum(len(e) + 1 for e in EDGES)
STARTS = np.cumsum([0] + [len(e) + 1 for e in EDGES[:-1]])


LINES, PIECE = 50_000, 8192


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, N_RAW) bins of a text's lines, numbered over all features, and the lines' lengths; the whole text, ``PIECE`` lines at a
    time."""
    seen: dict[bytes, int] = {}
    out, size, done = [], [], []
    lines = text.split(b"\n")
    for number, line in enumerate(lines, 1):
        line = line.strip()
        n = len(line) or 1
        words = line.lower().split()
        k = len(words) or 1
        copies = seen[line] = seen.get(line, -1) + 1
        out.append((
            len(line),
            (n - len(line.translate(None, UPPER))) / n if line else 0,
            (n - len(line.translate(None, DIGIT))) / n if line else 0,
            (n - len(line.translate(None, SYMBOL))) / n if line else 0,
            line.count(b"|") / n,
            len(set(words)) / k if k > 3 else 1.0,
            n / k,
            copies if line else 0,
            float(line[-1:] in b".!?:;" and bool(line)),
        ))
        size.append(n)
        if number % PIECE == 0 or number == len(lines):
            raw = np.array(out, np.float64)
            done.append(np.stack([STARTS[j] + np.searchsorted(EDGES[j], raw[:, j], "right") for j in range(N_RAW)], 1).astype(np.int16))
            out = []
    return np.concatenate(done), np.array(size, np.float64)


def binned(own: np.ndarray) -> np.ndarray:
    """(lines, 3 * N_RAW) feature numbers: of the line, the one before and the one after (an own number at the ends)."""
    own = own.astype(np.int64)
    none = np.full((1, N_RAW), WIDTH)
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    return np.concatenate([own, before + WIDTH, after + 2 * WIDTH + 1], 1)


def line_scores(weights: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of the weights of each line's ``binned`` features, ``PIECE`` lines at a time."""
    out = np.empty(len(own))
    for at in range(0, len(own), PIECE):
        first = max(0, at - 1)
        piece = binned(own[first : at + PIECE + 1])
        if first:  # the line before is known: only its own line before is not
            piece = piece[1:]
        out[at : at + PIECE] = weights[piece[: min(PIECE, len(own) - at)]].sum(1)
    return out


N_FEATURES = 3 * WIDTH + 2


class Padded:
    """Documents' lines side by side for steps over positions, longest first, so that the ones still running are a prefix."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.first = (np.cumsum(lengths) - lengths)[self.order]
        self.running = [int(np.searchsorted(-self.lengths, -t, "left")) for t in range(int(self.lengths[0]) if len(lengths) else 0)]

    def rows(self, t: int) -> np.ndarray:
        return self.first[: self.running[t]] + t


def marginals(emission: np.ndarray, transition: np.ndarray, start: np.ndarray, pad: Padded) -> tuple[np.ndarray, np.ndarray, float]:
    """P(state) of every line, the expected transitions and the sum of log partition functions. emission: (lines, 2)."""
    n = len(emission)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    steps = len(pad.running)
    for t in range(steps):
        r = pad.rows(t)
        alpha[r] = emission[r] + (start if t == 0 else np.logaddexp(alpha[r - 1][:, :1] + transition[0], alpha[r - 1][:, 1:] + transition[1]))
    last = pad.first + pad.lengths - 1
    log_z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    for t in range(steps - 2, -1, -1):
        r = pad.rows(t + 1) - 1
        ahead = emission[r + 1] + beta[r + 1]
        beta[r] = np.logaddexp(transition[:, 0] + ahead[:, :1], transition[:, 1] + ahead[:, 1:])
    whole = np.empty(n)
    expected = np.zeros((2, 2))
    for t in range(steps):
        r = pad.rows(t)
        whole[r] = log_z[: len(r)]
        if t:
            ahead = emission[r] + beta[r]
            pair = alpha[r - 1][:, :, None] + transition[None] + ahead[:, None, :] - whole[r][:, None, None]
            expected += np.exp(pair).sum(0)
    return np.exp(alpha + beta - whole[:, None]), expected, float(log_z.sum())


class LineModel:
    def __init__(self, weights: np.ndarray, transition: np.ndarray, start: np.ndarray, curve: tuple[float, float]):
        self.weights, self.transition, self.start, self.curve = weights, transition, start, curve

    def line_marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(bad) of each line, from ``line_scores``."""
        return marginals(np.stack([-scores / 2, scores / 2], 1), self.transition, self.start, Padded(lengths))[0][:, 1]

    def margins(self, bad: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return a + b * _share(bad, sizes, lengths)


def _share(bad, sizes, lengths):
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(doc, bad * sizes, len(lengths)) / np.maximum(np.bincount(doc, sizes, len(lengths)), 1e-9)


def _worst(bad, lengths):
    return np.maximum.reduceat(bad, np.cumsum(lengths) - lengths) if len(lengths) else bad


class _Adam:
    def __init__(self, *params):
        self.params, self.t = params, 0
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def step(self, grads, rate):
        self.t += 1
        for p, g, (m, v) in zip(self.params, grads, self.state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-9)


def train(texts: list[bytes], labels: list[int], weights: list[float], *, steps: int = 60, ridge: float = 1e-3) -> LineModel:
    y, sw = np.asarray(labels, np.float64), np.asarray(weights, np.float64)
    share = float((y * sw).sum() / sw.sum()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return LineModel(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2), (float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 0.0))
    raw = [line_features(t) for t in texts]
    lengths = np.array([len(s) for _, s in raw])
    sizes = np.concatenate([s for _, s in raw])
    x = np.concatenate([binned(f) for f, _ in raw])
    doc = np.repeat(np.arange(len(y)), lengths)
    bad_doc = (1 - y)[doc]
    # each class weighs the same, and a line by its share of its document
    by_line = sizes / np.maximum(np.bincount(doc, sizes), 1)[doc] * np.where(bad_doc == 1, 0.5 / max((1 - y).sum(), 1), 0.5 / max(y.sum(), 1))
    w = np.zeros(N_FEATURES)
    fit = _Adam(w)
    columns = x.shape[1]
    count = lambda g: np.bincount(x.ravel(), np.repeat(g, columns), N_FEATURES)
    for _ in range(steps):
        fit.step([count((sigmoid(w[x].sum(1)) - bad_doc) * by_line) + ridge * w], 0.1)
    p = sigmoid(w[x].sum(1))
    worst = _worst(p, lengths)[doc]
    state = ((bad_doc == 1) & ((p > 0.5) | (p >= worst))).astype(int)
    transition, start, pad = np.zeros((2, 2)), np.zeros(2), Padded(lengths)
    fit = _Adam(w, transition, start)
    first = np.cumsum(lengths) - lengths
    inner = np.ones(len(x), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    seen = np.bincount(state[to - 1] * 2 + state[to], minlength=4).reshape(2, 2) if len(to) else np.zeros((2, 2))
    begun = np.bincount(state[first], minlength=2)
    for _ in range(steps // 2):
        score = w[x].sum(1)
        p, expected, _ = marginals(np.stack([-score / 2, score / 2], 1), transition, start, pad)
        fit.step([count(p[:, 1] - state) / len(x) + ridge * w, (expected - seen) / len(x) + ridge * transition, (p[first].sum(0) - begun) / len(y) + ridge * start], 0.05)
    model = LineModel(w, transition, start, (0.0, 0.0))
    bad = model.line_marginals(w[x].sum(1), lengths)
    v = np.stack([np.ones(len(y)), _share(bad, sizes, lengths)], 1)
    c, sw = np.zeros(2), sw / sw.sum()
    for _ in range(40):
        q = sigmoid(v @ c)
        h = (v * (sw * q * (1 - q))[:, None]).T @ v + 1e-4 * np.eye(2)
        c -= np.clip(np.linalg.solve(h, v.T @ ((q - y) * sw) + 1e-4 * c), -2, 2)
    model.curve = tuple(float(z) for z in c)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, rows_each: int = 1200, max_chars: int = 30_000, **options) -> LineModel:
    """Fit on at most about ``rows_each`` documents of each label whose texts have up to ``max_chars`` characters (bounds for
    training alone). labels: doc_id and label (0, 1; else none; of a repeated id the largest)."""
    known = need(labels, doc_id="long", label="int").where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample, counts = bounded_sample(known, "label", rows_each)
    texts = need(docs, doc_id="long", text="string").where(F.length("text") <= max_chars)
    got = sorted((r[0], bytes(r[1] or b""), r[2]) for r in texts.join(F.broadcast(sample), "doc_id").select("doc_id", F.col("text").cast("binary"), "label").collect())
    have = [sum(r[2] == k for r in got) for k in (0, 1)]
    return train([r[1] for r in got], [r[2] for r in got], [counts.get(r[2], 0) / have[r[2]] for r in got], **options)


def score(docs: DataFrame, model: LineModel, keep: bool = False, lines: bool = False) -> DataFrame:
    """doc_id, score, predicted, and with ``lines`` also bad_lines: P(bad) of every line; ``keep`` adds ``row``, a struct of all columns
    of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_row(docs, keep, doc_id="long", text="binary")

    def make():
        m = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            z, shown, waiting, held = [], [], [], 0

            def flush():
                if waiting:
                    lengths = np.array([len(x) for x, _ in waiting])
                    bad = m.line_marginals(np.concatenate([x for x, _ in waiting]), lengths)
                    z.append(sigmoid(m.margins(bad, np.concatenate([s for _, s in waiting]), lengths)))
                    if lines:
                        shown.extend(np.split(bad, np.cumsum(lengths)[:-1]))
                    waiting.clear()

            for t in batch.column("text"):
                own, sizes = line_features(t.as_py() or b"")
                waiting.append((line_scores(m.weights, own), sizes))
                held += len(sizes)
                if held >= LINES:
                    flush()
                    held = 0
            flush()
            z = np.concatenate(z) if z else np.zeros(0)
            out = [pa.array(z), pa.array((z >= 0.5).astype(np.int32))]
            if lines:
                out.append(pa.array(shown, pa.list_(pa.float64())))
            kept = [batch.column("row")] if keep else []
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, *out], names=["doc_id", *["row"] * keep, "score", "predicted", *["bad_lines"] * lines])

        return step

    return by_arrow(rows, make, added_schema(rows, "text", "score double, predicted int" + ", bad_lines array<double>" * lines))
