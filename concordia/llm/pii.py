"""PII (10): a character-level bidirectional LSTM with CRF transitions, trained in numpy, beside exact base patterns.

Training windows come from labelled spans: those that the base patterns find in a bounded sample of documents, and synthetic
variants of the same kinds (spelt-out e-mail addresses, phone numbers without a plus sign, spaced card numbers) put into text of
the sample. The network reads every character of every text, in windows of ``SIZE`` characters that overlap by ``SIZE - STRIDE``. Each
window is decoded by Viterbi (a window in which no other path can beat the all-plain one is known from the emissions alone); where
windows overlap, each half of the overlap takes the tags of the window in which it lies further from an end, and runs of one tag
become spans over the whole text. Spans that touch a base span are dropped: base spans stay as they are, the network adds to them.
A span must hold what its kind cannot do without (``_trimmed``).

Texts of any length are read whole, ``BLOCK`` windows at a time, so memory is bounded by the text itself. Defined results: null texts
count as empty and have no spans; repeated rows get equal results, equal texts in a batch are read once; where decoded paths tie, the
tag of the lower number is taken; other columns are ignored, or kept in ``row`` whatever their names; if the sample has no base span,
training uses the synthetic ones alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_schema, by_arrow, need, with_row

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[\d@]|\(at\)|\[at\]", re.IGNORECASE)  # around which training windows are cut; reading needs none


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base patterns, by start and then kind in the order of KINDS; linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((start, m.end(), 0))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                parts, place = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = place + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        out.append((place, end, 1))
                    place = end + 1
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


def show(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


# --- the network ---------------------------------------------------------------------------------------------------

SIZE, STRIDE, BLOCK = 384, 336, 768
PIECE = 96  # characters of a training window
ALPHABET = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz.@+-_()[] \n0%,:")}
N_CHARS, N_TAGS = len(ALPHABET) + 2, 1 + len(KINDS)
CLASSES = np.array([ALPHABET["0"] if 48 <= c < 58 else ALPHABET.get(chr(c), N_CHARS - 1) for c in range(128)] + [N_CHARS - 1], np.uint8)
OTHER_DIGIT = re.compile(r"(?![0-9])\d")


def encode(text: str) -> np.ndarray:
    """Character classes: letters without case, all digits alike, other characters together."""
    low = text.lower()
    low = low if len(low) == len(text) else text
    if low.isascii():
        return CLASSES[np.frombuffer(low.encode(), np.uint8)]
    ids = CLASSES[np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]
    for m in OTHER_DIGIT.finditer(low):
        ids[m.start()] = ALPHABET["0"]
    return ids


class Tagger:
    """Two LSTMs, a linear layer and CRF transitions; all arrays by name in ``p``."""

    def __init__(self, hidden: int = 8, dim: int = 10, seed: int = 11):
        r = np.random.default_rng(seed)
        self.h = hidden
        f = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"emb": f(N_CHARS, dim), "out": f(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS), "tr": np.zeros((N_TAGS, N_TAGS))}
        for d in "fb":
            self.p |= {f"x{d}": f(dim, 4 * hidden), f"h{d}": f(hidden, 4 * hidden), f"b{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: (time, n, dim) in reading order. Gates: in, forget, out, new."""
        p, h = self.p, self.h
        steps, n, _ = x.shape
        hs, c, prev, cache = np.empty((steps, n, h), x.dtype), np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype), []
        pre = x @ p[f"x{d}"] + p[f"b{d}"]
        for t in range(steps):
            z = pre[t] + prev @ p[f"h{d}"]
            g = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h], -30, 30)))
            a = np.tanh(z[:, 3 * h :])
            c_new = g[:, h : 2 * h] * c + g[:, :h] * a
            th = np.tanh(c_new)
            if keep:
                cache.append((g, a, c, th, prev))
            c, prev = c_new, g[:, 2 * h :] * th
            hs[t] = prev
        return hs, cache

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["emb"][ids.T]
        hf, cf = self._lstm(x, "f", keep)
        hb, cb = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([hf, hb[::-1]], 2)
        return both @ self.p["out"] + self.p["ob"], (x, both, cf, cb)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Viterbi tags, (n, time)."""
        e, _ = self.emissions(ids)
        back, best = [], e[0]
        for t in range(1, len(e)):
            s = best[:, :, None] + self.p["tr"][None]
            back.append(s.argmax(1))
            best = s.max(1) + e[t]
        tags = [best.argmax(1)]
        for b in reversed(back):
            tags.append(b[np.arange(len(b)), tags[-1]])
        return np.stack(tags[::-1], 1)

    def loss_and_grads(self, ids: np.ndarray, tags: np.ndarray):
        """Mean negative log likelihood a window, by forward-backward, and its gradients through time."""
        p, h = self.p, self.h
        e, (x, both, cf, cb) = self.emissions(ids, True)
        steps, n, k = e.shape
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + p["tr"], 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["tr"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - log_z[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + p["tr"] + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]).sum((0, 1))
        tt, rows = tags.T, np.arange(n)
        gold = sum(e[t, rows, tt[t]].sum() for t in range(steps)) + p["tr"][tt[:-1], tt[1:]].sum()
        loss = (log_z.sum() - gold) / n
        for t in range(steps):
            de[t, rows, tt[t]] -= 1
        np.subtract.at(pair, (tt[:-1].ravel(), tt[1:].ravel()), 1)
        de /= n
        g = {"tr": pair / n, "out": both.reshape(-1, 2 * h).T @ de.reshape(-1, k), "ob": de.sum((0, 1))}
        dboth = de @ p["out"].T
        dx = np.zeros_like(x)
        for d, cache, dh_all, xs, dxs in (("f", cf, dboth[:, :, :h], x, dx), ("b", cb, dboth[::-1, :, h:], x[::-1], dx[::-1])):
            gh, dz_all = np.zeros_like(p[f"h{d}"]), np.empty((steps, n, 4 * h), x.dtype)
            dh, dc = np.zeros((n, h)), np.zeros((n, h))
            for t in range(steps - 1, -1, -1):
                gates, a, c_before, th, before = cache[t]
                i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                dh = dh + dh_all[t]
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * a * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - a * a)], 1)
                gh += before.T @ dz
                dz_all[t] = dz
                dh, dc = dz @ p[f"h{d}"].T, dc * f
            flat = dz_all.reshape(-1, 4 * h)
            g |= {f"h{d}": gh, f"b{d}": flat.sum(0), f"x{d}": xs.reshape(-1, xs.shape[2]).T @ flat}
            dxs += dz_all @ p[f"x{d}"].T
        ge = np.zeros_like(p["emb"])
        np.add.at(ge, ids.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return loss, g | {"emb": ge}

    def fit(self, ids: np.ndarray, tags: np.ndarray, *, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 3) -> float:
        r, t, loss = np.random.default_rng(seed), 0, 0.0
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for epoch in range(epochs):
            for at in np.array_split(r.permutation(len(ids)), max(1, len(ids) // batch)):
                loss, grads = self.loss_and_grads(ids[at], tags[at])
                t += 1
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                for k, g in grads.items():
                    m, v = state[k]
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= rate * (0.5 ** (epoch // 4)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return float(loss)

    def reader(self):
        """``tags(ids) -> (n, time)`` for ids (n, time): the same network in single precision, a row of numbers for each unit, so that every
        step is a few operations on whole rows. Gates are 1 / (1 + exp(-sum)), and so are values by tanh x = 2 / (1 + exp(-2 x)) - 1, as exp
        costs less than tanh; characters go through tables. What a step's hidden values emit comes with the sums of the step after it."""
        f, h = np.float32, self.h
        scale = np.concatenate([np.full(3 * h, -1.0), np.full(h, -2.0)])[:, None]
        tables = {d: np.ascontiguousarray((scale * (self.p["emb"] @ self.p[f"x{d}"] + self.p[f"b{d}"]).T).astype(f)) for d in "fb"}
        # cells and hidden values are kept halved, so what reads them is doubled; emissions are those above the plain tag's
        above = 2 * (self.p["out"][:, 1:] - self.p["out"][:, :1])
        both = {d: np.ascontiguousarray(np.concatenate([2 * scale * self.p[f"h{d}"].T, above[k * h : (k + 1) * h].T]).astype(f)) for k, d in enumerate("fb")}
        bias, tr = (self.p["ob"][1:] - self.p["ob"][0]).astype(f)[:, None], self.p["tr"].astype(f)
        lead = max(0.0, float((tr - tr[0, 0]).max()))  # what a step off the plain path can gain by transitions

        @np.errstate(over="ignore")  # 1 / (1 + inf) is 0
        def emissions(ids: np.ndarray) -> np.ndarray:
            steps, n = ids.shape
            e = np.empty((steps, N_TAGS - 1, n), f)
            e[:] = bias
            z, sums = np.empty((4 * h, n), f), np.empty((4 * h + N_TAGS - 1, n), f)
            gates, new, more, x = z[: 3 * h], z[3 * h :], sums[: 4 * h], sums[4 * h :]
            for d in "fb":
                c, hidden, last = np.zeros((h, n), f), np.zeros((h, n), f), None
                for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                    np.take(tables[d], ids[t], axis=1, out=z, mode="clip")
                    if last is not None:
                        np.matmul(both[d], hidden, out=sums)
                        e[last] += x
                        z += more
                    np.exp(z, out=z)
                    z += f(1)
                    np.reciprocal(z, out=z)
                    new -= f(0.5)
                    new *= gates[:h]
                    c *= gates[h : 2 * h]
                    c += new
                    np.multiply(c, f(-4), out=hidden)
                    np.exp(hidden, out=hidden)
                    hidden += f(1)
                    np.reciprocal(hidden, out=hidden)
                    hidden -= f(0.5)
                    hidden *= gates[2 * h :]
                    last = t
                e[last] += np.matmul(both[d], hidden, out=sums)[4 * h :]
            return e

        def tags(ids: np.ndarray) -> np.ndarray:
            e = emissions(np.ascontiguousarray(ids.T.astype(np.intp)))
            found = np.zeros(ids.shape, np.uint8)
            doubt = np.flatnonzero(e.max((0, 1)) + 2 * lead > 0)
            if len(doubt):
                some = np.ascontiguousarray(e[:, :, doubt].transpose(0, 2, 1))
                found[doubt] = viterbi(np.concatenate([np.zeros((*some.shape[:2], 1), f), some], 2), tr)
            return found

        return tags


def viterbi(e: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best paths, (n, time), for emissions (time, n, tags); where several are, from the lower tags."""
    steps, n, k = e.shape
    e, step = np.ascontiguousarray(e.transpose(0, 2, 1)), [np.ascontiguousarray(row[:, None]) for row in transitions]
    back, best = np.zeros((steps, k, n), np.uint8), e[0]
    new, better = np.empty((k, n), np.result_type(e, transitions)), np.empty((k, n), bool)
    for t in range(1, steps):
        top = best[0] + step[0]
        for tag in range(1, k):
            np.add(best[tag], step[tag], out=new)
            np.greater(new, top, out=better)
            np.copyto(back[t], tag, where=better)
            np.maximum(new, top, out=top)
        best = top + e[t]
    tags, rows = np.empty((steps, n), np.intp), np.arange(n)
    tags[-1] = best.argmax(0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t, tags[t], rows]
    return tags.T


def window_starts(length: int) -> list[int]:
    """Starts of the windows that cover a text; the last one ends with it."""
    return [*range(0, max(0, length - SIZE), STRIDE), max(0, length - SIZE)] if length else []


def owned(starts: list[int], length: int) -> list[int]:
    """Where each window's own part begins, halfway into its overlap with the one before; at last the text's end."""
    return [0, *((a + SIZE + b) // 2 for a, b in zip(starts, starts[1:], strict=False)), length]


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of one tag over a whole text."""
    edges = np.flatnonzero(np.diff(tags, prepend=np.uint8(0), append=np.uint8(0)))
    return [(int(a), int(b), KINDS[tags[a] - 1]) for a, b in zip(edges, edges[1:], strict=False) if tags[a]]


def read_texts(texts: list[str], tags) -> list[list[tuple[int, int, str]]]:
    """Decoded spans of whole texts: windows of all texts queue up to ``BLOCK``; a text's tags are put together from its windows."""
    spans: list[list] = [[] for _ in texts]
    rows, places, ids = [], [], np.zeros((BLOCK, SIZE), np.uint8)
    left: dict[int, tuple[np.ndarray, int]] = {}

    def flush():
        if not rows:
            return
        got = tags(ids[: len(rows)])
        for row, (i, start, a, b) in enumerate(places):
            whole, n = left[i]
            whole[a:b] = got[row, a - start : b - start]
            left[i] = whole, n - 1
            if n == 1:
                spans[i] = spans_of(whole)
                del left[i]
        rows.clear(), places.clear()

    for i, text in enumerate(texts):
        starts = window_starts(len(text))
        if not starts:
            continue
        code, cuts = encode(text), owned(starts, len(text))
        left[i] = np.zeros(len(text), np.uint8), len(starts)
        for k, start in enumerate(starts):
            piece = code[start : start + SIZE]
            ids[len(rows), : len(piece)] = piece
            ids[len(rows), len(piece) :] = 0
            rows.append(i), places.append((i, start, cuts[k], cuts[k + 1]))
            if len(rows) == BLOCK:
                flush()
    flush()
    return spans


AT = re.compile(r"@|[(\[]\s*at\s*[)\]]|\bat\b.*\bdot\b", re.IGNORECASE | re.DOTALL)


def _trimmed(text: str, span: tuple[int, int, str]) -> tuple[int, int, str] | None:
    """A decoded span without blanks and punctuation at its ends; None if too little is left to be personal data."""
    s, e, kind = span
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    digits = sum(c.isdecimal() for c in text[s:e])
    enough = {"email": AT.search(text[s:e]) and e - s >= 6, "ip": digits >= 4, "card": digits >= 12, "phone": digits >= 7}[kind]
    return (s, e, kind) if enough else None


def added_spans(text: str, base: list[tuple[int, int, str]], decoded: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Decoded spans, trimmed, that touch no base span."""
    starts = [s for s, _, _ in base]
    reach = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []
    out = []
    for span in decoded:
        if got := _trimmed(text, span):
            before = bisect_left(starts, got[1])
            if not before or reach[before - 1] <= got[0]:
                out.append(got)
    return out


def variant(r: np.random.Generator, held: bool = False) -> tuple[str, str]:
    """A synthetic labelled span: its text and kind. ``held``: of the forms that training never sees, kept for measuring."""
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvwy"), r.integers(2, 10)))
    kind = KINDS[r.integers(4)]
    if kind == "email":
        user, host, top = w() + r.choice(["", ".", "_"]) + r.choice([w(), d(2)]), w(), r.choice(["com", "org", "net", "co.uk", "de"])
        forms = (f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} (at) {host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user} @ {host}.{top}", f"{user} at {host} dot {top}")
        kept = (f"{user}(at){host}.{top}", f"{user} (AT) {host} (DOT) {top}", f"{user} @{host}.{top}")
    elif kind == "ip":
        parts = [str(x) for x in r.integers(0, 256, 4)]
        forms, kept = (".".join(parts),), (".".join(parts), "-".join(parts))
    elif kind == "card":
        four = [d(4) for _ in range(4)]
        forms, kept = ("".join(four), "".join(four), " ".join(four), "-".join(four)), (".".join(four), "  ".join(four), f"{d(4)} {d(6)} {d(5)}")
    else:
        forms = (f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(11)}", f"{d(3)}-{d(3)}-{d(4)}")
        kept = (f"00{d(2)} {d(3)} {d(7)}", f"({d(3)}){d(3)}-{d(4)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}")
    forms = kept if held else forms
    return forms[r.integers(len(forms))], kind


def training_windows(texts: list[str], n_real: int, n_made: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: around base spans, around other digits, plain ones, and with synthetic spans put in."""
    r, pieces = np.random.default_rng(seed), []
    for text in texts:
        spans = base_spans(text)
        for s, e, _ in spans:
            at = max(0, s - int(r.integers(0, PIECE - 20)))
            pieces.append((text[at : at + PIECE], [(max(x, at) - at, min(y, at + PIECE) - at, k) for x, y, k in spans if x < at + PIECE and y > at]))
        for m in list(TRIGGER.finditer(text))[:3]:
            at = max(0, m.start() - int(r.integers(10, PIECE - 10)))
            pieces.append((text[at : at + PIECE], [(max(x, at) - at, min(y, at + PIECE) - at, k) for x, y, k in spans if x < at + PIECE and y > at]))
    pieces = [pieces[i] for i in r.permutation(len(pieces))[:n_real]]
    plain = [t for t in texts if len(t) > 2 * PIECE] or ["the text of a document without any personal data in it, only words. " * 4]
    for _ in range(n_made):
        text = plain[r.integers(len(plain))]
        at = int(r.integers(0, len(text) - PIECE))
        left, right = text[at : at + int(r.integers(0, 60))], text[at + 60 : at + 60 + PIECE]
        kind = r.integers(4)
        if kind == 0:  # digits that are nothing personal: years, counts, versions, hexadecimal keys
            what, spans = (str(r.integers(1, 3000)), f"version {r.integers(1, 9)}.{r.integers(0, 20)}", f'token = "{r.bytes(16).hex()}"', f"{r.integers(1, 999)}%")[r.integers(4)], []
        else:
            what, name = variant(r)
            spans = [(len(left) + 1, len(left) + 1 + len(what), name)]
        piece = f"{left} {what} {right}"[:PIECE]
        pieces.append((piece, [(s, min(e, len(piece)), k) for s, e, k in spans if s < len(piece)]))
    ids, tags = np.zeros((len(pieces), PIECE), np.int64), np.zeros((len(pieces), PIECE), np.int64)
    for i, (piece, spans) in enumerate(pieces):
        code = encode(piece)
        ids[i, : len(code)] = code
        for s, e, k in spans:
            tags[i, s:e] = KINDS.index(k) + 1
    return ids, tags


def train(texts: list[str], *, n_real: int = 1200, n_made: int = 1800, epochs: int = 8, hidden: int = 8) -> Tagger:
    tagger = Tagger(hidden)
    tagger.fit(*training_windows(texts, n_real, n_made), epochs=epochs)
    return tagger


def fit(docs: DataFrame, *, rows: int = 600, max_chars: int = 20_000, **options) -> Tagger:
    """Fit on at most about ``rows`` documents of up to ``max_chars`` characters with a digit or ``@``, picked by a hash of the id
    (bounds for training alone)."""
    texts = need(docs, doc_id="long", text="string").where((F.length("text") <= max_chars) & F.col("text").rlike("[0-9@]"))
    n = texts.count()
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(99)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = sorted((r[0], r[1]) for r in texts.where(unit < min(1.0, rows / max(1, n))).collect() if r[0] is not None)
    return train([t for _, t in got], **options)


def find_pii(docs: DataFrame, tagger: Tagger, keep: bool = False) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added; kind:start:end, code points, end exclusive) and n_added,
    for each row; ``keep`` adds ``row``, a struct of all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = with_row(docs, keep, doc_id="long", text="string")

    def make():
        tags, order = shared.value.reader(), {k: i for i, k in enumerate(KINDS)}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = [t or "" for t in batch.column("text").to_pylist()]
            texts = list(dict.fromkeys(given))
            found = {}
            for text, decoded in zip(texts, read_texts(texts, tags), strict=True):
                base = base_spans(text)
                added = added_spans(text, base, decoded)
                spans = show(sorted(base + added, key=lambda x: (x[0], order[x[2]])))
                found[text] = (*(sum(x[2] == k for x in base) for k in KINDS), hashlib.sha256(show(base).encode()).hexdigest(), spans, len(added))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            cols = [pa.array([found[t][k] for t in given], kind) for k, kind in enumerate(kinds)]
            kept = [batch.column("row")] if keep else []
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *kept, *cols], names=["doc_id", *["row"] * keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

        return step

    return by_arrow(rows, make, added_schema(rows, "text", "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"))
