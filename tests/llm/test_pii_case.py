"""Every character is read: spelt-out addresses in any case, other scripts' digits, and spans across the windows' ends."""

import itertools
import warnings

import numpy as np

from concordia.llm import pii


def test_windows_own_a_text_between_them():
    for n in (1, 50, pii.SIZE, pii.SIZE + 1, pii.SIZE + pii.STRIDE, 5000):
        starts = pii.window_starts(n)
        cuts = pii.owned(starts, n)
        assert cuts[0] == 0 and cuts[-1] == n and all(a < b for a, b in zip(cuts, cuts[1:]))
        assert all(s <= a and b <= s + pii.SIZE for s, a, b in zip(starts, cuts, cuts[1:]))
    assert pii.window_starts(0) == []


def test_reader_is_the_network():
    """The fast reading decodes as the plain one does: emissions of the training code and Viterbi over every window."""
    net = pii.Tagger(hidden=5, dim=4)
    net.p["ob"][0] += 0.5
    ids = np.random.default_rng(3).integers(0, pii.N_CHARS, (40, 60)).astype(np.uint8)
    plain = pii.viterbi(net.emissions(ids)[0], net.p["tr"])
    assert (net.reader()(ids) == plain).mean() > 0.999


def test_case_of_at():
    for at in ("(AT)", "[At]", "(at)", "@", "( at )"):
        text = "word " * 60 + f"jane.doe {at} acme.org" + " word" * 60
        s = text.index("jane")
        assert pii._trimmed(text, (s, s + 18 + len(at), "email")) is not None
    assert pii._trimmed("look at the words", (0, 17, "email")) is None
    assert (pii.encode("x ٣٤5 İ@") == pii.encode("x 345 é@")).all()


def test_texts_longer_than_a_block_are_put_together(monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    sevens = lambda ids: (ids == pii.ALPHABET["0"]).astype(np.uint8)  # noqa: E731  a network that tags digits
    text = ("word " * 100 + "1234567 ") * 9
    want = [(m, m + 7, "email") for m in (i for i in range(len(text)) if text.startswith("1234567", i))]
    assert pii.read_texts(["", text, "7", "no"], sevens) == [[], want, [(0, 1, "email")], []]


def test_viterbi_takes_the_best_and_lowest_path():
    r = np.random.default_rng(5)
    for _ in range(30):
        steps, k = int(r.integers(1, 6)), int(r.integers(1, 4))
        e, tr = r.integers(-1, 2, (steps, 2, k)).astype(np.float32), r.integers(-1, 2, (k, k)).astype(np.float32)
        for n, got in enumerate(pii.viterbi(e, tr)):
            worth = lambda p: sum(e[t, n, x] for t, x in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(map(worth, itertools.product(range(k), repeat=steps)))
            tied = [p for p in itertools.product(range(k), repeat=steps) if worth(p) == best]
            assert tuple(got) == min(tied, key=lambda p: p[::-1])


def test_reader_stays_finite_and_spares_tanh(monkeypatch):
    """Sums far beyond what single precision's exp holds give gates of 0 and 1; and reading takes no tanh, which costs more than exp."""
    net = pii.Tagger(hidden=3, dim=2)
    for d in "fb":
        net.p[f"x{d}"] *= 500
    ids = np.random.default_rng(4).integers(0, pii.N_CHARS, (20, 50)).astype(np.uint8)
    plain = pii.viterbi(net.emissions(ids)[0], net.p["tr"])
    tags = net.reader()
    monkeypatch.setattr(np, "tanh", None)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert (tags(ids) == plain).mean() > 0.99
