"""Very long texts: whole, in bounded memory and linear time."""

import random
import time
import tracemalloc

import numpy as np

from concordia.llm import decontaminate, language, media, pii, quality, toxicity


def peak(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_pii_reads_in_blocks():
    text = "line of words with 12:30 and more, " * 30_000 + "mail jane@acme.org"  # a megabyte of digits
    flat = lambda ids: np.zeros(ids.shape, np.uint8)
    spans, used = peak(lambda: pii.read_texts([text], flat))
    assert spans == [[]] and used < 6 * len(text)
    assert pii.show(pii.base_spans(text)) == f"email:{len(text) - 13}:{len(text)}"
    net = pii.Tagger(hidden=3).reader()
    part = text[: pii.BLOCK * pii.STRIDE + 5000]
    assert len(pii.read_texts([part], net)) == 1


def test_quality_holds_little_beside_the_text():
    text = b"\n".join(b"a line of a few words, number %d." % i for i in range(60_000))
    (own, sizes), used = peak(lambda: quality.line_features(text))
    assert len(own) == len(sizes) == 60_000 and used < 16 * len(text)
    weights = np.random.default_rng(0).normal(size=quality.N_FEATURES)
    assert np.allclose(quality.line_scores(weights, own), weights[quality.binned(own)].sum(1))
    for n in (1, 2, quality.PIECE, quality.PIECE + 1, 2 * quality.PIECE + 3):
        assert np.allclose(quality.line_scores(weights, own[:n]), weights[quality.binned(own[:n])].sum(1))


def test_validators_are_linear():
    sniff = media.sniffer()
    took = []
    cases = (b"%PDF-1.4 ", b"PK\x03\x04" + bytes(26), b"OggS\x00" + bytes(21) + b"\x01\xff", b"\xff\xd8\xff\xc0\x00\x04ab\xff\xda\x00\x04cd", b"\x1f\x8b\x08")
    for piece in cases:
        sniff(piece * 500)
        for n in (10_000, 80_000):
            began = time.thread_time()
            sniff(piece * n)
            took.append(time.thread_time() - began)
    for small, large in zip(took[::2], took[1::2], strict=True):
        assert large < 20 * small + 0.3, took  # 8 times the value; a quadratic search takes 64 times as long


def test_broken_chains_and_whole_ones():
    sniff = media.sniffer()
    import io
    import zipfile

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for i in range(5):
            z.writestr(f"f{i}", "x" * i)
    good = held.getvalue()
    assert [x[0] for x in sniff(b"junk" + good + b"tail")] == ["application/zip"]
    assert sniff(good[:-30]) == []
    import gzip

    named = io.BytesIO()
    with gzip.GzipFile("a name", "wb", fileobj=named) as z:
        z.write(bytes(range(256)) * 900)
    plain = gzip.compress(b"plain")
    value = b"\x1f\x8b\x08\x08 never ends" + plain + b"--" + named.getvalue() + b"tail"
    assert [(t, e - s) for t, s, e in sniff(value)] == [("application/gzip", len(plain)), ("application/gzip", len(named.getvalue()))]
    pdf = b"%PDF-1.4 body startxref\n5\n%%EOF"
    assert [(t, s) for t, s, _ in sniff(b"%PDF-1.4 nothing " + b"x" * 200 + pdf)] == [("application/pdf", 0)]
    assert [(t, s) for t, s, _ in sniff(b"%PDF-x" + pdf)] == [("application/pdf", 6)]


def test_toxicity_and_language_read_scripts_without_blanks():
    r = random.Random(2)
    text = "".join(r.choice("漢字仮名交文長短") for _ in range(5000))
    table = np.zeros(1 << 18)
    late = text[:4800] + "毒毒毒毒" + text[4804:]
    g = set(toxicity.grams(toxicity.tokens_of(late), len(table) - 1)[0].tolist()) - set(toxicity.grams(toxicity.tokens_of(text), len(table) - 1)[0].tolist())
    table[list(g)] = 1.0
    a, b = toxicity.SubwordModel(table, -1.0).scorer()([late, text])
    assert a > b
    assert not np.array_equal(language.counts(late), language.counts(text))


def test_benchmark_bound_counts_words_as_they_are_split(spark):
    rows = spark.createDataFrame([("a", ",".join(f"w{i}" for i in range(3000)))], "item_id string, text string")
    assert decontaminate.load_windows(rows, max_words=2999) is None and decontaminate.load_windows(rows, max_words=3000) is not None
    docs = spark.createDataFrame([(1, "x " * 9 + " ".join(f"W{i}" for i in range(100, 130))), (2, "nothing of it"), (3, None)], "doc_id long, text string")
    one, two = (sorted(map(tuple, decontaminate.find_contamination(docs, rows, max_words=m).collect())) for m in (10, 10_000))
    assert one == two and [r[:3] for r in one] == [(1, 39, 30), (2, 3, 0), (3, 0, 0)] and one[0][4][0].asDict() == {"start": 9, "end": 39}
