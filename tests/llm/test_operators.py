"""Each corpus operator on small tables: against brute force, and on nulls, empty and long texts, repeated rows, empty tables and extra
columns."""

import gzip
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from concordia.llm import decontaminate, graph, jaccard_join, language, media, mixing, pii, quality, sharding, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
ODD = [(900, None, None, None, None, "x", "y"), (901, "", "en", "s1", 0, None, None), (902, " \n\t ", "en", "s1", 3, None, None), (903, "word " * 20_000, "en", None, 1, None, None), (904, "same text here", "en", "s2", 1, None, None), (904, "same text here", "en", "s2", 1, None, None), (None, "no id here", None, "s2", 1, None, None)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(5 + 13 * i % 200, i), "en", f"s{i % 4}", 1, None, None) for i in range(60)]
    near = rows[9][1].split()
    rows += [(100 + k, " ".join(near[: len(near) - k]), "en", "s1", 1, None, None) for k in range(6)]
    return spark.createDataFrame(rows + ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join_is_brute_force(docs, none):
    got = jaccard_join.linked_components(docs).collect()
    assert len(got) == docs.count()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.linked_components(none).count() == 0
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(docs).collect() if r.doc_id is not None)
    assert kept == sorted({c for _, c in want.values()})


def test_jaccard_large_blocks_meet_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 8)
    base = words(200, 1).split()
    rows = []
    for i in range(40):
        w, r = list(base), random.Random(i)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_divide_skip_finds_all():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(80)]
    index = jaccard_join.Index(sets)
    for percent in (50, 80):
        for i, s in enumerate(sets):
            want = [j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))]
            assert sorted(jaccard_join.search(index, s, np.ones(len(sets), bool), percent).tolist()) == want, (percent, i)
    lists = [sorted(set(r.integers(0, 99, 90).tolist())) for _ in range(9)]
    for a, b in ((lists[:3], 2), (lists, 4), (lists, 9), (lists[:1], 1), (lists[:2], 3)):
        count = np.bincount(np.concatenate(a), minlength=99)
        want = np.flatnonzero(count >= b).tolist()
        assert jaccard_join.merge_skip(a, b) == (want, count[want].tolist())


def test_rare_prefixes_meet_for_every_link():
    r = np.random.default_rng(1)
    levels = r.integers(0, 4, 1 << jaccard_join.LEAST_BITS).astype(np.uint8)
    for percent in (80, 90):
        for n in (1, 5, 10, 19, 40, 300):
            for _ in range(30):
                s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                cut = s[: len(s) - r.integers(0, 1 + len(s) // 10)]
                t = np.unique(np.concatenate([cut, r.integers(0, 1 << 63, max(0, len(s) // 30), dtype=np.uint64)]))
                if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t)):
                    assert set(jaccard_join.prefix(s, levels, percent).tolist()) & set(jaccard_join.prefix(t, levels, percent).tolist())


def test_cells_bound_every_link():
    r = np.random.default_rng(2)
    for n in (3, 60, 127, 140, 900):
        sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(6)]
        sets += [np.unique(np.concatenate([s[: len(s) - len(s) // 30], r.integers(0, 1 << 63, len(s) // 30, dtype=np.uint64)])) for s in sets[:3]]
        for percent in (80, 90):
            linked = {i for i, s in enumerate(sets) for j, t in enumerate(sets) if i != j and 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
            keep = jaccard_join.possible(np.array([len(s) for s in sets]), [jaccard_join.cells_of(s) for s in sets], percent)
            assert linked <= set(np.flatnonzero(keep).tolist()) and (n < 100 or keep.sum() == len(linked) == 6)


def test_common_shingles_are_salted(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)
    base = words(60, 1).split()
    rows = [(i, " ".join(w if (k + i) % 43 else f"y{i}" for k, w in enumerate(base[: 60 - i % 5]))) for i in range(90)]
    got = jaccard_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_templates_make_few_members(spark):
    """Texts that share seven tenths of their words are linked with nothing: hardly any of them may meet in a block."""
    shared = words(140, 5).split()
    rows = [(i, " ".join(shared + words(60, 1000 + i).split())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    levels = jaccard_join.rarity(jaccard_join.scan(docs, 3, 18), 18)
    assert jaccard_join.members(jaccard_join.shown(docs, levels, 3, 90), 90).count() < 100
    got = jaccard_join.linked_components(docs).collect()
    assert all(r.doc_id == r.component_id for r in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(200, i) for i in range(201, 260)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(200, 260), 200)}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark, docs, none):
    text = words(60, 77)
    bench = spark.createDataFrame([("b1", text), ("b2", "two, Words"), ("b3", ""), ("b4", None), ("b1", text), (None, "same text")], "item_id string, text string")
    extra = spark.createDataFrame([(500, "Zz " + text.upper() + " zz"), (501, "so TWO-words it is"), (502, " ".join(text.split()[:12]))], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra)

    def brute(t):
        w = [x.decode() for x in decontaminate.words_of((t or "").encode())]
        hit, items = set(), set()
        for item, b in (("b1", text), ("b2", "two, Words")):
            v = [x.decode() for x in decontaminate.words_of(b.encode())]
            n = min(13, len(v))
            for k in range(len(v) - n + 1):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit |= set(range(i, i + n))
                        items.add(item)
        return len(w), len(hit), sorted(items)

    want = sorted((r.doc_id or -1, *brute(r.text)) for r in both.collect())
    for most in (10**6, 0):  # the broadcast set, and the join for benchmarks beyond the bound
        got = decontaminate.find_contamination(both, bench, max_words=most)
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == want
        spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got.collect()}
        assert spans[500] == [(1, 61)] and spans[501] == [(1, 3)] and spans[502] == []
    assert decontaminate.remove_spans("so TWO-words it is", [(1, 3)]) == "so  it is"
    assert decontaminate.find_contamination(none, bench).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    want = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert all(r.size == want[r.doc_id] for r in got)
    by = {}
    for r, s in zip(got, got, strict=True):
        assert 0 <= r.copies <= 3
        by.setdefault((r.source_size, r.target), []).append(s)
    total = sum(k[0] for k in by)
    assert abs(sum(k[1] for k in by) - total) < 1e-6 * total
    for (size, target), rows in by.items():
        taken = sum(r.size * r.copies for r in rows)
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max([r.size for r in rows]) / 2 + 1
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    assert mixing.mix(none).count() == 0
    kept = mixing.mix(docs, keep=True).select("row.*")
    assert kept.columns == docs.columns


def brute_mix(rows, targets, seed, tilt=mixing.TILT, cap=3.0):
    """{(source, unit, size): copies}: the whole order sorted, source by source. rows: (source, unit, size)."""
    import hashlib
    import math

    out = {}
    for source, target in targets.items():
        own = sorted({r for r in rows if r[0] == source and r[2] > 0})
        sizes = [(r, sum(x[2] for x in rows if x == r)) for r in own]
        band = lambda n: int(math.floor(math.log2(n)))
        weight = {band(r[2]): 2.0 ** (tilt * band(r[2])) for r in own}
        full, copies = set(), {}
        while True:
            left = target - cap * sum(w for r, w in sizes if band(r[2]) in full)
            load = sum(weight[band(r[2])] * w for r, w in sizes if band(r[2]) not in full)
            copies = {b: cap if b in full else left / load * weight[b] for b in weight}
            above = {b for b in weight if copies[b] > cap * (1 + 1e-12)}
            if not above:
                break
            full.add(max(above))
        whole = {b: math.floor(c + 1e-9) for b, c in copies.items()}
        p = {b: max(0.0, c - whole[b]) for b, c in copies.items()}
        rest = max(0.0, target - sum(whole[band(r[2])] * w for r, w in sizes))
        ranked = []
        for r, w in sizes:
            if p[band(r[2])] > 1e-9:
                u = (int(hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                ranked.append((u / (1 - u) / (p[band(r[2])] / (1 - p[band(r[2])])), r, w))
        ranked.sort()
        taken = set()
        while ranked and ranked[0][2] <= rest:
            _, unit, w = ranked.pop(0)
            taken.add(unit)
            rest -= w
        near = ranked[: mixing.GAP_AMONG]
        for _ in range(mixing.GAP_DOCS):
            best = min(near, key=lambda x: abs(rest - x[2]), default=None)
            if best is None or abs(rest - best[2]) >= rest:
                break
            near.remove(best)
            taken.add(best[1])
            rest -= best[2]
        for r, _ in sizes:
            out[r] = whole[band(r[2])] + (r in taken)
    return out


def test_mixing_is_brute_force_and_keeps_its_probabilities(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([3, 10, 10, 40, 200, 900])), f"s{min(3, i % 7)}") for i in range(420)]
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, copies string")
    units = [(s, str(i), len(t.split())) for i, t, s in rows]
    for seed in (0, 5):
        got = {(x.source, str(x.doc_id), x.size): x.copies for x in mixing.mix(docs, seed=seed, keep=True).select("doc_id", "size", "copies", "row.source").collect()}
        targets = {x.source: x.target for x in mixing.targets(spark.createDataFrame([(s, n) for s, _, n in units], "source string, size long")).collect()}
        assert got == brute_mix(units, targets, seed)
    runs = [brute_mix(units, targets, seed) for seed in range(200)]
    for source, target in targets.items():  # over seeds, documents of a size come as often as the law says, but for those that close gaps
        own = [u for u in units if u[0] == source]
        words = sum(u[2] for u in own)
        for size in {u[2] for u in own}:
            alike = [u for u in own if u[2] == size]
            mean = sum(run[u] for run in runs for u in alike) / len(runs) / len(alike)
            load = sum(2 ** (mixing.TILT * (u[2].bit_length() - 1)) * u[2] for u in own)
            law = target / load * 2 ** (mixing.TILT * (size.bit_length() - 1))
            if target < 2 * words:  # no band at the cap
                assert abs(mean - law) < 0.06 + mixing.GAP_DOCS / len(alike), (source, size, mean, law)


def test_mixing_targets_are_water_filled(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 500, None: 7}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    weight = dict(zip(sorted((k for k in sizes if k), key=str) + [None], (5, 2, 1, 5, 2), strict=True))
    want, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[k] for k in capped)
        want = {k: 3 * sizes[k] if k in capped else left * weight[k] / sum(weight[j] for j in sizes if j not in capped) for k in sizes}
        above = {k for k in sizes if want[k] > 3 * sizes[k] + 1e-9}
        if not above:
            break
        capped |= above
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_sharding(docs, none):
    got = sharding.shard(docs, 16).collect()
    assert len(got) == docs.count()
    counts = [sum(r.shard == s for r in got) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "rows" for r in got)
    assert sharding.shard(none).count() == 0


def test_hilbert_index_is_a_curve():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_media(spark, docs, none):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    sniff = media.sniffer()
    for data, kind in ((png(), "image/png"), (gif, "image/gif"), (gzip.compress(b"x" * 99), "application/gzip"), (z.getvalue(), "application/zip"), (media.wav_of(b"ab" * 50), "audio/wav")):
        assert sniff(data) == [(kind, 0, len(data))]
        assert sniff(b"--" + data + b"tail") == [(kind, 2, 2 + len(data))]
        assert [x for x in sniff(data[:-3]) if x[0] == kind] == []
    inside = media.wav_of(png() + b"\0" * (len(png()) % 2))
    assert [x[0] for x in sniff(inside)] == ["audio/wav", "image/png"]
    rows = spark.createDataFrame([(1, bytearray(png()), "image/jpeg"), (2, None, None), (3, bytearray(b"BM PK\x03\x04 %PDF-1"), "application/octet-stream")], "doc_id long, media binary, declared string")
    got = {r.id: r for r in media.sniff_media(rows).collect()}
    assert got[1].type == "image/png" and got[1].corrected and got[2].type == got[3].type == media.UNKNOWN and not got[3].carved
    out = media.media_features(media.text_media(docs)).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        t = texts[r.doc_id]
        payload = t + bytes(-len(t) % 64 or (0 if t else 64))
        import hashlib

        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44 and r.media_sha256 == hashlib.sha256(media.wav_of(payload)).hexdigest()
    assert media.media_features(media.text_media(none)).count() == 0


def test_urls(spark):
    rows = [
        (1, "https://Shop.Example.COM/en/12?q=1#x", None), (2, "http://example.com/en/78", "<html>"), (3, "ftp://a.net/de/8", ""), (4, "x://www.example.net/de/81/", None),
        (5, None, None), (6, "no scheme", "<p>"), (7, "https://a.org/es", None), (8, "https://free.info/p", '<LINK href="https://shop.example.com/en/1" rel=canonical>'),
        (9, "https://other.info/", '<meta http-equiv="refresh" content="0; url=https://free.info/p">'), (10, "https://clean.info/?ref=1", None), (10, "https://clean.info/?ref=1", None),
        (11, "https://evilexample.com/fr/7", None), (12, "https://example.com/en/7", '<link rel="canonical" href="https://free.info/p">'),
    ]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got[1] == ("shop.example.com", "/en/12", "com/en/", "block")
    assert got[2] == ("example.com", "/en/78", "example.com/en/7", "allow")
    assert got[3] == ("a.net", "/de/8", "net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("a.org", "/es", None, "allow") and got[11][3] == "allow"
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert got[12][2:] == ("example.com/en/7", "allow")
    assert urls.judge(pages).count() == len(rows) and urls.judge(pages.limit(0)).count() == 0
    moved = spark.createDataFrame([("https://clean.info/?ref=1", "https://x.com/en/")], "source string, target string")
    assert {r.verdict for r in urls.judge(pages, redirects=moved).collect() if r.page_id == 10} == {"block"}


def test_toxicity(spark, docs, none):
    r, rows = random.Random(5), []
    for i in range(1200):
        w = words(r.randint(5, 80), i).split()
        if bad := i % 4 == 0:
            for _ in range(1 + len(w) // 20):
                w.insert(r.randrange(len(w)), r.choice(["zulmik", "zulmika", "zulmikest", "qorvan"]))
        rows.append((i, " ".join(w), int(bad)))
    all_docs = spark.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a % 5] + [(77, None), (None, 1)], "doc_id long, label int")
    model = toxicity.fit(all_docs, labels)
    got = {x.doc_id: x for x in toxicity.score(all_docs, model).collect()}
    held = [(got[a].predicted, c) for a, _, c in rows if a % 5 == 0]
    assert sum(p == c for p, c in held) / len(held) > 0.9
    misspelt = spark.createDataFrame([(1, words(20, 991) + " zulmikor zulmikan"), (2, words(20, 991))], "doc_id long, text string")
    a, b = (x.score for x in toxicity.score(misspelt, model).orderBy("doc_id").collect())
    assert a > b
    # one bad passage marks a text of any length, and texts without letters score as empty ones of any length
    long = words(4000, 992).split()
    margin = model.scorer()
    assert margin([" ".join([*long[:2000], "zulmik", "qorvan", *long[2000:]])])[0] > margin([" ".join(long)])[0]
    assert len(set(margin(["12 34 " * 5000, "", None]).tolist())) == 1
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    assert len({x.score for x in out if x.doc_id == 904}) == 1
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.fit(none, labels)
    assert {x.score for x in toxicity.score(docs, blank).collect()} and toxicity.train([], [], []).bias < 0


def test_quality(docs, none):
    r, texts, labels = random.Random(2), [], []
    for i in range(240):
        lines = [words(r.randint(4, 20), 1000 * i + k).capitalize() + "." for k in range(r.randint(1, 8))]
        if bad := i % 3 == 0:
            lines[r.randrange(len(lines))] = "!!! $$$ " * 40
        texts.append("\n".join(lines).encode())
        labels.append(int(not bad))
    model = quality.train(texts[:160], labels[:160], [1.0] * 160)
    raw = [quality.line_features(t) for t in texts[160:]]
    n = np.array([len(s) for _, s in raw])
    bad = model.line_marginals(np.concatenate([quality.line_scores(model.weights, f) for f, _ in raw]), n)
    z = model.margins(bad, np.concatenate([s for _, s in raw]), n)
    assert ((z >= 0) == np.array(labels[160:])).mean() > 0.9
    out = quality.score(docs, model, lines=True).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 for x in out)
    assert all(len(x.bad_lines) == ((next(d.text for d in docs.collect() if d.doc_id == x.doc_id) or "").count("\n") + 1) for x in out[:10])
    assert quality.score(none, model).count() == 0


def test_crf_marginals_are_sums_over_paths():
    r = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    e, t, s = r.normal(size=(8, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    got, _, log_z = quality.marginals(e, t, s, quality.Padded(lengths))
    from itertools import product

    at, total = 0, 0.0
    for n in lengths:
        paths = {p: np.exp(s[p[0]] + sum(e[at + i, p[i]] for i in range(n)) + sum(t[p[i - 1], p[i]] for i in range(1, n))) for p in product((0, 1), repeat=int(n))}
        z = sum(paths.values())
        total += np.log(z)
        for i in range(n):
            assert abs(got[at + i, 1] - sum(v for p, v in paths.items() if p[i]) / z) < 1e-9
        at += n
    assert abs(total - log_z) < 1e-9


def test_language(docs, none):
    tongue = {"xa": "aeiouklm", "xb": "bcdfgrst", "xc": "äöüßnhie"}
    make = lambda k, i: " ".join("".join(random.Random(f"{k}{i}{j}").choice(tongue[k]) for _ in range(5)) for j in range(30))
    model = language.train([make(k, i) for k in tongue for i in range(40)], [k for k in tongue for _ in range(40)])
    x = np.stack([language.counts(make(k, 1000 + i)) for k in tongue for i in range(20)])
    best, p, _ = model.decode(x)
    assert [model.languages[b] for b in best] == [k for k in tongue for _ in range(20)] and ((p >= 0) & (p <= 1)).all()
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert got[903].lang_pred in tongue
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}
    code = language.codewords(4, 15)
    assert min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) >= 5


def test_pii_base_is_the_patterns():
    import re

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t):
                digits = re.sub("[^0-9]", "", m[0])
                if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (k == 3 and not 9 <= len(digits) <= 15):
                    continue
                out.append((m.start(), m.end(), k))
        return [(s, e, pii.KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]

    r = random.Random(9)
    for _ in range(3000):
        t = "".join(r.choice("ab@@..--+ 0123456789()é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute(t), t
    t = "x 4111 1111 1111 1111 a@b.co 1.2.3.4 +1 (504) 555-2652"
    assert pii.base_spans(t) == brute(t) and {k for _, _, k in pii.base_spans(t)} == set(pii.KINDS)


def test_pii_network(docs, none):
    import re

    tagger = pii.Tagger(hidden=4, dim=3)
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, pii.N_CHARS, (2, pii.PIECE)), r.integers(0, pii.N_TAGS, (2, pii.PIECE))
    _, grads = tagger.loss_and_grads(ids, tags)
    for k, v in tagger.p.items():
        i = tuple(r.integers(0, s) for s in v.shape) if k != "emb" else (int(ids[0, 0]), 1)
        old, ends = v[i], []
        for step in (1e-5, -1e-5):
            v[i] = old + step
            ends.append(tagger.loss_and_grads(ids, tags)[0])
        v[i] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-4 * max(1, abs(grads[k][i])), k
    model = pii.train([words(80, i) + " mail a.b@c.org now " + words(80, i + 99) for i in range(20)], n_real=100, n_made=500, epochs=3)
    out = pii.find_pii(docs, model).collect()
    assert len(out) == docs.count()
    text = "a" * 50 + " j.doe@acme.org and 10.0.0.1 " + "b" * 400
    base = pii.base_spans(text)
    shown = pii.show(base + pii.added_spans(text, base, pii.read_texts([text], model.reader())[0]))
    assert all(re.search(f"{k}:{s}:{e}", shown) for s, e, k in base)
    assert pii.find_pii(none, model).count() == 0
