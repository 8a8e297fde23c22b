"""Relative targets and targets in another spelling reach the pages that they name."""

from pyspark.sql import functions as F

from concordia.llm import urls


def test_resolved(spark):
    base = "https://Site.info/a/b/c?q=1#f"
    want = {"/x/y": "https://Site.info/x/y", "//Host.org/p": "https://Host.org/p", "d": "https://Site.info/a/b/d", "../d?u=http://x": "https://Site.info/a/d?u=http://x", "./": "https://Site.info/a/b/", "..": "https://Site.info/a/", "/../../z": "https://Site.info/z", "?p=2": "https://Site.info/a/b/c?p=2", "#top": None, "": None, "mailto:a@b": None, "ftp://o/": "ftp://o/"}
    rows = spark.createDataFrame([(k, base) for k in want], "link string, base string")
    assert {r.link: r.got for r in rows.select("link", urls.resolved(F.col("link"), F.col("base")).alias("got")).collect()} == want
    assert spark.range(1).select(urls.resolved(F.lit("x"), F.lit("http://h"))).first()[0] == "http://h/x"


def test_blocks_spread_along_relative_links(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://one.org/p", canonical.format("/es/1")), (2, "https://two.info/p", canonical.format("//one.org/es/2")), (3, "https://three.info/x/y", '<meta http-equiv="refresh" content="0; url=../q">'),
        (4, "https://three.info/q", canonical.format("https://one.org/es/3")), (5, "https://five.info/p", canonical.format("HTTP://FOUR.info/q?utm_source=z")), (6, "https://four.info/q", canonical.format("http://one.org/es/4")),
        (7, "https://seven.info/p", '<base href="https://one.org/es/">' + canonical.format("9")), (8, "https://eight.info/p", canonical.format("/ok")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {**dict.fromkeys(range(1, 8), "block"), 8: "allow"}
    moved = spark.createDataFrame([("https://eight.info/ok", "//one.org/es/8")], "source string, target string")
    assert {r.verdict for r in urls.judge(pages, redirects=moved).collect()} == {"block"}


def test_entities_and_all_tags(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a?x=1&amp;y=2",), ("&#47;es&#x2F;1",), ("&#36;&#92;&amp;lt;",), ("plain",), (None,), ("&#960;",)], "t string")
    assert [r[0] for r in rows.select(urls.decoded(F.col("t"))).collect()] == ["a?x=1&y=2", "/es/1", "$\\&lt;", "plain", None, "&#960;"]
    html = '<link rel="canonical" href="https://ok.example/1"><link rel=canonical href="&#47;es&#47;2?a=1&amp;b=2">'
    pages = spark.createDataFrame([(1, "https://shop.org/x", html), (2, "https://shop.org/es/2?a=1&b=2", ""), (3, "https://ok.example/1", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert got == {1: (None, "block"), 2: ("org/es/", "block"), 3: (None, "block")}
