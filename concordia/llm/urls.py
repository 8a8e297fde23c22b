"""URL filters (6, native): rules, and block decisions that spread along redirects and canonical links.

All DataFrame and SQL functions. A page's url is split into host and path; the longest rule that fits decides. URLs are then
linked: a page with the targets of all its ``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` tags, entities read and
resolved against its ``<base href>`` and url, with every row of a redirect table that is given (targets resolved against the source), and each of these urls
with its own address without fragment, tracking parameters and ``http`` (what servers redirect to). Connected components over these links are aliases. A page without a rule of its own is blocked if any alias is; a page
that a rule allows stays allowed, whatever its aliases.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and has no aliases, so it is allowed;
null html has no links; html of any length is searched whole; repeated pages get equal rows; rules that tie in length go to allow; with
no rules all is allowed; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lasting, need
from .graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict): the rules of the contract's query
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as host + path) and its verdict; nulls if none does. Ties go to allow.

    The rules are a short fixed list, so they become one expression.
    """
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def address(url: Column) -> Column:
    """A url in the form that servers redirect to: https, host in lower case, no fragment, no tracking parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, "[?&]+$", ""), "([?&])&+", "$1")
    rest = F.regexp_extract(bare, "(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("https://"), host_of(url), rest))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one that ends in such a segment ends in a slash."""
    parts = F.split(path, "/")
    above = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
    step = lambda kept, x: F.when(x == "..", above(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(F.instr(path, "/.") > 0, F.array_join(F.concat(kept, end), "/")).otherwise(path)


def resolved(link: Column, base: Column) -> Column:
    """``link`` as a url, relative to the url ``base``; null if it is empty, only a fragment, or of a scheme without ``://``."""
    link = F.trim(link)
    scheme, root = F.regexp_extract(base, "(?s)^(.*?):", 1), F.regexp_extract(base, "(?s)^.*?://[^/?#]*", 0)
    path, own = path_of(base), F.regexp_extract(link, "(?s)^[^?#]*", 0)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    rest = F.substr(link, F.length(own) + 1)
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, without_dots(own), rest))
        .when(link.startswith("?"), F.concat(root, path, link))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), rest))
    )


def _numeric(text: Column, pattern: str, prefix: str, base: int) -> Column:
    """``text`` with the numeric entities of ASCII characters read that ``pattern`` finds."""
    char = lambda n: F.chr(F.conv(n, base, 10).cast("int"))
    plain = lambda n: F.when(char(n).isin("\\", "$"), F.concat(F.lit("\\"), char(n))).otherwise(char(n))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    found = F.filter(found, lambda n: F.conv(n, base, 10).cast("int").between(1, 127))
    read = F.aggregate(found, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(prefix), n, F.lit(";")), plain(n)))
    return F.when(F.instr(text, "&#") > 0, read).otherwise(text)


def decoded(text: Column) -> Column:
    """An attribute's value with its entities read: numeric ones of ASCII characters, and the named ones that urls need; ``&amp;`` last."""
    text = _numeric(text, "&#0*([0-9]{1,3});", "&#0*", 10)
    text = _numeric(text, "&#[xX]0*([0-9A-Fa-f]{1,2});", "&#[xX]0*", 16)
    for name, plain in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(plain))
    return text


def link_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b): links between urls that are aliases of each other."""
    html, url = F.coalesce("html", F.lit("")), F.col("url")
    tag = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
    refresh = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\burl\\s*=\\s*([^\"'\\s>]+)"
    start = "(?is)<base\\b[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
    low = F.lower(html)
    base = F.coalesce(F.when(F.instr(low, "<base") > 0, resolved(decoded(F.regexp_extract(html, start, 1)), url)), url)
    found = need(pages, url="string", html="string").where("url IS NOT NULL AND instr(url, '://') > 0")
    none = F.array().cast("array<string>")
    every = lambda word, pattern: F.when(F.instr(low, word) > 0, F.regexp_extract_all(html, F.lit(pattern), 1)).otherwise(none)
    links = F.transform(F.concat(every("canonical", tag), every("refresh", refresh)), decoded)
    found = found.select("url", links.alias("links"), base.alias("base"))
    targets = F.transform("links", lambda x: resolved(x, F.col("base")))
    edges = found.select(F.col("url").alias("a"), F.explode(F.array_append(targets, F.lit(None).cast("string"))).alias("b"))
    if redirects is not None:
        moved = need(redirects, source="string", target="string").where("source IS NOT NULL")
        edges = edges.union(moved.select("source", resolved(F.col("target"), F.col("source"))))
    edge = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    edges = edges.select(F.explode(F.array(edge(a, b), edge(a, address(a)), edge(b, address(b)))).alias("e")).select("e.a", "e.b")
    return edges.where("a IS NOT NULL AND a <> b AND instr(b, '://') > 0")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict and alias_of (the least url of its aliases, or null) for each row of pages."""
    rows = need(pages, page_id="long", url="string", html="string")
    edges = lasting(link_edges(rows, redirects).distinct())
    # Only aliases of a blocked url matter: components without one need no spreading, but finding them takes all links.
    members = lasting(connected_components(edges))
    _, verdict = matching_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    bad = members.where(verdict == "block").select("component").distinct().withColumn("tainted", F.lit(True))
    marks = members.join(bad, "component", "left").select(F.col("node").alias("url"), F.col("component").alias("alias_of"), "tainted")
    rule, own = matching_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumns({"rule": rule, "own": own}).join(marks, "url", "left")
    spread = F.when(F.col("tainted"), "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("own", spread).alias("verdict"), "alias_of")
