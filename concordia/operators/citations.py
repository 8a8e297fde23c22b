"""Where a text cites a reference: the laws it names, the articles it cites, and the best place for each reference.

One pass over a text's tokens finds citations: the word article with the items written before it ("23 üncü, geçici 19 ve 20 nci maddeleri",
"638-642 nci madde", "yirmi üçüncü madde") or after it ("madde 37"). An item is read by the same rules as a reference's article, and a
qualifier goes on through its series. Laws come from a second pass; the law of a citation is the one written right before it, or else the
last law before it that neither amends nor is a decree. Placing a reference compares both and keeps the candidate of least rank.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dimensions as d
from ..functions.articles import article, qualifier
from ..functions.normalize import fold, law_name, law_number, name_key, one_edit

UNITS = {"birinci": 1, "ikinci": 2, "üçüncü": 3, "dördüncü": 4, "beşinci": 5, "altıncı": 6, "yedinci": 7, "sekizinci": 8, "dokuzuncu": 9}
TENS, TENS_ORDINAL = {"on": 10, "yirmi": 20, "otuz": 30}, {"onuncu": 10, "yirminci": 20, "otuzuncu": 30}
#: verbs of an amendment, by their beginning
AMENDING = ("değişik", "değiştiril", "eklen", "ihdas")
ACRONYMS = {"VUK": "213", "GVK": "193", "KVK": "5520", "KDVK": "3065", "ÖTVK": "4760", "DVK": "488"}


def lower(text: str) -> str:
    """Lower case of Turkish text, letter for letter."""
    return text.replace("İ", "i").replace("I", "ı").lower()


def ordinal(words: str) -> int | None:
    """The number of an ordinal word or pair of words, 1 to 39."""
    text = "".join(lower(words).split())
    for tens, value in ({"": 0} | TENS).items():
        rest = text.removeprefix(tens)
        if text.startswith(tens) and rest in UNITS:
            return value + UNITS[rest]
    return TENS_ORDINAL.get(text)


class Piece(NamedTuple):
    text: str
    start: int
    end: int


_PIECE = re.compile(r"\d+|[^\W\d_]+|[^\w\s]")


def pieces(text: str) -> list[Piece]:
    return [Piece(m[0], m.start(), m.end()) for m in _PIECE.finditer(text)]


class Law(NamedTuple):
    start: int
    end: int
    number: str  # empty where the title stands for none
    key: str  # the title's folded letters and digits; empty where only a number is written
    written: bool = True  # False where it points back
    numbered: bool = False
    amending: bool = False
    decree: bool = False


_NUMBERED = re.compile(r"(?<![\d/.])(\d{4}/\d{1,6}|\d{2,5})\s+(?:[Ss]ayılı|SAYILI)\s+")
_BACK = re.compile(r"(?i:\b(?:aynı|anılan|mezkur|mezkûr|söz\s+konusu|adı\s+geçen|bu))\s+(?:[Kk]anun|KANUN)[\w’']*")
_TITLE_WORD = re.compile(r"[^\W\d_][\w’'.-]*")
_END = re.compile(r"(?i)kanun[\w’']*")
_BY_KEY = {name_key(n): k for n, k in d.NUMBER_BY_NAME.items()} | {name_key(a): d.NUMBER_BY_NAME[n] for a, n in d.ALIASES.items() if n in d.NUMBER_BY_NAME}
_LINKS = {"ve", "ile", "hakkında", "dair"}


def _title_end(text: str, start: int, most: int = 16) -> int | None:
    """Where a title that begins at ``start`` ends: at the first word of ``Kanun``, if none but capitalised words and links lead there."""
    at = start
    for k in range(most):
        m = _TITLE_WORD.match(text, at)
        if not m:
            return None
        if _END.fullmatch(m[0]):
            return m.end()
        if k and not (m[0][0].isupper() or lower(m[0]) in _LINKS):
            return None
        at = m.end()
        while at < len(text) and text[at] in " ,()\n":
            at += 1
    return None


def _title_key(title: str) -> str:
    words = re.sub(r"\([^)]*\)", " ", title).split()
    if words and _END.fullmatch(words[-1]):
        words[-1] = "Kanunu"
    return name_key(law_name(" ".join(words)))


def _amends(text: str, law: str, end: int) -> bool:
    """A law in the instrumental case, or followed by ``ile``, before a verb of amendment changes another law; it owns no article there."""
    after = lower(text[end : end + 40]).split()
    verb = lambda w: w.startswith(AMENDING)
    if after[:1] == ["ile"]:
        return bool(after[1:]) and verb(after[1])
    return bool(after) and verb(after[0]) and re.search(r"(?:la|le)$", lower(law)) is not None


def laws_of(text: str) -> list[Law]:
    """The laws a text names, in order; what points back takes the last law before it that owns articles."""
    found: list[Law] = []
    for m in _NUMBERED.finditer(text):
        end = _title_end(text, m.end()) or (m.end() + len(e[0]) if (e := _END.match(text, m.end())) else m.end())
        title = text[m.end() : end]
        found.append(Law(m.start(), end, law_number(m[1]), _title_key(title), True, True, _amends(text, title, end), "/" in m[1]))
    taken = [(x.start, x.end) for x in found]
    for m in _END.finditer(text):
        begin, at, words = m.start(), m.start(), 0
        while words < 14:  # back over the title's words
            before = re.search(r"([^\W\d_][\w’'.-]*|\([^()]*\)),?\s+$", text[max(0, at - 60) : at])
            if not before or not (before[1][0].isupper() or before[1][0] == "(" or lower(before[1]) in _LINKS):
                break
            at -= len(before[0])
            words += 1
            if before[1][0].isupper():
                begin = at
        if begin < m.start() and not any(s <= begin < e or s < m.end() <= e for s, e in taken):
            key = _title_key(text[begin : m.end()])
            if key:
                found.append(Law(begin, m.end(), "", key, True, False, _amends(text, m[0], m.end())))
    for m in re.finditer(rf"(?<!\w)({'|'.join(ACRONYMS)})(?!\w)", text):
        found.append(Law(m.start(), m.end(), ACRONYMS[m[1]], ""))
    aliases = {x.key: x.number for x in reversed(found) if x.number and x.key and not x.decree}
    out: list[Law] = []
    for x in sorted([*found, *(Law(m.start(), m.end(), "", "", False) for m in _BACK.finditer(text))]):
        if not x.written:
            owners = [y for y in out if not y.amending and not y.decree]
            if owners and not any(y.start <= x.start < y.end for y in out):
                out.append(x._replace(number=owners[-1].number, key=owners[-1].key))
            continue
        number = x.number or aliases.get(x.key) or _BY_KEY.get(x.key) or next((n for k, n in (aliases | _BY_KEY).items() if x.key.endswith(k)), "")
        out.append(x._replace(number=number))
    return out


class Citation(NamedTuple):
    start: int
    end: int
    articles: tuple[str, ...]  # each named itself, in one spelling
    ranges: tuple[tuple[int, int], ...]  # both ends included


_MARKS = set(",/-–—()'’")
_JOIN = {"ve", "ila", "ilâ", "veya", "ya", "da", "ile"}


def _is_article_word(word: str) -> bool:
    return lower(word).startswith("madde") or lower(word) in ("md", "mad")


def _ending(word: str) -> bool:
    return lower(word) in d.ORDINAL_ENDINGS


def _items(text: str, part: list[Piece]) -> tuple[tuple[str, ...], tuple[tuple[int, int], ...]]:
    """Articles and ranges of a series: it parts at commas and joining words, and a qualifier goes on until another stands there."""
    series: list[list[Piece]] = [[]]
    for p in part:
        if p.text == "," or lower(p.text) in _JOIN - {"ila", "ilâ"}:
            series.append([])
        else:
            series[-1].append(p)
    named, spans, inherited = [], [], None
    for item in filter(None, series):
        words = [p for p in item if not _ending(p.text) and p.text not in "'’"]
        if not words:
            continue
        own = qualifier(words[0].text) if words[0].text.isalpha() else None
        inherited = own or inherited
        numbers = [p for p in words if p.text.isdecimal()]
        if not numbers:
            value = ordinal(" ".join(p.text for p in words))
            if value:
                named.append(str(value))
            continue
        link = {lower(p.text) for p in words[1:]} & {"-", "–", "—", "ila", "ilâ"}
        if link and len(numbers) == 2 and int(numbers[1].text) > int(numbers[0].text) and "/" not in {p.text for p in words}:
            spans.append((int(numbers[0].text), int(numbers[1].text)))
            named.append(f"{int(numbers[0].text)} ila {int(numbers[1].text)}")
            continue
        body = text[numbers[0].start : words[-1].end]
        named.append(article(f"{inherited} {body}" if inherited else body))
    return tuple(dict.fromkeys(named)), tuple(spans)


def citations_of(text: str) -> list[Citation]:
    """Every citation of articles in a text, in order."""
    all_, out = pieces(text), []
    for k, p in enumerate(all_):
        if not _is_article_word(p.text):
            continue
        first, number_seen = k, False
        while first:
            q = all_[first - 1]
            word = q.text.isalpha()
            known = word and (_ending(q.text) or lower(q.text) in _JOIN or qualifier(q.text) or ordinal(q.text) or lower(q.text) in TENS or len(q.text) == 1)
            if not (q.text.isdecimal() or q.text in _MARKS or known):
                break
            first -= 1
            number_seen |= q.text.isdecimal() or (word and ordinal(q.text) is not None)
        while first < k and (all_[first].text in "),-–—'’/" or lower(all_[first].text) in _JOIN or _ending(all_[first].text) or (len(all_[first].text) == 1 and all_[first].text.isalpha())):
            first += 1
        if number_seen and first < k:
            articles, spans = _items(text, all_[first:k])
            if articles:
                out.append(Citation(all_[first].start, p.end, articles, spans))
            continue
        after = k + 1
        while after < len(all_) and (all_[after].text.isdecimal() or (after > k + 1 and all_[after].text in "/-–") or all_[after].text in ".:" and after == k + 1):
            after += 1
        if after > k + 1 and all_[after - 1].text.isdecimal() and text[p.end : all_[k + 1].start].strip() == "":
            articles, spans = _items(text, [x for x in all_[k + 1 : after] if x.text not in ".:"])
            if articles:
                out.append(Citation(p.start, all_[after - 1].end, articles, spans))
    return out


def agrees(law: Law, number: str, key: str) -> bool | None:
    """Whether a law that is named is the reference's: by numbers, else by titles; None where the text does not say."""
    if law.number and number:
        return law.number == number
    if law.key and key and (law.key == key or law.key.endswith(key) or key.endswith(law.key) or one_edit(law.key, key)):
        return True
    return None


class Place(NamedTuple):
    rank: tuple[int, int, int, int, int]
    start: int
    end: int
    law: int  # 0 written before it, 1 inferred, 2 unknown, 3 inferred to be another


_GAP = re.compile(r"(?:['’][^\W\d_]*)?[\s,]*")  # a case ending and blanks


def places(text: str, number: str, name: str, madde: str, laws: list[Law] | None = None, cited: list[Citation] | None = None) -> list[Place]:
    """Every place that may carry a reference, the best first: agreeing law, the article itself before a range that holds it, a law written
    before an inferred one, a number before a title, then the order of the text. A place whose written law is another is none."""
    laws, cited = laws_of(text) if laws is None else laws, citations_of(text) if cited is None else cited
    number = law_number(number)
    key, wanted = name_key(law_name(name, number)), article(madde)
    if not wanted:
        found = [Place((0, 0, 0 if x.numbered and x.key else 1 if x.numbered else 2, 0, x.start), x.start, x.end, 0) for x in laws if x.written and agrees(x, number, key)]
        return sorted(found)
    owners = [x for x in laws if not x.amending]
    starts = [x.start for x in owners]
    out = []
    for c in cited:
        exact = wanted in c.articles
        within = not exact and wanted.isdecimal() and any(a <= int(wanted) <= b for a, b in c.ranges)
        if not (exact or within):
            continue
        before = bisect_left(starts, c.start)
        beside = next((x for x in reversed(owners[:before]) if x.end <= c.start and _GAP.fullmatch(text, x.end, c.start)), None)
        evidence, numbered, begin = 2, 1, c.start
        if beside is not None:
            verdict = agrees(beside, number, key)
            if verdict is False and beside.written:
                continue
            evidence = 3 if verdict is False else 2 if verdict is None else 0 if beside.written else 1
            numbered, begin = 0 if verdict and beside.numbered else 1, beside.start
        else:
            last = next((x for x in reversed(owners[:before]) if not x.decree), None)
            verdict = agrees(last, number, key) if last else None
            evidence = 2 if verdict is None else 1 if verdict else 3
        out.append(Place((int(evidence > 1), int(within), evidence, numbered, c.start), begin, c.end, evidence))
    return sorted(out)


def located(text: str, refs: list[dict]) -> list[list[tuple[int, int]]]:
    """For each reference its spans: the best place, then the others whose law is written or inferred."""
    laws, cited = laws_of(text), citations_of(text)
    out = []
    for r in refs:
        found = places(text, r["law_no"] or "", r["law_name"] or "", r["article"] or "", laws, cited)
        out.append(list(dict.fromkeys((p.start, p.end) for k, p in enumerate(found) if k == 0 or p.law in (0, 1))))
    return out


SPANS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))


def locate(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, pos, law_no, law_name, article, text) with ``spans``: places of each reference in its text, best first; an empty array
    where the text does not cite it. A text is read once for all references of its document."""

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series, refs: pd.Series) -> pd.Series:
        return pd.Series([[[{"start": a, "end": b} for a, b in spans] for spans in located(t or "", list(r))] for t, r in zip(texts, refs, strict=True)])

    lists = rows.groupBy("doc_id").agg(F.first("text").alias("text"), F.array_sort(F.collect_list(F.struct("pos", "law_no", "law_name", "article"))).alias("refs"))
    found = lists.select("doc_id", "text", "refs", find("text", "refs").alias("spans")).select("doc_id", "text", F.explode(F.arrays_zip("refs", "spans")).alias("x"))
    return found.select("doc_id", "text", "x.refs.*", "x.spans")


def attached(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their quotes, refusals): an empty quote becomes the best span, ``quotes`` all of them; a row that has a quote keeps it; a row
    that the text does not cite is refused, never dropped. rows: as for ``locate``, with source_text."""
    given = rows.where(F.trim("source_text") != "").withColumn("quotes", F.array("source_text"))
    found = locate(rows.where(F.trim("source_text") == ""))
    cut = lambda s: F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    found = found.withColumn("quotes", F.array_distinct(F.transform("spans", cut)))
    names = ["doc_id", "pos", "law_no", "law_name", "article", "quotes"]
    placed = found.where(F.size("spans") > 0)
    return given.select(*names).unionByName(placed.select(*names)), found.where(F.size("spans") == 0).select(*names[:-1])


def laws_table(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, number, written, numbered, amending, decree) of every law that a text names."""
    kind = "array<struct<start:int,end:int,number:string,written:boolean,numbered:boolean,amending:boolean,decree:boolean>>"

    @F.pandas_udf(T.StringType())
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps([{f: getattr(x, f) for f in x._fields if f != "key"} for x in laws_of(t or "")]))

    return docs.select("doc_id", F.explode(F.from_json(scan("text"), kind)).alias("m")).select("doc_id", "m.*")


def stem(name: str) -> str:
    """A law's title without its word for law."""
    return re.sub(r"\b(kanun|yasa)\w*\b.*$", "", fold(name)).strip()
