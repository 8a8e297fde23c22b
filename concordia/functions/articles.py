"""Spelling of articles: a text becomes tokens, tokens become the parts of a citation, and the parts are written in one way.

A citation has, in this order, a qualifier (``ek``, ``geçici``, ``mükerrer``), a body (mostly a number) and an inserted letter (``/A``, or
``/A-B``). What else is written around them - list marks, the word article, ordinal endings, "and the following", and parts below the article
such as paragraphs - is recognised from its tokens and left out. A span of two numbers is written ``a ila b``.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from . import dimensions as d
from .words import EDGE, clean, fold, one_edit

DASHES, LIST_MARKS, QUOTES = "-–—", "-–—•·*", "'’`´"
LOWER, UPPER = frozenset("abcdefghijklmnopqrstuvwxyzçğıöşü"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÇĞİÖŞÜ")
_TOKEN = re.compile(r"(\s*)(?:(\d+)|([^\W\d_]+)|(.))", re.DOTALL)


class Token(NamedTuple):
    text: str
    kind: str  # number, word or mark
    apart: bool  # a blank stands before it


def tokens(text: str) -> list[Token]:
    found = [(m[1], m[2], m[3], m[4]) for m in _TOKEN.finditer(text)]
    return [Token(n or w or x, "number" if n else "word" if w else "mark", bool(gap)) for gap, n, w, x in found]


def written(items: list[Token]) -> str:
    """The tokens as text: blanks where they stood, none around a slash."""
    out = ""
    for k, t in enumerate(items):
        out += " " if t.apart and k and t.text != "/" and items[k - 1].text != "/" else ""
        out += t.text
    return out


def qualifier(word: str) -> str | None:
    """The qualifier that a word stands for: itself, an abbreviation, or one slip away from a long one."""
    plain = fold(word)
    if plain in d.QUALIFIER_ABBREVIATIONS:
        return d.QUALIFIER_ABBREVIATIONS[plain]
    for q in d.QUALIFIERS:
        if plain == fold(q) or (min(len(plain), len(q)) >= 5 and one_edit(plain, fold(q))):
            return q
    return None


def _ordinal(t: Token) -> bool:
    return t.kind == "word" and t.text.lower() in d.ORDINAL_ENDINGS


def _without_endings(items: list[Token]) -> list[Token]:
    """Apostrophes after a number go, with an ordinal ending if one follows."""
    out: list[Token] = []
    skip = False
    for t in items:
        if skip and _ordinal(t):
            skip = False
            continue
        skip = bool(out) and out[-1].kind == "number" and t.text in QUOTES
        if not skip:
            out.append(t)
    return out


def _after_heading(items: list[Token]) -> list[Token]:
    """Without the word article, or its abbreviation, that stands before a number."""
    if items and items[0].kind == "word":
        word, k = items[0].text.lower(), 1
        while k < len(items) and items[k].kind == "mark" and items[k].text in ".:-":
            k += 1
        number_next = k < len(items) and items[k].kind == "number"
        parted = k > 1 or (k < len(items) and items[k].apart)
        if number_next and (word.startswith("madde") or (word in d.ARTICLE_ABBREVIATIONS and word != "mad" and parted)):
            return items[k:]
    return items


def _tail(items: list[Token]) -> int:
    """How many tokens at the end say nothing of the article itself: "and the following", the word article, an ordinal ending, a point."""
    n = len(items)
    if not n:
        return 0
    last = items[-1]
    if last.text in (".", " "):
        return 1
    if last.kind != "word" or n == 1:
        return 0
    end = n - 1 if fold(last.text).startswith("madde") else n
    for k in (end - 2, end - 3):
        if k > 0 and items[k].text.lower() == "ve":
            rest = [fold(t.text) for t in items[k + 1 : end]]
            one = len(rest) == 1 and (rest[0] in d.FOLLOWING and rest[0] != "takip" or rest[0].startswith("devam"))
            if one or rest == ["takip", "eden"]:
                return n - k
    word = last.text.lower()
    if word in d.ARTICLE_FORMS or _ordinal(last) or (word in ("md", "mad") and last.apart):
        return 1
    return 0


def _part(items: list[Token]) -> int:
    """How many tokens at the end name a part below the article; 0 if none does."""
    texts, n = [t.text for t in items], len(items)
    if n >= 4 and texts[-1] == ")" and "(" in texts[:-1]:
        start = n - 1 - texts[::-1].index("(")
        inner = "".join(texts[start + 1 : -1])
        if start and 1 <= len(inner) <= 3 and all(c.isdigit() or c in LOWER for c in inner):
            return n - start
    if "/" in texts[1:]:
        slash = n - 1 - texts[::-1].index("/")
        after = items[slash + 1 :]
        if after and after[0].kind == "number":
            return n - slash
        if after and len(after[0].text) == 1 and after[0].text in LOWER and (len(after) == 1 or (len(after) >= 3 and after[1].text == "-" and not any(t.apart for t in after[3:]))):
            return n - slash
        if len(after) >= 3 and len(after[0].text) == 1 and after[0].text in UPPER and after[1].text == "-" and all(t.kind == "number" or t.text == "." for t in after[2:]):
            return len(after) - 1
    if n >= 3 and texts[-2] == "-" and len(texts[-1]) == 1 and texts[-1] in LOWER:
        return 2
    return 0


def _span(items: list[Token]) -> str | None:
    """``a ila b`` of two numbers with a dash or the word between them. A dash before a number that is no greater is no span: what follows
    it is left out; so is the end of a span of one article."""
    if len(items) != 3 or items[0].kind != "number" or items[2].kind != "number":
        return None
    link, a, b = items[1].text, int(items[0].text), int(items[2].text)
    if link not in DASHES and link.lower() not in ("ila", "ilâ"):
        return None
    if b > a:
        return f"{items[0].text} ila {items[2].text}"
    return items[0].text if b == a or link in DASHES else None


def _inserted(items: list[Token]) -> tuple[list[Token], str]:
    """The body and the inserted article's letter or letters, compact; an empty string without them."""
    texts = [t.text for t in items]
    for size in (4, 2):
        end = texts[-size:]
        letters = end[1::2]
        if len(texts) > size and end[0] == "/" and all(len(x) == 1 and x in UPPER for x in letters) and (size == 2 or end[2] == "-"):
            return items[:-size], "/" + "-".join(letters)
    return items, ""


def _enclosed(items: list[Token]) -> bool:
    """All in one pair of brackets, with a slash or a word and a number: more than a bare number."""
    inner = items[1:-1]
    if len(items) < 3 or items[0].text != "(" or items[-1].text != ")" or any(t.text in "()" for t in inner):
        return False
    return any(t.text == "/" for t in inner) or (len(inner) > 1 and inner[0].kind == "word" and inner[1].kind == "number" and inner[1].apart)


def _once(text: str) -> str:
    items = tokens(clean(text).strip(EDGE.replace("-", "")))
    while items and items[0].text in LIST_MARKS:
        items = items[1:]
    items = _after_heading(_without_endings(items))
    while n := _tail(items):
        items = items[:-n]
    if _enclosed(items):
        items = items[1:-1]
    while n := _part(items):
        items = items[:-n]
    if items and items[0].kind == "word" and fold(items[0].text) == "degisik":
        items = items[1:]
    name = ""
    if items and items[0].kind == "word" and (name := qualifier(items[0].text) or ""):
        items = items[2:] if len(items) > 1 and items[1].text == "." and not items[1].apart else items[1:]
        items = _after_heading(items)
    body, letters = _inserted(items)
    spelt = (_span(body) if not letters else None) or " ".join(written(body).split()).casefold()
    return f"{name} {spelt}".strip() + letters


@lru_cache(200_000)
def article(value) -> str:
    """The article in one spelling, stable under itself; something unreadable stays as written, folded."""
    text = _once(value or "")
    for _ in range(4):
        again = _once(text)
        if again == text:
            break
        text = again
    plain = clean(value)
    return text or (plain.casefold() if re.search(r"[^\W_]", plain) else "")


def spelt_articles(value) -> list[str]:
    """The article, or the articles that a span names, up to the widest that is spelt out; ``a ila mükerrer b`` also names that one."""
    text = article(value)
    words = text.split(" ")
    again = len(words) == 4 and words[2] == "mükerrer"
    if len(words) != 3 + again or words[1] != "ila" or not (words[0].isdecimal() and words[-1].isdecimal()):
        return [text]
    first, last = int(words[0]), int(words[-1])
    if not first + (not again) <= last < first + d.WIDEST_RANGE:
        return [text]
    return [*map(str, range(first, last + 1)), *[f"mükerrer {last}"] * again]
