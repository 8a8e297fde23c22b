"""Folding of words: entities and invisible marks, Turkish letters, case, and words that differ by one slip."""

from __future__ import annotations

import html
import os
import unicodedata

TURKISH, PLAIN = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"
_PLAIN = str.maketrans(TURKISH, PLAIN)
_INVISIBLE = dict.fromkeys((0xAD, 0x200B))
EDGE = " .,:;-'\""


def clean(value) -> str:
    """Entities read, compatibility forms joined, invisible marks dropped, blanks folded."""
    text = str(value or "")
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():  # ASCII is its own compatibility form
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return " ".join(text.split())


def fold(value: str) -> str:
    """Without accents, Turkish letters as their ASCII look-alikes, without case."""
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).translate(_PLAIN).casefold()


def one_edit(a: str, b: str) -> bool:
    """Levenshtein distance of at most one: between the common start and the common end, no more than one letter of either is left."""
    start = len(os.path.commonprefix([a, b]))
    end = len(os.path.commonprefix([a[start:][::-1], b[start:][::-1]]))
    return max(len(a), len(b)) - start - end <= 1
