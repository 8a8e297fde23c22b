"""Small expressions over texts, labels, numbers and times, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def ruling_number(text: Column) -> Column:
    """The number in a document's header: what stands between ``Sayı :`` and a date, or else the next word; empty without one."""
    dated = F.regexp_extract(text, "Sayı\\s*:\\s*([^\\n]{5,120}?)\\s+\\d{1,2}[./]\\d{1,2}[./]\\d{2,4}", 1)
    return F.when(dated != "", collapsed(dated)).otherwise(F.regexp_extract(text, "Sayı\\s*:\\s*(\\S+)", 1))


def snippet(text: Column, start: int | Column, end: int | Column, least: int = 30, most: int = 180) -> Column:
    """A stretch of a text, widened on both sides to ``least`` characters and cut at ``most``; empty for an empty stretch."""
    n = F.length(text)
    s, e = F.greatest(F.lit(0), F.lit(start) if isinstance(start, int) else start), F.least(n, F.lit(end) if isinstance(end, int) else end)
    short = F.greatest(F.lit(0), F.lit(least) - (e - s))
    left = F.floor(short / 2).cast("int")
    a, b = F.greatest(F.lit(0), s - left), F.least(n, e + short - left)
    b = F.least(b, a + most)
    return F.when(e <= s, "").otherwise(collapsed(F.substr(text, a + 1, b - a)))


def display_name(number: Column, name: Column, article: Column) -> Column:
    law = F.coalesce(F.nullif(number, F.lit("")), F.nullif(name, F.lit("")), F.lit("?"))
    return F.when(article != "", F.concat(law, F.lit("/"), article)).otherwise(law)


def reference_label(number: Column, name: Column, article: Column) -> Column:
    """As the screens name a reference."""
    law = F.coalesce(F.nullif(F.trim(number), F.lit("")), F.nullif(F.trim(name), F.lit("")), F.lit("kanun belirtilmemiş"))
    return F.concat(law, F.lit(" · madde "), F.coalesce(F.nullif(F.trim(article), F.lit("")), F.lit("—")))


def number(value: Column, fallback: Column | None = None) -> Column:
    """A counter as a number; what cannot be read, or is absent, is the fallback."""
    read = value.try_cast("double")
    return read if fallback is None else F.coalesce(read, fallback)


def bytes_of_gb(value: Column) -> Column:
    return F.round(value.try_cast("double") * 1e9).cast("long")


def seconds_on_page(opened: Column, now: Column) -> Column:
    """Whole seconds since a page was opened; null for a clock that runs back."""
    s = F.unix_timestamp(now) - F.unix_timestamp(opened)
    return F.when(s >= 0, s)
