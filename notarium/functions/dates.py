"""Dates of notes, and the dates a user types."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from notarium.functions.text import trim

#: The layouts of a note's date, in the order they are tried.
LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy/MM/dd", "dd.MM.yyyy")


def parsed(value: Column) -> Column:
    """The instant of one value in any of the layouts, else null; dates count as midnight UTC."""
    v = trim(value)
    shaped = [
        (r"^\d{4}-\d{2}-\d{2}$", lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd"))),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", lambda x: F.try_to_timestamp(x)),
        (r"^\d{4}/\d{2}/\d{2}$", lambda x: F.try_to_timestamp(x, F.lit("yyyy/MM/dd"))),
        (r"^\d{2}\.\d{2}\.\d{4}$", lambda x: F.try_to_timestamp(x, F.lit("dd.MM.yyyy"))),
    ]
    out = F.lit(None).cast("timestamp")
    for shape, read in reversed(shaped):
        out = F.when(v.rlike(shape), read(v)).otherwise(out)
    return out


def values(meta: Column, key: str) -> Column:
    """The list under ``key``, empty where the key or its list is missing."""
    return F.coalesce(F.try_element_at(meta, F.lit(key.lower())), F.array().cast("array<string>"))


def note_date(meta: Column, mtime: Column) -> Column:
    """The first readable value of date, updated and created, else ``mtime``."""
    every = F.concat(values(meta, "date"), values(meta, "updated"), values(meta, "created"))
    return F.coalesce(F.get(F.filter(F.transform(every, parsed), lambda t: t.isNotNull()), F.lit(0)), mtime)


def meta_first(meta: Column, key: str) -> Column:
    return F.coalesce(F.get(values(meta, key), F.lit(0)), F.lit(""))


def meta_has(meta: Column, key: str, want: str) -> Column:
    """Whether a value under ``key`` equals ``want``, whatever the case and the blanks around it."""
    return F.exists(values(meta, key), lambda v: F.lower(trim(v)) == F.lower(trim(F.lit(want))))


def parse_since(text: str, now: datetime | None = None) -> datetime | None:
    """A date, or so many days (d), weeks (w) or months (m) ago; None for an empty text, an error for any other.

    A month back from the 31st counts on past the end of a shorter month.
    """
    s = text.strip()
    if not s:
        return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s):
        try:
            return datetime.strptime(s, "%Y-%m-%d").replace(tzinfo=UTC)
        except ValueError:
            pass
    now = now or datetime.now(UTC)
    if m := re.fullmatch(r"([+-]?\d+)([dwm])", s):
        n, unit = int(m[1]), m[2]
        if unit != "m":
            return now - timedelta(days=n * (7 if unit == "w" else 1))
        month = now.year * 12 + now.month - 1 - n
        return now.replace(year=month // 12, month=month % 12 + 1, day=1) + timedelta(days=now.day - 1)
    raise ValueError(f"cannot read {text!r} as a date; 2026-01-15, 7d, 3w and 2m can be read")
