"""Text functions as Column expressions: tokens and their variants, identifiers, literal counts, snippets.

All of them stay in the JVM. ``expand_token`` is long, so tables are tokenised by
vocabulary: expand each distinct raw token once and join it back (``operators.index``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_TOKEN = r"[\p{L}\p{Nd}_]+"
HEX = r"^0[xX][0-9a-fA-F]+$"
#: Where a word splits: lower to upper, before the last capital of a run, digit to other, other to digit.
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Nd})(?=\P{Nd})|(?<=\P{Nd})(?=\p{Nd})"
#: Inflectional endings in the order they are tried.
RU_ENDINGS = (
    "иями ями ами ого ему ыми ими ому ений ение ения ой ей ая ое ые ый ий ом ах ях ов ев "
    "ам ям ую юю ем им ых их ся ть а я ы и о е у ю й ь"
).split()
EN_ENDINGS = ["ings", "ing", "ies", "ied", "es", "ed", "s"]
STEM_LEAST, PREFIX = 4, 6
#: White space as a pattern; plain ``trim`` strips the blank only.
SPACE = r"[\p{IsWhite_Space}]+"


def lower(c: Column) -> Column:
    """Lower case rune by rune, without the special casing of dotted I and final sigma."""
    return F.lower(F.translate(c, "İΣ", "iσ"))


def trim(c: Column) -> Column:
    """Strips Unicode white space."""
    return F.regexp_replace(c, rf"\A{SPACE}|{SPACE}\z", "")


def collapse(c: Column) -> Column:
    """One line: runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(RAW_TOKEN), F.lit(0))


def is_hex(c: Column) -> Column:
    return c.rlike(HEX)


def camel_split(c: Column) -> Column:
    """Words of an identifier without blanks. ``split`` would compile the pattern for each value; ``regexp_replace`` keeps it."""
    return F.split(F.regexp_replace(c, CAMEL, " "), " ")


def snake_split(c: Column) -> Column:
    return F.filter(F.split(c, "_"), lambda x: x != "")


def subwords(token: Column) -> Column:
    """Lower-cased parts of an identifier, those of one rune and the whole token left out."""
    parts = F.transform(F.flatten(F.transform(snake_split(token), camel_split)), lower)
    return F.filter(F.array_remove(parts, lower(token)), lambda x: F.length(x) > 1)


def _stemmer(endings: list[str]) -> str:
    """The shortest start of four or more runes that an ending completes. No ending in the list ends a later one, so that is the first one that fits."""
    return rf"^(.{{{STEM_LEAST},}}?)(?:{'|'.join(endings)})$"


def stem(w: Column) -> Column:
    """Without the first ending that fits and leaves four runes; words of under five runes stay."""
    return F.when(w.rlike("^[а-яё]"), F.regexp_replace(w, _stemmer(RU_ENDINGS), "$1")).otherwise(F.regexp_replace(w, _stemmer(EN_ENDINGS), "$1"))


def prefix_key(w: Column) -> Column:
    """The first six runes of words of eight or more without a digit, else null."""
    return F.when((F.length(w) >= PREFIX + 2) & ~w.rlike(r"\p{Nd}"), F.substring(w, 1, PREFIX))


def expand_token(token: Column) -> Column:
    """All terms of a raw token, distinct, in the order they are tried: itself, its parts, then stems and prefix keys."""
    low = lower(token)
    forms = F.concat(F.array(low), subwords(token))
    more = F.flatten(F.transform(forms, lambda w: F.array(stem(w), F.coalesce(prefix_key(w), w))))
    return F.when(is_hex(token), F.array(low, F.substring(low, 3, 1_000_000))).otherwise(F.array_distinct(F.concat(forms, more)))


def tokenize(c: Column) -> Column:
    """Terms of a text, with repeats."""
    return F.flatten(F.transform(raw_tokens(c), expand_token))


def ident_like(c: Column) -> Column:
    """Whether a query term is an address or a symbol: hexadecimal, with ``_`` or ``:``, or of mixed case and over three bytes."""
    return is_hex(c) | c.rlike("[_:]") | (c.rlike(r"\p{Lu}") & c.rlike(r"\p{Ll}") & (F.octet_length(c) > 3))


def count_fold(hay: Column, needle: Column) -> Column:
    """Occurrences of ``needle`` that don't overlap, whatever the case; 0 for an empty one."""
    h, n = lower(hay), lower(needle)
    return F.when(F.length(n) > 0, ((F.length(h) - F.length(F.replace(h, n, F.lit("")))) / F.length(n)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def fields(query: Column) -> Column:
    """Pieces of a query between blanks, commas and quotes."""
    return F.filter(F.split(query, "[ ,\"']"), lambda x: x != "")


def literal_terms(query: Column) -> Column:
    """What is looked up letter by letter: the whole trimmed query if it has a blank and over two bytes, and each piece that is an identifier or over five bytes."""
    whole = trim(query)
    first = F.when((F.octet_length(whole) > 2) & whole.contains(" "), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.concat(first, F.filter(fields(query), lambda x: ident_like(x) | (F.octet_length(x) > 5)))


SNIPPET, BEFORE = 260, 60


def snippet(body: Column, query: Column, terms: Column) -> Column:
    """One line of up to 260 runes from 60 before the query's first occurrence, else the first term's that occurs, else the start."""
    flat = collapse(F.coalesce(body, F.lit("")))
    low, q = lower(flat), lower(trim(query))
    by_query = F.when(q != "", F.call_function("locate", q, low)).otherwise(0)
    by_term = F.coalesce(F.get(F.filter(F.transform(terms, lambda t: F.call_function("locate", t, low)), lambda p: p > 0), F.lit(0)), F.lit(1))
    at = F.when(by_query > 0, by_query).otherwise(by_term)
    start = F.greatest(at - 1 - BEFORE, F.lit(0))
    end = F.least(start + SNIPPET, F.length(flat))
    mid = trim(F.substring(flat, start + 1, end - start))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), mid, F.when(end < F.length(flat), F.lit("…")).otherwise(""))


def matches_glob(c: Column, glob: str) -> Column:
    """Shell matching of one path element: ``*``, ``?`` and ``[...]`` never match a slash; a malformed pattern matches nothing."""
    import re

    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[":
            j = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "^" else i + 3)
            if j < 0:
                return F.lit(False)
            out += "[" + re.sub(r"([\[&])", r"\\\1", glob[i + 1 : j]) + "]"
            i = j
        elif ch == "\\":
            i += 1
            if i == len(glob):
                return F.lit(False)
            out += re.escape(glob[i])
        else:
            out += re.escape(ch)
        i += 1
    return c.rlike(rf"(?s)\A{out}\z")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
