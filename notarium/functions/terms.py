"""``functions.text.expand_token`` for the Arrow stage of the index build, remembered per distinct token.

Building the postings of a collection expands each task's distinct tokens once,
without the shuffle that joining a vocabulary would take. The rules and their
fixed values are those of ``functions.text``; a test holds both to the same
results on whole tables.
"""

from __future__ import annotations

import regex

from notarium.functions import text as t

_RAW, _HEX = regex.compile(t.RAW_TOKEN), regex.compile(t.HEX)
_CAMEL = regex.compile(t.CAMEL, regex.V1)
_DIGIT, _UPPER, _LOWER = regex.compile(r"\p{Nd}"), regex.compile(r"\p{Lu}"), regex.compile(r"\p{Ll}")
_RUSSIAN = regex.compile("[а-яё]")
_ONE_BY_ONE = str.maketrans("İΣ", "iσ")


def lower(s: str) -> str:
    return s.translate(_ONE_BY_ONE).lower()


def stem(w: str) -> str:
    if len(w) > t.STEM_LEAST:
        endings = t.RU_ENDINGS if _RUSSIAN.match(w) else t.EN_ENDINGS
        return next((w.removesuffix(e) for e in endings if w.endswith(e) and len(w) - len(e) >= t.STEM_LEAST), w)
    return w


def expand(token: str) -> tuple[str, ...]:
    whole = lower(token)
    if _HEX.match(token):
        return whole, whole[2:]
    words = [lower(w) for part in token.split("_") if part for w in _CAMEL.split(part)]
    forms = [whole, *(w for w in words if w != whole and len(w) > 1)]
    keys = (k for w in forms for k in (stem(w), w[: t.PREFIX] if len(w) >= t.PREFIX + 2 and not _DIGIT.search(w) else w))
    return tuple(dict.fromkeys([*forms, *keys]))


class Expansions(dict):
    """Token -> terms, for as many distinct tokens as ``limit``; then it starts anew."""

    limit = 1_000_000

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.limit:
            self.clear()
        out = self[token] = expand(token)
        return out


def raw_tokens(text: str) -> list[str]:
    return _RAW.findall(text)


def tokenize(text: str) -> list[str]:
    """Distinct terms of a query, in order."""
    return list(dict.fromkeys(term for token in raw_tokens(text) for term in expand(token)))


def ident_like(s: str) -> bool:
    return bool(_HEX.match(s)) or "_" in s or ":" in s or (bool(_UPPER.search(s)) and bool(_LOWER.search(s)) and len(s.encode()) > 3)


def literal_terms(query: str) -> list[str]:
    """What a query looks up letter by letter; a term that is given twice counts twice."""
    whole = query.strip()
    out = [whole] if len(whole.encode()) > 2 and " " in whole else []
    return out + [f for f in regex.split("[ ,\"']", query) if f and (ident_like(f) or len(f.encode()) > 5)]
