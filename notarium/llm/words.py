"""Words of a text for the Arrow stages: maximal runs of letters or digits after lower-casing."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
#: The same in the JVM's notation, to be applied after ``lower``.
SQL_WORD = r"[\p{L}\p{N}]+"


class _Codes(dict):
    """Word -> 64-bit hash, remembered for the words met so far and emptied when it gets large."""

    limit = 2_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


_CODES = _Codes()


def split(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin (one more entry than texts)."""
    starts, words = [0], []
    for t in texts:
        if t:
            words += _WORD.findall(t.lower())
        starts.append(len(words))
    get = _CODES.__getitem__
    return np.fromiter(map(get, words), np.uint64, len(words)), np.array(starts, np.int64)
