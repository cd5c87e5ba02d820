"""Held-out passages inside a corpus, verbatim or with other numbers and names.

Both sides are written as templates: each word becomes itself or a typed
placeholder (number, code with digits, unit, name). Windows of template
words are hashed and joined by hash; the words in the slots then tell a
verbatim passage (all equal) from a re-parameterised one (every placeholder
filled by one and the same word wherever it recurs).

The held-out side is small: its window hashes are broadcast as a sorted array
while they are at most ``broadcast_windows``, and a document then sends out its
matching windows only. Beyond that size all windows are shuffled and joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notarium.llm import words as wd
from notarium.llm.hashing import GOLD, mix64

#: Unit words that take a placeholder.
UNITS = frozenset("ms us ns s sec second seconds min minute minutes h hour hours day days week weeks month months year years b kb mb gb tb byte bytes bit bits percent pct hz khz mhz ghz m km cm mm kg g mg".split())
_DIGITS = re.compile(r"\d")


class _Templates:
    """Numbers words and keeps, by number, the hash of a word, that of its template word, and whether that is a slot."""

    limit = 2_000_000

    def __init__(self, common: frozenset[str]) -> None:
        self.common = common
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.exact, self.template, self.slot = [], [], []

    def add(self, words: set[str]) -> None:
        if len(self.known) > self.limit:
            self.clear()
        for w in words - self.known.keys():
            kind = "<num>" if w.isdecimal() else "<code>" if _DIGITS.search(w) else "<unit>" if w in UNITS else w if w in self.common else "<name>"
            self.known[w] = len(self.exact)
            self.exact.append(xxhash.xxh3_64_intdigest(w))
            self.template.append(xxhash.xxh3_64_intdigest(kind))
            self.slot.append(kind is not w)
        if words:
            self.arrays = np.array(self.exact, np.uint64), np.array(self.template, np.uint64), np.array(self.slot, bool)


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` codes."""
    h = np.zeros(max(len(codes) - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h + codes[k : k + len(h)]) * GOLD
            h ^= h >> np.uint64(29)
    return mix64(h)


def _matched(common: frozenset[str], width: int, fixed: int, keys: np.ndarray | None):
    """Windows (id, pos, key, exact, words, slots) of each text; only those whose key is among ``keys``, if given.

    key is the hash of the template; of windows with fewer than ``fixed`` words
    outside slots it is the hash of the words themselves.
    """
    templates = _Templates(common)
    sieve = None
    if keys is not None:
        sieve = np.zeros(1 << 22, bool)
        sieve[keys & np.uint64((1 << 22) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = [wd.split(t) for t in batch.column(1).to_pylist()]
            templates.add(set().union(*lists))
            n = np.array([len(x) for x in lists], np.int64)
            if n.sum() < width:
                continue
            number = np.fromiter(map(templates.known.__getitem__, chain.from_iterable(lists)), np.int64, n.sum())
            exact, template, slot = (x[number] for x in templates.arrays)
            owner, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            e, k = _windows(exact, width), _windows(template, width)
            loose = np.concatenate([[0], np.cumsum(slot)])
            free = loose[width:] - loose[:-width] > width - fixed
            k = np.where(free, e, k)
            hit = owner[: len(k)] == owner[width - 1 :]
            if keys is not None:
                hit &= sieve[k & np.uint64((1 << 22) - 1)]
                at = np.flatnonzero(hit)
                at = at[keys[np.minimum(np.searchsorted(keys, k[at]), len(keys) - 1)] == k[at]] if len(keys) else at[:0]
            else:
                at = np.flatnonzero(hit)
            for part in np.array_split(at, max(1, len(at) // 20_000)):
                if not len(part):
                    continue
                span = part[:, None] + np.arange(width)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner[part]], pa.int64()), pa.array((part - first[owner[part]]).astype(np.int32)), pa.array(k[part].view(np.int64)), pa.array(e[part].view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(exact[span].ravel().view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(slot[span].ravel())),
                    ],
                    names=["id", "pos", "key", "exact", "words", "slots"],
                )

    return run


_SCHEMA = "id bigint, pos int, key bigint, exact bigint, words array<bigint>, slots array<boolean>"


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", width: int = 13, share: float = 0.02, fixed: int = 4, broadcast_windows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, doc_pos, item_pos, verbatim, doc_words, item_words, slots): windows of ``width`` words with the same template.

    Words of at least ``share`` of the items are fixed words, so there are at
    most 1 / ``share`` times the words of an item; all others stand in slots.
    ``verbatim`` is true where all words are equal. Null ids and texts, and
    texts of under ``width`` words, match nothing; other columns are ignored.
    """
    own = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null").distinct()
    n = max(own.select("id").distinct().count(), 1)
    each = own.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({wd.SQL_WORD})"), 1))).alias("word"))
    common = frozenset(r.word for r in each.groupBy("word").agg(F.countDistinct("id").alias("df")).where(F.col("df") >= max(share * n, 2)).select("word").collect())
    known = own.mapInArrow(_matched(common, width, fixed, None), _SCHEMA)
    some = known.select("key").distinct().limit(broadcast_windows + 1).toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)
    keys = np.sort(some) if len(some) <= broadcast_windows else None
    given = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null and text is not null")
    d = given.mapInArrow(_matched(common, width, fixed, keys), _SCHEMA).select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "key", F.col("exact").alias("e"), F.col("words").alias("doc_words"))
    i = known.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "key", "exact", F.col("words").alias("item_words"), "slots")
    i = F.broadcast(i) if keys is not None and i.count() <= broadcast_windows else i
    return d.join(i, "key").select("doc_id", "item_id", "doc_pos", "item_pos", ((F.col("e") == F.col("exact")) & (F.col("doc_words") == F.col("item_words"))).alias("verbatim"), "doc_words", "item_words", "slots")


def leaks(found: DataFrame) -> DataFrame:
    """(doc_id, item_id) of ``matches`` with a passage word for word."""
    return found.where("verbatim").select("doc_id", "item_id").distinct()


def _joined(x: DataFrame, least: int, drift: int) -> DataFrame:
    """Runs at several distances within ``drift`` words, taken together, with their counts."""
    pair = ["doc_id", "item_id"]
    # each distance with the ones near it before and after; a pair at one distance only has no row
    at = Window.partitionBy(*pair).orderBy("shift")
    near = x.select(*pair, "shift").distinct().withColumn("los", F.collect_list("shift").over(at.rangeBetween(-drift, 0))).withColumn("his", F.collect_list("shift").over(at.rangeBetween(0, drift)))
    spans = near.select(*pair, "shift", F.explode("los").alias("lo"), "his").select(*pair, "shift", "lo", F.explode("his").alias("hi")).where((F.col("lo") < F.col("hi")) & (F.col("hi") - F.col("lo") <= drift))
    run = [*pair, "lo", "hi"]
    each = x.join(spans, [*pair, "shift"]).select(*run, "shift", "item_pos", F.posexplode(F.arrays_zip("item_words", "doc_words", "slots")).alias("k", "w")).select(*run, "shift", (F.col("item_pos") + F.col("k")).alias("at"), "w.item_words", "w.doc_words", "w.slots").distinct()
    # a word with a place at several distances is where they meet: its replacement isn't one word
    met = Window.partitionBy(*run, "at")
    told = each.withColumn("seam", F.min("shift").over(met) < F.max("shift").over(met))
    word = told.groupBy(*run, "item_words").agg(
        F.countDistinct(F.when(~F.col("seam"), F.col("doc_words"))).alias("ways"), F.countDistinct("at").alias("n"), F.max(F.col("slots").cast("int")).alias("slot"),
        F.countDistinct(F.when(F.col("seam"), F.col("at"))).alias("n_seam"), F.countDistinct(F.when(F.col("doc_words") != F.col("item_words"), F.col("at"))).alias("changed"),
    )
    runs = word.groupBy(*run).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("slot")).alias("n_slots"), F.sum("changed").alias("n_changed"), F.max("ways").alias("ways"), F.sum("n_seam").alias("n_seam"))
    return runs.where((F.col("ways") == 1) & (F.col("n_changed") > 0) & (F.col("n_words") >= least) & (F.col("n_seam") <= drift))


def reparameterised(found: DataFrame, least: int = 20, drift: int = 5) -> DataFrame:
    """(doc_id, item_id, n_words, n_slots, n_changed) of items that are in a document with other numbers or names.

    Windows of one document, item and distance belong together, and so do those
    at distances that differ by up to ``drift`` words, as a replacement of
    another number of words makes them; they must cover at least ``least``
    words. Slots are consistent if each word of the item is replaced by one word
    only, save the up to ``drift`` words where two distances meet; at least one
    must be changed, and no window of the pair may be verbatim.
    """
    x = found.withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    run = ["doc_id", "item_id", "shift"]
    each = x.select(*run, "item_pos", F.posexplode(F.arrays_zip("item_words", "doc_words", "slots")).alias("k", "w")).select(*run, (F.col("item_pos") + F.col("k")).alias("at"), "w.item_words", "w.doc_words", "w.slots").distinct()
    word = each.groupBy(*run, "item_words").agg(F.countDistinct("doc_words").alias("ways"), F.min("doc_words").alias("d"), F.max(F.col("slots").cast("int")).alias("slot"), F.countDistinct("at").alias("n"))
    runs = word.groupBy(*run).agg(F.sum("n").alias("n_words"), F.sum(F.col("n") * F.col("slot")).alias("n_slots"), F.sum(F.when(F.col("d") != F.col("item_words"), F.col("n")).otherwise(0)).alias("n_changed"), F.max("ways").alias("ways"))
    good = runs.where((F.col("ways") == 1) & (F.col("n_changed") > 0) & (F.col("n_words") >= least))
    both = [*run[:2], "n_words", "n_slots", "n_changed"]
    best = good.select(*both).unionByName(_joined(x, least, drift).select(*both)).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_slots", "n_changed")).alias("b")).select("doc_id", "item_id", "b.*")
    return best.join(leaks(found), ["doc_id", "item_id"], "left_anti")
