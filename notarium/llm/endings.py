"""Whether a text ends where its author ended it, judged by what all texts of the corpus do.

Two passes over the texts, both in Arrow batches with counts combined per task:

* ``vocabulary`` counts words by language. The most frequent ones (a bounded
  list) are the skeleton words; everything else is slot filling.
* ``outlines`` cuts each text into units (sentences, list items), writes each
  as a frame, its skeleton words and punctuation with ``_`` in the slots, and
  counts how often a frame occurs ended and at all. A text's last unit comes
  out by itself, with what its structure says.

``judged`` joins the last units with the corpus: the trie of known words, the
trie of frames, the frames that end, and the lengths at which a source's texts
pile up. A trie is a table of its nodes, each a rolling 64-bit hash of the
letters or frame tokens above it, so that a word or unit of any length costs a
number a letter or token; only the nodes that a last unit asks for are counted.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.llm.hashing import mix64, powers
from notarium.runtime import cut

_WORD = re.compile(r"[^\W\d_]+")
#: A number of three digits or more with its inner marks: dates, times, versions, grouped digits.
_NUMBER = re.compile(r"\d[.,:/-]*\d(?:[\d.,:/-]*\d)")
_VOCABULARY = re.compile(r"[^\W\d_]+|" + _NUMBER.pattern)
_TOKEN = re.compile(r"`[^`\n]*`|\b0[xX][0-9A-Fa-f]+|[^\W_][\w:]*\w|\w|[^\w\s]")
_HEX = re.compile(r"0[xX][0-9A-Fa-f]+$")
_IDENT = re.compile(r"[^_]_[^_]|\w::\w|[^\W\d_A-Z][A-Z]")
_ITEM = re.compile(r"(?:[-*+]|\d{1,9}[.)])\s+(?:\[[ xX]\]\s+)?")
_ENDED = re.compile(r"[.!?。！？][\"'”’»)*_\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)*_]*\s+")
#: What field limits and transfers leave behind a cut, spelled backwards, so that looking for it begins at the end.
_SKRAM = re.compile(r"\s*(?:(?:…|\.{3,}|[\])]\s*(?:…|\.{3,}|detacnurt|tuc|erom)\s*[\[(]|\ufffd)\s*)+", re.IGNORECASE)
_DROPPED = "*_\"'“”‘’«»"
FLUSH = 400_000
#: Characters of a text's end that are looked at for marks first; more only where all of them are marks.
_END = 256


def without_marks(body: str) -> str:
    """``body`` without the marks at its end."""
    size = _END
    while True:
        found = _SKRAM.match(body[: -size - 1 : -1])
        if not found or found.end() < min(size, len(body)) or size >= len(body):
            return body[: len(body) - found.end()] if found else body
        size *= 2


def language_key(lang: Column) -> Column:
    """The first two letters of a language tag, lower-cased; ``xx`` without one."""
    return F.coalesce(F.nullif(F.lower(F.substring(F.trim(lang), 1, 2)), F.lit("")), F.lit("xx"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def told() -> pa.RecordBatch:
        rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _VOCABULARY.findall(without_marks(text.rstrip()).lower())
            # the last word may be a piece of one
            counts[lang].update(words[:-1])
        if sum(map(len, counts.values())) > FLUSH:
            yield told()
    yield told()


def vocabulary(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of the words, and numbers of several digits, of ``texts`` (lang, text), the last one of each text left out."""
    some = texts.select("lang", "text").where("text is not null")
    return some.mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def skeleton_words(words: DataFrame, share: float = 0.004, least: int = 5) -> frozenset[str]:
    """Words that make up at least ``share`` of a language's words, so at most 1 / ``share`` a language."""
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    rows = words.join(F.broadcast(total), "lang").where((F.col("n") >= share * F.col("total")) & (F.col("n") >= least)).select("word").distinct()
    return frozenset(r.word for r in rows.collect())


class _Frames:
    """Frames of units, given the skeleton words."""

    def __init__(self, kept: frozenset[str]) -> None:
        self.kept, self.known = kept, {}

    def token(self, t: str) -> str:
        if t[0] == "`" and len(t) > 1:
            return "I"
        if _HEX.match(t):
            return f"H{len(t) - 2}"
        if t.isdigit():
            return "N"
        if _IDENT.search(t):
            return "I"
        if t[0].isalnum():
            low = t.lower()
            return low if low in self.kept else "_"
        return "" if t in _DROPPED else t

    def of(self, unit: str) -> str:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for t in _TOKEN.findall(unit):
            f = known.get(t)
            if f is None:
                f = known[t] = self.token(t)
            if f:
                out.append(f)
        return " ".join(out)


def paragraphs(text: str) -> tuple[list[tuple[str, bool]], str]:
    """(paragraphs and list items, each with whether it is an item; what the end of the text is in: '', 'fence', 'row', 'heading', 'closed' or 'whole row')."""
    lines = text.replace("\r\n", "\n").lstrip("﻿").split("\n")
    start = 0
    if lines and lines[0].strip() == "---":
        start = next((k + 1 for k in range(1, len(lines)) if lines[k].strip() == "---"), 0)
    out: list[list[str]] = []
    listed: list[bool] = []
    fence, state, fresh, cells, quoted = "", "", True, 0, False
    for line in lines[start:]:
        s = line.strip()
        mark = s[:3]
        if fence:
            if mark == fence:
                fence, state = "", "closed"
            continue
        if not s:
            fresh, cells = True, 0
            continue
        if mark in ("```", "~~~"):
            fence, fresh, state = mark, True, ""
        elif s[0] == "|":
            n = s.count("|")
            whole = s[-1] == "|" and n > 1 and (not cells or n >= cells)
            cells = cells or n
            state, fresh = ("whole row" if whole else "row"), True
        elif s[0] == "#" and s.lstrip("#")[:1] == " ":
            state, fresh = "heading", True
        else:
            state = ""
            item = _ITEM.match(s)
            fresh = fresh or quoted != (s[0] == ">")
            quoted = s[0] == ">"
            if quoted:
                s = s.lstrip("> ")
            if item:
                s = s[item.end() :]
            if fresh or item or not out:
                out.append([s])
                listed.append(bool(item))
            else:
                out[-1].append(s)
            fresh = False
    return list(zip(map(" ".join, out), listed, strict=True)), "fence" if fence else state


def _number(unit: str) -> str:
    """The number at the end of ``unit``, with its inner marks."""
    k = len(unit)
    while k and (unit[k - 1].isdecimal() or unit[k - 1] in ".,:/-"):
        k -= 1
    found = _NUMBER.search(unit, k)
    return found.group() if found and found.end() == len(unit) else ""


def _outlined(kept: frozenset[str]):
    frames = _Frames(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended, went = Counter(), Counter()

        def told(rows: list[tuple], counts: bool) -> pa.RecordBatch:
            if counts:
                for f in went.keys() | ended.keys():
                    rows.append((None, f, ended[f], went[f], None, None, None, None))
                ended.clear()
                went.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            rows = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = text.rstrip()
                short = without_marks(body)
                parts, state = paragraphs(short)
                last = ""
                for k, (p, item) in enumerate(parts):
                    units = _SPLIT.split(p)
                    if k == len(parts) - 1 and state not in ("whole row", "row", "closed", "heading", "fence"):
                        last = units.pop()
                        item = False
                    for n, u in enumerate(units, 1):
                        f = frames.of(u)
                        if _ENDED.search(u):
                            f = f.rstrip(" .!?")
                            ended[f] += 1
                        elif item and n == len(units):  # a list item that another follows ends as it is
                            ended[f] += 1
                        went[f] += 1
                terminated = bool(_ENDED.search(last)) and not (body != short and body[len(short) :].lstrip().startswith("..") and last.endswith("."))
                if terminated:
                    f = frames.of(last).rstrip(" .!?")
                    if body == short:
                        ended[f] += 1
                        went[f] += 1
                else:
                    f = frames.of(last)
                open_ = last.count("`") % 2 == 1 or last.count("(") > last.count(")") or last.count("[") > last.count("]")
                how = "fence" if state == "fence" else "row" if state == "row" else "open" if open_ and not terminated else "byte" if "�" in body[len(short) :] else "ended" if terminated or not last else "loose"
                tokens = _TOKEN.findall(last)
                tail = tokens[-1] if tokens else ""
                word = ""
                if tail and tail[0] != "`" and how == "loose":
                    if _HEX.match(tail):
                        word = f"0x{len(tail) - 2}"
                    elif tail[-1].isalpha():
                        word = (_WORD.findall(tail.lower()) or [""])[-1]
                    elif tail.isdecimal():
                        word = _number(last)
                rows.append((at, f, None, None, how, word, body != short, state))
            yield told(rows, sum((len(ended), len(went))) > FLUSH)
        yield told([], True)

    return run


_NAMES = ["id", "frame", "ended", "went", "how", "word", "marked", "state"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
_SCHEMA = "id bigint, frame string, ended bigint, went bigint, how string, word string, marked boolean, state string"


def outlines(texts: DataFrame, kept: frozenset[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, tails) over ``texts`` (id, text): frames (frame, ended, went), tails one row a text with its last unit."""
    both = cut(texts.select("id", "text").where("text is not null").mapInArrow(_outlined(kept), _SCHEMA))
    frames = both.where("id is null").groupBy("frame").agg(F.sum("ended").alias("ended"), F.sum("went").alias("went"))
    return frames, both.where("id is not null").select("id", "frame", "how", "word", "marked", "state")


def _nodes(of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: bool):
    """(node, n) of rows (sequence, n): the trie nodes above a sequence; with ``whole`` its own node too, and only that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts = of(batch.column(0).to_pylist())
            size = np.diff(starts)
            at = np.arange(len(codes)) - np.repeat(starts[:-1], size)
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers(int(size.max(initial=0)))[at], dtype=np.uint64)])
                node = mix64(sums[1:] - np.repeat(sums[starts[:-1]], size) + at.astype(np.uint64) + np.uint64(1)).view(np.int64)
            last = at == np.repeat(size, size) - 1
            keep = last if whole else ~last
            n = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), size)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(n, pa.int64())], names=["node", "n"])

    return run


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return mix64(flat + np.uint64(1)), np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])


def _tokens(frames: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lists = [f.split(" ") for f in frames]
    flat = [xxhash.xxh3_64_intdigest(t) for x in lists for t in x]
    return np.array(flat, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])


def below(sequences: DataFrame, asked: DataFrame, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(sequence, n): of the ``asked`` (sequence), those that are an inner node of the trie of ``sequences`` (sequence, n), with the sum of n below.

    ``of`` writes sequences as codes, of letters or of tokens. The result has
    ``asked`` sequences once; empty ones and those without anything below are missing.
    """
    own = asked.select("sequence").where("sequence <> ''").distinct()
    ask = _keyed(own, of)
    nodes = sequences.where("sequence <> ''").select("sequence", "n").mapInArrow(_nodes(of, False), "node bigint, n bigint")
    met = nodes.join(ask.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("n").alias("n"))
    return ask.join(met, "node").select("sequence", "n")


def _keyed(own: DataFrame, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(sequence, node) of ``own`` (sequence)."""
    whole = _nodes(of, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in whole(iter([pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(batch), np.int64))], names=["sequence", "n"])])):
                yield pa.RecordBatch.from_arrays([batch.column(0), got.column(0)], names=["sequence", "node"])

    return own.mapInArrow(run, "sequence string, node bigint")


def beginnings(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(word) of the ``tokens`` (word) that start a longer one of ``words``."""
    return below(words.select(F.col("word").alias("sequence")).distinct().withColumn("n", F.lit(1).cast("bigint")), tokens.select(F.col("word").alias("sequence")), _letters).select(F.col("sequence").alias("word"))


def prefixes(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """(frame, goes_on) of ``asked`` (frame): how many units of ``frames`` (frame, went) have it as a proper prefix; none are left out."""
    units = frames.where("went > 0").select(F.col("frame").alias("sequence"), F.col("went").alias("n"))
    return below(units, asked.select(F.col("frame").alias("sequence")), _tokens).select(F.col("sequence").alias("frame"), F.col("n").alias("goes_on"))


def limits(sized: DataFrame, least: int = 3, share: float = 0.25) -> DataFrame:
    """(source, kind, size): lengths, in characters or bytes, at which texts of a source are cut again and again.

    ``sized`` holds source, kind, size, h (hash of the text) and ``evident``. At
    least ``least`` different texts and ``share`` of those of that length must be
    evidently cut.
    """
    each = sized.groupBy("source", "kind", "size", "h").agg(F.max("evident").alias("evident"))
    n = each.groupBy("source", "kind", "size").agg(F.count("*").alias("n"), F.count_if("evident").alias("n_cut"))
    return n.where((F.col("n_cut") >= least) & (F.col("n_cut") >= share * F.col("n"))).select("source", "kind", "size")


def judged(texts: DataFrame, share: float = 0.004, ratio: float = 0.05, fewest: int = 3, sure: int = 10, continued: Callable[[DataFrame, DataFrame], DataFrame] = prefixes, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Whether and why a text counts as cut: one row for each of ``texts`` (id, text, lang, source; other columns are dropped).

    Columns id, source, how, state, marked, frame, word, ended, goes_on,
    before, begins, partial, at_limit and ``cut`` (boolean, never null). A text is cut
    if its structure is open (fence, table row, code span, link, half a
    character); or if its last unit has no end and either

    * its last word is unknown and starts known words (a number of three digits
      or more: known numbers, where no unit like its own has ended),
    * its frame goes on elsewhere (at least ``fewest`` times) and ends there in
      less than ``ratio`` of the cases,
    * its last word starts known words, and its frame occurs nowhere though it
      does without that word, at least ``sure`` times, or
    * its length is one at which its source's texts are cut again and again.

    Texts that are null or empty aren't cut; those that end after a heading,
    table or code block are by their length only. Repeated ids count once.
    """
    texts = texts.select(F.col("id").cast("bigint").alias("id"), "text", language_key(F.col("lang")).alias("lang"), "source").where("text is not null")
    words = cut(vocabulary(texts))
    frames, tails = outlines(texts, skeleton_words(words, share))
    tails = tails.dropDuplicates(["id"])
    loose = tails.where("how = 'loose'").select("id", "frame", "word", F.regexp_replace("frame", " ?[^ ]+$", "").alias("parent"))
    tokens = loose.where("word <> ''").select("word").distinct()
    known = words.join(F.broadcast(tokens) if tokens.count() <= broadcast_rows else tokens, "word", "left_semi").select("word").distinct()
    shapes = frames.select(F.explode(F.regexp_extract_all("frame", F.lit(r"\bH(\d+)"), 1)).alias("k"), "went").groupBy("k").agg(F.sum("went").alias("n")).where("length(k) < 4")
    usual = {int(r.k): r.n for r in shapes.collect()}
    whole = {k for k, n in usual.items() if n >= 0.02 * sum(usual.values())}
    hexes = [f"0x{k}" for k in range(max(whole, default=0)) if k not in whole]
    begun = beginnings(tokens, words).join(known.withColumn("known", F.lit(True)), "word", "left")
    begun = begun.select("word", F.lit(True).alias("begins"), F.col("known").isNull().alias("partial"))
    begun = begun.unionByName(tokens.where(F.col("word").isin(*hexes)).select("word", F.lit(True).alias("begins"), F.lit(True).alias("partial")))
    asked = cut(loose.select("frame").union(loose.select("parent")).where("frame <> ''").distinct())
    on = continued(frames, asked)
    told = frames.join(asked, "frame", "left_semi").select("frame", "ended").join(on, "frame", "full_outer")
    # texts without a last word or frame would all meet in one task
    alone = lambda c: F.when(F.col(c) == "", F.concat(F.lit("\x00"), F.col("id").cast("string"))).otherwise(F.col(c)).alias(c)
    x = loose.select("id", *map(alone, ("frame", "word", "parent"))).join(begun, "word", "left").join(told, "frame", "left").join(on.toDF("parent", "before"), "parent", "left")
    x = x.select("id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("begins", "partial")], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ended", "goes_on", "before")])
    numeric = ~F.col("word").rlike(r"\p{L}")
    broken = (F.col("goes_on") >= fewest) & (F.col("ended") < F.greatest(F.lit(1.0), ratio * F.col("goes_on")))
    stray = F.col("begins") & ~F.coalesce(numeric, F.lit(True)) & ~F.col("frame").endswith("I") & (F.col("goes_on") == 0) & (F.col("ended") == 0) & (F.col("before") >= sure)
    open_, no_end = F.col("how").isin("fence", "row", "open", "byte"), F.col("how") == "loose"
    may_stop = no_end | ((F.col("how") == "ended") & F.col("state").isin("whole row", "heading", "closed"))
    at = texts.select("id", "source", F.xxhash64("text").alias("h"), F.struct(F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).alias("size")).dropDuplicates(["id"])
    y = at.join(tails, "id").join(x, "id", "left").withColumn("evident", F.coalesce(open_ | (no_end & ((F.col("partial") & (~numeric | (F.col("ended") == 0))) | broken | stray)), F.lit(False)))
    y = cut(y)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"size.{k}").alias("size")) for k in ("chars", "bytes")]))
    sized = y.select("id", "source", "h", "evident", "how", "state", each.alias("s")).select("id", "source", "h", "evident", "how", "state", "s.*")
    spikes = limits(sized)
    near = sized.where(may_stop).alias("t").join(spikes.alias("k"), F.expr("t.source <=> k.source and t.kind = k.kind and t.size = k.size"), "left_semi").select("id").distinct()
    y = y.drop("h", "size").join(near.withColumn("at_limit", F.lit(True)), "id", "left").withColumn("at_limit", F.coalesce("at_limit", F.lit(False)))
    return y.withColumn("cut", F.col("evident") | (may_stop & F.col("at_limit"))).drop("evident")
