"""Which texts others go on from, told by sorting them and comparing neighbours' common prefixes.

In sorted order all texts that start with a given one follow it directly. A pass
over a sorted range keeps the texts that the current one starts with on a stack;
each hands what followed it down to the one it starts with, so the work is
linear. Where a range ends, the texts still open meet the next ranges in one
small task: a range is represented there by its first text and by how far the
following ones agree with that.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.runtime import cut

_SCHEMA = "part int, text string, good bigint, open boolean, lens array<bigint>, every array<bigint>, fits array<bigint>"
_NAMES = ["part", "text", "good", "open", "lens", "every", "fits"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=_NAMES)


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    return len(os.path.commonprefix((a, b)))


def _pass(allowed: Callable[[str], bool]):
    """Of a sorted stream (part, text, n, asked): asked texts with their followers, those open at the end, and the range's edge row (without ``open``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # text, all that start with it, those of them that go on as allowed
        first = part = None
        agreed, lens, every, fits = 0, [], [], []
        out: list[tuple] = []

        def down(text: str, n: int) -> None:
            """``n`` texts that start with ``text`` follow the one on top."""
            if stack:
                top = stack[-1]
                top[1] += n
                if allowed(text[len(top[0])]):
                    top[2] += n

        def close(open_: bool) -> None:
            text, n, good = stack.pop()
            if good or open_:
                out.append((part, text, good, open_, None, None, None))
            down(text, n)

        for batch in batches:
            for p, text, n, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if first is None:
                    first, part, agreed = text, p, len(text)
                elif agreed:
                    agreed = min(agreed, _common(first, text))
                if agreed or text == first:
                    fit = n if len(text) > agreed and allowed(text[agreed]) else 0
                    if lens and lens[-1] == agreed:
                        every[-1] += n
                        fits[-1] += fit
                    else:
                        lens.append(agreed)
                        every.append(n)
                        fits.append(fit)
                while stack and not text.startswith(stack[-1][0]):
                    close(False)
                if asked:
                    stack.append([text, n, 0])
                else:
                    down(text, n)
            if len(out) > 10_000:
                yield _batch(out)
                out.clear()
        while stack:
            close(True)
        if first is not None:
            out.append((part, first, None, None, lens, every, fits))
        yield _batch(out)

    return run


def _joined(allowed: Callable[[str], bool]):
    """Adds to the open texts (sorted by part) what follows them in later ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        edges = sorted((r for r in rows if r["open"] is None), key=lambda r: r["part"])
        at = {r["part"]: k for k, r in enumerate(edges)}
        out = []
        for r in (r for r in rows if r["open"]):
            text, good = r["text"], r["good"]
            for e in edges[at[r["part"]] + 1 :]:
                if not e["text"].startswith(text):
                    break
                own = allowed(e["text"][len(text)])
                good += sum(n if own else 0 for k, n in zip(e["lens"], e["every"], strict=True) if k > len(text)) + sum(n for k, n in zip(e["lens"], e["fits"], strict=True) if k == len(text))
            if good:
                out.append((text, good))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["text", "good"])

    return run


def followed(texts: DataFrame, allowed: Callable[[str], bool]) -> DataFrame:
    """(text, good) of the asked ones of ``texts`` (text, n, asked): the sum of n over the longer texts that start with it and go on with an ``allowed`` character, if there are any.

    Repeated texts count together; null and empty ones are left out.
    """
    own = texts.where("text <> ''").groupBy("text").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    ranged = own.repartitionByRange("text").sortWithinPartitions("text").select(F.spark_partition_id().alias("part"), "text", "n", "asked")
    seen = cut(ranged.mapInArrow(_pass(allowed), _SCHEMA))
    edges = seen.where("open is null or open").coalesce(1).mapInArrow(_joined(allowed), "text string, good bigint")
    return seen.where("not open").select("text", "good").unionByName(edges)
