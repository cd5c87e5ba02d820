"""Summaries by a given function: what is pending, what it gets to read, and progress that is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES = 24_000
SALTS = 64
PROMPT = "Summarise the note below in two or three sentences, in its own language.\n\n%s"


def checked_prompt(prompt: str = "") -> str:
    """``prompt`` or the default one; it must have exactly one place for the note."""
    prompt = prompt or PROMPT
    if prompt.count("%s") != 1:
        raise ValueError("the prompt must contain %s exactly once")
    return prompt


def pending(notes: DataFrame, limit: int = 0) -> DataFrame:
    """Notes whose summary is missing or was made of another content, by path; the first ``limit``, if positive."""
    todo = notes.where(~F.col("sum_hash").eqNullSafe(F.col("hash"))).orderBy("path")
    return todo.limit(limit) if limit > 0 else todo


def inputs(notes: DataFrame, chunks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, text): title, lead and headings, then chunks in order until ``most`` bytes are passed. The chunk that passes them is kept whole."""
    head = F.concat_ws("\n\n", F.coalesce("title", F.lit("")), F.coalesce("lead", F.lit("")), F.array_join(F.coalesce("headings", F.array().cast("array<string>")), "\n"))
    n = notes.select("path", head.alias("head"))
    part = F.concat(F.lit("\n\n"), F.coalesce("breadcrumb", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    # a part has three bytes at least, so the first ones of a note suffice; a note with very many
    # chunks is cut down to them in ``SALTS`` tasks before one task sees what is left
    enough, order = most // 3 + 2, Window.partitionBy("path").orderBy("chunk_id")
    parts = chunks.select("path", "chunk_id", part.alias("part"), F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).alias("salt"))
    some = parts.withColumn("n", F.row_number().over(Window.partitionBy("path", "salt").orderBy("chunk_id"))).where(F.col("n") <= enough)
    first = some.drop("n", "salt").withColumn("n", F.row_number().over(order)).where(F.col("n") <= enough)
    c = first.drop("n").join(n, "path")
    so_far = F.coalesce(F.sum(F.octet_length("part")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = c.withColumn("before", F.octet_length("head") + so_far).where(F.col("before") <= most)
    body = kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "part"))), lambda x: x["part"]), "").alias("body"))
    return n.join(body, "path", "left").select("path", F.concat("head", F.coalesce("body", F.lit(""))).alias("text"))


class SummaryFailed(RuntimeError):
    """The summariser failed on a note; ``done`` holds what was made before."""

    def __init__(self, path: str, done: list[tuple[str, str, str]]) -> None:
        super().__init__(f"{path}: no summary")
        self.path, self.done = path, done


def summaries(notes: DataFrame, chunks: DataFrame, summarise: Callable[[str], str], prompt: str = "", limit: int = 0, log: Callable[[str], None] | None = None) -> list[tuple[str, str, str]]:
    """(path, summary, sum_hash) for each pending note, one call after the other; what was made before a failure comes with it."""
    ask = checked_prompt(prompt)
    todo = pending(notes, limit).select("path", "hash", "title", "lead", "headings")
    done: list[tuple[str, str, str]] = []
    for r in inputs(todo, chunks).join(todo.select("path", "hash"), "path").orderBy("path").toLocalIterator():
        try:
            made = summarise(ask.replace("%s", r.text)).strip()
        except Exception as e:
            raise SummaryFailed(r.path, done) from e
        done.append((r.path, made, r.hash))
        if log:
            log(f"  summarised {r.path}")
    return done


def with_summaries(notes: DataFrame, made: list[tuple[str, str, str]]) -> DataFrame:
    """``notes`` with the summaries made put in."""
    new = notes.sparkSession.createDataFrame(made, "path string, s string, h string")
    old = [c for c in notes.columns if c not in ("summary", "sum_hash")]
    return notes.join(new, "path", "left").select(*old, F.coalesce("s", "summary").alias("summary"), F.coalesce("h", "sum_hash").alias("sum_hash"))
