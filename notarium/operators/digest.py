"""A map of the notes: grouped, newest first, each with its tags, summary or lead, and outline."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notarium.functions import dates
from notarium.operators.index import dense_ids
from notarium.runtime import cut


@dataclass(frozen=True)
class DigestOptions:
    title: str = "Notes map"
    group_by: str = ""
    show: tuple[str, ...] = ("status", "tags")
    since: datetime | None = None
    max_headings: int = 12
    now: datetime | None = None


def group_of(field: str) -> Column:
    """The top folder, ``(root)`` without one; or the first value of ``field``, ``(no field)`` without one."""
    if not field:
        return F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("(root)")
    first = dates.meta_first(F.col("meta"), field)
    return F.when(first != "", first).otherwise(f"(no {field})")


def _line(parts: list[Column], sep: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), sep)


def tag_line(show: tuple[str, ...], date: Column) -> Column:
    own = [F.when(F.size(dates.values(F.col("meta"), k)) > 0, F.concat(F.lit(f"{k}: "), F.array_join(dates.values(F.col("meta"), k), ", "))).otherwise("") for k in show]
    return _line([*own, F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(""))], " · ")


def meta_line(show: list[str], meta: Column) -> Column:
    """``key=value,value`` of the fields that have values, in the order given."""
    own = [F.when(F.size(dates.values(meta, k)) > 0, F.concat(F.lit(f"{k}="), F.array_join(dates.values(meta, k), ","))).otherwise("") for k in show]
    return _line(own or [F.lit("")], " ")


def blocks(notes: DataFrame, opt: DigestOptions) -> DataFrame:
    """(group, date, path, block): one row a note, its text as in the digest. Notes without a date fall out where ``since`` is set."""
    date = dates.note_date(F.col("meta"), F.col("mtime"))
    n = opt.max_headings if opt.max_headings > 0 else 12
    text = F.coalesce(F.nullif("summary", F.lit("")), F.col("lead"), F.lit(""))
    tags = tag_line(opt.show, date)
    heads = F.coalesce(F.col("headings"), F.array().cast("array<string>"))
    listed = F.concat(F.array_join(F.transform(F.slice(heads, 1, n), lambda h: F.concat(F.lit("- "), h, F.lit("\n"))), ""), F.when(F.size(heads) > n, F.concat(F.lit("- …"), (F.size(heads) - n).cast("string"), F.lit(" more\n"))).otherwise(""), F.lit("\n"))
    block = F.concat(
        F.lit("### ["), F.coalesce("title", F.lit("")), F.lit("]("), F.col("path"), F.lit(")\n\n"),
        F.when(tags != "", F.concat(F.lit("`"), tags, F.lit("`\n\n"))).otherwise(""),
        F.when(text != "", F.concat(text, F.lit("\n\n"))).otherwise(""),
        F.when(F.size(heads) > 0, listed).otherwise(""),
    )
    out = notes.select(group_of(opt.group_by).alias("group"), date.alias("date"), "path", block.alias("block"))
    return out.where(F.col("date") >= F.lit(opt.since)) if opt.since else out


def document(notes: DataFrame, opt: DigestOptions) -> DataFrame:
    """(pos, text): the digest's blocks in order from 1 on, a group's first one with the group's heading; newest first, notes without a date last."""
    rows = blocks(notes, opt).withColumn("\x02d", F.coalesce(-F.unix_micros("date"), F.lit((1 << 63) - 1)))
    placed = dense_ids(rows, ["group", "\x02d", "path"], "pos")
    first = placed.groupBy("group").agg(F.min("pos").alias("first"))
    head = F.when(F.col("pos") == F.col("first"), F.concat(F.lit("## "), "group", F.lit("\n\n"))).otherwise("")
    return placed.join(first, "group").select("pos", F.concat(head, "block").alias("text"))


def render(notes: DataFrame, opt: DigestOptions) -> Iterator[str]:
    """The digest in pieces, read partition by partition."""
    rows = cut(document(notes, opt))
    now = opt.now or datetime.now(UTC)
    since = f", changes since {opt.since:%Y-%m-%d}" if opt.since else ""
    yield f"# {opt.title or 'Notes map'}\n\n_Generated {now:%Y-%m-%d %H:%M}{since}. Files: {rows.count()}._\n\n"
    for r in rows.orderBy("pos").toLocalIterator():
        yield r.text
