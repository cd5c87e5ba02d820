"""A note's text taken apart: frontmatter, title, outline, lead and chunks.

Fences, heading paths and the greedy size limit are automata over the lines of
one note, so a note is parsed by one task in one Arrow pass (``parsed``):
nothing is shuffled, however long the notes are. The functions below work on
one note; ``kinds`` classifies its lines once, and everything else reads that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, as stripped from lines and values.
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK_SIZE, LEAD_SIZE = 2000, 400
FENCES = ("```", "~~~")

Line = tuple[str, int, str]


def bare(value: str) -> str:
    """``value`` stripped, and without one pair of quotes around it."""
    v = value.strip(BLANKS)
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def listed(value: str) -> list[str]:
    """The values of a frontmatter line: a bracketed list split at its commas, or the value itself."""
    if value[:1] == "[" and value[-1:] == "]":
        return [bare(v) for v in value[1:-1].split(",") if v.strip(BLANKS)]
    return [bare(value)]


def frontmatter(lines: list[str]) -> tuple[dict[str, list[str]], int]:
    """(metadata, first line of the body). Without a closed block there is none and the body starts at line 0."""
    rules = (i for i, ln in enumerate(lines) if ln.strip(BLANKS) == "---")
    close = next(rules, -1) == 0 and next(rules, None)
    if not close:
        return {}, 0
    meta: dict[str, list[str]] = {}
    key = None
    for entry in (ln.strip(BLANKS) for ln in lines[1:close]):
        if entry[:1] in ("", "#"):
            continue
        if key and entry.startswith("- "):
            meta[key].append(bare(entry[2:]))
            continue
        name, colon, value = entry.partition(":")
        if colon and name:
            key, value = name.strip(BLANKS).lower(), value.strip(BLANKS)
            meta[key] = listed(value) if value else []
    return meta, close + 1


def heading(line: str) -> tuple[int, str]:
    """(level, text) of a heading line, (0, '') of any other."""
    level = len(line) - len(line.lstrip("#"))
    if 1 <= level <= 6 and line[level : level + 1] == " ":
        return level, line[level + 1 :].rstrip("#").strip(BLANKS)
    return 0, ""


def kinds(lines: list[str]) -> Iterator[Line]:
    """(kind, heading level, text) of each line: ``code`` in fences and on their marks, ``head``, ``blank`` or ``text``."""
    mark = None
    for ln in lines:
        t = ln.strip(BLANKS)
        if mark:
            mark = None if t.startswith(mark) else mark
            yield "code", 0, t
        elif t.startswith(FENCES):
            mark = t[:3]
            yield "code", 0, t
        else:
            level, text = heading(ln)
            yield ("head", level, text) if level else ("text" if t else "blank", 0, t)


def outline(marks: list[Line]) -> list[str]:
    """The headings, indented by level."""
    return ["  " * (level - 1) + text for kind, level, text in marks if kind == "head"]


def lead(marks: list[Line]) -> str:
    """The first paragraph of prose on one line, cut at ``LEAD_SIZE`` runes. Headings, code, tables and quotes neither belong to it nor end it."""
    taken: list[str] = []
    for kind, _, text in marks:
        if kind == "text" and text[0] not in "|>":
            taken.append(text)
        elif kind == "blank" and taken:
            break
    whole = " ".join(taken)
    return whole if len(whole) <= LEAD_SIZE else whole[:LEAD_SIZE].strip(BLANKS) + "…"


def pieces(body: list[str], size: int = CHUNK_SIZE) -> list[tuple[int, str]]:
    """(line offset, text) of the chunks of one section.

    A section within ``size`` (runes and line ends) is one chunk. A longer one
    is cut once that much has gathered: outside fences, before or after a blank
    line, or anywhere from one and a half times the size.
    """
    filled = [i for i, ln in enumerate(body) if ln.strip(BLANKS)]
    if not filled:
        return []
    first, last = filled[0], filled[-1]
    rows = body[first : last + 1]
    if sum(map(len, rows)) + len(rows) <= size:
        return [(first, "\n".join(rows))]
    empty = [not ln.strip(BLANKS) for ln in rows]
    breaks = [e or nxt for e, nxt in zip(empty, [*empty[1:], True], strict=True)]
    ends, open_from, gathered, mark = [], None, 0, None
    for i, ln in enumerate(rows):
        t = ln.strip(BLANKS)
        if t.startswith(FENCES) and (mark is None or t.startswith(mark)):
            mark = t[:3] if mark is None else None
        if open_from is None:
            if empty[i]:
                continue
            open_from, gathered = i, 0
        gathered += len(ln) + 1
        if mark is None and (gathered >= size if breaks[i] else 2 * gathered >= 3 * size):
            ends.append((open_from, i + 1))
            open_from = None
    if open_from is not None:
        ends.append((open_from, len(rows)))
    return [(first + a, "\n".join(rows[a:b]).strip(BLANKS)) for a, b in ends]


def sections(lines: list[str], marks: list[Line], start: int, title: str) -> list[tuple[str, int, str]]:
    """(breadcrumb, line, body) of all chunks. A breadcrumb is the path of headings above, or the title."""
    path: dict[int, str] = {}
    numbers = accumulate(kind == "head" for kind, _, _ in marks)
    out = []
    for _, own in groupby(enumerate(numbers), key=lambda x: x[1]):
        at = [i for i, _ in own]
        kind, level, text = marks[at[0]]
        if kind == "head":
            path = {k: v for k, v in path.items() if k < level} | {level: text}
            at = at[1:]
        crumb = " > ".join(v for _, v in sorted(path.items()) if v) or title
        for offset, body in pieces([lines[i] for i in at]):
            out.append((crumb, start + at[0] + offset + 1, body))
    return out


def parse(path: str, text: str) -> dict:
    """Title, metadata, headings, lead and sections of one note."""
    lines = text.replace("\r\n", "\n").split("\n")
    meta, start = frontmatter(lines)
    body = lines[start:]
    marks = list(kinds(body))
    title = next(iter(meta.get("title", [])), "")
    # the first top heading counts even inside a fence
    title = title or next((t for level, t in map(heading, body) if level == 1), "")
    name = path.rpartition("/")[2]
    stem, dot, _ = name.rpartition(".")
    title = title or (stem if dot else name)
    return {"title": title, "meta": list(meta.items()), "headings": outline(marks), "lead": lead(marks), "sections": sections(body, marks, start, title)}


SCHEMA = "path string, title string, meta map<string,array<string>>, headings array<string>, lead string, sections array<struct<breadcrumb:string,line:int,body:string>>"
_TYPES = [
    pa.string(), pa.string(), pa.map_(pa.string(), pa.list_(pa.string())), pa.list_(pa.string()), pa.string(),
    pa.list_(pa.struct([("breadcrumb", pa.string()), ("line", pa.int32()), ("body", pa.string())])),
]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            paths = batch.column(0).to_pylist()
            some = [parse(p or "", t or "") for p, t in zip(paths, batch.column(1).to_pylist(), strict=True)]
            columns = [
                paths, [x["title"] for x in some], [x["meta"] for x in some], [x["headings"] for x in some], [x["lead"] for x in some],
                [[{"breadcrumb": b, "line": n, "body": t} for b, n, t in x["sections"]] for x in some],
            ]
            kept = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)), *kept], names=["path", "title", "meta", "headings", "lead", "sections", *batch.schema.names[2:]])


def parsed(notes: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, title, meta, headings, lead, sections) and the columns ``keep`` of each note, row by row; a null text counts as empty."""
    given = notes.select(F.col(f"`{path_col}`").alias("path"), F.col(f"`{text_col}`").alias("text"), *keep)
    schema = T.StructType([*T.StructType.fromDDL(SCHEMA).fields, *given.select(*keep).schema.fields]) if keep else SCHEMA
    return given.mapInArrow(_parsed, schema)
