"""How often every distinct term occurs, and in how many records, over a whole collection.

1. Each task packs the rows of one record that follow each other into one row
   (the terms' bytes, their lengths, their counts, as Arrow buffers without
   copying), so that what is shuffled by record is a row a record, not a row a
   term. Rows of records that don't exist are joined away there.
2. Each block of packed rows encodes its terms by a dictionary of its own and
   accumulates two count arrays, occurrences and records. Repeated rows of a
   record meet here and count once.
3. The distinct terms of all blocks get global integer identifiers, dense
   within ranges. Block counts are encoded by them, accumulated in arrays by
   identifier range, and the arrays are summed by range.
4. The sums are read off the arrays and decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.runtime import cut

#: Identifiers in one range, a power of two.
RANGE = 4096
_BLOCK = 1_000_000


def _parts(a: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Offsets and data of a string array without nulls."""
    a = a.cast(pa.string())
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return offsets, a.buffers()[2] or pa.py_buffer(b"")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        record = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(record):
            continue
        first = np.concatenate([[0], np.flatnonzero(record[1:] != record[:-1]) + 1])
        ends = np.concatenate([first, [len(record)]])
        offsets, data = _parts(batch.column(1))
        lens, ns = np.ascontiguousarray(np.diff(offsets), np.int32), np.ascontiguousarray(batch.column(2).to_numpy(zero_copy_only=False), np.int64)

        def runs(at: np.ndarray, buffer: pa.Buffer, n: int = len(first)) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), buffer])

        yield pa.RecordBatch.from_arrays([pa.array(record[first]), runs(offsets[ends], data), runs(ends * 4, pa.py_buffer(lens)), runs(ends * 8, pa.py_buffer(ns))], names=["record", "terms", "lens", "ns"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []
    size = 0

    def told() -> pa.RecordBatch:
        lens, ns = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        offsets = np.concatenate([[0], np.cumsum(lens)])
        wide = pa.Array.from_buffers(pa.large_string(), len(lens), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"".join(x[1] for x in held))])
        coded = wide.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids = np.array([x[0] for x in held])
        owner = np.repeat(np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]), [len(x[2]) for x in held])
        width = len(coded.dictionary)
        key = owner * width + code
        order = np.lexsort((ns, key))
        key, ns = key[order], ns[order]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        once = fresh | np.concatenate([[True], ns[1:] != ns[:-1]])
        code = key % width
        occurs, present = np.zeros(width, np.int64), np.bincount(code[fresh], minlength=width)
        np.add.at(occurs, code[once], ns[once])
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(occurs), pa.array(present)], names=["term", "n_total", "n_records"])

    for batch in batches:
        for record, terms, lens, ns in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if size >= _BLOCK and record != held[-1][0]:
                yield told()
                held, size = [], 0
            held.append((record, terms, np.frombuffer(lens, np.int32), np.frombuffer(ns, np.int64)))
            size += len(lens) // 4
    if held:
        yield told()


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays (range, occurs, present) of encoded counts (id, n_total, n_records)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        at, total, present = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        for r in np.unique(at // RANGE).tolist():
            own = at // RANGE == r
            if r not in sums:
                if len(sums) >= 1024:
                    yield _told(sums)
                    sums = {}
                sums[r] = np.zeros((2, RANGE), np.int64)
            np.add.at(sums[r][0], at[own] % RANGE, total[own])
            np.add.at(sums[r][1], at[own] % RANGE, present[own])
    if sums:
        yield _told(sums)


def _told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    both = np.stack(list(sums.values()))
    wide = lambda k: pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * RANGE), pa.array(np.ascontiguousarray(both[:, k]).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), wide(0), wide(1)], names=["range", "occurs", "present"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of count arrays of a stream sorted by range."""
    now: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if r not in now:
                if now:
                    yield _told(now)
                now = {r: np.zeros((2, RANGE), np.int64)}
            now[r][0] += a.values.to_numpy()
            now[r][1] += b.values.to_numpy()
    if now:
        yield _told(now)


def frequencies(rows: DataFrame, record: str, term: str, n: str | None = None, live: DataFrame | None = None) -> DataFrame:
    """(term, n_total, n_records): occurrences of each distinct term, and the records it is in.

    ``rows`` holds a record's id, a term and how often it occurs there (once
    without ``n``). Rows that repeat record, term and count are one row; rows of
    one record and term with other counts add up. Null records and terms are
    left out, null counts count 0. If ``live`` is given, its first column holds
    the ids of the records that exist; others don't count. Further columns don't
    matter; an empty table gives no rows.
    """
    x = rows.select(F.col(f"`{record}`").cast("bigint").alias("record"), F.col(f"`{term}`").cast("string").alias("term"), (F.coalesce(F.col(f"`{n}`").cast("bigint"), F.lit(0)) if n else F.lit(1).cast("bigint")).alias("n"))
    packed = x.where("record is not null and term is not null").mapInArrow(_packed, "record bigint, terms binary, lens binary, ns binary")
    if live is not None:
        packed = packed.join(live.select(F.col(live.columns[0]).cast("bigint").alias("record")).where("record is not null").distinct(), "record", "left_semi")
    # a broadcast join brings no record's rows together
    blocks = cut(packed.repartition("record").sortWithinPartitions("record").mapInArrow(_counted, "term string, n_total bigint, n_records bigint"))
    ids = cut(blocks.select("term").distinct().withColumn("id", F.monotonically_increasing_id()))
    encoded = blocks.join(ids, "term").select("id", "n_total", "n_records")
    schema = "range bigint, occurs array<bigint>, present array<bigint>"
    sums = encoded.mapInArrow(_arrays, schema).repartition("range").sortWithinPartitions("range").mapInArrow(_summed, schema)
    each = sums.select("range", F.posexplode(F.arrays_zip("occurs", "present")).alias("k", "x")).where("x.present > 0")
    return each.select((F.col("range") * RANGE + F.col("k")).alias("id"), F.col("x.occurs").alias("n_total"), F.col("x.present").alias("n_records")).join(ids, "id").select("term", "n_total", "n_records")


def marked(counts: DataFrame, n_all: int, rare: int = 3, common: float = 0.1) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``rare`` records, else ``common`` above the share ``common`` of ``n_all`` records, else null."""
    return counts.withColumn("mark", F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") > common * n_all, "common"))


def meta_values(notes: DataFrame, left_out: tuple[str, ...] = ("title", "date", "created", "updated", "aliases")) -> DataFrame:
    """(record, field, val, n): the values of a note's metadata, trimmed of spaces and lower-cased, with their entries in its list."""
    one = notes.where("note_id is not null and meta is not null").select("note_id", "meta").dropDuplicates(["note_id"])
    each = one.select(F.col("note_id").alias("record"), F.explode("meta").alias("key", "values")).where(~F.col("key").isin(*left_out))
    vals = each.select("record", F.concat(F.lit("meta."), "key").alias("field"), F.explode("values").alias("val")).where("val is not null")
    return vals.select("record", "field", F.lower(F.trim("val")).alias("val")).groupBy("record", "field", "val").agg(F.count("*").alias("n"))


def term_marks(postings: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """(field, val, n_total, n_records, mark) of every term of the postings of existing chunks and of every metadata value; ``mark`` may be null."""
    n_chunks = chunks.where("chunk_id is not null").select("chunk_id").distinct().count()
    n_notes = notes.where("note_id is not null").select("note_id").distinct().count()
    terms = marked(frequencies(postings, "chunk_id", "term", "tf", chunks.select("chunk_id")), n_chunks).select(F.lit("term").alias("field"), F.col("term").alias("val"), "n_total", "n_records", "mark")
    values = meta_values(notes).select("record", F.concat_ws("\x00", "field", "val").alias("term"), "n")
    meta = marked(frequencies(values, "record", "term", "n"), n_notes)
    field = F.substring_index("term", "\x00", 1)
    return terms.unionByName(meta.select(field.alias("field"), F.expr("substring(term, length(substring_index(term, '\\u0000', 1)) + 2)").alias("val"), "n_total", "n_records", "mark"))
