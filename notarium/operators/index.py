"""The index: notes, chunks, postings, document lengths and totals, as versioned Parquet tables.

A version is a folder ``v=N`` with one folder a table; the file ``CURRENT`` names
the versions whose folders make up each table and is replaced once those of the
next one are written. A refresh reads the listing against the stored hashes,
parses what is new or changed, and adds that and the ids of dead chunks as a
version of its own; when over a fifth of all chunks are dead, all is written
anew. Folders may be in any file system that Spark can reach.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notarium.functions.markdown import parsed
from notarium.functions.terms import Expansions, raw_tokens
from notarium.runtime import cut
from notarium.sources import files

NOTES = "path string, hash string, mtime timestamp, title string, meta map<string,array<string>>, headings array<string>, lead string, summary string, sum_hash string"
CHUNKS = "chunk_id bigint, path string, ord int, breadcrumb string, line int, body string"
POSTINGS = "term string, chunk_id bigint, tf int"
DOC_LEN = "chunk_id bigint, len int"
STATS = "n_notes bigint, n_chunks bigint, n_terms bigint, total_len bigint, avg_len double"
SCHEMAS = {"notes": NOTES, "chunks": CHUNKS, "postings": POSTINGS, "doc_len": DOC_LEN, "corpus_stats": STATS}


@dataclass(frozen=True)
class Index:
    notes: DataFrame
    chunks: DataFrame
    postings: DataFrame
    doc_len: DataFrame
    corpus_stats: DataFrame


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Expansions()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        counts = [Counter(chain.from_iterable(map(terms.__getitem__, raw_tokens(t)))) for t in batch.column(1).to_pylist()]
        sizes = [len(c) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(chain.from_iterable(counts)), pa.string()),
                pa.array([i for i, n in zip(ids, sizes, strict=True) for _ in range(n)], pa.int64()),
                pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int32()),
            ],
            names=["term", "chunk_id", "tf"],
        )


def indexed_text(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text): what is searched of a chunk, its breadcrumb, path and body."""
    return chunks.select("chunk_id", F.concat_ws("\n", F.coalesce("breadcrumb", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("body", F.lit(""))).alias("text"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf) of ``chunks``; one Arrow pass, no shuffle. Chunks that repeat an id must have been dropped."""
    return indexed_text(chunks).where("chunk_id is not null").mapInArrow(_posted, POSTINGS)


def doc_lengths(posted: DataFrame) -> DataFrame:
    """(chunk_id, len): terms of a chunk with their repeats."""
    return posted.groupBy("chunk_id").agg(F.sum("tf").cast("int").alias("len"))


def corpus_stats(notes: DataFrame, chunks: DataFrame, posted: DataFrame) -> DataFrame:
    """One row: distinct notes, chunks and terms, all terms with their repeats, and their average a chunk."""
    one = lambda df, *cols: df.agg(*cols)
    n = one(notes, F.countDistinct("path").alias("n_notes")).select("n_notes", F.lit(0).alias("k"))
    c = one(chunks, F.countDistinct("chunk_id").alias("n_chunks")).select("n_chunks", F.lit(0).alias("k"))
    p = one(posted, F.countDistinct("term").alias("n_terms"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_len")).select("n_terms", "total_len", F.lit(0).alias("k"))
    out = n.join(c, "k").join(p, "k")
    return out.select("n_notes", "n_chunks", "n_terms", "total_len", F.when(F.col("n_chunks") > 0, F.col("total_len") / F.col("n_chunks")).otherwise(0.0).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(term, df)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def notes_and_sections(texts: DataFrame) -> DataFrame:
    """``texts`` (path, hash, mtime, text) parsed, with summary and sum_hash still null."""
    return parsed(texts, keep=("hash", "mtime")).select("path", "hash", "mtime", "title", "meta", "headings", "lead", F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("sum_hash"), "sections")


def numbered(sections: DataFrame, after: int = 0) -> DataFrame:
    """Chunks with ids from ``after`` + 1 on, in the order of path elements and sections.

    Sorted by range; the numbers of the chunks before a range are added to its
    own, so no task sees all rows.
    """
    order = F.split("path", "/")
    flat = sections.select("path", F.posexplode("sections").alias("ord", "s")).select("path", "ord", "s.*")
    return dense_ids(flat.withColumn("k", order), ["k", "ord"], "chunk_id", after).select("chunk_id", "path", "ord", "breadcrumb", "line", "body")


def dense_ids(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """``df`` with row numbers from ``after`` + 1 on in ``name``, by ``order``, which must tell all rows apart."""
    part, within = "\x02part", "\x02within"
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(within, F.monotonically_increasing_id()))
    # the identifier is the partition's number, shifted, plus the row's number in it
    ranged = ranged.withColumn(part, F.shiftright(within, 33)).withColumn(within, F.col(within).bitwiseAND((1 << 33) - 1))
    size = ranged.groupBy(part).agg(F.count("*").alias("n"))
    base = size.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("base"))  # one row a partition
    return ranged.join(F.broadcast(base), part).withColumn(name, F.col("base") + F.col(within) + 1 + after).drop(part, within, "base")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change) of ``now`` (path, hash) against ``before`` (path, hash): added, updated, removed or unchanged."""
    n, b = now.select("path", F.col("hash").alias("new")).distinct(), before.select("path", F.col("hash").alias("old")).distinct()
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return n.join(b, "path", "full_outer").select("path", change.alias("change"))


def change_counts(changed: DataFrame) -> DataFrame:
    """(added, updated, removed): one row."""
    return changed.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "updated", "removed")])


# --- versions on disk ---


class NoIndex(FileNotFoundError):
    """There is no index at the place."""


def default_path(root: str) -> str:
    return os.path.join(root, ".notarium", "index")


#: Tables whose rows belong to a chunk: versions add to them, and dead chunks drop out on reading.
BY_CHUNK = ("chunks", "postings", "doc_len")
DEAD = "chunk_id bigint"
#: An index with more than one dead chunk for so many live ones is written anew.
DEAD_SHARE = 4


class _Files:
    """The few files that are no tables, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.fs_ = spark._jvm.org.apache.hadoop.fs
        self.io = spark._jvm.org.apache.commons.io.IOUtils
        self.gateway, self.conf = spark._sc._gateway, spark._jsc.hadoopConfiguration()
        self.place = place
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.fs_.Path(os.path.join(self.place, name) if name else self.place)

    def read(self, name: str) -> str | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Readers see the old text or the new one."""
        out = self.fs.create(self.path(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        how = self.gateway.new_array(getattr(self.gateway.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        how[0] = getattr(self.gateway.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        self.fs_.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(f"{name}.tmp"), self.path(name), how)

    def versions(self) -> list[int]:
        return [int(x.getPath().getName()[2:]) for x in self.fs.globStatus(self.path("v=*")) or []]

    def remove(self, version: int) -> None:
        self.fs.delete(self.path(f"v={version}"), True)


def _pointer(spark: SparkSession, place: str) -> dict:
    text = _Files(spark, place).read("CURRENT")
    if text is None:
        raise NoIndex(place)
    got = json.loads(text)
    return {"version": int(got["version"]), "parts": {k: [int(v) for v in vs] for k, vs in got["parts"].items()}}


def current(spark: SparkSession, place: str) -> int:
    """The version that counts. ``NoIndex`` where there is none; anything unreadable is an error of its own."""
    return _pointer(spark, place)["version"]


def load(spark: SparkSession, place: str) -> Index:
    parts = _pointer(spark, place)["parts"]
    read = lambda name, schema: spark.read.schema(schema).parquet(*[os.path.join(place, f"v={v}", name) for v in parts[name]])
    own = {name: read(name, schema) for name, schema in SCHEMAS.items()}
    if parts["dead"]:
        dead = read("dead", DEAD)
        own |= {name: own[name].join(dead, "chunk_id", "left_anti").select(*own[name].columns) for name in BY_CHUNK}
    return Index(**own)


def empty(spark: SparkSession) -> Index:
    return Index(*(spark.createDataFrame([], schema) for schema in SCHEMAS.values()))


def _written(df: DataFrame, place: str, version: int, name: str) -> None:
    if name == "postings":  # so that a query's terms prune row groups
        df = df.repartitionByRange("term").sortWithinPartitions("term", "chunk_id")
    df.write.mode("overwrite").parquet(os.path.join(place, f"v={version}", name))


def _publish(spark: SparkSession, place: str, version: int, parts: dict[str, list[int]]) -> int:
    """Makes a version the one that counts. Folders stay that it or the one before names, as readers may be using them."""
    own = _Files(spark, place)
    before = own.read("CURRENT")
    own.replace("CURRENT", json.dumps({"version": version, "parts": parts}))
    used = {version, *chain.from_iterable(parts.values()), *(chain.from_iterable(json.loads(before)["parts"].values()) if before else ())}
    for old in own.versions():
        if old not in used:
            own.remove(old)
    return version


def _next(spark: SparkSession, place: str) -> tuple[int, dict[str, list[int]] | None]:
    try:
        was = _pointer(spark, place)
    except NoIndex:
        return 1, None
    return was["version"] + 1, was["parts"]


def save(index: Index, place: str) -> int:
    """Writes all of ``index`` as the next version and makes it the one that counts; the version's number."""
    spark = index.notes.sparkSession
    version = _next(spark, place)[0]
    for name in SCHEMAS:
        _written(getattr(index, name), place, version, name)
    return _publish(spark, place, version, {**{name: [version] for name in SCHEMAS}, "dead": []})


def save_notes(notes: DataFrame, place: str) -> int:
    """The next version differs in its notes only, which keep their paths and hashes."""
    spark = notes.sparkSession
    version, parts = _next(spark, place)
    if parts is None:
        raise NoIndex(place)
    _written(notes, place, version, "notes")
    return _publish(spark, place, version, {**parts, "notes": [version]})


@dataclass(frozen=True)
class Refresh:
    added: int
    updated: int
    removed: int


@dataclass(frozen=True)
class Delta:
    """What a listing changes: all ``notes`` after it, the new ``chunks``, the ids of ``dead`` ones, and the change of each path."""

    notes: DataFrame
    chunks: DataFrame
    dead: DataFrame
    changed: DataFrame


def delta(before: Index, listing: DataFrame) -> Delta:
    """What ``listing`` (path, hash, mtime, text) changes in ``before``; new notes are parsed once.

    Unchanged notes keep their chunks and their stored mtime; updated ones keep
    their summaries and get new chunk ids after all others.
    """
    changed = cut(changes(listing, before.notes))
    fresh = listing.join(changed.where("change in ('added', 'updated')").select("path"), "path", "left_semi")
    gone = changed.where("change in ('updated', 'removed')").select("path")
    kept = before.notes.join(gone, "path", "left_anti")
    new = cut(notes_and_sections(fresh))
    told = before.notes.select("path", F.col("summary").alias("s"), F.col("sum_hash").alias("h"))
    new_notes = new.drop("sections").join(told, "path", "left").select("path", "hash", "mtime", "title", "meta", "headings", "lead", F.col("s").alias("summary"), F.col("h").alias("sum_hash"))
    last = before.chunks.agg(F.max("chunk_id")).first()[0] or 0
    dead = before.chunks.join(gone, "path", "left_semi").select("chunk_id")
    return Delta(kept.select(*new_notes.columns).unionByName(new_notes), numbered(new, last), dead, changed)


def refreshed(before: Index, listing: DataFrame) -> tuple[Index, DataFrame]:
    """(index, changes) of ``listing`` on top of ``before``, without a place to write to."""
    d = delta(before, listing)
    dead, posted_new = cut(d.dead), cut(postings(d.chunks))
    live = lambda df: df.join(dead, "chunk_id", "left_anti").select(*df.columns)
    chunks, posted = live(before.chunks).unionByName(d.chunks), live(before.postings).unionByName(posted_new)
    return Index(d.notes, chunks, posted, live(before.doc_len).unionByName(doc_lengths(posted_new)), corpus_stats(d.notes, chunks, posted)), d.changed


def refresh(spark: SparkSession, place: str, listing: Callable[[Index], DataFrame]) -> Refresh:
    """Brings the index at ``place`` to what ``listing`` gives for it, as a version that adds to the one before, or anew where there is none or too much is dead."""
    try:
        before, first = load(spark, place), False
    except NoIndex:
        before, first = empty(spark), True
    d = delta(before, listing(before))
    n = change_counts(d.changed).first()
    got = Refresh(n.added, n.updated, n.removed)
    if not first and got == Refresh(0, 0, 0):
        return got
    version, parts = _next(spark, place)
    parts = parts or {name: [] for name in (*SCHEMAS, "dead")}
    if parts["chunks"]:
        _written(d.dead, place, version, "dead")
        parts["dead"] = [*parts["dead"], version]
    at = lambda name, schema: spark.read.schema(schema).parquet(os.path.join(place, f"v={version}", name))
    _written(d.chunks, place, version, "chunks")
    _written(postings(at("chunks", CHUNKS)), place, version, "postings")
    _written(doc_lengths(at("postings", POSTINGS)), place, version, "doc_len")
    _written(d.notes, place, version, "notes")
    parts = {**parts, **{name: [*parts[name], version] for name in BY_CHUNK}, "notes": [version], "corpus_stats": [version]}
    whole = lambda name, schema: spark.read.schema(schema).parquet(*[os.path.join(place, f"v={v}", name) for v in parts[name]])
    chunks, posted = whole("chunks", CHUNKS), whole("postings", POSTINGS)
    n_dead = 0
    if parts["dead"]:
        dead = whole("dead", DEAD)
        n_dead = dead.count()
        chunks, posted = chunks.join(dead, "chunk_id", "left_anti"), posted.join(dead, "chunk_id", "left_anti")
    stats = cut(corpus_stats(at("notes", NOTES), chunks, posted))
    _written(stats, place, version, "corpus_stats")
    _publish(spark, place, version, parts)
    if n_dead * DEAD_SHARE > stats.first().n_chunks:
        save(load(spark, place), place)
    return got


def build(spark: SparkSession, root: str, place: str | None = None, opt: files.CrawlOptions | None = None, read: Callable[[str], bytes] = files.read_bytes) -> Refresh:
    """Builds or refreshes the index of the notes below ``root``. A file that can't be read leaves the index as it was."""
    given = opt or files.CrawlOptions()
    options = files.CrawlOptions(given.extensions, (*given.exclude, files.DIGEST_FILE))
    return refresh(spark, place or default_path(root), lambda _: cut(files.crawl(spark, root, options, read)))
