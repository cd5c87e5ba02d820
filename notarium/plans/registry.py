"""The queries of the core by name. Each reads its whole tables; ``reference_sql`` has what they must give."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions import dates
from notarium.functions import text as tx
from notarium.operators import digest, enrich, facets, search, timestamps
from notarium.operators import index as ix
from notarium.plans import reference_sql, tables
from notarium.runtime import table
from notarium.sources import files

#: What the search queries ask, and how they filter.
ASKED = {
    1: "page leak under heavy load",
    2: "DropBarrierChunk 0x7C1E22",
    3: "гипотеза о работе кэша",
    4: "retry policy, \"lock order\" replicated handshakes",
    5: "stHeaderTokenFSM buffer::ReleaseHeaderToken",
    6: "...",
}
FILTERS = search.Filters(meta={"status": "Done"}, path="NET/", since=datetime(2024, 6, 1, tzinfo=UTC))
SINCE = ("2025-02-28", "7d", "2w", "1m", "13m", "0d", "")
EXCLUDE = ("INDEX.md", "*-quorum-*", "gone/")
DIGEST = digest.DigestOptions(since=datetime(2024, 6, 1, tzinfo=UTC), max_headings=3)


def tok_raw(spark: SparkSession, root: str) -> DataFrame:
    return tables.chunks(spark, root).select(F.explode(tx.raw_tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").select(F.explode(tx.raw_tokens(F.col("body"))).alias("token")).distinct()


def tok_expand(spark: SparkSession, root: str) -> DataFrame:
    return _vocabulary(spark, root).select("token", F.explode(tx.expand_token(F.col("token"))).alias("term"))


def tok_stem(spark: SparkSession, root: str) -> DataFrame:
    w = _vocabulary(spark, root).select(tx.lower(F.col("token")).alias("word")).distinct()
    return w.select("word", tx.stem(F.col("word")).alias("stem"), tx.prefix_key(F.col("word")).alias("prefix_key"))


def ident_like(spark: SparkSession, root: str) -> DataFrame:
    w = table(spark, root, "chunks").select(F.explode(tx.fields(F.regexp_replace("body", "\\s", " "))).alias("piece")).distinct()
    return w.select("piece", tx.ident_like(F.col("piece")).alias("ident"), tx.is_hex(F.col("piece")).alias("hex"))


def index_postings(spark: SparkSession, root: str) -> DataFrame:
    return ix.postings(tables.chunks(spark, root))


def index_doc_len(spark: SparkSession, root: str) -> DataFrame:
    return ix.doc_lengths(tables.postings(spark, root))


def index_stats(spark: SparkSession, root: str) -> DataFrame:
    s = tables.stored(spark, root).corpus_stats
    return s.withColumn("avg_len", F.round("avg_len", 9))


def index_idf(spark: SparkSession, root: str) -> DataFrame:
    n = F.broadcast(table(spark, root, "chunks").agg(F.countDistinct("chunk_id").alias("n")))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return ix.document_frequency(tables.postings(spark, root)).join(n, F.lit(True)).select("term", "df", F.round(idf, 9).alias("idf"))


def search_bm25(spark: SparkSession, root: str) -> DataFrame:
    i = search.narrowed(tables.written(spark, root), ASKED)
    return search.ranked(search.bm25(i, ASKED, search.live_chunks(i)), 20).withColumn("score", F.round("score", 6))


def search_literal(spark: SparkSession, root: str) -> DataFrame:
    i = search.narrowed(tables.stored(spark, root), ASKED)
    return search.ranked(search.literal(i, ASKED, search.live_chunks(i)))


def search_titles(spark: SparkSession, root: str) -> DataFrame:
    """The first ten chunks for the title of every note whose id is divisible by 20."""
    i = tables.stored(spark, root)
    asked = tables.notes(spark, root).where("note_id % 20 = 0 and title is not null").select(F.col("note_id").alias("query_id"), F.col("title").alias("text"))
    return search.first_of(i, asked, search.live_chunks(i), 10).withColumn("score", F.round("score", 6))


def _flat(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "path", "line", "title", "breadcrumb", F.round("score", 9).alias("score"), "exact", "snippet", F.length("body").alias("n_chars"))


def search_fused(spark: SparkSession, root: str) -> DataFrame:
    return _flat(search.search_many(tables.written(spark, root), ASKED, k=10))


def search_filtered(spark: SparkSession, root: str) -> DataFrame:
    return _flat(search.search_many(tables.written(spark, root), ASKED, FILTERS, k=5))


def notes_filtered(spark: SparkSession, root: str) -> DataFrame:
    return tables.notes(spark, root).where(FILTERS.condition()).select("note_id", "path")


def note_date(spark: SparkSession, root: str) -> DataFrame:
    return tables.notes(spark, root).select("note_id", F.unix_micros(dates.note_date(F.col("meta"), F.col("mtime"))).alias("at_us"))


def parse_meta(spark: SparkSession, root: str) -> DataFrame:
    return tables.documents(spark, root).select("doc_id", F.explode("meta").alias("key", "v")).select("doc_id", "key", F.size("v").alias("n"), F.array_join("v", "|").alias("vals"))


def parse_title(spark: SparkSession, root: str) -> DataFrame:
    return tables.documents(spark, root).select("doc_id", "title", "lead")


def parse_outline(spark: SparkSession, root: str) -> DataFrame:
    return tables.documents(spark, root).select("doc_id", F.posexplode("headings").alias("pos", "heading"))


def parse_sections(spark: SparkSession, root: str) -> DataFrame:
    each = tables.documents(spark, root).select("doc_id", F.posexplode("sections").alias("ord", "s"))
    return each.select("doc_id", "ord", "s.breadcrumb", "s.line", F.length("s.body").alias("n_chars"), F.md5("s.body").alias("digest"))


def content_hash(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", files.content_hash(F.col("text")).alias("hash"))


def change_set(spark: SparkSession, root: str) -> DataFrame:
    """The notes against the files ever crawled: some aren't among them, some of them have no note any more."""
    return ix.changes(tables.notes(spark, root).select("path", "hash"), tables.sighted(spark, root))


def change_counts(spark: SparkSession, root: str) -> DataFrame:
    return ix.change_counts(change_set(spark, root))


def _refreshed(spark: SparkSession, root: str) -> ix.Index:
    """The given tables as the index of the files crawled, refreshed by the documents and by the sections' notes with a text of their own."""
    return ix.refreshed(_before(spark, root), _listing(spark, root))[0]


def _before(spark: SparkSession, root: str) -> ix.Index:
    i = tables.stored(spark, root)
    n = i.notes.select("path", "hash", "mtime", "title", "meta", "headings", "lead", "summary", "sum_hash")
    c = i.chunks.select("chunk_id", "path", "ord", "breadcrumb", "line", "body")
    return ix.Index(n, c, i.postings, i.doc_len, i.corpus_stats)


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, mtime, text): the documents; the notes that have sections, which are new texts of theirs; the notes crawled, as they are. Other notes are gone."""
    d = table(spark, root, "documents").where("path is not null").select("path", files.content_hash(F.coalesce("text", F.lit(""))).alias("hash"), "mtime", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["path"])
    n = tables.notes(spark, root).select("path", "hash", "mtime")
    s = table(spark, root, "sections").where("path is not null").groupBy("path").agg(F.min("section_id").alias("at"))
    new = n.join(s, "path").select("path", F.concat(F.lit("section "), F.col("at").cast("string")).alias("hash"), "mtime", F.concat(F.lit("# Rewritten\n\nsection "), F.col("at").cast("string"), F.lit("\n")).alias("text"))
    kept = n.join(s, "path", "left_anti").join(tables.sighted(spark, root).select("path"), "path", "left_semi").select("path", "hash", "mtime", F.lit(None).cast("string").alias("text"))
    return d.unionByName(new).unionByName(kept)


def refresh_notes(spark: SparkSession, root: str) -> DataFrame:
    return _refreshed(spark, root).notes.select("path", "hash", "title", "summary", "sum_hash")


def refresh_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks by note; the ids of new ones follow the largest one."""
    return _refreshed(spark, root).chunks.groupBy("path").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def refresh_counts(spark: SparkSession, root: str) -> DataFrame:
    return ix.change_counts(ix.changes(_listing(spark, root), _before(spark, root).notes))


def crawl_filter(spark: SparkSession, root: str) -> DataFrame:
    seen = table(spark, root, "crawl_log").select("path").distinct()
    return seen.where(files.wanted(F.col("path"), files.CrawlOptions(exclude=EXCLUDE)))


def facet_counts(spark: SparkSession, root: str) -> DataFrame:
    return facets.facets(tables.notes(spark, root), max_values=200)


def facet_fields(spark: SparkSession, root: str) -> DataFrame:
    return facets.facets(tables.notes(spark, root), ["Owner", "tz", "status"])


def digest_groups(spark: SparkSession, root: str) -> DataFrame:
    return digest.blocks(tables.notes(spark, root), digest.DigestOptions(group_by="status")).groupBy(F.col("group").alias("name")).agg(F.count("*").alias("n"), F.unix_micros(F.max("date")).alias("newest_us"))


def digest_blocks(spark: SparkSession, root: str) -> DataFrame:
    return digest.blocks(tables.notes(spark, root), DIGEST).select(F.col("group").alias("name"), F.unix_micros("date").alias("date_us"), "path", "block")


def digest_document(spark: SparkSession, root: str) -> DataFrame:
    return digest.document(tables.notes(spark, root), DIGEST)


def meta_lines(spark: SparkSession, root: str) -> DataFrame:
    return tables.notes(spark, root).select("note_id", digest.meta_line(["status", "tags", "owner"], F.col("meta")).alias("line"))


def stats_report(spark: SparkSession, root: str) -> DataFrame:
    return facets.report_lines(tables.stored(spark, root).corpus_stats, facets.facets(tables.notes(spark, root), max_values=200))


def since_dates(spark: SparkSession, root: str) -> DataFrame:
    """What a user may type, read on the last of March."""
    now = datetime(2026, 3, 31, 12, tzinfo=UTC)
    return spark.createDataFrame([(t, dates.parse_since(t, now)) for t in SINCE], "typed string, at timestamp").select("typed", F.unix_micros("at").alias("at_us"))


def summary_first(spark: SparkSession, root: str) -> DataFrame:
    """The first 25 pending ones by path."""
    return enrich.pending(tables.notes(spark, root), 25).select("note_id", "path")


def summary_pending(spark: SparkSession, root: str) -> DataFrame:
    return enrich.pending(tables.notes(spark, root)).select("note_id", "path")


def _measured(x: DataFrame) -> DataFrame:
    return x.select("path", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("digest"))


def summary_input(spark: SparkSession, root: str) -> DataFrame:
    return _measured(enrich.inputs(tables.notes(spark, root), tables.chunks(spark, root)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "search_fused": search_fused,
    "p4_found": timestamps.found,
} | {
    f.__name__: f
    for f in (
        tok_raw, tok_expand, tok_stem, ident_like, index_postings, index_doc_len, index_stats, index_idf, search_bm25, search_literal, search_filtered, search_titles,
        notes_filtered, note_date, parse_meta, parse_title, parse_outline, parse_sections, content_hash, change_set, change_counts, refresh_notes, refresh_chunks, refresh_counts, crawl_filter, facet_counts, facet_fields,
        digest_groups, digest_blocks, digest_document, meta_lines, stats_report, since_dates, summary_pending, summary_first, summary_input,
    )
}
SQL: dict[str, str] = reference_sql.queries()
