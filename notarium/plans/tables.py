"""The given tables as an index: repeated rows once, stale postings left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions.markdown import parsed
from notarium.operators import index as ix
from notarium.runtime import cut, table


def notes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "notes").dropDuplicates(["note_id"])


def chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").dropDuplicates(["chunk_id"])


def postings(spark: SparkSession, root: str) -> DataFrame:
    """(term, chunk_id, tf) of chunks that exist. Both sides meet by chunk, where repeated rows meet too."""
    own = table(spark, root, "chunks").select("chunk_id").distinct()
    return table(spark, root, "postings").select("term", "chunk_id", "tf").join(own, "chunk_id", "left_semi").select("term", "chunk_id", "tf").dropDuplicates(["chunk_id", "term", "tf"])


def stored(spark: SparkSession, root: str) -> ix.Index:
    """For one reading of the postings."""
    n, c, p = notes(spark, root), chunks(spark, root), postings(spark, root)
    return ix.Index(n, c, p, ix.doc_lengths(p), ix.corpus_stats(n, c, p))


def written(spark: SparkSession, root: str) -> ix.Index:
    """For several: the postings are written out first, as in a saved index. Of the totals only those that are read are worked out."""
    n, c, p = notes(spark, root), chunks(spark, root), cut(postings(spark, root))
    return ix.Index(n, c, p, ix.doc_lengths(p), ix.corpus_stats(n, c, p))


def sighted(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of every file ever crawled: that of the note's last summary, its own where there is none, ``gone`` without a note."""
    n = notes(spark, root).select("path", "hash", "sum_hash")
    seen = table(spark, root, "crawl_log").where("path is not null").select("path").distinct()
    return seen.join(n, "path", "left").select("path", F.coalesce("sum_hash", "hash", F.lit("gone")).alias("hash"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents taken apart: doc_id, path, title, meta, headings, lead, sections."""
    return parsed(table(spark, root, "documents").select("doc_id", "path", "text"), keep=("doc_id",))

