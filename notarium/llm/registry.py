"""Queries of the subpackage and their reference SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.llm import contamination, frequency, mixing, near_dup, pairs, reference_sql, split, truncated
from notarium.runtime import cut, table

BODY = near_dup.Similarity(kind="words", width=3, least=40, threshold=0.5)
TITLE = near_dup.Similarity(kind="chars", width=3, threshold=0.5)


def _similar(spark: SparkSession, root: str) -> list[near_dup.Field]:
    return [near_dup.Field("body", table(spark, root, "chunks"), "chunk_id", "body", BODY), near_dup.Field("title", table(spark, root, "notes"), "note_id", "title", TITLE)]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.record_pairs(near_dup.class_links(_similar(spark, root)))


def p1_groups(spark: SparkSession, root: str) -> DataFrame:
    return near_dup.groups(_similar(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pairs.defects(table(spark, root, "notes"))


def _items(spark: SparkSession, root: str) -> DataFrame:
    """Sections and chunks as items, repeated rows once."""
    s = table(spark, root, "sections").select(F.lit("section").alias("item"), F.col("section_id").alias("item_id"), "line", "body")
    c = table(spark, root, "chunks").select(F.lit("chunk").alias("item"), F.col("chunk_id").alias("item_id"), "line", "body")
    return s.unionByName(c)


def p3_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of the items over the limit."""
    return split.pieces(_items(spark, root)).where("n_pieces > 1").dropDuplicates(["item", "item_id", "piece"])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return split.pieces(_items(spark, root)).where("n_pieces > 1 and piece = 1").select("item", "item_id").distinct()


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    return frequency.term_marks(table(spark, root, "postings"), table(spark, root, "chunks"), table(spark, root, "notes"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_counts(spark, root).where("mark is not null")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return contamination.leaks(contamination.matches(table(spark, root, "documents"), table(spark, root, "eval_items")))


def p6_reparameterised(spark: SparkSession, root: str) -> DataFrame:
    return contamination.reparameterised(cut(contamination.matches(table(spark, root, "documents"), table(spark, root, "eval_items"))))


def p7_selected(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(table(spark, root, "documents"), table(spark, root, "mix_targets"))[0].select(F.col("id").alias("doc_id"), "source", "n_tokens", "n_uses")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(table(spark, root, "documents"), table(spark, root, "mix_targets"))[1]


def _shared(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text, sources): each different text once, with the sources of all ids that have it."""
    d = table(spark, root, "documents").where("text is not null").select("doc_id", "text", "source", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    own = d.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.collect_set("source").alias("sources"))  # at most all sources
    return d.select("doc_id", "text").join(own, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "sources")


def p7_overlapping(spark: SparkSession, root: str) -> DataFrame:
    """Texts that several sources have belong to all of these: the flow decides which of them a text is used for."""
    return mixing.mixed(_shared(spark, root), table(spark, root, "mix_targets"), sources=F.col("sources"))[0].select(F.col("id").alias("doc_id"), "source", "n_tokens", "n_uses")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return truncated.truncated(table(spark, root, "documents")).where("cut").select(F.col("id").alias("doc_id"))


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return truncated.rates(truncated.truncated(table(spark, root, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_groups, p2_found, p3_found, p3_pieces, p5_found, p5_counts, p6_found, p6_reparameterised, p7_selected, p7_shares, p7_overlapping, p8_found, p8_rates)
}
SQL: dict[str, str] = reference_sql.SQL
