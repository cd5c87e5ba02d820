"""Texts cut off at a field limit or in mid-transfer, and how often each source cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notarium.llm.endings import judged


def truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``endings.judged`` over the documents: one row a document with a text, ``cut`` telling whether it was cut off.

    Documents without id or text are left out, repeated ids count once, any
    other columns are ignored; empty texts aren't cut.
    """
    x = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    return judged(x.where("id is not null and text is not null"))


def rates(found: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) of the result of ``truncated``; the null source is a source of its own."""
    return found.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("cut").cast("int")).cast("bigint").alias("n_cut"), F.round(F.avg(F.col("cut").cast("int")), 9).alias("rate"))
