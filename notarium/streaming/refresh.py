"""Keeping an index up to date from a stream of crawled notes.

Each micro-batch is a set of sightings (path, content hash, mtime, text). Of a
path seen more than once in a batch the latest one counts; notes that weren't
seen stay. A batch that was applied before changes nothing, because its hashes
are those of the index, so a restarted stream may repeat one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from notarium.operators import index as ix
from notarium.runtime import cut

SIGHTINGS = "path string, hash string, mtime timestamp, text string, deleted boolean"


def latest(sightings: DataFrame) -> DataFrame:
    """One row a path, the latest by mtime, then by hash."""
    at = Window.partitionBy("path").orderBy(F.desc_nulls_last("mtime"), F.desc("hash"))
    return sightings.where("path is not null").withColumn("\x02n", F.row_number().over(at)).where("`\x02n` = 1").drop("\x02n")


def apply(spark: SparkSession, place: str, sightings: DataFrame) -> ix.Refresh:
    """Applies one batch to the index at ``place`` and publishes the next version, unless nothing changed."""
    batch = cut(latest(sightings))
    live = batch.where("not coalesce(deleted, false)").select("path", "hash", "mtime", "text")

    def listing(before: ix.Index) -> DataFrame:
        untouched = before.notes.join(batch.select("path"), "path", "left_anti").select("path", "hash", "mtime", F.lit(None).cast("string").alias("text"))
        return live.unionByName(untouched)

    return ix.refresh(spark, place, listing)


def follow(spark: SparkSession, source: str, place: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Applies every file of sightings (Parquet, ``SIGHTINGS``) that arrives in the folder ``source``."""
    stream = spark.readStream.schema(SIGHTINGS).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, _: apply(df.sparkSession, place, df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
