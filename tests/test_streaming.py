from datetime import UTC, datetime

from pyspark.sql import functions as F

from notarium.operators import index as ix
from notarium.sources.files import content_hash
from notarium.streaming import refresh


def sightings(spark, rows):
    df = spark.createDataFrame([(p, datetime(2026, 1, day, tzinfo=UTC), t, d) for p, day, t, d in rows], "path string, mtime timestamp, text string, deleted boolean")
    return df.withColumn("hash", content_hash(F.col("text"))).select("path", "hash", "mtime", "text", "deleted")


def test_batches_arrive(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "index")
    sightings(spark, [("a.md", 1, "# A\n\none", False), ("a.md", 2, "# A\n\ntwo", None), ("b.md", 1, "# B\n\nthree", False)]).write.parquet(source)
    refresh.follow(spark, source, place, str(tmp_path / "cp")).awaitTermination()
    got = ix.load(spark, place)
    assert {r.path: r.body for r in got.chunks.collect()} == {"a.md": "two", "b.md": "three"}
    again = sightings(spark, [("a.md", 2, "# A\n\ntwo", None)])
    assert refresh.apply(spark, place, again) == ix.Refresh(0, 0, 0) and ix.current(spark, place) == 1
    sightings(spark, [("b.md", 3, None, True), ("c.md", 3, "# C\n\nfour", False)]).write.mode("append").parquet(source)
    refresh.follow(spark, source, place, str(tmp_path / "cp")).awaitTermination()
    got = ix.load(spark, place)
    assert {r.path for r in got.notes.collect()} == {"a.md", "c.md"} and got.corpus_stats.first().n_chunks == 2
