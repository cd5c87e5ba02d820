"""Notes on disk: walking a folder, the filters of the crawl, reading and hashing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notarium.functions.text import any_of, matches_glob

#: Folders that are never entered, beside hidden ones.
SKIPPED_FOLDERS = ("node_modules", "vendor", "build", "dist", "obj", "bin", "target")
EXTENSIONS = (".md", ".markdown")
DIGEST_FILE = "INDEX.md"


@dataclass(frozen=True)
class CrawlOptions:
    extensions: tuple[str, ...] = EXTENSIONS
    exclude: tuple[str, ...] = ()


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    """Whether the last extension, with its dot, is one of ``extensions``, whatever the case."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*[e.lower() for e in extensions])


def in_skipped_folder(path: Column) -> Column:
    """Whether a folder of the relative ``path`` is hidden or never entered."""
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d.startswith(".") | d.isin(*SKIPPED_FOLDERS))


def excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a pattern matches the file's name as a glob or is part of its path."""
    name = F.element_at(F.split(path, "/"), -1)
    return any_of([matches_glob(name, p) | path.contains(p) for p in patterns])


def wanted(path: Column, opt: CrawlOptions) -> Column:
    return has_extension(path, opt.extensions or EXTENSIONS) & ~in_skipped_folder(path) & ~excluded(path, opt.exclude)


def content_hash(content: Column) -> Column:
    """The first eight bytes of SHA-256, in hexadecimal."""
    return F.substring(F.sha2(content, 256), 1, 16)


def walk(root: str) -> list[str]:
    """Relative paths below ``root``, skipped folders left out. An unreadable folder or a missing root is an error.

    Spark's own listing hides files that start with ``_`` or ``.``, which are notes like any other.
    """

    def fail(e: OSError) -> None:
        raise e

    found = []
    for folder, dirs, files in os.walk(root, onerror=fail):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_FOLDERS)
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        found += [f if rel == "." else f"{rel}/{f}" for f in files]
    return sorted(found, key=lambda p: p.split("/"))


def read_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def _reader(root: str, read: Callable[[str], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                full = os.path.join(root, rel)
                data, at = read(full), datetime.fromtimestamp(int(os.stat(full).st_mtime), UTC)
                yield pa.RecordBatch.from_arrays([pa.array([rel]), pa.array([data], pa.binary()), pa.array([at], pa.timestamp("us", "UTC"))], names=["path", "content", "mtime"])

    return run


def crawl_stored(spark: SparkSession, root: str, opt: CrawlOptions) -> DataFrame:
    """``crawl`` of a folder in any file system that Spark reaches, listed and read by its executors; files starting with ``_`` or ``.`` stay hidden there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    either_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in opt.extensions or EXTENSIONS]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(either_case)}}}").load(root)
    rel = F.expr(f"substring(path, {len(base.rstrip('/')) + 2})")
    named = rows.select(rel.alias("path"), "content", F.date_trunc("second", "modificationTime").alias("mtime")).where(wanted(F.col("path"), opt))
    return named.select("path", content_hash(F.col("content")).alias("hash"), "mtime", F.col("content").cast("string").alias("text"))


def crawl(spark: SparkSession, root: str, opt: CrawlOptions | None = None, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """(path, hash, mtime, text) of the notes below ``root``, a folder that all executors see; read in parallel.

    Bytes that are no UTF-8 become replacement characters. A root with a scheme
    (``hdfs://``, ``s3a://``) is read by ``crawl_stored``.
    """
    opt = opt or CrawlOptions()
    if "://" in root:
        return crawl_stored(spark, root, opt)
    paths = spark.createDataFrame([(p,) for p in walk(root)], "path string").where(wanted(F.col("path"), opt))
    files = paths.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_reader(os.path.abspath(root), read), "path string, content binary, mtime timestamp")
    return files.select("path", content_hash(F.col("content")).alias("hash"), "mtime", F.col("content").cast("string").alias("text"))
