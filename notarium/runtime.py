"""Session helpers shared by every operator: reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("notarium")
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """Names a checkpoint folder only where the cluster has named none and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or _own_folder())


@cache
def _own_folder() -> str:
    at = tempfile.mkdtemp(prefix="notarium-checkpoints-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


#: Spark's switch that removes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation.

    What its shuffles left on the executors' disks is removed then, as nothing reads it again.
    """
    spark = df.sparkSession
    checkpoint_ready(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(df: DataFrame) -> None:
    """Removes what ``cut`` has written of ``df``, which nothing may read any more."""
    jvm, at = df.sparkSession._jvm, df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if at.isDefined():
        path = jvm.org.apache.hadoop.fs.Path(at.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that it needn't be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="notarium-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "notarium_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
