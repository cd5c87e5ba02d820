import glob
import os
import time

import pytest

from notarium import runtime


def test_a_step_leaves_no_shuffle_files(spark):
    at = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    files = lambda: set(glob.glob(f"{at}/blockmgr-*/**/shuffle_*.data", recursive=True))
    was, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    got = runtime.cut(spark.range(1000).groupBy("id").count().repartition(3))
    deadline = time.time() + 20
    while files() - was and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - was and got.count() == 1000 and spark.conf.get(key, None) == before


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.checkpoint_ready(Session())
