"""What a session needs before Python functions of this package can run in it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_geoloom_core", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="geoloom-"), "geoloom_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("geoloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._geoloom_core = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor share: the session's ``spark.checkpoint.dir``.

    Only a local master, as in tests, may do without; a temporary folder takes its place there.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that the whole cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="geoloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster shares."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; computed once, unlike a checkpoint."""
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Tasks for work that costs much more than its bytes tell, as that of Python functions."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, n: int = 0) -> DataFrame:
    """The rows dealt to many tasks, to n if those are more: a small file is one task's, however much work its rows are."""
    return df.repartition(max(n, tasks(df.sparkSession)))
