"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own if all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="turnweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/turnweave/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


#: Spark's setting by which the shuffle files of a query go at its end; else they stay until the driver's JVM collects its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str, release: bool = False, **options: object) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.  The files go when the driver ends, or by ``discard`` before.

    With ``release``, the write's own shuffle files go as soon as it ends.  ``options`` are the Parquet writer's.
    """
    path, conf = scratch(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(RELEASE, None)
    if release:
        conf.set(RELEASE, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if release:
            conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
