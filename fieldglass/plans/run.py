"""Plan boundaries: what is scored or drawn more than once is written once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def work_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, removed when the driver ends. Where that is unset a local session gets a temporary
    folder; a cluster raises, because its executors don't share the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(remove_work)
    path = f"{base.rstrip('/')}/fieldglass/plan-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove_work() -> None:
    """Removes what work_folder() gave out; results that still read it become unreadable."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing can be removed through it
            continue


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to a work folder and reads it again."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
