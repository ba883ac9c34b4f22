"""What the corpus operators share: text rules, work folders on shared storage, and joins that check sizes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
WS = "\\x20\\x09-\\x0D"
WORD = f"[^{WS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Most bytes of values that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

_made: list[tuple[SparkSession, str]] = []


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII texts take the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local session gets a temporary
    one; a cluster raises, because its executors don't share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="fieldglass-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    if not _made:
        atexit.register(remove_work)
    path = f"{shared_folder(spark)}/fieldglass/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove_work() -> None:
    """Removes what work_path() gave out; results that still read it become unreadable."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing can be removed through it
            continue


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder and reads it again, so a lost executor costs one task."""
    spark = df.sparkSession
    path = work_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(field: T.StructField) -> Column:
    """About how many bytes a value takes."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.AtomicType):
        return F.lit(8)
    return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the values of a stored table take `limit` bytes at most."""
    per_row = F.lit(16)
    for field in df.schema.fields:
        per_row = per_row + width(field)
    return (df.agg(F.sum(per_row.cast("long"))).head()[0] or 0) <= limit


def sized(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a stored table for broadcast if its values take `limit` bytes at most; else leaves the join to a shuffle."""
    return F.broadcast(df) if fits(df, limit) else df


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) from the columns' values alone: the same in every run and partitioning."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
