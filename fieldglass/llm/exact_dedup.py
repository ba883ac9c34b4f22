"""Exact de-duplication by an extendible-hash index on shared files (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, sized, stored, text_or_empty

#: Different keys that a bucket holds before it splits.
CAPACITY = 4096
#: Doublings of the directory beyond the depth that even keys need, counted at once; more follow while a bucket is overfull.
SLACK = 4
#: Deepest directory: 64-bit keys that share so many bits chain in one bucket.
DEEPEST = 60
#: A group is hot from this many rows, or from 1 / HOT_ROWS of all rows: so there are HOT_ROWS hot groups at most, which are broadcast.
HOT_SIZE, HOT_ROWS = 1000, 100_000


def cell(depth: int) -> Column:
    """The directory cell of a key h: its leading bits."""
    return F.shiftrightunsigned("h", 64 - depth)


def directory(keys: DataFrame, n_keys: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The extendible-hash directory of `keys` (a row for each hash h): (cell, bucket, local_depth), and the global depth.

    A cell is h's leading `depth` bits. Starting from one bucket, each overfull bucket splits by its next bit; splitting a
    bucket whose local depth equals the global one doubles the directory. All rounds of doubling come from one count by cell,
    rolled up by prefix: a bucket is a prefix that fits while its parent doesn't. If a cell is overfull itself, keys are
    counted again by longer prefixes. A bucket is named by its first cell.
    """
    depth = max(1, math.ceil(math.log2(max(1, n_keys) / capacity)) + SLACK) if n_keys > capacity else 1
    while True:
        cells = keys.groupBy(cell(depth).alias("cell")).agg(F.count("*").alias("n"))
        cells = stored(cells, "cells")
        if depth >= DEEPEST or (cells.agg(F.max("n")).head()[0] or 0) <= capacity:
            break
        depth = min(DEEPEST, depth + SLACK)
    prefixes = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - local_depth)"))
    counts = prefixes.groupBy("local_depth", "prefix").agg(F.sum("n").alias("n"))
    parents = counts.select((F.col("local_depth") + 1).alias("local_depth"), F.col("prefix").alias("parent"), F.col("n").alias("parent_n"))
    leaves = (
        counts.withColumn("parent", F.when(F.col("local_depth") > 0, F.expr("shiftrightunsigned(prefix, 1)")))
        .join(parents, ["local_depth", "parent"], "left")
        .where(((F.col("n") <= capacity) | (F.col("local_depth") == depth)) & ((F.col("local_depth") == 0) | (F.col("parent_n") > capacity)))
        .select("local_depth", "prefix")
    )
    found = prefixes.join(leaves, ["local_depth", "prefix"], "left_semi")
    return found.select("cell", F.expr(f"shiftleft(prefix, {depth} - local_depth)").alias("bucket"), "local_depth"), depth


def build_index(read: DataFrame, entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """(index, directory, global depth) of entries (id, h, sha) with their normalised texts `read` (id, norm, h).

    The index has a row for each different text: bucket, h, chain, sha, keep_id, group_size. Its files are the owners' ranges
    of buckets, each sorted; a bucket lies in one file. A key that one row has is inserted as it is. The texts of other keys
    are compared by their bytes: rows with one bucket, key and text are combined on the map side first, so that a group of any
    size sends one row a task to its owner; different texts of one key are numbered as its chain.
    """
    keys = stored(entries.groupBy("h").agg(F.count("*").alias("n")), "keys")
    dirs, depth = directory(keys, keys.count(), capacity)
    dirs = stored(dirs, "directory")
    bucket_of = lambda df: df.withColumn("cell", cell(depth)).join(sized(dirs.select("cell", "bucket")), "cell").drop("cell")
    more = sized(stored(keys.where("n > 1").select("h"), "repeated-keys"))
    single = bucket_of(entries.join(more, "h", "left_anti")).select("bucket", "h", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    same = bucket_of(read.join(more, "h", "left_semi")).groupBy("bucket", "h", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = single.unionByName(same.select("bucket", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    return stored(rows.repartitionByRange("bucket").withColumn("chain", chain).sortWithinPartitions("bucket", "h", "chain"), "index"), dirs, depth


def look_up(entries: DataFrame, index: DataFrame, dirs: DataFrame, depth: int) -> DataFrame:
    """Entries with keep_id and group_size from the index: the directory names the bucket, in which key and digest are looked up.

    Groups that are hot are a list of bounded length and are broadcast; the others are too small to skew the join by bucket.
    """
    total = entries.count()
    hot = F.col("group_size") >= max(HOT_SIZE, math.ceil(total / HOT_ROWS))
    found = index.select("bucket", "h", "sha", "keep_id", "group_size")
    asked = entries.withColumn("cell", cell(depth)).join(sized(dirs.select("cell", "bucket")), "cell").drop("cell")
    names = stored(found.where(hot), "hot-groups")
    by = ["bucket", "h", "sha"]
    return asked.join(F.broadcast(names), by).unionByName(asked.join(F.broadcast(names.select(*by)), by, "left_anti").join(found.where(~hot), by))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256, h.

    Texts are equal when their bytes are after lower-casing A-Z; the row with the largest id stays.
    1. A scan writes the entries (id, 64-bit key h, SHA-256) to the shared folder; texts stay where they are.
    2. Keys are counted; from the counts the directory doubles until no bucket is overfull, and is written.
    3. Owners of bucket ranges insert all keys, comparing the bytes of those that collide, and write the index files.
    4. Every entry looks its group up: directory, bucket, key, digest.

    Null texts count as empty; empty texts equal one another. A null id is smaller than any other (a group of null ids keeps
    all its rows, keep_id null). Rows that repeat an id and a text share one verdict. No rows give no rows. Other columns of
    `docs` are not read and may have any name.
    """
    text = ascii_lower(text_or_empty(text_col))
    read = docs.select(F.col(id_col).alias("id"), text.alias("norm")).withColumn("h", F.xxhash64("norm"))
    entries = stored(read.select("id", "h", F.sha2("norm", 256).alias("sha")), "entries")
    out = look_up(entries, *build_index(read, entries, capacity))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "h",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that exact_dedup() drops; rows that repeat an id and a text are left once."""
    verdict = stored(exact_dedup(docs, id_col, text_col), "verdict")
    gone = stored(verdict.where("not kept").select(F.col(id_col).alias("gone_id"), F.col("h").alias("gone_h")), "gone")
    again = stored(verdict.where("kept").groupBy(F.col(id_col).alias("again_id"), F.col("h").alias("again_h")).agg(F.count("*").alias("n")).where("n > 1").select("again_id", "again_h"), "again")
    h = F.xxhash64(ascii_lower(F.coalesce(docs[text_col], F.lit(""))))
    # columns are named by their frames: `docs` may have columns of any name
    left = docs.join(sized(gone), docs[id_col].eqNullSafe(gone["gone_id"]) & (h == gone["gone_h"]), "left_anti")
    if again.isEmpty():
        return left
    same = docs[id_col].eqNullSafe(again["again_id"]) & (h == again["again_h"])
    return left.join(sized(again), same, "left_anti").unionByName(left.join(sized(again), same, "left_semi").dropDuplicates([id_col]))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
