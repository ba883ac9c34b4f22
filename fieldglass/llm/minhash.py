"""MinHash near-de-duplication by min-max hashing: both ends of each permutation are kept and banded, links are confirmed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sized, stored
from .shingles import give_back, mix, sets

SIMILAR_PERCENT = 80
#: 100 permutations give 200 values: 40 bands of 5. Two texts at the threshold share no band with a chance of (1 - 0.8^5)^40,
#: about 1 in 8 million; more similar ones far less.
PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: 64-bit words of the bitmap that a set is hashed into for bounds.
BITMAP = 32
#: Shingles whose permutations are computed at a time.
BLOCK = 2048
#: Rounds in which each bucket that spans components compares all its members with one more pivot, before all that is left.
PIVOTS = 3
#: Members of a bucket, or of a part of one, that are paired in one place; fuller buckets are split.
CELL = 2048
#: Pairs of members whose bitmaps are compared at a time.
PAIRED = 1 << 14

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype="u4")[:, None] | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype="u4")[:, None]
_SALTS = _draw.integers(0, 1 << 63, BANDS, dtype="u8")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of a set under each permutation: mins of all, then maxes of all."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, "u4")
    high = np.zeros(PERMUTATIONS, "u4")
    narrow = (shingles >> np.uint64(32)).astype("u4")
    for at in range(0, len(narrow), BLOCK):
        values = _FACTORS * narrow[at : at + BLOCK] + _SHIFTS
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.concatenate((low, high))


def bands(signatures: np.ndarray) -> np.ndarray:
    """A key per band of each signature; a band's values come from different permutations, minima and maxima apart."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype("u8")
    keys = np.broadcast_to(_SALTS, parts.shape[:2])
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view("i8") if keys.flags.c_contiguous else np.ascontiguousarray(keys).view("i8")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, c1, c2, bands) for rows (id, text): set size, 128 bits that name the set, band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, signs = [], [], []
            for s in sets(batch.column("text"), k):
                n.append(len(s))
                names.append((np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else 0, np.add.reduce(mix(s ^ np.uint64(0xA0761D6478BD642F))) if len(s) else 0))
                signs.append(signature(s))
            if not n:
                continue
            keys = bands(np.array(signs))
            size = np.where(np.array(n) > 0, BANDS, 0)
            offsets = np.concatenate(([0], np.cumsum(size))).astype("i4")
            c = np.array(names, "u8").view("i8")
            flat = keys[np.array(n) > 0].ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(n, "i8")), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "n", "c1", "c2", "bands"]
            )
        give_back()

    return docs.mapInArrow(run, "id bigint, n bigint, c1 bigint, c2 bigint, bands array<bigint>")


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle. Two bitmaps differ in no more bits than the sets in elements."""
    out = np.zeros(64 * BITMAP, bool)
    out[(shingles % np.uint64(64 * BITMAP)).astype("i8")] = True
    return np.packbits(out).view("i8")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, set, bits) for rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "set", "bits"]
        for batch in batches:
            got = list(sets(batch.column("text"), k))
            for at in range(0, len(got), 1000):
                part = got[at : at + 1000]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in part]))).astype("i4")
                bits = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([bitmap(s) for s in part])), BITMAP).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(part).view("i8"))), bits], names=names)
        give_back()

    return docs.mapInArrow(run, "id bigint, set array<bigint>, bits array<bigint>")


def in_cells(members: DataFrame, percent: int, most: int = CELL) -> DataFrame:
    """Adds own (the part of its bucket that a member is in) and cell to members (key, rep, n, ...): two members of a bucket that
    are similar enough in size have one cell in common, and a cell has about two parts, 2 * most members, at most.

    Parts are size classes, wide enough that linked sets are in one class or in neighbouring ones, each dealt by hash into
    parts of about `most`. A cell is a pair of parts. A bucket of up to `most` members is one part and one cell.
    """
    step = math.log(100 / percent) * 1.01
    members = members.withColumn("class", F.floor(F.log("n") / step))
    per = stored(members.groupBy("key", "class").agg(F.count("*").alias("m")), "classes-of-buckets")
    near = lambda by, name: per.select("key", (F.col("class") + by).alias("class"), F.ceil(F.col("m") / most).alias(name))
    whole = per.groupBy("key").agg(F.sum("m").alias("all")).where(F.col("all") > most).select("key")
    split = per.join(whole, "key", "left_semi").select("key", "class", F.ceil(F.col("m") / most).alias("parts")).join(near(-1, "above"), ["key", "class"], "left").join(near(1, "below"), ["key", "class"], "left")
    placed = members.join(sized(stored(split, "split-buckets")), ["key", "class"], "left")
    up_to = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c) - 1)).otherwise(F.array().cast("array<bigint>"))
    part, kind = F.pmod(F.xxhash64("rep"), F.col("parts")), F.col("class")
    cell = lambda a, i, b, j: F.struct(a.alias("a"), i.alias("i"), b.alias("b"), j.alias("j"))
    cells = F.concat(
        F.transform(up_to("parts"), lambda j: cell(kind, F.least(part, j), kind, F.greatest(part, j))),
        F.transform(up_to("above"), lambda j: cell(kind, part, kind + 1, j)),
        F.transform(up_to("below"), lambda j: cell(kind - 1, j, kind, part)),
    )
    zero = F.lit(0).cast("long")
    one = F.col("parts").isNull()
    placed = placed.withColumn("own", F.when(~one, F.struct(kind.alias("a"), part.alias("i"))))
    return placed.withColumn("cell", F.explode(F.when(one, F.array(cell(zero, zero, zero, zero))).otherwise(cells))).drop("class", "parts", "above", "below")


def met_in_cells(rows: dict[str, np.ndarray], bits: np.ndarray, keys: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (smaller rep, larger rep) of rows of one cell, cells being runs of rows, that pass the conditions of rest_of_pairs()."""
    n = len(rows["rep"])
    cell = np.stack([rows[c] for c in ("key", "ca", "ci", "cb", "cj")])
    ends = np.append(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1, n)
    partners = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n) - 1
    total = np.cumsum(partners)
    same_part = (rows["ca"] == rows["cb"]) & (rows["ci"] == rows["cj"])  # whole buckets, too
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRED, "right")))
        own = partners[at:to]
        x = np.repeat(np.arange(at, to), own)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own)
        size = [rows["n"][i] for i in (x, y)]
        ok = (rows["label"][x] != rows["label"][y]) & (rows["rep"][x] != rows["rep"][y]) & (100 * np.minimum(*size) >= percent * np.maximum(*size))
        ok &= same_part[x] | (rows["oa"][x] != rows["oa"][y]) | (rows["oi"][x] != rows["oi"][y])
        x, y = x[ok], y[ok]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype="i8")
        ok = (100 + percent) * differ <= (100 - percent) * (rows["n"][x] + rows["n"][y])
        x, y = x[ok], y[ok]
        first = ~((keys[x] == keys[y]) & (np.arange(keys.shape[1]) < rows["place"][x][:, None])).any(1)
        a, b = rows["rep"][x[first]], rows["rep"][y[first]]
        yield np.minimum(a, b), np.maximum(a, b)
        at = to


def rest_of_pairs(members: DataFrame, info: DataFrame, percent: int, most: int = CELL) -> DataFrame:
    """All pairs of a bucket's members (key, place, rep, n, label) with different labels that could be similar enough.

    Sets that share `percent` of their union differ in at most (100 - percent) / (100 + percent) of their sizes' sum, and
    bitmaps in no more bits: pairs over the bound can't be links. A pair comes from the first of its common buckets. Fuller
    buckets are paired cell by cell. info: bits and bands of each rep.

    Cells are runs of sorted rows; their pairs are made and ruled out on arrays, PAIRED at a time.
    """
    names = ["key", "ca", "ci", "cb", "cj", "oa", "oi", "place", "rep", "n", "label"]
    none = F.lit(0).cast("long")
    fat = in_cells(members, percent, most).join(info, "rep").select(
        "key", *[F.col(f"cell.{x}").alias(f"c{x}") for x in "aibj"], *[F.coalesce(F.col(f"own.{x}"), none).alias(f"o{x}") for x in "ai"], F.col("place").cast("long").alias("place"), "rep", "n", "label", "bits", "bands"
    )
    fat = fat.repartition("key", "ca", "ci", "cb", "cj").sortWithinPartitions("key", "ca", "ci", "cb", "cj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            flat = lambda c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]).to_numpy()
            rows = {c: table.column(c).to_numpy() for c in names}
            for a, b in met_in_cells(rows, flat("bits").view("u8").reshape(-1, BITMAP), flat("bands").reshape(-1, BANDS), percent):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(c)[-1] for c in names[:5]]
            cell = np.stack([held.column(c).to_numpy() == x.as_py() for c, x in zip(names[:5], last, strict=True)]).all(0)
            whole = int(np.argmax(cell))  # rows before the last cell, which may go on in the next batch
            if whole:
                yield from pairs(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from pairs(held)
        give_back()

    return fat.mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the links (a, b), by alternating large-star and small-star steps.

    Stars replace links until nothing changes, in about log(n) rounds; a round reads and writes a table of links. Minima combine
    on the map side, so a node with many links costs one row a task.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts are linked if their sets of k-word shingles (A-Z lower-cased) share `percent` of their union.
    1. One pass over the texts writes set sizes, names and band keys. Rows with one set are a class, and one row stands for it.
    2. In each bucket, members whose sizes allow a link are paired with the bucket's smallest, not with one another.
    3. Full sets confirm pairs; components follow. Buckets that still span components take more pivots, PIVOTS times. Then
       every pair of members from different components is taken that wasn't compared and that exact bounds on sizes and
       bitmaps don't rule out. So pairs grow in proportion to a group's size, and no link between components is left out.

    A text without words, or null, has an empty set and no links. Null ids have no links; their component_id is null. Rows that
    share an id are one node. No rows give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = stored(sketches(rows, k), "sketches")
    named = sketch.where("n > 0 AND id IS NOT NULL")
    classes = stored(named.groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("rows"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("rep", "n", F.posexplode("bands").alias("place", "key"))
    full_buckets = stored(placed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "buckets")
    members = stored(placed.join(sized(full_buckets), "key"), "members")
    asked = members.select("rep").distinct()
    full = stored(full_sets(rows.join(sized(stored(asked, "candidates")), rows["id"] == F.col("rep"), "left_semi"), k), "sets")

    labels = None
    compared: DataFrame | None = None
    for turn in range(PIVOTS + 1):
        now = members.withColumn("label", F.col("rep")) if labels is None else members.join(sized(labels), F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        if turn:
            open_keys = now.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("key")
            now = stored(now.join(sized(stored(open_keys, "open")), "key", "left_semi"), "open-members")
            if now.isEmpty():
                break
        if turn < PIVOTS:
            order = F.xxhash64("rep", F.lit(turn)) if turn else F.col("rep")
            pivot = now.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "n", "label")).alias("p")).select("key", F.col("p.rep").alias("p_rep"), F.col("p.n").alias("p_n"), F.col("p.label").alias("p_label"))
            met = now.join(sized(stored(pivot, "pivots")), "key")
            pairs = met.where((F.col("label") != F.col("p_label")) & (100 * F.least("n", "p_n") >= percent * F.greatest("n", "p_n"))).select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()
        else:
            info = full.select(F.col("id").alias("rep"), "bits").join(classes.select("rep", "bands"), "rep")
            pairs = rest_of_pairs(now, info.join(now.select("rep").distinct(), "rep", "left_semi"), percent)
        pairs = stored(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        compared = pairs if compared is None else stored(compared.unionByName(pairs), "compared")
        links = confirmed(pairs, full, percent)
        if labels is None:
            labels = components(links)
        else:
            at = lambda df, c: df.join(sized(labels), F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("label", c)).drop("node", "label")  # noqa: B023, E731
            more = components(at(at(links, "a"), "b")).select(F.col("node").alias("old"), F.col("label").alias("new"))
            moved = labels.join(more, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
            fresh = more.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("label"))
            labels = stored(moved.unionByName(fresh), "labels")
    known = classes.select("c1", "c2", "rep", "rows")
    if labels is None:
        known = known.where("rows > 1").select("c1", "c2", F.col("rep").alias("component"))
    else:
        known = known.join(labels, F.col("rep") == F.col("node"), "left").where("rows > 1 OR label IS NOT NULL").select("c1", "c2", F.coalesce("label", "rep").alias("component"))
    known = stored(known, "components")
    out = sketch.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("c1")).alias("c1"), "c2").join(sized(known), ["c1", "c2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = SIMILAR_PERCENT) -> DataFrame:
    """`docs` without the rows that near_dedup() drops: the document with the smallest id of each group stays, columns as they are.

    Rows without an id, and texts that are null or without words, stay. Rows that share an id go or stay together. No rows give
    no rows. Other columns may have any name.
    """
    gone = near_dedup(docs, id_col, text_col, k, percent).where("not kept").select(F.col(id_col).alias("gone_id")).distinct()
    gone = stored(gone, "gone")
    return docs.join(sized(gone), docs[id_col].cast("long") == gone["gone_id"], "left_anti")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON node = doc_id
"""
