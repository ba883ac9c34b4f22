"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, sized, stored, text_or_empty

WEIGHTS = (5, 2, 1)
#: Most copies of a document, and most times its size that a source gives.
MOST = 3
#: Documents that a leaf of the reduction tree rounds (and that the root gets of each class), and residuals that an inner node combines.
LEAF, FAN_IN = 128, 256
#: Words of mass that count as none: what sums of doubles lose.
NONE = 1e-6

_ITEM = "struct<key: bigint, id: bigint, size: bigint, n: bigint, base: bigint, p: double>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, n, source_size, target) of rows (source, size, n): `share` of all sizes dealt by weight, no source above `most` times its own size.

    Sources in order of code points, null last, get the weights in turn. Instead of round after round of resharing, sources
    are ordered by cap / weight: those below the water level stop at their cap, and the level follows from prefix sums. The
    table has one row per source, so its windows are as small as the list of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = (
        per.withColumn("all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left"))
        .withColumn("rank", F.row_number().over(level))
        .withColumn("first", F.min(F.when(F.col("open"), F.struct("rank", "left", "w_left"))).over(everything))
    )
    target = F.when(F.col("rank") >= F.col("first.rank"), F.col("first.left") * F.col("w") / F.col("first.w_left")).otherwise(F.col("cap"))
    return per.select("source", "n", "source_size", target.cast("double").alias("target"))


def _fold(seed: int) -> str:
    """SQL of the pivotal step over an array of items, in order: (cur, out), out being the items that became integral.

    cur and x hold masses p * size. Either t_up moves from x to cur or t_down from cur to x, with chances that keep each
    expectation; the sum of the masses stays exactly, and one of the two ends at 0 or 1.
    """
    done = "named_struct('key', {0}.key, 'id', {0}.id, 'size', {0}.size, 'n', {0}.n, 'base', {0}.base, 'p', {1})"
    u = f"(xxhash64(q.a.key, q.b.key, q.a.p, q.b.p, {seed}L) & 9007199254740991L) / 9007199254740992D"
    up = f"CASE WHEN q.t_up >= (1 - q.a.p) * q.a.size THEN {pair(done.format('q.a', '1D'), done.format('q.b', 'q.b.p - q.t_up / q.b.size'))} ELSE {pair(done.format('q.b', '0D'), done.format('q.a', 'q.a.p + q.t_up / q.a.size'))} END"
    down = f"CASE WHEN q.t_down >= q.a.p * q.a.size THEN {pair(done.format('q.a', '0D'), done.format('q.b', 'q.b.p + q.t_down / q.b.size'))} ELSE {pair(done.format('q.b', '1D'), done.format('q.a', 'q.a.p - q.t_down / q.a.size'))} END"
    step = f"CASE WHEN q.t_up + q.t_down <= 0 THEN {pair('q.a', 'q.b')} WHEN {u} * (q.t_up + q.t_down) < q.t_down THEN {up} ELSE {down} END"
    let = "named_struct('a', acc.cur, 'b', x, 't_up', least((1 - acc.cur.p) * acc.cur.size, x.p * x.size), 't_down', least(acc.cur.p * acc.cur.size, (1 - x.p) * x.size))"
    moved = f"element_at(transform(array({let}), q -> {step}), 1)"
    append = f"element_at(transform(array({moved}), m -> named_struct('cur', m.rest, 'out', concat(acc.out, array(m.done)))), 1)"
    return f"aggregate(slice(items, 2, greatest(size(items) - 1, 0)), named_struct('cur', items[0], 'out', cast(array() AS array<{_ITEM}>)), (acc, x) -> {append})"


def pair(done: str, rest: str) -> str:
    return f"named_struct('done', {done}, 'rest', {rest})"


def _root(seed: int) -> str:
    """SQL of the last pivotal step of a source over an array of items, largest first: the items with p 0 or 1.

    Each item is paired with the pool of all items after it, which takes or gives mass in proportion: either t_up moves from
    the pool to the item or t_down back, with chances that keep every expectation. So large documents are decided while much
    remains that can make up for them, and what is left in the end is a fraction of a small one. The pool's fractions all
    change by one line p -> scale * p + shift, so `mass` and `size` of the pool are all that is carried along. An item that
    stays fractional because its pool is empty or has become integral is drawn.
    """
    drawn = lambda salt: f"(xxhash64(x.key, x.id, {seed}L, {salt}L) & 9007199254740991L) / 9007199254740992D"
    let = lambda fields, name, body: f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"
    whole = "CASE WHEN q.p <= 1e-9 THEN 0D WHEN q.p >= 1 - 1e-9 THEN 1D WHEN " + drawn(2) + " < q.p THEN 1D ELSE 0D END"
    after = let("'p', e.p, 'scale', e.scale, 'shift', e.shift, 'mass', e.mass", "q", f"named_struct('scale', q.scale, 'shift', q.shift, 'mass', q.mass, 'size', acc.size - x.size, 'out', concat(acc.out, array({whole})))")
    up = "named_struct('p', r.p + r.t_up / x.size, 'scale', acc.scale * (1 - r.t_up / r.mass), 'shift', acc.shift * (1 - r.t_up / r.mass), 'mass', r.mass - r.t_up)"
    down = "named_struct('p', r.p - r.t_down / x.size, 'scale', acc.scale * (1 - r.t_down / r.room), 'shift', acc.shift * (1 - r.t_down / r.room) + r.t_down / r.room, 'mass', r.mass + r.t_down)"
    stay = "named_struct('p', r.p, 'scale', acc.scale, 'shift', acc.shift, 'mass', r.mass)"
    chosen = f"CASE WHEN r.t_up + r.t_down <= {NONE}D THEN {stay} WHEN {drawn(1)} * (r.t_up + r.t_down) < r.t_down THEN {up} ELSE {down} END"
    moved = f"element_at(transform(array({chosen}), e -> {after}), 1)"
    able = lambda t: f"CASE WHEN {t} <= {NONE}D THEN 0D ELSE {t} END"
    limits = let(f"'p', p.p, 'mass', p.mass, 'room', p.room, 't_up', {able('least((1 - p.p) * x.size, p.mass)')}, 't_down', {able('least(p.p * x.size, p.room)')}", "r", moved)
    pool = let("'p', g.p, 'mass', greatest(0D, acc.mass - g.p * x.size), 'room', greatest(0D, acc.size - x.size - greatest(0D, acc.mass - g.p * x.size))", "p", limits)
    step = let("'p', least(1D, greatest(0D, acc.scale * x.p + acc.shift))", "g", pool)
    start = "named_struct('scale', 1D, 'shift', 0D, 'mass', aggregate(items, 0D, (n, x) -> n + x.p * x.size), 'size', aggregate(items, 0L, (n, x) -> n + x.size), 'out', cast(array() AS array<double>))"
    decided = f"aggregate(items, {start}, (acc, x) -> {step}, acc -> acc.out)"
    return f"zip_with(items, {decided}, (x, v) -> named_struct('key', x.key, 'id', x.id, 'size', x.size, 'n', x.n, 'base', x.base, 'p', v))"


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, **to) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken, copies, key.

    A document's size is its number of words; its source's target / size is the expected number of copies, of which the whole
    part is given and the fraction rounded by the pivotal method: leaves of the tree round about LEAF documents of a source and
    size class (powers of two) each and hand one fractional document on, inner nodes do the same for FAN_IN residuals, and the
    root of a source combines its classes' residuals with one leaf of each class, largest first. So the words taken from a
    source end within a small document of its target, unless a few large ones are all it has. A leaf is chosen by a hash of
    the document, so hot sources spread over many leaves, and reruns agree whatever the partitioning.

    Null texts have size 0, take no words, and get the whole part of the copies; a null source is a source of its own, the last.
    Sources without words have target 0. Rows that repeat an id and a text are combined first and rounded as one; their copies
    are dealt evenly. No rows give no rows. Ids are read as long. Other columns are not read.
    """
    sizes = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    )
    sizes = stored(sizes.groupBy("id", "source", "size", "key").agg(F.count("*").alias("n")), "sizes")
    per = stored(targets(sizes, **to), "targets")
    aim = per.select(F.col("source").alias("of"), "source_size", "target")
    rate = F.coalesce(F.expr("try_divide(target, source_size)"), F.lit(0.0)) * F.col("n")
    rows = sizes.join(sized(aim), F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    fraction = (F.col("p") > 1e-12) & (F.col("size") > 0)
    part = rows.where(fraction).withColumn("class", F.floor(F.log2("size")).cast("int"))
    classes = stored(part.groupBy(F.col("source").alias("in_source"), F.col("class").alias("in_class")).agg(F.count("*").alias("in_n")), "classes")
    part = part.join(sized(classes), F.col("source").eqNullSafe(F.col("in_source")) & (F.col("class") == F.col("in_class")))
    item = F.struct("key", "id", "size", "n", "base", "p")
    leaves = stored(part.select("source", "class", F.pmod(F.xxhash64("key", F.lit(seed)), F.ceil(F.col("in_n") / LEAF)).alias("node"), item.alias("item")), "leaves")
    last = leaves.where("node = 0").select("source", "item")
    node, levels, width = leaves.where("node > 0"), [], math.ceil((classes.agg(F.max("in_n")).head()[0] or 0) / LEAF)
    while width > 1 or (levels and width == 1):
        folded = node.groupBy("source", "class", "node").agg(F.sort_array(F.collect_list("item")).alias("items")).select("source", "class", "node", F.expr(_fold(seed)).alias("f"))
        folded = stored(folded.select("source", "class", "node", "f.*"), f"level-{len(levels)}")
        levels.append(folded.select("source", F.explode("out").alias("item")).select("source", "item.*"))
        node = folded.select("source", "class", F.floor(F.col("node") / FAN_IN).alias("node"), F.col("cur").alias("item"))
        if width == 1:
            last = last.unionByName(node.select("source", "item"))
            break
        width = math.ceil(width / FAN_IN)
    largest = F.reverse(F.sort_array(F.collect_list(F.struct(F.col("item.size").alias("size"), F.col("item.key").alias("key"), F.col("item.id").alias("id"), F.col("item.n").alias("n"), F.col("item.base").alias("base"), F.col("item.p").alias("p")))))
    done = last.groupBy("source").agg(largest.alias("items")).select("source", F.explode(F.expr(_root(seed))).alias("item")).select("source", "item.*")
    for level in levels:
        done = done.unionByName(level)
    names = ["id", "size", "source_size", "target", "key", "n", "base", "p"]
    done = done.join(sized(aim), F.col("source").eqNullSafe(F.col("of"))).select(*names)
    found = rows.where(~fraction).withColumn("p", F.lit(0.0)).select(*names).unionByName(done).withColumn("all", (F.col("base") + F.round("p")).cast("long"))
    out = found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    copies = (F.floor(F.col("all") / F.col("n")) + (F.col("k") < F.col("all") % F.col("n")).cast("long")).cast("long")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "key")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **to) -> DataFrame:
    """`docs` with each row as often as mix() takes it. Rows that repeat an id and a text share the mean of their copies, rounded."""
    found = mix(docs, id_col, text_col, source_col, **to).groupBy(F.col(id_col).alias("mix_id"), F.col("key").alias("mix_key")).agg(F.round(F.avg("copies")).cast("int").alias("mix_copies"))
    found = stored(found.where("mix_copies > 0").select("mix_id", "mix_key", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies")))), "copies")
    same = docs[id_col].cast("long").eqNullSafe(found["mix_id"]) & (F.xxhash64(docs[id_col], docs[text_col]) == found["mix_key"])
    return docs.join(sized(found), same).select(*[docs[c] for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
