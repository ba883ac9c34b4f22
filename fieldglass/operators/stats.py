"""Aggregates of record scores by group, bootstrap intervals and paired tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import draw, four

RESAMPLES, LEVEL, SIGNIFICANCE, LEAST_PAIRS = 10_000, 0.95, 0.05, 10
# What two runs are compared by, if nothing else is asked for.
COMPARED = ["field_f1", "required_f1", "exact_match_rate", "hallucination_rate", "mean_correction_gain", "schema_valid"]
#: Values of a group that a resample draws from a broadcast array; a larger group's draws are rows of a join.
ARRAY_VALUES = 1_000_000
LEVELS = {"overall": [], "domain": ["domain"], "difficulty": ["difficulty"], "domain_x_difficulty": ["domain", "difficulty"], "task": ["task"]}


def long_form(rows: DataFrame, metrics: list[str], keep: list[str]) -> DataFrame:
    """(keep..., metric, value): one row per record and metric, without nulls."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    return rows.select(*keep, pairs).select(*keep, "m.metric", "m.value").where("value IS NOT NULL")


def summarize(rows: DataFrame, metrics: list[str], groups: tuple[str, str] = ("domain", "difficulty")) -> DataFrame:
    """(level, group columns, metric, n, mean, median, p10, p90, std) overall, by each group column, and by both, in one pass.

    Percentiles interpolate and are exact; a group of one has no deviation. No rows give no rows.
    """
    a, b = groups
    out = long_form(rows, metrics, [a, b]).groupingSets([["metric"], ["metric", a], ["metric", b], ["metric", a, b]], "metric", a, b)
    got = out.agg(
        F.grouping_id("metric", a, b).alias("_g"), F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"),
        F.round(F.percentile("value", F.lit(0.1)), 4).alias("p10"), F.round(F.percentile("value", F.lit(0.9)), 4).alias("p90"), F.round(F.stddev_samp("value"), 4).alias("std"),
    )
    level = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, a).when(F.col("_g") == 2, b).otherwise(f"{a}_x_{b}")
    return got.select(level.alias("level"), a, b, "metric", "n", "mean", "median", "p10", "p90", "std")


def group_key(levels: list[str]) -> Column:
    """The name of a record's group: the parts of each level, joined; a missing value is `unknown`."""
    if unknown := [x for x in levels if x not in LEVELS]:
        raise ValueError(f"unknown levels {', '.join(unknown)}; there are {', '.join(LEVELS)}")
    part = lambda level: F.concat_ws("__", *[F.coalesce(F.col(c), F.lit("unknown")) for c in LEVELS[level]]) if LEVELS[level] else F.lit(level)
    return F.concat_ws(" | ", *[part(x) for x in levels])


def summarize_by(rows: DataFrame, metrics: list[str], levels: list[str]) -> DataFrame:
    """(group, metric, n, mean, median, p10, p90, std) by group_key(levels), such as by task."""
    out = long_form(rows.withColumn("group", group_key(levels)), metrics, ["group"]).groupBy("group", "metric")
    return out.agg(
        F.count("value").alias("n"), four(F.avg("value")).alias("mean"), four(F.median("value")).alias("median"), four(F.percentile("value", F.lit(0.1))).alias("p10"),
        four(F.percentile("value", F.lit(0.9))).alias("p90"), four(F.stddev_samp("value")).alias("std"),
    )


def mode_counts(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return rows.select(*(groups or []), F.explode("failure_modes").alias("mode")).groupBy(*(groups or []), "mode").count()


def bootstrap(rows: DataFrame, value: str, by: list[str], id_col: str = "id", resamples: int = RESAMPLES, level: float = LEVEL, seed: int = 42, most: int = ARRAY_VALUES) -> DataFrame:
    """(by..., mean, lower, upper, n): percentile interval of the mean from resamples drawn by hash.

    Resample r takes, for each of its n draws, the value whose rank in the order of ids a hash of (seed, r, draw) names.
    Groups of up to `most` values are arrays that are broadcast; tasks hold some resamples each and draw from the array, so
    nothing but a mean a resample is shuffled. The draws of larger groups are rows of a join by rank, summed on the map side.
    No values give no row; one value is its own interval.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    known = rows.where(F.col(value).isNotNull()).select(*by, F.col(id_col).alias("_id"), F.col(value).cast("double").alias("_v"))
    total = known.groupBy(*by).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))
    counts = total.select(*by, F.col("n").alias("_n"))
    few, many = counts.where(F.col("_n") <= most), counts.where(F.col("_n") > most)
    small = known.alias("k").join(F.broadcast(few.alias("c")), [F.col(f"k.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by] or [F.lit(True)]).select(*[F.col(f"k.{c}") for c in by], "_id", "_v", "_n")
    arrays = small.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_id", "_v"))), lambda x: x["_v"]).alias("_values"), F.first("_n").alias("_n"))
    arrays = arrays.withColumn("_one", F.lit(1))
    turns = rows.sparkSession.range(resamples).select(F.col("id").cast("int").alias("_r"), F.lit(1).alias("_one")).repartition(F.col("_r"))
    picked = turns.join(F.broadcast(arrays), "_one").select(*by, "_r", "_n", "_values", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_draw"))
    means = picked.groupBy("_r", *by).agg(F.avg(F.get("_values", draw(seed, F.col("_r"), F.col("_draw"), F.col("_n")))).alias("_mean"))
    if not many.isEmpty():
        large = known.alias("k").join(F.broadcast(many.alias("c")), [F.col(f"k.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by] or [F.lit(True)]).select(*[F.col(f"k.{c}") for c in by], "_id", "_v", "_n")
        large = large.withColumn("_rank", F.row_number().over(w.orderBy("_id")) - 1)
        draws = large.select(*by, "_n", F.col("_rank").alias("_draw")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
        draws = draws.withColumn("_rank", draw(seed, F.col("_r"), F.col("_draw"), F.col("_n"))).drop("_n")
        means = means.unionByName(draws.join(large.select(*by, "_rank", "_v"), [*by, "_rank"]).groupBy("_r", *by).agg(F.avg("_v").alias("_mean")))
    low, high = math.floor((1 - level) / 2 * resamples), math.ceil((1 + level) / 2 * resamples) - 1
    ordered = means.groupBy(*by).agg(F.sort_array(F.collect_list("_mean")).alias("_m"))
    out = total.alias("t").join(F.broadcast(ordered).alias("o"), [F.col(f"t.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by] or [F.lit(True)])
    return out.select(*[F.col(f"t.{c}") for c in by], four(F.col("mean")).alias("mean"), four(F.get("_m", F.lit(low))).alias("lower"), four(F.get("_m", F.lit(high))).alias("upper"), "n")


def overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Whether closed intervals meet; an unknown bound counts as meeting."""
    return F.coalesce((low_a <= high_b) & (low_b <= high_a), F.lit(True))


@F.pandas_udf(T.DoubleType())
def two_tailed(z: pd.Series) -> pd.Series:
    """Chance of a normal deviate beyond |z|."""
    return pd.Series([None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


def last_of(rows: DataFrame, metrics: list[str], id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """One row per id: the last by `order_col`; without one the greatest by its metrics, so that reruns agree."""
    kept = F.struct(*[F.col(m).cast("double").alias(m) for m in metrics])
    found = F.max_by(kept, F.col(order_col)) if order_col else F.max(kept)
    return rows.groupBy(id_col).agg(found.alias("_m")).select(id_col, "_m.*")


def paired(a: DataFrame, b: DataFrame, metrics: list[str], id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """(id, metric, a, b) of records that both runs have; of records with one id the last counts."""
    x, y = (long_form(last_of(r, metrics, id_col, order_col), metrics, [id_col]).withColumnRenamed("value", n) for r, n in ((a, "a"), (b, "b")))
    return x.join(y, [id_col, "metric"])


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, w, z, p, significant, effect) of the signed-rank test on columns a and b.

    Equal pairs are dropped; equal differences share their mean rank; without any difference p is 1; below LEAST_PAIRS there is
    no test. Ranks come from counts of each size of difference, so no task holds a group's pairs.
    """
    d = pairs.withColumn("_d", F.round(F.col("a") - F.col("b"), 10))
    sizes = d.where("_d <> 0").groupBy(*by, F.abs("_d").alias("_size")).agg(F.count("*").alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"))
    order = Window.partitionBy(*by).orderBy("_size")
    sizes = sizes.withColumn("_before", F.sum("_c").over(order) - F.col("_c")).withColumn("_rank", F.col("_before") + (F.col("_c") + 1) / 2)
    sums = sizes.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_rank") * F.col("_up")).alias("_plus"), F.sum(F.col("_rank") * (F.col("_c") - F.col("_up"))).alias("_minus"))
    out = pairs.select(*by).distinct().join(sums, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= LEAST_PAIRS
    w = F.least("_plus", "_minus")
    n = F.col("n").cast("double")  # products of whole numbers overflow from 1.7 million differences
    z = F.when(enough, (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24))
    out = out.withColumn("w", F.when(n > 0, w)).withColumn("z", z)
    p = F.when(n == 0, 1.0).otherwise(two_tailed(F.col("z")))
    out = out.withColumn("p", p)
    return out.select(*by, "n", "w", four(F.col("z")).alias("z"), four(F.col("p")).alias("p"), F.coalesce(F.col("p") < SIGNIFICANCE, F.lit(False)).alias("significant"), four(F.abs(F.col("z")) / F.sqrt(n)).alias("effect"))


def compare(a: DataFrame, b: DataFrame, metrics: list[str] | None = None, resamples: int = RESAMPLES, lower_is_better: tuple[str, ...] = (), order_col: str | None = None) -> DataFrame:
    """One row per metric: both intervals, mean difference, overlap, the signed-rank test and the winner.

    The winner has the higher mean (the lower one for metrics named in `lower_is_better`) if the test is significant and the
    intervals don't meet; meeting intervals are a tie, the rest is inconclusive.
    """
    both = paired(a, b, metrics or COMPARED, order_col=order_col)
    ci = {n: bootstrap(both.withColumnRenamed(n, "v"), "v", ["metric"], resamples=resamples).select("metric", F.struct("mean", "lower", "upper", "n").alias(f"ci_{n}")) for n in "ab"}
    out = ci["a"].join(ci["b"], "metric").join(wilcoxon(both, ["metric"]).select("metric", F.struct("n", "w", "z", "p", "significant", "effect").alias("wilcoxon")), "metric")
    meets = overlap(F.col("ci_a.lower"), F.col("ci_a.upper"), F.col("ci_b.lower"), F.col("ci_b.upper"))
    better = F.col("ci_a.mean") > F.col("ci_b.mean")
    better = F.when(F.col("metric").isin(*lower_is_better), ~better).otherwise(better) if lower_is_better else better
    winner = F.when(meets, "tie").when(F.col("wilcoxon.significant"), F.when(better, "a").otherwise("b")).otherwise("inconclusive")
    return out.select("metric", "ci_a", "ci_b", F.round(F.col("ci_a.mean") - F.col("ci_b.mean"), 4).alias("mean_diff"), meets.alias("ci_overlaps"), "wilcoxon", winner.alias("winner"))
