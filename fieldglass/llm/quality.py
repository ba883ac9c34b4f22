"""Quality rules: counted statistics, then robust multivariate outliers by language and source (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, WS, fits, sized, stored, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The transformed statistics and the least spread that each is given: smaller spreads are normal variation of clean prose.
#: Those of x_lines (1 at most) and x_repeats (sqrt(0.5) at most) are small enough for each to reach CUTOFF by itself.
VECTOR = {"x_length": 0.08, "x_symbols": 0.05, "x_lines": 0.12, "x_repeats": 0.1}
#: Share of a group that the determinant is minimal over: junk may be up to half. Consistency factor: share / P(chi-square 6 <= its chi-square 4 quantile).
SUPPORT, CONSISTENCY = 0.5, 2.109
#: Rows nearer than the 0.975 quantile of chi-square (4 degrees) enter the final estimates, with the factor for that share.
NEAR, NEAR_CONSISTENCY = 11.143, 1.0645
#: Squared distance beyond which a document is an outlier: chi-square with 4 degrees of freedom at 0.99999.
CUTOFF = 28.473
#: Rows that a language and source need for estimates of their own; smaller ones share their language's, then one of all.
LEAST = 50
#: Rows of the narrow table of vectors in a partition: it is scanned some dozens of times, so it isn't left in as many pieces as the texts.
PART_ROWS = 100_000
#: Concentration ends once a step lowers no group's least log determinant so far by more than SETTLED. Distances are cut at bins, so
#: a determinant may swing after that; the least one counts.
SETTLED, MOST_STEPS = 1e-3, 30


def counts(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{WS}]"))
    return {
        "words": words,
        "word_chars": (F.length(text) - F.length(F.regexp_replace(text, f"[^{WS}]+", ""))).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeat_words() -> Column:
    """Words in 3-word windows that the array `words` has twice; h has a hash for each window.

    Without equal hashes the answer is 0. Else hash and place, packed into one number, are sorted, and neighbours with one hash
    are compared word by word. If all of them are equal, they are the repeated windows; if two differ (different windows with
    one hash), the windows themselves are sorted. Places that overlap count once.
    """
    bits = "greatest(1, cast(ceil(log2(size(h) + 1)) AS int))"
    neighbours = "zip_with(s, slice(s, 2, size(s)), (a, c) -> named_struct('a', a, 'c', c))"
    place = "cast(z.{0} & (shiftleft(1L, b) - 1) AS int)"
    found = f"""
      transform(array({bits}), b ->
        transform(array(sort_array(transform(h, (x, i) -> shiftleft(shiftright(x, b), b) | cast(i AS bigint)))), s ->
          transform(filter({neighbours}, z -> shiftright(z.a, b) = shiftright(z.c, b)), z -> named_struct('a', {place.format("a")}, 'c', {place.format("c")}))
        )[0])[0]"""
    differ = "exists(found, z -> NOT (words[z.a] = words[z.c] AND words[z.a + 1] = words[z.c + 1] AND words[z.a + 2] = words[z.c + 2]))"
    places = "sort_array(array_distinct(flatten(transform({0}, z -> array(z.a, z.c)))))"
    window = "named_struct('x', words[i], 'y', words[i + 1], 'z', words[i + 2], 'i', i)"
    sorted_ = f"transform(array(sort_array(transform(h, (x, i) -> {window}))), s -> transform(filter({neighbours}, z -> z.a.x = z.c.x AND z.a.y = z.c.y AND z.a.z = z.c.z), z -> named_struct('a', z.a.i, 'c', z.c.i)))[0]"
    chosen = f"transform(array({found}), found -> CASE WHEN {differ} THEN {places.format(sorted_)} ELSE {places.format('found')} END)[0]"
    covered = f"transform(array({chosen}), p -> aggregate(zip_with(p, slice(p, 2, size(p)), (a, c) -> named_struct('a', a, 'c', c)), 0L, (n, z) -> n + least(3, coalesce(z.c - z.a, 3))))[0]"
    return F.expr(f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {covered} END")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = text_or_empty(text_col)
    read = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("key"), *[c.alias(k) for k, c in counts(text).items()])
    read = read.withColumn("n_words", F.size("words").cast("long")).withColumn("h", F.expr("transform(array(words), w -> transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))[0]"))
    read = read.withColumn("n_repeat_words", repeat_words())
    n = F.greatest("n_words", F.lit(1))
    return read.select(
        *("id", "lang", "source", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.log(F.greatest("word_chars", F.lit(1)) / n).alias("x_length"),
        F.sqrt(F.col("n_symbols") / n).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeats"),
    )


def _estimates(rows: DataFrame, by: list[str], consistency: float) -> DataFrame:
    """Mean, Cholesky factor of the covariance and its log determinant, for the rows of each group; the least spreads stand on
    the diagonal as a ridge.

    Means and products of deviations come from Spark's one-pass moments, which combine on the map side.
    """
    names = list(VECTOR)
    cells = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    got = rows.groupBy(*by).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i, j in cells])
    ridge = [x**2 for x in VECTOR.values()]
    got = got.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * consistency + F.lit(ridge[i] if i == j else 0.0) for i, j in cells})
    # Cholesky factor, column by column
    for j in range(len(names)):
        rest = {i: F.col(f"c{i}{j}") for i in range(j, len(names))}
        for k in range(j):
            rest = {i: r - F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for i, r in rest.items()}
        got = got.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest.pop(j), F.lit(1e-9))))
        got = got.withColumns({f"l{i}{j}": r / F.col(f"l{j}{j}") for i, r in rest.items()}) if rest else got
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(names))), 2 * F.log("l00"))
    return got.select(*by, det.alias("det"), *[f"m{i}" for i in range(len(names))], *[f"l{i}{j}" for i, j in cells])


def _with_distance(rows: DataFrame, estimates: DataFrame, hint: Callable[[DataFrame], DataFrame] = sized) -> DataFrame:
    """Squared Mahalanobis distance d2 by forward substitution; a row for each start s, if the estimates have starts."""
    names = list(VECTOR)
    out = rows.join(hint(estimates), "g", "left")
    for i, x in enumerate(names):
        z = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(names))), F.col("z0") * F.col("z0"))).select(*rows.columns, *[c for c in ["s"] if c in estimates.columns], "d2")


def _nearest(rows: DataFrame, hint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The SUPPORT share of the rows (with d2) of each group and start that lie nearest, cut at a bin of 1/32 of a doubling.

    Only counts by bin leave the scan, a bounded table for each group and start. The cuts are stored and sized, unless it is
    known how they are to be joined.
    """
    rows = rows.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) * 32))
    cut = rows.groupBy("g", "s").agg(F.percentile("bin", SUPPORT).alias("cut"))
    cut = hint(cut) if hint else sized(stored(cut, "cut"))
    return rows.join(cut, ["g", "s"]).where(F.col("bin") <= F.col("cut"))


def grouped(rows: DataFrame) -> DataFrame:
    """Adds g: language and source, or what a group below LEAST rows shares."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    rows = rows.withColumn("g2", F.concat_ws("\t", name("lang"), name("source"))).withColumn("g1", name("lang"))
    two = stored(rows.groupBy("g2", "g1").agg(F.count("*").alias("n2")), "groups")
    one = two.where(F.col("n2") < LEAST).groupBy("g1").agg(F.sum("n2").alias("n1"))
    g = F.when(F.col("n2") >= LEAST, F.col("g2")).when(F.col("n1") >= LEAST, F.col("g1")).otherwise(F.lit("all"))
    names = stored(two.join(one, "g1", "left").select("g2", g.alias("g")), "group-names")
    return rows.join(sized(names), "g2").drop("g1", "g2")


def outliers(rows: DataFrame) -> DataFrame:
    """Squared robust distances d2 of rows with the VECTOR columns, by minimum-covariance-determinant estimates of each group g.

    Starts s: distances from medians in units of the median absolute deviation, the same in units of the least spreads, and the
    lowest values of each statistic that junk raises. Concentration steps run on all starts at once until they settle: estimate
    mean and covariance from the nearest SUPPORT share, which doesn't raise the determinant, and measure all rows again. The
    start with the least determinant gives a group's raw estimates; rows NEAR them give the final ones. Each step scans a
    narrow stored table; what it shuffles is counts by bin and moments by group. A step is one write, which carries the least
    estimates so far along, and one maximum: the driver holds threads, plans and code of every query.
    """
    names = list(VECTOR)
    half = lambda cols, p: [(F.percentile(F.floor(c * 256), 0.5) / 256 + 0.5 / 256).alias(f"{p}{i}") for i, c in enumerate(cols)]
    middle = stored(rows.groupBy("g").agg(*half([F.col(x) for x in names], "med")), "medians")
    centred = rows.join(sized(middle), "g")
    away = [F.abs(F.col(x) - F.col(f"med{i}")) for i, x in enumerate(names)]
    spread = stored(centred.groupBy("g").agg(*half(away, "mad")), "spreads")
    total = lambda parts: sum(parts[1:], parts[0])
    starts = [
        total([F.pow(away[i] / F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(VECTOR[x])), 2) for i, x in enumerate(names)]),
        total([F.pow(away[i] / VECTOR[x], 2) for i, x in enumerate(names)]),
        *[F.pow(F.col(x) / VECTOR[x], 2) for x in names[1:]],
    ]
    first = centred.join(sized(spread), "g").select("g", *names, F.posexplode(F.array(*starts)).alias("s", "d2"))
    narrow = rows.select("g", *names)
    got = _estimates(_nearest(first), ["g", "s"], CONSISTENCY)
    fields = [c for c in got.columns if c not in ("g", "s", "det")]
    state = stored(got.select(*got.columns, F.struct("det", *fields).alias("e"), F.lit(None).cast("double").alias("fallen")), "estimates-0")
    # every step's estimates and cuts have the groups and starts of the first: how they are joined is decided once
    hint = F.broadcast if fits(state) else lambda df: df
    for step in range(1, MOST_STEPS + 1):
        now = state.select("g", "s", "det", *fields)
        got = _estimates(_nearest(_with_distance(narrow, now, hint), hint), ["g", "s"], CONSISTENCY)
        before = state.select("g", "s", F.col("e").alias("was"))
        e = F.least("was", F.when(F.col("det").isNotNull(), F.struct("det", *fields)))
        state = stored(before.join(hint(got), ["g", "s"], "left").select(*got.columns, e.alias("e"), (F.col("was.det") - e["det"]).alias("fallen")), f"estimates-{step}")
        fallen = state.agg(F.max("fallen")).head()[0]
        if fallen is None or fallen <= SETTLED:
            break
    best = state.groupBy("g").agg(F.min("e").alias("e")).select("g", "e.*")
    near = _with_distance(narrow, stored(best, "estimates-raw")).where(F.col("d2") <= NEAR)
    return _with_distance(rows, stored(_estimates(near, ["g"], NEAR_CONSISTENCY), "estimates"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, counted statistics, base_failed, kept, d2 (null if base_failed), key.

    Statistics are counted over whole texts (null: empty). Rows that fail the base rules (too few words, too many repeated
    windows) go; the rest are measured against robust estimates of their language and source, and kept up to CUTOFF. A null
    language or source is a group of its own; groups below LEAST rows share estimates. Equal rows get equal verdicts. A text
    without words has zeros and fails. No rows give no rows. Other columns are not read.
    """
    stats = stored(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    counted = ["id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = grouped(stats.where("not base_failed")).select("g", *VECTOR, *counted)
    good = stored(good.coalesce(max(1, math.ceil(stats.count() / PART_ROWS))), "vectors")
    verdict = outliers(good).select(*counted, "d2", F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)).alias("kept"))
    failed = stats.where("base_failed").select(*counted, F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return verdict.unionByName(failed).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`docs` without the rows that quality() rejects, columns as they are.

    Rejected rows are looked up by id and the text's hash, so rows that repeat an id and a text go or stay together; a null id or
    text is a value like any other. Empty texts go. No rows give no rows. Other columns may have any name.
    """
    gone = quality(docs, id_col, text_col, lang_col, source_col).where("not kept").select(F.col(id_col).alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    gone = stored(gone, "rejected")
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_key"])
    return docs.join(sized(gone), same, "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
