"""Queries that apply the operators to the star-schema tables, each with SQL that states its result where SQL can."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfix, normalize, similarity
from ..operators import domains, generate, noise, predict, score, serialize, stats
from ..sources import records
from . import generate_sql, noise_sql
from .noise_sql import u
from .run import cut, work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers as receipts: id, domain, difficulty (by key), and four fields as text. The join shuffles on the
    customer key or broadcasts customers, as their size decides."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    out = o.join(c, o.o_custkey == c.c_custkey)
    difficulty = F.element_at(F.array(*[F.lit(d) for d in domains.DIFFICULTIES]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return out.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("key"), F.lit("receipts").alias("domain"), difficulty.alias("difficulty"), F.col("c_name").alias("vendor_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").alias("total"))


#: The same in DuckDB.
ORDERS = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS key, ['easy', 'medium', 'hard', 'extreme'][CAST(o_orderkey % 4 + 1 AS INT)] AS difficulty,
  c_name AS vendor_name, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderdate AS day, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey)"""


def money(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN format('{{:,.0f}}', {c}) ELSE format('{{:,.2f}}', {c}) END"


def form(rows: DataFrame) -> DataFrame:
    """Adds raw_text: four labelled lines."""
    total = serialize.number(F.col("total"))
    return rows.withColumn("raw_text", F.concat(F.lit("Vendor: "), "vendor_name", F.lit("\nDate: "), F.date_format(F.col("date").cast("date"), "dd/MM/yyyy"), F.lit("\nTotal: "), total, F.lit("\nCurrency: INR")))


def four(x: str) -> str:
    """SQL of functions.text.four: decimals, so that halves go up as in Spark."""
    return f"CAST(round(round(CAST({x} AS DECIMAL(28, 12)), 9), 4) AS DOUBLE)"


FORM = ORDERS + f""", f AS (SELECT *, 'Vendor: ' || vendor_name || chr(10) || 'Date: ' || strftime(day, '%d/%m/%Y') || chr(10) || 'Total: ' || {money("total")} || chr(10) || 'Currency: INR' AS raw_text FROM o)"""


# Sources, filters, sampling, splits.


def _task_sql() -> str:
    out = []
    for d, shares in domains.TASKS.items():
        at, cases = 0.0, []
        for name, w in list(shares.items())[:-1]:
            at += w
            cases.append(f"WHEN x < {at!r} THEN '{name}'")
        out.append(f"WHEN difficulty = '{d}' THEN CASE {' '.join(cases)} ELSE '{list(shares)[-1]}' END")
    return "CASE " + " ".join(out) + " END"


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, with task, split and noise tags."""
    rows = form(orders_gt(spark, sf_dir)).withColumn("ocr_text", F.col("raw_text")).withColumn("track", F.lit("synthetic")).withColumn("source_type", F.lit("synthetic"))
    tags = F.array_compact(F.array(F.when(F.col("key") % 2 == 0, F.lit("char_O0")), F.when(F.col("key") % 3 == 0, F.lit("value_swap"))))
    rows = rows.withColumn("task", generate.task(F.col("difficulty"), F.col("id"), "task")).withColumn("noise_tags", tags).withColumn("noise_valid", F.lit(True))
    return generate.split(rows, ["domain", "difficulty"], F.col("id"))


#: The same in DuckDB: s, from f.
SAMPLES = f"""n AS (SELECT *, 'receipts' AS domain, {u('id', chr(39) + 'task' + chr(39))} AS x, count(*) OVER (PARTITION BY difficulty) AS n, row_number() OVER (PARTITION BY difficulty ORDER BY md5(id), id) AS r FROM f),
s AS (SELECT *, {_task_sql()} AS task, CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.8) THEN 'dev' ELSE 'test' END AS split FROM n)"""


def stored_samples(spark: SparkSession, sf_dir: str) -> str:
    """The path of a data folder with these samples."""
    path = work_folder(spark)
    records.write_samples(order_samples(spark, sf_dir).select("id", "domain", "difficulty", "track", "source_type", "split", "task", "raw_text", "ocr_text", "noise_tags", "noise_valid"), path)
    return path


@query(f"WITH {FORM}, {SAMPLES} SELECT id, task, raw_text FROM s WHERE difficulty = 'hard' AND split = 'dev'")
def src_filter(spark, sf_dir):
    return records.read_samples(spark, stored_samples(spark, sf_dir), domain="receipts", difficulty="hard", split="dev").select("id", "task", "raw_text")


@query(f"WITH {FORM}, {SAMPLES} SELECT id, difficulty, split FROM s WHERE task = 'correction'")
def flt_task(spark, sf_dir):
    return records.read_samples(spark, stored_samples(spark, sf_dir), task="correction").select("id", "difficulty", "split")


@query(f"WITH {FORM}, {SAMPLES} SELECT id, difficulty FROM s WHERE key % 6 = 0 AND split = 'train'")
def flt_all_tags(spark, sf_dir):
    return records.read_samples(spark, stored_samples(spark, sf_dir), split="train", noise_tags=["char_O0", "value_swap"]).select("id", "difficulty")


@query(f"WITH {FORM}, {SAMPLES} SELECT id, difficulty, split, task FROM s WHERE difficulty = 'easy'")
def src_discover(spark, sf_dir):
    """Samples of the optical track as JSON-lines files by name, found by name."""
    path = work_folder(spark)
    rows = order_samples(spark, sf_dir).select("id", "domain", "difficulty", "split", "task")
    for difficulty in ("easy", "hard"):
        for split in domains.SPLITS:
            rows.where((F.col("difficulty") == difficulty) & (F.col("split") == split)).write.json(f"{path}/vision/receipts/receipts_{difficulty}_{split}.jsonl")
    found = records.discover(spark, path, difficulty="easy", track="real_ocr")
    return records.read_lines(spark, found).select("id", "difficulty", "split", "task")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def prd_resume_antijoin(spark, sf_dir):
    todo = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return predict.pending(todo, table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))


@query("SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), o_orderkey LIMIT 100")
def src_sample_n(spark, sf_dir):
    return records.sample_n(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), 100)


@query(f"""WITH {ORDERS}, n AS (SELECT difficulty, count(*) OVER (PARTITION BY difficulty) AS n, row_number() OVER (PARTITION BY difficulty ORDER BY md5(id), id) AS r FROM o)
SELECT difficulty, count(*) FILTER (r <= floor(n * 0.6)) AS train, count(*) FILTER (r > floor(n * 0.6) AND r <= floor(n * 0.8)) AS dev, count(*) FILTER (r > floor(n * 0.8)) AS test, count(*) AS total, 'receipts' AS domain FROM n GROUP BY difficulty""")
def gen_manifest(spark, sf_dir):
    return generate.manifest(generate.split(orders_gt(spark, sf_dir), ["domain", "difficulty"], F.col("id")))


@query(f"WITH {ORDERS}, x AS (SELECT id, difficulty, {u('id', chr(39) + 'task' + chr(39))} AS x FROM o) SELECT id, difficulty, {_task_sql()} AS task FROM x")
def gen_task(spark, sf_dir):
    return orders_gt(spark, sf_dir).select("id", "difficulty", generate.task(F.col("difficulty"), F.col("id"), "task").alias("task"))


# Serialization.


def _label_sql(path: str) -> str:
    labels = next(f.labels for f in domains.fields("receipts") if f.path == path)
    items = ", ".join(f"'{x}'" for x in labels)
    at = u("id", f"'{path}'", "'label'")
    return f"([{items}])[CAST(floor({at} * {len(labels)}) AS INT) + 1]"


def _sep_sql(path: str) -> str:
    at = u("id", f"'{path}'", "'sep'")
    return f"CASE WHEN {at} * 100 < 70 THEN ': ' WHEN {at} * 100 < 90 THEN ':' ELSE ' : ' END"


def _date_sql() -> str:
    at = u("id", "'date'", "'date'")
    return f"([strftime(day, '%d/%m/%Y'), strftime(day, '%d-%m-%Y'), strftime(day, '%d %b %Y'), strftime(day, '%Y-%m-%d')])[CAST(floor({at} * 4) AS INT) + 1]"


def _serialize_sql() -> str:
    values = {"vendor_name": "vendor_name", "date": _date_sql(), "total_amount": money("total"), "currency": "'INR'"}
    rows = [f"SELECT id, {u('id', repr(p), repr('order'))} AS o, {_label_sql(p)} || {_sep_sql(p)} || {v} AS t FROM o" for p, v in values.items()]
    return f"WITH {ORDERS}, r AS ({' UNION ALL '.join(rows)}) SELECT id, string_agg(t, chr(10) ORDER BY o) AS raw_text FROM r GROUP BY id"


def receipt_map(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gt", F.create_map(F.lit("vendor_name"), F.col("vendor_name"), F.lit("date"), F.col("date"), F.lit("total_amount"), F.col("total").cast("string"), F.lit("currency"), F.lit("INR")))


@query(_serialize_sql())
def ser_orders(spark, sf_dir):
    return receipt_map(orders_gt(spark, sf_dir)).select("id", serialize.serialize(F.col("gt"), "receipts", F.col("id")).alias("raw_text"))


# Noise.


def _confuse_sql(tag: str) -> str:
    here, there = noise.CONFUSED[tag]
    low, high = domains.NOISE_RATES[tag]
    rate = f"({low} + {u('id', repr(tag), repr('rate'))} * ({high} - {low}))"
    char = u("id", repr(tag), "CAST(i AS VARCHAR)")
    return f"""WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || p_brand || ' SOB lIB ' || CAST(p_partkey AS VARCHAR) AS text FROM part), r AS (SELECT *, {rate} AS rate FROM t),
c AS (SELECT id, rate, i, substr(text, i + 1, 1) AS c FROM r, unnest(range(length(text))) AS x(i))
SELECT id, string_agg(CASE WHEN contains('{here}', c) AND {char} < rate THEN translate(c, '{here}', '{there}') ELSE c END, '' ORDER BY i) AS text FROM c GROUP BY id"""


def _confuse(tag: str) -> None:
    def run(spark, sf_dir):
        text = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" SOB lIB "), F.col("p_partkey").cast("string"))
        rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), text.alias("text"))
        return rows.select("id", noise.apply(tag, F.col("text"), F.col("id")).alias("text"))

    run.__name__ = f"noise_{tag}"
    query(_confuse_sql(tag))(run)


for _tag in noise.CONFUSED:
    _confuse(_tag)


def _noised(tag: str, sql: str | None) -> None:
    def run(spark, sf_dir):
        rows = form(orders_gt(spark, sf_dir))
        return rows.select("id", noise.apply(tag, F.col("raw_text"), F.col("id")).alias("text"))

    run.__name__ = f"noise_{tag}"
    query(sql)(run)


_LINES = FORM + ", l AS (SELECT id, i - 1 AS i, string_split(raw_text, chr(10))[i] AS line FROM f, unnest(range(1, 5)) AS x(i))"
_noised("missing_colon", f"WITH {_LINES} SELECT id, string_agg(CASE WHEN {u('id', repr('missing_colon'), 'CAST(i AS VARCHAR)')} < 0.3 + {u('id', repr('missing_colon'), repr('rate'))} * 0.2 THEN replace(line, ': ', ' ') ELSE line END, chr(10) ORDER BY i) AS text FROM l GROUP BY id")
_noised("num_comma_drop", f"WITH {FORM} SELECT id, regexp_replace(raw_text, '([0-9]),([0-9])', '\\1\\2', 'g') AS text FROM f")
_EXTRA = ", ".join(f"('{x}', {i})" for i, x in enumerate(domains.EXTRA_LINES["receipts"]))
_noised("extraneous_field", f"""WITH {FORM}, e AS (SELECT id, raw_text, x, row_number() OVER (PARTITION BY id ORDER BY {u('id', repr('extraneous_field'), 'CAST(i AS VARCHAR)')}, x) AS r,
  1 + floor({u('id', repr('extraneous_field'), repr('n'))} * 2) AS n FROM f, (VALUES {_EXTRA}) AS v(x, i))
SELECT id, any_value(raw_text) || chr(10) || string_agg(x, chr(10) ORDER BY r) AS text FROM e WHERE r <= n GROUP BY id""")
_noised("value_truncated", f"""WITH {_LINES}, v AS (SELECT *, split_part(line, ': ', 2) AS v FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS r, count(*) OVER (PARTITION BY id) AS n FROM v WHERE length(v) > 5),
p AS (SELECT id, i, CAST(floor(length(v) * 0.5) AS INT) AS low, CAST(floor(length(v) * 0.8) AS INT) AS high FROM k WHERE r = 1 + floor({u('id', repr('value_truncated'))} * n))
SELECT v.id, string_agg(CASE WHEN p.i IS NULL THEN line ELSE split_part(line, ':', 1) || ': ' || left(v, CAST(low + floor({u('v.id', repr('value_truncated'), repr('cut'))} * (high - low + 1)) AS INT)) END, chr(10) ORDER BY v.i) AS text
FROM v LEFT JOIN p ON v.id = p.id AND v.i = p.i GROUP BY v.id""")
_noised("ambiguous_key", f"""WITH {_LINES} SELECT id, string_agg(CASE WHEN i = floor({u('id', repr('ambiguous_key'))} * 4) THEN ({noise.VAGUE!r})[CAST(floor({u('id', repr('ambiguous_key'), repr('to'))} * 7) AS INT) + 1] || substr(line, instr(line, ':')) ELSE line END, chr(10) ORDER BY i) AS text FROM l GROUP BY id""")
_noised("value_swap", f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {u('id', repr('value_swap'), 'CAST(i AS VARCHAR)')}, i) AS r FROM l)
SELECT a.id, string_agg(CASE WHEN a.r > 2 THEN a.line ELSE split_part(a.line, ':', 1) || ':' || substr(b.line, instr(b.line, ':') + 1) END, chr(10) ORDER BY a.i) AS text
FROM r a LEFT JOIN r b ON a.id = b.id AND a.r + b.r = 3 GROUP BY a.id""")
#: Forms whose vendors have a name of several words, which a line can be split at.
_WORDY = FORM + ", g AS (SELECT * REPLACE (replace(raw_text, '#', ' No ') AS raw_text) FROM f)"
for _tag in noise_sql.STATEMENTS:
    _noised(_tag, noise_sql.statement(_tag, FORM))


@query(f"WITH {_WORDY}, {noise_sql.lines('g')}, {noise_sql.split_line()}")
def noise_split_words(spark, sf_dir):
    rows = form(orders_gt(spark, sf_dir)).withColumn("raw_text", F.replace("raw_text", F.lit("#"), F.lit(" No ")))
    return rows.select("id", noise.apply("split_line", F.col("raw_text"), F.col("id")).alias("text"))


# Normalization.


def _dates() -> list[Column]:
    day = F.col("o_orderdate")
    return [F.date_format(day, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yy", "d MMM yyyy", "MMMM d, yyyy", "ddMMyyyy")]


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders")
def norm_date(spark, sf_dir):
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 7 == i, f) for i, f in enumerate(_dates())], F.lit("12/0B/2002"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), normalize.date(raw).alias("value"))


@query("SELECT event_id AS id, strftime(ts, '%H:%M') AS value FROM events")
def norm_time(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "HH:mm")).otherwise(F.concat(F.lit("at "), F.lower(F.date_format("ts", "hh.mm a"))))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), normalize.time(raw).alias("value"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice WHEN 2 THEN l_quantity * 100000.0 ELSE NULL END AS value FROM lineitem""")
def norm_number(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.concat(F.format_number("l_extendedprice", 2), F.lit(" INR"))).when(k == 1, F.concat(F.lit("₹ "), F.format_string("%.2f", "l_extendedprice"))).when(k == 2, F.concat(F.col("l_quantity").cast("string"), F.lit(" Lakh"))).otherwise("S,OOO")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), normalize.number(raw).alias("value"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE lpad(CAST(c_custkey + 9000000000 AS VARCHAR), 10, '0') END AS value FROM customer")
def norm_phone(spark, sf_dir):
    digits = (F.col("c_custkey") + 9_000_000_000).cast("string")
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("+91 "), F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 5))).when(k == 1, digits).otherwise(F.substring(digits, 1, 7))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), normalize.phone(raw).alias("value"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'department' ELSE lower(p_name || ' ' || p_type) END AS value FROM part")
def norm_string(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 5 == 0, " Dept ").otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" \t "), "p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), normalize.string(raw).alias("value"))


@query("SELECT n_nationkey AS id, (['INR', 'USD', 'EUR', 'XYZ', NULL])[n_nationkey % 5 + 1] AS currency, (['yearly', 'monthly', 'half-yearly', 'weekly', 'quarterly'])[n_nationkey % 5 + 1] AS frequency FROM nation")
def norm_codes(spark, sf_dir):
    at = F.col("n_nationkey") % 5 + 1
    raw = [F.element_at(F.array(*[F.lit(x) for x in xs]), at) for xs in (["Rs", " dollars", "€", "xyz", "1RN"], ["P.A.", "per month", "semi-annual", "Weekly", "/quarter"])]
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), normalize.currency(raw[0]).alias("currency"), normalize.frequency(raw[1]).alias("frequency"))


# Similarity.


@query("SELECT p_partkey AS id, levenshtein(lower(p_name), lower(p_type)) AS distance, round(levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 4) AS ned FROM part")
def sim_ned(spark, sf_dir):
    a, b = F.lower("p_name"), F.lower("p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.levenshtein(a, b).cast("long").alias("distance"), F.round(similarity.ned(a, b), 4).alias("ned"))


_WINDOW_SQL = """WITH d AS (SELECT DISTINCT p_name AS a, p_brand || ' ' || p_type AS b FROM part), s AS (SELECT *, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM d)
SELECT a, b, round(100.0 * list_max([len([1 for j in range(length(s)) if substr(s, j + 1, 1) = substr(l, i + j + 1, 1)]) for i in range(length(l) - length(s) + 1)]) / length(s), 6) AS ratio FROM s"""


def _window(spark, sf_dir, f) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", "p_brand", "p_type").alias("b")).distinct()
    return rows.select("a", "b", F.round(f(F.col("a"), F.col("b")), 6).alias("ratio"))


@query(_WINDOW_SQL)
def sim_window(spark, sf_dir):
    return _window(spark, sf_dir, similarity.window_ratio)


@query(_WINDOW_SQL)
def sim_window_arrow(spark, sf_dir):
    return _window(spark, sf_dir, similarity.window_ratio_arrow)


# Parsing and prediction.


@query(f"""WITH {FORM}, n AS (SELECT id, CASE WHEN key % 3 = 0 THEN replace(raw_text, 'Date: ', 'Shop: ') ELSE raw_text END AS t FROM f), l AS (SELECT id, i, string_split(t, chr(10))[i] AS line FROM n, unnest(range(1, 5)) AS x(i)),
m AS (SELECT id, i, split_part(line, ': ', 2) AS value, (MAP {{'vendor': 'vendor_name', 'shop': 'vendor_name', 'date': 'date', 'total': 'total_amount', 'currency': 'currency'}})[lower(split_part(line, ':', 1))] AS path FROM l)
SELECT id, path, arg_min(value, i) AS value FROM m GROUP BY id, path""")
def prd_regex_rules(spark, sf_dir):
    rows = form(orders_gt(spark, sf_dir)).withColumn("ocr_text", F.when(F.col("key") % 3 == 0, F.replace("raw_text", F.lit("Date: "), F.lit("Shop: "))).otherwise(F.col("raw_text")))
    return predict.labelled_values(rows)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(f"""WITH {FORM} SELECT id, left(sha256(replace(replace(replace(replace({_quoted(predict.TEMPLATE)}, '{{DOMAIN}}', 'receipts'), '{{TASK_INSTRUCTION}}', {_quoted(predict.TASK_TEXT['extraction'])}), '{{SCHEMA}}', {_quoted(predict.schema_text('receipts'))}), '{{OCR_TEXT}}', raw_text)), 8) AS prompt_hash FROM f""")
def prm_prompt_hash(spark, sf_dir):
    rows = form(orders_gt(spark, sf_dir)).withColumn("ocr_text", F.col("raw_text")).withColumn("task", F.lit("extraction"))
    return predict.prompts(rows).select("id", "prompt_hash")


@query("""SELECT event_id AS id, CASE event_id % 8 WHEN 5 THEN 'partial' WHEN 6 THEN 'failure' WHEN 7 THEN 'failure' ELSE 'success' END AS status,
CASE WHEN event_id % 8 < 5 THEN CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) ELSE -1 END AS k FROM events""")
def jsn_cascade(spark, sf_dir):
    p, k = F.col("props"), F.col("event_id") % 8
    raw = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here is the JSON: "), p, F.lit(" - done"))).when(k == 3, F.replace(p, F.lit("}"), F.lit(",}")))
        .when(k == 4, F.replace(p, F.lit("}"), F.lit(', "none": None}'))).when(k == 5, F.lit('"a": 1, "b": "x"')).when(k == 6, F.lit("no data here")).otherwise(F.lit("  "))
    )
    got = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), jsonfix.coerce(raw).alias("c"))
    return got.select("id", F.col("c.status").alias("status"), F.coalesce(F.get_json_object("c.json", "$.k").cast("long"), F.lit(-1)).alias("k"))


# Scores.


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with answers that go wrong by key: right, another total, no date, an unknown name, a foreign vendor."""
    rows = form(receipt_map(orders_gt(spark, sf_dir))).withColumn("ocr_text", F.col("raw_text"))
    k = F.col("key") % 5
    parts = [
        F.concat(F.lit('"vendor_name": "'), F.when(k == 4, F.lit("QQQQ ZZZZ")).otherwise(F.col("vendor_name")), F.lit('"')), F.when(k != 2, F.concat(F.lit('"date": "'), "date", F.lit('"'))),
        F.concat(F.lit('"total_amount": '), F.format_string("%.2f", F.when(k == 1, F.col("total") * 2).otherwise(F.col("total")))), F.lit('"currency": "INR"'), F.when(k == 3, F.lit('"colour": "red"')),
    ]
    return rows.withColumn("model_output", F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))


#: Field scores of these answers: v has the canonical values, w distances and gains. Said is what the form says of a field.
_SCORED = FORM + """, v AS (SELECT id, key, difficulty, unnest([
  {'path': 'vendor_name', 'gt': lower(vendor_name), 'pred': CASE WHEN key % 5 = 4 THEN 'qqqq zzzz' ELSE lower(vendor_name) END, 'said': lower(vendor_name)},
  {'path': 'date', 'gt': date, 'pred': CASE WHEN key % 5 <> 2 THEN date END, 'said': strftime(day, '%d/%m/%Y')},
  {'path': 'total_amount', 'gt': CAST(total AS VARCHAR), 'pred': CAST(CASE WHEN key % 5 = 1 THEN round(total * 2, 2) ELSE total END AS VARCHAR), 'said': split_part(split_part(raw_text, 'Total: ', 2), chr(10), 1)},
  {'path': 'currency', 'gt': 'INR', 'pred': 'INR', 'said': 'inr'}, {'path': 'colour', 'gt': NULL, 'pred': CASE WHEN key % 5 = 3 THEN 'red' END, 'said': NULL}]) AS r FROM f),
d AS (SELECT id, key, difficulty, r.path AS path, r.gt AS gt, r.pred AS pred, levenshtein(r.said, lower(r.gt)) / greatest(length(r.said), length(r.gt)) AS before,
  CASE WHEN r.pred IS NULL THEN 1.0 ELSE levenshtein(lower(r.pred), lower(r.gt)) / greatest(length(r.pred), length(r.gt)) END AS after FROM v WHERE r.gt IS NOT NULL OR r.pred IS NOT NULL),
w AS (SELECT *, CASE WHEN gt IS NULL OR path = 'total_amount' THEN NULL ELSE round(after, 4) END AS ned, CASE WHEN path = 'total_amount' THEN key % 5 <> 1 END AS within,
  CASE WHEN before > 0 THEN round((before - after) / before, 4) END AS gain, coalesce(gt = pred, false) AS exact, pred IS NOT NULL AND (gt IS NULL OR gt <> pred) AS hallucinated FROM d)"""


@query(f"""WITH {_SCORED}, g AS (SELECT id, any_value(difficulty) AS difficulty, any_value(key) AS key, {four('avg(ned)')} AS mean_ned, {four('avg(gain)')} AS mean_correction_gain, min(gain) AS min_correction_gain, max(gain) AS max_correction_gain,
  count(*) FILTER (gain > 0) AS n_improved, count(*) FILTER (gain < 0) AS n_regressed, round(count(*) FILTER (hallucinated) / count(pred), 4) AS hallucination_rate, round(count(*) FILTER (exact) / 4, 4) AS exact_match_rate FROM w GROUP BY id)
SELECT id, difficulty, CASE key % 5 WHEN 3 THEN 0.8 ELSE 1.0 END AS field_precision, CASE key % 5 WHEN 2 THEN 0.75 ELSE 1.0 END AS field_recall,
CASE key % 5 WHEN 2 THEN 0.8571 WHEN 3 THEN 0.8889 ELSE 1.0 END AS field_f1, CASE key % 5 WHEN 2 THEN 0.8571 ELSE 1.0 END AS required_f1, 0.0 AS optional_f1,
exact_match_rate, mean_ned, CASE key % 5 WHEN 1 THEN 0.0 ELSE 1.0 END AS numeric_tolerance_rate, mean_correction_gain, min_correction_gain, max_correction_gain, n_improved, n_regressed, hallucination_rate,
CASE key % 5 WHEN 3 THEN 0.0 WHEN 2 THEN 0.0 ELSE 1.0 END AS schema_valid, 1.0 AS parse_success FROM g""")
def agg_record_scores(spark, sf_dir):
    out = score.evaluate(answers(spark, sf_dir))
    return out.select("id", "difficulty", *score.METRICS, "min_correction_gain", "max_correction_gain", "n_improved", "n_regressed")


@query(f"""WITH {_SCORED} SELECT id, path, CASE path WHEN 'total_amount' THEN 'number' WHEN 'date' THEN 'date' WHEN 'currency' THEN 'currency' ELSE 'string' END AS kind, gt AS gt_value, pred IS NOT NULL AS pred_present, pred AS pred_value,
path <> 'colour' AS is_required, exact, ned, within, gain, hallucinated FROM w""")
def agg_field_scores(spark, sf_dir):
    out = score.field_scores(score.parsed(answers(spark, sf_dir)))
    return out.select("id", "path", "kind", "gt_value", "pred_present", "pred_value", "is_required", "exact", "ned", "within", "gain", "hallucinated")


@query(f"""WITH {_SCORED} SELECT id, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths, string_agg(path, ',' ORDER BY path) FILTER (exact) AS exact_paths, sum(gain) AS gains FROM w GROUP BY id""")
def agg_field_maps(spark, sf_dir):
    maps = score.field_maps(score.field_scores(score.parsed(answers(spark, sf_dir))))
    each = F.map_entries("per_field")
    exact = F.array_join(F.array_sort(F.transform(F.filter(each, lambda e: e["value"]["exact"]), lambda e: e["key"])), ",")
    gains = F.filter(F.transform(each, lambda e: e["value"]["gain"]), lambda g: g.isNotNull())
    total = F.when(F.size(gains) > 0, F.aggregate(gains, F.lit(0.0), lambda a, g: a + g))
    return maps.select("id", F.size("per_field").cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys("per_field")), ",").alias("paths"), F.when(exact != "", exact).alias("exact_paths"), total.alias("gains"))


@query(f"""WITH {_SCORED}, g AS (SELECT id, any_value(difficulty) AS difficulty, any_value(key) AS key, avg(gain) AS gain FROM w GROUP BY id),
m AS (SELECT difficulty, unnest(CASE key % 5 WHEN 1 THEN ['wrong_value', 'hallucination'] WHEN 2 THEN ['schema_mismatch', 'missing_required', 'wrong_value'] WHEN 3 THEN ['schema_mismatch', 'hallucination'] WHEN 4 THEN ['wrong_value', 'hallucination'] ELSE [] END) AS mode FROM g
  UNION ALL SELECT difficulty, 'correction_regression' FROM g WHERE {four('gain')} < 0)
SELECT difficulty, mode, count(*) AS "count" FROM m GROUP BY ALL""")
def agg_failure_modes(spark, sf_dir):
    return stats.mode_counts(score.evaluate(answers(spark, sf_dir)), ["difficulty"])


@query(f"""WITH {FORM}, {SAMPLES} SELECT task || ' | ' || domain || '__' || difficulty AS "group", 'total' AS metric, count(*) AS n, round(avg(total), 4) AS mean, round(median(total), 4) AS median, round(quantile_cont(total, 0.1), 4) AS p10, round(quantile_cont(total, 0.9), 4) AS p90, round(stddev_samp(total), 4) AS std
FROM s GROUP BY 1""")
def agg_by_task(spark, sf_dir):
    return stats.summarize_by(order_samples(spark, sf_dir), ["total"], ["task", "domain_x_difficulty"])


@query("""WITH l AS (SELECT l_returnflag, l_linestatus, unnest([{'metric': 'l_discount', 'value': l_discount}, {'metric': 'l_quantity', 'value': l_quantity}]) AS m FROM lineitem)
SELECT CASE WHEN grouping(l_returnflag) = 1 AND grouping(l_linestatus) = 1 THEN 'overall' WHEN grouping(l_linestatus) = 1 THEN 'l_returnflag' WHEN grouping(l_returnflag) = 1 THEN 'l_linestatus' ELSE 'l_returnflag_x_l_linestatus' END AS level,
l_returnflag, l_linestatus, m.metric AS metric, count(*) AS n, round(avg(m.value), 4) AS mean, round(median(m.value), 4) AS median, round(quantile_cont(m.value, 0.1), 4) AS p10, round(quantile_cont(m.value, 0.9), 4) AS p90, round(stddev_samp(m.value), 4) AS std
FROM l GROUP BY GROUPING SETS ((m.metric), (m.metric, l_returnflag), (m.metric, l_linestatus), (m.metric, l_returnflag, l_linestatus))""")
def agg_summary(spark, sf_dir):
    return stats.summarize(table(spark, sf_dir, "lineitem"), ["l_discount", "l_quantity"], ("l_returnflag", "l_linestatus"))


# Statistics.


def _bootstrap_sql(k: str, by: str, resamples: int = stats.RESAMPLES) -> str:
    """CTEs over k (by, v, r from 0, n): o has the sorted means of all resamples."""
    mask = (1 << 31) - 1
    return f"""d AS (SELECT {by}, n, x.b AS b, (x.b * 747796405 + r * 277803737 + {42 * 961748941}) & {mask} AS h FROM {k}, unnest(range({resamples})) AS x(b)),
d1 AS (SELECT {by}, n, b, (xor(h, h >> 16) * 739982445) & {mask} AS h FROM d), d2 AS (SELECT {by}, n, b, (xor(h, h >> 15) * 695872825) & {mask} AS h FROM d1),
e AS (SELECT {by}, b, (xor(h, h >> 16) * n) >> 31 AS r FROM d2),
m AS (SELECT e.{by}, b, avg(v) AS m FROM e JOIN {k} ON {k}.{by} = e.{by} AND {k}.r = e.r GROUP BY e.{by}, b), o AS (SELECT {by}, list_sort(list(m)) AS m FROM m GROUP BY {by})"""


@query(f"""WITH k AS (SELECT lang, CAST(n_chars AS DOUBLE) AS v, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents), {_bootstrap_sql('k', 'lang')}
SELECT k.lang, {four('avg(v)')} AS mean, {four('any_value(o.m)[251]')} AS lower, {four('any_value(o.m)[9750]')} AS upper, count(*) AS n FROM k JOIN o USING (lang) GROUP BY k.lang""")
def sta_bootstrap(spark, sf_dir):
    return stats.bootstrap(table(spark, sf_dir, "documents"), "n_chars", ["lang"], id_col="doc_id")


def _tail_sql(z: str) -> str:
    """Chance of a normal deviate beyond |z|: Simpson's rule over 10 deviations."""
    term = f"(CASE WHEN t IN (0, 2000) THEN 1 WHEN t % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs({z}) + t * 0.005, 2) / 2)"
    return f"sqrt(2 / pi()) * 0.005 / 3 * list_sum(list_transform(range(2001), lambda t: {term}))"


def _wilcoxon_sql(pairs: str, by: str) -> str:
    """CTEs over pairs (by, d): s has n, w and z, t also p, significant and effect."""
    return f"""r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2 AS r FROM {pairs} WHERE d <> 0),
s AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM r GROUP BY 1),
z AS (SELECT {by}, CAST(n AS BIGINT) AS n, least(up, down) AS w, (least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24) AS z FROM s),
t AS (SELECT *, CASE WHEN n >= 10 THEN {_tail_sql('z')} END AS p FROM z)"""


@query(f"""WITH p AS (SELECT l_returnflag, round(l_discount - l_tax, 10) AS d FROM lineitem), {_wilcoxon_sql('p', 'l_returnflag')}
SELECT l_returnflag, n, w, round(z, 4) AS z, round(p, 4) AS p, p < 0.05 AS significant, round(abs(z) / sqrt(n), 4) AS effect FROM t""")
def sta_wilcoxon(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return stats.wilcoxon(pairs, ["l_returnflag"])


@query("""WITH a AS (SELECT l_orderkey AS id, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS discount, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS quantity FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
b AS (SELECT l_orderkey AS id, arg_max(l_discount, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS discount, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) AS quantity FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT id, m.metric AS metric, m.a AS a, m.b AS b FROM (SELECT a.id, unnest([{'metric': 'discount', 'a': a.discount, 'b': b.discount}, {'metric': 'quantity', 'a': a.quantity, 'b': b.quantity}]) AS m FROM a JOIN b ON a.id = b.id)""")
def sta_paired_join(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").alias("place"), "l_returnflag", "l_linestatus", F.col("l_discount").alias("discount"), F.col("l_quantity").cast("double").alias("quantity"))
    return stats.paired(runs.where("l_returnflag <> 'R'"), runs.where("l_linestatus = 'F'"), ["discount", "quantity"], order_col="place")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs with a record per supplier: `near` differs little between them, `far` much."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 10_000).alias("x"), (F.col("s_suppkey") % 7 / 100).alias("e"))
    four = lambda c: F.round(c * 10_000) / 10_000  # noqa: E731  # as SQL rounds doubles: a half is one after the product, not in the shortest decimal
    return rows.select("id", four(F.col("x")).alias("near"), four(F.col("x") / 2).alias("far")), rows.select("id", four(F.col("x") + F.col("e") - 0.03).alias("near"), four(F.col("x") / 2 + 0.3 + F.col("e")).alias("far"))


@query(f"""WITH x AS (SELECT s_suppkey AS id, abs(s_acctbal) / 10000 AS x, s_suppkey % 7 / 100 AS e FROM supplier),
q AS (SELECT id, unnest([{{'metric': 'near', 'a': round(x, 4), 'b': round(x + e - 0.03, 4)}}, {{'metric': 'far', 'a': round(x / 2, 4), 'b': round(x / 2 + 0.3 + e, 4)}}]) AS m FROM x),
y AS (SELECT m.metric AS metric, id, m.a AS a, m.b AS b, row_number() OVER (PARTITION BY m.metric ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY m.metric) AS n FROM q),
k AS (SELECT metric || ' a' AS side, a AS v, r, n FROM y UNION ALL SELECT metric || ' b', b, r, n FROM y), {_bootstrap_sql('k', 'side')},
c AS (SELECT k.side, {four('avg(v)')} AS mean, {four('any_value(o.m)[251]')} AS lower, {four('any_value(o.m)[9750]')} AS upper FROM k JOIN o USING (side) GROUP BY k.side),
p AS (SELECT metric, round(a - b, 10) AS d FROM y), {_wilcoxon_sql('p', 'metric').replace('r AS (', 'r2 AS (', 1).replace('FROM r GROUP', 'FROM r2 GROUP')}
SELECT t.metric, a.mean AS mean_a, a.lower AS lower_a, a.upper AS upper_a, b.mean AS mean_b, b.lower AS lower_b, b.upper AS upper_b, round(a.mean - b.mean, 4) AS mean_diff, a.lower <= b.upper AND b.lower <= a.upper AS ci_overlaps,
  t.n AS n, t.w AS w, round(t.p, 4) AS p, coalesce(t.p < 0.05, false) AS significant, CASE WHEN a.lower <= b.upper AND b.lower <= a.upper THEN 'tie' WHEN t.p < 0.05 THEN CASE WHEN a.mean > b.mean THEN 'a' ELSE 'b' END ELSE 'inconclusive' END AS winner
FROM t JOIN c a ON a.side = t.metric || ' a' JOIN c b ON b.side = t.metric || ' b'""")
def sta_compare(spark, sf_dir):
    got = stats.compare(*_runs(spark, sf_dir), ["near", "far"])
    ci = [F.col(f"ci_{x}.{y}").alias(f"{y}_{x}") for x in "ab" for y in ("mean", "lower", "upper")]
    return got.select("metric", *ci, "mean_diff", "ci_overlaps", "wilcoxon.n", "wilcoxon.w", "wilcoxon.p", "wilcoxon.significant", "winner")


@query("SELECT c_mktsegment AS run_id, round(avg(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END), 4) AS exact_match_rate FROM customer GROUP BY 1 ORDER BY 2 DESC, 1")
def snk_leaderboard(spark, sf_dir):
    from .report import leaderboard

    runs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run_id")).agg(F.round(F.avg((F.col("c_acctbal") > 5000).cast("int")), 4).alias("exact_match_rate"))
    return leaderboard(runs).select("run_id", "exact_match_rate")


#: Settings with a fault for each check.
_BROKEN = {
    "domains": {"receipts": domains.DOMAINS["receipts"]}, "required": {"receipts": ["vendor_name", "colour"]}, "tasks": {"easy": {"extraction": 0.5}}, "splits": {"train": 0.6, "dev": 0.3},
    "weights": [{"char_O0": 1, "char_Q9": 2}], "applicability": {"char_B8": ["receipts"]}, "rates": {"char_O0": [0.1, 0.2]}, "case_paths": ["receipt_number", "agent.agent_id"],
}


@query("""SELECT * FROM (SELECT 'own' AS settings, unnest(['domains', 'noise_applicability', 'noise_rates', 'required_fields', 'tasks_easy', 'tasks_medium', 'tasks_hard', 'tasks_extreme', 'splits', 'case_paths', 'abbreviations']) AS name, true AS ok, '' AS faults)
UNION ALL VALUES ('broken', 'domains', false, 'hospital,insurance'), ('broken', 'noise_applicability', false, 'char_B8'), ('broken', 'noise_rates', false, 'char_Q9'), ('broken', 'required_fields', false, 'receipts:colour'),
('broken', 'tasks_easy', false, '0.5'), ('broken', 'splits', false, '0.8999999999999999'), ('broken', 'case_paths', false, 'agent.agent_id'), ('broken', 'abbreviations', true, '')""")
def val_config_checks(spark, sf_dir):
    path = f"{work_folder(spark)}/settings.json"
    records.write_text(spark, path, json.dumps(_BROKEN))
    faults = F.when(F.col("name") == "abbreviations", "").otherwise(F.col("detail")).alias("faults")
    own, broken = domains.checks(spark), domains.checks(spark, domains.load_settings(spark, path))
    return own.select(F.lit("own").alias("settings"), "name", "ok", faults).unionByName(broken.select(F.lit("broken").alias("settings"), "name", "ok", faults))


# Generation.


def _generated(domain: str) -> None:
    def run(spark, sf_dir):
        return generate.records(spark, domain, 400).select("id", F.explode("gt").alias("path", "value"))

    run.__name__ = f"gen_{domain}"
    query(generate_sql.records(domain, 400))(run)


for _domain in domains.DOMAINS:
    _generated(_domain)


@query(" UNION ALL ".join(f"({generate_sql.texts(d, 400)})" for d in domains.DOMAINS))
def ser_domains(spark, sf_dir):
    """Generated records of all domains as forms."""
    return generate.samples(spark).select("id", "raw_text")


@query(generate_sql.layout(100))
def gen_layout(spark, sf_dir):
    """Id, domain, difficulty, task and split of the whole generated data set."""
    return generate.samples(spark).select("id", "domain", "difficulty", "task", "split", "track", "source_type")


@query(f"WITH {ORDERS}, {generate_sql.selection('o', 'receipts')} SELECT id, tags FROM picked")
def noise_select(spark, sf_dir):
    return orders_gt(spark, sf_dir).select("id", F.array_join(noise.select(F.col("difficulty"), "receipts", F.col("id")), ",").alias("tags"))


@query(f"""WITH {FORM}, t AS (SELECT id, difficulty, raw_text, CASE key % 3 WHEN 0 THEN raw_text WHEN 1 THEN replace(raw_text, 'Date', 'XXXX') ELSE raw_text || '!' END AS text, key FROM f)
SELECT id, difficulty, CASE key % 3 WHEN 0 THEN difficulty = 'easy' WHEN 1 THEN difficulty IN ('easy', 'hard', 'extreme') ELSE difficulty <> 'extreme' END AND (difficulty NOT IN ('easy', 'medium') OR key % 3 <> 1) AS ok FROM t""")
def noise_valid(spark, sf_dir):
    """Forms as they are, without the label of a required field, and with a changed end."""
    k = F.col("key") % 3
    rows = form(orders_gt(spark, sf_dir)).withColumn("text", F.when(k == 0, F.col("raw_text")).when(k == 1, F.replace("raw_text", F.lit("Date"), F.lit("XXXX"))).otherwise(F.concat("raw_text", F.lit("!"))))
    return rows.select("id", "difficulty", noise.valid(F.col("raw_text"), F.col("text"), F.col("difficulty"), "receipts").alias("ok"))


@query()
def gen_dataset(spark, sf_dir):
    """A generated data set: every domain, difficulty and split."""
    return generate.dataset(spark).select("id", "domain", "difficulty", "split", "task", "raw_text", "ocr_text", "noise_tags", "noise_valid")


@query()
def agg_baseline_summary(spark, sf_dir):
    """The labelled-line baseline over a generated data set, summarized."""
    samples = cut(generate.dataset(spark))
    return stats.summarize(cut(score.evaluate(predict.regex_rules(samples))), score.METRICS)


# Runs and their artefacts.


def _prompt_sql(text: str) -> str:
    return f"replace(replace(replace(replace({_quoted(predict.TEMPLATE)}, '{{DOMAIN}}', 'receipts'), '{{TASK_INSTRUCTION}}', (MAP {{{', '.join(f'{_quoted(k)}: {_quoted(v)}' for k, v in predict.TASK_TEXT.items())}}})[task]), '{{SCHEMA}}', {_quoted(predict.schema_text('receipts'))}), '{{OCR_TEXT}}', {text})"


@query(f"WITH {FORM}, {SAMPLES} SELECT id, left(sha256({_prompt_sql('raw_text')}), 8) AS prompt_hash, 'always_null' AS model, 'hardcoded' AS backend, true AS success, '{{}}' AS model_output FROM s WHERE difficulty = 'medium'")
def prd_run_resumed(spark, sf_dir):
    """A run over the medium samples that stopped after the dev split, taken up again."""
    samples, path = cut(order_samples(spark, sf_dir)), work_folder(spark)
    predict.run(spark, samples, "R00", path, split="dev", difficulty="medium")
    return predict.run(spark, samples, "R00", path, resume=True, difficulty="medium").select("id", "prompt_hash", "model", "backend", "success", "model_output")


@query(f"WITH {FORM}, {SAMPLES} SELECT id, 'llama3.2' AS model, 'dry_run' AS backend, {_quoted(predict.MOCK['receipts'])} AS model_output FROM s WHERE split = 'test' AND task = 'schema'")
def prd_dry_run(spark, sf_dir):
    return predict.run(spark, order_samples(spark, sf_dir), "R06", work_folder(spark), dry_run=True, split="test", task="schema").select("id", "model", "backend", "model_output")


def _answering():
    """A stand-in for a model: it answers with the length of the prompt, fails on some and is out of quota on others."""

    def ask(prompt: str) -> str:
        if "Total: 1" in prompt:
            raise RuntimeError("quota used up")
        if "Total: 2" in prompt:
            raise ValueError("no answer")
        return f'{{"n": {len(prompt)}}}'

    return ask


@query(f"""WITH {FORM}, {SAMPLES}, p AS (SELECT id, raw_text, {_prompt_sql('raw_text')} AS prompt FROM s WHERE split = 'dev' AND difficulty = 'hard')
SELECT id, left(sha256(prompt), 8) AS prompt_hash, 'mistral' AS model, NOT contains(raw_text, 'Total: 2') AS success, CASE WHEN contains(raw_text, 'Total: 2') THEN 'ValueError: no answer' END AS error,
CASE WHEN contains(raw_text, 'Total: 2') THEN '' ELSE '{{"n": ' || length(prompt) || '}}' END AS model_output FROM p WHERE NOT contains(raw_text, 'Total: 1')""")
def prd_model_run(spark, sf_dir):
    got = predict.run(spark, order_samples(spark, sf_dir), "R08", work_folder(spark), make_backend=_answering, split="dev", difficulty="hard")
    return got.select("id", "prompt_hash", "model", "success", "error", "model_output")


@query("""SELECT c_custkey AS id, '{"flat":' || to_json(c_name) || CASE WHEN c_custkey % 2 = 0 THEN ',"agent":{"name":' || to_json(c_mktsegment) || '}' ELSE '' END || ',"policy":{"no":' || to_json('P "' || c_custkey || '"') || ',"type":' || to_json(c_mktsegment) || '}}' AS json FROM customer""")
def prd_nested_json(spark, sf_dir):
    pair = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    number = F.concat(F.lit('P "'), F.col("c_custkey").cast("string"), F.lit('"'))
    parts = F.concat(F.array(pair("flat", F.col("c_name"))), F.when(F.col("c_custkey") % 2 == 0, F.array(pair("agent.name", F.col("c_mktsegment")))).otherwise(F.array().cast("array<struct<path:string,value:string>>")), F.array(pair("policy.no", number), pair("policy.type", F.col("c_mktsegment"))))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), predict.nested_json(parts).alias("json"))


@query("""SELECT p_partkey AS id, path, CASE path WHEN 'a' THEN p_name WHEN 'b.c.d.e.f.g' THEN CAST(p_size AS VARCHAR) WHEN 'b.c.h' THEN '[1,"x"]' WHEN 'b.i' THEN NULL ELSE 'true' END AS value FROM part, unnest(['a', 'b.c.d.e.f.g', 'b.c.h', 'b.i', 'j']) AS x(path)""")
def flt_leaves(spark, sf_dir):
    """Leaves of objects six levels deep."""
    answer = F.concat(F.lit('{"a":'), F.regexp_extract(F.to_json(F.struct(F.col("p_name").alias("v"))), r'^\{"v":(.*)\}$', 1), F.lit(',"b":{"c":{"d":{"e":{"f":{"g":'), F.col("p_size").cast("string"), F.lit('}}},"h":[1,"x"]},"i":null},"j":true,"k":{}}'))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), jsonfix.leaves(answer).alias("found")).select("id", F.explode("found").alias("e")).select("id", "e.path", "e.value")


@query(f"""WITH {_SCORED}, g AS (SELECT id, any_value(key) AS key, avg(gain) AS gain FROM w GROUP BY id) SELECT id, {four('gain')} AS mean_correction_gain, CASE WHEN key % 5 = 2 THEN 'missing_required' END AS mode FROM g""")
def snk_evaluated(spark, sf_dir):
    """Evaluated predictions, written as JSON lines and read back."""
    got = records.write_evaluated(spark, score.evaluate(answers(spark, sf_dir)), work_folder(spark))
    return got.select("id", "mean_correction_gain", F.when(F.array_contains("failure_modes", "missing_required"), "missing_required").alias("mode"))


@query(f"""WITH {_SCORED}, g AS (SELECT id, any_value(key) % 5 AS k, avg(ned) AS ned, avg(gain) AS gain, count(*) FILTER (hallucinated) / count(pred) AS hall, count(*) FILTER (exact) / 4 AS exact FROM w GROUP BY id),
m AS (SELECT count(*) AS n, round(avg(round(exact, 4)), 4) AS exact_match_rate, round(avg(round(ned, 4)), 4) AS mean_ned, round(avg(CASE k WHEN 2 THEN 0.8571 ELSE 1 END), 4) AS required_f1, round(avg(round(hall, 4)), 4) AS hallucination_rate,
  round(avg(CASE WHEN k IN (2, 3) THEN 0 ELSE 1 END), 4) AS schema_valid, 1.0 AS parse_success, round(avg({four('gain')}), 4) AS mean_correction_gain,
  count(*) FILTER (k IN (1, 2, 4)) AS wrong_value, count(*) FILTER (k = 2) AS missing_required FROM g)
SELECT 'R01' AS run_id, 'regex_rules' AS model, 'hardcoded' AS backend, 'dev' AS split, n AS n_records, exact_match_rate, mean_ned, required_f1, hallucination_rate, schema_valid, parse_success, mean_correction_gain, wrong_value, missing_required FROM m""")
def snk_summary(spark, sf_dir):
    """A run's summary.json, written, copied beside an unreadable one, and read back."""
    from . import report

    base = work_folder(spark)
    report.write_summary(spark, cut(score.evaluate(answers(spark, sf_dir))), f"{base}/run", {"model": "regex_rules", "backend": "hardcoded", "filters": {"split": "dev"}})
    records.write_text(spark, f"{base}/all/R02/summary.json", "{damaged")
    records.snapshot(spark, f"{base}/run", f"{base}/all/R01")
    got = records.read_summaries(spark, f"{base}/all/*/summary.json")
    return got.select("run_id", "model", "backend", "split", "n_records", *[F.col("metrics")[m].alias(m) for m in report.SUMMARY], *[F.col("failure_modes")[m].alias(m) for m in ("wrong_value", "missing_required")])


@query("""WITH m AS (SELECT l_returnflag, l_linenumber, round(avg(l_quantity) / 50, 4) AS v FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linenumber, v, CASE WHEN v >= 0.85 THEN 'good' WHEN v >= 0.65 THEN 'fair' ELSE 'poor' END AS higher, CASE WHEN v <= 0.05 THEN 'good' WHEN v <= 0.15 THEN 'fair' ELSE 'poor' END AS lower,
CASE WHEN v >= 0.85 THEN 'hot' WHEN v >= 0.7 THEN 'warm' WHEN v >= 0.5 THEN 'mild' ELSE 'cold' END AS heat FROM m""")
def viz_classes(spark, sf_dir):
    """The classes by which reports colour a small table of means."""
    from . import report

    means = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_quantity") / 50, 4).alias("v")).collect()
    rows = [(r["l_returnflag"], r["l_linenumber"], r["v"], report.score_class(r["v"]), report.score_class(r["v"], False), report.heat_class(r["v"])) for r in means]
    return spark.createDataFrame(rows, "l_returnflag string, l_linenumber long, v double, higher string, lower string, heat string")


def _lines(spark: SparkSession, text: str) -> DataFrame:
    """The lines of a text that the driver made, with their places."""
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"))), "place long, line string")


_MEANS = "m AS (SELECT l_linenumber AS k, round(avg(l_discount) * 5, 4) AS v FROM lineitem GROUP BY 1)"


@query(f"""WITH {_MEANS} SELECT 0 AS place, 'Discounts' AS line UNION ALL SELECT row_number() OVER (ORDER BY k), 'line ' || k || ' ' || repeat('█', CAST(floor(v * 30 + 0.5) AS INT)) || repeat('░', 30 - CAST(floor(v * 30 + 0.5) AS INT)) || ' ' || printf('%.3f', v) FROM m""")
def viz_bars(spark, sf_dir):
    from . import report

    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_discount") * 5, 4).alias("v")).orderBy("k").collect()
    return _lines(spark, report.bars({f"line {r['k']}": r["v"] for r in means}, "Discounts"))


@query("""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, round(avg(l_discount), 4) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT a FROM c)
SELECT 0 AS place, repeat(' ', 12) || lpad('F', 10, ' ') || lpad('O', 10, ' ') AS line UNION ALL
SELECT row_number() OVER (ORDER BY a), rpad(a, 12, ' ') || coalesce((SELECT lpad(printf('%.3f', v), 10, ' ') FROM c WHERE c.a = r.a AND b = 'F'), repeat(' ', 9) || '-') || coalesce((SELECT lpad(printf('%.3f', v), 10, ' ') FROM c WHERE c.a = r.a AND b = 'O'), repeat(' ', 9) || '-') FROM r""")
def viz_heatmap(spark, sf_dir):
    from . import report

    summary = stats.summarize(table(spark, sf_dir, "lineitem"), ["l_discount"], ("l_returnflag", "l_linestatus"))
    grid = report.matrix(summary, "l_discount", "l_returnflag", "l_linestatus")
    return _lines(spark, report.heatmap(dict(sorted(grid.items())), ["F", "O"]))


@query(f"""WITH c AS ({SQL['sta_compare']}) SELECT row_number() OVER (ORDER BY metric) - 1 AS place, rpad(metric, 24, ' ') || ' ' || printf('%.4f', mean_a) || ' ' || printf('%.4f', mean_b) || ' ' || CASE WHEN mean_diff >= 0 THEN '+' ELSE '' END || printf('%.4f', mean_diff) || ' ' || winner AS line FROM c""")
def sta_text(spark, sf_dir):
    from . import report

    return _lines(spark, report.comparison_text(stats.compare(*_runs(spark, sf_dir), ["near", "far"])))


@query("""WITH r AS (SELECT c_mktsegment AS run, round(avg(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END), 4) AS a, round(avg(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END), 4) AS b FROM customer GROUP BY 1)
SELECT 0 AS place, '| run | rich | solvent |' AS line UNION ALL SELECT 1, '|---|---|---|' UNION ALL SELECT 1 + row_number() OVER (ORDER BY a DESC, run), '| ' || run || ' | ' || printf('%.4f', a) || ' | ' || printf('%.4f', b) || ' |' FROM r""")
def snk_markdown(spark, sf_dir):
    from . import report

    share = lambda c, name: F.round(F.avg(c.cast("int")), 4).alias(name)
    runs = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run_id")).agg(share(F.col("c_acctbal") > 5000, "rich"), share(F.col("c_acctbal") > 0, "solvent"))
    return _lines(spark, report.leaderboard_markdown(runs, ["rich", "solvent"]))


@query("SELECT 'R06' AS run_id, 'llama3.2' AS model, 'ollama' AS backend, 'test' AS split, 'schema' AS task, true AS dry_run, 1024 AS max_tokens")
def snk_run_config(spark, sf_dir):
    path = work_folder(spark)
    predict.run(spark, order_samples(spark, sf_dir), "R06", path, dry_run=True, split="test", task="schema")
    c = records.read_run_config(spark, path)
    row = (c["run_id"], c["model"], c["backend"], c["filters"]["split"], c["filters"]["task"], c["dry_run"], c["max_tokens"])
    return spark.createDataFrame([row], "run_id string, model string, backend string, split string, task string, dry_run boolean, max_tokens long")


@query("SELECT * FROM (VALUES ('own', ''), ('no schema', 'the template lacks {SCHEMA}'), ('nothing', 'the template lacks {TASK_INSTRUCTION}, {SCHEMA}, {OCR_TEXT}')) AS t(name, fault)")
def prm_template(spark, sf_dir):
    rows = []
    for name, template in (("own", predict.TEMPLATE), ("no schema", "{TASK_INSTRUCTION} {OCR_TEXT}"), ("nothing", "")):
        try:
            predict.check_template(template)
            rows.append((name, ""))
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "name string, fault string")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders serialized as forms, corrupted, read by the labelled-line baseline and scored, by difficulty."""
    rows = form(receipt_map(orders_gt(spark, sf_dir))).withColumn("ocr_text", noise.apply("char_O0", F.col("raw_text"), F.col("id")))
    found = score.evaluate(predict.regex_rules(rows))
    return found.groupBy("difficulty").agg(F.count("*").alias("n"), F.round(F.avg("exact_match_rate"), 4).alias("exact_match_rate"), F.round(F.avg("mean_ned"), 4).alias("mean_ned"))

