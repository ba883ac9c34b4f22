"""Synthetic ground truth: records of each domain from a row number and a seed, without state between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import below, between, by_weight, pick, uniform
from .domains import DIFFICULTIES, DOMAINS, PREFIXES, SPLITS, TASKS, fields

FIRST = ["Asha", "Bela", "Chetan", "Divya", "Esha", "Farid", "Gita", "Hari", "Indu", "Jatin", "Kamal", "Lata", "Mohan", "Nila", "Omar", "Parul", "Qadir", "Ritu", "Sunil", "Tara"]
LAST = ["Anand", "Bajaj", "Cherian", "Dutta", "Fernandes", "Gill", "Hegde", "Irani", "Jha", "Kohli", "Lal", "Menon", "Nath", "Oza", "Parekh", "Rana", "Sethi", "Thomas", "Vohra", "Zaveri"]
CITIES = ["Agra", "Bhuj", "Cuttack", "Dehradun", "Erode", "Guntur", "Hubli", "Jammu", "Kochi", "Ludhiana", "Mysuru", "Nashik"]
STREETS = ["Garden Road", "Hill Street", "Lake Lane", "Market Road", "Mill Street", "Park Avenue", "River View", "Station Road", "Temple Street", "Tower Road"]
SHOPS = ["Blue Lotus Stores", "Corner Pantry", "Daily Basket", "Evergreen Mart", "Family Foods", "Golden Grain", "Harvest House", "Lucky Traders", "Metro Bazaar", "Open Market", "Sunrise Cafe", "Village Kitchen"]
PAYMENTS = ["UPI", "Cash", "Debit Card", "Credit Card", "Net Banking", "Wallet"]
ITEMS = ["2x Tea 60.00", "1x Bread 45.00", "3x Soap 135.00", "1x Rice 5kg 410.00", "2x Milk 96.00", "1x Oil 1L 190.00", "4x Pens 80.00", "1x Shirt 649.00"]
POLICIES = ["Term Life", "Whole Life", "Endowment", "Health", "Motor", "Home", "Travel", "Accident"]
FREQUENCIES = ["yearly", "monthly", "quarterly", "half-yearly"]
DEPARTMENTS = ["Cardiology", "Dermatology", "Emergency", "ENT", "General Medicine", "Neurology", "Oncology", "Orthopaedics", "Paediatrics", "Urology"]
SYMPTOMS = ["Back pain", "Cough", "Dizziness", "Ear pain", "Fever", "Headache", "Itching", "Joint pain", "Nausea", "Swelling"]
SINCE = ["since morning", "since yesterday", "for 3 days", "for 2 weeks", "after meals", "at night", "on exertion", "with mild fever"]
VISITS = ["Annual checkup", "Follow-up review", "Vaccination", "Second opinion"]
PAYERS = ["Amber Health", "Beacon Mutual", "Cedar Assurance", "Delta Care", "Evergreen Life"]
BLOOD = ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"]


def _day(first: str, days: int, *key) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), below(days, *key)), "yyyy-MM-dd")


def _maybe(value: Column, missing: float, *key) -> Column:
    return F.when(uniform(*key) >= missing, value)


def _money(low: float, high: float, *key) -> Column:
    return F.round(F.lit(low) + uniform(*key) * (high - low), 2)


def _values(domain: str, k: Column) -> dict[str, Column]:
    """Each field's value (as text) from the row's key."""
    u = lambda name: (k, domain, name)
    name = lambda n: F.concat_ws(" ", pick(FIRST, *u(n + "1")), pick(LAST, *u(n + "2")))
    code = lambda prefix, low, high, n: F.concat(F.lit(prefix), between(low, high, *u(n)).cast("string"))
    hour = lambda low, high, n: F.format_string("%02d:%02d", between(low, high, *u(n + "h")), below(4, *u(n + "m")) * 15)
    phone = _maybe(F.concat(pick(["98", "97", "96", "95", "94"], *u("p1")), F.lpad(below(100_000_000, *u("p2")).cast("string"), 8, "0")), 0.35, *u("p0"))
    address = _maybe(F.concat(between(1, 400, *u("a1")).cast("string"), F.lit(" "), pick(STREETS, *u("a2")), F.lit(", "), pick(CITIES, *u("a3"))), 0.45, *u("a0"))
    if domain == "receipts":
        subtotal = _money(80, 4500, *u("subtotal"))
        rate = F.element_at(F.array(F.lit(0.05), F.lit(0.12), F.lit(0.18)), below(3, *u("rate")) + 1)
        tax = F.round(subtotal * rate, 2)
        money = lambda c: c.cast("string")
        return {
            "vendor_name": pick(SHOPS, *u("vendor")), "date": _day("2022-01-01", 1096, *u("date")), "time": _maybe(hour(8, 21, "time"), 0.2, *u("time0")),
            "receipt_number": _maybe(code("RCT-", 10_000, 99_999, "no"), 0.15, *u("no0")), "subtotal": _maybe(money(subtotal), 0.2, *u("sub0")), "tax_amount": _maybe(money(tax), 0.2, *u("tax0")),
            "total_amount": money(F.round(subtotal + tax, 2)), "currency": F.lit("INR"), "payment_method": _maybe(pick(PAYMENTS, *u("pay")), 0.1, *u("pay0")),
            "line_items": _maybe(F.concat_ws(", ", pick(ITEMS, *u("i1")), pick(ITEMS, *u("i2"))), 0.25, *u("i0")),
        }
    if domain == "insurance":
        start = _day("2018-01-01", 2373, *u("start"))
        years = (below(6, *u("years")) + 1) * 5
        return {
            "policyholder.name": name("name"), "policyholder.dob": _day("1955-01-01", 18_628, *u("dob")), "policyholder.gender": pick(["Male", "Female"], *u("sex")), "policyholder.contact_number": phone,
            "policyholder.address": address, "policy.policy_number": code("AG-", 100_000, 999_999, "policy"), "policy.policy_type": pick(POLICIES, *u("type")), "policy.start_date": start,
            "policy.end_date": _maybe(F.date_format(F.add_months(start.cast("date"), years * 12), "yyyy-MM-dd"), 0.4, *u("end")), "premium.amount": _money(300, 30_000, *u("amount")).cast("string"),
            "premium.currency": F.lit("INR"), "premium.payment_frequency": pick(FREQUENCIES, *u("freq")), "agent.name": _maybe(name("agent"), 0.1, *u("agent0")), "agent.agent_id": _maybe(code("AGT-", 100, 999, "aid"), 0.1, *u("aid0")),
        }
    insured = uniform(*u("insured")) > 0.3
    fahrenheit = F.round(F.lit(97.0) + uniform(*u("temp")) * 6.5, 1)
    return {
        "patient.name": name("name"), "patient.dob": _day("1940-01-01", 30_681, *u("dob")), "patient.gender": pick(["Male", "Female"], *u("sex")), "patient.blood_group": _maybe(pick(BLOOD, *u("blood")), 0.15, *u("blood0")),
        "patient.contact_number": phone, "patient.address": address, "visit.date": _day("2021-01-01", 1461, *u("date")), "visit.time": _maybe(hour(7, 20, "time"), 0.15, *u("time0")),
        "visit.department": _maybe(pick(DEPARTMENTS, *u("dept")), 0.05, *u("dept0")), "visit.reason_for_visit": F.when(uniform(*u("why")) < 0.2, pick(VISITS, *u("why1"))).otherwise(F.concat_ws(" ", pick(SYMPTOMS, *u("why2")), pick(SINCE, *u("why3")))),
        "vitals.blood_pressure": _maybe(F.concat_ws("/", (F.lit(100) + below(14, *u("bp1")) * 5).cast("string"), (F.lit(60) + below(9, *u("bp2")) * 5).cast("string")), 0.1, *u("bp0")),
        "vitals.pulse": _maybe(between(55, 114, *u("pulse")).cast("string"), 0.1, *u("pulse0")),
        "vitals.temperature": _maybe(F.when(uniform(*u("unit")) < 0.5, F.concat(fahrenheit.cast("string"), F.lit("F"))).otherwise(F.concat(F.round((fahrenheit - 32) * 5 / 9, 1).cast("string"), F.lit("C"))), 0.15, *u("temp0")),
        "vitals.weight": _maybe(F.concat(between(38, 130, *u("weight")).cast("string"), F.lit(" kg")), 0.4, *u("weight0")), "vitals.height": _maybe(F.concat(between(140, 195, *u("height")).cast("string"), F.lit(" cm")), 0.4, *u("height0")),
        "insurance.provider": F.when(insured, pick(PAYERS, *u("payer"))), "insurance.policy_number": F.when(insured, code("INS-", 100_000, 999_999, "ins")),
        "attending_physician.name": _maybe(F.concat(F.lit("Dr "), name("doctor")), 0.05, *u("doctor0")), "attending_physician.id": _maybe(code("REG-", 1000, 9999, "reg"), 0.1, *u("reg0")),
    }


def records(spark: SparkSession, domain: str, n: int, seed: int = 42) -> DataFrame:
    """(id, domain, row, gt): n records, gt a map of path to text without missing fields. Rows depend on their number alone."""
    k = F.concat_ws("-", F.lit(seed), F.col("row"))
    values = _values(domain, k)
    assert list(values) == [f.path for f in fields(domain)]
    entries = F.array(*[F.struct(F.lit(p).alias("key"), v.alias("value")) for p, v in values.items()])
    gt = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return spark.range(n).select(F.col("id").alias("row")).select(F.format_string(f"{PREFIXES[domain]}_%06d", "row").alias("id"), F.lit(domain).alias("domain"), "row", gt.alias("gt"))


def task(difficulty: Column, *key) -> Column:
    """A task label by the difficulty's shares."""
    out = None
    for d, shares in TASKS.items():
        out = F.when(difficulty == d, by_weight(shares, *key)) if out is None else out.when(difficulty == d, by_weight(shares, *key))
    return out


def split(rows: DataFrame, group: list[str], key: Column, shares: dict[str, float] | None = None) -> DataFrame:
    """Adds `split`: each group's rows in the order of a hash, cut at the whole parts of the cumulated shares.

    A row's place is the count of its group's rows in lower hash ranges plus its place in its own range, so no task sorts a
    whole group; the counts are 4096 a group at most.
    """
    from pyspark.sql import Window

    shares = shares or SPLITS
    rows = rows.withColumn("_hash", F.md5(key.cast("string"))).withColumn("_range", F.substring("_hash", 1, 3))
    ranges = rows.groupBy(*group, "_range").agg(F.count("*").alias("_in"))
    every = Window.partitionBy(*group)
    ranges = ranges.withColumn("_n", F.sum("_in").over(every)).withColumn("_before", F.sum("_in").over(every.orderBy("_range")) - F.col("_in")).drop("_in")
    rows, ranges = rows.alias("r"), F.broadcast(ranges).alias("c")
    rows = rows.join(ranges, [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*group, "_range")]).select("r.*", "_n", "_before")
    rows = rows.withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_hash", key)))
    at, out = 0.0, None
    for name, share in list(shares.items())[:-1]:
        at += share
        cond = F.col("_at") <= F.floor(F.col("_n") * F.lit(round(at, 9)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return rows.withColumn("split", out.otherwise(list(shares)[-1])).drop("_n", "_at", "_hash", "_range", "_before")


def samples(spark: SparkSession, per_cell: int = 100, seed: int = 42, track: str = "synthetic") -> DataFrame:
    """All samples before corruption: domains by difficulties by `per_cell`, serialized, with task and split."""
    from .serialize import serialize

    out = None
    for domain in DOMAINS:
        rows = records(spark, domain, per_cell * len(DIFFICULTIES), seed)
        difficulty = F.element_at(F.array(*[F.lit(d) for d in DIFFICULTIES]), F.floor(F.col("row") / per_cell).cast("int") + 1)
        rows = rows.withColumn("difficulty", difficulty).withColumn("track", F.lit(track)).withColumn("source_type", F.lit(track))
        rows = rows.withColumn("raw_text", serialize(F.col("gt"), domain, F.concat_ws("-", F.lit(seed), "id")))
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("task", task(F.col("difficulty"), F.lit(seed), F.col("id"), "task"))
    return split(out, ["domain", "difficulty"], F.concat_ws("-", F.lit(seed), "id"))


def dataset(spark: SparkSession, per_cell: int = 100, seed: int = 42) -> DataFrame:
    """All samples of the synthetic track, corrupted."""
    from .noise import corrupt

    return corrupt(samples(spark, per_cell, seed), seed=seed)


def manifest(samples: DataFrame) -> DataFrame:
    """Rows by domain and difficulty, a column per split and their total."""
    return samples.groupBy("domain", "difficulty").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("total"))
