"""Scalar functions against tables of cases, and properties of distances."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldglass.functions import jsonfix, normalize, similarity


def applied(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = {
    normalize.date: {"2024-03-14": "2024-03-14", "2024/3/4": "2024-03-04", "14/03/2024": "2024-03-14", "14-03-24": "2024-03-14", "14.03.71": "1971-03-14", "14 March 2024": "2024-03-14", "Mar 14, 2024": "2024-03-14", "14032024": "2024-03-14", "31/02/2024": "2024-02-31", "12/0B/2002": None, "32/01/2024": None, "01/13/2024": None, "": None, None: None},
    normalize.time: {"09:15": "09:15", "9:15 AM": "09:15", "9.15pm": "21:15", "12:00 AM": "00:00", "12:00 PM": "12:00", "25:00": None, "soon": None, None: None},
    normalize.number: {"5,000 INR": 5000.0, "₹ 5000": 5000.0, "368.16": 368.16, "2 lakh": 200000.0, "1.5 crore": 15000000.0, "-3": -3.0, "S,OOO": None, "abc": None, "": None, ".": None, None: None},
    normalize.phone: {"9876543210": "9876543210", "+91 98765 43210": "9876543210", "98765-43210": "9876543210", "12345": None, None: None},
    normalize.string: {"  Hello   World ": "hello world", "Dept": "department", " ": None, None: None},
    normalize.currency: {"Rs": "INR", "inr": "INR", "₹": "INR", "dollars": "USD", "€": "EUR", "XYZ": "XYZ", "1RN": None, None: None},
    normalize.frequency: {"Annual": "yearly", "p.a.": "yearly", "per month": "monthly", "semi-annual": "half-yearly", "weekly": "weekly"},
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_canonical_forms(spark, f):
    assert applied(spark, f, list(CASES[f])) == list(CASES[f].values())


def test_json_cascade(spark):
    cases = {
        '{"a": 1}': ("success", 1), ' {"a": 1} ': ("success", 1), '```json\n{"a": 1}\n```': ("success", 1), '```\n{"a": 1}\n```': ("success", 1), 'The answer: {"a": 1} ok': ("success", 1),
        '{"a": 1, }': ("success", 1), "{'a': 1}": ("success", 1), '{"a": 1, "b": None}': ("success", 1), 'x {"a": 1, "s": "}"} {"a": 2}': ("success", 1), '"a": 1, "b": 2': ("partial", 1), "no": ("failure", None), "[1, 2]": ("failure", None), "": ("failure", None), None: ("failure", None),
        '{"a": 1': ("failure", None), '"a": 1, "a.b": 2': ("partial", None),
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", jsonfix.coerce(F.col("t")).alias("c"))
    got = rows.select("i", "c.status", F.get_json_object("c.json", "$.a").alias("a")).orderBy("i").collect()
    for r, (text, (status, a)) in zip(got, cases.items()):
        assert r["status"] == status, text
        assert a is None or r["a"] == str(a), text


def test_leaves(spark):
    text = '{"a": {"b": {"c": 1, "d": null}, "e": {}}, "f": [1, 2], "g": "x", "h": "{no"}'
    got = spark.createDataFrame([(text,)], "t string").select(jsonfix.leaves(F.col("t")).alias("l")).head()["l"]
    assert {r["path"]: r["value"] for r in got} == {"a.b.c": "1", "a.b.d": None, "f": "[1,2]", "g": "x", "h": "{no"}


def test_equality(spark):
    rows = spark.createDataFrame([("1.001", "1.0", True), ("A  b", "a b", True), (None, None, True), (None, "a", False), ("a", "b", False)], "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in rows.select("want", similarity.same(F.col("a"), F.col("b")).alias("got")).collect())


def test_containment(spark):
    rows = spark.createDataFrame([("Asha", "Name: Asha Rao", True), ("Asha Rao", "Name: Asha Rap", True), ("Zzzz", "Name: Asha", False), (None, "x", True), (" ", "x", True), ("x", None, False)], "v string, t string, want boolean")
    assert [r["got"] for r in rows.select(similarity.in_text(F.col("v"), F.col("t")).alias("got")).collect()] == [r["want"] for r in rows.collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), min_size=1, max_size=30))
def test_distance_properties(spark, pairs):
    pairs = [(a.encode("utf-8", "ignore").decode(), b.encode("utf-8", "ignore").decode()) for a, b in pairs]
    a, b = F.col("a"), F.col("b")
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ned(a, b).alias("x"), similarity.ned(b, a).alias("y"), similarity.window_ratio_arrow(a, b).alias("r"))
    for r in rows.collect():
        assert 0 <= r["x"] <= 1 and math.isclose(r["x"], r["y"]) and (r["x"] == 0) == (r["a"] == r["b"]) and 0 <= r["r"] <= 100
