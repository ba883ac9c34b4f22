"""Records as form-like text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import by_weight, pick, strip, uniform, unlines
from .domains import Field, fields

# Date notations of forms, and separators by weight.
DATE_FORMATS = ["dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "yyyy-MM-dd"]
SEPARATORS = {": ": 70, ":": 20, " : ": 10}
BLANK_LINE = 0.3


def number(c: Column) -> Column:
    """Thousands separated; whole numbers without, others with two decimals."""
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def date(c: Column, *key) -> Column:
    d = c.cast("date")
    which = pick(DATE_FORMATS, *key)
    out = F.date_format(d, DATE_FORMATS[-1])
    for f in DATE_FORMATS[:-1]:
        out = F.when(which == f, F.date_format(d, f)).otherwise(out)
    return out


def label(f: Field, *key) -> Column:
    return pick(list(f.labels), *key) if f.labels else F.lit(f.path.rpartition(".")[2].replace("_", " ").title())


def line(f: Field, value: Column, key: Column) -> Column:
    if f.kind == "number":
        value = number(value.cast("double"))
    elif f.kind == "date":
        value = date(value, key, f.path, "date")
    return F.concat(label(f, key, f.path, "label"), by_weight(SEPARATORS, key, f.path, "sep"), value)


def serialize(gt: Column, domain: str, key: Column) -> Column:
    """Text of a record (a map of path to text): sections in schema order, their lines in hash order, now and then a blank line
    after a nested section; missing fields have no line."""
    sections: dict[str, list[Field]] = {}
    for f in fields(domain):
        sections.setdefault(f.section, []).append(f)
    parts = []
    for name, fs in sections.items():
        rows = F.array(*[F.struct(uniform(key, f.path, "order").alias("o"), line(f, F.try_element_at(gt, F.lit(f.path)), key).alias("t")) for f in fs])
        found = F.transform(F.array_sort(F.filter(rows, lambda r: r["t"].isNotNull())), lambda r: r["t"])
        if name:
            found = F.when((F.size(found) > 0) & (uniform(key, name, "blank") < BLANK_LINE), F.array_append(found, "")).otherwise(found)
        parts.append(found)
    return strip(unlines(F.concat(*parts)))
