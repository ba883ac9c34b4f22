"""String distances and containment, as Column expressions; the sliding window has an Arrow form for long texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import squash, strip

THRESHOLD = 85.0


def ned(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(a, b) / longest)


def window_ratio(a: Column, b: Column) -> Column:
    """The shorter string slides over the longer: best share of equal places, 0 to 100. Native, for short strings."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    places = F.sequence(F.lit(0), F.length(long) - F.length(short))
    let = F.transform(F.array(F.struct(F.split(short, "").alias("s"), F.split(long, "").alias("l"))), lambda x: F.array_max(F.transform(places, lambda at: F.aggregate(x["s"], F.struct(F.lit(0).alias("i"), F.lit(0).alias("n")), lambda acc, c: F.struct((acc["i"] + 1).alias("i"), (acc["n"] + (F.get(x["l"], at + acc["i"]) == c).cast("int")).alias("n")), lambda acc: acc["n"]))))
    return F.when((F.length(a) == 0) & (F.length(b) == 0), 100.0).when(F.length(short) == 0, 0.0).otherwise(100.0 * F.element_at(let, 1) / F.length(short))


def ratio(x: str, y: str) -> float:
    """window_ratio() of two strings, over code points."""
    if len(x) > len(y):
        x, y = y, x
    if not x:
        return 100.0 if not y else 0.0
    s, t = (np.frombuffer(v.encode("utf-32-le"), "u4") for v in (x, y))
    return 100.0 * int((np.lib.stride_tricks.sliding_window_view(t, len(s)) == s).sum(1).max()) / len(s)


@F.pandas_udf(T.DoubleType())
def window_ratio_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """window_ratio() in Arrow batches; null where either side is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def in_text(value: Column, text: Column, threshold: float = THRESHOLD, exactly: Column | None = None) -> Column:
    """Whether a text holds a value, exactly or nearly (only exactly where `exactly` is true); a null or blank value counts as
    held. Only values that aren't found exactly reach the Arrow form: the others pass null to it."""
    v, t = F.lower(strip(value)), F.lower(F.coalesce(text, F.lit("")))
    blank = F.coalesce(v, F.lit("")) == ""
    exact = F.contains(t, v)
    asked = ~blank & ~exact if exactly is None else ~blank & ~exact & ~exactly
    near = window_ratio_arrow(F.when(asked, v), F.when(asked, t)) >= threshold
    return blank | F.coalesce(exact, F.lit(False)) | F.coalesce(near, F.lit(False))


def same(pred: Column, gt: Column, case_sensitive: Column | None = None) -> Column:
    """Value equality: both null; numbers to two decimals; identifiers as they stand; else without case and white space runs."""
    a, b = pred.try_cast("double"), gt.try_cast("double")
    loose = F.when(a.isNotNull() & b.isNotNull(), F.round(a, 2) == F.round(b, 2)).otherwise(squash(F.lower(pred)) == squash(F.lower(gt)))
    out = loose if case_sensitive is None else F.when(case_sensitive, strip(pred) == strip(gt)).otherwise(loose)
    return F.when(pred.isNull() & gt.isNull(), True).when(pred.isNull() | gt.isNull(), False).otherwise(out)


