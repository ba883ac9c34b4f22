"""Text helpers and hash-based random numbers, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that str.strip() removes and that occurs in practice.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the values of its parts alone: the same in every run, partitioning and SQL engine."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draw(seed: int, turn: Column, place: Column, n: Column) -> Column:
    """A whole number from 0 to n - 1 (n up to 2^31) for a turn and a place, by integer mixing that any SQL engine repeats; some
    hundred times cheaper than uniform(), for resampling."""
    mask = F.lit((1 << 31) - 1).cast("long")
    x = (turn.cast("long") * 747796405 + place.cast("long") * 277803737 + F.lit(seed * 961748941).cast("long")).bitwiseAND(mask)
    for shift, factor in ((16, 739982445), (15, 695872825)):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * factor).bitwiseAND(mask)
    return F.shiftright(x.bitwiseXOR(F.shiftright(x, 16)) * n.cast("long"), 31).cast("int")


def below(n: Column | int, *parts) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(*parts) * n).cast("int")


def between(low: int, high: int, *parts) -> Column:
    return (F.lit(low) + below(high - low + 1, *parts)).cast("int")


def pick(pool: list[str] | Column, *parts) -> Column:
    """An element of a non-empty pool; null for an empty array."""
    values = F.array(*[F.lit(v) for v in pool]) if isinstance(pool, list) else pool
    return F.try_element_at(values, F.greatest(below(F.size(values), *parts) + 1, F.lit(1)))


def by_weight(weights: dict[str, float], *parts) -> Column:
    """A key of `weights`, with a chance in proportion to its weight."""
    u, total, at, out = uniform(*parts) * sum(weights.values()), sum(weights.values()), 0.0, None
    for name, w in weights.items():
        at += w
        cond = u < min(at, total)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(list(weights)[-1])


def number_text(c: Column) -> Column:
    """A double as its shortest decimal text with a fraction (1234.5, 10000000.0), also where Spark would turn to exponents."""
    plain = F.regexp_replace(F.format_string("%.6f", c), r"(\.\d+?)0+$", "$1")
    return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).when((F.abs(c) < 1e-3) & (F.abs(c) >= 1e-4), plain).otherwise(c.cast("string"))


def four(c: Column) -> Column:
    """Four decimals. Nine come first: sums of doubles in another order differ in the last places, which mustn't decide a half."""
    return F.round(F.round(c, 9), 4)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(array: Column) -> Column:
    return F.array_join(array, "\n", "")
