"""JSON objects out of model answers: a cascade of attempts; the first three are native, the rest runs on what they leave."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

_PREFIX = re.compile(r"\A[^{\[]*?(?::|,|!|\n)\s*(?=\{)", re.S)
#: A quoted key of word characters and dots, and a string, number, true, false or null.
_PAIR = re.compile(r'"([\w.]+)"\s*:\s*("(?:[^"\\]|\\.)*"|true|false|null|-?\d+(?:\.\d+)?)', re.S)
FENCE = r"(?s)```(?:[A-Za-z]*)\s*\n?(.*?)```"


def repaired(c: Column) -> Column:
    """Trailing commas dropped, single quotes doubled where there is no other, Python's words for null, true and false replaced."""
    t = F.regexp_replace(c, r",\s*([}\]])", "$1")
    t = F.when(F.contains(t, F.lit('"')), t).otherwise(F.replace(t, F.lit("'"), F.lit('"')))
    for word, to in (("None", "null"), ("True", "true"), ("False", "false")):
        t = F.regexp_replace(t, rf"\b{word}\b", to)
    return t


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def _whole(c: Column) -> Column:
    """The text if it is an object, as it stands or repaired."""
    t = strip(c)
    return F.when(is_object(t), t).when(is_object(repaired(t)), repaired(t))


def _load(text: str) -> dict | None:
    for fix in (False, True):
        t = text.strip()
        if fix:
            t = re.sub(r",\s*([}\]])", r"\1", t)
            t = t if '"' in t else t.replace("'", '"')
            for word, to in (("None", "null"), ("True", "true"), ("False", "false")):
                t = re.sub(rf"\b{word}\b", to, t)
        try:
            found = json.loads(t)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


def balanced(text: str) -> str | None:
    """The first {...} whose braces balance outside of strings."""
    at = text.find("{")
    if at < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : i + 1]
    return None


def pairs(text: str) -> dict | None:
    """At least two "key": value pairs; dotted keys nest, the last value wins."""
    found = _PAIR.findall(text)
    if len(found) < 2:
        return None
    out: dict = {}
    for key, raw in found:
        *path, leaf = key.strip().split(".")
        at = out
        for p in path:
            if not isinstance(at.get(p), dict):
                at[p] = {}
            at = at[p]
        at[leaf] = json.loads(raw, strict=False)
    return out


def salvage(text: str) -> tuple[str | None, str]:
    """(object, status) of a text that is no object: a balanced block, one behind a prefix, then single pairs."""
    for t in (text, _PREFIX.sub("", text, count=1)):
        if (block := balanced(t)) is not None and (found := _load(block)) is not None:
            return json.dumps(found, ensure_ascii=False), "success"
    try:
        found = pairs(text)
    except ValueError:
        found = None
    return (json.dumps(found, ensure_ascii=False), "partial") if found else (None, "failure")


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("status", T.StringType())]))
def _salvaged(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([salvage(t) if t is not None else (None, None) for t in text], columns=["json", "status"])


def coerce(c: Column) -> Column:
    """struct(json, status): the answer's object as JSON text, and success, partial or failure. Null and blank fail."""
    blocks = F.regexp_extract_all(c, F.lit(FENCE), F.lit(1))
    inner = F.get(F.filter(F.transform(blocks, _whole), lambda x: x.isNotNull()), F.lit(0))
    native = F.coalesce(_whole(c), inner)
    blank = F.coalesce(strip(c), F.lit("")) == ""
    rest = _salvaged(F.when(native.isNull() & ~blank, c))
    return F.struct(F.coalesce(native, rest["json"]).alias("json"), F.when(blank, "failure").when(native.isNotNull(), "success").otherwise(rest["status"]).alias("status"))


class _Number(str):
    """A number as it is written."""


def _shown(value) -> str:
    """JSON text of a value, numbers as they were written."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return f"[{','.join(map(_shown, value))}]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_shown(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def flat(text: str, prefix: str = "") -> list[tuple[str, str | None]]:
    """(path, value) of the leaves of a JSON object of any depth, values as text; the last of equal names stays."""
    stack, out = [(prefix, json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number))], []
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}.{k}" if path else k, v) for k, v in reversed(value.items()))
        else:
            out.append((path, value if value is None or isinstance(value, str) else _shown(value)))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def _flat(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else [{"path": p, "value": v} for p, v in flat(t)] for t in text])


#: Levels of objects that are taken apart natively; answers with deeper ones go to Arrow.
NATIVE_LEVELS = 4


def leaves(c: Column) -> Column:
    """array<struct<path, value>> of a JSON object's leaves, paths dotted; lists stay leaf values, empty objects give nothing.

    A JSON null is a leaf with a null value. Objects may be of any depth; the rare ones deeper than NATIVE_LEVELS are taken
    apart in Arrow batches, to which all others pass null.
    """
    parsed = lambda text: F.from_json(text, "map<string,string>")
    nested = lambda value: F.coalesce(value.startswith("{") & is_object(value), F.lit(False))

    def level(text: Column, prefix: Column, left: int) -> Column:
        entries = F.map_entries(parsed(text))

        def one(e: Column) -> Column:
            path = F.concat(prefix, e["key"])
            leaf = F.array(F.struct(path.alias("path"), e["value"].alias("value")))
            if not left:
                return leaf
            inner = level(e["value"], F.concat(path, F.lit(".")), left - 1)
            return F.when(nested(e["value"]), inner).otherwise(leaf)

        return F.flatten(F.transform(entries, one))

    # without its strings, an object of so many levels is gone after as many removals of innermost objects
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"', "")
    for _ in range(NATIVE_LEVELS):
        bare = F.regexp_replace(bare, r"\{[^{}]*\}", "")
    deep = F.when(F.regexp_count(c, F.lit("[{]")) > NATIVE_LEVELS, F.contains(bare, F.lit("{")))
    return F.coalesce(_flat(F.when(deep, c)), level(c, F.lit(""), NATIVE_LEVELS - 1))
