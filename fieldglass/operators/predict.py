"""Prompts, baseline predictors, and a pluggable protocol for model backends."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .domains import DOMAINS, fields, label_table

# Names of kinds as they are shown, the model list, and the words of a rate limit.
SHOWN = {"date": "date (YYYY-MM-DD)", "time": "time (HH:MM)", "currency": "string (ISO-4217)", "frequency": "string"}
BASELINES = {"R00": "always_null", "R01": "regex_rules"}
MODELS = {"R02": ("llama-3.1-8b-instruct", "ollama"), "R03": ("gpt-4o-2024-08-06", "openai"), "R04": ("claude-3-5-sonnet-20241022", "anthropic"), "R06": ("llama3.2", "ollama"), "R07": ("phi3.5", "ollama"), "R08": ("mistral", "ollama"), "R09": ("qwen2.5:7b", "ollama"), "R10": ("llama-3.3-70b-versatile", "openai")}
LIMITS = ["rate limit", "429", "too many requests", "quota", "tokens per day", "tokens per minute"]
DEFAULTS = {"temperature": 0, "max_tokens": 1024, "max_retries": 3, "backoff_base_seconds": 2}
LABEL_LINE = r"^\s*([A-Za-z][\w\s./()'-]*?)\s*[:=|]\s*(.+?)\s*$"
TASK_TEXT = {
    "extraction": "Find every field of the schema that the text holds.",
    "normalization": "Find every field and write its value in canonical form.",
    "correction": "The text has misread characters; give each field's corrected value.",
    "hallucination": "Give only values that the text supports; leave out what it doesn't say.",
    "schema": "Find every field and keep to the schema's names, nesting and types.",
}
TEMPLATE = "Extract data from a scanned {DOMAIN} document.\n{TASK_INSTRUCTION}\nAnswer with one JSON object of this shape:\n{SCHEMA}\nText:\n{OCR_TEXT}"
PLACEHOLDERS = ("{TASK_INSTRUCTION}", "{SCHEMA}", "{OCR_TEXT}")


def schema_text(domain: str) -> str:
    """The domain's schema as indented JSON: kind, format, and whether a field may be null or left out."""
    import json

    out: dict = {}
    for f in fields(domain):
        at = out
        for part in f.path.split(".")[:-1]:
            at = at.setdefault(part, {})
        at[f.path.rpartition(".")[2]] = f"{SHOWN.get(f.kind, f.kind)} | {'null' if f.required else 'omit if absent'}"
    return json.dumps(out, indent=2)


def check_template(template: str) -> None:
    missing = [p for p in PLACEHOLDERS if p not in template]
    if missing:
        raise ValueError(f"the template lacks {', '.join(missing)}")


def prompts(samples: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Adds prompt and prompt_hash (8 hex digits of SHA-256) to samples (domain, task, ocr_text)."""
    check_template(template)
    spark = samples.sparkSession
    shapes = spark.createDataFrame([(d, schema_text(d)) for d in DOMAINS], "domain string, _schema string")
    tasks = spark.createDataFrame(list(TASK_TEXT.items()), "task string, _task string")
    out = samples.join(F.broadcast(shapes), "domain").join(F.broadcast(tasks), "task")
    text = F.replace(F.lit(template), F.lit("{DOMAIN}"), F.col("domain"))
    for name, c in (("{TASK_INSTRUCTION}", "_task"), ("{SCHEMA}", "_schema"), ("{OCR_TEXT}", "ocr_text")):
        text = F.replace(text, F.lit(name), F.col(c))
    return out.withColumn("prompt", text).withColumn("prompt_hash", F.substring(F.sha2("prompt", 256), 1, 8)).drop("_schema", "_task")


def labelled_values(samples: DataFrame) -> DataFrame:
    """(id, path, value): for each field the first line whose label is one of its own. The label list is a fixed 150 rows."""
    text_line = F.posexplode(F.split("ocr_text", "\n")).alias("place", "line")
    found = samples.select("id", "domain", text_line).where(F.col("line").rlike(LABEL_LINE))
    found = found.select("id", "domain", "place", F.lower(F.regexp_extract("line", LABEL_LINE, 1)).alias("label"), F.regexp_extract("line", LABEL_LINE, 2).alias("value"))
    known = F.broadcast(label_table(samples.sparkSession))
    return found.join(known, ["domain", "label"]).groupBy("id", "path").agg(F.min_by("value", "place").alias("value"))


def nested_json(paths: Column) -> Column:
    """JSON of array<struct<path, value>> with one level of sections; values as strings."""
    flat = F.filter(paths, lambda e: ~F.contains(e["path"], F.lit(".")))
    deep = F.filter(paths, lambda e: F.contains(e["path"], F.lit(".")))
    sections = F.array_sort(F.array_distinct(F.transform(deep, lambda e: F.substring_index(e["path"], ".", 1))))
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    pair = lambda name, value: F.concat(quote(name), F.lit(":"), value)
    inner = lambda s: F.concat(F.lit("{"), F.array_join(F.transform(F.filter(deep, lambda e: F.substring_index(e["path"], ".", 1) == s), lambda e: pair(F.substring(e["path"], F.length(s) + 2, F.length(e["path"])), quote(e["value"]))), ","), F.lit("}"))
    parts = F.concat(F.transform(flat, lambda e: pair(e["path"], quote(e["value"]))), F.transform(sections, lambda s: pair(s, inner(s))))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def regex_rules(samples: DataFrame) -> DataFrame:
    """Adds model_output: labelled values as nested JSON, {} where there are none."""
    found = labelled_values(samples).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("path", "value"))).alias("_found"))
    out = samples.join(found, "id", "left")
    return out.withColumn("model_output", F.coalesce(nested_json(F.col("_found")), F.lit("{}"))).drop("_found")


def always_null(samples: DataFrame) -> DataFrame:
    return samples.withColumn("model_output", F.lit("{}"))


#: A fixed answer per domain, by which a run can be tried without a model.
MOCK = {
    "receipts": '{"vendor_name": "Trial Shop", "date": "2024-01-02", "total_amount": 10.5, "currency": "INR"}',
    "insurance": '{"policyholder": {"name": "Trial Name", "dob": "1990-01-02"}, "policy": {"policy_number": "T-1"}, "premium": {"amount": 100, "currency": "INR"}}',
    "hospital": '{"patient": {"name": "Trial Name", "dob": "1990-01-02"}, "visit": {"date": "2024-01-02", "reason_for_visit": "trial"}}',
}


def mock(samples: DataFrame) -> DataFrame:
    return samples.withColumn("model_output", F.coalesce(*[F.when(F.col("domain") == d, F.lit(t)) for d, t in MOCK.items()], F.lit("{}")))


PREDICTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"always_null": always_null, "regex_rules": regex_rules}


def predictor(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in PREDICTORS:
        raise ValueError(f"unknown baseline {name!r}; there are {', '.join(sorted(PREDICTORS))}")
    return PREDICTORS[name]


@dataclass
class Call:
    """What a backend's answer to one prompt is kept as."""

    text: str
    latency_ms: int
    success: bool
    error: str | None


TRANSIENT = ("rate limit", "rate_limit", "429", "timeout", "timed out", "connection", "503", "overloaded")


def call(backend: Callable[[str], str], prompt: str, max_retries: int = 3, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Call:
    """Calls a backend; errors that name a passing cause are tried again after base, base^2, base^3 seconds; others are kept."""
    began = time.time()
    for n in range(max_retries + 1):
        try:
            return Call(backend(prompt), int(1000 * (time.time() - began)), True, None)
        except Exception as e:  # a backend may raise anything; the record keeps what it said
            if n == max_retries or not any(t in str(e).lower() for t in TRANSIENT):
                return Call("", int(1000 * (time.time() - began)), False, f"{type(e).__name__}: {e}")
            sleep(base ** (n + 1))
    raise AssertionError


def predict(samples: DataFrame, make_backend: Callable[[], Callable[[str], str]], model: str, backend: str, max_retries: int = 3, base: float = 2.0) -> DataFrame:
    """Calls a model for each prompt, in partitions: (id, prompt_hash, model, backend, latency_ms, success, error, model_output).

    `make_backend` is called once a partition and gives a function of a prompt; network clients live there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make_backend()
        for batch in batches:
            got = [call(ask, p, max_retries, base) for p in batch["prompt"]]
            yield pd.DataFrame({"id": batch["id"], "prompt_hash": batch["prompt_hash"], "model": model, "backend": backend, "latency_ms": [c.latency_ms for c in got], "success": [c.success for c in got], "error": [c.error for c in got], "model_output": [c.text for c in got]})

    asked = prompts(samples).select("id", "prompt", "prompt_hash")
    return asked.mapInPandas(run, "id string, prompt_hash string, model string, backend string, latency_ms int, success boolean, error string, model_output string")


def model_settings(run_id: str, **own) -> dict:
    """The settings of a run: defaults, then the model of the run id, then what is given."""
    if run_id in BASELINES:
        return DEFAULTS | {"name": BASELINES[run_id], "backend": "hardcoded"} | own
    if run_id not in MODELS:
        raise ValueError(f"unknown run {run_id!r}")
    name, backend = MODELS[run_id]
    return DEFAULTS | {"name": name, "backend": backend} | own


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a prediction yet."""
    return samples.join(done.select("id").distinct(), "id", "left_anti")


def chosen(samples: DataFrame, n: int | None = None, seed: int = 42, **equal: str | None) -> DataFrame:
    """The samples of a split, domain, difficulty or task (as far as given), and of these n by the order of a hash."""
    from ..sources.records import sample_n

    for name, value in equal.items():
        if value is not None:
            samples = samples.where(F.col(name) == value)
    return sample_n(samples, n, seed) if n is not None else samples


def limited(error: Column) -> Column:
    """Whether a call failed because the service has had enough for now."""
    out = F.lit(False)
    for words in LIMITS:
        out = out | F.contains(F.lower(F.coalesce(error, F.lit(""))), F.lit(words))
    return out


def run(spark: SparkSession, samples: DataFrame, run_id: str, out_dir: str, dry_run: bool = False, resume: bool = False, make_backend: Callable[[], Callable[[str], str]] | None = None, **filters) -> DataFrame:
    """Predicts what `out_dir` doesn't hold yet (if resumed), appends it there, and returns all of its predictions.

    filters: split, domain, difficulty, task and n, as in chosen(). Runs that aren't a baseline need `make_backend`, the client
    of their model; a call that a rate limit ended isn't saved, so that a resumed run asks again. With dry_run fixed answers
    stand for all calls. The prompt's hash is kept with every answer.
    """
    from ..sources.records import append_predictions, completed, write_run_config

    settings = model_settings(run_id)
    samples = chosen(samples, **filters)
    if resume:
        samples = pending(samples, completed(spark, out_dir))
    write_run_config(spark, out_dir, {"run_id": run_id, "model": settings["name"], **settings, "filters": filters, "dry_run": dry_run})
    if "task" not in samples.columns:
        samples = samples.withColumn("task", F.lit("extraction"))
    if dry_run or settings["backend"] == "hardcoded":
        got = prompts((mock if dry_run else predictor(settings["name"]))(samples)).drop("prompt")
        backend = "dry_run" if dry_run else settings["backend"]
        got = got.withColumns({"model": F.lit(settings["name"]), "backend": F.lit(backend), "latency_ms": F.lit(0), "success": F.lit(True), "error": F.lit(None).cast("string")})
    elif make_backend is None:
        raise ValueError(f"run {run_id!r} needs a client for {settings['backend']}")
    else:
        from ..plans.run import cut

        asked = cut(predict(samples, make_backend, settings["name"], settings["backend"], settings["max_retries"], settings["backoff_base_seconds"]))
        got = samples.join(asked.where(F.col("success") | ~limited(F.col("error"))), "id")
    return append_predictions(got, out_dir)
