"""Reading and writing of samples, predictions and summaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.domains import DIFFICULTIES, DOMAINS, SPLITS, TASKS, TRACKS

SAMPLE = (
    "id string, domain string, difficulty string, track string, source_type string, split string, task string, raw_text string, ocr_text string, "
    "noise_tags array<string>, noise_valid boolean, gt map<string,string>, notes string"
)
PREDICTION = SAMPLE + ", prompt_hash string, model string, backend string, latency_ms int, success boolean, error string, model_output string"


def _checked(name: str, value: str | None, allowed) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} {value!r} isn't one of {', '.join(allowed)}")


def _file(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file on whatever storage the path names."""
    fs, where = _file(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read on the driver."""
    fs, where = _file(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
    finally:
        stream.close()


#: Where the samples of a track lie below the data folder.
TRACK_FOLDERS = {"synthetic": "", "real_ocr": "vision"}


def track_folder(path: str, track: str) -> str:
    _checked("track", track, TRACKS)
    return f"{path.rstrip('/')}/{TRACK_FOLDERS[track]}".rstrip("/")


def discover(spark: SparkSession, path: str, domain: str | None = None, difficulty: str | None = None, split: str | None = None, track: str = "synthetic") -> list[str]:
    """The files {domain}_{difficulty}_{split}.jsonl of a data folder, sorted: in a folder by domain, or else beside one another.

    Unknown names raise an error, as does a missing folder; names that aren't given stand for all.
    """
    for name, value, allowed in (("domain", domain, DOMAINS), ("difficulty", difficulty, DIFFICULTIES), ("split", split, SPLITS)):
        _checked(name, value, list(allowed))
    base = track_folder(path, track)
    if not _exists(spark, base):
        raise FileNotFoundError(base)
    name = f"{domain or '*'}_{difficulty or '*'}_{split or '*'}.jsonl"
    for pattern in (f"{base}/{domain or '*'}/{name}", f"{base}/{name}"):
        fs, where = _file(spark, pattern)
        if found := sorted(str(f.getPath()) for f in fs.globStatus(where) or []):
            return found
    return []


def read_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Samples of JSON-lines files; a damaged line raises an error, blank ones are skipped. No files give no rows."""
    if not files:
        return spark.createDataFrame([], SAMPLE)
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(files)


def write_samples(samples: DataFrame, path: str, format: str = "json") -> None:
    """Samples in folders by track, domain, difficulty and split, which later reads prune."""
    samples.write.mode("overwrite").partitionBy("track", "domain", "difficulty", "split").format(format).save(path)


def read_samples(spark: SparkSession, path: str, domain: str | None = None, difficulty: str | None = None, split: str | None = None, task: str | None = None, noise_tags: list[str] | None = None, track: str = "synthetic", n: int | None = None, seed: int = 42, format: str = "json") -> DataFrame:
    """Samples that pass all filters; `noise_tags` must all be there. With n, exactly n of them by the order of a hash.

    Damaged lines raise an error, blank ones are skipped. Unknown names and missing folders raise an error, as do too few rows.
    """
    for name, value, allowed in (("domain", domain, DOMAINS), ("difficulty", difficulty, DIFFICULTIES), ("split", split, SPLITS), ("track", track, TRACKS), ("task", task, TASKS["easy"])):
        _checked(name, value, list(allowed))
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(SAMPLE)
    out = (reader.option("mode", "FAILFAST") if format == "json" else reader).format(format).load(path)
    for name, value in (("track", track), ("domain", domain), ("difficulty", difficulty), ("split", split), ("task", task)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if noise_tags:
        out = out.where(F.size(F.array_except(F.array(*[F.lit(t) for t in noise_tags]), "noise_tags")) == 0)
    return sample_n(out, n, seed) if n is not None else out


def sample_n(rows: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Exactly n rows, the first by a hash of seed and id."""
    there = rows.count()
    if n > there:
        raise ValueError(f"{n} rows asked for, {there} there")
    return rows.orderBy(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)


def append_predictions(rows: DataFrame, path: str) -> DataFrame:
    """Adds predictions to a run's folder; a run that is stopped keeps what was written."""
    rows.write.mode("append").parquet(f"{path}/predictions")
    return read_predictions(rows.sparkSession, path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/predictions"):
        raise FileNotFoundError(f"{path}/predictions")
    return spark.read.parquet(f"{path}/predictions")


def read_prediction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as JSON lines; a damaged line raises an error."""
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """Ids that a run has predicted; none if it hasn't begun. JSON lines that are damaged are passed over."""
    if _exists(spark, f"{path}/predictions"):
        return spark.read.parquet(f"{path}/predictions").select("id").distinct()
    if _exists(spark, f"{path}/predictions.jsonl"):
        return spark.read.schema("id string").option("mode", "DROPMALFORMED").json(f"{path}/predictions.jsonl").select("id").distinct()
    return spark.createDataFrame([], "id string")


def write_run_config(spark: SparkSession, path: str, settings: dict) -> None:
    write_text(spark, f"{path}/run_config.json", json.dumps(settings, indent=2, default=str))


def read_run_config(spark: SparkSession, path: str) -> dict:
    """A run's settings; none if it has none."""
    return json.loads(read_text(spark, f"{path}/run_config.json")) if _exists(spark, f"{path}/run_config.json") else {}


def write_evaluated(spark: SparkSession, found: DataFrame, path: str) -> DataFrame:
    """A run's evaluated predictions as JSON lines beside its predictions, read back."""
    found.write.mode("overwrite").json(f"{path}/evaluated_predictions.jsonl")
    return spark.read.schema(found.schema).json(f"{path}/evaluated_predictions.jsonl")


def read_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """The summaries below a pattern such as runs/*/summary.json; unreadable ones are left out."""
    schema = "model string, backend string, split string, n_records long, timestamp_utc string, metrics map<string,double>, failure_modes map<string,long>, _corrupt_record string"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern).withColumn("run_id", F.element_at(F.split(F.input_file_name(), "/"), -2))
    return found.where("_corrupt_record IS NULL").drop("_corrupt_record")


def snapshot(spark: SparkSession, run_dir: str, to: str, names: tuple[str, ...] = ("run_config.json", "summary.json", "report.html")) -> list[str]:
    """Copies a run's small artefacts and returns those that were there."""
    there = [n for n in names if _exists(spark, f"{run_dir}/{n}")]
    for n in there:
        write_text(spark, f"{to}/{n}", read_text(spark, f"{run_dir}/{n}"))
    return there
