"""Scoring of predictions as they arrive, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import evaluate


def score_stream(predictions: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scores a stream of predictions batch by batch into a Parquet table; an id that came before is left out, which is how a
    run resumes. A batch that is run again after a failure overwrites its own folder."""

    def batch(rows: DataFrame, n: int) -> None:
        evaluate(rows).drop("schema").write.mode("overwrite").parquet(f"{out_dir}/batch={n}")

    writer = predictions.dropDuplicates(["id"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
