"""Scores prediction files as they arrive, and keeps running failure counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meridian.operators.score import comparable, long_form, score_pairs
from meridian.sources.files import PREDICTIONS


def arriving(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(PREDICTIONS).option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(folder)


def score_stream(records: DataFrame, target: str, checkpoint: str, legacy: bool = False) -> StreamingQuery:
    """Writes the scores of each micro-batch to a folder of its own, so a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        scored = score_pairs(long_form(comparable(batch)), legacy=legacy)
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def failures_by_window(scored: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of labels in windows of event time; rows later than the watermark no longer count."""
    rows = scored.withWatermark(time, late).select(time, "model", F.explode("failures").alias("label"))
    return rows.groupBy(F.window(time, width), "model", "label").agg(F.count(F.lit(1)).alias("n"))
