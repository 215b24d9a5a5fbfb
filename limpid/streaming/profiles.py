"""Profiles and run logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_at_once: int = 1) -> DataFrame:
    """Parquet files of a folder as they arrive, with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_profile(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """Counts, missing values and moments of a column by key and tumbling window; later events than ``late`` drop out.

    With ``late`` None no event is too late, and all windows stay open: for a
    stream over a finished table, whose files come in any order. The same expression serves a batch table. Times without a zone are read in the session's.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return (timed if late is None else timed.withWatermark(time, late)).groupBy(F.window(time, window).alias("w"), key).agg(
        F.count("*").alias("rows"), F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"),
    ).select(F.col("w.start").alias("start"), key, "rows", "missing", "low", "high", "total")


def latest_steps(trace: DataFrame) -> DataFrame:
    """The last state of each (column, step) of a run log: the last writer wins."""
    return trace.groupBy("column", "step").agg(F.max_by(F.struct("status", "note"), "at").alias("s"), F.max("at").alias("at")).select("column", "step", "s.*", "at")


def trace_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A run log's JSON lines as they are appended in new files; lines that do not parse are skipped."""
    lines = spark.readStream.schema("value string").text(folder)
    parsed = F.from_json("value", "column string, step string, status string, note string, at long", {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("t")).where("t.step is not null").select("t.*")
