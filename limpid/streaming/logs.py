"""Logs of runs as files that are only ever added to, and their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How many lines of a log are shown.
LAST_LINES = 500


def append_trace(steps: DataFrame, folder: str) -> None:
    """Adds steps of a run (``column, step, status, note, at``) to its log, as JSON lines in a new file."""
    steps.coalesce(1).write.mode("append").json(folder)


def append_log(spark: SparkSession, folder: str, lines: list[str]) -> None:
    """Adds lines, in their order, to a text log; line ends within a line become blanks."""
    text = [(line.replace("\r", " ").replace("\n", " "),) for line in lines]
    spark.createDataFrame(text, "value string").coalesce(1).write.mode("append").text(folder)


def last_lines(spark: SparkSession, folder: str, n: int = LAST_LINES) -> DataFrame:
    """``place, line``: the last n lines, from place 1 on: later files after earlier ones, and lines of a file as they stand.

    Only the n last lines of each partition leave it.
    """
    at = [F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    lines = spark.read.text(folder).select("value", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(at)]).alias("at"))
    last = lines.orderBy(F.desc("at")).limit(n).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("lines"))
    return last.select(F.posexplode("lines").alias("i", "l")).select((F.col("i") + 1).alias("place"), F.col("l.value").alias("line"))
