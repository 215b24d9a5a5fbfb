"""Queries over streams, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.plans.demo import table
from limpid.sources.store import shared_folder
from limpid.streaming.profiles import event_stream, windowed_profile


def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly profiles of event values, computed by a stream over the events' files and read back from its sink."""
    like = table(spark, sf_dir, "events")
    stream = event_stream(spark, f"{sf_dir}/events.parquet*", like)
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/part={number}")

    # Update mode: each batch hands on the windows that it changed. No watermark, for files of one table may overlap in time: state is a row a window and type.
    profiled = windowed_profile(stream, "ts", "event_type", "value", late=None)
    query = profiled.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    written = spark.read.parquet(f"{base}/out").drop("part")
    values = ["rows", "missing", "low", "high", "total"]
    out = written.groupBy("start", "event_type").agg(F.max_by(F.struct(*values), "batch").alias("v")).select("start", "event_type", "v.*")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "rows", "missing", *[F.round(c, 4).alias(c) for c in ("low", "high", "total")])


QUERIES = {"stream_profile": stream_profile}
ORACLE = {
    "stream_profile": """SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS rows, count(*) - count(value) AS missing,
        round(min(value), 4) AS low, round(max(value), 4) AS high, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
