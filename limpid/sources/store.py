"""Tables that a plan reads more than once, written to a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder; on
    a cluster, whose machines share no such folder, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="limpid-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Like checkpoint files, what is written stays there until its owner clears it.
    """
    path = f"{shared_folder(df.sparkSession)}/limpid-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
