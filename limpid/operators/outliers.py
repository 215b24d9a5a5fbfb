"""Outliers by the modified z-score, robust against the outliers themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.numbers import to_number
from limpid.functions.text import shortened
from limpid.operators.ranks import median

THRESHOLD = 5.0
FACTOR = 0.6745
LEAST_ROWS = 10


def center(df: DataFrame, column: str) -> tuple[float | None, float | None, int]:
    """Median, median absolute deviation (both exact and interpolated) and number of the values that read as numbers."""
    x = df.select(to_number(F.col(f"`{column}`")).alias("x")).where("x is not null and not isnan(x)")
    n = x.count()
    middle = median(x, F.col("x"), n=n)
    mad = None if middle is None else median(x, F.abs(F.col("x") - F.lit(middle)), n=n)
    return middle, mad, n


def outlier_rows(df: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose value is an outlier, with its number as ``__x``.

    None with fewer than ten numbers, or where at least half of them are equal
    (no spread to measure by).
    """
    middle, mad, n = center(df, column)
    valued = df.withColumn("__x", to_number(F.col(f"`{column}`")))
    if n < LEAST_ROWS or not mad:
        return valued.limit(0)
    return valued.where(F.abs(FACTOR * (F.col("__x") - F.lit(middle)) / F.lit(mad)) > threshold)


def outliers(df: DataFrame, rid: str, column: str) -> DataFrame:
    """``value, n, first_rid``: distinct outliers and how often they occur."""
    return outlier_rows(df, column).groupBy(F.col("__x").alias("value")).agg(F.count("*").alias("n"), F.min(rid).alias("first_rid"))


def outlier_context(df: DataFrame, rid: str, column: str, rows: int = 2) -> DataFrame:
    """The first ``rows`` rows of each outlier value, long texts cut, with the value as ``outlier``."""
    ranked = outlier_rows(df, column).withColumn("__r", F.row_number().over(Window.partitionBy("__x").orderBy(rid))).where(F.col("__r") <= rows)
    return ranked.select(F.col("__x").alias("outlier"), *[shortened(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
