"""Exact medians, ranks and numbers of tables of any size.

Nothing here gathers a column in one task. A rank is found by histograms that
close in on it: each pass counts a few thousand bins, and goes on within the
bin that holds the rank. Rows are numbered in buckets of a bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a pass, and values that may be sorted on the driver at its end.
BINS = 4096
#: Columns of so many values may be held in one task as a map of their values.
FEW_VALUES = 1_000_000
#: Rows that are sorted together while a table is numbered.
BUCKET_ROWS = 1_000_000


def kth_smallest(values: DataFrame, x: Column, k: int, bins: int = BINS) -> float | int | None:
    """The k-th smallest value (from 1) of a numeric expression, nulls and NaN left out; None if there are fewer."""
    present = values.select(x.alias("x")).where("x is not null and not isnan(x)")
    low, high, n = present.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        inside = present.where(F.col("x").between(F.lit(low), F.lit(high)))
        if n <= bins:
            return sorted(r["x"] for r in inside.collect())[k - 1]
        width = high / bins - low / bins
        place = F.least(F.lit(bins - 1), F.floor((F.col("x").cast("double") - F.lit(float(low))) / F.lit(width))) if width > 0 else F.when(F.col("x") > F.lit(low), 1).otherwise(0)
        counted = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).orderBy("a").collect()  # a row a bin
        for r in counted:
            if k <= r["n"]:
                if (r["a"], r["b"]) == (low, high):  # all in one bin: values too close for it, so halve by value
                    middle = low + (high - low) / 2
                    below = inside.where(F.col("x") <= F.lit(middle)).agg(F.count("*"), F.max("x")).first()
                    if not below[0] or below[1] == high:
                        return low if k <= inside.where(F.col("x") == F.lit(low)).count() else high
                    if k <= below[0]:
                        high, n = below[1], below[0]
                    else:
                        k, n = k - below[0], r["n"] - below[0]
                        low = inside.where(F.col("x") > F.lit(middle)).agg(F.min("x")).first()[0]
                else:
                    low, high, n = r["a"], r["b"], r["n"]
                break
            k -= r["n"]
    return low


def median(values: DataFrame, x: Column, few: int = FEW_VALUES, n: int | None = None) -> float | None:
    """The exact, interpolated median of a numeric expression; nulls and NaN left out, None without values.

    Up to ``few`` values are aggregated as Spark does, which holds a map of
    them in one task; more are closed in on. ``n`` is their number, where it is known.
    """
    x = F.when(~F.isnan(x), x)
    n = values.agg(F.count(x)).first()[0] if n is None else n
    if n <= few:
        return values.agg(F.median(x)).first()[0]
    lower = kth_smallest(values, x, (n + 1) // 2)
    if n % 2:
        return float(lower)
    upto, above = values.agg(F.count_if(x <= F.lit(lower)), F.min(F.when(x > F.lit(lower), x))).first()
    return float(lower) if upto > n // 2 else (float(lower) + float(above)) / 2


def numbered(df: DataFrame, by: str, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with its rows numbered from 1 in the order of a numeric column without nulls or ties.

    Buckets are cut at approximate quantiles; numbers are exact whatever the
    cuts are, for each bucket starts from the count of those before it.
    """
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    cuts = sorted(set(df.approxQuantile(by, [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(by))) if cuts else F.lit(0)
    placed = df.withColumn("__bucket", bucket)
    before, begins = 0, []
    for r in placed.groupBy("__bucket").count().orderBy("__bucket").collect():  # a row a bucket
        begins.append((r["__bucket"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(begins, "__bucket int, __before long")
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(by))
    return placed.withColumn(name, own).join(F.broadcast(offsets), "__bucket").withColumn(name, F.col(name) + F.col("__before")).drop("__bucket", "__before")
