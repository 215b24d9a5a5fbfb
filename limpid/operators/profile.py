"""Column profiles: counts, top values, histograms, shapes and semantic types.

Most questions are answered from one table of value counts in long form
(column, value, n, first row), which a single grouped aggregate makes for all
columns at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.kinds import value_kind, zero_one
from limpid.functions.text import signature
from limpid.operators.ranks import FEW_VALUES, median

BINS = 16
FLOAT_SHARE = 0.05
ZERO_ONE_SHARE = 0.95
SHAPE_ROWS = 3000
SHAPE_SHARE = 0.2
SHAPES = 3


def unpivoted(df: DataFrame, rid: str, columns: list[str] | None = None) -> DataFrame:
    """``rid, column, value``: one row for each cell, values as text."""
    columns = columns or [c for c in df.columns if c != rid]
    return df.select(F.col(rid).alias("rid"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot("rid", columns, "column", "value")


def value_counts(df: DataFrame, rid: str, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n, first_rid`` over the cells that are not missing."""
    return unpivoted(df, rid, columns).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"))


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest values of each column with their share of the cells present; ties by first appearance."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first_rid")
    totals = counts.groupBy("column").agg(F.sum("n").alias("present"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(totals), "column").select("column", "rank", "value", "n", F.round(F.col("n") / F.col("present") * 100, 1).alias("pct"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, missing, present, distinct, missing_pct, unique_pct, uniqueness``; all columns in one aggregate.

    ``unique_pct`` is of the cells present; ``uniqueness`` counts a missing
    value as one more and is of all rows.
    """
    aggs = []
    for c in columns:
        x = F.col(f"`{c}`")
        aggs += [F.count_if(x.isNull()).alias(f"{c}#missing"), F.count_distinct(x).alias(f"{c}#distinct")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}#missing`").alias("missing"), F.col(f"`{c}#distinct`").alias("distinct")) for c in columns])
    x = one.select("rows", F.explode(cells).alias("s")).select("rows", "s.*").withColumn("present", F.col("rows") - F.col("missing"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return x.select(
        "column",
        "missing",
        "present",
        "distinct",
        F.round(ratio(F.col("missing"), F.col("rows")) * 100, 4).alias("missing_pct"),
        F.round(ratio(F.col("distinct"), F.col("present")) * 100, 4).alias("unique_pct"),
        F.round(ratio(F.col("distinct") + (F.col("missing") > 0).cast("long"), F.col("rows")), 6).alias("uniqueness"),
    )


def repetition(counts: DataFrame) -> DataFrame:
    """``column, repeated_values, repeated_rows``: shares of values, and of rows, that occur more than once."""
    return counts.groupBy("column").agg(
        (F.count_if(F.col("n") > 1) / F.count("*")).alias("repeated_values"),
        (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated_rows"),
    )


def numeric_stats(df: DataFrame, columns: list[str], few: int = FEW_VALUES) -> DataFrame:
    """``column, low, high, span, mean, median, std`` (population) of numeric columns; NaN counts as missing.

    One aggregate counts the values of all columns, a second one has all that
    is asked; only medians of more than ``few`` values are closed in on by passes of their own.
    """
    x = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    sizes = df.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x.values())]).first()
    stats = []
    for i, (c, v) in enumerate(x.items()):
        middle = F.median(v) if sizes[f"n{i}"] <= few else F.lit(median(df, v, few, sizes[f"n{i}"])).cast("double")
        stats.append(F.struct(F.lit(c).alias("column"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("span"), F.avg(v).alias("mean"), middle.alias("median"), F.stddev_pop(v).alias("std")))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """``bin, low, high, n, height_pct`` over equal, right-closed bins, the first of which holds the least value.

    A column with one value has it in the middle of bins around it.
    """
    x = df.select(F.col(f"`{column}`").cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    margin = F.when(F.col("a") == F.col("b"), F.when(F.col("a") == 0, 0.001).otherwise(F.abs("a") * 0.001)).otherwise(0.0)
    ends = ends.select((F.col("a") - margin).alias("a"), (F.col("b") + margin).alias("b")).withColumn("w", (F.col("b") - F.col("a")) / bins)
    placed = x.crossJoin(F.broadcast(ends)).select(F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("a")) / F.col("w")))).cast("int").alias("bin"))
    counted = placed.groupBy("bin").agg(F.count("*").alias("n"))
    every = ends.select("a", "w", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    full = every.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    most = full.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    return full.crossJoin(F.broadcast(most)).select("bin", (F.col("a") + (F.col("bin") - 1) * F.col("w")).alias("low"), (F.col("a") + F.col("bin") * F.col("w")).alias("high"), "n", F.greatest(F.lit(8), F.floor(F.col("n") / F.col("most") * 100).cast("int")).alias("height_pct"))


def shapes(df: DataFrame, rid: str, column: str, rows: int = SHAPE_ROWS) -> DataFrame:
    """``pattern, n, pct``: up to three shapes that a fifth of the first values or more have.

    Where no shape is that common, one broad pattern: letters only, if a fifth
    are, else any text, with the lengths met.
    """
    first = df.where(F.col(f"`{column}`").isNotNull()).orderBy(rid).limit(rows).select(F.col(rid).alias("rid"), F.col(f"`{column}`").cast("string").alias("v"))
    total = first.agg(F.count("*").alias("total"))
    each = first.groupBy(signature(F.col("v")).alias("pattern")).agg(F.count("*").alias("n"), F.min("rid").alias("first_rid")).crossJoin(F.broadcast(total))
    common = each.where(F.col("n") >= SHAPE_SHARE * F.col("total")).orderBy(F.desc("n"), "first_rid").limit(SHAPES).select("pattern", "n", F.round(F.col("n") / F.col("total") * 100, 1).alias("pct"))
    length = F.char_length("v")
    alpha = F.col("v").rlike("^[A-Za-z]+$")
    broad = first.agg(F.count("*").alias("total"), F.count_if(alpha).alias("na"), F.min(F.when(alpha, length)).alias("a"), F.max(F.when(alpha, length)).alias("b"), F.count_if(length > 0).alias("nl"), F.min(F.when(length > 0, length)).alias("c"), F.max(length).alias("d"))
    letters = F.col("na") >= SHAPE_SHARE * F.col("total")
    n = F.when(letters, F.col("na")).otherwise(F.col("nl"))
    pattern = F.when(letters, F.format_string("^[A-Za-z]{%d,%d}$", "a", "b")).otherwise(F.format_string("^.{%d,%d}$", "c", "d"))
    wide = broad.where((F.col("total") > 0) & (n >= SHAPE_SHARE * F.col("total"))).select(pattern.alias("pattern"), n.alias("n"), F.round(n / F.col("total") * 100, 1).alias("pct"))
    any_common = common.agg((F.count("*") > 0).alias("found"))
    return common.unionByName(wide.crossJoin(F.broadcast(any_common)).where("not found").drop("found"))


def kind_votes(counts: DataFrame) -> DataFrame:
    """``column, kind, n, first_rid``: how many cells are of each kind. Kinds are told once for each distinct value."""
    return counts.withColumn("kind", value_kind(F.col("value"))).where("kind is not null").groupBy("column", "kind").agg(F.sum("n").alias("n"), F.min("first_rid").alias("first_rid"))


def semantic_types(counts: DataFrame, columns: list[str]) -> DataFrame:
    """``column, semantic_type``: the majority kind in upper case, ties by first appearance.

    A column of 0 and 1 is BOOLEAN; integers with more than one float in twenty
    are FLOAT; a column with no value, or none but blanks, is EMPTY.
    """
    binary = counts.groupBy("column").agg((F.sum(F.when(zero_one(F.col("value")), F.col("n")).otherwise(0)) / F.sum("n")).alias("binary_share"))
    votes = kind_votes(counts)
    totals = votes.groupBy("column").agg((F.sum(F.when(F.col("kind") == "float", F.col("n")).otherwise(0)) / F.sum("n")).alias("float_share"))
    first = votes.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first_rid"))).where("r = 1")
    every = counts.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    joined = every.join(F.broadcast(binary), "column", "left").join(F.broadcast(totals), "column", "left").join(F.broadcast(first.select("column", "kind")), "column", "left")
    kind = (
        F.when(F.col("binary_share") > ZERO_ONE_SHARE, "BOOLEAN")
        .when(F.col("kind").isNull(), "EMPTY")
        .when((F.col("kind") == "integer") & (F.col("float_share") > FLOAT_SHARE), "FLOAT")
        .otherwise(F.upper("kind"))
    )
    return joined.select("column", kind.alias("semantic_type"))
