"""Exact, repeatable samples.

A row's place in a sample is the hash of a seed and its id, so the same seed
gives the same sample on any cluster, and the k rows with the smallest hashes
are found without a sort of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.kinds import is_datetime
from limpid.functions.numbers import to_number
from limpid.functions.text import noise_mask
from limpid.operators.ranks import kth_smallest, median

#: What a profile looks at: all of a small table, else a bounded number of rows.
ALL_CELLS, ALL_ROWS, MOST_ROWS, FEWEST_ROWS = 50_000, 1_500, 1_000, 100
#: Rows of a clean column that a review looks at.
CLEAN_REVIEW = 12


def seed_of(seed: int, *keys: str) -> str:
    """The text that a draw is keyed by: draws for distinct keys are independent."""
    return "|".join([str(seed), *keys])


def place(rid: Column, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), rid.cast("string")))


def sample(df: DataFrame, rid: str, n: int, seed: str) -> DataFrame:
    """Exactly ``min(n, rows)`` rows of ``df``."""
    return df.orderBy(place(F.col(rid), seed), rid).limit(n)


def profile_rows(df: DataFrame, rid: str, seed: str = "42") -> DataFrame:
    """The rows that types are told from: all of a small table, else a sample that prefers rows with some value."""
    rows, columns = df.count(), len(df.columns) - 1
    if rows * columns <= ALL_CELLS and rows <= ALL_ROWS:
        return df
    n = min(rows, max(FEWEST_ROWS, min(MOST_ROWS, ALL_CELLS // max(columns, 1))))
    empty = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in df.columns if c != rid]).isNull()
    return df.orderBy(empty, place(F.col(rid), seed), rid).limit(n)


def distinct_values(df: DataFrame, rid: str, column: str) -> DataFrame:
    """``value, n, first_rid`` of the values present, to be ordered by first appearance."""
    return df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"), F.min(rid).alias("first_rid"))


def distinct_sample(values: DataFrame, cap: int, seed: str) -> DataFrame:
    """All distinct values if they are at most ``cap``, else ``cap`` of them; with ``all_included``."""
    total = values.agg(F.count("*").alias("total"))
    return sample(values, "first_rid", cap, seed).crossJoin(F.broadcast(total)).select("value", (F.col("total") <= cap).alias("all_included"))


def numeric_parts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``is_clean``: whether a present value reads as a number."""
    return df.where(F.col(f"`{column}`").isNotNull()).withColumn("is_clean", to_number(F.col(f"`{column}`")).isNotNull())


def datetime_parts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(f"`{column}`").isNotNull()).withColumn("is_clean", is_datetime(F.col(f"`{column}`")))


def text_parts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``is_short``: whether a text is no longer than the median length."""
    length = F.char_length(f"`{column}`" if "`" not in column else column)
    present = df.where(F.col(f"`{column}`").isNotNull())
    middle = median(present, length.cast("double"))
    return present.withColumn("is_short", length <= F.lit(middle).cast("double"))


def text_halves(values: DataFrame) -> DataFrame:
    """Distinct texts in halves by length, ties by first appearance: ``value, half`` with 0 for the shorter half.

    The last of the shorter half is found by rank, first of lengths, then of
    the rows of that length, so nothing is sorted as a whole.
    """
    length = F.char_length("value")
    k = values.count() // 2
    if not k:
        return values.select("value", F.lit(1).alias("half"))
    last = kth_smallest(values, length, k)
    k -= values.where(length < last).count()
    rid = kth_smallest(values.where(length == last), F.col("first_rid"), k)
    return values.select("value", F.when((length < last) | ((length == last) & (F.col("first_rid") <= rid)), 0).otherwise(1).alias("half"))


def noise_patterns(df: DataFrame, rid: str, column: str) -> DataFrame:
    """``mask, value, first_rid``: each noise pattern of a numeric column with its first value."""
    masked = df.select(F.col(rid).alias("rid"), F.col(f"`{column}`").cast("string").alias("value"), noise_mask(F.col(f"`{column}`").cast("string")).alias("mask")).where("mask is not null")
    return masked.groupBy("mask").agg(F.min_by("value", "rid").alias("value"), F.min("rid").alias("first_rid"))


def dirty_top(df: DataFrame, rid: str, column: str, k: int) -> DataFrame:
    """The k commonest values that are no numbers: ``value, n, first_rid``; ties by first appearance."""
    dirty = numeric_parts(df, column).where("not is_clean")
    return distinct_values(dirty, rid, column).orderBy(F.desc("n"), "first_rid").limit(k)


def review_sample(pairs: DataFrame, rid: str, is_changed: Column, seed: str, most_changed: int = 90, most_random: int = 60, cap: int = 150) -> DataFrame:
    """Rows for a review: up to 90 changed ones, then up to 60 of the rest; 150 of all where none changed. With ``stratum``."""
    marked = pairs.withColumn("stratum", F.when(is_changed, "changed").otherwise("random"))
    some = sample(marked.where("stratum = 'changed'"), rid, most_changed, seed)
    rest = marked.join(some.select(rid), rid, "left_anti").withColumn("stratum", F.lit("random"))
    none_changed = some.isEmpty()
    drawn = sample(rest, rid, cap if none_changed else most_random, seed + "|rest").select(marked.columns)
    return some.unionByName(drawn).limit(cap)


def clean_review(df: DataFrame, rid: str, column: str, seed: str, n: int = CLEAN_REVIEW) -> DataFrame:
    """Values of a column that is said to be clean, for a review: ``rid, original, cleaned, changed`` of up to 12 that are there."""
    value = F.col(f"`{column}`").cast("string")
    return sample(df.select(F.col(rid).alias("rid"), value.alias("original")).where("original is not null"), "rid", n, seed).select("rid", "original", F.col("original").alias("cleaned"), F.lit(False).alias("changed"))


def capped_cells(cells: DataFrame, rid: str, most: int, seed: str) -> DataFrame:
    """Labelled cells of a column, a sample of ``most`` (at least 1) where there are more, ordered by row."""
    return sample(cells, rid, max(1, most), seed).orderBy(rid)


def pair_lines(df: DataFrame, rid: str, lhs: str, rhs: str, n: int = 40, seed: str = "42") -> DataFrame:
    """A sample of two columns as lines of CSV."""
    return sample(df.select(rid, lhs, rhs), rid, n, seed).select(F.to_csv(F.struct(lhs, rhs)).alias("line"))


def page(df: DataFrame, rid: str, start: int, size: int = 100) -> DataFrame:
    """A page of rows by dense row id; a start past the end gives the last page."""
    last = df.agg(F.max(rid).alias("__last"))
    begin = F.greatest(F.lit(0), F.least(F.lit(start), F.col("__last") - size + 1))
    return df.crossJoin(F.broadcast(last)).where((F.col(rid) >= begin) & (F.col(rid) < begin + size)).drop("__last")
