"""Numbers in text. Spark 4 casts fail on bad text, so each cast here is guarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plain decimal number with an optional exponent; blanks around it are allowed.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: The same with digits grouped by single underscores, as the profiler's parser reads them.
GROUPED = r"^\s*[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?\s*$"
SPECIAL = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def to_number(c: Column) -> Column:
    """Text as a double, or null. Commas are not removed: ``1,234`` is no number here."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def loose_number(c: Column) -> Column:
    """Text as a double with commas removed and underscores between digits allowed; NaN for nan, inf."""
    text = F.replace(c.cast("string"), F.lit(","), F.lit(""))
    plain = F.regexp_replace(text, r"[_\s]", "")
    return F.when(text.rlike(GROUPED), plain.try_cast("double")).when(text.rlike(SPECIAL), F.lit(float("nan")))


def half_even_integer(c: Column) -> Column:
    """A double as a bigint, halves to the even neighbour (Spark's cast truncates)."""
    return F.bround(c, 0).cast("bigint")


def nan_as_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def close(a: Column, b: Column, relative: float = 1e-9, absolute: float = 1e-8) -> Column:
    """Whether two doubles agree within absolute + relative * |b|; equal infinities agree."""
    return (a == b) | (F.abs(a - b) <= absolute + relative * F.abs(b))


def close_symmetric(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """The dashboard's tolerance: relative to the larger magnitude, none near zero."""
    return (a == b) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b)))
