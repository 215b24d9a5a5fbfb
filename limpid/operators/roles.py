"""What a column of numbers is: a quantity, a year, or an identifier that only looks like a number.

Arithmetic makes sense for quantities alone: identifiers keep their zeros and
their width, and neither they nor years have outliers. The role is told from
one aggregate over the column's value counts and from its name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.numbers import to_number

#: Widths of digit strings that are counted apart; wider ones are counted together.
WIDTHS = 20
#: A column is one of numbers if this share of its values are.
NUMBER_SHARE = 0.5
#: A share of this size of the numbers is nearly all of them.
NEARLY_ALL = 0.95
#: A leading zero in so many of the whole numbers is no accident.
ZERO_SHARE = 0.01
YEARS, YEAR_SHARE = (1900, 2100), 0.9
#: Numbers of one width are codes from this width on, if their last digits are as evenly spread as this (1: all alike).
CODE_WIDTH, EVENNESS = 5, 0.8
#: Whole numbers that hardly repeat and leave few gaps number the rows, from so many rows on.
UNIQUE_SHARE, DENSITY, LEAST_NUMBERED = 0.98, 0.9, 20
#: Last words of the names of columns that hold identifiers. Fixed values.
ID_WORDS = ["id", "ids", "key", "code", "zip", "zipcode", "postcode", "phone", "phonenumber", "fax", "isbn", "issn", "ssn", "ean", "upc", "index", "uuid", "providernumber", "accountnumber", "ordernumber"]


def named_as_identifier(column: str) -> bool:
    """Whether the last word of a name, or the last two together, is one for identifiers: ``brewery_id``, ``ZipCode``, ``Phone Number``."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", column)]
    return bool(words) and (words[-1] in ID_WORDS or "".join(words[-2:]) in ID_WORDS)


def _evenness(text: Column, counted: Column, from_end: int) -> list[Column]:
    """How many distinct values have each digit at a place from their end."""
    return [F.count_if(counted & (F.substring(text, -from_end, 1) == str(d))) for d in range(10)]


def _entropy(counts: Column) -> Column:
    """Entropy of ten counts, as a share of what it would be if they were spread as evenly as can be."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    each = F.transform(counts, lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0))
    most = F.log2(F.least(F.lit(10.0), total))
    return F.when(most > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / most).otherwise(0.0)


def role_measures(counts: DataFrame) -> DataFrame:
    """``column, present, numbers, codes, zero_share, width, width_share, year_share, unique_share, density, evenness``.

    ``counts`` is a table of value counts. ``numbers`` and ``codes`` are shares:
    of values that are numbers, and of these of digits alone. What follows is of the codes.
    """
    text, n = F.trim("value"), F.col("n")
    number = to_number(text)
    code = text.rlike("^[0-9]+$")
    width, value = F.char_length(text), text.try_cast("double")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    one = counts.groupBy("column").agg(
        F.sum(n).alias("present"),
        of(number.isNotNull()).alias("numbers"),
        of(code).alias("codes"),
        of(code & (width > 1) & F.startswith(text, F.lit("0"))).alias("zeros"),
        F.array(*[of(code & (F.least(width, F.lit(WIDTHS)) == k)) for k in range(1, WIDTHS + 1)]).alias("widths"),
        of(code & (width == 4) & value.between(*YEARS)).alias("years"),
        F.count_if(code).alias("distinct"),
        F.min(F.when(code, value)).alias("low"),
        F.max(F.when(code, value)).alias("high"),
        F.array(*_evenness(text, code, 1)).alias("last"),
        F.array(*_evenness(text, code & (width > 1), 2)).alias("second"),
    )
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 6).alias(f"{a}_share")
    widest = F.array_max("widths")
    return one.select(
        "column", "present",
        F.round(F.col("numbers") / F.col("present"), 6).alias("numbers"),
        F.round(F.coalesce(F.try_divide(F.col("codes").cast("double"), F.col("numbers")), F.lit(0.0)), 6).alias("codes"),
        share("zeros", "codes").alias("zero_share"),
        F.array_position("widths", widest).cast("int").alias("width"),
        F.round(F.coalesce(F.try_divide(widest.cast("double"), F.col("codes")), F.lit(0.0)), 6).alias("width_share"),
        share("years", "codes").alias("year_share"),
        share("distinct", "codes").alias("unique_share"),
        F.round(F.coalesce(F.col("distinct") / (F.col("high") - F.col("low") + 1), F.lit(0.0)), 6).alias("density"),
        F.round(F.least(_entropy(F.col("last")), _entropy(F.col("second"))), 6).alias("evenness"),
    )


def column_roles(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The measures and ``role``: quantity, year, identifier, or none where most values are no numbers.

    ``keys`` are columns known to determine others, which makes identifiers of
    their whole numbers, as a name like ``ZipCode`` does. Years come first,
    then whatever a quantity would not show: leading zeros, one width with
    evenly spread last digits, or a number for each row.
    """
    measured = role_measures(counts)
    known = sorted({c for c in (keys or [])} | {r["column"] for r in measured.select("column").collect() if named_as_identifier(r["column"])})  # names of columns
    whole = F.col("codes") >= NEARLY_ALL
    fixed = whole & (F.col("width") >= CODE_WIDTH) & (F.col("width_share") >= NEARLY_ALL) & (F.col("evenness") >= EVENNESS)
    numbering = whole & (F.col("present") >= LEAST_NUMBERED) & (F.col("unique_share") >= UNIQUE_SHARE) & (F.col("density") >= DENSITY)
    role = (
        F.when(F.col("numbers") < NUMBER_SHARE, "none")
        .when(whole & (F.col("year_share") >= YEAR_SHARE), "year")
        .when((F.col("zero_share") >= ZERO_SHARE) | fixed | numbering, "identifier")
        .when(whole & F.col("column").isin(known), "identifier")
        .otherwise("quantity")
    )
    return measured.withColumn("role", role)
