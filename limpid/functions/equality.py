"""When two cells agree. None of these expressions is ever null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.numbers import close, close_symmetric, to_number


def _with_missing(a: Column, b: Column, present: Column) -> Column:
    """Both missing agree, one missing does not."""
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.coalesce(present, F.lit(False)))


def lenient_equal(a: Column, b: Column, numeric: bool = True) -> Column:
    """Numbers agree within a tolerance, whatever their type; other values as they are."""
    if not numeric:
        return _with_missing(a, b, a.cast("string") == b.cast("string"))
    x, y = to_number(a), to_number(b)
    return _with_missing(a, b, F.when(x.isNotNull() & y.isNotNull(), close(x, y)).otherwise(a.cast("string") == b.cast("string")))


def value_kind_of(c: Column, of_type: T.DataType) -> Column:
    """bool, int, float or text: by the column's type, and of whole floating numbers none is an int."""
    kind = "bool" if isinstance(of_type, T.BooleanType) else "int" if isinstance(of_type, T.IntegralType) else "float" if isinstance(of_type, (T.FractionalType, T.DecimalType)) else "text"
    return F.when(c.isNotNull(), F.lit(kind))


def text_kind(c: Column) -> Column:
    """The kind that a cell of a text table was written as: a number without marks is a number, ``true`` and ``false`` are bool, all else is text."""
    text = c.cast("string")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), "int").when(to_number(text).isNotNull(), "float").when(F.lower(text).isin("true", "false"), "bool").when(text.isNotNull(), "text")


def column_kind(df: DataFrame, column: str) -> str | None:
    """The kind that all cells of a text column share (int and float together are float); None for mixed ones, where each cell decides."""
    kinds = {r[0] for r in df.select(text_kind(F.col(f"`{column}`")).alias("k")).where("k is not null").distinct().collect()}  # four at most
    return "float" if kinds == {"int", "float"} else kinds.pop() if len(kinds) == 1 else None


def typed_equal(a: Column, b: Column, a_kind: Column, b_kind: Column) -> Column:
    """As values of their kinds: the text ``20`` is not the number 20, but 20 and 20.0 are the same."""
    number = lambda k: k.isin("int", "float")
    same = F.when(number(a_kind) & number(b_kind), to_number(a) == to_number(b)).otherwise((a_kind == b_kind) & (a.cast("string") == b.cast("string")))
    return _with_missing(a, b, same)


def strict_equal(a: Column, b: Column, a_kind: Column, b_kind: Column, column_kind: str | None = None) -> Column:
    """Value and kind must agree with the right side, the ground truth.

    ``column_kind`` is the kind of the ground truth's whole column (bool, int,
    float or text) where it has one; else each of its cells decides.
    """
    wanted = F.lit(column_kind) if column_kind else b_kind
    x, y = to_number(a), to_number(b)
    same = F.when(wanted == "float", close(x, y)).when(wanted == "int", x == y).otherwise(a.cast("string") == b.cast("string"))
    return _with_missing(a, b, (a_kind == wanted) & same)


def shown_equal(a: Column, b: Column) -> Column:
    """The dashboard's highlighting: numbers by a symmetric relative tolerance, else trimmed text."""
    x, y = to_number(a), to_number(b)
    return _with_missing(a, b, F.when(x.isNotNull() & y.isNotNull(), close_symmetric(x, y)).otherwise(F.trim(a.cast("string")) == F.trim(b.cast("string"))))


def changed(a: Column, b: Column) -> Column:
    """Whether a cell's text differs, missing cells being equal to each other."""
    return ~a.cast("string").eqNullSafe(b.cast("string"))


def outcome(error: Column, is_changed: Column, correct: Column) -> Column:
    """How one cell turned out."""
    return (
        F.when(error & correct, "Corrected (TP)")
        .when(~error & ~correct, "Wrong correction (FP)")
        .when(error & is_changed, "Detected but wrong fix")
        .when(error, "Not fixed (FN)")
        .otherwise("(TN)")
    )
