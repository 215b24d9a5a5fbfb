"""What a validator would object to in a rule's effect, told from counts and from shapes before and after.

Each distinct change of a value is looked at once and weighted by its cells. One
aggregate over all changed columns counts kinds of change, another one the
coarse shapes on both sides, whose distributions are then compared. The same
judgement serves a whole cleaning run and a single rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.numbers import to_number

#: A change of more than this share of the values present is one of the whole column.
MOST = 0.5
#: Divergence of the shapes (bits, 0 to 1) beyond which a column has got another form.
DIVERGENCE = 0.5
#: Objections that concern the form of a text; a rule that makes numbers changes that as a matter of course.
OF_FORM = ("recased", "shortened", "unbracketed", "reseparated", "reshaped")
#: All objections.
PROBLEMS = ("emptied", "collapsed", "scaled", *OF_FORM)
_BRACKETS = r"[()\[\]{}<>]"


def coarse_shape(c: Column) -> Column:
    """A text's shape with letters of one case, digits and blanks each as one mark, however many; other marks as they are."""
    x = F.regexp_replace(c, r"\p{Nd}+", "9")
    x = F.regexp_replace(x, r"\p{Lu}+", "A")
    x = F.regexp_replace(x, r"\p{Ll}+", "a")
    return F.regexp_replace(F.regexp_replace(x, r"(Aa?|a)+", "w"), r"\s+", " ")


def separators(c: Column) -> Column:
    """The marks of a text that are no letters, digits, brackets or blanks at its ends, blanks among them once."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), rf"[\p{{L}}\p{{Nd}}]|{_BRACKETS}", ""), r"\s+", " ")


def letters_and_digits(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def _number(c: Column) -> Column:
    """The number in a text of one number and a unit or percent sign; null for others."""
    return to_number(F.regexp_replace(F.replace(c, F.lit(","), F.lit("")), r"^[^0-9.+-]{0,4}(?=[-+.0-9])|(?<=[0-9.])[^0-9.]{0,6}$", ""))


def value_changes(before: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """``column, a, b, n``: how many cells of a column go from one text to another, or stay."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("a"), after.cast("string").alias("b")) for c, after in changes.items()]
    return before.select(F.inline(F.array(*cells))).groupBy("column", "a", "b").agg(F.count("*").alias("n"))


def _counts(pairs: DataFrame) -> DataFrame:
    """A row a column of what is counted in its changes. Only cells that differ are looked at closely."""
    a, b = F.col("a"), F.col("b")
    other = a != b
    same_words = other & (letters_and_digits(a) == letters_and_digits(b))
    same_number = F.coalesce(to_number(a) == to_number(b), F.lit(False))
    numbers = pairs.withColumns({"x": F.when(other, _number(a)), "y": F.when(other, _number(b))}).withColumn("power", F.log10(F.abs(F.try_divide("y", "x"))))
    power = F.col("power")
    cells = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return numbers.groupBy("column").agg(
        cells(~a.eqNullSafe(b) & ~same_number).alias("changed"),
        cells(a.isNotNull()).alias("present"), cells(b.isNotNull()).alias("kept"), F.approx_count_distinct(a).alias("before"), F.min(b).alias("low"), F.max(b).alias("high"),
        cells(other & (F.lower(a) == F.lower(b))).alias("recased"),
        cells(F.char_length(b) * 2 < F.char_length(a)).alias("shortened"),
        cells(other & (F.regexp_count(a, F.lit(_BRACKETS)) > F.regexp_count(b, F.lit(_BRACKETS)))).alias("unbracketed"),
        cells(same_words & (separators(a) != separators(b))).alias("reseparated"),
        cells((F.col("x") != 0) & (F.col("y") != 0) & (F.abs(power) > 0.5) & (F.abs(power - F.round(power)) < 1e-9)).alias("scaled"),
    )


def shape_divergence(pairs: DataFrame) -> DataFrame:
    """``column, divergence``: Jensen and Shannon's, in bits, of the coarse shapes before and after; nulls are left out.

    ``pairs`` are value_changes. One grouped aggregate of all columns' shapes, however many a column has.
    """
    shaped = pairs.withColumn("sa", coarse_shape(F.col("a"))).withColumn("sb", F.when(F.col("a") == F.col("b"), F.col("sa")).otherwise(coarse_shape(F.col("b"))))
    both = shaped.groupBy("column", "sa", "sb").agg(F.sum("n").alias("n"))
    side = lambda shape, p, q: F.struct(F.col(shape).alias("shape"), p.alias("p"), q.alias("q"))
    n, none = F.col("n"), F.lit(0).cast("long")
    sides = both.select("column", F.inline(F.array(side("sa", n, none), side("sb", none, n))))
    counted = sides.where("shape is not null").groupBy("column", "shape").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    totals = counted.groupBy("column").agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    shares = counted.join(F.broadcast(totals), "column").where("ps > 0 and qs > 0").select("column", (F.col("p") / F.col("ps")).alias("p"), (F.col("q") / F.col("qs")).alias("q"))
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0) / 2
    return shares.groupBy("column").agg(F.round(F.sum(part("p") + part("q")), 6).alias("divergence"))


def change_problems(before: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """A row for each changed column: ``column``, each of PROBLEMS as a boolean, and ``divergence`` (0 where one side has no values).

    ``changed`` counts the cells that are no longer equal, numbers as numbers.
    emptied: nothing is left. collapsed: at most one value is left of three or more.
    Of most values: recased, their case changed alone; shortened, cut below
    half; unbracketed, brackets gone; reseparated, other marks between the same
    letters and digits; scaled, the same number but for a power of ten.
    reshaped: another distribution of shapes.
    """
    pairs = value_changes(before, changes)
    x = lambda k: F.coalesce(k, F.lit(0))  # noqa: E731  a column of a table without rows has no counts
    most = lambda k: (x(k) > MOST * x("present")).alias(k)
    each = before.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, changes))).alias("column")).join(F.broadcast(_counts(pairs)), "column", "left").select(
        "column",
        x("changed").alias("changed"),
        ((x("present") > 0) & (x("kept") == 0)).alias("emptied"),
        # One value at most is left if the least and the greatest agree; more than two were there is an estimate that is exact for so few.
        ((x("before") > 2) & ((x("kept") == 0) | (F.col("low") == F.col("high")))).alias("collapsed"),
        *[most(k) for k in ("scaled", "recased", "shortened", "unbracketed", "reseparated")],
    )
    out = each.join(F.broadcast(shape_divergence(pairs)), "column", "left").withColumn("divergence", F.coalesce("divergence", F.lit(0.0)))
    return out.withColumn("reshaped", F.col("divergence") > DIVERGENCE).select("column", "changed", *PROBLEMS, "divergence")
