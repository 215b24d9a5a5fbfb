"""Spellings of one value brought together: by case and blanks, and by edit distance up to two.

Near spellings meet in an equi-join of segments. A text that is at most k edits
from another one shares one of k + 1 pieces with it, shifted by at most k
places; so common values list their pieces, rare ones the substrings where
such a piece could be, and no pair of all values is formed. Counts are compared
with each other only, so a table and a hundred copies of it are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.sources.store import stored

#: Most edits between a rare spelling and the common one.
EDITS = 2
#: A spelling is a slip if the near one is at least so many times as common, for each edit.
SUPPORT = 4
#: Lengths from which one edit, and two, leave no doubt which word is meant.
ONE_EDIT_FROM, TWO_EDITS_FROM = 4, 6


def counted_values(df: DataFrame, column: str, rid: str) -> DataFrame:
    """``value, folded, n, first_rid`` of the values present; folded are those without case and outer blanks."""
    value = F.col(f"`{column}`").cast("string")
    counted = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(rid).alias("first_rid"))
    return counted.withColumn("folded", F.lower(F.trim("value")))


def case_map(df: DataFrame, column: str, rid: str) -> DataFrame:
    """``value, canonical``: spellings that differ only in case and blanks, to the commonest; ties go to the first."""
    counted = counted_values(df, column, rid)
    best = counted.groupBy(F.col("folded").alias("of")).agg(F.min(F.struct((-F.col("n")).alias("n"), "first_rid", "value")).alias("b"))
    return counted.join(best, F.col("folded") == F.col("of")).select("value", F.col("b.value").alias("canonical"))


def _pieces(edits: int) -> Column:
    """Of ``folded``: its length, a piece's number, and the piece. Pieces are as long as can be, longer ones last."""
    length = F.char_length("folded")
    begin = lambda i: F.floor(length * i / (edits + 1)).cast("int")
    return F.array(*[F.struct(length.alias("length"), F.lit(i).alias("piece"), F.substr("folded", begin(i) + 1, begin(i + 1) - begin(i)).alias("text")) for i in range(edits + 1)])


def _places(edits: int) -> Column:
    """Of ``folded``: for each length of a partner and each of its pieces, the substrings where that piece can be."""
    length = F.char_length("folded")
    out = []
    for more in range(-edits, edits + 1):
        other = length + more
        for i in range(edits + 1):
            begin = F.floor(other * i / (edits + 1)).cast("int")
            size = F.floor(other * (i + 1) / (edits + 1)).cast("int") - begin
            for shift in range(-edits, edits + 1):
                at = begin + shift
                inside = (other > 0) & (at >= 0) & (size > 0) & (at + size <= length)
                out.append(F.when(inside, F.struct(other.alias("length"), F.lit(i).alias("piece"), F.substr("folded", at + 1, size).alias("text"))))
    return F.array_distinct(F.array_compact(F.array(*out)))


def near_pairs(low: DataFrame, high: DataFrame, edits: int = EDITS) -> DataFrame:
    """Rows of two tables with a column ``folded`` that are 1 to ``edits`` edits apart: ``a`` and ``b`` structs and ``distance``.

    Texts of at most ``edits`` letters have no piece for all, and are left out.
    """
    long_enough = F.char_length("folded") > edits
    probes = low.where(long_enough).select(F.struct(*low.columns).alias("a"), F.explode(_places(edits)).alias("key"))
    listed = high.where(long_enough).select(F.struct(*high.columns).alias("b"), F.explode(_pieces(edits)).alias("key"))
    met = probes.join(listed, "key").select("a", "b").distinct()
    # A threshold makes the distance stop early; beyond it is -1.
    apart = met.withColumn("distance", F.levenshtein(F.col("a.folded"), F.col("b.folded"), edits))
    return apart.where(F.col("distance").between(1, edits))


def spelling_map(df: DataFrame, column: str, rid: str, support: int = SUPPORT) -> DataFrame:
    """``value, canonical``: spellings that a near one is far commoner than, or that differ in case and blanks only, to the commonest of their cluster.

    A value links to the nearest, then commonest, then earliest value that is
    one edit away and ``support`` times as common, or two and the square of
    that. Short words allow fewer edits. Codes that differ in digits are
    different codes; only a mark amid digits may stand for one. Links lead to
    commoner values, so they are trees; each value goes to the root of its tree.
    """
    counted = counted_values(df, column, rid)
    values = counted.groupBy("folded").agg(F.sum("n").alias("n"), F.min("first_rid").alias("first_rid"), F.min(F.struct((-F.col("n")).alias("m"), "first_rid", "value")).alias("best"))
    values = values.select("folded", "n", "first_rid", F.col("best.value").alias("value"))
    totals = values.agg(F.max("n").alias("most"))
    # Only what some value can outweigh, and what outweighs some value, takes part.
    least = values.agg(F.min("n").alias("least"))
    low = values.join(F.broadcast(totals), F.col("n") * support <= F.col("most")).drop("most")
    high = values.join(F.broadcast(least), F.col("n") >= F.col("least") * support).drop("least")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    same_code = (digits("a.folded") == digits("b.folded")) | (F.col("b.folded").rlike("^[0-9]+$") & ~F.col("a.folded").rlike("^[0-9]+$"))
    needed = F.when(F.col("distance") == 1, ONE_EDIT_FROM).otherwise(TWO_EDITS_FROM)
    fits = (F.col("b.n") >= F.col("a.n") * F.pow(F.lit(support), F.col("distance"))) & (F.least(F.char_length("a.folded"), F.char_length("b.folded")) >= needed) & same_code
    linked = near_pairs(low, high).where(fits)
    links = linked.groupBy(F.col("a.value").alias("value")).agg(F.min(F.struct("distance", (-F.col("b.n")).alias("m"), F.col("b.first_rid").alias("r"), F.col("b.value").alias("to"))).alias("best")).select("value", F.col("best.to").alias("canonical"))
    roots = _rooted(links).select(F.col("value").alias("best"), F.col("canonical").alias("root"))
    written = counted.select("value", "folded").join(values.select("folded", F.col("value").alias("best")), "folded").join(roots, "best", "left")
    return written.select("value", F.coalesce("root", "best").alias("canonical")).where("value <> canonical")


def _rooted(links: DataFrame) -> DataFrame:
    """The links with each target replaced by its root: twice as far a step each round, at most as often as a count can grow."""
    links = stored(links)
    while True:
        onward = links.select(F.col("value").alias("canonical"), F.col("canonical").alias("further"))
        joined = links.join(onward, "canonical", "left")
        if joined.where("further is not null").isEmpty():
            return links
        links = stored(joined.select("value", F.coalesce("further", "canonical").alias("canonical")))


def respelled(df: DataFrame, column: str, spelling: DataFrame) -> DataFrame:
    """``df`` with the values of a spelling map replaced."""
    table = spelling.select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
    return df.join(table, F.col(f"`{column}`") == F.col("__value"), "left").withColumn(column, F.coalesce("__canonical", F.col(f"`{column}`"))).select(*[F.col(f"`{c}`") for c in df.columns])
