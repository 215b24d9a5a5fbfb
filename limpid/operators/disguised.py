"""Missing values in disguise: 9999, -1, 99/99 or a site's stock phrase that stand for no value.

Such a value is far too frequent for its column, lies apart from the others,
and says nothing about the rest of its row. The first two are told from the
value counts, the last by a chi-square test of its rows against every other
column that is a list of categories, on a bounded sample of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.numbers import to_number
from limpid.operators.sampling import sample
from limpid.operators.validation import coarse_shape

#: A value is too frequent if it makes up this share of its column, and occurs so many times as often as nine in ten values; a number that lies apart, no less often.
LEAST_SHARE, EXCESS = 0.01, 5
#: Columns with fewer values than this are lists, in which any value may be frequent.
LEAST_DISTINCT = 20
#: Numbers make a column of numbers from this share on.
NUMBERS_SHARE = 0.9
#: A text of letters is a stock phrase only where at least this share of values are distinct.
FREE_SHARE = 0.3
#: Other values of a column that may have the shape of a mark without letters.
SHAPE_SHARE = 0.05
#: Rows that independence is tested on, most categories of a column it is tested against, and least expected rows of one.
SAMPLE_ROWS, MOST_CATEGORIES, LEAST_EXPECTED = 50_000, 50, 5
#: Standard deviations by which chi-square may exceed its degrees of freedom.
DEPENDENCE = 4.0
#: Candidates of a column at most: the most frequent ones.
CANDIDATES = 3


def frequent_outsiders(counts: DataFrame) -> DataFrame:
    """``column, value, n``: values that are too frequent for their column and lie apart, at most CANDIDATES a column.

    Of a column of numbers, the only negative ones, and those whose distance to
    all others is more than the range of nine tenths of the values. Of other columns, marks without letters whose
    shape hardly any other value has, and phrases in free text.
    """
    number = to_number(F.trim("value"))
    told = counts.withColumn("x", number).withColumn("shape", coarse_shape(F.trim("value")))
    of = told.groupBy("column").agg(
        F.sum("n").alias("present"), F.count("*").alias("distinct"), F.percentile("n", F.lit(0.9)).alias("usual"), (F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("numbers"),
        F.count_if(F.col("x") < 0).alias("negatives"), F.percentile("x", F.lit(0.05)).alias("low"), F.percentile("x", F.lit(0.95)).alias("high"),
    )
    alike = told.groupBy("column", "shape").agg(F.count("*").alias("same_shape"))
    of_numbers = F.col("numbers") >= NUMBERS_SHARE
    order = Window.partitionBy("column").orderBy(F.desc("n"), "first_rid")
    often = told.join(F.broadcast(of), "column").where((F.col("distinct") >= LEAST_DISTINCT) & (F.col("n") >= LEAST_SHARE * F.col("present")) & (F.col("n") >= F.when(of_numbers, 1).otherwise(EXCESS) * F.col("usual")))
    often = often.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES).join(alike, ["column", "shape"])
    span = F.col("high") - F.col("low")
    apart = ((F.col("x") < 0) & (F.col("negatives") == 1)) | (F.col("x") > F.col("high") + span) | (F.col("x") < F.col("low") - span)
    letters = F.col("value").rlike(r"\p{L}")
    odd = F.when(letters, F.col("distinct") >= FREE_SHARE * F.col("present")).otherwise(F.col("same_shape") - 1 <= SHAPE_SHARE * F.col("distinct"))
    return often.where(F.when(of_numbers, F.coalesce(apart, F.lit(False)) | (F.col("x").isNull() & ~letters)).otherwise(odd)).select("column", "value", "n")


def disguised_missing(df: DataFrame, rid: str, counts: DataFrame, seed: str = "42") -> DataFrame:
    """``column, value, n, dependence``: values that stand for no value.

    ``counts`` are the value counts of ``df``. ``dependence`` is by how many
    standard deviations chi-square exceeds what chance gives, at most over the
    other columns; null where no other column is a list of categories.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, value string, n long, dependence double")
    found = frequent_outsiders(counts).collect()  # at most CANDIDATES a column
    if not found:
        return empty
    lists = [r["column"] for r in counts.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k").between(2, MOST_CATEGORIES)).collect()]  # names of columns
    rows = sample(df, rid, SAMPLE_ROWS, f"{seed}|disguised")
    hit = [F.coalesce(F.col(f"`{r['column']}`").cast("string") == r["value"], F.lit(False)) for r in found]
    dependence: dict[int, float] = {}
    if lists:
        cells = F.array(*[F.struct(F.lit(c).alias("other"), F.col(f"`{c}`").cast("string").alias("v")) for c in lists])
        each = rows.select(F.array(*hit).alias("hits"), F.explode(cells).alias("cell")).select("hits", "cell.*").where("v is not null")
        table = each.groupBy("other", "v").agg(F.count("*").alias("all"), *[F.count_if(F.col("hits")[i]).alias(f"h{i}") for i in range(len(found))]).collect()  # at most MOST_CATEGORIES a column
        for i, r in enumerate(found):
            for c in lists:
                own = [(t["all"], t[f"h{i}"]) for t in table if t["other"] == c]
                total, hits = sum(a for a, _ in own), sum(h for _, h in own)
                if c == r["column"] or not hits or hits == total:
                    continue
                share = hits / total
                cells_of = [(a * share, a * (1 - share), h, a - h) for a, h in own if a * share >= LEAST_EXPECTED]
                freedom = len(cells_of) - 1
                if freedom > 0:
                    chi = sum((h - e) ** 2 / e + (m - f) ** 2 / f for e, f, h, m in cells_of)
                    dependence[i] = max(dependence.get(i, float("-inf")), (chi - freedom) / (2 * freedom) ** 0.5)
    kept = [(r["column"], r["value"], r["n"], dependence.get(i)) for i, r in enumerate(found) if dependence.get(i, 0.0) <= DEPENDENCE]
    return spark.createDataFrame(kept, empty.schema) if kept else empty
