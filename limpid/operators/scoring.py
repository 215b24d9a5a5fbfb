"""Scoring a cleaned table against dirty data and ground truth, cell by cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.equality import lenient_equal, outcome
from limpid.operators.ranks import numbered

REPORT_ROWS = 1500
#: Parts of a column that its first rows are looked for in.
REPORT_PARTS = 64


def aligned(left: DataFrame, right: DataFrame, rid: str) -> DataFrame:
    """Rows of both tables side by side, by row id: ``left`` and ``right`` structs. Ids in only one table drop out."""
    a = left.select(F.col(rid), F.struct(*[f"`{c}`" for c in left.columns if c != rid]).alias("left"))
    b = right.select(F.col(rid), F.struct(*[f"`{c}`" for c in right.columns if c != rid]).alias("right"))
    return a.join(b, rid)


def aligned_by_place(left: DataFrame, right: DataFrame, rid: str) -> DataFrame:
    """As :func:`aligned`; but tables of equal length whose ids have nothing in common are matched by the order of their ids."""
    n = left.count()
    if n != right.count() or not left.join(right.select(rid), rid, "left_semi").isEmpty():
        return aligned(left, right, rid)
    a, b = (numbered(t, rid, "__place") for t in (left, right))
    out = aligned(a.drop(rid).withColumnRenamed("__place", "__p"), b.drop(rid).withColumnRenamed("__place", "__p"), "__p")
    ids = a.select(F.col("__place").alias("__p"), rid)
    return out.join(ids, "__p").select(rid, "left", "right")


def same_shape(*tables: DataFrame) -> None:
    """Raises ValueError unless all tables have the same columns and number of rows."""
    rows = tables[0].count()
    for t in tables[1:]:
        if t.columns != tables[0].columns or t.count() != rows:
            raise ValueError("The tables must have the same rows and columns.")


def masks(dirty: DataFrame, cleaned: DataFrame, truth: DataFrame, rid: str, equal: Callable[[Column, Column], Column] = lenient_equal, numeric: list[str] | None = None) -> DataFrame:
    """``rid, column, dirty, cleaned, truth, error, changed, correct``: one row for each cell.

    Rows are matched by id. ``numeric`` names the columns to be compared as
    numbers; None tries all of them. Cells are unpivoted first, so one set of
    expressions serves every column, however many there are.
    """
    columns = [c for c in dirty.columns if c != rid]
    side = lambda t, name: t.select(F.col(rid), *[F.col(f"`{c}`").cast("string").alias(f"{name}#{c}") for c in columns])
    rows = side(dirty, "d").join(side(cleaned, "c"), rid).join(side(truth, "t"), rid)
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{n[0]}#{c}`").alias(n) for n in ("dirty", "cleaned", "truth")]) for c in columns]
    long = rows.select(F.col(rid).alias("rid"), F.inline(F.array(*cells)))
    d, x, t = F.col("dirty"), F.col("cleaned"), F.col("truth")

    def agree(a: Column, b: Column) -> Column:
        if equal is not lenient_equal or numeric is None:
            return equal(a, b)
        as_number = F.col("column").isin(list(numeric)) if numeric else F.lit(False)
        return F.when(as_number, lenient_equal(a, b)).otherwise(lenient_equal(a, b, numeric=False))

    return long.select("*", (~agree(d, t)).alias("error"), (~agree(d, x)).alias("changed"), agree(x, t).alias("correct"))


def counts(cells: DataFrame) -> DataFrame:
    """``column, tp, fp, fn, tn, errors, changes, repaired, right, cells``; the row without a column is the whole table's."""
    c = lambda x: F.count_if(F.expr(x))
    return cells.groupingSets([["column"], []], "column").agg(
        c("error and changed").alias("tp"), c("changed and not error").alias("fp"), c("error and not changed").alias("fn"), c("not error and not changed").alias("tn"),
        c("error").alias("errors"), c("changed").alias("changes"), c("error and changed and correct").alias("repaired"), c("correct").alias("right"), F.count("*").alias("cells"),
    )


def _ratio(a: Column, b: Column, undefined: float | None) -> Column:
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if undefined is None else F.coalesce(x, F.lit(undefined))


def _f1(p: Column, r: Column, undefined: float | None) -> Column:
    x = F.try_divide(2 * p * r, p + r)
    return x if undefined is None else F.coalesce(x, F.lit(undefined))


def scores(counted: DataFrame) -> DataFrame:
    """Detection and correction precision, recall and F1 beside the counts; undefined ones are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    with_parts = counted.withColumns(
        {
            "wrong_repairs": tp - F.col("repaired"),
            "detection_precision": _ratio(tp, tp + fp, 0.0),
            "detection_recall": _ratio(tp, tp + fn, 0.0),
            "correction_precision": _ratio(F.col("repaired"), F.col("changes"), 0.0),
            "correction_recall": _ratio(F.col("repaired"), F.col("errors"), 0.0),
        }
    )
    return with_parts.withColumns({f"{k}_f1": _f1(F.col(f"{k}_precision"), F.col(f"{k}_recall"), 0.0) for k in ("detection", "correction")})


def dashboard(counted: DataFrame) -> DataFrame:
    """Cell accuracy and repair precision, recall and F1 as the dashboard shows them; undefined ones are null."""
    x = counted.withColumns({"cell_accuracy": _ratio(F.col("right"), F.col("cells"), None), "repair_precision": _ratio(F.col("repaired"), F.col("changes"), None), "repair_recall": _ratio(F.col("repaired"), F.col("errors"), None)})
    return x.withColumn("repair_f1", _f1(F.col("repair_precision"), F.col("repair_recall"), None))


def report(cells: DataFrame, most: int = REPORT_ROWS) -> DataFrame:
    """Cells that were wrong or were touched, and how each ended; the first ``most`` rows of each column.

    The first rows of a column are looked for in each of many parts of its
    rows before these are put together, so no task sorts a whole column.
    """
    listed = cells.where("error or changed").withColumn("status", outcome(F.col("error"), F.col("changed"), F.col("correct"))).withColumn("__part", F.pmod(F.xxhash64("rid"), F.lit(REPORT_PARTS)))
    for parts in (["column", "__part"], ["column"]):
        listed = listed.withColumn("__r", F.row_number().over(Window.partitionBy(*parts).orderBy("rid"))).where(F.col("__r") <= most).drop("__r")
    return listed.drop("__part")


def detection_only(cells: DataFrame, flagged: DataFrame) -> DataFrame:
    """Detection counts of a method that only names cells: ``flagged`` holds rid and column."""
    marked = cells.drop("changed").join(flagged.select("rid", "column").distinct().withColumn("changed", F.lit(True)), ["rid", "column"], "left")
    return counts(marked.withColumn("changed", F.coalesce("changed", F.lit(False)))).select("column", "tp", "fp", "fn", "tn", "errors", "changes", "cells")


def over_runs(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over runs, for keys that every run has."""
    total = runs.select(F.count_distinct("run").alias("total"))
    grouped = runs.groupBy(*keys).agg(F.count_distinct("run").alias("runs"), *[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    return grouped.crossJoin(F.broadcast(total)).where("runs = total").drop("total")


def usage(events: DataFrame) -> DataFrame:
    """Tokens by agent with their share, and in total (no agent): ``agent, prompt, completion, tokens, share``."""
    per = events.groupingSets([["agent"], []], "agent").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    x = per.withColumn("tokens", F.col("prompt") + F.col("completion"))
    whole = events.agg(F.sum(F.col("prompt") + F.col("completion")).alias("whole"))
    return x.crossJoin(F.broadcast(whole)).select("agent", "prompt", "completion", "tokens", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0)).alias("share"))


def usage_by_level(events: DataFrame, levels: tuple[str, ...] = ("run", "task", "agent")) -> DataFrame:
    """Tokens at every level of a run, from one rollup: ``level``, the levels' names (null above them), ``prompt, completion, tokens, share`` of the whole."""
    per = events.rollup(*levels).agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.grouping_id().alias("rolled"))
    # The id has a bit for each level that is rolled up, the last level's lowest.
    names = F.array(*[F.lit(n) for n in ("all", *levels)])
    level = F.element_at(names, len(levels) + 1 - F.bit_count("rolled"))
    x = per.withColumn("tokens", F.col("prompt") + F.col("completion")).withColumn("level", level)
    whole = x.where("level = 'all'").select(F.col("tokens").alias("whole"))
    return x.crossJoin(F.broadcast(whole)).select("level", *levels, "prompt", "completion", "tokens", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0)).alias("share"))


def rejections(trace: DataFrame) -> DataFrame:
    """How often a validator sent a column back."""
    return trace.where(F.contains(F.lower("step"), F.lit("validator")) & (F.col("status") == "needs_correction")).agg(F.count("*").alias("rejections"))
