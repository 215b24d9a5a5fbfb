"""Approximate functional dependencies between pairs of columns.

All pairs are scored in one aggregate: each row is unfolded into the grouping
sets of the unordered pairs, counted, and both directions are read off the pair
counts. No pair gets a pass of its own.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.text import shortened
from limpid.operators.profile import column_stats, repetition, value_counts
from limpid.sources.store import stored

LEAST_SCORE = 0.925
REPEATED_VALUES = 0.7
REPEATED_ROWS = 0.8
#: Pairs that one aggregate unfolds a row into; more pairs are taken in turns.
PAIRS_AT_ONCE = 100


def candidate_columns(df: DataFrame, rid: str, columns: list[str]) -> DataFrame:
    """``column, repeated_values, repeated_rows, as_lhs, as_rhs``: what may determine, and what may be determined."""
    counts = value_counts(df, rid, columns)
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    shares = repetition(counts).join(F.broadcast(distinct), "column")
    lhs = (F.col("repeated_values") >= REPEATED_VALUES) | (F.col("repeated_rows") >= REPEATED_ROWS)
    return shares.select("column", "repeated_values", "repeated_rows", lhs.alias("as_lhs"), (F.col("distinct") > 1).alias("as_rhs"))


def pair_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``pair, a, b, n``: how often two values stand side by side, both being present.

    Rows that agree in all columns are counted before they are unfolded into
    pairs, so what is unfolded are the distinct rows.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    df = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("__n"))

    def some(part: list[tuple[int, tuple[str, str]]]) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")) for i, (a, b) in part]
        return df.select("__n", F.inline(F.array(*cells))).where("a is not null and b is not null").groupBy("pair", "a", "b").agg(F.sum("__n").alias("n"))

    numbered = list(enumerate(pairs))
    return reduce(DataFrame.unionByName, [some(numbered[i : i + PAIRS_AT_ONCE]) for i in range(0, len(numbered), PAIRS_AT_ONCE)])


def _known_scores(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Scores of pairs with a column that is never missing and never repeats, which follow from the columns' own counts.

    Such a column determines every other; and it agrees with another's value
    once for each distinct one. No row need be unfolded for that. One cheap
    pass says which columns may be such, one more settles it.
    """
    x = {c: F.col(f"`{c}`") for c in columns}
    rough = df.agg(F.count("*").alias("rows"), *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)], *[F.approx_count_distinct(x[c]).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    rows = rough["rows"]
    near = [c for i, c in enumerate(columns) if rows and rough[f"n{i}"] == rows and rough[f"d{i}"] >= 0.8 * rows]
    if not near:
        return {}
    exact = df.agg(*[F.count_distinct(x[c]).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    present, distinct = ({c: r[f"{k}{i}"] for i, c in enumerate(columns)} for r, k in ((rough, "n"), (exact, "d")))
    keys = [c for c in near if distinct[c] == rows]
    found = {(k, c): 1.0 if present[c] else 0.0 for k in keys for c in columns if c != k}
    return {(c, k): distinct[c] / present[c] if present[c] else 0.0 for k in keys for c in columns if c != k} | found


def score_pairs(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """``lhs, rhs, ord, score``: the share of rows that agree with their lhs value's commonest rhs value.

    Rows with either side missing do not count; a pair without rows scores 0.
    ``ord`` numbers the ordered pairs, lhs first.
    """
    wanted = [(a, b) for a in lhs for b in rhs if a != b]
    order = {p: i for i, p in enumerate(wanted)}
    columns = list(dict.fromkeys([*lhs, *rhs]))
    known = _known_scores(df, columns)
    pairs = [p for p in combinations(columns, 2) if any(q in order and q not in known for q in (p, p[::-1]))]
    spark = df.sparkSession
    told = spark.createDataFrame([(a, b, i, known.get((a, b))) for (a, b), i in order.items()] or [("", "", -1, None)], "lhs string, rhs string, ord int, known double").where("ord >= 0")
    names = told.select("lhs", "rhs", "ord")
    if not pairs:
        return told.select("lhs", "rhs", "ord", F.coalesce("known", F.lit(0.0)).alias("score"))
    sides = spark.createDataFrame([(i, *p, False) for i, p in enumerate(pairs) if p in order] + [(i, *p[::-1], True) for i, p in enumerate(pairs) if p[::-1] in order], "pair int, lhs string, rhs string, turned boolean")
    counted = pair_counts(df, pairs)
    directed = counted.join(F.broadcast(sides), "pair").select("lhs", "rhs", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("l"), "n")
    best = directed.groupBy("lhs", "rhs", "l").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    score = best.groupBy("lhs", "rhs").agg((F.sum("most") / F.sum("all")).alias("score"))
    return told.join(F.broadcast(score), ["lhs", "rhs"], "left").select(*names.columns, F.coalesce("known", "score", F.lit(0.0)).alias("score"))


def dependencies(df: DataFrame, rid: str, columns: list[str], least: float = LEAST_SCORE) -> DataFrame:
    """Dependencies at or above the threshold between candidate columns, before merging: ``lhs, rhs, ord, score``."""
    roles = candidate_columns(df, rid, columns).collect()  # one row a column
    by = {r["column"]: r for r in roles}
    lhs = [c for c in columns if c in by and by[c]["as_lhs"]]
    rhs = [c for c in columns if c in by and by[c]["as_rhs"]]
    return score_pairs(df, lhs, rhs).where(F.col("score") >= least)


def merged(found: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """One dependency for each rhs: the best rounded score, then the most unique lhs, then the first pair."""
    unique = column_stats(df, columns).select(F.col("column").alias("lhs"), "uniqueness")
    ranked = found.withColumn("score", F.round("score", 4)).join(F.broadcast(unique), "lhs")
    first = Window.partitionBy("rhs").orderBy(F.desc("score"), F.desc("uniqueness"), "ord")
    return ranked.withColumn("r", F.row_number().over(first)).where("r = 1").select("lhs", "rhs", "score", "uniqueness")


def _groups(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``pair, l, kinds, present, missing`` for each lhs value: distinct and present rhs cells, missing ones."""
    cells = [F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("string").alias("l"), F.col(f"`{b}`").cast("string").alias("r")) for i, (a, b) in enumerate(pairs)]
    rows = df.select(F.inline(F.array(*cells))).where("l is not null")
    return rows.groupBy("pair", "l", "r").agg(F.count("*").alias("n")).groupBy("pair", "l").agg(F.count("r").alias("kinds"), F.sum(F.when(F.col("r").isNull(), F.col("n")).otherwise(0)).alias("missing"))


def issues(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``lhs, rhs, violations, imputables``: lhs values with several rhs values, and missing cells that one could fill."""
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, lhs string, rhs string")
    seen = _groups(df, pairs).groupBy("pair").agg(F.count_if(F.col("kinds") > 1).alias("violations"), F.sum(F.when(F.col("kinds") > 0, F.col("missing")).otherwise(0)).alias("imputables"))
    return names.join(F.broadcast(seen), "pair", "left").select("lhs", "rhs", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.coalesce("imputables", F.lit(0)).cast("long").alias("imputables"))


def detect(df: DataFrame, rid: str, columns: list[str], least: float = LEAST_SCORE) -> DataFrame:
    """Merged dependencies that have violations or gaps: ``lhs, rhs, score, violations, imputables``.

    The columns are written once and read for each question, however the table was made.
    """
    df = stored(df.select(*dict.fromkeys([rid, *columns])))
    kept = merged(dependencies(df, rid, columns, least), df, columns).collect()  # at most one row a column
    if not kept:
        return df.sparkSession.createDataFrame([], "lhs string, rhs string, score double, violations bigint, imputables bigint")
    pairs = [(r["lhs"], r["rhs"]) for r in kept]
    scores = df.sparkSession.createDataFrame([(r["lhs"], r["rhs"], r["score"]) for r in kept], "lhs string, rhs string, score double")
    return scores.join(F.broadcast(issues(df, pairs)), ["lhs", "rhs"]).where("violations > 0 or imputables > 0")


def value_pairs(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """``l, r, n, first_rid`` over rows with both sides present."""
    return df.select(F.col(rid).alias("rid"), F.col(f"`{lhs}`").alias("l"), F.col(f"`{rhs}`").alias("r")).where("l is not null and r is not null").groupBy("l", "r").agg(F.count("*").alias("n"), F.min("rid").alias("first_rid"))


def violations(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """``l, rank, r, n, first_rid``: the rhs values of each violating lhs value, commonest first."""
    pairs = value_pairs(df, rid, lhs, rhs)
    over = Window.partitionBy("l")
    return pairs.withColumn("kinds", F.count("*").over(over)).where("kinds > 1").withColumn("rank", F.row_number().over(over.orderBy(F.desc("n"), "first_rid"))).select("l", "rank", "r", "n", "first_rid")


def conflicts(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """``l, conflict``: for each violating lhs value its rhs values as ``value (n)``, commonest first."""
    found = violations(df, rid, lhs, rhs).groupBy("l").agg(F.array_sort(F.collect_list(F.struct("rank", "r", "n"))).alias("c"))
    return found.select("l", F.array_join(F.transform("c", lambda x: F.concat(x["r"].cast("string"), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("conflict"))


def context_rows(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """For each conflicting (lhs, rhs) pair the first row that holds it, long texts cut."""
    first = violations(df, rid, lhs, rhs).select(F.col("first_rid").alias(rid))
    rows = df.join(first, rid, "left_semi")
    return rows.select(*[shortened(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def imputable_rows(df: DataFrame, lhs: str, rhs: str) -> DataFrame:
    """Rows whose rhs is missing while another row with the same lhs has one."""
    known = df.where(F.col(f"`{rhs}`").isNotNull()).select(lhs).distinct()
    return df.where(F.col(f"`{rhs}`").isNull()).join(known, lhs, "left_semi")


def canonical(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """``l, canonical``: the commonest rhs value of each lhs value; ties go to the least."""
    best = value_pairs(df, rid, lhs, rhs).groupBy("l").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("r").alias("r"))).alias("b"))
    return best.select("l", F.col("b.r").alias("canonical"))


def enforce(df: DataFrame, rid: str, lhs: str, rhs: str) -> DataFrame:
    """``df`` with rhs made canonical: violations repaired, gaps filled, lhs untouched. A missing lhs changes nothing."""
    table = canonical(df, rid, lhs, rhs).select(F.col("l").alias("__l"), F.col("canonical").alias("__canonical"))
    value = F.coalesce("__canonical", F.col(f"`{rhs}`"))
    return df.join(table, F.col(f"`{lhs}`") == F.col("__l"), "left").withColumn(rhs, value).select(*[F.col(f"`{c}`") for c in df.columns])


def enforcement_order(found: list[tuple[str, str, float]]) -> list[list[tuple[str, str, float]]]:
    """Dependencies in levels: one that determines another's lhs comes in an earlier level.

    A cycle loses its weakest dependency (the last of equals), which is then
    not enforced at all.
    """
    left, levels = list(found), []
    while left:
        ready = [d for d in left if not any(o is not d and o[1] == d[0] for o in left)]
        if ready:
            levels.append(ready)
            left = [d for d in left if d not in ready]
            continue
        cycle = list(left)
        while trimmed := [d for d in cycle if any(o is not d and o[1] == d[0] for o in cycle) and any(o is not d and d[1] == o[0] for o in cycle)]:
            if len(trimmed) == len(cycle):
                break
            cycle = trimmed
        left.remove(min(reversed(cycle), key=lambda d: d[2]))
    return levels


