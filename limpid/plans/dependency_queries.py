"""Queries on functional dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.operators import dependencies as fd
from limpid.operators import sampling
from limpid.plans.demo import FLAT, FLAT_COLUMNS, made
from limpid.sources.store import stored

RID = "o_orderkey"
LHS, RHS = "c_nationkey", "n_name"


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, FLAT)


def fd_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fd.candidate_columns(_flat(spark, sf_dir).withColumn("rid", F.col(RID)), "rid", FLAT_COLUMNS)
    return out.select("column", F.round("repeated_values", 6).alias("repeated_values"), F.round("repeated_rows", 6).alias("repeated_rows"), "as_lhs", "as_rhs")


def fd_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.score_pairs(stored(_flat(spark, sf_dir)), FLAT_COLUMNS, FLAT_COLUMNS).select("lhs", "rhs", F.round("score", 6).alias("score"))


def fd_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir).withColumn("rid", F.col(RID))
    return fd.merged(fd.dependencies(flat, "rid", FLAT_COLUMNS), flat, FLAT_COLUMNS)


def fd_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.detect(_flat(spark, sf_dir).withColumn("rid", F.col(RID)), "rid", FLAT_COLUMNS)


def fd_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.violations(_flat(spark, sf_dir), RID, LHS, RHS).select("l", F.col("rank").cast("long").alias("rank"), "r", "n", "first_rid")


def fd_imputables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.imputable_rows(_flat(spark, sf_dir), LHS, RHS)


def fd_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.conflicts(_flat(spark, sf_dir), RID, LHS, RHS)


def fd_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.context_rows(_flat(spark, sf_dir), RID, LHS, RHS)


def fd_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.pair_lines(_flat(spark, sf_dir), RID, LHS, RHS)


def fd_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = fd.enforce(_flat(spark, sf_dir), RID, LHS, RHS)
    return fd.enforce(repaired, RID, "n_regionkey", "r_name").select(RID, "n_name", "r_name")


def _scores(pairs: list[tuple[str, str]]) -> str:
    one = """SELECT '{a}' AS lhs, '{b}' AS rhs, {i} AS ord, coalesce(sum(m) / sum(n), 0) AS score
             FROM (SELECT max(n) AS m, sum(n) AS n FROM (SELECT {a} AS l, {b} AS r, count(*) AS n FROM flat
                   WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL) GROUP BY l)"""
    return " UNION ALL ".join(one.format(a=a, b=b, i=i) for i, (a, b) in enumerate(pairs))


_PAIRS = [(a, b) for a in FLAT_COLUMNS for b in FLAT_COLUMNS if a != b]
_ROLES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (n > 1) / count(*) AS repeated_values,
               coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS repeated_rows, count(*) AS d
        FROM (SELECT {c} AS v, count(*) AS n FROM flat WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in FLAT_COLUMNS
)
_UNIQUE = " UNION ALL ".join(f"SELECT '{c}' AS lhs, round((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) / count(*), 6) AS uniqueness FROM flat" for c in FLAT_COLUMNS)
_MERGED = f"""
    roles AS ({_ROLES}), scores AS ({_scores(_PAIRS)}), uniq AS ({_UNIQUE}),
    found AS (
      SELECT lhs, rhs, round(score, 4) AS score, uniqueness,
             row_number() OVER (PARTITION BY rhs ORDER BY round(score, 4) DESC, uniqueness DESC, ord) AS k
      FROM scores JOIN roles a ON a."column" = lhs JOIN roles b ON b."column" = rhs JOIN uniq USING (lhs)
      WHERE score >= 0.925 AND (a.repeated_values >= 0.7 OR a.repeated_rows >= 0.8) AND b.d > 1),
    merged AS (SELECT lhs, rhs, score, uniqueness FROM found WHERE k = 1)"""
_GROUPS = " UNION ALL ".join(
    f"""SELECT '{a}' AS lhs, '{b}' AS rhs, CAST(count(*) FILTER (d > 1) AS BIGINT) AS violations, CAST(coalesce(sum(missing) FILTER (d > 0), 0) AS BIGINT) AS imputables
        FROM (SELECT {a} AS l, count(DISTINCT {b}) AS d, count(*) - count({b}) AS missing FROM flat WHERE {a} IS NOT NULL GROUP BY 1)"""
    for a, b in _PAIRS
)
_WITH = f"WITH flat AS ({FLAT})"
_RANKED = f"""
    pairs AS (SELECT {LHS} AS l, {RHS} AS r, count(*) AS n, min({RID}) AS first_rid FROM flat WHERE {LHS} IS NOT NULL AND {RHS} IS NOT NULL GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, first_rid) AS rank, count(*) OVER (PARTITION BY l) AS kinds FROM pairs)"""
_CANON = "SELECT l, r FROM (SELECT {a} AS l, {b} AS r, row_number() OVER (PARTITION BY {a} ORDER BY count(*) DESC, {b}) AS k FROM flat WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) WHERE k = 1"

QUERIES = {f.__name__: f for f in (fd_candidates, fd_pair_scores, fd_merge, fd_detect, fd_violations, fd_imputables, fd_conflicts, fd_context, fd_pair_sample, fd_repair)}
ORACLE = {
    "fd_candidates": f"""{_WITH}, roles AS ({_ROLES})
        SELECT "column", round(repeated_values, 6) AS repeated_values, round(repeated_rows, 6) AS repeated_rows,
               repeated_values >= 0.7 OR repeated_rows >= 0.8 AS as_lhs, d > 1 AS as_rhs FROM roles""",
    "fd_pair_scores": f"{_WITH} SELECT lhs, rhs, round(score, 6) AS score FROM ({_scores(_PAIRS)})",
    "fd_merge": f"{_WITH}, {_MERGED} SELECT * FROM merged",
    "fd_detect": f"{_WITH}, {_MERGED} SELECT lhs, rhs, score, violations, imputables FROM merged JOIN ({_GROUPS}) USING (lhs, rhs) WHERE violations > 0 OR imputables > 0",
    "fd_violations": f"{_WITH}, {_RANKED} SELECT l, rank, r, n, first_rid FROM ranked WHERE kinds > 1",
    "fd_imputables": f"{_WITH} SELECT * FROM flat WHERE {RHS} IS NULL AND {LHS} IN (SELECT {LHS} FROM flat WHERE {RHS} IS NOT NULL)",
    "fd_conflicts": f"{_WITH}, {_RANKED} SELECT l, string_agg(r || ' (' || n || ')', ', ' ORDER BY rank) AS conflict FROM ranked WHERE kinds > 1 GROUP BY l",
    "fd_context": f"{_WITH}, {_RANKED} SELECT flat.* FROM flat JOIN ranked ON {RID} = first_rid WHERE kinds > 1",
    "fd_pair_sample": f"{_WITH} SELECT {LHS} || ',' || coalesce({RHS}, '') AS line FROM (SELECT * FROM flat ORDER BY md5('42|' || {RID}), {RID} LIMIT 40)",
    "fd_repair": f"""{_WITH}, a AS ({_CANON.format(a=LHS, b=RHS)}), b AS ({_CANON.format(a="n_regionkey", b="r_name")})
        SELECT {RID}, coalesce(a.r, n_name) AS n_name, coalesce(b.r, r_name) AS r_name
        FROM flat LEFT JOIN a ON {LHS} = a.l LEFT JOIN b ON n_regionkey = b.l""",
}
