"""Queries that compare and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions import equality, text
from limpid.operators import sampling, scoring
from limpid.plans.demo import FLAT, FLAT_COLUMNS, PARTS, REPAIRED, TRUTH, made, table

RID = "o_orderkey"
CELLS = [c for c in FLAT_COLUMNS if c != RID]


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return made(spark, sf_dir, FLAT), made(spark, sf_dir, REPAIRED), made(spark, sf_dir, TRUTH)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.masks(*_tables(spark, sf_dir), RID)


def _rounded(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns]


METRICS = ["detection_precision", "detection_recall", "detection_f1", "correction_precision", "correction_recall", "correction_f1"]


def score_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.scores(scoring.counts(_cells(spark, sf_dir))).where("column is null").drop("column")
    return x.select(*_rounded(x, METRICS))


def score_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.scores(scoring.counts(_cells(spark, sf_dir))).where("column is not null")
    return x.select("column", "tp", "fp", "fn", "tn", "repaired", "wrong_repairs", *[F.round(m, 6).alias(m) for m in METRICS])


def gui_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.dashboard(scoring.counts(_cells(spark, sf_dir)))
    return x.select(F.coalesce("column", F.lit("all")).alias("column"), "tp", "fp", "fn", "tn", *[F.round(m, 6).alias(m) for m in ("cell_accuracy", "repair_precision", "repair_recall", "repair_f1")])


def score_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(_cells(spark, sf_dir)).select("rid", "column", "dirty", "cleaned", "truth", "status")


def score_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric column exported as text, held against the numbers leniently, strictly and by kind; kinds are told from the cells and of the whole truth."""
    parts = made(spark, sf_dir, PARTS)
    kind, truth_kind = equality.text_kind(F.col("size_text")), equality.value_kind_of(F.col("p_size"), parts.schema["p_size"].dataType)
    of_column = equality.column_kind(parts.select(F.col("p_size").cast("string").alias("size")), "size")
    strict = equality.strict_equal(F.col("size_text"), F.col("p_size").cast("string"), kind, truth_kind, of_column)
    lenient = equality.lenient_equal(F.col("size_text"), F.col("p_size").cast("string"))
    typed = equality.typed_equal(F.col("size_text"), F.col("p_size").cast("string"), kind, truth_kind)
    shown = equality.shown_equal(F.col("size_text"), F.col("p_size").cast("string"))
    return parts.select("p_partkey", lenient.alias("lenient"), strict.alias("strict"), typed.alias("typed"), shown.alias("shown"))


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty, cleaned, _ = _tables(spark, sf_dir)
    both = scoring.aligned(dirty, cleaned, RID)
    any_changed = F.lit(False)
    for c in CELLS:
        any_changed = any_changed | equality.changed(F.col(f"left.{c}"), F.col(f"right.{c}"))
    line = text.change_line([F.col("left.n_name"), F.col("left.r_name")], [F.col("right.n_name"), F.col("right.r_name")])
    return both.where(any_changed).select(RID, line.alias("line"))


def align_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty, cleaned, _ = _tables(spark, sf_dir)
    return scoring.aligned(dirty.where("n_name is not null"), cleaned, RID).select(RID, F.col("left.n_name").alias("before"), F.col("right.n_name").alias("after"))


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty, cleaned, _ = _tables(spark, sf_dir)
    both = scoring.aligned(dirty, cleaned, RID).select(RID, F.col("left.n_name").alias("before"), F.col("right.n_name").alias("after"))
    return sampling.review_sample(both, RID, equality.changed(F.col("before"), F.col("after")), "42").select(RID, "stratum")


def except_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty, _, truth = _tables(spark, sf_dir)
    return dirty.join(truth.where("n_name = 'NATION_1' or n_regionkey = 2").select(RID), RID, "left_anti").select(RID, "n_name")


def detection_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = made(spark, sf_dir, FLAT).where("n_name is null or n_name like '%x'").select(F.col(RID).alias("rid"), F.lit("n_name").alias("column"))
    return scoring.detection_only(_cells(spark, sf_dir), flagged).select(F.coalesce("column", F.lit("all")).alias("column"), "tp", "fp", "fn", "tn")


def sparse_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of (row, column number) pairs as one boolean column for each column."""
    cells = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("i"), F.explode(F.array_compact(F.array(F.when(F.col("quality") == 0, 0), F.when(F.col("toxic") == 1, 1)))).alias("j"))
    wide = cells.groupBy("i").agg(F.bool_or(F.col("j") == 0).alias("poor"), F.bool_or(F.col("j") == 1).alias("toxic"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(wide, docs.doc_id == wide.i, "left").select("doc_id", F.coalesce("poor", F.lit(False)).alias("poor"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four runs' scores by source, made from the labels."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy(F.col("source").alias("column"), (F.floor(F.col("doc_id") / 20) % 4).alias("run")).agg(F.avg("quality").alias("f1"), F.avg("toxic").alias("recall"))


def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scoring.over_runs(_runs(spark, sf_dir), ["column"], ["f1", "recall"])
    return x.select("column", "runs", *[F.round(c, 6).alias(c) for c in ("f1_mean", "f1_sd", "recall_mean", "recall_sd")])


def agent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "conversations").select(F.col("role").alias("agent"), F.char_length("text").cast("long").alias("prompt"), F.size(F.split("text", " ")).cast("long").alias("completion"))
    x = scoring.usage(events)
    return x.select(F.coalesce("agent", F.lit("all")).alias("agent"), "prompt", "completion", "tokens", F.round("share", 6).alias("share"))


def usage_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation as a run, of each of its turns as a task, and of each role as an agent."""
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("task"), F.col("role").alias("agent"), F.char_length("text").cast("long").alias("prompt"), F.size(F.split("text", " ")).cast("long").alias("completion"))
    return scoring.usage_by_level(events).withColumn("share", F.round("share", 6))


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = table(spark, sf_dir, "conversations").select(F.concat(F.when(F.col("turn") % 2 == 0, "coder_").otherwise("validator_"), F.col("turn").cast("string")).alias("step"), F.when(F.col("role") == "user", "needs_correction").otherwise("ok").alias("status"))
    return scoring.rejections(trace)


_F = f"WITH d AS ({FLAT}), c AS ({REPAIRED}), t AS ({TRUTH})"
_EQ = "CASE WHEN {a} IS NULL AND {b} IS NULL THEN true WHEN {a} IS NULL OR {b} IS NULL THEN false WHEN TRY_CAST({a} AS DOUBLE) IS NOT NULL AND TRY_CAST({b} AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST({a} AS DOUBLE) - TRY_CAST({b} AS DOUBLE)) <= 1e-8 + 1e-9 * abs(TRY_CAST({b} AS DOUBLE)) ELSE {a} = {b} END"
_LONG = " UNION ALL ".join(f"SELECT d.{RID} AS rid, '{x}' AS \"column\", CAST(d.{x} AS VARCHAR) AS dirty, CAST(c.{x} AS VARCHAR) AS cleaned, CAST(t.{x} AS VARCHAR) AS truth FROM d JOIN c USING ({RID}) JOIN t USING ({RID})" for x in CELLS)
_MASK = f"""{_F}, cells AS ({_LONG}), m AS (SELECT *, NOT {_EQ.format(a="dirty", b="truth")} AS error, NOT {_EQ.format(a="dirty", b="cleaned")} AS changed, {_EQ.format(a="cleaned", b="truth")} AS correct FROM cells),
    k AS (SELECT {{key}} count(*) FILTER (error AND changed) AS tp, count(*) FILTER (changed AND NOT error) AS fp, count(*) FILTER (error AND NOT changed) AS fn, count(*) FILTER (NOT error AND NOT changed) AS tn,
          count(*) FILTER (error) AS errors, count(*) FILTER (changed) AS changes, count(*) FILTER (error AND changed AND correct) AS repaired, count(*) FILTER (correct) AS "right", count(*) AS cells FROM m {{group}}),
    s AS (SELECT *, tp - repaired AS wrong_repairs, coalesce(tp / nullif(tp + fp, 0), 0) AS dp, coalesce(tp / nullif(tp + fn, 0), 0) AS dr,
          coalesce(repaired / nullif(changes, 0), 0) AS cp, coalesce(repaired / nullif(errors, 0), 0) AS cr FROM k)"""
_M = "round(dp, 6) AS detection_precision, round(dr, 6) AS detection_recall, round(coalesce(2 * dp * dr / nullif(dp + dr, 0), 0), 6) AS detection_f1, round(cp, 6) AS correction_precision, round(cr, 6) AS correction_recall, round(coalesce(2 * cp * cr / nullif(cp + cr, 0), 0), 6) AS correction_f1"
_ONE, _EACH, _BOTH = {"key": "", "group": ""}, {"key": '"column",', "group": 'GROUP BY "column"'}, {"key": "coalesce(\"column\", 'all') AS \"column\",", "group": 'GROUP BY GROUPING SETS (("column"), ())'}
_SHOW = "coalesce('\"' || replace(CAST({0} AS VARCHAR), '\"', '''') || '\"', 'NaN')"

QUERIES = {
    f.__name__: f
    for f in (score_overall, score_per_column, gui_metrics, score_reports, score_strict, changed_rows, align_rows, review_sample, except_rows, detection_only, sparse_mask, run_aggregate, agent_usage, usage_by_level, rejections)
}
ORACLE = {
    "score_overall": f'{_MASK.format(**_ONE)} SELECT tp, fp, fn, tn, errors, changes, repaired, "right", cells, wrong_repairs, {_M} FROM s',
    "score_per_column": f'{_MASK.format(**_EACH)} SELECT "column", tp, fp, fn, tn, repaired, wrong_repairs, {_M} FROM s',
    "gui_metrics": f"""{_MASK.format(**_BOTH)}, g AS (SELECT *, repaired / nullif(changes, 0) AS rp, repaired / nullif(errors, 0) AS rr FROM s)
        SELECT "column", tp, fp, fn, tn, round("right" / cells, 6) AS cell_accuracy, round(rp, 6) AS repair_precision, round(rr, 6) AS repair_recall,
               round(2 * rp * rr / nullif(rp + rr, 0), 6) AS repair_f1 FROM g""",
    "score_reports": f"""{_MASK.format(**_ONE)}, r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rid) AS i FROM m WHERE error OR changed)
        SELECT rid, "column", dirty, cleaned, truth, CASE WHEN error AND correct THEN 'Corrected (TP)' WHEN NOT error AND NOT correct THEN 'Wrong correction (FP)'
               WHEN error AND changed THEN 'Detected but wrong fix' WHEN error THEN 'Not fixed (FN)' ELSE '(TN)' END AS status FROM r WHERE i <= 1500""",
    "score_strict": f"""WITH p AS (SELECT p_partkey, size_text AS a, CAST(p_size AS VARCHAR) AS b FROM ({PARTS}))
        SELECT p_partkey, {_EQ.format(a="a", b="b")} AS lenient,
               coalesce(regexp_full_match(a, '[0-9]+') AND TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE), false) AS strict,
               coalesce(regexp_matches(a, '^[0-9]+([.][0-9]*)?$') AND TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE), false) AS typed, coalesce(TRY_CAST(a AS DOUBLE) = TRY_CAST(b AS DOUBLE), trim(a) = b, false) AS shown FROM p""",
    "changed_rows": f"""{_F} SELECT d.{RID}, {_SHOW.format("d.n_name")} || ', ' || {_SHOW.format("d.r_name")} || ' => ' || {_SHOW.format("c.n_name")} || ', ' || {_SHOW.format("c.r_name")} AS line
        FROM d JOIN c USING ({RID}) WHERE """ + " OR ".join(f"d.{x} IS DISTINCT FROM c.{x}" for x in CELLS),
    "align_rows": f"{_F} SELECT d.{RID}, d.n_name AS before, c.n_name AS after FROM d JOIN c USING ({RID}) WHERE d.n_name IS NOT NULL",
    "review_sample": f"""{_F}, b AS (SELECT d.{RID}, d.n_name IS DISTINCT FROM c.n_name AS changed FROM d JOIN c USING ({RID})),
        one AS (SELECT {RID} FROM b WHERE changed ORDER BY md5('42|' || {RID}), {RID} LIMIT 90),
        two AS (SELECT {RID} FROM b WHERE {RID} NOT IN (SELECT {RID} FROM one) ORDER BY md5('42|rest|' || {RID}), {RID} LIMIT 60)
        SELECT {RID}, 'changed' AS stratum FROM one UNION ALL SELECT {RID}, 'random' FROM two""",
    "except_rows": f"{_F} SELECT {RID}, n_name FROM d WHERE {RID} NOT IN (SELECT {RID} FROM t WHERE n_name = 'NATION_1' OR n_regionkey = 2)",
    "detection_only": f"""{_F}, cells AS ({_LONG}), m AS (SELECT "column", NOT {_EQ.format(a="dirty", b="truth")} AS error,
            "column" = 'n_name' AND (dirty IS NULL OR dirty LIKE '%x') AS changed FROM cells)
        SELECT coalesce("column", 'all') AS "column", count(*) FILTER (error AND changed) AS tp, count(*) FILTER (changed AND NOT error) AS fp,
               count(*) FILTER (error AND NOT changed) AS fn, count(*) FILTER (NOT error AND NOT changed) AS tn FROM m GROUP BY GROUPING SETS (("column"), ())""",
    "sparse_mask": "SELECT documents.doc_id, coalesce(quality = 0, false) AS poor, coalesce(toxic = 1, false) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "run_aggregate": """WITH r AS (SELECT source AS "column", doc_id // 20 % 4 AS run, avg(quality) AS f1, avg(toxic) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
        SELECT "column", count(*) AS runs, round(avg(f1), 6) AS f1_mean, round(stddev_pop(f1), 6) AS f1_sd, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_sd
        FROM r GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT run) FROM r)""",
    "agent_usage": """WITH e AS (SELECT role AS agent, length(text) AS p, len(string_split(text, ' ')) AS c FROM conversations)
        SELECT coalesce(agent, 'all') AS agent, CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(c) AS BIGINT) AS completion, CAST(sum(p + c) AS BIGINT) AS tokens,
               round(sum(p + c) / (SELECT sum(p + c) FROM e), 6) AS share FROM e GROUP BY GROUPING SETS ((agent), ())""",
    "usage_by_level": """WITH e AS (SELECT conv_id AS run, turn AS task, role AS agent, length(text) AS p, len(string_split(text, ' ')) AS c FROM conversations)
        SELECT CASE grouping(run, task, agent) WHEN 0 THEN 'agent' WHEN 1 THEN 'task' WHEN 3 THEN 'run' ELSE 'all' END AS level, run, task, agent,
               CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(c) AS BIGINT) AS completion, CAST(sum(p + c) AS BIGINT) AS tokens, round(sum(p + c) / (SELECT sum(p + c) FROM e), 6) AS share
        FROM e GROUP BY ROLLUP (run, task, agent)""",
    "rejections": "SELECT count(*) AS rejections FROM conversations WHERE turn % 2 = 1 AND role = 'user'",
}
