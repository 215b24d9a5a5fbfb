"""``python -m limpid clean|evaluate|score``."""

from __future__ import annotations

import argparse
import json
import time
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions.equality import lenient_equal
from limpid.functions.text import percent
from limpid.operators import sampling, scoring
from limpid.plans import export
from limpid.plans.cleaning import Report, clean_table
from limpid.sources.datasets import Settings, dirty_next_to, numeric_columns, resolve
from limpid.sources.tables import RID, load_table, save_table, stored_runs, with_row_ids
from limpid.streaming.logs import append_trace

#: What is averaged over runs.
METRICS = [f"{k}_{m}" for k in ("detection", "correction") for m in ("precision", "recall", "f1")]


def _numbered(spark: SparkSession, path: str | Path) -> DataFrame:
    return with_row_ids(load_table(spark, str(path)))


def evaluate(dirty: DataFrame, cleaned: DataFrame, truth: DataFrame, numeric: tuple[str, ...] | None) -> DataFrame:
    """Scores by column, and of the whole table in the row without a column."""
    scoring.same_shape(dirty, cleaned, truth)
    cells = scoring.masks(dirty, cleaned, truth, RID, lenient_equal, list(numeric) if numeric else None)
    return scoring.scores(scoring.counts(cells)).orderBy(F.col("column").asc_nulls_first())


def mean_of(runs: list[tuple[int, DataFrame]]) -> list[dict]:
    """Mean and deviation over runs of every metric, by column and of the whole table (all), with the mean correction F1 as a percentage."""
    every = reduce(DataFrame.unionByName, [df.withColumn("run", F.lit(n)) for n, df in runs]).withColumn("column", F.coalesce("column", F.lit("all")))
    return as_json(scoring.over_runs(every, ["column"], METRICS).withColumn("correction", percent(F.col("correction_f1_mean"))))


def reviewed(dirty: DataFrame, cleaned: DataFrame, report: Report, settings: Settings, folder: str) -> dict[str, str]:
    """For each column that was worked on, rows before and after as JSON lines: changed ones, up to the size of a dirty sample, and others, up to that of a random one."""
    out = {}
    for s in report.steps:
        if s.outcome in ("cleaned", "unified", "enforced") and s.target in dirty.columns and s.target not in out:
            side = lambda df, name: df.select(RID, F.col(f"`{s.target}`").cast("string").alias(name))  # noqa: B023, E731
            pairs = side(dirty, "before").join(side(cleaned, "after"), RID)
            sizes = settings.sample_sizes
            drawn = sampling.review_sample(pairs, RID, ~F.col("before").eqNullSafe(F.col("after")), sampling.seed_of(settings.seed, "review", s.target), sizes["dirty"], sizes["random"], sizes["dirty"] + sizes["random"])
            out[s.target] = f"{folder}/{export.identifier(s.target)}"
            drawn.write.mode("overwrite").json(out[s.target])
    return out


def as_json(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]  # a row a column


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="limpid")
    commands = parser.add_subparsers(dest="command", required=True)
    clean = commands.add_parser("clean", help="clean a file, or a known dataset")
    clean.add_argument("source")
    clean.add_argument("--out", default="cleaned")
    clean.add_argument("--config")
    clean.add_argument("--seed", type=int)
    clean.add_argument("--sample-size", type=int)
    clean.add_argument("--results")
    clean.add_argument("--notebook")
    clean.add_argument("--trace", help="folder of the run's log")
    clean.add_argument("--runs", type=int, default=1, help="runs with seeds one after another; scores are of the first, and their mean over all")
    clean.add_argument("--review", help="folder for samples of each column before and after, of the sizes that the settings name")
    judge = commands.add_parser("evaluate", help="score a cleaned file against its ground truth")
    judge.add_argument("cleaned")
    judge.add_argument("truth")
    judge.add_argument("--results")
    board = commands.add_parser("score", help="score all stored runs of a dataset")
    board.add_argument("dataset")
    board.add_argument("--runs", default="cleaned")
    board.add_argument("--data", default="data")
    board.add_argument("--results")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()

    if args.command == "clean":
        source, truth = resolve(args.source)
        settings = Settings.load(args.config).merged({"seed": args.seed} if args.seed is not None else {})
        if args.sample_size:
            settings = settings.with_sample_size(args.sample_size)
        dirty = _numbered(spark, source).cache()
        cleaned, report = clean_table(dirty, RID, settings)
        path = save_table(cleaned.drop(RID), str(source), args.out)
        result = {"source": str(source), "cleaned": path, "settings": vars(settings), "steps": [vars(s) for s in report.steps]}
        more = [clean_table(dirty, RID, settings.merged({"seed": settings.seed + i}))[0] for i in range(1, args.runs)]
        result["runs"] = [path, *[save_table(df.drop(RID), str(source), args.out) for df in more]]
        if truth:
            gt, numeric = _numbered(spark, truth), numeric_columns(truth)
            scored = [evaluate(dirty, df, gt, numeric) for df in (cleaned, *more)]
            result["scores"] = as_json(scored[0])
            if more:
                result["mean"] = mean_of(list(enumerate(scored)))
        if args.review:
            result["review"] = reviewed(dirty, cleaned, report, settings, args.review)
        if args.trace:
            append_trace(report.trace(cleaned, int(time.time() * 1000)), args.trace)
        if args.notebook:
            changed = scoring.masks(dirty, cleaned, dirty, RID).where("changed").count()
            export.write_notebook(args.notebook, str(source), args.out, RID, report, changed)
    elif args.command == "evaluate":
        tables = [_numbered(spark, p) for p in (dirty_next_to(args.truth), args.cleaned, args.truth)]
        result = {"scores": as_json(evaluate(*tables, numeric_columns(args.truth)))}
    else:
        dirty_path, truth_path = resolve(args.dataset, args.data)
        dirty, truth = _numbered(spark, dirty_path).cache(), _numbered(spark, truth_path).cache()
        runs = [(r["run"], evaluate(dirty, _numbered(spark, r["path"].removeprefix("file:")), truth, numeric_columns(truth_path))) for r in stored_runs(spark, args.runs, args.dataset).collect()]
        if not runs:
            parser.error(f"No stored runs of {args.dataset} in {args.runs}")
        result = {"runs": len(runs), "mean": mean_of(runs)}
    shown = json.dumps(result, indent=2, default=str)
    if args.results:
        Path(args.results).write_text(shown)
    print(shown)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
