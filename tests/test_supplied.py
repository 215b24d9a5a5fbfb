"""Supplied functions and analysers, run logs, exported code."""

import json
import time

import pandas as pd
from pyspark.sql import functions as F

from limpid.plans import export
from limpid.plans.cleaning import clean_table
from limpid.plans.supplied import PairFunctions, apply_series_cleaner, drained, run_supplied
from limpid.sources import datasets
from limpid.sources.datasets import Settings
from limpid.sources.tables import load_table, with_row_ids
from limpid.streaming import logs
from limpid.streaming.profiles import latest_steps, trace_stream


def frame(spark, n, **columns):
    return spark.createDataFrame(pd.DataFrame({"rid": range(n)} | {k: [f(i) for i in range(n)] for k, f in columns.items()}))


def test_supplied_functions_have_a_time_limit_and_name_their_error(spark):
    table = frame(spark, 4, v=lambda i: f" {i}")
    out, error = run_supplied(table, lambda df: apply_series_cleaner(df, "v", lambda s: s.str.strip(), "rid"))
    assert error is None and {r["v"] for r in out.collect()} == {"0", "1", "2", "3"}

    def broken(s):
        raise ValueError("no such column")

    out, error = run_supplied(table, lambda df: apply_series_cleaner(df, "v", broken, "rid"))
    assert "no such column" in error and out is table

    def slow(s):
        time.sleep(60)
        return s

    began = time.monotonic()
    out, error = run_supplied(table, lambda df: apply_series_cleaner(df, "v", slow, "rid"), seconds=3)
    assert error == "Stopped after 3 seconds." and out is table and time.monotonic() - began < 40


def test_stops_leave_the_session_whole(spark):
    """Ten functions in turn that never end, each followed by a Python job on all cores that succeeds."""
    table = frame(spark, 40, v=lambda i: f" {i}").repartition(4)

    def endless(s):
        while True:
            try:
                time.sleep(0.01)
            except Exception:  # what stops it is no Exception
                pass

    for _ in range(10):
        out, error = run_supplied(table, lambda df: apply_series_cleaner(df, "v", endless, "rid"), seconds=0.5)
        assert error == "Stopped after 0.5 seconds." and out is table
        assert apply_series_cleaner(table, "v", lambda s: s.str.strip(), "rid").where("v = cast(rid as string)").count() == 40


def test_jobs_are_cancelled_where_python_does_not_come_back(spark, monkeypatch):
    """The last resort, with a function that no timer reaches."""
    monkeypatch.setattr("limpid.plans.supplied.stopping", lambda f: f)
    monkeypatch.setattr("limpid.plans.supplied.time_limit.__wrapped__.__defaults__", (30.0, 0.5))
    table = frame(spark, 8, v=str).repartition(4)
    out, error = run_supplied(table, lambda df: apply_series_cleaner(df, "v", lambda s: time.sleep(60) or s, "rid"), seconds=1)
    assert error == "Stopped after 1 seconds." and out is table
    assert apply_series_cleaner(table, "v", lambda s: s, "rid").count() == 8 and drained(spark) is None


def test_functions_of_two_columns_in_a_whole_run(spark):
    table = frame(spark, 30, city=lambda i: ["Gent", "Brugge"][i % 2], code=lambda i: None if i == 3 else f"K{i % 2}")
    fill = lambda t: t.assign(code=t["code"].fillna("K1"))
    finder = PairFunctions({("city", "code"): fill, ("code", "city"): lambda t: t.head(1), ("city", "none"): fill})
    cleaned, report = clean_table(table, "rid", table_cleaners=[finder])
    assert {r["code"] for r in cleaned.collect()} == {"K0", "K1"}
    assert [(s.target, s.outcome) for s in report.steps if s.kind == "SUPPLIED"] == [("city → code", "enforced"), ("code → city", "failed")]
    assert "as long as" in finder.errors["code", "city"]


class Lengths:
    def analyse(self, df, column, kind):
        return {"longest": df.agg(F.max(F.char_length(F.col(column).cast("string")))).first()[0]} if column == "city" else {}


class Broken:
    def analyse(self, df, column, kind):
        raise KeyError(column)


class FillFromLeft:
    task_type = "FILL"

    def detect(self, df, rid, columns):
        return [("city", "code"), ("code", "city")]

    def get_data(self, df, task):
        return df.where(F.col(task[1]).isNull()).first()

    def settle(self, df, rid, task):
        return df.withColumn(task[1], F.coalesce(task[1], task[0]))


def test_analysers_and_table_cleaners(spark):
    table = frame(spark, 30, city=lambda i: ["Gent", "Brugge"][i % 2], code=lambda i: None if i == 3 else f"K{i % 2}")
    cleaned, report = clean_table(table, "rid", analysers=[Lengths(), Broken()], table_cleaners=[FillFromLeft()])
    assert report.notes["city"]["longest"] == 6 and report.notes["code"] == {"errors": ["'code'"]}
    assert cleaned.where("code is null").count() == 0
    assert [(s.target, s.outcome) for s in report.steps if s.kind == "FILL"] == [("city → code", "enforced"), ("code → city", "already clean")]


def test_merged_code_repeats_the_run(spark):
    table = frame(spark, 60, city=lambda i: ["Gent", "Brugge", "GENT " if i == 7 else "Gent", "Bruge" if i == 9 else "Brugge"][i % 4], price=lambda i: f"{10 + i % 7}.50 kg", flag=lambda i: ["YES", "no"][i % 2])
    cleaned, report = clean_table(table, "rid")
    code = export.script("x_dirty.csv", "out", "rid", report)
    compile(code, "script", "exec")
    names = {}
    exec("from pyspark.sql import functions as F\nfrom limpid.operators import dependencies as fd\nfrom limpid.operators import rules\n" + export.merged_code(report), names)
    assert sorted(map(tuple, names["clean_dataset"](table).collect())) == sorted(map(tuple, cleaned.collect()))
    assert {s.target: s.validated for s in report.steps if s.kind not in ("CATEGORY", "DEPENDENCY")} == {"city": True, "price": False, "flag": False}
    assert {r["flag"] for r in cleaned.collect()} == {"yes", "no"}


def test_the_script_runs(spark, tmp_path, capsys):
    (tmp_path / "x_dirty.csv").write_text("city,price\n" + "".join(f"{'Gent ' if i == 4 else 'Gent'},{i}\n" for i in range(20)))
    source = str(tmp_path / "x_dirty.csv")
    _, report = clean_table(with_row_ids(load_table(spark, source), "rid"), "rid", Settings(clean_columns=("price",)))
    exec(export.script(source, str(tmp_path / "out"), "rid", report), {})
    assert "1 cells changed" in capsys.readouterr().out
    assert {r["city"] for r in load_table(spark, str(tmp_path / "out" / "x_cleaned.csv")).collect()} == {"Gent"}


def test_a_run_is_logged(spark, tmp_path):
    table = frame(spark, 30, city=lambda i: ["Gent ", "Brugge"][i % 2])
    _, report = clean_table(table, "rid")
    folder = str(tmp_path / "trace")
    for at in (1, 2):
        logs.append_trace(report.trace(table, at), folder)
    (tmp_path / "trace" / "more.json").write_text("no json\n")
    assert [r["step"] for r in report.trace(table, 1).collect()][:4] == ["recommender_1", "coder_1", "validator_1", "finished"]
    run = trace_stream(spark, folder).writeStream.format("memory").queryName("trace_rows").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("trace_rows").count() == 2 * report.trace(table, 1).count()
    assert {r["at"] for r in latest_steps(spark.table("trace_rows")).collect()} == {2}


def test_the_end_of_a_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    logs.append_log(spark, folder, [f"a {i}" for i in range(400)])
    time.sleep(1.1)
    logs.append_log(spark, folder, [f"b {i}" for i in range(299)] + ["two\nlines"])
    got = [r["line"] for r in logs.last_lines(spark, folder).orderBy("place").collect()]
    assert got == [f"a {i}" for i in range(200, 400)] + [f"b {i}" for i in range(299)] + ["two lines"]
    assert [r["line"] for r in logs.last_lines(spark, folder, 2).orderBy("place").collect()] == ["b 298", "two lines"]


def test_stored_results_and_runtimes(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"scores": [1]}))
    (tmp_path / "t.json").write_text(json.dumps({"beers": 3}))
    assert datasets.stored_results(tmp_path / "r.json") == {"scores": [1]}
    assert [datasets.stored_runtime(tmp_path / f, n) for f, n in (("t.json", "beers"), ("t.json", "tax"), ("none.json", "tax"))] == [3.0, -1.0, -1.0]
