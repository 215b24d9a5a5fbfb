import json

import pytest

from limpid.__main__ import main
from limpid.sources import datasets, tables
from limpid.sources.datasets import Settings


def test_csv_rules(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n1,"x, ""y""",NA\n2,short\n3,too,many,fields\nnull,"two\nlines",nan\n')
    rows = [tuple(r) for r in tables.load_table(spark, str(tmp_path / "x.csv")).collect()]
    assert rows == [("1", 'x, "y"', None), ("2", "short", None), (None, "two\nlines", None)]


def test_unknown_and_missing(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.load_table(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, str(tmp_path / "none.csv"))


@pytest.mark.parametrize("suffix", ["csv", "json", "parquet", "orc"])
def test_save_and_load(spark, tmp_path, suffix):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, abv double")
    paths = [tables.save_table(df, f"x_dirty.{suffix}", str(tmp_path / "out")) for _ in range(2)]
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"x_cleaned.{suffix}", f"x_cleaned_2.{suffix}"]
    back = tables.load_table(spark, paths[0])
    assert sorted((r["name"], None if r["abv"] is None else float(r["abv"])) for r in back.collect()) == [("a", 0.5), ("b", None)]


def test_nan_and_row_ids(spark):
    df = spark.createDataFrame([(float("nan"), "N/A"), (1.0, "x")], "d double, s string").repartition(1)
    assert sorted(map(str, (r["d"] for r in tables.missing_as_null(df).collect()))) == ["1.0", "None"]
    assert [r["_rid"] for r in tables.with_row_ids(spark.range(100).repartition(5)).collect()] == list(range(100))


def test_stored_runs(spark, tmp_path):
    for n in ("beers_cleaned.csv", "beers_cleaned_2.csv", "beers_cleaned_10.csv", "beersx_cleaned.csv"):
        (tmp_path / n).write_text("a\n1\n")
    assert [r["run"] for r in tables.stored_runs(spark, str(tmp_path), "beers").collect()] == [1, 2, 10]


def test_masks(spark):
    dense = spark.createDataFrame([(0, "1", "0"), (1, "true", None)], "rid int, a string, b string")
    assert {(r["rid"], r["column"]) for r in tables.dense_mask(dense, "rid").collect()} == {(0, "a"), (1, "a")}
    sparse = spark.createDataFrame([(0, 1), (2, 0), (None, 1), (3, 9)], "i int, j int")
    assert {(r["rid"], r["column"]) for r in tables.sparse_mask(sparse, ["a", "b"]).collect()} == {(0, "b"), (2, "a")}


def test_names(tmp_path):
    assert datasets.dirty_next_to("d/x_gt.csv").name == "x_dirty.csv"
    assert datasets.numeric_columns("beers_gt.csv") == ("id", "ounces", "abv", "ibu", "brewery_id") and datasets.numeric_columns("other_gt.csv") is None
    assert [p.name for p in datasets.resolve("beers")] == ["beers_dirty.csv", "beers_gt.csv"]
    with pytest.raises(FileNotFoundError):
        datasets.resolve("nothing")


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 7, "least_score": "bad", "other": 1, "sample_sizes": {"clean": 5, "dirty": -1, "x": 3}, "clean_columns": ["a"]}))
    s = Settings.load(str(tmp_path / "c.json"))
    assert (s.seed, s.least_score, s.sample_sizes["clean"], s.sample_sizes["dirty"], s.clean_columns) == (7, 0.925, 5, 500, ("a",)) and "x" not in s.sample_sizes
    assert Settings.load(str(tmp_path / "none.json")) == Settings()
    sized = s.with_sample_size(9)
    assert sized.sample_sizes["dirty"] == 9 and sized.sample_sizes["long"] == s.sample_sizes["long"]


def test_commands(spark, tmp_path, capsys):
    rows = [(i % 4, "City" + str(i % 4)) for i in range(40)]
    write = lambda name, change: (tmp_path / name).write_text("code,city\n" + "".join(f"K{a},{change(i, b)}\n" for i, (a, b) in enumerate(rows)))
    write("x_gt.csv", lambda i, b: b)
    write("x_dirty.csv", lambda i, b: "Citi9" if i == 5 else b)
    assert main(["clean", str(tmp_path / "x_dirty.csv"), "--out", str(tmp_path / "out"), "--results", str(tmp_path / "r.json"), "--notebook", str(tmp_path / "n.ipynb"), "--seed", "3", "--runs", "2", "--review", str(tmp_path / "review"), "--sample-size", "7"]) == 0
    result = json.loads((tmp_path / "r.json").read_text())
    assert result["scores"][0]["column"] is None and result["scores"][0]["correction_f1"] == 1.0
    overall = next(r for r in result["mean"] if r["column"] == "all")
    assert len(set(result["runs"])) == 2 and overall["runs"] == 2 and overall["correction"] == "100.0%" and overall["detection_recall_mean"] == 1.0 and overall["correction_f1_sd"] == 0.0
    reviews = spark.read.json(result["review"]["city"]) if "city" in result["review"] else None
    assert reviews is None or reviews.where("stratum = 'random'").count() <= 7
    assert json.loads((tmp_path / "n.ipynb").read_text())["nbformat"] == 4
    assert main(["evaluate", str(tmp_path / "x_gt.csv"), str(tmp_path / "x_gt.csv")]) == 0
