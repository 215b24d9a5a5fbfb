"""Whole-table cleaning against a known truth, and what settings change."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid.operators import scoring, validation
from limpid.plans.cleaning import clean_table
from limpid.plans.supplied import apply_pair_cleaner
from limpid.plans.demo import FLAT, TRUTH, made
from limpid.plans.sql_program import run
from limpid.sources.datasets import Settings

FOLDER = "/root/testdata/sf0.001"


def test_a_dirty_table_is_cleaned(spark):
    """Detection and correction F1 over all cells of a table whose names and regions were spoilt or taken out."""
    dirty, truth = made(spark, FOLDER, FLAT), made(spark, FOLDER, TRUTH)
    cleaned, report = clean_table(dirty, "o_orderkey")
    got = scoring.scores(scoring.counts(scoring.masks(dirty, cleaned, truth, "o_orderkey"))).where("column is null").first()
    assert got["errors"] > 20 and got["detection_f1"] >= 0.95 and got["correction_f1"] >= 0.95, got
    assert report.outcomes()["enforced"] >= 2


def rows(n, **columns):
    return pd.DataFrame({"rid": range(n)} | {k: [f(i) for i in range(n)] for k, f in columns.items()})


def test_settings_and_rules_take_effect(spark):
    table = spark.createDataFrame(rows(60, city=lambda i: ["Gent", "Brugge", "GENT " if i == 7 else "Gent", "Bruge" if i == 9 else "Brugge"][i % 4], price=lambda i: "9999.5" if i == 3 else f"{10 + i % 7}.5", tags=lambda i: "a;b; c" if i % 10 else "a|b|c"))
    cleaned, _ = clean_table(table, "rid", Settings(outlier_policy="null"))
    got = {r["rid"]: r for r in cleaned.collect()}
    assert {r["city"] for r in got.values()} == {"Gent", "Brugge"}
    assert got[3]["price"] is None and got[4]["price"] == 14.5
    assert {r["tags"] for r in got.values()} == {"a;b;c"}
    kept, _ = clean_table(table, "rid", Settings(clean_columns=("city", "price", "tags")))
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, table.collect()))
    sentinel, _ = clean_table(table, "rid", Settings(sentinels=(9999.5,)))
    assert sentinel.where("price is null").count() == 1


def test_rules_that_spoil_are_rejected(spark):
    table = spark.createDataFrame(rows(20, a=lambda i: f"Word{i}", b=lambda i: f"long text number {i}"))
    spoil = {"a": F.lower("a"), "b": F.substring("b", 1, 3)}
    cleaned, report = clean_table(table, "rid", cleaner=lambda df, c, kind: spoil[c])
    assert sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, table.collect())) and report.outcomes() == {"rejected": 2}
    found = {r["column"]: r for r in validation.change_problems(table, spoil).collect()}
    assert found["a"]["recased"] and found["b"]["shortened"] and not found["a"]["emptied"]


def test_cleaners_of_two_columns(spark):
    table = spark.createDataFrame(rows(6, l=lambda i: str(i % 2), r=lambda i: None if i == 5 else "x"))
    out = apply_pair_cleaner(table, "l", "r", lambda t: t.assign(r=t["r"].fillna("y")))
    assert out.where("r = 'y'").count() == 1
    with pytest.raises(Exception, match="left column"):
        apply_pair_cleaner(table, "l", "r", lambda t: t.assign(l="z")).collect()


def test_tables_are_matched_by_place_where_ids_are_foreign(spark):
    a, b = spark.createDataFrame(rows(5, v=str)), spark.createDataFrame(rows(5, v=str)).withColumn("rid", F.col("rid") * 3 + 100)
    got = scoring.aligned_by_place(a, b, "rid").collect()
    assert len(got) == 5 and all(r["left"]["v"] == r["right"]["v"] for r in got)
    assert scoring.aligned_by_place(a, b.limit(4), "rid").count() == 0


def test_programs_take_the_relation_by_its_whole_name(spark):
    table = spark.createDataFrame(rows(3, v=lambda i: "from dirty"))
    sql = "WITH dirty_x AS (SELECT * FROM dirty), b AS (SELECT rid, v FROM dirty_x) SELECT b.rid, b.v, 'FROM dirty' AS note FROM b join `dirty` d ON d.rid = b.rid"
    got = run(table, sql).collect()
    assert len(got) == 3 and got[0]["note"] == "FROM dirty"
