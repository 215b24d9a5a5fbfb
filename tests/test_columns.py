"""What whole columns are and how they are written: roles, marks, date orders, spellings, patterns, objections."""

import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from limpid.operators import patterns, profile, roles, rules, spelling, validation
from limpid.plans.cleaning import clean_table
from limpid.sources.datasets import Settings


def frame(spark, n, **columns):
    return spark.createDataFrame(pd.DataFrame({"rid": range(n)} | {k: [f(i) for i in range(n)] for k, f in columns.items()}))


def values(spark, *given):
    return spark.createDataFrame(list(enumerate(given)), "rid long, v string")


def test_identifiers_and_years_are_not_spoilt(spark):
    """Leading zeros, letters beside digits, and codes far from the others stay; look-alike letters in numbers are read as digits."""
    table = frame(
        spark, 60, zip=lambda i: f"{(i * 1237) % 99991:05d}" if i % 9 else "01000", phone=lambda i: str(2053250000 + i * 104729), founded=lambda i: "I999" if i == 5 else str(1950 + i % 60),
        stock=lambda i: {3: "1O", 4: "x5", 5: "199O", 6: "5000"}.get(i, str(10 + i % 17)), weight=lambda i: {7: "1O.5", 8: "12 stones"}.get(i, f"{i % 9}.5 kg"), id=lambda i: str(i * i),
    )
    cleaned, report = clean_table(table, "rid", Settings(outlier_policy="null"))
    was, now = {r["rid"]: r for r in table.collect()}, {r["rid"]: r for r in cleaned.collect()}
    assert all(now[i][c] == was[i][c] for i in was for c in ("zip", "phone", "id"))
    assert now[5]["founded"] == "1999" and all(now[i]["founded"] == was[i]["founded"] for i in was if i != 5)
    assert now[3]["stock"] == 10 and now[4]["stock"] is None and now[6]["stock"] is None and now[0]["stock"] == 10
    assert now[7]["weight"] is None or now[7]["weight"] == 10.5
    assert now[8]["weight"] is None and now[0]["weight"] == 0.5
    assert {c: report.notes[c]["role"] for c in ("zip", "phone", "founded", "stock", "id")} == {"zip": "identifier", "phone": "identifier", "founded": "year", "stock": "quantity", "id": "identifier"}


def test_roles(spark):
    table = frame(spark, 200, area=lambda i: f"{i % 50:03d}", salary=lambda i: str(10000 + 500 * (i % 160)), shop=lambda i: str(i % 7), row=str, text=lambda i: f"word{i}", brewery_id=lambda i: str(i % 9), few=lambda i: None if i else "3")
    counts = profile.value_counts(table, "rid")
    got = {r["column"]: r["role"] for r in roles.column_roles(counts).collect()}
    assert got == {"area": "identifier", "salary": "quantity", "shop": "quantity", "row": "identifier", "text": "none", "brewery_id": "identifier", "few": "quantity"}
    assert {r["column"]: r["role"] for r in roles.column_roles(counts, keys=["shop"]).collect()}["shop"] == "identifier"
    assert [c for c in ("id", "ZipCode", "Phone Number", "width", "paid", "PhoneNumber", "article_jissue", "userID") if roles.named_as_identifier(c)] == ["id", "ZipCode", "Phone Number", "PhoneNumber", "userID"]


def test_numbers_are_read_by_the_columns_mark(spark):
    us, european = values(spark, "1,234", "1.5", "2.25", "7", None), values(spark, "1.234", "1,5", "2,25", "7", None)
    assert rules.decimal_mark(us, "rid") == "." and rules.decimal_mark(european, "rid") == ","
    read = lambda df, mark: [r["x"] for r in df.orderBy("rid").select(rules.plain_number(F.col("v"), mark).alias("x")).collect()]
    assert read(us, ".") == [1234.0, 1.5, 2.25, 7.0, None] and read(european, ",") == [1234.0, 1.5, 2.25, 7.0, None]
    assert read(values(spark, "12 kg", "$5", "5 %", "3 stones", "12a34", "1e3", "~ 4", "12.0 oz.", "-2.5 C"), ".") == [12.0, 5.0, 5.0, None, None, 1000.0, 4.0, 12.0, -2.5]


def test_one_order_of_day_and_month_for_a_column(spark):
    """American dates, nearly all with days up to twelve."""
    table = frame(spark, 60, day=lambda i: "10/25/2021" if i == 3 else "2021-03-04" if i == 4 else f"{1 + i % 12:02d}/{1 + i * 5 % 12:02d}/2020")
    cleaned, report = clean_table(table, "rid")
    got = {r["rid"]: r["day"] for r in cleaned.collect()}
    assert got[4] == "03/04/2021" and all(got[r["rid"]] == r["day"] for r in table.where("rid <> 4").collect())
    assert rules.date_formats(table.select("rid", "day"), "rid")[0] == "MM/dd/yyyy"
    noted = values(spark, *["22 March 2014 (USA)"] * 3, "3 May 2015", "31 April 2015")
    assert [r["d"] for r in noted.orderBy("rid").select(rules.dates(F.col("v"), "d MMMM yyyy").alias("d")).collect()] == ["22 March 2014"] * 3 + ["3 May 2015", None]


def test_spellings_cluster_alike_at_any_size(spark):
    words = ["dothan"] * 40 + ["birmingham"] * 32 + ["dxthxn", "birminghxm", "birmingxm", "doxhan"] + ["austin"] * 20 + ["boston"] * 20 + ["code12"] * 20 + ["code13"] + ["20532587"] * 20 + ["2053x587"]
    table = spark.createDataFrame(list(enumerate(words)), "rid long, v string")
    want = {("dxthxn", "dothan"), ("doxhan", "dothan"), ("birminghxm", "birmingham"), ("birmingxm", "birmingham"), ("2053x587", "20532587")}
    assert {tuple(r) for r in spelling.spelling_map(table, "v", "rid").collect()} == want
    copies = table.join(spark.range(100).withColumnRenamed("id", "copy")).select((F.col("rid") + F.col("copy") * 1000).alias("rid"), "v")
    assert {tuple(r) for r in spelling.spelling_map(copies, "v", "rid").collect()} == want


def test_chains_of_slips_end_at_their_root(spark):
    words = ["segment"] * 100 + ["segmant"] * 20 + ["segmand"] * 4
    table = spark.createDataFrame(list(enumerate(words)), "rid long, v string")
    assert {tuple(r) for r in spelling.spelling_map(table, "v", "rid").collect()} == {("segmant", "segment"), ("segmand", "segment")}


@pytest.mark.parametrize("edits", [1, 2])
def test_near_pairs_are_all_found(spark, edits):
    """The segment join against all pairs, over words of few letters."""
    import random

    draw = random.Random(edits)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 9))) for _ in range(150)})
    table = spark.createDataFrame([(w,) for w in words], "folded string")
    got = {(r["a"]["folded"], r["b"]["folded"]) for r in spelling.near_pairs(table, table, edits).collect()}
    pairs = table.select(F.col("folded").alias("x")).join(table.select(F.col("folded").alias("y"))).where((F.levenshtein("x", "y") <= edits) & (F.col("x") != F.col("y"))).collect()
    assert got == {(r["x"], r["y"]) for r in pairs if min(len(r["x"]), len(r["y"])) > edits}


def mended(spark, *given):
    table = values(spark, *given)
    pattern = patterns.dominant_pattern(table, "rid")
    return pattern and [r["x"] for r in table.orderBy("rid").select(patterns.patterned(F.col("v"), pattern).alias("x")).collect()]


def test_values_follow_the_dominant_pattern(spark):
    most = ["12.0 oz", "16.0 oz", "8.4 oz"] * 10
    assert mended(spark, *most, "12.0 oz.", "12oz", "9.00 OZ", None)[30:] == ["12.0 oz", "12.0 oz", "9.0 oz", None]
    assert mended(spark, *most, "oz 12", "12.05 oz", "12.0 ounce", "12.0 oz can", "")[30:] == ["oz 12", "12.05 oz", "12.0 ounce", "12.0 oz can", ""]
    phones = ["205-555-1234", "334-123-9876"] * 10
    assert mended(spark, *phones, "(205) 555-1234", "2055551234", "205.555.1234", "205-55-1234", "205-555-1234 x9")[20:] == ["205-555-1234"] * 3 + ["205-55-1234", "205-555-1234 x9"]
    codes = ["ABCD1234", "XYZA0001"] * 10
    assert mended(spark, *codes, "ABcD1234", "ABCD-1234", "ABCD12345", "ABCD")[20:] == ["ABCD1234", "ABCD1234", "ABCD12345", "ABCD"]
    assert mended(spark, *["Gent", "Brugge"] * 10, "St. Paul") is None  # words alone are no codes
    assert mended(spark, *["a1", "b-2", "3c"] * 5) is None and mended(spark, None, None) is None


def test_patterns_in_a_whole_run(spark):
    table = frame(spark, 60, code=lambda i: {7: "AB 0017", 9: "ab-0019"}.get(i, f"AB-{i:04d}"))
    cleaned, report = clean_table(table, "rid")
    assert {r["code"] for r in cleaned.collect()} == {f"AB-{17 if i == 7 else 19 if i == 9 else i:04d}" for i in range(60)}


def objections(table, **changes):
    return {r["column"]: {k for k in validation.PROBLEMS if r[k]} for r in validation.change_problems(table, changes).collect()}


def test_objections(spark):
    table = frame(spark, 40, day=lambda i: f"2020-01-{i % 28 + 1:02d}", rate=lambda i: f"{i % 9 + 1}.5%", name=lambda i: f"Song {i} (2013)", clock=lambda i: f"{i % 12 + 1}:30 PM", size=lambda i: f"{i} kg")
    got = objections(
        table, day=F.regexp_replace("day", "-", "/"), rate=(F.regexp_replace("rate", "%", "").cast("double") / 100).cast("string"), name=F.regexp_replace("name", r" \(.*\)", ""),
        clock=F.concat(F.regexp_extract("clock", "^[0-9]+", 0).cast("int") + 12, F.lit(":30")), size=F.regexp_replace("size", " kg", ""),
    )
    assert got["day"] == {"reseparated", "reshaped"} and "scaled" in got["rate"] and {"unbracketed", "reshaped"} <= got["name"]
    assert "reshaped" in got["clock"] and "scaled" not in got["size"] and "emptied" not in got["size"]
    assert objections(table, day=F.trim("day"), name=F.col("name")) == {"day": set(), "name": set()}
    empty = table.where("rid < 0")
    assert objections(empty, day=F.upper("day")) == {"day": set()}


def test_changes_are_judged_once_for_equal_cells(spark):
    """Every cell went through every pattern, twice, and in the table's own few tasks; equal changes are now one row with its cells."""
    table = frame(spark, 600, day=lambda i: f"2020-01-{i % 28 + 1:02d}", code=lambda i: None if i % 6 == 0 else f"ab{i % 5}").withColumn("gone", F.lit(None).cast("string"))
    changes = {"day": F.regexp_replace("day", "-", "/"), "code": F.when(F.col("code") != "ab1", F.upper("code")), "gone": F.lit("x")}
    pairs = {(r["column"], r["a"], r["b"]): r["n"] for r in validation.value_changes(table, changes).collect()}
    assert len(pairs) == 28 + 6 + 1 and sum(pairs.values()) == 3 * 600
    assert pairs["gone", None, "x"] == 600 and pairs["code", None, None] == 100 and pairs["code", "ab1", None] == 100 and pairs["code", "ab2", "AB2"] == 100
    got = {r["column"]: r for r in validation.change_problems(table, changes).collect()}
    assert {c: r["changed"] for c, r in got.items()} == {"day": 600, "code": 500, "gone": 600}
    assert got["code"]["recased"] and not got["gone"]["reshaped"] and got["day"]["reseparated"]


def test_rules_that_change_the_form_are_rejected_in_a_run(spark):
    table = frame(spark, 40, day=lambda i: f"2020-01-{i % 28 + 1:02d}", rate=lambda i: f"{i % 9 + 1}.5%")
    change = {"day": F.regexp_replace("day", "-", "/"), "rate": F.regexp_replace("rate", "%", "").cast("double") / 100}
    cleaned, report = clean_table(table, "rid", cleaner=lambda df, c, kind: change[c], table_cleaners=[])
    assert report.outcomes() == {"rejected": 2} and sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, table.collect()))


def test_columns_without_a_change_are_already_clean(spark):
    table = frame(spark, 30, city=lambda i: ["Gent", "Brugge"][i % 2], price=lambda i: f"{i % 7}.50")
    cleaned, report = clean_table(table, "rid", table_cleaners=[])
    assert report.outcomes() == {"already clean": 2} and cleaned.schema == table.schema


def slow_cleaner(df, column, kind):
    """A measurement of half a second, as a job of one task."""
    df.sparkSession.sparkContext.parallelize([0], 1).map(lambda x: time.sleep(0.5)).count()


def test_columns_are_measured_side_by_side(spark):
    table = frame(spark, 30, **{f"n{k}": str for k in range(10)})
    took = {}
    for workers in (1, 8):
        began = time.monotonic()
        _, report = clean_table(table, "rid", Settings(workers=workers), cleaner=slow_cleaner, table_cleaners=[])
        took[workers] = time.monotonic() - began
        assert report.outcomes() == {"already clean": 10}
    assert took[1] - took[8] > 2.0, took  # of five seconds of measuring more than two are saved


def test_a_run_is_cancelled(spark):
    table = frame(spark, 30, **{f"n{k}": str for k in range(10)})
    cancel = threading.Event()

    def cleaner(df, column, kind):
        if column == "n0":
            return F.concat(F.col("n0"), F.lit("!"))
        cancel.set()
        df.sparkSession.sparkContext.parallelize([0], 1).map(lambda x: time.sleep(30)).count()

    began = time.monotonic()
    cleaned, report = clean_table(table, "rid", Settings(workers=2), cleaner=cleaner, cancel=cancel)
    assert time.monotonic() - began < 25 and report.outcomes()["cancelled"] == 10
    assert cleaned.count() == 30 and not [s for s in report.steps if s.kind == "DEPENDENCY"]
    assert clean_table(table.select("rid", "n1"), "rid")[1].steps  # the session goes on
