"""Planted marks for missing values are found, and frequent values that mean something are not."""

import random

from limpid.operators import profile
from limpid.operators.disguised import disguised_missing
from limpid.plans.cleaning import clean_table
from limpid.sources.datasets import Settings


def planted(spark, seed=3, n=3000):
    """Marks at random in five columns; decoys: a default price of one region, zeros of a count, a list's commonest word, a common first name."""
    draw, rows = random.Random(seed), []
    names = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    for i in range(n):
        region = draw.choice(["north", "south", "east", "west"])
        mark = lambda share: draw.random() < share
        rows.append((
            i, region, "-1" if mark(0.04) else str(draw.randint(18, 90)), "9999" if mark(0.03) else f"{draw.uniform(1, 100):.2f}", "99/99" if mark(0.03) else f"{draw.randint(1, 28):02d}.{draw.randint(1, 12):02d}.20{draw.randint(10, 20)}",
            "Add a Plot" if mark(0.05) else " ".join(draw.choice(names) for _ in range(6)), "500.0" if region == "north" and mark(0.3) else f"{draw.uniform(1, 100):.2f}",
            str(0 if mark(0.3) else draw.randint(1, 60)), "Anna" if mark(0.1) else draw.choice(names),
        ))
    return spark.createDataFrame(rows, "rid long, region string, age string, price string, day string, plot string, fee string, visits string, name string")


WANT = {("age", "-1"), ("price", "9999"), ("day", "99/99"), ("plot", "Add a Plot")}


def test_recall_and_precision(spark):
    for seed in (3, 4, 5):
        table = planted(spark, seed)
        got = {(r["column"], r["value"]) for r in disguised_missing(table, "rid", profile.value_counts(table, "rid")).collect()}
        assert got == WANT, seed


def test_nothing_to_find(spark):
    table = planted(spark).selectExpr("rid", "region", "name")
    assert disguised_missing(table, "rid", profile.value_counts(table, "rid")).count() == 0
    assert disguised_missing(table.where("rid < 0"), "rid", profile.value_counts(table.where("rid < 0"), "rid")).count() == 0


def test_they_become_null_in_a_run(spark):
    table = planted(spark)
    cleaned, report = clean_table(table, "rid", Settings(), table_cleaners=[])
    for column, value in WANT:
        n = table.where(f"`{column}` = '{value}'").count()
        assert n > 0 and cleaned.where(f"`{column}` is null").count() == n, column
    assert cleaned.where("cast(fee as double) = 500").count() == table.where("fee = '500.0'").count() and cleaned.where("cast(visits as double) = 0").count() > 0
    kept, _ = clean_table(table, "rid", Settings(disguised=False), table_cleaners=[])
    assert kept.where("plot = 'Add a Plot'").count() == table.where("plot = 'Add a Plot'").count()
