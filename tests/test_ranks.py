"""Ranks, medians and numbers by closing in, against sorted lists."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from limpid.operators.ranks import kth_smallest, median, numbered


@pytest.mark.parametrize("kind", ["close", "wide", "ties", "whole"])
def test_ranks_and_medians(spark, kind):
    draw = random.Random(1)
    make = {"close": lambda: 1 + draw.random() * 1e-12, "wide": lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300), "ties": lambda: float(draw.choice([1, 1, 1, 2, 7])), "whole": lambda: float(draw.randint(-(10**12), 10**12))}[kind]
    for n in (1, 2, 101, 400):
        values = [make() for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        for k in {1, 2, n // 2 + 1, n}:
            want = sorted(values)[k - 1] if k <= n else None
            assert kth_smallest(df, F.col("x"), k, bins=8) == want
        assert median(df, F.col("x"), few=0) == median(df, F.col("x")) == statistics.median(values)
    assert median(df.limit(0), F.col("x")) is None and kth_smallest(df, F.col("x"), 401) is None


def test_numbers_in_buckets(spark):
    ids = random.Random(2).sample(range(10**9), 500)
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    for rows in (1, 7, 100, 1000):
        got = {r["i"]: r["place"] for r in numbered(df, "i", "place", rows if rows > 1 else 20).collect()}
        assert got == {v: k + 1 for k, v in enumerate(sorted(ids))}
    assert numbered(df.limit(0), "i", "place").count() == 0
