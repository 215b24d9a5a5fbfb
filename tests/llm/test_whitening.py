"""Whitening against plain arithmetic in whole numbers of any size."""

import math
from fractions import Fraction

import numpy as np
import pytest

from limpid.llm import queries
from limpid.llm.whitening import deviations, exact_scatter, fit_whitening, is_prime, primes_above, remaindered, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, white string, x int"


def fixed(vector):
    return tuple(math.floor(256 * float(c)) for c in vector)


def brute(vectors, k=4):
    """Distinct fixed vectors, their sums, and the covariance as fractions."""
    seen = list(dict.fromkeys(map(fixed, vectors)))
    n, sums = len(seen), [sum(c) for c in zip(*seen, strict=True)]
    centred = [[n * v - s for v, s in zip(x, sums, strict=True)] for x in seen]
    size = len(sums)
    scatter = [[sum(r[i] * r[j] for r in centred) for j in range(size)] for i in range(size)]
    covariance = np.array([[float(Fraction(v, n**3)) for v in row] for row in scatter])
    values, columns = np.linalg.eigh(covariance)
    return n, sums, scatter, values[::-1][:k], columns[:, ::-1][:, :k], np.trace(covariance)


def made(seed, rows, size, spread=1.0, shift=0.0):
    rng = np.random.default_rng(seed)
    return (shift + spread * rng.normal(size=(rows, size)) @ rng.normal(size=(size, size))).tolist()


def test_query(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, _, values, columns, trace = brute([r["embedding"] for r in given])
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 4 * len(given)
    by = {(r["vec_id"], r["component"]): r for r in got}
    mean = np.array([float(Fraction(s, n)) for s in sums])
    signs = {}
    for r in given:
        x = fixed(r["embedding"])
        for k in range(4):
            found = by[r["vec_id"], k + 1]
            want = (np.array(x) - mean) @ columns[:, k] / math.sqrt(values[k])
            sign = signs.setdefault(k, 1 if found["whitened"] * want > 0 else -1)
            assert found["whitened"] == pytest.approx(sign * want, abs=1e-9)
            assert found["deviation"] == sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert found["n"] == n and found["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
            assert found["identity_error"] < 1e-9


@pytest.mark.parametrize(("spread", "shift"), [(1.0, 0.0), (1e-2, 1e6), (1e9, -1e12)])
def test_scatter_is_exact(spark, spread, shift):
    """Means far from zero and entries of forty bits leave no rounding in it."""
    vectors = made(1, 40, 5, spread, shift)
    n, sums, scatter, *_ = brute(vectors)
    distinct = spark.createDataFrame([(list(x),) for x in dict.fromkeys(map(fixed, vectors))], "x array<long>").repartition(3)
    seen = list(map(fixed, vectors))
    reach = max(max(c) - min(c) for c in zip(*seen, strict=True))
    assert exact_scatter(distinct, 5, n, sums, reach) == scatter


def test_copies_are_fitted_once_and_rows_stay(spark):
    """A third of all rows is one vector; copies by fixed entries count as copies."""
    vectors = made(2, 60, 6)
    rows = [(i, v, "a", 1) for i, v in enumerate(vectors)] + [(None, vectors[0], None, None)] * 30 + [(7, [c + 1e-9 for c in vectors[3]], "b", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    model, alone = fit_whitening(df, "embedding"), fit_whitening(df.where("vec_id is not null").limit(60), "embedding")
    assert model.n == len({fixed(r[1]) for r in rows}) and alone.n >= 59
    out = whiten(df, model, "embedding")
    assert out.columns == ["vec_id", "embedding", "x", "white"] and out.count() == len(rows)
    assert len({tuple(r["white"]["whitened"]) for r in out.where("vec_id is null").collect()}) == 1


def test_awkward_vectors(spark):
    """Null vectors and entries, no entries, infinities, other lengths and values that no long holds."""
    nan, inf = float("nan"), float("inf")
    good = made(3, 30, 3)
    rows = [(i, v) for i, v in enumerate(good)] + [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df, "embedding")
    out = whiten(df, model, "embedding").collect()
    assert sorted(r["vec_id"] for r in out) == list(range(30)) and model.size == 3 and len(model.values) == 3
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = fit_whitening(huge, "embedding")
    assert found.n == 3 and [r["white"]["deviation"] for r in whiten(huge, found, "embedding").collect()][:2] == [None, None]


def test_no_rows_and_no_variance(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert fit_whitening(df, "embedding") is None and whiten(df, None, "embedding").count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model = fit_whitening(same, "embedding")
    assert model.n == 1 and len(model.values) == 0
    assert [r["white"]["whitened"] for r in whiten(same, model, "embedding").collect()] == [[], []]


def test_deviations_beyond_a_long():
    x = np.array([[3, 4], [10**9, 0], [3_037_000_499, 0], [3_037_000_500, 0]])
    assert deviations(x, 1, [0, 0]) == [25, 10**18, 3_037_000_499**2, None]


def test_remainders():
    moduli = primes_above(10**40)
    assert all(map(is_prime, moduli)) and len(set(moduli)) == len(moduli)
    for v in (0, 1, -1, 10**39, -(10**39) + 7):
        assert remaindered([v % p for p in moduli], moduli) == v
