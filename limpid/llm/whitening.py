"""Embedding whitening: exact scatter by residue numbers, then an eigendecomposition in doubles.

Vectors become whole numbers. What is multiplied is centred first: with n
vectors and sums S of their entries, n x - S is a whole number too. Each task
multiplies matrices of these numbers' residues modulo several primes, which
doubles do without rounding; sums by prime are reduced in Spark, and Chinese
remaindering gives the scatter matrix exactly. Only then are numbers rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import given, named, stored

#: Entries are kept in steps of one part in so many.
SCALE = 256
#: Primes are the largest below this, so residues around zero are below 2^19.
LARGEST_PRIME = 1 << 20
#: Rows of a product: so many squares of residues stay below 2^53, up to which doubles hold every whole number.
ROWS_OF_PRODUCT = 1 << 14
#: Entries of a block that a task holds as whole numbers.
BLOCK_ENTRIES = 1 << 21
LONG_MOST = 2**63 - 1


@dataclass
class Whitening:
    """What was learned from the distinct vectors: their number, the sums of their entries, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of fixed vectors, one row each."""
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ (self.vectors / np.sqrt(self.values))


def is_prime(k: int) -> bool:
    return k > 1 and all(k % i for i in range(2, isqrt(k) + 1))


def primes_above(bound: int) -> list[int]:
    """The largest primes below LARGEST_PRIME whose product is above ``bound``, as few as will do."""
    out, k = [], LARGEST_PRIME
    while prod(out) <= bound:
        k -= 1
        if is_prime(k):
            out.append(k)
    return out


def remaindered(residues: list[int], moduli: list[int]) -> int:
    """The whole number nearest to zero with these residues."""
    x, m = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x - m if 2 * x > m else x


def usable(c: Column, size: int | None = None) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers; with a size, so many of them."""
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fits = F.size(c) > 0 if size is None else F.size(c) == size
    return F.coalesce(c.isNotNull() & fits & ~odd, F.lit(False))


def fixed_matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(256 c) of each entry, as whole numbers; what no 64 bits hold is kept at their ends."""
    c = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), size)
    with np.errstate(over="ignore"):
        x = np.floor(c * SCALE)
    inside = np.abs(x) < 2.0**63
    return np.where(inside, np.where(inside, x, 0).astype(np.int64), np.where(x > 0, LONG_MOST, -LONG_MOST - 1))


def fixed(size: int):
    @F.arrow_udf("array<long>")
    def of(vectors: pa.Array) -> pa.Array:
        x = fixed_matrix(vectors, size)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(x.ravel()))

    return of


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    rows = max(1, BLOCK_ENTRIES // size)
    for batch in batches:
        x = np.asarray(batch.column(0).flatten(), np.int64).reshape(batch.num_rows, size)
        for begin in range(0, len(x), rows):
            yield x[begin : begin + rows]


def _sums(size: int):
    """A task's sums by dimension, of the upper and lower 32 bits apart, and the least and greatest entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        least, most = np.full(size, LONG_MOST), np.full(size, -LONG_MOST - 1)
        for x in _blocks(batches, size):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            least, most = np.minimum(least, x.min(axis=0)), np.maximum(most, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(size), np.full(size, n), high, low, least, most)], names=["i", "n", "high", "low", "least", "most"])

    return sums


def _scatters(size: int, n: int, sums: list[int], moduli: list[int]):
    """A task's sums of products of centred entries, modulo each prime; the upper triangle."""
    i, j = np.triu_indices(size)

    def scatters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(moduli), size, size), np.int64)
        some = False
        for x in _blocks(batches, size):
            some = True
            for k, p in enumerate(moduli):
                y = ((n % p) * (x % p) - np.array([s % p for s in sums])) % p
                y = (y - p * (2 * y > p)).astype(np.float64)
                for begin in range(0, len(y), ROWS_OF_PRODUCT):
                    part = y[begin : begin + ROWS_OF_PRODUCT]
                    totals[k] = (totals[k] + (part.T @ part).astype(np.int64)) % p
        if some:
            for k in range(len(moduli)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(j), pa.array(totals[k][i, j])], names=["k", "i", "j", "sum"])

    return scatters


def exact_scatter(distinct: DataFrame, size: int, n: int, sums: list[int], reach: int) -> list[list[int]]:
    """The sum over the rows of ``distinct`` (column x) of (n x - S)(n x - S)', in whole numbers of any size.

    ``reach`` bounds the difference of two entries of one dimension. The driver gets one row for each prime and pair of dimensions.
    """
    moduli = primes_above(2 * n * (n * reach) ** 2 + 1)
    parts = distinct.mapInArrow(_scatters(size, n, sums, moduli), "k long, i long, j long, sum long")
    totals = np.zeros((len(moduli), size, size), np.int64)
    for r in parts.groupBy("k", "i", "j").agg(F.sum("sum").alias("sum")).collect():
        totals[r["k"], r["i"], r["j"]] = r["sum"] % moduli[r["k"]]
    out = [[0] * size for _ in range(size)]
    for i in range(size):
        for j in range(i, size):
            out[i][j] = out[j][i] = remaindered(totals[:, i, j].tolist(), moduli)
    return out


def leading(scatter: list[list[int]], n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors (columns) and shares of the variance of the leading components, as many as have any variance in doubles.

    The matrix that is decomposed is the covariance, each entry rounded once. Of either sign the one whose largest entry is positive is taken.
    """
    size, cube = len(scatter), n**3
    covariance = np.array([[v / cube for v in row] for row in scatter])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > max(values[0], 0) * size * np.finfo(float).eps
    values, vectors = values[kept], vectors[:, kept]
    trace = sum(scatter[i][i] for i in range(size)) / cube
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[top, np.arange(vectors.shape[1])]), values / trace if len(values) else values


def _whitened(model: Whitening):
    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches, model.size):
            w = model.projected(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names=[f"w{k}" for k in range(w.shape[1])])

    return whitened


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured on all distinct rows."""
    k = len(model.values)
    whitened = distinct.mapInArrow(_whitened(model), ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def fit_whitening(df: DataFrame, vector_col: str, components: int = 4) -> Whitening | None:
    """What whitens the vectors of ``df``, learned from each distinct fixed vector once; None without any.

    Null vectors, vectors without entries and those with null or non-finite
    entries are left out. Vectors are as long as most of them are, of equally
    common lengths the longer; others are left out too. Copies, a third of all
    rows or more, are combined before they are shuffled.
    """
    vector = named(vector_col)
    valid = df.where(usable(vector)).select(vector.alias("v"))
    lengths = valid.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    size = lengths["size"]
    distinct = stored(valid.where(F.size("v") == size).select(fixed(size)("v").alias("x")).distinct())
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    found = distinct.mapInArrow(_sums(size), "i long, n long, high long, low long, least long, most long")
    by_dimension = found.groupBy("i").agg(F.sum("n").alias("n"), whole("high").alias("high"), whole("low").alias("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("i").collect()
    n, sums = by_dimension[0]["n"], [int(r["high"]) * 2**32 + int(r["low"]) for r in by_dimension]
    reach = max(r["most"] - r["least"] for r in by_dimension)
    values, vectors, explained = leading(exact_scatter(distinct, size, n, sums, reach), n, components)
    model = Whitening(n, sums, values, vectors, explained)
    if len(values):
        model.identity_error = identity_error(distinct, model)
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None where 64 bits do not hold it.

    Sums are made modulo 2^64; an estimate in doubles tells whether that is the sum itself.
    """
    about = ((n * x.astype(np.float64) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    wrapped = x.view(np.uint64) * np.uint64(n % 2**64) - np.array([s % 2**64 for s in sums], np.uint64)
    exact = (wrapped * wrapped).sum(axis=1, dtype=np.uint64)
    out: list[int | None] = []
    for i, (a, e) in enumerate(zip(about.tolist(), exact.tolist(), strict=True)):
        if a > 0.999 * 2.0**63:  # seldom: tell it in whole numbers of any size
            e = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums, strict=True))
        out.append(e if e <= LONG_MOST else None)
    return out


def whiten(df: DataFrame, model: Whitening | None, vector_col: str) -> DataFrame:
    """The rows of ``df`` with a usable vector of the model's length, with all their columns and ``white``.

    ``white`` is a struct: deviation, exact (null where a long does not hold
    it), and whitened, one double for each component. A column named ``white``
    before is replaced. Equal vectors get equal values, whatever their ids;
    null ids stay. Without a model no row is left.
    """
    size, vector = (model.size if model else 1), named(vector_col)
    kind = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
    shared = df.sparkSession.sparkContext.broadcast(model)  # a matrix of dimensions by components

    @F.arrow_udf("struct<deviation: long, whitened: array<double>>")
    def white(vectors: pa.Array) -> pa.Array:
        model = shared.value
        x = fixed_matrix(vectors, model.size)
        w = model.projected(x)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
        return pa.StructArray.from_arrays([pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], fields=list(kind))

    rows = df.where(usable(vector, size) & F.lit(model is not None))
    return rows.select(*given(df, "white"), white(vector).alias("white"))
