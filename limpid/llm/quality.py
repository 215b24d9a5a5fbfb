"""Quality by importance resampling.

Texts are bags of word uni- and bigrams hashed to a fixed number of buckets.
Two generative models, one of target texts and one of all raw texts, give each
text the logarithm of its importance weight, the sum over its n-grams of the
log ratio of the two models. Adding Gumbel noise and taking the k largest
draws k texts without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import LOWER_BYTES, WordHashes, checkpointed, gram_hashes, named, payload, utf8

BUCKETS = 10_000
#: Keys are compared in steps of this size.
STEP = 1e-6


#: N-grams that a task gathers before it counts them.
GRAMS_HELD = 1 << 21


def buckets_of(text: bytes, memory: WordHashes) -> np.ndarray:
    hashes = memory.of(text.translate(LOWER_BYTES).split())
    return (np.concatenate([gram_hashes(hashes, 1), gram_hashes(hashes, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(target_ids):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, memory = target_ids.value, WordHashes()
        sums = {True: np.zeros(BUCKETS, np.int64), False: np.zeros(BUCKETS, np.int64)}  # of target texts, of the others
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        n = 0

        def count() -> None:
            for kind, grams in held.items():
                if grams:
                    sums[kind] += np.bincount(np.concatenate(grams), minlength=BUCKETS)
                    grams.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = buckets_of(payload(text.as_py()), memory)
                held[doc in target].append(grams)
                n += len(grams)
                if n >= GRAMS_HELD:
                    count()
                    n = 0
        count()
        raw = sums[True] + sums[False]
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(sums[True][at])], names=["bucket", "raw", "target"])

    return counts


def _weigher(ratios):
    @F.pandas_udf(T.DoubleType())
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memory, ratio = WordHashes(), ratios.value
        for series in texts:
            yield pd.Series([float(ratio[buckets_of(payload(t), memory)].sum()) for t in series], dtype="float64")

    return weigh


def log_ratios(docs: DataFrame, target_ids: list, id_col: str, text_col: str) -> np.ndarray:
    """Per bucket the log ratio of the target model to the raw model, each smoothed by one count a bucket.

    Raw counts cover all rows; target counts those whose id is in ``target_ids``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(target_ids))
    table = docs.select(named(id_col).alias("id"), utf8(named(text_col)).alias("text")).mapInArrow(_counts(shared), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in table.collect():  # one row a bucket at most
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(values: DataFrame, column: str, k: int, ways: int = 4096) -> int | None:
    """The k-th largest value of an integer column, by histograms of ``ways`` bins that close in on it."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = (high - low) // ways + 1
        bins = values.where(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - F.lit(low)) / F.lit(width)).alias("bin")).count().collect()
        for row in sorted(bins, key=lambda r: -r["bin"]):
            if k <= row["count"]:
                low, high = low + row["bin"] * width, min(high, low + (row["bin"] + 1) * width - 1)
                break
            k -= row["count"]
        else:
            return low
    return low


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(2**53)
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_rows: int = 20_000, share: float | None = None, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: its id, log_weight, sample_key, selected.

    The target is the labelled documents of good quality that are not toxic,
    at most ``target_rows`` of them (those with the smallest id hashes): the
    only sampled thing here. The raw model counts all rows. ``share`` of the
    rows are selected, by default the target's share of the labels; rows that
    tie with the last one selected (repeated rows) are selected too. Null and
    empty texts weigh 0. Rows with a null id share one noise value. Without
    any target label all rows weigh the same against an even model.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where(named(id_col).isNotNull() & F.col("quality").isNotNull()).select(named(id_col).alias("id"), good.alias("good"))
    if share is None:
        share = known.agg(F.avg(F.col("good").cast("int"))).first()[0]
        share = 1.0 if share is None else share
    ids = known.where("good").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(target_rows)
    ratios = log_ratios(docs, [r[0] for r in ids.collect()], id_col, text_col)
    weight = _weigher(docs.sparkSession.sparkContext.broadcast(ratios))(utf8(named(text_col)))
    weighed = docs.select(named(id_col).alias("id"), weight.alias("log_weight")).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("id"), seed))
    scored = checkpointed(weighed.withColumn("rank_key", F.round(F.col("sample_key") / STEP).cast("long")))
    last = kth_largest(scored, "rank_key", round(share * scored.count()))
    selected = F.lit(False) if last is None else F.col("rank_key") >= last
    return scored.select(F.col("id").alias(id_col), "log_weight", "sample_key", selected.alias("selected"))
