"""Importance resampling to a target's distribution, with n-grams read off suffix arrays.

A task numbers the words of its texts and sorts, block by block, all suffixes
of their concatenation by their first words. Neighbours in that order share a
prefix, whose length is kept; a run of neighbours that share m words is all
occurrences of one m-gram. Its bytes are hashed once a run, and the bucket goes
back to the places of the occurrences, for counting and for scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import LOWER_BYTES, few, named, payload, released, stored, utf8
from limpid.operators.ranks import kth_smallest

#: Words of a block whose suffixes are sorted together: a place and two ranks then fit in 64 bits.
BLOCK_WORDS = 1 << 20
#: Words that a task remembers the number of before it starts anew.
WORDS_NUMBERED = 1 << 20
#: bytes.translate table: A-Z lower-cased, all other ASCII that is no letter or digit made a blank.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in LOWER_BYTES)


class Words:
    """Numbers of words from 1, with their bytes and check sums; 0 stands between texts."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bytes: list[bytes] = [b""]
        self.sums: list[int] = [0]

    def of(self, words: list[bytes]) -> np.ndarray:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(self.bytes)
            self.bytes.append(w)
            self.sums.append(crc32(w))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes that begin there, told by their first ``depth`` words or more; by doubling."""
    place_bits, rank, h = np.uint64(len(ids).bit_length()), ids, 1
    while True:
        following = np.zeros_like(rank)
        if h < depth:
            following[:-h] = rank[h:]
        bits = int(following.max(initial=0)).bit_length()
        key = (rank << bits | following).view(np.uint64)
        key = key << place_bits | np.arange(len(ids), dtype=np.uint64)
        key.sort()
        order = (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        if 2 * h >= depth:
            return order
        new = np.r_[True, np.diff(key >> place_bits) > 0]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        h *= 2


def shared_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words each suffix shares with the one before it in the order, up to ``depth``; words between texts share none."""
    padded = np.r_[ids, np.zeros(depth, np.int64)]
    same, out = np.ones(len(order), bool), np.zeros(len(order), np.int64)
    same[:1] = False
    before = np.r_[0, order[:-1]]
    for m in range(depth):
        same &= (padded[order + m] == padded[before + m]) & (padded[order + m] > 0)
        out += same
    return out


def bucket_places(ids: np.ndarray, words: Words, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``grams``: the places where such an n-gram begins, and its bucket there."""
    order = suffix_order(ids, grams)
    shared = shared_prefixes(ids, order, grams)
    whole = ids > 0
    for m in range(1, grams + 1):
        if m > 1:
            whole = whole & np.r_[ids[m - 1 :] > 0, np.zeros(min(m - 1, len(ids)), bool)]
        inside = whole[order]
        places = order[inside]
        begins = shared[inside] < m  # suffixes that hold no such n-gram share less with all others
        run = np.cumsum(begins) - 1
        first = places[begins]
        sums = [words.sums[i] for i in ids[first].tolist()]
        for at in range(1, m):
            sums = [crc32(b" " + words.bytes[i], s) for i, s in zip(ids[first + at].tolist(), sums, strict=True)]
        yield places, (np.array(sums, np.int64) % buckets)[run] if len(run) else run


def pieces(texts: list[list[bytes]], grams: int) -> Iterator[tuple[list[int], list[list[bytes]], list[int]]]:
    """Blocks of texts: their numbers, their words, and how many of these an n-gram may begin with.

    A text of more words than a block has several pieces, which overlap by one word less than the longest n-gram.
    """
    owner, words, own, n = [], [], [], 0
    for i, text in enumerate(texts):
        for begin in range(0, max(len(text), 1), BLOCK_WORDS):
            piece = text[begin : begin + BLOCK_WORDS + grams - 1]
            if n and n + len(piece) > BLOCK_WORDS:
                yield owner, words, own
                owner, words, own, n = [], [], [], 0
            owner.append(i)
            words.append(piece)
            own.append(min(BLOCK_WORDS, len(text) - begin))
            n += len(piece) + 1
    if owner:
        yield owner, words, own


def text_buckets(texts: list[list[bytes]], words: Words, grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of the text and the bucket of every n-gram of every text, some at a time."""
    for owner, block, own in pieces(texts, grams):
        if len(words.bytes) > WORDS_NUMBERED:
            words.forget()
        sizes = np.array([len(w) for w in block])
        ids = np.zeros(int((sizes + 1).sum()), np.int64)
        begins = np.r_[0, np.cumsum(sizes + 1)[:-1]]
        for b, w in zip(begins.tolist(), block, strict=True):
            ids[b : b + len(w)] = words.of(w)
        text = np.repeat(np.arange(len(block)), sizes + 1)
        of, limit = np.array(owner)[text], (begins + np.array(own))[text]
        for places, found in bucket_places(ids, words, grams, buckets):
            mine = places < limit[places]
            yield of[places[mine]], found[mine]


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[list[bytes]]]]:
    """Batches whose texts fill a block together, with their words; a large batch comes in slices of one text or more."""
    held, texts, n = [], [], 0
    for batch in batches:
        at = 0
        for i, text in enumerate(batch.column(column)):
            words = split_words(payload(text.as_py()))
            texts.append(words)
            n += len(words)
            if n >= BLOCK_WORDS:
                yield [*held, batch.slice(at, i + 1 - at)], texts
                held, texts, n, at = [], [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield held, texts


def _counts(grams: int, buckets: int):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros(buckets, np.int64)
        for _, texts in _gathered(released(batches), 0):
            for _, found in text_buckets(texts, words, grams, buckets):
                sums += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    return counts


def _weights(grams: int, buckets: int, gains):
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gain = Words(), gains.value
        for held, texts in _gathered(released(batches), 1):
            total, features = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for of, found in text_buckets(texts, words, grams, buckets):
                features += np.bincount(of, minlength=len(texts))
                total += np.bincount(of, gain[found], minlength=len(texts)).astype(np.int64)  # whole numbers far below 2^53
            ids = pa.concat_arrays([b.column(0) for b in held])
            n_words = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, n_words, pa.array(features), pa.array(total // np.maximum(features, 1))], names=["id", "n_words", "n_features", "weight"])

    return weights


def bucket_counts(texts: DataFrame, text_col: str, grams: int, buckets: int) -> np.ndarray:
    """Occurrences of n-grams by bucket over all rows; the driver gets a row a bucket."""
    found = texts.select(utf8(named(text_col)).alias("text")).mapInArrow(_counts(grams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) by bucket, in doubles."""
    b = len(raw)
    s_all, t_all = float(raw.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """Standard Gumbel noise in thousandths, rounded down, from the key and seed alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` from 1: ranges of the order are sorted apart and numbered from the count of those before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = dealt.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row a partition
    before, begins = 0, []
    for r in counts:
        begins.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(begins, "part long, before long")
    return dealt.join(few(offsets), part == F.col("part")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at")


def resample_to_target(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", grams: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_features, weight, score, rank.

    A-Z are lower-cased; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. The
    features of a text are all its runs of 1 to ``grams`` words, repeats
    counted, in the bucket of their CRC-32. Both models count all rows of their
    table, with one more in each bucket. ``weight`` is the mean gain of the
    features, rounded down; ``score`` adds the id's noise. Of the N rows of at
    least ``least_words`` words the N * percent // 100 with the highest scores
    are drawn and ranked from 1, ties by smaller id; others have no rank.

    Null and wordless texts have no features and weigh 0. Rows with a null id
    share one noise value, and come first of a tie. Repeated rows have equal
    scores and ranks one after another. An empty target is an even one. No
    name of other columns matters, for they are not kept.
    """
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, target_text_col, grams, buckets)))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    weighed = docs.select(named(id_col).alias("id"), utf8(named(text_col)).alias("text")).mapInArrow(_weights(grams, buckets, gains), schema)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    last = -kth_smallest(long_enough, -F.col("score"), drawn) if drawn else None
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= last) if drawn else F.lit(False)
    # Equal rows differ by their place in the stored table alone, which keeps many of them from one range.
    placed = scored.where(chosen).withColumn("place", F.monotonically_increasing_id())
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    first = ranked(placed, [F.desc("score"), F.asc("id"), F.asc("place")]).withColumn("rank", rank).drop("place")
    out = first.unionByName(scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
