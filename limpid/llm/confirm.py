"""Sets of word shingles, and pairs of them confirmed on whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import LOWER_BYTES, WordHashes, few, gram_hashes, named, payload, released, stored, text_hashes, utf8

#: A set's partners are confirmed in groups of about so many, and of so many shingles.
GROUP_PAIRS, GROUP_SHINGLES = 256, 500_000
#: Most buckets of a sketch: with fewer than shingles it rules out less, never a link.
SKETCH = 4096


def shingle_set(text: bytes, memory: WordHashes, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; one for a shorter text, none for no words."""
    hashes = memory.of(text.translate(LOWER_BYTES).split())
    if len(hashes) >= width:
        return np.unique(gram_hashes(hashes, width))
    return gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes)) if len(hashes) else np.empty(0, np.uint64)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits, in two halves, that tell sets apart."""
    k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64).tolist()
    return k1, k2


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of K buckets, K being a power of two above 1.5 times their number, if that is not too many.

    The lesser counts of two sets bound their intersection from above. None if
    a bucket overflows a byte: then nothing is ruled out.
    """
    k = 64
    while 2 * k < 3 * len(shingles) and k < SKETCH:
        k *= 2
    found = np.bincount((shingles & np.uint64(k - 1)).astype(np.int64), minlength=k)
    return found.astype(np.uint8) if found.max() < 256 else np.empty(0, np.uint8)


def folded(counts: np.ndarray, k: int) -> np.ndarray:
    """A sketch with fewer buckets."""
    wide = counts.astype(np.uint16)
    while len(wide) > k:
        wide = wide[: len(wide) // 2] + wide[len(wide) // 2 :]
    return wide


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= 80 * (len(one) + len(other) - common)


def texts_of(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """``set_key, text`` with the text of one document for each of the ``keys`` (column set_key)."""
    # The id alone could be missing, or be there with other texts.
    holders = stored(sets.join(keys, "set_key").groupBy("set_key").agg(F.min(F.struct("doc", "t1", "t2")).alias("at")).select("set_key", "at.*"))
    t1, t2 = text_hashes(named(text_col))
    rows = docs.select(named(id_col).alias("own_doc"), t1.alias("own_t1"), t2.alias("own_t2"), utf8(named(text_col)).alias("text"))
    held = rows.join(few(holders), (F.col("own_t1") == F.col("t1")) & (F.col("own_t2") == F.col("t2")) & F.col("own_doc").eqNullSafe(F.col("doc")))
    return stored(held.select("set_key", "text").dropDuplicates(["set_key"]))


def _confirmed(width: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, hub, one = WordHashes(), None, None
        for batch in released(batches):
            keep = []
            for b, part, a, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                shingles = shingle_set(payload(text.as_py()), memory, width)
                if a is None:
                    hub, one = (b, part), shingles
                keep.append(a is not None and hub == (b, part) and linked(one, shingles))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirmed


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of set keys whose sets link, told on the texts.

    ``b``, of which a set that many are tied to is one, comes once for a group
    of its partners, which follow it in a sorted stream; a row has one text.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = stored(pairs)
    sized = texts.select(F.col("set_key").alias("b"), F.octet_length("text").alias("bytes"))
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).join(sized, "b")
    # Partners of one set are about as large as it is; a shingle has some eight bytes.
    groups = F.greatest(F.ceil(F.col("n") / GROUP_PAIRS), F.ceil(F.col("n") * F.col("bytes") / 8 / GROUP_SHINGLES))
    hubs = stored(hubs.select("b", F.least(groups, F.col("n")).cast("int").alias("groups")))
    dealt = pairs.join(few(hubs), "b").select("b", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("part"), "a")
    partners = dealt.join(texts, dealt["a"] == texts["set_key"]).select("b", "part", "a", "text")
    first = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")).join(texts, F.col("b") == F.col("set_key")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    ordered = first.unionByName(partners).repartition(parts, "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))
    return ordered.mapInArrow(_confirmed(width), "a long, b long")
