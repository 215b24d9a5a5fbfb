"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.sources.store import shared_folder, stored

#: Characters that separate words and that line keys are stripped of: blank and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z and leaves all other bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Entries that a worker keeps in a per-word memory before it starts anew.
WORDS_KEPT = 200_000


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast.
FEW_ROWS = 250_000


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A stored table marked for broadcast if its count says that it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def named(name: str) -> Column:
    """A column by its name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def private(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as it takes to clash with no column of ``df``, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def given(df: DataFrame, added: str) -> list[Column]:
    """All columns of ``df`` but one that has the name of the column to be added, in any case."""
    return [named(c) for c in df.columns if c.lower() != added.lower()]


def text_hash(column: Column) -> Column:
    """A hash of a text that tells null and empty apart."""
    return F.xxhash64(column, column.isNull())


def text_hashes(column: Column) -> tuple[Column, Column]:
    """128 bits in two halves that tell texts apart, null from empty too."""
    return text_hash(column), F.xxhash64(F.lit("second"), column)


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def utf8(column: Column) -> Column:
    """A text as UTF-8 bytes; null stays null."""
    return column.cast("string").cast("binary")


class WordHashes(dict):
    """64-bit hashes of words, kept between documents up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a multiplicative hash, on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for i in range(n):
        out *= base
        out += hashes[i : i + count]
    return mixed(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """True at the positions below ``length`` inside any [start, end)."""
    delta = np.zeros(length + 1, np.int64)
    np.add.at(delta, np.clip(starts, 0, length), 1)
    np.add.at(delta, np.clip(ends, 0, length), -1)
    return np.cumsum(delta[:-1]) > 0


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; then Arrow's unused memory goes back, for the worker lives on."""
    yield from batches
    pa.default_memory_pool().release_unused()


def payload(value) -> bytes:
    """A binary cell as bytes; null as none."""
    return b"" if value is None or value is pd.NA else bytes(value)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in a batch that goes to Python, for texts can be long and workers share an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
