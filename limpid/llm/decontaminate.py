"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows of 13 words are the sets to find, and their shingles of three
words the elements. A document holds a window only if it holds all of its
shingles, so with shingles ordered from rare to common (document frequencies
over the whole corpus) the necessary prefix is one shingle, the rarest. The
corpus is read once to count the benchmark's shingles and once more for the
places of prefix shingles; Spark joins these with the windows. The shingle's
offset in the window fixes the only possible alignment, which must lie inside
the document; there the words are compared one by one.

Both readings look shingles up in a bitmap of bounded size, which may pass some
that the benchmark does not hold, never lose one; the joins settle which. So
the number of readings and what executors hold do not depend on the size of
the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import covered, given, gram_hashes, named, payload, private, signed, stored, text_hashes, utf8

#: bytes.translate table: A-Z lower-cased, ASCII other than letters and digits blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of texts whose words are hashed together, and of words that are not hashed one by one.
HASHED_AT_ONCE, LONG_WORD = 1 << 20, 64
#: The bytes of an integer of eight that belong to a word of so many bytes.
WORD_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Shingles counted before a task hands its counts on.
COUNTS_HELD = 1 << 20
#: Windows, a line of text each, that may be broadcast.
FEW_WINDOWS = 50_000
#: Bytes of hit documents' rows, each with its items, that may be broadcast.
FEW_BYTES = 16 << 20
#: Parts that a shingle's places are dealt to where windows are not broadcast: one of common words may be in very many places.
PARTS = 16


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased."""
    return text.translate(WORD_BYTES).split()


@F.pandas_udf(T.LongType())
def _word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words_of(payload(t))) for t in texts], dtype="int64")


def shingles_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, distinct from those of other sizes."""
    return gram_hashes(hashes, size) ^ np.uint64(size)


def hashed_together(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= HASHED_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


class Words:
    """The words of some texts, one text's after the other's, and a hash of each.

    Hashes are made of eight bytes of all words at a time. They only choose
    candidates, whose words are compared.
    """

    def __init__(self, texts: list[bytes]):
        self.text = b"".join([b" ", b" ".join(texts), b" " * 9]).translate(WORD_BYTES)
        inside = np.frombuffer(self.text, np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begins, self.ends = edges[::2], edges[1::2]
        #: Where each text's words begin among all; at last, how many there are.
        self.bounds = np.searchsorted(self.begins, np.cumsum([1, *(len(t) + 1 for t in texts)]))
        size = self.ends - self.begins
        eights = np.ndarray(len(self.text) - 7, "<u8", self.text, strides=(1,))
        self.hashes = size.astype(np.uint64)
        some = np.arange(len(size))
        for at in range(0, LONG_WORD, 8):
            some = some[size[some] > at]
            x = self.hashes[some] ^ eights[self.begins[some] + at] & WORD_MASKS[np.minimum(size[some] - at, 8)]
            x *= np.uint64(0xFF51AFD7ED558CCD)
            self.hashes[some] = x ^ (x >> np.uint64(32))
        for i in some[size[some] > LONG_WORD].tolist():
            self.hashes[i] = xxhash.xxh3_64_intdigest(self.text[self.begins[i] : self.ends[i]])

    def between(self, begin: int, end: int) -> list[bytes]:
        return self.text[self.begins[begin] : self.ends[end - 1]].split()

    def shingles(self, size: int, bitmap: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles that the bitmap passes: their text's number, their first word's, and their hash."""
        hashes = shingles_of(self.hashes, size)
        at = np.flatnonzero(bitmap.holds(hashes))
        of = np.searchsorted(self.bounds, at, "right") - 1
        whole = at + size <= self.bounds[of + 1]  # within one text
        return of[whole], at[whole], hashes[at[whole]]


def _windows(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(payload(text.as_py()))
                found = dict.fromkeys(b" ".join(words[i : i + size]).decode() for i in range(max(1, len(words) - size + 1))) if words else {}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(list(found), pa.string())], names=["item", "window"])

    return windows


def _listed(shingle: int):
    """Each window's shingles and their first places; a window of fewer words is one shingle."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for windows in hashed_together(w.encode() for w in batch.column(0).to_pylist()):
                words = Words(windows)
                for window, begin, end in zip(windows, words.bounds[:-1], words.bounds[1:], strict=True):
                    size = min(shingle, int(end - begin))
                    values, first = np.unique(shingles_of(words.hashes[begin:end], size), return_index=True)
                    rows += [(window.decode(), int(end - begin), size, v, at) for v, at in zip(signed(values).tolist(), first.tolist(), strict=True)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["window", "words", "size", "shingle", "offset"])

    return listed


class Bitmap:
    """A set of 64-bit hashes as two bits each: it may hold more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = self._set(hashes & self.mask)
        passed = np.flatnonzero(found)  # few, as a rule
        found[passed] = self._set((hashes[passed] >> np.uint64(32)) & self.mask)
        return found

    def _set(self, x: np.ndarray) -> np.ndarray:
        return (self.bits[(x >> np.uint64(3)).view(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def bitmap_of(hashes: DataFrame, column: str, most_bits: int) -> Bitmap:
    """A bitmap of a column, of 1024 bits a value but at most ``most_bits`` in all, in pieces of 4 KB that executors fill."""
    wanted = 1024 * max(1, hashes.select(column).distinct().count())
    bits = 1 << min(max(15, (wanted - 1).bit_length()), max(15, (most_bits - 1).bit_length()))
    places = [x.bitwiseAND(F.lit(bits - 1)) + 1 for x in (F.col(column), F.shiftrightunsigned(column, 32))]
    placed = hashes.select(F.explode(F.array(*places)).alias("place"))
    pieces = placed.groupBy(F.bitmap_bucket_number("place").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        out[(r["piece"] - 1) * 4096 :][:4096] = np.frombuffer(r["bits"], np.uint8)[: len(out)]
    return Bitmap(out)


def _document_counts(shared, sizes: list[int]):
    """How many documents hold each shingle that the bitmap passes, summed up within a task."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, n = shared.value, [], 0

        def summed() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(times)], names=["shingle", "n"])

        for batch in batches:
            for texts in hashed_together(payload(t.as_py()) for t in batch.column(0)):
                words = Words(texts)
                for size in sizes:
                    of, _, x = words.shingles(size, bitmap)
                    order = np.lexsort((x, of))
                    of, x = of[order], x[order]
                    held.append(x[np.flatnonzero(np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (of[1:] != of[:-1])]))])
                    n += len(held[-1])
                if n >= COUNTS_HELD:
                    yield summed()
                    held, n = [], 0
        yield summed()

    return counts


def _places(shared, sizes: list[int], window: int, shingle: int):
    """Where a document's shingles pass the bitmap, and the words around that a window could cover.

    A shingle of fewer words than ``shingle`` is a whole window, so nothing around it counts.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        names = ["t1", "t2", "shingle", "place", "before", "around"]
        for batch in batches:
            cols, done = [[] for _ in names], 0
            t1, t2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for texts in hashed_together(payload(t.as_py()) for t in batch.column(2)):
                words = Words(texts)
                bounds = words.bounds.tolist()
                for size in sizes:
                    reach = window - size if size == shingle else 0
                    for of, at, x in zip(*(v.tolist() for v in words.shingles(size, bitmap)), strict=True):
                        begin = max(bounds[of], at - reach)
                        around = words.between(begin, min(bounds[of + 1], at + size + reach))
                        row = (t1[done + of], t2[done + of], x - (x >> 63 << 64), at - bounds[of], at - begin, [w.decode() for w in around])
                        for col, value in zip(cols, row, strict=True):
                            col.append(value)
                done += len(texts)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return places


@F.pandas_udf(T.LongType())
def _covered_words(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([int(covered(np.asarray(s, np.int64), np.asarray(e, np.int64), int(max(e))).sum()) for s, e in zip(starts, ends, strict=True)], dtype="int64")


def prefixes_of(windows: DataFrame, texts: DataFrame, shingle: int, most_bits: int) -> DataFrame:
    """``window, words, size, shingle, offset``: each window's rarest shingle, of the windows all of whose shingles occur in the corpus."""
    spark = texts.sparkSession
    table = stored(windows.mapInArrow(_listed(shingle), "window string, words int, size int, shingle long, offset int"))
    sizes = [r["size"] for r in table.select("size").distinct().collect()]  # at most as many as ``shingle`` says
    shared = spark.sparkContext.broadcast(bitmap_of(table, "shingle", most_bits))
    counted = texts.select("text").mapInArrow(_document_counts(shared, sizes), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    ranked = table.join(counted, "shingle", "left").groupBy("window", "words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("p"))
    return stored(ranked.where("p.n > 0").select("window", "words", "size", "p.shingle", "p.offset"))


def occurrences(texts: DataFrame, prefixes: DataFrame, window: int, shingle: int, most_bits: int) -> DataFrame:
    """``t1, t2, start, end, window``: where the windows occur in the texts that have these hashes."""
    spark = texts.sparkSession
    sizes = [r["size"] for r in prefixes.select("size").distinct().collect()]
    shared = spark.sparkContext.broadcast(bitmap_of(prefixes, "shingle", most_bits))
    found = texts.mapInArrow(_places(shared, sizes, window, shingle), "t1 long, t2 long, shingle long, place int, before int, around array<string>")
    if prefixes.count() <= FEW_WINDOWS:
        candidates = found.join(F.broadcast(prefixes), "shingle")
    else:
        dealt = prefixes.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        candidates = found.withColumn("dealt", F.pmod(F.xxhash64("t1", "t2", "place"), F.lit(PARTS)).cast("int")).join(dealt, ["shingle", "dealt"])
    begin = F.col("before") - F.col("offset")
    inside = (begin >= 0) & (begin + F.col("words") <= F.size("around"))  # the window lies inside the document
    same = F.array_join(F.slice("around", begin + 1, F.col("words")), " ") == F.col("window")
    start = F.col("place") - F.col("offset")
    return candidates.where(F.when(inside, same).otherwise(False)).select("t1", "t2", start.alias("start"), (start + F.col("words")).alias("end"), "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20, shingle: int = 3, most_bits: int = 1 << 27) -> DataFrame:
    """``docs`` with a struct ``hits``: n_words, n_hit, items (sorted), contaminated.

    A document word inside any occurrence of a window (``window`` consecutive
    item words; an item with fewer, but some, is one window) is hit. A
    document is contaminated when it has a hit and ``share`` times its hits
    are at least its words. ``shingle`` is the words of the elements that the
    join works on, ``most_bits`` the size of the bitmap that goes to the
    executors (16 MB by default): both change what the job costs, never what
    it finds.

    Each row of ``docs`` comes back with its columns (but a column ``hits``,
    in any case, is replaced) and is judged on its own: repeated rows get
    equal results. Null and empty texts have no words and no hits; null or
    wordless items have no windows. An item with a null id still hits words,
    but is not listed.
    """
    t1, t2 = text_hashes(named(text_col))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), utf8(named(text_col)).alias("text"))
    holders = stored(benchmark.select(named(item_id).cast("string").alias("item"), utf8(named(item_text)).alias("text")).mapInArrow(_windows(window), "item string, window string").distinct())
    prefixes = prefixes_of(holders.select("window").distinct(), texts, min(shingle, window), most_bits)
    found = stored(occurrences(texts, prefixes, window, min(shingle, window), most_bits).distinct())
    spans = found.select("t1", "t2", "start", "end").distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    items = found.select("t1", "t2", "window").distinct().join(holders, "window").select("t1", "t2", "item").distinct().groupBy("t1", "t2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    by_text = stored(spans.select("t1", "t2", _covered_words("s.start", "s.end").alias("n_hit")).join(items, ["t1", "t2"]))
    # A row is two hashes, a number and its items, whose number is not bounded: what may be broadcast is counted in bytes.
    if (by_text.agg(F.sum(48 + 12 * F.size("items") + F.octet_length(F.array_join("items", "")))).first()[0] or 0) <= FEW_BYTES:
        by_text = F.broadcast(by_text)
    a, b, c, d, e, f, g = private(docs, "t1", "t2", "t1_hit", "t2_hit", "n_hit", "items", "n_words")
    joined = docs.withColumns({a: t1, b: t2, g: _word_count(utf8(named(text_col)))}).join(by_text.toDF(c, d, e, f), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left")
    n_words, n_hit = F.col(g), F.coalesce(F.col(e), F.lit(0)).cast("long")
    hits = F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce(F.col(f), F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"))
    return joined.select(*given(docs, "hits"), hits.alias("hits"))
