"""Substring dedup by compacting a de Bruijn graph of words.

Token k-mers are the graph's edges, of which each window of 35 words keeps the
one with the smallest hash. Equal windows keep the same edge at the same place,
so a text is a chain of kept edges, each standing for the run of windows that
chose it; the words which that run covers are the edge's span.

* Occurrences are dealt out by ranges of (edge, span, text), so that those of
  an edge lie side by side and an edge of any frequency spreads over many
  tasks. One pass over the sorted ranges, and a grouped count where a cut runs
  through, tell how often each span occurs and what follows it.
* Spans that occur again are the nodes. A node whose occurrences all go on to
  one other node, with as many occurrences, does not branch there. Such links
  compact by rounds of joins: a piece of a path takes in the piece that its
  end is linked to. A path stands for all of its occurrences.
* The spans of an edge that diverges, of which some occur once, are opened
  into single windows.
* Source coordinates lead back to the texts. The words of each path and of
  each opened window are read there and hashed to 128 bits anew; what is found
  again is a repeat. So 64-bit hashes choose only where to look.

Texts are told apart by 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import WordHashes, covered, few, given, gram_hashes, mixed, named, payload, private, signed, stored, text_hashes, utf8

#: ``place`` packs where a span is: 32 bits for its first window, and so many each for its other windows and for the edge's offset.
BITS = 16
#: Rounds of joins in which paths compact; links that are left only cost time.
ROUNDS = 6
_NODE = np.uint64(0xD6E8FEB86659FD93)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def smallest_edges(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` grams the index of its smallest, the first of equals."""
    value, index, span = grams, np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        take = value[step:] < value[:-step]
        value = np.where(take, value[step:], value[:-step])
        index = np.where(take, index[step:], index[:-step])
        span += step
    return index


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words in each [start, end)."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, len(hashes)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(hashes))[starts] + (ends - starts).astype(np.uint64))


def _edges(window: int, k: int):
    """The kept edges of each text, with a name for what follows each."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            parts = []
            for t1, t2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = payload(text.as_py()).split()
                if len(words) < window:
                    continue
                hashes = memory.of(words)
                grams = gram_hashes(hashes, k)
                edge = smallest_edges(grams, window - k + 1)
                first = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
                last = np.r_[first[1:] - 1, len(edge) - 1]
                at = edge[first]
                place = first << 2 * BITS | (last - first) << BITS | (at - first)
                span = _span_hashes(hashes, first, last + window)
                node = mixed(grams[at] * _NODE + span)
                parts.append((signed(grams[at]), signed(span), signed(node), np.r_[signed(node)[1:], 0], np.full(len(first), t1), np.full(len(first), t2), place))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 7
            arrays = [pa.array(x.astype(np.int64)) for x in (*cols[:2], *cols[3:5], cols[6])] + [pa.array(cols[5].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["edge", "span", "next", "t1", "place", "t2"])

    return edges


def _told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted occurrences: those whose span is there twice (``copies`` 0), and the spans of edges that may repeat.

    Each batch is judged alone. A run that touches a batch's end may go on
    elsewhere, so its spans are always passed on, with how many occurrences
    there are here and the least and greatest name of what follows.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        edge, span, following, t1, place, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new_edge = np.r_[True, edge[1:] != edge[:-1]]
        new_span = new_edge | np.r_[True, span[1:] != span[:-1]]
        fresh = new_span | np.r_[True, (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1]) | (place[1:] != place[:-1])]  # repeated rows have the same places
        edge_run, span_run = np.cumsum(new_edge) - 1, np.cumsum(new_span) - 1
        copies = np.bincount(span_run)
        at = np.flatnonzero(new_span)
        passed = (np.bincount(edge_run)[edge_run[at]] > 1) | (edge_run[at] == 0) | (edge_run[at] == edge_run[-1])
        whole = (copies[span_run] > 1) & fresh
        some, zero = at[passed], np.zeros(int(whole.sum()), np.int64)
        node = signed(mixed(edge.view(np.uint64) * _NODE + span.view(np.uint64)))
        low, high = np.minimum.reduceat(following, at)[passed], np.maximum.reduceat(following, at)[passed]
        cols = [np.r_[zero, edge[some]], np.r_[zero, span[some]], np.r_[node[whole], node[some]], np.r_[zero, copies[passed]], np.r_[zero, low], np.r_[zero, high], np.r_[t1[whole], t1[some]], np.r_[t2[whole], t2[some]], np.r_[place[whole], place[some]]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["edge", "span", "node", "copies", "low", "high", "t1", "t2", "place"])


_TOLD = "edge long, span long, node long, copies long, low long, high long, t1 long, t2 int, place long"


def _read_again(window: int, t1_col: str, t2_col: str, text_col: str, places_col: str):
    """128-bit hashes of the words at the places beside a text: of a path's, or of each single window."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "again", "t1", "start", "end", "t2"]
        for batch in batches:
            rows, digests = [], []
            texts = batch.column(text_col).cast(pa.binary())
            for t1, t2, text, places in zip(batch.column(t1_col).to_pylist(), batch.column(t2_col).to_pylist(), texts, batch.column(places_col).to_pylist(), strict=True):
                words = text.as_py().split()
                for p in places:
                    n = p["windows"]
                    for start, end in [(p["start"], p["start"] + n + window - 1)] if p["path"] else [(s, s + window) for s in range(p["start"], p["start"] + n)]:
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words[start:end])))
                        rows.append((p["again"], t1, start, end, t2))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return read


_CUT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(_CUT)
def _cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for value, s, e in zip(text, starts, ends, strict=True):
        words = payload(value).split()
        kept = words
        if s is not None and len(s):
            gone = covered(np.asarray(s, np.int64), np.asarray(e, np.int64), len(words))
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(kept)
        rows.append((len(words), len(words) - len(kept), joined.decode(), hashlib.sha256(joined).hexdigest()))
    return pd.DataFrame(rows, columns=_CUT.names)


def compacted(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``head, extra``: paths by their first node, with the windows of the nodes that follow it.

    ``nodes`` has node, copies, windows, and low and high, the least and
    greatest name of what follows its occurrences (0: nothing). A node is
    linked to the next where all occurrences go on to it and it has no others.
    In each round the pieces that a coin says take in the linked piece, if its
    coin says the other side: one join for all of them, a quarter of the links.
    """
    # Names are 64 bits: in the rare case that two spans share one, neither is linked.
    named_once = nodes.groupBy("node").agg(F.count("*").alias("same"), F.max("copies").alias("copies"), F.max("windows").alias("windows"), F.min("low").alias("low"), F.max("high").alias("high"))
    one = named_once.where("same = 1 and low = high and low <> 0 and low <> node").select(F.col("node").alias("head"), "copies", F.col("low").alias("next"))
    two = named_once.where("same = 1").select(F.col("node").alias("next"), F.col("copies").alias("as_many"))
    links = stored(one.join(two, "next").where("copies = as_many").select("head", "next"))
    taken = links.select(F.col("next").alias("head"), F.lit(True).alias("taken"))
    marked = stored(named_once.select(F.col("node").alias("head"), "windows", F.lit(0).cast("long").alias("extra")).join(links, "head", "left").join(taken, "head", "left"))
    columns = ["head", "next", "windows", "extra"]
    in_links = F.col("next").isNotNull() | F.col("taken")
    pieces, alone = marked.where(in_links).select(columns), marked.where(~F.coalesce(in_links, F.lit(False))).select(columns)
    for i in range(rounds):
        if pieces.where("next is not null").isEmpty():
            break
        coin = F.pmod(F.xxhash64(F.lit(i), "head"), F.lit(2)) == 1
        takers = pieces.where(coin & F.col("next").isNotNull()).alias("x")
        joined = takers.join(pieces.where(~coin).alias("y"), F.col("x.next") == F.col("y.head"), "full")
        no_taker, no_taken = F.col("x.head").isNull(), F.col("y.head").isNull()
        grown = joined.select(
            F.coalesce("x.head", "y.head").alias("head"),
            F.when(no_taken, F.col("x.next")).otherwise(F.col("y.next")).alias("next"),
            F.coalesce("x.windows", "y.windows").alias("windows"),
            F.when(no_taker, F.col("y.extra")).when(no_taken, F.col("x.extra")).otherwise(F.col("x.extra") + F.col("y.windows") + F.col("y.extra")).alias("extra"),
        )
        pieces = stored(grown.unionByName(pieces.where(coin & F.col("next").isNull())))
    return pieces.unionByName(alone).select("head", "extra")


def repeated_spans(keyed: DataFrame, t1_col: str, t2_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """The word ranges to remove, by text: ``t1, t2, starts, ends``.

    A range [start, end) lies in windows of ``window`` words whose word
    sequence also starts elsewhere, in any text or the same one. ``keyed`` has
    two hashes beside each text.
    """
    texts = keyed.select(F.col(t1_col).alias("t1"), F.col(t2_col).alias("t2"), utf8(named(text_col)).alias("text"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(texts.mapInArrow(_edges(window, k), "edge long, span long, next long, t1 long, place long, t2 int"))
    order = ["edge", "span", "t1", "t2"]
    told = stored(kept.repartitionByRange(parts, *order).sortWithinPartitions(*order, "place").mapInArrow(_told_apart, _TOLD))
    again, pieces = told.where("copies = 0"), told.where("copies > 0")
    spans = stored(pieces.groupBy("edge", "span", "node").agg(F.sum("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("t1", "t2", "place")).alias("at")))
    windows_at = lambda place: F.shiftright(place, BITS).bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    start_at = lambda place: F.shiftright(place, 2 * BITS)

    # Where paths are: the places of their first nodes, wherever those were told to repeat.
    late = pieces.where("copies = 1").join(spans.where("copies > 1").select("edge", "span"), ["edge", "span"])
    paths = few(stored(compacted(spans.where("copies > 1").withColumn("windows", windows_at("at.place")))))
    places = again.select("node", "t1", "t2", "place").unionByName(late.select("node", "t1", "t2", "place")).join(paths, F.col("node") == F.col("head"))
    place = lambda path, again, place, extra: F.struct(F.lit(path).alias("path"), again.alias("again"), start_at(place).cast("int").alias("start"), (windows_at(place) + extra).cast("int").alias("windows")).alias("p")
    on_paths = places.select("t1", "t2", place(True, F.lit(False), "place", F.col("extra")))

    # Where edges diverge: one place of each of their spans.
    diverging = spans.groupBy("edge").agg(F.count("*").alias("spans"), F.min("copies").alias("fewest")).where("spans > 1 and fewest = 1").select("edge")
    opened = spans.join(diverging, "edge").select("at.t1", "at.t2", place(False, F.col("copies") > 1, "at.place", F.lit(0)))

    beside = on_paths.unionByName(opened).groupBy("t1", "t2").agg(F.collect_set("p").alias("places"))
    c, d, places_col = private(keyed, "t1_read", "t2_read", "places")
    # With all columns, as in the join that follows in dedup_substrings: so both take the texts from one shuffle.
    joined = keyed.join(beside.toDF(c, d, places_col), (F.col(t1_col) == F.col(c)) & (F.col(t2_col) == F.col(d)))
    read = joined.mapInArrow(_read_again(window, t1_col, t2_col, text_col, places_col), "h1 long, h2 long, again boolean, t1 long, start int, end int, t2 int")
    # Spans that are known to repeat need no second find, and are not to be removed by their single windows.
    repeated = read.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.bool_or("again").alias("known")).where("n > 1 or known")
    # The join has keys of its own, the same hashes with all bits turned, so that both of its sides are dealt out for it alone and a passage that very many texts hold can be split.
    turned = repeated.select(F.bitwise_not("h1").alias("g1"), F.bitwise_not("h2").alias("g2"))
    ranges = read.where("not again").join(turned, (F.bitwise_not("h1") == F.col("g1")) & (F.bitwise_not("h2") == F.col("g2")))
    gathered = ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("r"))
    return gathered.select("t1", "t2", F.col("r.start").alias("starts"), F.col("r.end").alias("ends"))


def dedup_substrings(docs: DataFrame, text_col: str = "text", window: int = 35, k: int = 8) -> DataFrame:
    """``docs`` with a struct ``cut``: n_words, n_removed, kept, kept_sha256.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; kept words are joined by one
    blank. Every word covered by a window of ``window`` words that also starts
    anywhere else is removed; all windows are judged on the input. ``k``, the
    words of an edge, changes what the job costs, not what it finds.

    Rows come back with their columns, but a column ``cut``, in any case, is
    replaced. A null text has no words. Repeated rows are copies of each
    other, so all their windows repeat. Texts shorter than a window stay
    whole. Raises ValueError for a window shorter than an edge, or longer by
    65536 words or more.
    """
    if not 1 <= k <= window < k + (1 << BITS):
        raise ValueError(f"A window has to have from {k} to {k + (1 << BITS) - 1} words, not {window}.")
    t1, t2 = text_hashes(named(text_col))
    t2 = t2.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    a, b, c, d, starts, ends = private(docs, "t1", "t2", "t1_found", "t2_found", "starts", "ends")
    keyed = docs.withColumns({a: t1, b: t2})
    found = repeated_spans(keyed, a, b, text_col, window, k)
    joined = keyed.join(found.toDF(c, d, starts, ends), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left")
    return joined.select(*given(docs, "cut"), _cut(utf8(named(text_col)), F.col(starts), F.col(ends)).alias("cut"))
