"""Packing by lexical retrieval.

Documents are cut into token sequences with neighbours that are lexically
close. They are dealt out in ranges of a key made of their commonest tokens and
the smallest hash of their token triples, so that like documents lie side by
side. Each run of some million tokens in that order is a shard with a BM25
inverted index of its own (over tokens, with document frequencies of the whole
corpus), which returns unused neighbours for each seed; they fill the seed's
window one after the other. The piece that does not fit is cut, and its rest is
the next seed. A task takes shards one after the other and goes on with the
open window, so only the last window of a range is padded.
"""

from __future__ import annotations

import os
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import named, released, stored

#: Ends each document.
END_ID = 1
K1, B = 1.2, 0.75
#: Words of Latin and Cyrillic letters; without U+0130, which falls apart when lower-cased.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-įı-ɏЀ-ҁҊ-ӿ]+$"
#: Words that a worker keeps the ids of before it starts anew.
WORDS_KEPT = 700_000
#: Texts, and bytes of them, that are looked up at once.
AT_ONCE, BYTES_AT_ONCE = 1500, 6 << 20


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine; a path stays a path."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of texts, column-wise: each distinct word of a batch is looked up once.

    The tokenizer never joins characters across a blank, so a text's ids are
    those of its stretches between ASCII blanks, one after the other. Nor does
    it join letters with other marks, so a word of plain letters keeps its ids
    whatever ASCII marks follow it; and it lower-cases. Ids of words are kept between batches,
    up to a bound. New words of plain letters are looked up many in one text and told apart by
    the mark that the tokenizer's last id of a word bears; where it bears none, one by one.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.sizes = {"": 0}, np.empty(0, self.kind), np.zeros(1, np.int64)  # words by place, and their ids on end

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of these distinct words is among the known ones; new ones are learned first."""
        given, known = words.to_pylist(), self.known
        at = np.fromiter(map(known.get, given, repeat(-1)), np.int64, len(given))
        new = np.flatnonzero(at < 0)
        if len(new) and len(known) + len(new) > WORDS_KEPT and len(known) > 1:
            self._forget()
            return self.places(words)
        if len(new):
            alpha = pc.match_substring_regex(words.take(pa.array(new)), LETTERS).to_numpy(zero_copy_only=False)
            flat, sizes = [self.flat], [self.sizes]
            for places, look_up in ((new[alpha], self._looked_up_joined), (new[~alpha], self._looked_up)):
                at[places] = np.arange(len(known), len(known) + len(places))
                known.update(zip([given[i] for i in places.tolist()], range(len(known), len(known) + len(places)), strict=True))
                for begin in range(0, len(places), 4096):  # encodings are far larger than their ids
                    for held, more in zip((flat, sizes), look_up([given[i] for i in places[begin : begin + 4096].tolist()]), strict=True):
                        held.append(more)
            self.flat, self.sizes = np.concatenate(flat), np.concatenate(sizes)
        return at

    def _looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids on end, and how many each has."""
        ids, sizes = array("H" if self.kind.itemsize == 2 else "I"), []
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            ids.extend(e.ids)
            sizes.append(len(e))
        return np.frombuffer(ids, self.kind), np.array(sizes, np.int64)

    def _looked_up_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters, by way of one text."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.kind)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return self._looked_up(words)
        return ids, np.diff(ends, prepend=0)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without the end id."""
        found, cuts = self.on_end(texts)
        return np.split(found, cuts[:-1])

    def on_end(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text's after the other's, and where each text's end."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words_in = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        stretch = coded.dictionary
        bare = pc.utf8_rtrim(stretch, characters=string.punctuation)
        alpha = pc.match_substring_regex(bare, LETTERS)
        word = pc.if_else(alpha, bare, stretch)
        word = pc.if_else(pc.and_(alpha, pc.string_is_ascii(word)), pc.ascii_lower(word), word)
        marks = np.where(alpha.to_numpy(zero_copy_only=False), pc.subtract(pc.binary_length(stretch), pc.binary_length(bare)).to_numpy(zero_copy_only=False), 0)
        # What follows the letters: none for most stretches, and few lengths in all.
        pieces, places = [word], [np.arange(len(word))]
        for n in np.unique(marks[marks > 0]):
            at = np.flatnonzero(marks == n)
            pieces.append(pc.utf8_slice_codeunits(stretch.take(pa.array(at)), -int(n)))
            places.append(at)
        parts = pa.concat_arrays(pieces).dictionary_encode()
        place = self.places(parts.dictionary)[parts.indices.to_numpy()]
        part_of = np.zeros((len(stretch), 2), np.int32)  # the first known word is the empty one
        part_of[:, 0] = place[: len(word)]
        done = len(word)
        for at in places[1:]:
            part_of[at, 1] = place[done : done + len(at)]
            done += len(at)
        begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        each = part_of[coded.indices.to_numpy()].ravel()
        length = self.sizes[each]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        found = self.flat[np.repeat(begins[each] - (ends - length).astype(np.int32), length) + np.arange(total, dtype=np.int32)]
        word_ends = np.r_[0, ends[1::2]]
        return found, word_ends[np.cumsum(words_in)]


@cache
def word_ids(name: str) -> WordIds:
    """One for each Python worker, so that its tasks share what they have looked up."""
    return WordIds(name)


def counted(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents whose ids lie on end: each one's distinct ids in order, as its number, the id and how often it occurs there."""
    wide = ids.dtype.itemsize > 2 or len(lengths) > 1 << 16
    kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)
    ordered = np.sort(np.repeat(np.arange(len(lengths), dtype=kind) << kind(shift), lengths) | ids.astype(kind))
    begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ordered[1:] != ordered[:-1]]))
    found = ordered[begins]
    return (found >> kind(shift)).astype(np.int64), (found & kind((1 << shift) - 1)).astype(np.int64), np.diff(begins, append=len(ids))


def shard_keys(ids: np.ndarray, lengths: np.ndarray, of: np.ndarray, unique: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Like documents have near keys: the two commonest tokens, then the smallest hash of a token triple. No document is empty."""
    low = (1 << 32) - 1
    rank = counts << 32 | (low - unique)  # of equally common ones the smaller id
    begins = np.searchsorted(of, np.arange(len(lengths)))
    best = np.maximum.reduceat(rank, begins)
    rank[rank == best[of]] &= low
    first, second = (low - (x & low) for x in (best, np.maximum.reduceat(rank, begins)))
    wide = ids.astype(np.uint64)
    triples = wide << np.uint64(32)
    triples[:-1] += wide[1:] << np.uint64(16)
    triples[:-2] += wide[2:]
    short = np.repeat(lengths < 3, lengths)
    triples[short] = wide[short]
    hashes = (triples + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    ends = np.cumsum(lengths)
    long_ends = ends[lengths >= 3]
    hashes[long_ends - 1] = hashes[long_ends - 2] = np.uint64(low)  # there no triple begins
    least = np.minimum.reduceat(hashes, ends - lengths).astype(np.int64)
    return (first & 0xFFFF) << 47 | (second & 0xFFFF) << 31 | least


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Small batches put together, and large ones taken apart, for fewer and bounded lookups."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Array, pa.Array]:
        return pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])

    for batch in batches:
        step = max(1, int(batch.num_rows * BYTES_AT_ONCE / max(batch.nbytes, BYTES_AT_ONCE)))
        for begin in range(0, batch.num_rows, step):
            held.append(batch.slice(begin, step))
            if sum(b.num_rows for b in held) >= AT_ONCE or sum(b.nbytes for b in held) >= BYTES_AT_ONCE:
                yield whole()
                held = []
    if held:
        yield whole()


def _tokenised(name: str, id_type: pa.DataType):
    """Token rows; after them, as rows with no ids, how many documents of the task hold each token."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = word_ids(name)
        names = ["doc", "stat", "key", "n", "ids"]
        frequency = np.zeros(0, np.int64)
        total = 0
        for docs, texts in _gathered(released(batches)):
            if not len(texts):
                continue
            found, cuts = memory.on_end(texts)
            ids = np.insert(found, cuts, END_ID)
            sizes = np.diff(cuts, prepend=0) + 1
            of, unique, counts = counted(ids, sizes)
            held = np.bincount(unique, minlength=len(frequency))
            held[: len(frequency)] += frequency
            frequency = held
            total += len(ids)
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([docs, pa.array(np.zeros(len(sizes), bool)), pa.array(shard_keys(ids, sizes, of, unique, counts)), pa.array(sizes), packed], names=names)
        held = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(held) + 1, id_type), pa.array([True] * (len(held) + 1)), pa.array(np.r_[-1, held]), pa.array(np.r_[total, frequency[held]]), pa.nulls(len(held) + 1, pa.binary())], names=names)

    return tokenise


class Windows:
    """Fills windows from shards of documents; the open window goes on from shard to shard."""

    def __init__(self, window: int, idf: np.ndarray):
        self.window, self.idf = window, idf
        self.sequence, self.used, self.open_number = 0, 0, 0

    def pieces(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document's place in the shard, start, length, sequence, offset) of each piece."""
        tails = []
        for d, ids in enumerate(docs):
            whole = len(ids) // self.window
            for i in range(whole):
                yield d, i * self.window, self.window, self._next(), 0
            if len(ids) % self.window:
                tails.append((d, whole * self.window))
        yield from self._fill(docs, tails)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _number(self) -> int:
        """The open window's, or a new one's."""
        if self.used == 0:
            self.open_number = self._next()
        return self.open_number

    def _fill(self, docs: list[np.ndarray], tails: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        index = Index([docs[d][s:] for d, s in tails], self.idf)
        left = np.ones(len(tails), bool)
        following = 0
        rest: tuple[int, int, int] | None = None  # tail, and its document's place and start
        while True:
            if rest is not None:
                seed, d, start = rest
                rest = None
            else:
                while following < len(tails) and not left[following]:
                    following += 1
                if following == len(tails):
                    return
                seed = following
                left[seed] = False
                d, start = tails[seed]
            queue, near = [(seed, d, start)], None
            while queue:
                item, d, start = queue.pop()
                length = min(len(docs[d]) - start, self.window - self.used)
                number = self._number()
                yield d, start, length, number, self.used
                self.used = (self.used + length) % self.window
                if start + length < len(docs[d]):
                    rest = (item, d, start + length)
                if self.used == 0:
                    break
                if near is None:
                    near = iter(index.neighbours(seed, left))
                found = next((n for n in near if left[n]), None)
                if found is not None:
                    left[found] = False
                    queue.append((found, *tails[found]))


class Index:
    """A BM25 inverted index over the tails of a shard: what is left of documents after their full windows."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray):
        self.n, self.idf = len(items), idf
        lengths = np.array([len(x) for x in items], np.int64)
        of, term, tf = counted(np.concatenate([np.empty(0, np.uint16), *items]), lengths)
        self.terms, self.term_begins = term, np.searchsorted(of, np.arange(self.n + 1))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1)) if self.n else lengths
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[of])
        order = np.argsort(term, kind="stable")
        self.items, self.weights = of[order], weight[order]
        self.begins = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.held = np.arange(self.n)  # the items that postings count through: all at first
        # Terms of more than a sixteenth of the items: rows of a weight an item add up faster than postings, of which they take at most twice the room.
        self.common: dict[int, np.ndarray] = {}
        of_term = np.diff(self.begins)
        often = np.argsort(-of_term, kind="stable")[: 2 * len(term) // max(self.n, 1)]
        for t in often[16 * of_term[often] > self.n]:
            a, b = self.begins[t], self.begins[t + 1]
            self.common[int(t)] = row = np.zeros(self.n)
            row[self.items[a:b]] = self.weights[a:b]

    def _drop_used(self, unused: np.ndarray) -> None:
        """Takes used items out of the index; ``unused`` has a flag for each that is held."""
        keep = unused[self.items]
        self.begins = np.r_[0, np.cumsum(keep)][self.begins]
        self.items, self.weights = (np.cumsum(unused) - 1)[self.items[keep]], self.weights[keep]
        self.common = {t: row[unused] for t, row in self.common.items()}
        self.held = self.held[unused]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each held item for all distinct terms of a seed."""
        scores, items, weights = np.zeros(len(self.held)), [], []
        common, begins = self.common, self.begins
        terms = self.terms[self.term_begins[seed] : self.term_begins[seed + 1]]
        for t, a, b in zip(terms.tolist(), begins[terms].tolist(), begins[terms + 1].tolist(), strict=True):
            if t in common:
                scores += common[t]
            elif a < b:
                items.append(self.items[a:b])
                weights.append(self.weights[a:b])
        if items:
            scores += np.bincount(np.concatenate(items), np.concatenate(weights), len(scores))
        return scores

    def neighbours(self, seed: int, left: np.ndarray) -> Iterator[int]:
        """Unused items by falling score, those with the same score in order; ``left`` only ever loses items."""
        flags = left[self.held]
        if 4 * np.count_nonzero(flags) < 3 * len(flags):
            self._drop_used(flags)
            flags = np.ones(len(self.held), bool)
        unused, values = self.held[flags], self.scores(seed)[flags]
        if len(unused) > 64:  # most windows take a few
            some = np.argpartition(-values, 64)[:64]
            yield from unused[some[np.lexsort((some, -values[some]))]]
        yield from unused[np.argsort(-values, kind="stable")]


def _packed(window: int, shard_tokens: int, kind, idf, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(window, idf.value)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def out(ids_of: list, docs: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
            rows = list(windows.pieces(docs))
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.empty(0, np.int64)] * 5
            crc = np.array([zlib.crc32(docs[i][s : s + n].astype("<u4").tobytes()) for i, s, n in zip(d, start, length, strict=True)], np.int64)
            total = np.array([len(x) for x in docs], np.int64)[d] if rows else d
            return pa.RecordBatch.from_arrays([pa.array([ids_of[i] for i in d], id_type), *(pa.array(x) for x in (start, length, crc, total, sequence + first, offset))], names=names)

        ids_of, docs, held = [], [], 0
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids_of.append(doc)
                docs.append(np.frombuffer(packed.as_py(), kind))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield out(ids_of, docs, batch.schema.field(0).type)
                    ids_of, docs, held = [], [], 0
            id_type = batch.schema.field(0).type
        if docs:
            yield out(ids_of, docs, id_type)

    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, tokenizer: str = "word_bpe_49k.json", shard_tokens: int = 3_000_000) -> DataFrame:
    """Pieces of all rows: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are the tokenizer's for its text (null: empty), without special
    tokens, then ``END_ID``; each lies in exactly one piece. ``start`` counts
    the row's ids before the piece, ``offset`` the sequence's. A sequence holds
    at most ``window`` ids; only the last of a range holds fewer.
    ``shard_tokens`` ids, and the document that goes beyond them, are indexed
    together, which bounds a task's memory: neighbours come from the same
    shard. Repeated rows are packed each for itself. An empty table has no
    pieces. Columns of ``docs`` other than these two do not matter. What goes
    to the driver and executors is one frequency for each entry of the
    vocabulary.
    """
    from tokenizers import Tokenizer

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    size = Tokenizer.from_file(tokenizer_file(tokenizer)).get_vocab_size()
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField("doc", id_field.dataType), T.StructField("stat", T.BooleanType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    tokens = stored(docs.select(named(id_col).alias("doc"), named(text_col).cast("string").alias("text")).mapInArrow(_tokenised(tokenizer, to_arrow_type(id_field.dataType)), schema))
    stats = {r["key"]: r["n"] for r in tokens.where("stat").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    total = stats.pop(-1, 0)
    rows = tokens.where("not stat")
    frequency = np.zeros(size, float)
    for t, n in stats.items():
        frequency[t] = n
    count = max(frequency[END_ID], 1)  # each row holds the end id
    idf = np.log(1 + (count - frequency + 0.5) / (frequency + 0.5))
    # A padded window in 128 at worst, and a range of at most 64 million ids.
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (128 * window)), total >> 26)
    dealt = rows.repartitionByRange(int(parts), "key", "doc").sortWithinPartitions("key", "doc", "n").select("doc", "ids")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = T.StructType([T.StructField(id_col, id_field.dataType)] + [T.StructField(n, T.LongType()) for n in names[1:]])
    return dealt.mapInArrow(_packed(window, shard_tokens, kind, spark.sparkContext.broadcast(idf), names), out)
