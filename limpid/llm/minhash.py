"""MinHash near-duplicates by fast similarity sketches, banding and exact verification.

A sketch has t coordinates, filled in rounds. In each of the first t rounds
every shingle is hashed to one coordinate and a value; in each of t more rounds
all shingles go to one coordinate, which no longer can stay empty. A
coordinate keeps the value of its first round, the least of that round. So a
set of any size fills all coordinates, mostly in (t ln t) / n rounds, and two
sets agree in a coordinate with a probability of their Jaccard similarity,
concentrated about as for independent coordinates.

Bands of four coordinates make candidates. With forty bands a link at the
threshold of 0.8 is in no band in common with a probability of (1 - 0.8^4)^40,
7e-10, a closer one with less. Candidates whose sketches agree in fewer than
88 of 160 coordinates go (a link does that with 9e-12), the rest is confirmed
on the whole sets. No list or group is capped: a bucket's sets are tied to its
least set first; only buckets that then still span several components are
compared, block by block, on sketches and on counts by hash bucket that bound
any intersection from above. Of what these leave, each set first goes with its
likeliest partner and then with all that may link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import WordHashes, mixed, named, payload, released, signed, stored, text_hashes, utf8
from limpid.llm.components import components
from limpid.llm.confirm import confirmed, folded, set_keys, shingle_set, sketch, texts_of

SHINGLE = 2
ROWS, BANDS = 4, 40
COORDINATES = ROWS * BANDS
#: Coordinates in which the sketches of a pair have to agree, to be worth confirming.
LEAST_AGREEMENT = 88
#: Sets of a block whose sketches are compared.
BLOCK = 1024
#: Rounds in which each set goes with its likeliest partner, before all that may link do.
LIKELIEST_ROUNDS = 1
#: Sets that a task remembers, so as to sketch copies once.
SETS_MET = 100_000
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_EMPTY = np.uint64(2**64 - 1)


def similarity_sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The coordinates' values, each of its round (upper half) and hash (lower half), of a set with at least one shingle."""
    values = np.full(t, _EMPTY)
    begin, at_once = 0, max(1, min(2 * t, -(-2 * t // len(shingles))))
    while begin < 2 * t and (values == _EMPTY).any():
        rounds = np.arange(begin, min(2 * t, begin + at_once), dtype=np.uint64)
        h = mixed(shingles[None, :] + (rounds * _SEED + _SEED)[:, None])
        value = (rounds << np.uint64(32))[:, None] | (h & _LOW)
        place = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        forced = rounds >= t
        if forced.any():
            place[forced] = (rounds[forced] - np.uint64(t))[:, None]
        np.minimum.at(values, place.ravel().astype(np.int64), value.ravel())
        begin += at_once
    return values


def band_tokens(values: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates, and of which band it is."""
    bands = values.reshape(-1, ROWS)
    out = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        out = mixed(out * _SEED + bands[:, i])
    return out


def fingerprint(values: np.ndarray) -> bytes:
    """Sixteen bits of each coordinate: sketches that differ there differ."""
    return mixed(values).astype(np.uint16).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and key; bands and sketch only the first time that the task meets the set."""
    memory, met = WordHashes(), set()
    for batch in released(batches):
        n, keys, bands, sketches = [], [], [], []
        for text in batch.column(3):
            s = shingle_set(payload(text.as_py()), memory, SHINGLE)
            key = set_keys(s)
            n.append(len(s))
            keys.append(key)
            values = similarity_sketch(s) if len(s) and key not in met else None
            bands.append(None if values is None else signed(band_tokens(values)))
            sketches.append(None if values is None else fingerprint(values))
            if len(met) < SETS_MET:
                met.add(key)
        k1, k2 = zip(*keys, strict=True) if keys else ([], [])
        arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "t1", "t2", "n", "k1", "k2", "bands", "sketch"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the entries whose token stands alone in a sorted batch, or comes again for a set that two tasks sketched; runs at a batch's ends may go on elsewhere."""
    for batch in batches:
        if batch.num_rows:
            token, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            new = np.r_[True, token[1:] != token[:-1]]
            run = np.cumsum(new) - 1
            fresh = new | np.r_[True, key[1:] != key[:-1]]
            keep = fresh & ((np.bincount(run, fresh)[run] > 1) | (run == 0) | (run == run[-1]))
            yield batch.filter(pa.array(keep))


def agreements(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many coordinates rows of fingerprints agree."""
    return (one == other).sum(axis=-1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, other = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array(agreements(one, other) >= LEAST_AGREEMENT))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows of a sorted stream that are equal in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if held and any(held[-1].column(i)[-1].as_py() != c[0] for i, c in enumerate(columns)):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            held.append(batch.slice(begin, end - begin))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Bounds:
    """How many shingles of one set of a block others can share at most, by counts in hash buckets."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts, self.size = counts, np.array([len(c) for c in counts])
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by buckets: the sets that have so many, or twice as many, and their counts

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds; without counts, or for others of very different size, there is none."""
        k = self.size[i]
        most = np.full(len(others), np.iinfo(np.int64).max // 16)
        if k:
            if k not in self.level:
                at = np.flatnonzero((self.size == k) | (self.size == 2 * k))
                self.level[k] = at, np.stack([folded(self.counts[j], k) for j in at])
            at, table = self.level[k]
            near = np.flatnonzero((self.size[others] == k) | (self.size[others] == 2 * k))
            mine = folded(self.counts[i], k)
            for begin in range(0, len(near), 64):
                some = near[begin : begin + 64]
                most[some] = np.minimum(table[np.searchsorted(at, others[some])], mine).sum(axis=1)
        return most


def likely_pairs(own: np.ndarray, keys: np.ndarray, n: np.ndarray, root: np.ndarray, sketches: np.ndarray, counts: list[np.ndarray], across: bool, likeliest: bool) -> list[tuple[int, int]]:
    """Pairs (greater, lesser key) of a block, or across two, of different components, that may link; of each set all or the likeliest.

    Sizes and counts by bucket leave room for a link, and sketches agree in enough coordinates.
    """
    order = np.lexsort((keys, n))
    own, keys, n, root, sketches = own[order], keys[order], n[order], root[order], sketches[order]
    bounds = Bounds([counts[i] for i in order])
    ends, out = np.searchsorted(n, 5 * n // 4, side="right"), []
    for i in range(len(n)):
        later = np.arange(i + 1, ends[i])
        later = later[(root[later] != root[i]) & ((own[later] != own[i]) | (not across))]
        same = agreements(sketches[later], sketches[i])
        later, same = later[same >= LEAST_AGREEMENT], same[same >= LEAST_AGREEMENT]
        room = 9 * bounds.shared(i, later) >= 4 * (n[i] + n[later])
        later, same = later[room], same[room]
        if likeliest and len(later):
            later = later[[same.argmax()]]
        out += [(max(keys[i], keys[j]), min(keys[i], keys[j])) for j in later]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = WordHashes()
    for batch in released(batches):
        counts = [sketch(shingle_set(payload(t.as_py()), memory, SHINGLE)).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary())], names=["set_key", "counts"])


def _scanned(likeliest: bool):
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, 3):
            own, key, n, root = (block.column(c).to_numpy() for c in ("own", "set_key", "n", "root"))
            sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint16).reshape(len(own), -1)
            counts = [np.frombuffer(c, np.uint8) for c in block.column("counts").to_pylist()]
            found = likely_pairs(own, key, n, root, sketches, counts, block.column("one")[0] != block.column("two")[0], likeliest)
            a, b = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return scanned


def open_buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``head, set_key, n, root``: the sets of buckets that span several components; buckets with one least set are one group."""
    marked = shared.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("token", "set_key", "n", F.coalesce("root", "set_key").alias("root"))
    spans = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("set_key").alias("head")).where("low <> high").select("token", "head")
    return stored(marked.join(spans, "token").select("head", "set_key", "n", "root").distinct())


def scan(members: DataFrame, sketches: DataFrame, likeliest: bool) -> DataFrame:
    """Pairs (a, b) within the heads' groups that may link, by pairs of blocks of their sets; ``sketches`` has sketch and counts."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = members.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(blocks, "head").withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other"))
    dealt = each.join(sketches, "set_key").select("head", "one", "two", "own", "set_key", "n", "root", "sketch", "counts")
    return dealt.repartition(parts, "head", "one", "two").sortWithinPartitions("head", "one", "two").mapInArrow(_scanned(likeliest), "a long, b long").distinct()


def sketch_components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows' sets ``doc, n, set_key``, and ``node, root`` over the keys of linked sets."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    longs = [T.StructField(c, T.LongType()) for c in ("t1", "t2", "n", "k1", "k2")]
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), *longs, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    t1, t2 = text_hashes(named(text_col))
    texts = docs.select(named(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), utf8(named(text_col)).alias("text"))
    sets = stored(texts.mapInArrow(_sketched, schema))
    # One half of the 128 bits names a set; where two sets share it, both halves do.
    shared_halves = [r["k1"] for r in sets.groupBy("k1").agg(F.min("k2").alias("low"), F.max("k2").alias("high")).where("low <> high").select("k1").collect()]
    name = F.when(F.col("k1").isin(shared_halves), F.xxhash64("k1", "k2")).otherwise(F.col("k1")) if shared_halves else F.col("k1")
    sets = sets.select("doc", "t1", "t2", "n", name.alias("set_key"), "bands", "sketch")

    entries = sets.where("bands is not null").select(F.explode("bands").alias("token"), "set_key", F.col("n").cast("int").alias("n"))
    dealt = entries.repartitionByRange(parts, "token", "set_key").sortWithinPartitions("token", "set_key")
    shared = stored(dealt.mapInArrow(_shared, "token long, set_key long, n int"))
    heads = shared.groupBy("token").agg(F.min(F.struct("set_key", "n")).alias("head"), F.max("set_key").alias("last")).where("head.set_key <> last").select("token", F.col("head.set_key").alias("b"), F.col("head.n").alias("nb"))
    fits = F.least("n", "nb") * 5 >= F.greatest("n", "nb") * 4
    ties = shared.join(heads, "token").where((F.col("set_key") != F.col("b")) & fits).select(F.col("set_key").alias("a"), "b").distinct()
    keys = stored(shared.join(heads.select("token"), "token", "left_semi").select("set_key").distinct())
    sketches = stored(sets.where("sketch is not null").join(keys, "set_key", "left_semi").select("set_key", "sketch").dropDuplicates(["set_key"]))
    both = ties.join(sketches.select(F.col("set_key").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("set_key").alias("b"), F.col("sketch").alias("y")), "b")
    tried = stored(both.select("a", "b", "x", "y").mapInArrow(_agreeing, "a long, b long"))
    held = texts_of(docs, id_col, text_col, sets, keys)
    links = stored(confirmed(tried, held, SHINGLE))
    roots = stored(components(links))
    members = open_buckets(shared, roots)
    counts = held.join(members.select("set_key").distinct(), "set_key", "left_semi").select("set_key", "text").mapInArrow(_counted, "set_key long, counts binary")
    sketches = stored(sketches.join(counts, "set_key"))
    settled = False
    for likeliest in [True] * LIKELIEST_ROUNDS + [False]:
        if likeliest and settled:
            continue
        pairs = stored(scan(members, sketches, likeliest).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            settled = True
            continue
        tried = stored(tried.unionByName(pairs))
        found = stored(confirmed(pairs, held, SHINGLE))
        if not found.isEmpty():
            links = stored(links.unionByName(found))
            roots = stored(components(links))
            members = open_buckets(shared, roots)
    return sets.select("doc", "n", "set_key"), roots


def sketch_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, set_key, component_id, kept.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A text of one word has
    that as its shingle; a null text or one without words has none, links with
    nothing, is its own component and kept. ``component_id`` is the smallest id
    reachable by links, and ``kept`` tells whether it is the row's own. Rows
    without an id take part, but name a component only if no row of it has one;
    such rows are kept together. Repeated rows have equal sets. Shingles are
    64-bit hashes of their words; sets of them are told apart by 128 bits.
    """
    sets, roots = sketch_components(docs, id_col, text_col)
    grouped = stored(sets.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key")))
    least = grouped.where("n > 0").groupBy("root").agg(F.min("doc").alias("least"))
    out = grouped.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "doc"))
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "set_key", "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))
