"""N-gram Jaccard join: a size-aware join of light and heavy sets.

A document's set is its distinct 5-word shingles. Two sets link at a Jaccard
similarity of 0.8 or more. Equal sets are one set from the start.

* Light (small) sets enumerate subsets. Sets of sizes m and n can only link
  when they share c(m, n) = ceil(4 (m + n) / 9) shingles, so both list their
  subsets of that fixed size, and a common subset makes a candidate.
* Heavy (large) sets scan inverted lists. With shingles in one order for all,
  linked sets share one of their first n - ceil(0.8 n) + 1, so only these are
  listed. Shingles with the longest lists come last in the order.
* The boundary is the largest size for which enumerating costs no more than
  scanning and comparing what the lists of this corpus hold.

Candidates are never all pairs of a list. First each list's sets are tied to
the list's least set; verified ties give components, in which the large groups
of near copies collapse. Only lists that still span several components go on.
Short ones form pairs, of which those with enough shared prefix stay. Long ones
are scanned: the sets of all lists with the same head are split by size, and by
what can still be shared from their first long list on, which rules most pairs
out (texts that share a boilerplate but little else have no partner left). What
remains is compared block by block on counts of shingles by hash bucket, which
bound any intersection from above; a component that fills whole blocks is not
compared with itself. Only pairs that may link come out of a block, first each
set's likeliest partner, then, with the components that this gives, all. Links
are verified on the whole sets, made from the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import WordHashes, few, named, payload, private, released, signed, stored, text_hashes, utf8
from limpid.llm.components import components
from limpid.llm.confirm import confirmed, folded, set_keys, shingle_set, sketch, texts_of

SHINGLE = 5
#: Lists longer than this move to the end of the order.
LONG_LIST = 64
#: Sets that a task remembers, so as to list copies once; others are listed again, which only costs time.
SETS_MET = 100_000
#: Sets of a block when a long list is scanned.
BLOCK = 2048
#: Sizes are split at powers of this: more than 1.25, so that linked sets are in one class or in neighbouring ones.
SIZE_STEP = 1.3
#: What a pair of sets costs, counted and compared on their texts, against an entry of a list. Measured on small sets: 10 to 30 microseconds against 1 to 2.
PAIR_COST = 12
#: At most so many shingles are sent to the executors as having long lists; the rest only cost time.
LONG_LISTS = 200_000


def own_set(text: bytes, memory: WordHashes) -> np.ndarray:
    return shingle_set(text, memory, SHINGLE)


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def shared_at_least(m: int, n: int) -> int:
    """The fewest common shingles of linked sets of these sizes."""
    return -(-4 * (m + n) // 9)


def linkable(m: int, n: int) -> bool:
    return 5 * min(m, n) >= 4 * max(m, n)


def subsets_of(n: int, light: int) -> Iterator[tuple[int, int]]:
    """(partner size, subset size) of the enumerations that a set of size n takes part in."""
    for m in range(-(-4 * n // 5), 5 * n // 4 + 1):
        if min(m, n) <= light:
            yield m, shared_at_least(m, n)


def light_boundary(partners: float) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists.

    ``partners`` is how many other sets an entry of a list meets on average.
    """
    n = 0
    while sum(comb(n + 1, c) for _, c in subsets_of(n + 1, n + 1)) <= prefix_size(n + 1) * (1 + partners * PAIR_COST):
        n += 1
    return n


def held_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def prefix_of(shingles: np.ndarray, long_lists: np.ndarray) -> np.ndarray:
    """The first shingles in the order: by hash, those with long lists last."""
    p = prefix_size(len(shingles))
    is_long = held_in(shingles, long_lists)
    short = shingles[~is_long][:p]
    return short if len(short) == p else np.concatenate([short, shingles[is_long][: p - len(short)]])


def signatures(shingles: np.ndarray, light: int, long_lists: np.ndarray) -> tuple[np.ndarray, int]:
    """What a set is listed under, subset hashes for light pairs and then prefix shingles for heavy ones, and how many are of the first sort."""
    n, out = len(shingles), []
    if not n:
        return shingles, 0
    if 4 * n <= 5 * light:
        for m, c in subsets_of(n, light):
            tag = b"%d:%d:" % (min(m, n), max(m, n))
            out += [xxhash.xxh3_64_intdigest(tag + np.array(s, np.uint64).tobytes()) for s in combinations(shingles.tolist(), c)]
    found = np.array(out, np.uint64)
    return np.concatenate([found, prefix_of(shingles, long_lists)]) if n > light else found, len(found)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's set size and key; prefix and sketch only the first time that the task meets the set."""
    memory, met = WordHashes(), set()
    for batch in released(batches):
        n, keys, prefixes, sketches = [], [], [], []
        for text in batch.column(3):
            s = own_set(payload(text.as_py()), memory)
            key = set_keys(s)
            n.append(len(s))
            keys.append(key)
            fresh = key not in met and len(s)
            prefixes.append(signed(prefix_of(s, s[:0])) if fresh else None)
            sketches.append(sketch(s).tobytes() if fresh else None)
            if len(met) < SETS_MET:
                met.add(key)
        k1, k2 = zip(*keys, strict=True) if keys else ([], [])
        arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "t1", "t2", "n", "k1", "k2", "prefix", "sketch"])


_LISTED = "n long, k1 long, k2 long, subsets int, lists array<long>"


def _relisted(light: int, long_lists):
    """Signatures of the sets that are light or have a shingle with a long list in their first prefix."""

    def relisted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, met, long = WordHashes(), set(), long_lists.value
        for batch in released(batches):
            n, k1, k2, subsets, lists = [], [], [], [], []
            for text in batch.column(0):
                s = own_set(payload(text.as_py()), memory)
                key = set_keys(s)
                if not len(s) or key in met or (4 * len(s) > 5 * light and not held_in(s[: prefix_size(len(s))], long).any()):
                    continue
                found, of_subsets = signatures(s, light, long)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                subsets.append(of_subsets)
                lists.append(signed(found))
                if len(met) < SETS_MET:
                    met.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(subsets, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["n", "k1", "k2", "subsets", "lists"])

    return relisted


def _as_listed(light: int, long_lists):
    """First prefixes of the sets that need no new listing."""

    def as_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = np.sort(long_lists.value.view(np.int64))
        for batch in batches:
            n = batch.column(0).to_numpy()
            prefix = batch.column(4)
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), prefix.value_lengths().to_numpy(zero_copy_only=False))
            touched = np.zeros(len(n), bool)
            touched[of[held_in(flat, long)]] = True
            yield batch.filter(pa.array(~touched & (4 * n > 5 * light))).rename_columns(["n", "k1", "k2", "subsets", "lists"])

    return as_listed


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops the list entries that stand alone in a sorted batch; runs at its ends may go on elsewhere."""
    for batch in batches:
        if batch.num_rows:
            token, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            new = np.r_[True, token[1:] != token[:-1]]
            run = np.cumsum(new) - 1
            fresh = new | np.r_[True, key[1:] != key[:-1]]  # a set that two tasks listed comes once
            keep = fresh & ((np.bincount(run, fresh)[run] > 1) | (run == 0) | (run == run[-1]))
            yield batch.filter(pa.array(keep))


def _enough_shared(light: int) -> Column:
    """Whether a pair's shared prefix shingles leave room for a link; subsets of light pairs always do."""
    prefix = lambda n: F.col(n) - F.floor((4 * F.col(n) + 4) / 5) + 1
    most = F.col("shared") + F.greatest(F.col("na") - prefix("na"), F.col("nb") - prefix("nb"))
    return (F.least("na", "nb") <= light) | (most >= F.ceil(4 * (F.col("na") + F.col("nb")) / 9))


def set_components(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows' sets ``doc, n, set_key``, and ``node, root`` over the keys of linked sets."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc", id_type)] + [T.StructField(c, T.LongType()) for c in ("t1", "t2", "n", "k1", "k2")] + [T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    t1, t2 = text_hashes(named(text_col))
    texts = docs.select(named(id_col).alias("doc"), t1.alias("t1"), t2.alias("t2"), utf8(named(text_col)).alias("text"))
    sets = stored(texts.mapInArrow(_sets, schema))
    # One half of the 128 bits names a set. Where two sets share it, of which even a very large corpus has few, their names are made of both halves.
    shared_halves = [r["k1"] for r in sets.groupBy("k1").agg(F.min("k2").alias("low"), F.max("k2").alias("high")).where("low <> high").select("k1").collect()]
    name = F.when(F.col("k1").isin(shared_halves), F.xxhash64("k1", "k2")).otherwise(F.col("k1")) if shared_halves else F.col("k1")
    first_lists = sets.select("n", "k1", "k2", F.lit(0).alias("subsets"), "prefix").where("prefix is not null")
    sets = sets.select("doc", "t1", "t2", "n", name.alias("set_key"), "prefix", "sketch")
    lengths = first_lists.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    lengths = stored(lengths.where("n > 1"))
    entries = first_lists.agg(F.sum(F.size("prefix"))).first()[0] or 1
    met = lengths.where(F.col("n") <= LONG_LIST).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0
    light = light_boundary(met / entries)
    long = np.array([r["token"] for r in lengths.where(F.col("n") > LONG_LIST).orderBy(F.desc("n"), "token").limit(LONG_LISTS).collect()], np.int64).view(np.uint64)
    shared_long = spark.sparkContext.broadcast(np.sort(long))  # at most LONG_LISTS numbers
    lists = first_lists.mapInArrow(_as_listed(light, shared_long), _LISTED).unionByName(texts.select("text").mapInArrow(_relisted(light, shared_long), _LISTED))
    lists = stored(lists)
    # From its place on in the order a set can share so many shingles; a subset says nothing about that.
    room = F.when(F.col("at") < F.col("subsets"), F.col("n")).otherwise(F.col("n") + F.col("subsets") - F.col("at"))
    placed = lists.select(name.alias("set_key"), F.col("n").cast("int").alias("n"), "subsets", F.posexplode("lists").alias("at", "token"))
    listed = placed.select("token", "set_key", "n", room.cast("int").alias("room"))
    dealt = listed.repartitionByRange(parts, "token", "set_key").sortWithinPartitions("token", "set_key")
    shared = stored(dealt.mapInArrow(_shared, "token long, set_key long, n int, room int"))

    # Ties to the least set of each list.
    heads = shared.groupBy("token").agg(F.min(F.struct("set_key", "n")).alias("head"), F.max("set_key").alias("last")).where("head.set_key <> last").select("token", F.col("head.set_key").alias("b"), F.col("head.n").alias("nb"))
    fits = F.least("na", "nb") * 5 >= F.greatest("na", "nb") * 4
    ties = shared.select("token", F.col("set_key").alias("a"), F.col("n").alias("na")).join(heads, "token").where("a <> b").where(fits)
    pairs = stored(ties.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(_enough_shared(light)).select("a", "b"))
    tied = stored(verify(docs, id_col, text_col, sets, pairs))
    near = stored(components(tied))

    # Each set of a long list that still spans several components goes with its likeliest partner outside its own.
    entry = open_entries(shared, near)
    likeliest = stored(scan(entry.where(F.col("entries") > LONG_LIST), sets, True))
    if not likeliest.isEmpty():
        tied = stored(tied.unionByName(verify(docs, id_col, text_col, sets, likeliest)))
        entry = open_entries(entry.select("token", "set_key", "n", "room"), stored(components(tied)))
        pairs = pairs.unionByName(likeliest)

    # What is left: pairs of short lists with enough shared, and all that may link in long ones.
    short = entry.where(F.col("entries") <= LONG_LIST)
    scanned = entry.where(F.col("entries") > LONG_LIST)
    # A pair may share as many long lists as the one of its sets with fewer of them is in.
    in_long = scanned.groupBy("set_key").agg(F.count("*").alias("in_long"))
    counted = short.join(in_long, "set_key", "left").withColumn("in_long", F.coalesce("in_long", F.lit(0)))
    one = counted.select("token", F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("in_long").alias("la"))
    two = counted.select("token", F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("in_long").alias("lb"))
    across = one.join(two, "token").where("a < b and ra <> rb").where(fits)
    more = across.groupBy("a", "b", "na", "nb").agg((F.count("*") + F.least(F.max("la"), F.max("lb"))).alias("shared")).where(_enough_shared(light)).select("a", "b")
    rest = more.unionByName(scan(scanned, sets, False)).distinct()
    rest = stored(rest.join(pairs.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")), ["a", "b"], "left_anti"))
    found = verify(docs, id_col, text_col, sets, rest)
    links = tied.select("a", "b").unionByName(found.select("a", "b"))
    return sets.select("doc", "n", "set_key"), components(links)


def open_entries(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries of lists that span several components, with each list's length and least set."""
    root = F.coalesce("root", "set_key")
    marked = shared.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").select("token", "set_key", "n", "room", root.alias("root"))
    lists = marked.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("entries"), F.min("set_key").alias("head")).where("low <> high")
    return stored(marked.join(lists.select("token", "entries", "head"), "token"))


def dealt_members(entries: DataFrame) -> DataFrame:
    """The sets of long lists once for each pair of blocks in which they may have a partner.

    ``head, band, one, two, own, set_key, n, most, moved, root``: a set is in
    the class of its size and, moved there, in the next one if a partner could
    be. ``most`` is the largest partner that the shingles which it can share
    leave room for. Sets that have room for smaller partners only, and those
    of a component that fills a block, have blocks of their own, which are not
    paired with each other.
    """
    size_class = lambda c: F.floor(F.log(c) / F.log(F.lit(SIZE_STEP)))
    members = entries.groupBy("head", "set_key", "n", "root").agg(F.max("room").alias("room")).withColumn("most", F.least(F.floor(F.col("room") * 9 / 4) - F.col("n"), F.floor(F.col("n") * 5 / 4)))
    top = F.when(F.col("most") >= F.col("n"), size_class("most")).otherwise(size_class("n"))
    banded = members.select("head", "set_key", "n", "most", "root", size_class("n").alias("own_band"), F.explode(F.sequence(size_class("n"), top)).alias("band"))
    banded = stored(banded.select("head", "band", "set_key", "n", "most", "root", (F.col("band") != F.col("own_band")).alias("moved")))
    filling = banded.groupBy("head", "band", "root").agg(F.count("*").alias("members")).where(F.col("members") >= BLOCK).select("head", "band", "root", F.lit(True).alias("fills"))
    kind = F.when(F.col("most") < F.col("n"), "small").when(F.col("fills"), F.col("root").cast("string")).otherwise("rest")
    kinds = banded.join(filling, ["head", "band", "root"], "left").withColumn("kind", kind)
    blocks = kinds.groupBy("head", "band", "kind").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    others = blocks.groupBy("head", "band").agg(F.collect_list(F.struct("kind", "blocks")).alias("others"))
    name = lambda kind, i: F.concat_ws("/", kind, i.cast("string"))
    own = name(F.col("kind"), F.pmod(F.xxhash64("set_key"), F.col("blocks")))
    met = kinds.join(blocks, ["head", "band", "kind"]).join(others, ["head", "band"]).select("head", "band", "kind", own.alias("own"), "set_key", "n", "most", "moved", "root", F.explode("others").alias("met"))
    met = met.where((F.col("kind") != F.col("met.kind")) | (F.col("kind") == "rest"))
    each = met.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("met.blocks") - 1)).alias("i")).withColumn("other", name(F.col("met.kind"), F.col("i")))
    return each.select("head", "band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "set_key", "n", "most", "moved", "root")


def scan(entries: DataFrame, sets: DataFrame, likeliest: bool) -> DataFrame:
    """Pairs (a, b), a < b, of sets in long lists that may link, by the lists' heads and in blocks of sets.

    All of them, or for each set and block the one that shares most.
    """
    dealt = stored(dealt_members(entries))
    keys = few(stored(dealt.select("set_key").distinct()))
    sketches = sets.where("sketch is not null").select("set_key", "sketch").join(keys, "set_key", "left_semi").dropDuplicates(["set_key"])
    return dealt.join(sketches, "set_key").groupBy("head", "band", "one", "two").applyInPandas(_scanned(likeliest), "a long, b long").distinct()


def _scanned(likeliest: bool):
    def scanned(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        return _compared(block, key[2] != key[3], likeliest)

    return scanned


def _compared(block: pd.DataFrame, across: bool, likeliest: bool) -> pd.DataFrame:
    """Pairs of a block, or across two blocks, whose sketches leave room for a link."""
    block = block.sort_values(["n", "set_key"], ignore_index=True)
    n, root, own, keys, largest, moved = (block[c].to_numpy() for c in ("n", "root", "own", "set_key", "most", "moved"))
    counts = [np.frombuffer(x, np.uint8) for x in block["sketch"]]
    size = np.array([len(x) for x in counts])
    level: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by buckets: the sets that have so many, or twice as many, and their sketches
    ends = np.searchsorted(n, 5 * n // 4, side="right")
    found = []
    for i, k in enumerate(size):
        later = np.arange(i + 1, ends[i])  # sets up to 1.25 times as large have at most twice the buckets
        later = later[(root[later] != root[i]) & ((own[later] != own[i]) if across else True)]
        later = later[(n[later] <= largest[i]) & ~(moved[later] & moved[i])]
        if k and len(later):
            if k not in level:
                at = np.flatnonzero((size == k) | (size == 2 * k))
                level[k] = at, np.stack([folded(counts[j], k) for j in at])
            at, table = level[k]
            mine = folded(counts[i], k)
            sketched = later[size[later] > 0]
            most = np.empty(len(sketched), np.int64)
            for begin in range(0, len(sketched), 64):
                some = np.searchsorted(at, sketched[begin : begin + 64])
                most[begin : begin + 64] = np.minimum(table[some], mine).sum(axis=1)
            room = 9 * most - 4 * (n[i] + n[sketched])
            if likeliest:
                later = sketched[[room.argmax()]] if len(room) and room.max() >= 0 else sketched[:0]
            else:
                later = np.r_[later[size[later] == 0], sketched[room >= 0]]
        elif likeliest:
            later = later[:0]
        found += [(min(keys[i], keys[j]), max(keys[i], keys[j])) for j in later]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def verify(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of set keys (a, b) whose sets link, by the texts of one document of each."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    return confirmed(pairs, texts_of(docs, id_col, text_col, sets, keys), SHINGLE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, set_key, component_id.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer than
    five words has its whole sequence as one shingle; a null text or one without
    words has no shingles, links with nothing and is its own component.
    ``component_id`` is the smallest id reachable by links. Rows without an id
    take part, but never name a component that has an id in it. Repeated rows
    have equal sets. Shingles are 64-bit hashes of their words; sets of them
    are told apart by 128 bits.
    """
    sets, roots = set_components(docs, id_col, text_col)
    grouped = sets.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    grouped = stored(grouped)
    least = grouped.where("n > 0").groupBy("root").agg(F.min("doc").alias("least"))
    out = grouped.join(least, "root", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "set_key", F.coalesce("least", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first, by id, in their component, with their columns; of repeated rows one stays.

    ``docs`` has to be a stored table: its rows are told apart by where they
    are in its files. Null and wordless texts all stay. Ids are integers.
    """
    numbered_id, row = private(docs, "id", "row")
    numbered = docs.withColumn(numbered_id, F.struct(named(id_col).isNull().alias("none"), named(id_col).alias("id"), F.monotonically_increasing_id().alias("row")))
    found = near_duplicates(numbered, numbered_id, text_col)
    dropped = found.where(F.col("component_id") != F.col(numbered_id)).select(F.col(f"{numbered_id}.row").alias(row))
    return numbered.join(dropped, F.col(f"{numbered_id}.row") == F.col(row), "left_anti").select(*[named(c) for c in docs.columns])
