"""Records that hold their own separators, read by byte ranges: CSV with line ends within quotes, and JSON arrays.

A file is read as pieces, cut at a separator wherever it stands: at line ends
for CSV, at closing braces for JSON. Spark splits such a reading at any size.
Whether a piece ends a record depends on what lies before it, of which two
things matter: whether the piece begins within quotes, and how many brackets
are open. So each block of a file is first read as a function of both: for
each of the two ways it may begin, how it ends and how many brackets it opens.
Functions of a file's blocks, put one after another, tell how each block
begins. Then each block is cut into records by itself; only a record that goes
on in the next blocks waits for the pieces that these hold of it.

A row a block reaches the driver, as Spark's own list of blocks does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of unfinished records that may be broadcast; beyond, they are joined by a shuffle and the rows put in order.
FEW_CHARACTERS = 1 << 24

# From the start of a field: fields that end, then one whose quotes stay open. A quote opens only at the start of a field.
_CSV_OPEN = re.compile(r'(?:(?!")[^,]*+,|"(?:[^"]|"")*+"[^,]*+,)*+"(?:[^"]|"")*+')
_CSV_CLOSE = re.compile(r'(?:[^"]|"")*+"[^,]*+')
_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*+("?)', re.S)
_JSON_REST = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)


def csv_step(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether quotes are open after a line that begins outside or within quotes."""
    at = 0
    if inside:
        closed = _CSV_CLOSE.match(piece)
        if closed is None:
            return True, 0
        at = closed.end() + 1  # after the comma, if there is one
    return _CSV_OPEN.fullmatch(piece, min(at, len(piece))) is not None, 0


def json_step(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece and the closing brace behind it, and how many brackets both open.

    No escape can span pieces: a backslash before a brace is not JSON.
    """
    at = 0
    if inside:
        rest = _JSON_REST.match(piece)
        if not rest[1]:
            return True, 0
        at = rest.end()
    is_open = False

    def blank(m: re.Match) -> str:
        nonlocal is_open
        is_open = not m[1]
        return ""

    bare = _JSON_STRING.sub(blank, piece[at:])
    return is_open, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]") - (not is_open)


@dataclass(frozen=True)
class Grammar:
    separator: str
    quote: str  # every piece without this and without ``brackets`` leaves the state as it is, but for ``plain``
    brackets: str
    plain: int  # what a piece without quotes and brackets adds to the open brackets, outside quotes
    step: Callable[[str, bool], tuple[bool, int]]
    level: int  # open brackets where a record ends


CSV = Grammar("\n", '"', "", 0, csv_step, 0)
JSON = Grammar("}", '"', "{[]", -1, json_step, 1)


def pieces(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """``file, block, piece`` in file order."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", grammar.separator).text(path).select(*meta, F.col("value").alias("piece"))


def _plain(grammar: Grammar, batch: pa.Array) -> list[bool]:
    return pc.invert(pc.match_substring_regex(batch, f"[{re.escape(grammar.quote + grammar.brackets)}]")).to_pylist()


def _functions(grammar: Grammar):
    """One row a block: how it ends, and what it adds to the open brackets, for both ways to begin."""
    names = ["file", "block", "quoted0", "opened0", "quoted1", "opened1"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, *ends[0], *ends[1]), types, strict=True)], names=names)

        for batch in batches:
            for file, block, piece, plain in zip(*(c.to_pylist() for c in batch.columns), _plain(grammar, batch.column(2)), strict=True):
                if (file, block) != at:
                    if at is not None:
                        yield row()
                    at, ends = (file, block), [(False, 0), (True, 0)]
                for i, (inside, opened) in enumerate(ends):
                    if not plain:
                        inside, more = grammar.step(piece, inside)
                        ends[i] = (inside, opened + more)
                    elif not inside:
                        ends[i] = (inside, opened + grammar.plain)
        if at is not None:
            yield row()

    return functions


def beginnings(found: DataFrame, grammar: Grammar) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether each block begins within quotes, and with how many open brackets, from the functions of the blocks before it."""
    out, file, state = {}, None, (False, 0)
    kind = "file string, block long, quoted0 boolean, opened0 long, quoted1 boolean, opened1 long"
    for r in found.mapInArrow(_functions(grammar), kind).orderBy("file", "block").toLocalIterator():
        if r["file"] != file:
            file, state = r["file"], (False, 0)
        out[file, r["block"]] = state
        i = int(state[0])
        state = (r[f"quoted{i}"], state[1] + r[f"opened{i}"])
    return out


def _cut(grammar: Grammar, begins, wanted: str):
    """``file, block, place, part, text`` by block: ``rows`` are records that begin in it (part 1: it goes on in the next block), ``rest`` what it holds of a record begun before (part 0: ended here, part 1: not yet)."""
    names = ["file", "block", "place", "part", "text"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, place, carried, inside, opened = None, [], 0, False, False, 0
        out: list[tuple] = []

        def give(part: int) -> None:
            nonlocal held, place, carried
            text = grammar.separator.join(held)
            if carried or part or text.strip("\r\n"):  # empty lines are no records
                if carried == (wanted == "rest"):
                    out.append((*at, place, part, text))
                place += 1
            held, carried = [], False

        def batch_of() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [[]] * 5
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for file, block, piece, plain in zip(*(c.to_pylist() for c in batch.columns), _plain(grammar, batch.column(2)), strict=True):
                if (file, block) != at:
                    if at is not None and held:
                        give(1)
                    at, place = (file, block), 0
                    inside, opened = begins.value[file, block]
                    carried = block > 0 and (inside or opened != grammar.level)
                if wanted == "rest" and not carried:
                    continue
                held.append(piece)
                if not plain:
                    inside, more = grammar.step(piece, inside)
                    opened += more
                elif not inside:
                    opened += grammar.plain
                if not inside and opened == grammar.level:
                    give(0)
            yield batch_of()
        if held:
            give(1)
        yield batch_of()

    return cut


def records(spark: SparkSession, path: str, grammar: Grammar) -> DataFrame:
    """``file, block, place, record`` in file order: each record whole, as it stands in the file, without the separator that ends it.

    What follows the last record of a file (a closing bracket, an unclosed
    quote's lines) comes as a record of its own, for the caller to judge. A
    record begins in a block even if it ends in a later one.
    """
    found = pieces(spark, path, grammar)
    begins = beginnings(found, grammar)
    shared = spark.sparkContext.broadcast(begins)
    kind = "file string, block long, place long, part int, text string"
    rows = found.mapInArrow(_cut(grammar, shared, "rows"), kind)
    if not any(block > 0 and (inside or opened != grammar.level) for (_, block), (inside, opened) in begins.items()):
        return rows.select("file", "block", "place", F.col("text").alias("record"))
    rest = found.mapInArrow(_cut(grammar, shared, "rest"), kind)
    # Rests that follow each other belong to one record: runs that a finished rest ends. A block has one rest at most.
    runs = Window.partitionBy("file").orderBy(F.desc("block"))
    run = rest.withColumn("run", F.sum(F.when(F.col("part") == 0, 1).otherwise(0)).over(runs))
    joined = run.groupBy("file", "run").agg(F.min("block").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), grammar.separator).alias("tail"))
    # The block in which such a record began is the last one before its first rest that has any blocks' rows: the block just before it.
    before = {}
    ordered = sorted(begins)
    for (f1, b1), (f2, b2) in zip(ordered, ordered[1:], strict=False):
        if f1 == f2:
            before[f2, b2] = b1
    order = spark.createDataFrame([(f, b, p) for (f, b), p in before.items()], "file string, first long, began long")
    tails = joined.join(order, ["file", "first"]).select("file", F.col("began").alias("block"), F.lit(1).alias("part"), "tail")
    few = (tails.agg(F.sum(F.char_length("tail"))).first()[0] or 0) <= FEW_CHARACTERS
    whole = rows.join(F.broadcast(tails) if few else tails, ["file", "block", "part"], "left")
    text = F.when(F.col("tail").isNotNull(), F.concat_ws(grammar.separator, "text", "tail")).otherwise(F.col("text"))
    out = whole.select("file", "block", "place", text.alias("record"))
    return out if few else out.orderBy("file", "block", "place")


def begin_with(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether the first piece, up to a closing brace, of each of the files matches."""
    first = pieces(spark, path, JSON).where("block = 0").select("file", "piece", F.monotonically_increasing_id().alias("at"))
    return first.groupBy("file").agg(F.min_by(F.substr("piece", F.lit(1), F.lit(1 << 16)), "at").alias("piece")).where(~F.col("piece").rlike(pattern)).isEmpty()
