"""Line dedup: lines that many documents share stay only in the last of them.

Keys of lines are hashed, dealt out by ranges of (hash, document, position)
and sorted within each range. One pass streams each run of equal hashes: its
first document holds the line for good, later ones lose it as soon as the run
is known to reach enough documents. Ranges are cut by document as well, so a
line that a third of the corpus holds spreads over many tasks; only rows of a
run that touches the edge of a range stay open, and a grouped count over those
settles them. What comes back for a document is a compressed bitmap of the
lines to keep, never text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.common import BLANKS, ascii_lower, checkpointed, given, named, private, stored, text_hash

#: Stands for a null document id while rows are sorted: it is below all others.
NO_ID = -(2**63)
_COLUMNS = ("h1", "h2", "doc", "text_key", "line", "n_lines")
_ROWS = T.StructType([T.StructField("open", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in _COLUMNS])


def _streamed(min_docs: int):
    """The pass over one sorted range: rows to drop, and rows whose run may reach into other ranges.

    Rows that are there again, from repeated rows of the table, count once.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the current run: the rows of its first min_docs documents
        held_at: list[np.ndarray] = []  # and which document of the run each is in
        key, last_row, last_doc, docs, first = None, None, None, 0, True

        def out(rows: np.ndarray, is_open: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], is_open))] + [pa.array(x) for x in rows], names=["open", *_COLUMNS])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in _COLUMNS])
            fresh = np.ones(rows.shape[1], bool)
            fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
            fresh[0] = last_row is None or (rows[:, 0] != last_row).any()
            last_row = rows[:, -1].copy()
            rows = rows[:, fresh]
            if not rows.shape[1]:
                continue
            h1, h2, doc = rows[0], rows[1], rows[2]
            new_run = np.ones(len(h1), bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_run[0] = key is None or key != (h1[0], h2[0])
            new_doc = new_run.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            new_doc[0] |= last_doc != doc[0]
            run = np.cumsum(new_run)  # 0: goes on from the batch before
            seen = np.cumsum(new_doc)
            base = np.zeros(run[-1] + 1, np.int64)
            begins = np.flatnonzero(new_run)
            base[run[begins]] = seen[begins] - 1
            base[0] = -docs
            at = seen - base[run]
            total = np.zeros(run[-1] + 1, np.int64)
            np.maximum.at(total, run, at)
            in_first = np.zeros(len(h1), bool)
            if first:
                in_first = run == (1 if key is None else 0)
                yield out(rows[:, in_first], True)
            yield out(rows[:, ~in_first & (at > 1) & (total[run] >= min_docs)], False)
            goes_on = not new_run[0]
            if goes_on and not first and docs < min_docs <= total[0]:
                yield from (out(x[:, n > 1], False) for x, n in zip(held, held_at, strict=True))
            last = run == run[-1]
            if run[-1] > 0:
                held, held_at = [], []
                first = first and key is None and run[-1] == 1
            keep = last & (at <= min_docs)
            held.append(rows[:, keep])
            held_at.append(at[keep])
            key, last_doc, docs = (h1[-1], h2[-1]), doc[-1], int(total[run[-1]])
        if not first:
            yield from (out(x, True) for x in held)

    return stream


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, lines: np.ndarray) -> bytes:
        keep = np.ones(n, bool)
        keep[np.asarray(lines, np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, x) for n, x in zip(n_lines, dropped, strict=True)], dtype=object)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For each document that loses lines: ``doc, text_key, n_lines, n_dropped, keep_bitmap``.

    A line's key is the line stripped of blanks at both ends, with A-Z
    lower-cased. Keys of at least ``min_chars`` code points that are found
    under at least ``min_docs`` ids lose all their lines except under the
    largest id. ``id_col`` holds integers; a null id ranks below all others
    (``doc`` is then ``NO_ID``) and all rows without an id count as one
    document for that purpose. ``text_key`` is the text's hash. Rows with the
    same id and text count once and have one row here. A null or empty text is
    one empty line. ``keep_bitmap`` is the zlib-compressed packed bits of the
    lines, first line first, 1 for keep.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc = F.coalesce(named(id_col).cast("long"), F.lit(NO_ID))
    split = docs.select(doc.alias("doc"), text_hash(named(text_col)).alias("text_key"), F.split(F.coalesce(named(text_col), F.lit("")), "\n").alias("lines"))
    lines = split.select("doc", "text_key", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("line", "raw"))
    keys = lines.select("doc", "text_key", F.col("line").cast("long").alias("line"), "n_lines", ascii_lower(F.btrim("raw", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= min_chars)
    hashed = keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "text_key", "line", "n_lines")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc()]
    hashed = stored(hashed)  # ranges are cut from a sample, which reads the rows once more than the shuffle
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text_key", "line")
    streamed = checkpointed(ranged.mapInArrow(_streamed(min_docs), _ROWS))
    edge = streamed.where("open")
    totals = edge.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)
    # Only the first and the last run of a range are open, so there are at most two keys a range to send.
    settled = edge.join(F.broadcast(totals), ["h1", "h2"]).where("doc <> keeper")
    drops = streamed.where("not open").unionByName(settled.select(streamed.columns))
    gathered = drops.groupBy("doc", "text_key", "n_lines").agg(F.collect_set("line").alias("dropped"))
    return gathered.select("doc", "text_key", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), _bitmap("n_lines", "dropped").alias("keep_bitmap"))


_KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(_KEPT)
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    rows = []
    for value, bits in zip(text, bitmap, strict=True):
        lines = (value or "").split("\n")
        if bits is not None:
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)]
            lines_kept = [x for x, k in zip(lines, keep, strict=True) if k]
        else:
            lines_kept = lines
        kept = "\n".join(lines_kept)
        rows.append((len(lines), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return pd.DataFrame(rows, columns=_KEPT.names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with a struct ``lines``: n_lines, n_dropped, kept, kept_sha256, keep_bitmap.

    Each row of ``docs`` comes back once with its columns, repeated rows too;
    a column ``lines``, in any case, is replaced. See :func:`keep_bitmaps` for
    the rule; ``keep_bitmap`` is null where all lines stay. An empty table
    gives an empty one.
    """
    a, b, doc, key, total, dropped, bitmap, kept = private(docs, "own_doc", "own_key", "doc", "text_key", "n_lines", "n_dropped", "keep_bitmap", "kept")
    found = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).toDF(doc, key, total, dropped, bitmap)
    keyed = docs.withColumns({a: F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)), b: text_hash(named(text_col))})
    joined = keyed.join(found, (F.col(a) == F.col(doc)) & (F.col(b) == F.col(key)), "left")
    out = joined.withColumn(kept, _kept(named(text_col), F.col(bitmap)))
    k = F.col(kept)
    lines = F.struct(k["n_lines"].alias("n_lines"), F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias("n_dropped"), k["kept"].alias("kept"), k["kept_sha256"].alias("kept_sha256"), F.col(bitmap).alias("keep_bitmap"))
    return out.select(*given(docs, "lines"), lines.alias("lines"))
