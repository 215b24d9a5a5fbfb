"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a row's hash. Every bucket
whose rows exceed the byte limit splits on one more bit; the others stay. Sums
for all prefix lengths of one round come from a single aggregate over the
finest prefixes, so a round adds many bits at once, and only rows of buckets
which are still too large go on to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import checkpointed, given, named, private

#: Bits of a row's hash; buckets never go deeper.
BITS = 128


def digest_of(key: Column) -> Column:
    """The MD5 of a key as 32 hexadecimal digits; a null key is hashed as the empty string."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def leading_bits(digest: Column, n: int) -> Column:
    """The first ``n`` bits of a digest as text."""
    words = [F.lpad(F.conv(F.substring(digest, i, 8), 16, 2), 32, "0") for i in range(1, -(-n // 32) * 8, 8)]
    return F.substring(F.concat(*words), 1, n)


def assign_shards(df: DataFrame, key: str, n_bytes: Column, limit: int, bits_a_round: int = 12) -> DataFrame:
    """``df`` with a struct ``shard``: prefix, depth, bytes.

    ``n_bytes`` is a row's size (null: 0), ``limit`` a shard's most bytes. A
    bucket splits only while its rows exceed the limit. Rows with equal keys
    share all bits: a bucket with one key left, such as a single row above the
    limit, cannot split and is a shard of its own, at the depth at which no
    other key shares it. An empty table has no shards. Rows come back with
    their columns, but a column ``shard``, in any case, is replaced.
    """
    own, size_of = private(df, "own_digest", "own_size")
    rows = df.withColumns({own: digest_of(named(key)), size_of: F.coalesce(n_bytes.cast("long"), F.lit(0))})
    # One row for each key: all later rounds work on these.
    keys = checkpointed(rows.groupBy(F.col(own).alias("digest")).agg(F.sum(size_of).alias("size")))
    leaves, open_keys, done = [], keys, 0
    while done < BITS:
        deepest = min(done + bits_a_round, BITS)
        fine = open_keys.groupBy(leading_bits(F.col("digest"), deepest).alias("fine")).agg(F.sum("size").alias("size"), F.count("*").alias("keys"))
        depths = F.explode(F.sequence(F.lit(done), F.lit(deepest))).alias("depth")
        sums = fine.select("fine", "size", "keys", depths).groupBy(F.expr("substring(fine, 1, depth)").alias("prefix"), "depth").agg(F.sum("size").alias("size"), F.sum("keys").alias("keys"))
        fits = (F.col("size") <= limit) | (F.col("keys") == 1) | (F.col("depth") == BITS)
        # A leaf is the first prefix on its path that fits; sizes only fall along a path.
        at = fine.select("fine", depths).withColumn("prefix", F.expr("substring(fine, 1, depth)")).join(sums.where(fits), ["prefix", "depth"])
        found = at.groupBy("fine").agg(F.min(F.struct("depth", "prefix", "size")).alias("leaf"))
        placed = open_keys.withColumn("fine", leading_bits(F.col("digest"), deepest)).join(found, "fine", "left")
        leaves.append(placed.where("leaf is not null").select("digest", F.struct(F.col("leaf.prefix").alias("prefix"), F.col("leaf.depth").alias("depth"), F.col("leaf.size").alias("bytes")).alias("shard")))
        open_keys = checkpointed(placed.where("leaf is null").select("digest", "size"))
        done = deepest
        if open_keys.isEmpty():
            break
    digest, shard = private(rows, "digest", "leaf")
    directory = reduce(DataFrame.unionByName, leaves).toDF(digest, shard)
    return rows.join(directory, F.col(own) == F.col(digest)).select(*given(df, "shard"), F.col(shard).alias("shard"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes sharded rows as Parquet, one folder for each shard prefix."""
    df.withColumn("shard_prefix", F.concat(F.lit("p"), F.col("shard.prefix"))).drop("shard").repartition("shard_prefix").write.partitionBy("shard_prefix").parquet(path)
