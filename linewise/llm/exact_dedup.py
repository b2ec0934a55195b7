"""Exact dedup through an extendible-hash index on shared files, with DataFrame functions only.

1. Entries (document, key, length, digest) are stored once; the key is a 64-bit hash of the
   normalised text.
2. The directory starts at ``FIRST_DEPTH`` key bits. A bucket with more distinct keys than
   its capacity is split by one more bit, again and again (directory doubling), from
   aggregated counts. Capacity is at least a fixed share of all keys, so the directory
   has a proven bound and is broadcast.
3. Texts go to the owner task of their bucket: rows are range-partitioned by the first key of the bucket, so an owner has
   whole buckets of one key range. Inside a bucket the texts of one key are a chain, compared by the bytes of the normalised
   text, so two texts under one key stay apart. Texts of hot keys (more rows than an average partition) are folded by
   partial aggregates first and come to the owner as a few counted rows.
4. The owners write the index (bucket, key, text digest, document that stays, size) to the shared folder; entries look
   their row up in it, those of hot texts (fewer than partitions) by broadcast, the others by a join on key and digest.

Defined results: null text counts as empty; of equal texts the row with the most code points
stays, then the smallest doc_id (null last); rows that repeat a doc_id are rows of their own
in group_size, and all rows with the doc_id that stays are kept; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.session import stored

SPACES = " \t\n\x0b\f\r"
FIRST_DEPTH = 6
LEAST_CAPACITY = 2_000
LEAST_HOT = 1_000
DIRECTORY_SHARE = 2048
MOST_DEPTH = 62


def without_spaces(text: Column) -> Column:
    """Null as empty; every white-space character deleted."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key as a number."""
    return F.shiftrightunsigned("key", 64 - depth)


def split_buckets(entries: DataFrame, least_capacity: int = LEAST_CAPACITY, first_depth: int = FIRST_DEPTH) -> DataFrame:
    """Overfull buckets: depth, prefix. An entry's bucket ends below its deepest overfull prefix.

    Capacity counts distinct keys: a hot key is one chain and no splitting divides it. With
    capacity at or above 1/2048 of all keys, each depth has at most 2,048 overfull buckets.
    """
    spark = entries.sparkSession
    keys = stored(entries.select("key").distinct())
    capacity = max(least_capacity, -(-keys.count() // DIRECTORY_SHARE))
    directory = spark.createDataFrame([], "depth int, prefix long")
    inside = keys
    for depth in range(first_depth, MOST_DEPTH):
        overfull = stored(inside.groupBy(_prefix(depth).alias("prefix")).count().where(F.col("count") > capacity).select("prefix"))
        if overfull.isEmpty():
            return directory
        directory = directory.unionByName(overfull.select(F.lit(depth).alias("depth"), "prefix"))
        inside = inside.join(F.broadcast(overfull), _prefix(depth) == F.col("prefix"), "left_semi")
    return directory


def with_bucket(rows: DataFrame, directory: DataFrame, first_depth: int = FIRST_DEPTH) -> DataFrame:
    """Add bucket (local depth and key prefix, as text) and start (the bucket's first key)."""
    depths = [row["depth"] for row in directory.select("depth").distinct().orderBy("depth").collect()]  # at most 56 numbers
    rows = rows.withColumn("depth", F.lit(first_depth))
    for depth in depths:
        split = F.broadcast(directory.where(F.col("depth") == depth).select(F.col("prefix").alias("split")))
        rows = rows.join(split, _prefix(depth) == F.col("split"), "left").withColumn(
            "depth", F.when(F.col("split").isNotNull(), depth + 1).otherwise(F.col("depth"))
        ).drop("split")
    return rows.withColumns({
        "bucket": F.expr("concat_ws('-', depth, shiftrightunsigned(key, 64 - depth))"),
        "start": F.expr("shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth)"),
    }).drop("depth")


def _hot_keys(entries: DataFrame, least_hot: int) -> DataFrame:
    """Keys with more rows than an average partition; fewer of them than partitions."""
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least_hot, entries.count() // partitions)
    return entries.groupBy("key").count().where(F.col("count") > limit).select("key")


def dedup_exact(docs: DataFrame, least_capacity: int = LEAST_CAPACITY, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, bucket: one row per row of ``docs``."""
    normal = docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("length"), without_spaces(F.col("text")).alias("body"))
    keyed = normal.withColumn("key", F.xxhash64("body"))
    entries = stored(keyed.select("doc_id", "key", "length", F.sha2("body", 256).alias("text_sha256")))
    directory = stored(split_buckets(entries, least_capacity))
    hot = stored(_hot_keys(entries, least_hot))

    texts = keyed.select("key", "body")
    folded = texts.join(F.broadcast(hot), "key").groupBy("key", "body").agg(F.count("*").alias("rows"))
    single = texts.join(F.broadcast(hot), "key", "left_anti").withColumn("rows", F.lit(1).cast("long"))
    owned = with_bucket(single.unionByName(folded), directory).repartitionByRange("start")
    chains = owned.groupBy("start", "bucket", "key", "body").agg(F.sum("rows").alias("group_size")).select(
        "bucket", "key", F.sha2("body", 256).alias("text_sha256"), "group_size"
    )
    first = F.struct((-F.col("length")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id")
    best = entries.groupBy("key", "text_sha256").agg(F.min(first).alias("best"))
    index = stored(chains.join(best, ["key", "text_sha256"]).select("bucket", "key", "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id")))

    rows_of_hot = index.join(F.broadcast(hot), "key", "left_semi")
    cold = entries.join(F.broadcast(hot), "key", "left_anti").join(index, ["key", "text_sha256"])
    met = cold.unionByName(entries.join(F.broadcast(rows_of_hot), ["key", "text_sha256"]))
    return met.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket"
    )
