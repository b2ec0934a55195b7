"""Line dedup over the whole corpus, with DataFrame functions only.

Line keys are hashed to 128 bits and range-partitioned by hash with document and
position as secondary sort; every partition streams its keys once, sees the first
occurrence first and counts the documents. What comes back is not text but one
compressed bitmap per document: the line numbers at which "keep" flips, starting
from keep. ``apply_bitmaps`` turns a bitmap into text.

A key with more lines than an average partition is hot. There are at most as many
hot keys as partitions, so their decisions come from partial aggregates and are
broadcast; their lines never meet in one task.

Defined results: null text is one empty line; keys shorter than ``least_chars`` are
never dropped; rows with the same doc_id are one document for the count; equal rows
get equal bitmaps; a null doc_id is a document of its own; no rows give no rows;
other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.session import stored

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COUNTERS = ("n_lines", "n_dropped")
KEY = ["h1", "h2"]
LEAST_HOT = 10_000


@dataclass(frozen=True)
class LineRule:
    """least_documents: a key in fewer documents is left alone. keep_first: one line of it stays."""

    least_chars: int = 1
    least_documents: int = 2
    keep_first: bool = True


def line_key(line: Column) -> Column:
    """The line without outer white space, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashed_lines(docs: DataFrame, rule: LineRule) -> DataFrame:
    numbered = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = numbered.select("doc_id", "digest", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= rule.least_chars).select(
        "doc_id", "digest", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _hot_decisions(lines: DataFrame, least_hot: int) -> DataFrame:
    """Keys with more rows than an average partition: number of documents and first line.

    Counts by 65,536 hash buckets find where hot keys can be; only those buckets are
    counted by key.
    """
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(least_hot, lines.count() // partitions)
    bucket = F.shiftright("h1", 48)
    crowded = lines.groupBy(bucket.alias("bucket")).count().where(F.col("count") > limit).select("bucket")
    suspects = lines.join(F.broadcast(crowded), bucket == F.col("bucket"), "left_semi")
    hot = suspects.groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY)
    by_document = suspects.join(F.broadcast(hot), KEY, "left_semi").groupBy(*KEY, "doc_id").agg(
        F.min(F.struct("digest", "pos")).alias("first")
    )
    return by_document.groupBy(*KEY).agg(
        F.count("*").alias("documents"), F.min(F.struct("doc_id", "first.digest", "first.pos")).alias("first")
    )


def _flips(dropped: Column) -> Column:
    """Sorted dropped line numbers as the numbers at which the keep bit flips."""
    before = lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1)
    after = lambda x, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != x + 1)
    runs = F.zip_with(F.filter(dropped, before), F.filter(dropped, after), lambda a, b: F.array(a, b + 1))
    return F.flatten(runs)


def line_bitmaps(docs: DataFrame, rule: LineRule = LineRule(), least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, digest (of the text), n_dropped, keep_flips for every document that loses a line."""
    lines = stored(_hashed_lines(docs, rule))
    hot = stored(_hot_decisions(lines, least_hot))
    stays = F.lit(rule.keep_first)

    place = F.struct("doc_id", "digest", "pos")
    of_hot = lines.join(F.broadcast(hot), KEY).where(
        (F.col("documents") >= rule.least_documents) & ~(stays & (place == F.col("first")))
    )

    along = Window.partitionBy(*KEY).orderBy("doc_id")
    cold = (
        lines.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti")
        .repartitionByRange(*KEY).sortWithinPartitions(*KEY, "doc_id", "digest", "pos")
        .withColumn("number", F.dense_rank().over(along))
        .withColumn("order", F.rank().over(along.orderBy("doc_id", "digest", "pos")))
        .withColumn("documents", F.max("number").over(Window.partitionBy(*KEY)))
        .where((F.col("documents") >= rule.least_documents) & ~(stays & (F.col("order") == 1)))
    )
    place = ["doc_id", "digest", "pos"]
    dropped = of_hot.select(place).unionByName(cold.select(place)).groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_set("pos")).alias("dropped")
    )
    return dropped.select("doc_id", "digest", F.size("dropped").cast("long").alias("n_dropped"), _flips(F.col("dropped")).alias("keep_flips"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text, and n_lines and n_dropped (overwriting columns of these names)."""
    others = [name for name in docs.columns if name not in ("text", *COUNTERS)]
    split = docs.select(*others, F.xxhash64("text").alias("__digest"), _lines(F.col("text")).alias("__lines"))
    marks = bitmaps.select(
        F.col("doc_id").alias("__id"), F.col("digest").alias("__mark"), F.col("n_dropped").alias("__dropped"), F.col("keep_flips").alias("__flips")
    )
    joined = split.join(marks, (F.col("__digest") == F.col("__mark")) & split["doc_id"].eqNullSafe(F.col("__id")), "left")
    edges = F.concat(F.array(F.lit(0)), F.col("__flips"), F.array(F.size("__lines")))
    edged = joined.withColumn("__edges", F.when(F.col("__flips").isNotNull(), edges))
    kept = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("__edges") - 2, F.lit(2)),
        lambda k: F.slice("__lines", F.get("__edges", k) + 1, F.get("__edges", k + 1) - F.get("__edges", k)),
    ))
    return edged.select(
        *others,
        F.array_join(F.when(F.col("__flips").isNull(), F.col("__lines")).otherwise(kept), "\n").alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).alias("n_dropped"),
    )


def drop_repeated_lines(docs: DataFrame, rule: LineRule = LineRule()) -> DataFrame:
    """Bitmaps made and applied."""
    return apply_bitmaps(docs, line_bitmaps(docs, rule))
