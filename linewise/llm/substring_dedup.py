"""Substring dedup by winnowing: phrases with one anchor are compared as whole blocks, then window by window.

This is not a relative Lempel-Ziv parse: phrases are cut before any reference is read, and no longest match is extended.

A window is ``window`` consecutive words. The anchor of a window is its least-hashed ``gram``-word
run, so equal windows have equal anchors at equal offsets, and the windows of a document fall into
consecutive runs with one anchor each: the phrases. A phrase and the words under its
windows are one reference block; every block of the corpus is indexed by its anchor.

1. Anchors that occur once are dropped: no window of theirs occurs twice.
2. A phrase that equals a block elsewhere as a whole has only duplicate windows:
   long copies are covered by such phrases, one row each.
3. Where blocks of one anchor differ, and only there, all single windows of one
   representative a block are looked up against every other block of the anchor.

So every window whose word sequence also starts elsewhere is found, and no other. Counts are
aggregated before they are shuffled; a passage in a third of all documents costs one row a task
and block. A block's name is its anchor and 64 bits more, a window's 64 bits and 32 of its anchor and place.

Defined results: null text has no words; documents shorter than a window lose nothing; windows
of one document count against each other; rows that share a doc_id are separate places, and spans
carry a 32-bit hash of the text they belong to; a null doc_id is an id like any; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.arrow import WordHashes, hash_runs, list_array, mixed, small_batches
from linewise.session import stored

@dataclass(frozen=True)
class SpanRule:
    window: int = 50  # words
    gram: int = 8     # words of an anchor

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1


def phrases(words: np.ndarray, rule: SpanRule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a document: anchor hash, first window, number of windows, anchor's offset in the first window."""
    count = len(words) - rule.window + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    grams = hash_runs(words, rule.gram, seed=rule.gram)
    order = mixed(grams)
    # leftmost least gram of each window: the window minimum, then its first place
    least = order[:count].copy()
    at = np.zeros(count, np.int64)
    for shift in range(1, rule.reach):
        other = order[shift:shift + count]
        below = other < least
        least[below] = other[below]
        at[below] = shift
    place = at + np.arange(count)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    lengths = np.diff(np.concatenate([starts, [count]]))
    return grams[place[starts]], starts, lengths, at[starts]


def _block_names(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, rule: SpanRule) -> list[int]:
    """64-bit name of the words under a phrase's windows, with the anchor's offset."""
    raw = words.tobytes()
    return [
        xxhash.xxh3_64_intdigest(raw[8 * s:8 * (s + n + rule.window - 1)], seed=int(o))
        for s, n, o in zip(starts.tolist(), lengths.tolist(), offsets.tolist(), strict=True)
    ]


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.hash("text").alias("digest"))


def _of_text(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``marks`` (doc_id, digest, ...) beside the texts they belong to."""
    marks = marks.withColumnRenamed("doc_id", "__id").withColumnRenamed("digest", "__digest")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return _hashed(docs).join(marks, same, how).drop("__id", "__digest", "digest")


def _blocks(docs: DataFrame, rule: SpanRule) -> DataFrame:
    """anchor, block, doc_id, digest, start (first window), windows, offset: one row per phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in small_batches(batches):
            rows, parts, names = [], [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = known.of((text or b"").split())
                found = phrases(words, rule)
                if len(found[0]):
                    parts.append(found)
                    names += _block_names(words, *found[1:], rule)
                    rows += [row] * len(found[0])
            anchors, starts, lengths, offsets = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchors.view(np.int64)), pa.array(np.array(names, np.uint64).view(np.int64)),
                    batch.column("doc_id").take(rows), batch.column("digest").take(rows),
                    pa.array(starts.astype(np.int32)), pa.array(lengths.astype(np.int16)), pa.array(offsets.astype(np.int16)),
                ],
                names=["anchor", "block", "doc_id", "digest", "start", "windows", "offset"],
            )
    return _hashed(docs).mapInArrow(
        run, "anchor long, block long, doc_id long, digest int, start int, windows short, offset short"
    )


def _window_hashes(docs: DataFrame, wanted: DataFrame, rule: SpanRule) -> DataFrame:
    """anchor, block, doc_id, digest, start, offset, alone, windows (array of hashes) for the phrases in ``wanted``.

    wanted: doc_id, digest, and phrases: array of (digest, anchor, block, start, windows, offset, alone).
    """
    asked = _of_text(docs, wanted, "inner").select("doc_id", "text", "phrases")
    passed = ("digest", "anchor", "block", "start", "offset", "alone")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in small_batches(batches, 64):
            rows, found, hashes = [], [], []
            for row, (text, phrases_) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("phrases").to_pylist(), strict=True)):
                windows = hash_runs(known.of((text or b"").split()), rule.window, seed=rule.window).view(np.int64)
                found += phrases_
                rows += [row] * len(phrases_)
                hashes += [windows[p["start"]:p["start"] + p["windows"]] for p in phrases_]
            columns = [pa.array([p[name] for p in found], kind) for name, kind in zip(passed, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns, list_array(hashes, pa.int64())], names=["doc_id", *passed, "windows"]
            )
    return asked.mapInArrow(run, "doc_id long, digest int, anchor long, block long, start int, offset short, alone boolean, windows array<long>")


def duplicate_spans(docs: DataFrame, rule: SpanRule = SpanRule()) -> DataFrame:
    """doc_id, digest (of the text), spans: array of (start, end) word numbers covered by windows that occur elsewhere.

    Spans are sorted and may touch or overlap.
    """
    blocks = stored(_blocks(docs, rule))
    often = blocks.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    repeated = stored(blocks.join(often, "anchor"))

    # whole factors: blocks that occur more than once
    index = stored(
        repeated.groupBy("anchor", "block").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "start", "windows", "offset")).alias("lead")
        )
    )
    covered = repeated.join(index.where("n > 1").select("anchor", "block"), ["anchor", "block"]).select(
        "doc_id", "digest", "start", (F.col("start") + F.col("windows") + rule.window - 1).alias("end")
    )

    # anchors with different blocks: their single windows, of one representative each; blocks that occur twice are covered already
    differ = index.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor")
    edges = index.join(differ, "anchor").select("anchor", "block", (F.col("n") == 1).alias("alone"), "lead.*")
    phrase = F.struct("digest", "anchor", "block", "start", "windows", "offset", "alone")
    wanted = stored(edges.groupBy("doc_id", "digest").agg(F.collect_list(phrase).alias("phrases")))  # at most the phrases of one document
    # rows that repeat a document give a representative twice
    windows = stored(_window_hashes(docs, wanted, rule).dropDuplicates(["anchor", "block"]))
    place = F.col("offset") - F.col("k")
    looked = windows.select("doc_id", "digest", "start", "alone", "anchor", "offset", F.posexplode("windows").alias("k", "window")).select(
        "doc_id", "digest", (F.col("start") + F.col("k")).alias("start"), "alone", "window", F.hash("anchor", place).alias("where")
    )
    twice = looked.groupBy("window", "where").agg(F.count("*").alias("n")).where("n > 1").select("window", "where")
    partly = looked.where("alone").join(twice, ["window", "where"]).select("doc_id", "digest", "start", (F.col("start") + rule.window).alias("end"))

    spans = covered.unionByName(partly)
    return spans.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def cut_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept text: words outside the spans, joined by one space."""
    joined = _of_text(docs, spans, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts, removed, kept = [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
                words = (text or b"").split()
                keep = np.ones(len(words), bool)
                if found.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, found.values.field("start").to_numpy(zero_copy_only=False), 1)
                    np.add.at(edge, found.values.field("end").to_numpy(zero_copy_only=False), -1)
                    keep = np.cumsum(edge)[:-1] == 0
                counts.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
