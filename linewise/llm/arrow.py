"""Helpers for functions that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import SparkSession

GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64
ROWS = 256
ARROW_ROWS = 512  # rows with a text or its ids in one batch between Spark and Python


class WordHashes(dict):
    """64-bit hash of each word's bytes, kept for words seen before; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:  # some 7 MB a worker
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = values + GOLD
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def hash_runs(words: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, by doubling: each step joins two neighbours."""
    count = len(words) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, span, out, done = mixed(words ^ np.uint64(seed)), 1, None, 0
    rest = length
    while rest:
        if rest & 1:
            part = power[done:done + count]
            out = part.copy() if out is None else mixed(out * MIX1 + part)
            done += span
        rest >>= 1
        if rest:
            power = mixed(power[:-span] * MIX1 + power[span:])
            span *= 2
    return out


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that no list of Python texts grows large.

    Workers outlive their tasks, so what Arrow freed but still holds goes back to the system at the end.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """From now on Spark sends rows to Python in batches of at most ``rows``; a smaller setting stays.

    With the default of 10,000 whole texts a task's rows are one batch, which the JVM and each Python worker hold entire and in
    buffers that grow by doubling. Results do not depend on the setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, rows)


def packed_text(text: bytes | None) -> bytes:
    """A text for a shuffle: its length and its zstd block, about a third of the bytes of its words' hashes."""
    text = text or b""
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked_text(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def flat_map(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``make`` on each small batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield make(batch)
    return run


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(part) for part in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))
