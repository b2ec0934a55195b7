"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Encoding runs on Arrow batches. Texts longer than ``LONG`` code points are cut first at safe
boundaries: a white-space character after one that is none. No match of the pattern crosses such a
place and none looks past it, so the pieces' ids joined are the whole text's ids, while the
regex engine never holds a very long text at once. A text without such a place is encoded whole.
Decoding joins the raw bytes of the ids, so ids of a broken character decode too.

Spark sends texts and ids to Python in short batches (``arrow.short_batches``), so a task's memory does not grow with its rows.

The rank file must be present on every executor (its path is a parameter); each task reads it once.

Defined results: null text is empty and has no ids; null ids decode to no bytes; an unknown id is an
error; repeated rows and no rows are as any; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewise.llm.arrow import list_array, short_batches, small_batches

LONG = 100_000
BOUNDARY = re.compile(r"(?<=\S)(?=[ \t\n\x0b\f\r])")


def load_encoding(rank_file: str, pattern: str):  # noqa: ANN201
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long: int = LONG) -> Iterator[str]:
    """The text in pieces of ``long`` code points or somewhat more, cut at safe boundaries only."""
    start = 0
    while len(text) - start > long:
        found = BOUNDARY.search(text, start + long)
        if found is None:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:]


def _with_column(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema if f.name != name] + [T.StructField(name, kind)])


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, field in enumerate(batch.schema.names) if field != name]
    return pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], column], names=[*[batch.schema.names[i] for i in kept], name])


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", long: int = LONG) -> DataFrame:
    """``docs`` with ``ids``: the token ids of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_file, pattern)

        def ids_of(value: str | None) -> np.ndarray:
            """One text at a time, as a compact array."""
            parts = [np.asarray(encoding.encode_ordinary(piece), np.int32) for piece in safe_pieces(value, long)] if value else []
            return np.concatenate(parts) if parts else np.zeros(0, np.int32)

        for batch in small_batches(batches, 64):
            column = [ids_of(value.as_py()) for value in batch.column(text)]
            yield _replaced(batch, ids, list_array(column, pa.int32()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, _with_column(docs, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``docs`` with ``data``: the bytes of ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(rank_file, pattern)
        for batch in small_batches(batches, 64):
            column = [encoding.decode_bytes(value.as_py()) if value.is_valid and len(value) else b"" for value in batch.column(ids)]
            yield _replaced(batch, data, pa.array(column, pa.binary()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, _with_column(docs, data, T.BinaryType()))


def ids_sha256(ids: Column) -> Column:
    """Hex digest of the ids as little-endian unsigned 32-bit numbers."""
    @F.pandas_udf("string")
    def digest(lists: pd.Series) -> pd.Series:
        return lists.map(lambda values: hashlib.sha256(np.asarray(values if values is not None else [], "<u4").tobytes()).hexdigest())

    return digest(ids)
