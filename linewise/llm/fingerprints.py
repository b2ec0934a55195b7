"""Document fingerprints by locally consistent parsing.

Level 0 is the code points. At each level runs of one symbol become one symbol; deterministic coin
tossing (the lowest bit in which a symbol differs from its left neighbour, and its value there) turns
symbols into labels of six values in four rounds; local maxima of the labels start phrases; a phrase's
name is a hash of its symbols. A phrase depends only on symbols nearby, so equal substrings have equal
names inside, wherever they lie. A level shortens the text about three times.

The fingerprint keeps, for each of 64 slots, 16 bits of the least name (of the levels from ``LEAST_LEVEL``)
that falls there, as hex; "----" is an empty slot. The likeness of two fingerprints is the share of equal slots
among those that either fills.

Next documents are met by range-partitioning on doc_id once: each partition streams its rows, and
only its first and last row meet others, through a table of at most two rows a partition.

Defined results: null and empty text have an empty fingerprint, alike 1 among themselves and 0 to others;
rows with one doc_id are ordered by a hash of the text; null doc_ids come last; a single document is its
own next; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.arrow import GOLD, MIX2, mixed
from linewise.session import stored

LEVELS, LEAST_LEVEL = 4, 3
SLOTS = 64
CHARACTERS = 400_000  # code points that are parsed at once
LOW_BIT = np.array([0, *[(i & -i).bit_length() - 1 for i in range(1, 256)]], np.uint8)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest bit that differs from the left neighbour, plus the symbol's bit there."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = symbols[first] ^ symbols.dtype.type(1)
    differs = symbols ^ left
    if symbols.dtype == np.uint8:
        at = LOW_BIT[differs]
    else:
        at = np.bitwise_count((differs & (~differs + symbols.dtype.type(1))) - symbols.dtype.type(1)).astype(np.uint8)
    return (at << 1) | ((symbols >> at.astype(symbols.dtype)) & symbols.dtype.type(1)).astype(np.uint8)


def _starts(changed: np.ndarray, first: np.ndarray) -> np.ndarray:
    changed[first] = True
    return np.flatnonzero(changed)


def parse_level(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of concatenated texts and the places of each text's first phrase.

    ``first`` are the places of each text's first symbol; every text has at least one.
    """
    changed = np.empty(len(symbols), bool)
    changed[1:] = symbols[1:] != symbols[:-1]
    at = _starts(changed, first)
    if len(at) < len(symbols):
        lengths = np.diff(np.append(at, len(symbols)))
        first = np.searchsorted(at, first)
        symbols = symbols[at].astype(np.uint64)
        runs = lengths > 1
        symbols[runs] = mixed(symbols[runs] + mixed(lengths[runs].astype(np.uint64)))
    labels = symbols
    for _ in range(4):
        labels = _toss(labels, first)
    peak = np.zeros(len(labels), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = np.append(first[1:], len(labels)) - 1
    peak[last] = False
    at = _starts(peak, first)
    lengths = np.diff(np.append(at, len(labels)))
    place = np.arange(len(labels), dtype=np.uint64) - np.repeat(at, lengths).astype(np.uint64)
    sums = np.add.reduceat(mixed(symbols.astype(np.uint64) + place * MIX2), at)
    return mixed(sums + lengths.astype(np.uint64) * GOLD + np.uint64(level)), np.searchsorted(at, first)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of every text."""
    out = ["-" * 4 * SLOTS] * len(texts)
    filled = [i for i, text in enumerate(texts) if text]
    if not filled:
        return out
    lengths = np.array([len(texts[i]) for i in filled])
    symbols = np.frombuffer("".join(texts[i] for i in filled).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    names, owners = [], []
    for level in range(1, LEVELS + 1):
        symbols, first = parse_level(symbols, first, level)
        if level >= LEAST_LEVEL:
            names.append(symbols)
            owners.append(np.repeat(np.arange(len(filled)), np.diff(np.append(first, len(symbols)))))
    names = np.concatenate(names)
    slots = np.concatenate(owners) * SLOTS + (names % np.uint64(SLOTS)).astype(np.int64)
    least = np.full(len(filled) * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    order = np.argsort(slots, kind="stable")
    edges = np.flatnonzero(np.diff(slots[order], prepend=-1))
    least[slots[order][edges]] = np.minimum.reduceat(names[order], edges)
    empty = (least == np.iinfo(np.uint64).max).reshape(-1, SLOTS)
    # low bits: the high ones of a minimum are nearly always zero
    codes = ((least >> np.uint64(6)) & np.uint64(0xFFFF)).astype(">u2").reshape(-1, SLOTS)
    for row, i in enumerate(filled):
        text = codes[row].tobytes().hex()
        out[i] = "".join("----" if e else text[4 * k:4 * k + 4] for k, e in enumerate(empty[row].tolist())) if empty[row].any() else text
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal slots among those that are filled in either."""
    pairs = [(a[i:i + 4], b[i:i + 4]) for i in range(0, 4 * SLOTS, 4)]
    filled = [x == y for x, y in pairs if x != "----" or y != "----"]
    return sum(filled) / len(filled) if filled else 1.0


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [part.split()[0] for part in RESULT.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(ids: list, texts: list[str], following: list[str]) -> list[list]:
    """Result columns for documents and the documents after them."""
    edited = [text[:len(text) - len(text) // 2] + after[:len(text) // 2] for text, after in zip(texts, following, strict=True)]
    # nearly always following[i] is texts[i + 1]: each text is parsed once
    known: dict[int, str] = {}
    own = fingerprints(texts)
    for text, print_ in zip(texts, own, strict=True):
        known[id(text)] = print_
    missing = [text for text in following if id(text) not in known]
    for text, print_ in zip(missing, fingerprints(missing), strict=True):
        known[id(text)] = print_
    after, changed = [known[id(text)] for text in following], fingerprints(edited)
    return [
        ids, [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], own, changed,
        [likeness(a, b) for a, b in zip(own, changed, strict=True)], [likeness(a, b) for a, b in zip(own, after, strict=True)],
    ]


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch in groups of about CHARACTERS code points."""
    ids, texts, held = [], [], 0
    for i in range(batch.num_rows):
        text = batch.column("text")[i].as_py() or ""
        ids.append(batch.column("doc_id")[i].as_py())
        texts.append(text)
        held += len(text)
        if held >= CHARACTERS:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """RESULT columns for each document, its edited text and the next document in descending doc_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made(columns: list[list], kind: int, text: str | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            arrays = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
            arrays += [pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([text] * n, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[*NAMES, "part", "kind", "text"])

        none = [[None]] * (len(NAMES) - 1)
        held = None
        for batch in batches:
            for ids, texts in _by_size(batch):
                if held is None:
                    yield made([[None], *none], 1, texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield made(_compared(ids[:-1], texts[:-1], texts[1:]), 0)
        if held is not None:
            yield made([[held[0]], *none], 2, held[1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, after = batch.column("text")[i].as_py(), batch.column("after")[i].as_py()
                columns = _compared([batch.column("doc_id")[i].as_py()], [text], [after])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)

    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(placed.select("doc_id", "text").mapInArrow(run, f"{RESULT}, part int, kind int, text string"))
    # at most one first and one last row a partition
    ends = rows.where("kind = 2").select("part", "doc_id", "text").join(rows.where("kind = 1").select("part", F.col("text").alias("head")), "part")
    along = Window.orderBy("part")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(along), F.first("head").over(whole))
    closed = ends.select("doc_id", "text", after.alias("after")).mapInArrow(close, RESULT)
    return rows.where("kind = 0").select(*NAMES).unionByName(closed)
