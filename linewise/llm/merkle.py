"""Merkle manifest of a dataset by nested-interval labels.

Every row is a leaf; leaves of one source ascend by doc_id and have ranks 0..n-1. A node carries the interval
of leaf ranks it covers, so a node of level L with lowest rank lo lies in the parent whose interval contains lo, and
the siblings of a node are what its parent's interval leaves when its own is taken away.

1. One scan makes the digests; from here on no text moves. Ranks come from a range layout by (source, doc_id, digest),
   so a hot source is spread over many tasks.
2. Levels are worked in bands of six. A band groups the nodes of its lowest level by the ancestor that contains
   them (3**6 = 729 neighbours at most), builds the nodes between and notes for each member the siblings on its
   left and right, level by level. Ancestors become the members of the next band; the number of bands grows
   with the logarithm of the largest source. A task holds one group at a time.
3. Bands are attached downwards by joins of a member to the ancestor that contains it. A key of these joins has at most
   729 rows. Sub-roots are the leaves of one more tree, built the same way.

Defined results: a null field hashes as ``-``; null source comes first; null doc_ids come last within a source; rows that
repeat a doc_id are leaves of their own, ordered by their digest; a lone leaf is its source's sub-root; no rows give no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.arrow import small_batches
from linewise.operators.joining import lookup_join
from linewise.operators.ordering import PART, POS, range_layout
from linewise.session import stored

FAN = 3
BAND = 6  # levels worked at once
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 4096


def field_bytes(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of one row; ``changed`` replaces fields by name."""
    return F.sha2(F.concat(*[field_bytes(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def digest_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _ranked(leaves: DataFrame, sort: list[str]) -> DataFrame:
    """Add pos (from 0) and count to the leaves of each branch."""
    laid = range_layout(leaves, ["branch"], sort)
    spans = laid.groupBy("branch", PART).agg(F.min(POS).alias("_start"), F.count("*").alias("_rows"))
    branch = Window.partitionBy("branch")
    earlier = branch.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    places = spans.select(
        "branch", PART, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_start")).alias("_shift"),
        F.sum("_rows").over(branch).alias("count"),
    )
    return lookup_join(laid, places, ["branch", PART]).withColumn("pos", F.col(POS) + F.col("_shift")).drop(PART, POS, "_shift")


def _inside(first: int, count: int, digests: list[bytes], fan: int, width_end: int) -> tuple[list, list, bytes]:
    """Siblings to the left and right of each member, level by level, and the digest of their common ancestor."""
    nodes = [(first + i, first + i + 1, digest) for i, digest in enumerate(digests)]
    left: list[list[bytes]] = [[] for _ in digests]
    right: list[list[bytes]] = [[] for _ in digests]
    width = 1
    while width < width_end and count > width:
        width *= fan
        parents: list[tuple[int, int, bytes]] = []
        at = 0
        while at < len(nodes):
            end = at
            while end < len(nodes) and nodes[end][0] // width == nodes[at][0] // width:
                end += 1
            run = nodes[at:end]
            for low, high, _ in run:
                before = b"".join(d for _, h, d in run if h <= low)
                after = b"".join(d for lo, _, d in run if lo >= high)
                for member in range(low - first, high - first):
                    left[member].append(before)
                    right[member].append(after)
            whole = hashlib.sha256(b"".join(d.hex().encode() for _, _, d in run)).digest()
            parents.append((run[0][0], run[-1][1], whole))
            at = end
        nodes = parents
    return left, right, nodes[0][2]


def _band(fan: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def climb(rows: pa.Table, starts: list[int]) -> pa.Table:
        lefts: list[list[bytes]] = []
        rights: list[list[bytes]] = []
        tops: list[bytes] = []
        pos, count, digest = (rows[name].to_pylist() for name in ("pos", "count", "digest"))
        for start, end in zip(starts, [*starts[1:], rows.num_rows]):
            left, right, top = _inside(pos[start], count[start], digest[start:end], fan, width)
            lefts += left
            rights += right
            tops += [top] * (end - start)
        kind = pa.list_(pa.binary())
        return (
            rows.append_column("left", pa.array(lefts, kind)).append_column("right", pa.array(rights, kind))
            .append_column("top", pa.array(tops, pa.binary()))
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the group that may go on in the next batch
        for batch in small_batches(batches, ROWS):
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = list(zip(rows["branch"].to_pylist(), rows["bucket"].to_pylist()))
            starts = [i for i, key in enumerate(keys) if i == 0 or key != keys[i - 1]]
            if len(starts) > 1:
                yield from climb(rows.slice(0, starts[-1]), starts[:-1]).combine_chunks().to_batches()
            rest = rows.slice(starts[-1])
        if rest is not None:
            yield from climb(rest, [0]).combine_chunks().to_batches()

    return run


def _climb(members: DataFrame, fan: int, band: int) -> list[DataFrame]:
    """Bands from the leaves up; the last has one group a branch, whose top is the branch's root.

    ``members`` has branch, pos, count, digest; a band adds bucket, left, right and top.
    """
    width = fan**band
    bands: list[DataFrame] = []
    while True:
        grouped = members.withColumn("bucket", F.floor(F.col("pos") / width)).repartition("branch", "bucket")
        sorted_rows = grouped.sortWithinPartitions("branch", "bucket", "pos")
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in grouped.schema)}, left array<binary>, right array<binary>, top binary"
        bands.append(stored(sorted_rows.mapInArrow(_band(fan, width), schema)))
        if (bands[-1].agg(F.max("count")).first()[0] or 0) <= width:
            return bands
        members = bands[-1].where(F.col("pos") % width == 0).select(
            "branch", F.col("bucket").alias("pos"), F.ceil(F.col("count") / width).alias("count"), F.col("top").alias("digest")
        )


def _attach(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """Members of the lowest band with all siblings up to the root; ``above`` has branch, sub, left, right, root per branch."""
    upper = above.withColumn("up", F.lit(0).cast("long"))
    for band in reversed(bands):
        ancestors = upper.select(
            F.col("branch").alias("_branch"), F.col("up").alias("_up"), F.col("left").alias("_left"), F.col("right").alias("_right"), "subroot", "root"
        )
        upper = band.join(ancestors, (F.col("branch") == F.col("_branch")) & (F.col("bucket") == F.col("_up"))).select(
            *[name for name in band.columns if name not in ("left", "right", "pos", "top", "bucket")], F.col("pos").alias("up"),
            F.concat("left", "_left").alias("left"), F.concat("right", "_right").alias("right"), "subroot", "root",
        )
    return upper


def merkle_proofs(leaves: DataFrame, fan: int = FAN, band: int = BAND) -> DataFrame:
    """Rows of ``leaves`` (source, doc_id, digest: binary, and others that are carried) with subroot, root, left and right.

    ``left`` and ``right`` hold, level by level from the leaf to the root, the joined digests of the siblings on either side.
    """
    carried = [name for name in leaves.columns if name not in ("source", "digest")]
    branch = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # null first, then bytewise
    placed = _ranked(leaves.select(branch.alias("branch"), "digest", *carried), ["doc_id", "digest"])
    bands = _climb(placed, fan, band)
    subroots = bands[-1].where(F.col("pos") == 0).select(F.lit("").alias("branch"), F.col("branch").alias("name"), F.col("top").alias("digest"))
    root_bands = _climb(_ranked(subroots, ["name"]), fan, band)
    root = root_bands[-1].where(F.col("pos") == 0).select(
        "branch", F.col("top").alias("root"), F.array().cast("array<binary>").alias("left"), F.array().cast("array<binary>").alias("right"),
        F.lit(None).cast("binary").alias("subroot"),
    )
    above = _attach(root_bands, root).select(F.col("name").alias("branch"), F.col("digest").alias("subroot"), "left", "right", "root")
    source = F.when(F.col("branch") != "-", F.substring("branch", 2, 2**31 - 1))
    return _attach(bands, stored(above)).select(source.alias("source"), "digest", *carried, "subroot", "root", "left", "right")


def proof_text(left: Column, right: Column) -> Column:
    """All siblings as hex text, level by level, left to right."""
    return F.array_join(F.zip_with(left, right, lambda a, b: F.concat(digest_text(a), digest_text(b))), "")


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root as hex text that a leaf (hex text) gives with these siblings."""
    steps = F.zip_with(left, right, lambda a, b: F.struct(digest_text(a).alias("a"), digest_text(b).alias("b")))
    return F.aggregate(steps, leaf, lambda digest, step: F.sha2(F.concat(step["a"], digest, step["b"]), 256))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where two divides the checksum of the doc_id; a stand-in for damage in storage."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verified_manifest(docs: DataFrame, text_now: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of ``docs``, and each row as it is now.

    ``text_now`` is the text as found later; it is folded with the manifest's siblings and compared with its root.
    """
    leaves = docs.select("source", "doc_id", F.unhex(leaf_digest()).alias("digest"), F.unhex(leaf_digest(text=text_now)).alias("now"))
    folded = fold(digest_text(F.col("now")), F.col("left"), F.col("right"))
    out = merkle_proofs(leaves).select(
        "doc_id", digest_text(F.col("digest")).alias("leaf"), digest_text(F.col("subroot")).alias("subroot"), digest_text(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("left"), F.col("right")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
