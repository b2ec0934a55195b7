"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Sets are put in size bands. In a band, two sets that link differ in at most H shingles. The
hash universe is cut into M segments; if all segments of two sets differ, the sets differ in at
least as many places as the segments count: an exact segment counts 1, a segment that is also
indexed with all its one-deletion neighbours counts 2 (it fails only at two differences). The
allocation of a band chooses M, the number d of deletion segments, and the number z of
poorest segments that every set may leave out, such that M + d - 2z > H, at the least cost
in signatures and expected chance meetings, from the sizes counted over all documents.
Two sets that link therefore share a signature, and every candidate is verified exactly.

A set indexes its own band and probes the band below, so a pair meets in the band of the smaller.
Equal sets are one class from the start. Per signature, members are verified against one pivot
(the member with the most company), which also gives each member's difference from the pivot. Two
members a, b of a pivot differ by |da| + |db| - 2 |da & db|; two members linked to the pivot are one component
already, and any other pair can link only with an overlap of differences that grows with their
sizes. So those pairs are found by a prefix filter on the differences, rarest elements first, screened by their odd sketches
(bit i: whether an odd number of elements falls on i; the sketches of a and b differ in at most as many bits as the sets differ in elements), and
verified exactly from them: a group of near copies, linked or just short of it, costs about as many
checks as members, not pairs. A member less than half like its pivot, and more than two links away from it, met it by chance; it cannot link
with a member that is linked to the pivot (Jaccard distance is a metric), and is checked against the
others that meet it, where sizes and the distance of 64 shingle counts, a lower bound of the sets'
distance, leave a link possible. No partner that can link is dropped.

Defined results: null, empty or wordless text has an empty set and links with nothing; rows
that share a doc_id are one node; a null doc_id is in no group (component null); fewer words than
a shingle make one shingle of the whole; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.llm.arrow import GOLD, MIX1, WordHashes, hash_runs, list_array, mixed, packed_text, small_batches, unpacked_text
from linewise.llm.graph import components
from linewise.llm.joins import near_side
from linewise.session import released, stored

PIVOT_ROWS = 5_000        # partners of one pivot in one group of rows
CALL_ROWS = 1_000         # pairs of one document in one row
BLOCK_ROWS = 2_000        # members of one signature in one block


@dataclass(frozen=True)
class JoinRule:
    """Link when 100 * intersection >= percent * union of sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80


@dataclass(frozen=True)
class Allocation:
    """Signatures of one size band: segments, those with deletions, and how many exact ones a set leaves out."""

    low: int
    high: int
    differences: int
    segments: int
    deletions: int
    skipped: int


def shingles(text: bytes | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    length = min(words, len(tokens))
    return np.unique(hash_runs(known.of(tokens), length, seed=length))


@cache
def bands(percent: int, largest: int) -> list[tuple[int, int]]:
    """Size bands whose ends are in the ratio of the threshold."""
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return out


def most_differences(low: int, high: int, percent: int) -> int:
    """Largest symmetric difference of two linked sets, the smaller of which is in the band."""
    totals = np.arange(2 * low, high + high * 100 // percent + 1)
    least_common = -(-percent * totals // (100 + percent))
    return int((totals - 2 * least_common).max())


def allocate(low: int, high: int, percent: int, population: int) -> Allocation:
    """The cheapest valid allocation for ``population`` sets of the band."""
    differences, size = most_differences(low, high, percent), (low + high) / 2
    best, least = None, math.inf
    # long sets have hundreds of empty segments, so what may be left out is tried in proportion too
    for skipped in sorted({0, 1, 2, 3, *(math.ceil(differences * part / 200) for part in (1, 2, 4, 6, 8, 10, 14, 20, 30))}):
        for deletions in {0, skipped, 2 * skipped}:
            segments = differences + 1 + 2 * skipped - deletions
            if deletions + skipped > segments:
                continue
            signatures = segments - deletions - skipped + deletions * (1 + size / segments)
            # segments of the smallest sets left with no shingle after the poorest are skipped meet by chance
            empty = math.exp(-low / segments)
            spread = math.sqrt(segments * empty * (1 - empty))
            over = (skipped - segments * empty) / spread
            spare = spread * (math.exp(-over * over / 2) / math.sqrt(2 * math.pi) - over * math.erfc(over / math.sqrt(2)) / 2)
            cost = signatures + population / 2 * spare * spare / segments
            if cost < least:
                best, least = Allocation(low, high, differences, segments, deletions, skipped), cost
    return best


def signatures(hashes: np.ndarray, plan: Allocation) -> np.ndarray:
    """Signatures of a sorted set under an allocation."""
    count = plan.segments
    cuts = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(count) >> np.uint64(32), np.arange(count + 1, dtype=np.uint64))
    parts = mixed(hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    total, size = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)
    salt = mixed(np.arange(count, dtype=np.uint64) + np.array([plan.low], np.uint64) * GOLD)
    code = lambda summed, n, at: mixed(summed + n.astype(np.uint64) * MIX1 ^ salt[at])
    exact = np.arange(plan.deletions, count)
    if plan.skipped:
        exact = exact[np.argsort(size[plan.deletions:], kind="stable")[plan.skipped:]]
    out = [code(total[exact], size[exact], exact)]
    if plan.deletions:
        whole = np.arange(plan.deletions)
        inside = np.repeat(whole, size[:plan.deletions])
        out += [code(total[whole], size[whole], whole), code(total[inside] - parts[:len(inside)], size[inside] - 1, inside)]
    return np.unique(np.concatenate(out))


def odd_sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """One and a half bits for each of ``size`` elements: bit i is whether an odd number of ``hashes`` falls on it."""
    bits = 64 * -(-size * 3 // 128)
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sizes(docs: DataFrame, rule: JoinRule) -> DataFrame:
    """doc_id, n_shingles, set_1, set_2 (128 bits that name the set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in small_batches(batches):
            sets = [shingles(text, rule.words, known) for text in batch.column("text").cast(pa.binary()).to_pylist()]
            names = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1])],
                names=["doc_id", "n_shingles", "set_1", "set_2"],
            )
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_1 long, set_2 long")


def _postings(docs: DataFrame, rule: JoinRule, limits: list[tuple[int, int]], plans: dict[int, Allocation]) -> DataFrame:
    """signature, doc_id, own (indexed in its own band; else it probes the band below)."""
    lows = np.array([low for low, _ in limits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in small_batches(batches):
            ids, codes, owns, counts = batch.column("doc_id"), [], [], []
            rows = []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                hashes = shingles(text, rule.words, known)
                if not len(hashes):
                    continue
                band = int(np.searchsorted(lows, len(hashes), "right")) - 1
                for at in (band, band - 1):
                    plan = plans.get(at)
                    if plan is None or len(hashes) * rule.percent > plan.high * 100:
                        continue
                    codes.append(signatures(hashes, plan))
                    rows.append(row)
                    owns.append(at == band)
                    counts.append(len(codes[-1]))
            flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat.view(np.int64)), ids.take(pa.array(np.repeat(np.array(rows, np.int64), counts))),
                 pa.array(np.repeat(np.array(owns, bool), counts))],
                names=["signature", "doc_id", "own"],
            )
    return docs.select("doc_id", "text").mapInArrow(run, "signature long, doc_id long, own boolean")


def _parted(pairs: DataFrame, key: str, other: str, rows: int) -> DataFrame:
    """Add part: the pairs of each ``key`` dealt into groups of about ``rows``."""
    groups = pairs.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("groups"))
    return pairs.join(groups, key).withColumn("part", F.pmod(F.xxhash64(other), F.col("groups")).cast("int")).drop("groups")


def _differences(docs: DataFrame, pairs: DataFrame, rule: JoinRule) -> DataFrame:
    """pivot, base, id, own, size, delta, linked, far, counts, sketch for pairs (pivot, other): each set minus the other.

    far pairs (less than half alike, and at a distance above twice that of a link) have no delta and no sketch of it; members that are not linked have 64 shingle counts, four to a number.

    base and own name the two sets, for ids with several texts. Each text travels once per pair, packed: its set would take
    about three times the bytes; a pivot with many partners is split. What is given back reads tables stored here.
    """
    salted = stored(_parted(pairs, "pivot", "other", PIVOT_ROWS))
    calls = salted.select(F.col("other").alias("id"), "pivot", "part", F.lit(False).alias("leads")).union(
        salted.select(F.col("pivot").alias("id"), "pivot", "part", F.lit(True)).distinct()
    )
    dealt = _parted(calls.withColumnRenamed("part", "group"), "id", "pivot", CALL_ROWS)
    call = F.struct("pivot", F.col("group").alias("part"), "leads")
    wanted = stored(dealt.groupBy("id", "part").agg(F.collect_list(call).alias("calls")).drop("part"))
    asked = docs.join(near_side(wanted, salted), docs["doc_id"] == wanted["id"]).select("id", "text", "calls")

    kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
    apart = max(50, 2 * (100 - rule.percent))  # least Jaccard distance of far sets: none can link with a set linked to the pivot

    def made(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["pivot", "part", "follows", "id", "data"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            out, held = [[], [], [], [], []], 0
            for id_, text, calls_ in zip(
                batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("calls").to_pylist(), strict=True
            ):
                data = packed_text(text)
                for call in calls_:
                    for column, value in zip(out, (call["pivot"], call["part"], not call["leads"], id_, data), strict=True):
                        column.append(value)
                    held += len(data)
                    if held > 4_000_000:
                        yield made(out)
                        out, held = [[], [], [], [], []], 0
            yield made(out)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leads, known = None, [], WordHashes()  # the sets of the pivot's rows come first in the group
        name = lambda data: int(np.frombuffer(xxhash.xxh3_64_digest(data), np.int64)[0])
        kinds, none = (*[pa.int64()] * 4, pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), *[pa.list_(pa.int64())] * 2), np.zeros(0, np.int64)
        for batch in small_batches(batches):
            out = []
            for pivot, part, follows, id_, data in zip(*[batch.column(n).to_pylist() for n in ("pivot", "part", "follows", "id", "data")], strict=True):
                hashes = shingles(unpacked_text(data), rule.words, known)
                if (pivot, part) != group:
                    group, leads = (pivot, part), []
                own = name(hashes.tobytes())
                if not follows:
                    leads.append((own, hashes))
                    continue
                for base, lead in leads:
                    delta = np.setxor1d(lead, hashes, assume_unique=True)
                    common = (len(lead) + len(hashes) - len(delta)) // 2
                    linked = 100 * common >= rule.percent * (len(lead) + len(hashes) - common)
                    far = not linked and 100 * len(delta) > apart * (len(lead) + len(hashes) - common)
                    counts = none if linked else np.minimum(np.bincount((hashes % np.uint64(64)).astype(np.int64), minlength=64), 32_767).astype("<i2").view(np.int64)
                    kept, sketch = (none, none) if far else (delta.view(np.int64), odd_sketch(delta, len(lead)))
                    out.append((pivot, base, id_, own, len(hashes), kept, linked, far, counts, sketch))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            arrays = [list_array(list(c), pa.int64()) if k == kinds[5] else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["pivot", "base", "id", "own", "size", "delta", "linked", "far", "counts", "sketch"])

    sent = asked.mapInArrow(texts, "pivot long, part int, follows boolean, id long, data binary")
    grouped = sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "follows")
    return grouped.mapInArrow(
        check, "pivot long, base long, id long, own long, size int, delta array<long>, linked boolean, far boolean, counts array<long>, sketch array<long>"
    )


def _members_that_meet(deltas: DataFrame, labels: DataFrame, rule: JoinRule) -> tuple[DataFrame, DataFrame]:
    """Members of pivots, and pairs (a, b) of members of one pivot that may link: of different components, at least one not linked to the pivot.

    With c = (100 - percent) / (100 + percent), a and b link only if 2 |da & db| >= r(a) + r(b), r(x) = |dx| - c |x|.
    The sum is above 0 for such pairs. Each member's least overlap t follows from the least r it can meet, and two
    members with that overlap share one of their |d| - t + 1 rarest elements. Of pairs that share one, those whose
    sketches differ in more bits than linked sets can differ in elements are no rows: members that have passages in common, but
    do not link, meet often.
    """
    plus, minus = 100 + rule.percent, 100 - rule.percent
    group = ["pivot", "base"]
    named = deltas.where("not far").join(labels, deltas["id"] == labels["node"], "left").select(
        *group, "id", "own", "size", "delta", "linked", "sketch", F.coalesce("component", "id").alias("component"),
        (plus * F.size("delta") - minus * F.col("size")).cast("long").alias("r"),
    )
    bounds = named.groupBy(*group).agg(F.min("r").alias("any"), F.min(F.when(~F.col("linked"), F.col("r"))).alias("open"), F.min("component").alias("low"), F.max("component").alias("high"))
    bounds = bounds.where("open is not null and low != high")  # a group inside one component has no pair left to find
    least = F.greatest(F.lit(1), F.ceil((F.col("r") + F.when(F.col("linked"), F.col("open")).otherwise(F.col("any"))) / (2 * plus)))
    members = stored(
        named.join(bounds, group).withColumn("prefix", (F.size("delta") - least + 1).cast("int")).where("prefix > 0").drop("any", "open", "low", "high")
    )
    # one row for each member and element, never for a pair; one exchange, counted in place, instead of a count and a join back
    elements = members.select(*group, "id", "own", "prefix", F.explode("delta").alias("e"))
    often = elements.withColumn("n", F.count("*").over(Window.partitionBy(*group, "e"))).where("n > 1")
    # elements of one member only are the rarest and meet nobody: they use up the prefix first
    ranked = often.groupBy(*group, "id", "own", "prefix").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("held"))
    light = members.select(*group, "id", "own", "size", "component", "linked", "sketch", "r", F.size("delta").alias("whole"))
    ranked = ranked.join(light, [*group, "id", "own"])
    ranked = ranked.withColumn("keep", F.col("prefix") - (F.col("whole") - F.size("held"))).where("keep > 0")
    own = ("id", "own", "size", "component", "linked", "sketch", "r")
    placed = ranked.select(*group, *own, F.size("held").alias("many"), F.posexplode(F.slice("held", F.lit(1), F.col("keep"))).alias("at", "h"))
    prefixes = stored(placed.withColumn("e", F.col("h.e")).withColumn("rest", F.col("many") - F.col("at")).drop("h", "at", "many"))

    def side(letter: str) -> DataFrame:
        return prefixes.select(*group, "e", *[F.col(c).alias(f"{c}_{letter}") for c in (*own, "rest")])

    # from the first element they share on, neither has more than its rest left to share
    enough = 2 * plus * F.least("rest_a", "rest_b") >= F.col("r_a") + F.col("r_b")
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, bits: n + bits)
    near = plus * apart <= minus * (F.col("size_a") + F.col("size_b"))
    key = lambda letter: F.struct(f"id_{letter}", f"own_{letter}")
    met = side("a").where("not linked_a").join(side("b"), [*group, "e"]).where(
        (F.col("component_a") != F.col("component_b")) & (F.col("linked_b") | (key("a") < key("b"))) & enough & near
    ).select(*group, "id_a", "own_a", "id_b", "own_b").distinct()
    return members, met


def _links_between_members(deltas: DataFrame, labels: DataFrame, rule: JoinRule) -> DataFrame:
    """Links (a, b) among the pairs of members that meet, verified from their differences from the pivot."""
    group = ["pivot", "base"]
    members, met = _members_that_meet(deltas, labels, rule)

    def full(letter: str) -> DataFrame:
        return members.select(*group, *[F.col(c).alias(f"{c}_{letter}") for c in ("id", "own", "size", "delta")])

    pairs = met.join(full("a"), [*group, "id_a", "own_a"]).join(full("b"), [*group, "id_b", "own_b"])
    total, overlap = F.col("size_a") + F.col("size_b"), F.size(F.array_intersect("delta_a", "delta_b"))
    differ = F.size("delta_a") + F.size("delta_b") - 2 * overlap
    # 100 * common >= percent * union with common = (total - differ) / 2 and union = (total + differ) / 2
    return pairs.where(100 * (total - differ) >= rule.percent * (total + differ)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _screened(rows: list[dict], first: int, second: int, rule: JoinRule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, one of block ``first`` and one of ``second``, that may link."""
    ids, sizes, components, blocks = (np.array([r[name] for r in rows], np.int64) for name in ("id", "size", "component", "block"))
    own, far = np.array([r["own"] for r in rows]), np.array([r["far"] for r in rows])
    counts = np.array([r["counts"] for r in rows], "<i8").view("<i2").astype(np.int32)
    right = np.flatnonzero(blocks == second)
    lows, highs = [], []
    for at in np.flatnonzero((blocks == first)).tolist():
        may = right[(components[right] != components[at]) & (own[right] | own[at]) & (far[right] | far[at])]
        if first == second:
            may = may[may > at]
        may = may[100 * np.minimum(sizes[may], sizes[at]) >= rule.percent * np.maximum(sizes[may], sizes[at])]
        apart = np.abs(counts[may] - counts[at]).sum(1)
        may = may[(100 + rule.percent) * apart <= (100 - rule.percent) * (sizes[may] + sizes[at])]
        lows.append(np.minimum(ids[may], ids[at]))
        highs.append(np.maximum(ids[may], ids[at]))
    none = np.zeros(0, np.int64)
    return np.concatenate([*lows, none]), np.concatenate([*highs, none])


def _pairs_of_far_members(met: DataFrame, pivots: DataFrame, deltas: DataFrame, labels: DataFrame, rule: JoinRule) -> DataFrame:
    """Pairs (pivot, other) that share a signature and can link, both not linked to its pivot, at least one far from it.

    The members of a signature are dealt into blocks of about BLOCK_ROWS, and a task holds two blocks at a time.
    """
    open_ = deltas.where("not linked").groupBy("pivot", "id", "own").agg(F.max("far").alias("far"), F.first("size").alias("size"), F.first("counts").alias("counts")).drop("own")
    members = met.select("signature", "id", "own").join(pivots.select("signature", F.col("p.id").alias("pivot")), "signature").join(open_, ["pivot", "id"])
    members = members.join(labels, members["id"] == labels["node"], "left").select(
        "signature", "id", "own", "far", "size", "counts", F.coalesce("component", "id").alias("component")
    )
    some = members.groupBy("signature").agg(F.max("far").alias("any"), F.count("*").alias("n")).where("any and n > 1")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    members = stored(members.join(some.select("signature", blocks.alias("blocks")), "signature").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    dealt = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "signature", F.least("block", "with").alias("first"), F.greatest("block", "with").alias("second"), "id", "own", "far", "size", "counts", "component", "block"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def close() -> pa.RecordBatch:
            low, high = _screened(held, group[1], group[2], rule) if len(held) > 1 else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["low", "high"])

        for batch in small_batches(batches, 1024):
            for row in batch.to_pylist():
                if (row["signature"], row["first"], row["second"]) != group:
                    if group:
                        yield close()
                    group, held = (row["signature"], row["first"], row["second"]), []
                held.append(row)
        if group:
            yield close()

    # few bytes, but much to compare: a number of its own keeps the partitions from being merged
    partitions = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["signature", "first", "second"]
    pairs = dealt.repartition(partitions, *key).sortWithinPartitions(*key).mapInArrow(run, "low long, high long").where("low != high").distinct()
    done = deltas.select(F.least("pivot", "id").alias("low"), F.greatest("pivot", "id").alias("high")).distinct()
    return pairs.join(done, ["low", "high"], "left_anti").select(F.col("low").alias("pivot"), F.col("high").alias("other"))


def one_of_each_group(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """``docs`` without the documents whose group has a smaller doc_id; ungrouped documents stay."""
    groups = similar_groups(docs.select("doc_id", "text"), rule)
    gone = stored(groups.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(near_side(gone, gone), docs["doc_id"] == F.col("__gone"), "left_anti")


def similar_groups(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; component_id is the smallest doc_id reachable."""
    sizes = stored(_sizes(docs, rule))
    filled = sizes.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("set_1", "set_2").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies")))
    copies = stored(
        filled.join(classes.where("copies > 1"), ["set_1", "set_2"]).where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    )

    largest = sizes.agg(F.max("n_shingles")).first()[0] or 0
    limits = bands(rule.percent, largest)
    lows = F.array(*[F.lit(low) for low, _ in limits]) if limits else F.array(F.lit(1))
    band = F.size(F.filter(lows, lambda low: low <= F.col("n_shingles"))) - 1
    population = {row["band"]: row["count"] for row in filled.groupBy(band.alias("band")).count().collect()}  # one row a band
    plans = {
        at: allocate(low, high, rule.percent, population.get(at, 0) + population.get(at + 1, 0))
        for at, (low, high) in enumerate(limits)
        if population.get(at) and most_differences(low, high, rule.percent)
    }

    # equal sets are one class and only its lead has postings; an id with several texts keeps them all
    plain = filled.groupBy("doc_id").agg(F.countDistinct("set_1", "set_2").alias("sets")).where("sets = 1")
    twins = stored(copies.join(plain, copies["b"] == plain["doc_id"]).groupBy("doc_id").agg(F.min("a").alias("lead")))
    led = near_side(twins, twins)
    leads = docs.select("doc_id", "text").where("doc_id is not null").join(led, "doc_id", "left_anti")

    # signatures that two leads share
    # (a signature holds at most one posting a document, and a document has hundreds, so none can hold more than a small
    # part of all postings; one exchange, counted in place, costs half of a count and a join back)
    whole = Window.partitionBy("signature")
    postings = _postings(leads, rule, limits, plans)
    met = postings.withColumn("n", F.count("*").over(whole)).withColumn("owned", F.max("own").over(whole)).where("n > 1 and owned").drop("n", "owned")
    shared = stored(met.select("signature", F.col("doc_id").alias("id"), "own").distinct())
    crowd = shared.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    crowded = stored(shared.join(crowd, "signature"))
    released(shared)
    central = crowded.groupBy("id").agg(F.sum("n").alias("company"))
    met = stored(crowded.join(central, "id").select("signature", "id", "own", "company"))
    released(crowded)

    pivots = met.where("own").groupBy("signature").agg(F.max(F.struct("company", "id")).alias("p"))
    first = met.join(pivots, "signature").select(F.col("p.id").alias("pivot"), F.col("id").alias("other"))
    pairs = stored(first.where("pivot != other").distinct())
    deltas = stored(_differences(docs, pairs, rule))
    several = copies.join(twins, copies["b"] == twins["doc_id"], "left_anti")  # copies among the texts of one id; the others follow their lead
    links = several.union(deltas.where("linked").select("pivot", "id"))
    labels = components(links)
    far = stored(_pairs_of_far_members(met, pivots, deltas, labels, rule))
    more = _links_between_members(deltas, labels, rule).union(_differences(docs, far, rule).where("linked").select("pivot", "id"))
    more = stored(more)
    if not more.isEmpty():
        labels = components(links.union(more))
    released(met, pairs, deltas, far, more)
    follows = sizes.join(led.withColumnRenamed("doc_id", "led"), F.col("doc_id") == F.col("led"), "left").withColumn("stands_for", F.coalesce("lead", "doc_id"))
    return follows.join(labels, F.col("stands_for") == labels["node"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "stands_for").alias("component_id")
    )
