"""Exact cosine links by a dual traversal of cover trees.

Unit vectors are compared by Euclidean distance (cosine c is distance sqrt(2 - 2c)). A cover tree has nested levels of centres: a
node's children are centres within it at the next halved radius, the node's own point among them; every node knows its
true covering radius, the greatest distance from its point to a point below it.

1. Equal vectors become one site with a number of copies. Sites are dealt to blocks of bounded bytes: a bounded sample
   (``SAMPLE`` sites of least hash, at most ``BLOCK_BYTES``) gives up to ``CELLS`` upper centres, every site goes to its nearest, and
   cells next to each other share or fill blocks. The sample decides only who shares a block, never what links.
2. A task builds the tree of one block and traverses it against itself. Two blocks meet in a task only if their roots are
   not farther apart than the threshold plus both radii.
3. A pair of nodes is left when its centres are farther apart than the threshold plus both radii, and taken whole when their
   distance plus both radii is within it: then every point of one links to every point of the other, which is
   counted by size without listing pairs. Else the children meet, many at once by a matrix product. Points are
   decided by their cosine in double precision alone.
4. Counts are summed by site. Components join the blocks' own components, so the graph has at most one node a component and block.

Covering radii prune what has low intrinsic dimension. Random directions in 64 dimensions all lie about sqrt(2) apart, no level
between "all" and "each alone" exists there, and the traversal compares all of them by matrix products: n * n / 2 products.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; so do vectors of
different lengths; rows that repeat a vec_id are rows of their own; a component is named by its smallest vec_id that is not null; no rows
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.arrow import small_batches
from linewise.llm.graph import components
from linewise.operators.joining import lookup_join
from linewise.session import stored

SAMPLE, CELLS = 4096, 256
BLOCK_BYTES = 8 << 20  # of one block's vectors in double precision
LEAST_BLOCK = 256
TASKS_PER_CORE = 4
SAFE = 1e-6  # more than rounding can move a distance between unit vectors
TILE = 2_000_000  # products made at once
CHUNK = 1024  # blocks whose roots meet others in one join key
TREE = "ids binary, copies binary, vectors binary, point binary, radius binary, low binary, high binary, first binary, label binary"


@dataclass
class Tree:
    """Nodes in arrays; node 0 is the root. A node covers places low..high; its children are first[k]..first[k + 1]."""

    ids: np.ndarray
    copies: np.ndarray
    unit: np.ndarray
    point: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    label: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(self.copies)])
        return before[self.high] - before[self.low]

    def is_leaf(self) -> np.ndarray:
        return self.first[1:] == self.first[:-1]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))


def distances(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def cover(unit: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """For each row the number of the first centre within ``radius``; rows become centres in order. -1 beyond ``most`` centres."""
    within = 1.0 - radius * radius / 2.0
    label = np.full(len(unit), -1, np.int64)
    open_rows, made = np.arange(len(unit)), 0
    while len(open_rows) and (most is None or made < most):
        batch = open_rows[:256]
        near = unit[batch] @ unit[open_rows].T >= within
        free = np.ones(len(open_rows), bool)
        for k in range(len(batch)):
            if free[k] and (most is None or made < most):
                mine = near[k] & free
                mine[k] = True
                label[open_rows[mine]] = made
                free &= ~mine
                made += 1
        open_rows = open_rows[free]
    return label


def build_tree(ids: np.ndarray, copies: np.ndarray, unit: np.ndarray, least_radius: float) -> Tree:
    order = np.arange(len(ids))  # place -> row; a node's rows stay together
    low, high, radius, first = [0], [len(ids)], [], []
    at = 0
    while at < len(low):
        start, end = low[at], high[at]
        first.append(len(low))
        rows = order[start:end]
        reach = float(distances(unit[rows] @ unit[rows[0]]).max()) if end - start > 1 else 0.0
        radius.append(reach)
        if end - start > 1:
            # the greatest halving of 2 below the true radius, so the node's own point cannot cover all
            level = 2.0 ** (math.ceil(math.log2(reach)) - 1) if reach > least_radius else 0.0
            label = cover(unit[rows], level) if level else np.arange(len(rows))
            by_child = np.argsort(label, kind="stable")
            order[start:end] = rows[by_child]
            cuts = np.flatnonzero(np.diff(label[by_child])) + 1
            low += [start, *(start + cuts).tolist()]
            high += [*(start + cuts).tolist(), end]
        at += 1
    first.append(len(low))
    low_at = np.array(low)
    return Tree(ids[order], copies[order], unit[order], low_at, np.array(radius), low_at, np.array(high), np.array(first), ids[order].copy())


class Links:
    """What a traversal of two trees finds: a number of links per place, and pairs of places in one component."""

    def __init__(self, a: Tree, b: Tree, cosine: float) -> None:
        self.a, self.b, self.cosine = a, b, cosine
        self.threshold = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
        self.same = a is b
        self.leaf_a, self.leaf_b = a.is_leaf(), b.is_leaf()
        self.weight_a, self.weight_b = a.weight, b.weight
        self.gain_a = np.zeros(len(a.ids) + 1, np.int64)
        self.gain_b = self.gain_a if self.same else np.zeros(len(b.ids) + 1, np.int64)
        self.own = np.zeros(len(a.ids) + 1, np.int64)
        self.whole_a = np.zeros(len(a.low), bool)
        self.whole_b = self.whole_a if self.same else np.zeros(len(b.low), bool)
        self.shift = 0 if self.same else len(a.ids)  # places of b count on after those of a
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self._run()

    def _run(self) -> None:
        root = np.zeros(1, np.int64)
        todo = [self._judge(root, root, np.einsum("ij,ij->i", self.a.unit[:1], self.b.unit[:1]))]
        while todo:
            u, v = todo.pop()
            wide = self._sizes(u, v)
            small = wide <= 4096
            if small.any():
                for piece in self._pieces(u[small], v[small], wide[small]):
                    todo += self._kept(self._judge(*piece))
            for x, y in zip(u[~small].tolist(), v[~small].tolist()):
                for piece in self._product(x, y):
                    todo += self._kept(self._judge(*piece))

    @staticmethod
    def _kept(pair: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [pair] if len(pair[0]) else []

    def _sizes(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.maximum(1, np.diff(self.a.first)[u]) * np.maximum(1, np.diff(self.b.first)[v])

    def _judge(self, u: np.ndarray, v: np.ndarray, dots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take, leave or return node pairs for a closer look."""
        away, reach = distances(dots), self.a.radius[u] + self.b.radius[v]
        points = self.leaf_a[u] & self.leaf_b[v]
        itself = (u == v) if self.same else np.zeros(len(u), bool)
        taken = np.where(points, (dots >= self.cosine) & ~itself, away + reach <= self.threshold - SAFE)
        self._take(u[taken], v[taken], itself[taken])
        closer = ~points & ~taken & (away <= self.threshold + reach + SAFE)
        return u[closer], v[closer]

    def _take(self, u: np.ndarray, v: np.ndarray, itself: np.ndarray) -> None:
        a, b = self.a, self.b
        for node, gain, tree in ((u, self.weight_b[v], a), (v[~itself], self.weight_a[u[~itself]], b)):
            into = self.gain_a if tree is a else self.gain_b
            np.add.at(into, tree.low[node], gain)
            np.subtract.at(into, tree.high[node], gain)
        np.add.at(self.own, a.low[u[itself]], 1)
        np.subtract.at(self.own, a.high[u[itself]], 1)
        self.whole_a[u], self.whole_b[v] = True, True
        self.pairs.append((a.low[u], b.low[v] + self.shift))
        self.held += len(u)
        if self.held > TILE:  # as many ties as places say the same
            label = least_labels(self.shift + len(b.ids), *map(np.concatenate, zip(*self.pairs)))
            moved = np.flatnonzero(label != np.arange(len(label)))
            self.pairs, self.held = [(moved, label[moved])], 0

    def _children(self, tree: Tree, node: int) -> np.ndarray:
        start, end = tree.first[node], tree.first[node + 1]
        return np.arange(start, end) if end > start else np.array([node])

    def _pieces(self, u: np.ndarray, v: np.ndarray, wide: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Children pairs of many small node pairs."""
        a, b = self.a, self.b
        group = np.cumsum(wide) // (TILE // 8 // a.unit.shape[1] + 4096)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(u)]
        for start, end in zip(cuts, cuts[1:]):
            x, y, n = u[start:end], v[start:end], wide[start:end]
            which = np.repeat(np.arange(len(x)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            across = np.maximum(1, np.diff(b.first)[y])[which]
            left = np.where(self.leaf_a[x], x, a.first[x])[which] + offset // across
            right = np.where(self.leaf_b[y], y, b.first[y])[which] + offset % across
            if self.same:  # the two sides of a pair of a node with itself are equal
                once = (x != y)[which] | (left <= right)
                left, right = left[once], right[once]
            yield left, right, np.einsum("ij,ij->i", a.unit[a.point[left]], b.unit[b.point[right]])

    def _product(self, x: int, y: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Children pairs of one wide node pair that their radii don't rule out, by matrix products."""
        a, b = self.a, self.b
        left, right = self._children(a, x), self._children(b, y)
        for lefts in (left[self.leaf_a[left]], left[~self.leaf_a[left]]):
            for rights in (right[self.leaf_b[right]], right[~self.leaf_b[right]]):
                if not len(lefts) or not len(rights):
                    continue
                reach = self.threshold + a.radius[lefts].max() + b.radius[rights].max() + SAFE
                least = 1.0 - reach * reach / 2.0 if reach < 2.0 else -math.inf
                step = max(1, TILE // len(rights))
                table = b.unit[b.point[rights]].T
                for start in range(0, len(lefts), step):
                    rows = lefts[start:start + step]
                    dots = a.unit[a.point[rows]] @ table
                    i, j = np.nonzero(dots >= least)
                    if self.same and x == y:
                        once = rows[i] <= rights[j]
                        i, j = i[once], j[once]
                    for part in range(0, len(i), TILE):
                        p, q = i[part:part + TILE], j[part:part + TILE]
                        yield rows[p], rights[q], dots[p, q]

    def gains(self) -> tuple[np.ndarray, np.ndarray]:
        """Links per place of either tree, copies of the other side counted, a site's own copies not."""
        first = np.cumsum(self.gain_a)[:-1] - np.cumsum(self.own)[:-1] * self.a.copies
        return first, first if self.same else np.cumsum(self.gain_b)[:-1]

    def joined_places(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places that tie all linked places together; places of b count on after those of a."""
        left = [p for p, _ in self.pairs]
        right = [q for _, q in self.pairs]
        for tree, whole, plus in ((self.a, self.whole_a, 0), (self.b, self.whole_b, self.shift)):
            for node in np.flatnonzero(whole & (tree.high - tree.low > 1)):
                places = np.arange(tree.low[node], tree.high[node]) + plus
                left.append(np.full(len(places), places[0]))
                right.append(places)
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def least_labels(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        for side in (left, right):
            np.minimum.at(fresh, side, low)
            np.minimum.at(fresh, label[side], low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def _packed(tree: Tree, vectors: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in (tree.ids, tree.copies, vectors, tree.point, tree.radius, tree.low, tree.high, tree.first, tree.label)]


def _unpacked(row: dict, kind: str) -> Tree:
    ints = {name: np.frombuffer(row[name], np.int64) for name in ("ids", "copies", "point", "low", "high", "first", "label")}
    unit = unit_rows(np.frombuffer(row["vectors"], kind).reshape(len(ints["ids"]), -1))
    return Tree(unit=unit, radius=np.frombuffer(row["radius"], np.float64), **ints)


def _read_rows(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, site (hash of the values, null for vectors that link with nothing), dims, values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            sites: list[bytes | None] = []
            sizes: list[int | None] = []
            values: list[bytes | None] = []
            for item in batch["embedding"]:
                row = np.asarray(item.values.to_numpy(zero_copy_only=False), np.float64) if item.is_valid else np.zeros(0)
                good = len(row) > 0 and item.values.null_count == 0 and bool(np.isfinite(row).all()) and bool(row.any())
                row = row.astype(kind) + np.zeros(1, kind)  # -0.0 becomes 0.0
                values.append(row.tobytes() if good else None)
                sites.append(xxhash.xxh3_128_digest(values[-1]) if good else None)
                sizes.append(len(row) if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(sites, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())],
                ["vec_id", "site", "dims", "vector"],
            )

    return run


def upper_centres(unit: np.ndarray, most: int = CELLS) -> np.ndarray:
    """Rows that are the centres of the deepest level with at most ``most``; of the first level where even that has more, the first."""
    best = np.zeros(1, np.int64)
    radius = 1.0
    while radius > 0.05:
        label = cover(unit, radius, most)
        _, best = np.unique(label[label >= 0], return_index=True)
        if (label < 0).any():
            break
        radius /= 2
    return best


def _nearest_cell(centres: dict[int, np.ndarray], kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1024):
            dims = np.asarray(batch["dims"])
            cell = np.full(batch.num_rows, -1, np.int64)
            vectors = batch["vector"].to_pylist()
            for size in np.unique(dims):
                rows = np.flatnonzero(dims == size)
                if int(size) in centres:
                    unit = unit_rows(np.stack([np.frombuffer(vectors[k], kind) for k in rows]))
                    cell[rows] = np.argmax(unit @ centres[int(size)].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _blocks(sites: DataFrame, kind: str, block_rows: int | None) -> DataFrame:
    """sites with dims and block: bounded, and near ones together where there is a near."""
    spark = sites.sparkSession
    count, dims = sites.agg(F.count("*"), F.max("dims")).first()
    if not count:
        return sites.withColumn("block", F.lit(0).cast("long"))
    rows = sites.orderBy("site").limit(max(1, min(SAMPLE, BLOCK_BYTES // (8 * dims)))).select("dims", "vector").collect()
    centres = {}
    for size in {row["dims"] for row in rows}:
        unit = unit_rows(np.stack([np.frombuffer(row["vector"], kind) for row in rows if row["dims"] == size]))
        centres[size] = unit[upper_centres(unit)]
    tiles = math.ceil(math.sqrt(2 * TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    most = max(1, BLOCK_BYTES // (8 * dims))
    width = block_rows or min(most, max(LEAST_BLOCK, math.ceil(count / tiles)))
    celled = stored(sites.mapInArrow(
        _nearest_cell(centres, kind), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sites.schema) + ", cell long"
    ))
    before = Window.partitionBy("dims").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS + 1 rows
    cells = celled.groupBy("dims", "cell").agg(F.count("*").alias("_size")).withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    place = F.col("_start") + F.pmod(F.xxhash64("site"), F.col("_size"))
    return lookup_join(celled, cells, ["dims", "cell"]).withColumn("block", F.floor(place / width)).drop("cell", "_size", "_start")


def _build(cosine: float, kind: str) -> Callable[[pa.Table], pa.Table]:
    least_radius = math.sqrt(max(1e-6, 2.0 - 2.0 * cosine)) / 16

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        raw = np.stack([np.frombuffer(v, kind) for v in rows["vector"].to_pylist()])
        ids = rows["id"].to_numpy()
        tree = build_tree(ids, rows["copies"].to_numpy(), unit_rows(raw), least_radius)
        raw = raw[np.searchsorted(ids, tree.ids)]
        found = Links(tree, tree, cosine)
        tree.label = tree.ids[least_labels(len(ids), *found.joined_places())]
        links, _ = found.gains()
        row = {
            "dims": [rows["dims"][0].as_py()], "block": [rows["block"][0].as_py()], "centre": [tree.unit[0].tolist()], "reach": [float(tree.radius[0])],
            "points": [[{"id": int(i), "label": int(c), "links": int(n)} for i, c, n in zip(tree.ids, tree.label, links)]],
        }
        row |= {name.split()[0]: [data] for name, data in zip(TREE.split(", "), _packed(tree, raw))}
        return pa.table(row, BLOCK_ARROW)

    return run


BLOCK_SCHEMA = f"dims int, block long, centre array<double>, reach double, points array<struct<id:long,label:long,links:long>>, {TREE}"
BLOCK_ARROW = pa.schema([
    ("dims", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("reach", pa.float64()),
    ("points", pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int64()), ("links", pa.int64())]))),
    *[(name.split()[0], pa.binary()) for name in TREE.split(", ")],
])


def _meet(cosine: float, kind: str) -> Callable[[pa.Table], pa.Table]:
    """Links between two blocks: rows (a, null, n) count n links of site a; rows (a, b, 0) join two labels."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block").to_pylist()
        a, b = (_unpacked(row, kind) for row in rows)
        found = Links(a, b, cosine)
        ids, labels = np.concatenate([a.ids, b.ids]), np.concatenate([a.label, b.label])
        gains = np.concatenate(found.gains())
        linked = np.flatnonzero(gains)
        left, right = found.joined_places()
        ties = np.unique(np.stack([labels[left], labels[right]], axis=1), axis=0)
        ties = ties[ties[:, 0] != ties[:, 1]]
        return pa.table({
            "a": pa.array(np.concatenate([ids[linked], ties[:, 0]]), pa.int64()),
            "b": pa.array([None] * len(linked) + ties[:, 1].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([gains[linked], np.zeros(len(ties), np.int64)]), pa.int64()),
        })

    return run


def _block_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """dims, i, j: blocks whose roots are near enough. Roots meet by chunks of ``CHUNK`` blocks, not in one cross join."""
    roots = blocks.select("dims", "block", "centre", "reach", F.floor(F.col("block") / CHUNK).alias("chunk"))
    chunks = roots.groupBy("dims").agg(F.max("chunk").alias("last"))
    left = roots.join(F.broadcast(chunks), "dims").withColumn("chunk", F.explode(F.sequence("chunk", "last"))).select(
        "dims", "chunk", F.col("block").alias("i"), F.col("centre").alias("ci"), F.col("reach").alias("ri")
    )
    right = roots.select("dims", "chunk", F.col("block").alias("j"), F.col("centre").alias("cj"), F.col("reach").alias("rj"))
    apart = F.sqrt(F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = apart <= math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + F.col("ri") + F.col("rj") + SAFE
    return left.join(right, ["dims", "chunk"]).where(F.col("i") < F.col("j")).where(near).select("dims", "i", "j")


def near_links(vectors: DataFrame, cosine: float, block_rows: int | None = None, least_hot: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding).

    Two rows link when the cosine of their vectors is at least ``cosine`` (above 0).
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _read_rows(kind), "vec_id long, site binary, dims int, vector binary"
    ))
    grouped = rows.where(F.col("site").isNotNull()).groupBy("site", "dims").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")
    )
    sites = stored(grouped.withColumn("id", F.monotonically_increasing_id()))
    blocks = stored(
        _blocks(sites.select("id", "site", "dims", "copies", "vector"), kind, block_rows).select("dims", "block", "id", "copies", "vector")
        .groupBy("dims", "block").applyInArrow(_build(cosine, kind), BLOCK_SCHEMA)
    )
    pairs = stored(_block_pairs(blocks, cosine))
    trees = blocks.drop("centre", "reach", "points")
    sides = [
        trees.join(pairs.withColumnRenamed("dims", "_dims"), (F.col("dims") == F.col("_dims")) & (F.col("block") == F.col(side))).drop("_dims")
        for side in ("i", "j")
    ]
    met = stored(sides[0].unionByName(sides[1]).groupBy("dims", "i", "j").applyInArrow(_meet(cosine, kind), "a long, b long, links long"))
    points = blocks.select(F.explode("points").alias("p")).select("p.*")
    return _answer(spark, rows, sites.select("id", "site", "least", "copies"), stored(points), met, least_hot)


def _answer(spark: SparkSession, rows: DataFrame, sites: DataFrame, points: DataFrame, met: DataFrame, least_hot: int | None) -> DataFrame:
    counts = points.select("id", "links").unionByName(met.where(F.col("b").isNull()).select(F.col("a").alias("id"), "links"))
    named = points.select("id", "label").join(sites, "id")
    labels = named.groupBy("label").agg(F.min("least").alias("least"))  # at most a block's rows a label
    tied = components(met.where(F.col("b").isNotNull()).select("a", "b"))
    groups = stored(labels.join(tied, F.col("label") == F.col("node"), "left").select("label", "least", F.coalesce("component", "label").alias("component")))
    names = groups.groupBy("component").agg(F.min("least").alias("component_id"))  # at most one row a label and block
    group_names = groups.select("label", "component").join(names, "component").select("label", "component_id")
    answer = stored(
        named.join(group_names, "label").join(counts.groupBy("id").agg(F.sum("links").alias("links")), "id")
        .select("site", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    )
    if least_hot is None:
        least_hot = max(1000, rows.count() // int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.where(F.col("site").isNotNull()).select("vec_id", "site")
    alone = rows.where(F.col("site").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    hot = answer.where(F.col("copies") > least_hot)  # fewer of them than partitions
    cold = found.join(F.broadcast(hot.select("site")), "site", "left_anti").join(answer.where(F.col("copies") <= least_hot), "site")
    parts = [part.select("vec_id", "n_links", "component_id") for part in (cold, found.join(F.broadcast(hot), "site"), alone)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
