"""Positions, running totals and neighbours in very long ordered groups.

A window over a station sorts the whole station in one task. The operators here
never do: rows are range-partitioned by (group, sort columns), so a hot group is
spread over many partitions; each partition is numbered on its own and a small
table with one row per (group, partition) carries the offsets across.

The range layout is stored once through the checkpoint folder, because the range
bounds are sampled and both readers of the layout must see the same bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.operators.joining import lookup_join, match_join
from linewise.session import cut_lineage

PART, POS = "_part", "_pos"
BLOCK = 65_536


def _sort_columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(name).asc_nulls_last() if isinstance(name, str) else name for name in names]


def range_layout(df: DataFrame, keys: Sequence[str], sort: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted by keys and sort columns across partitions, with part and position."""
    columns = _sort_columns([*keys, *sort])
    placed = (
        df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return cut_lineage(placed)


def _earlier_parts(spans: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """Add, per (keys, part), the totals of all earlier parts of the same group.

    ``spans`` has one row per (group, partition): at most #partitions rows a group.
    """
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return spans.select(
        "*", *[F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(name) for name, total in sums.items()]
    )


def rank_in_groups(
    df: DataFrame, keys: Sequence[str], sort: Sequence[str | Column], name: str
) -> DataFrame:
    """1..n position inside each group; equals row_number over (keys order by sort)."""
    laid = range_layout(df, keys, sort)
    spans = laid.groupBy(*keys, PART).agg(F.min(POS).alias("_rank_start"), F.count("*").alias("_rank_rows"))
    offsets = _earlier_parts(spans, keys, {"_rank_before": "_rank_rows"}).drop("_rank_rows")
    ranked = lookup_join(laid, offsets, [*keys, PART])
    return ranked.withColumn(name, (F.col(POS) - F.col("_rank_start") + F.col("_rank_before") + 1).cast("bigint")).drop(
        PART, POS, "_rank_start", "_rank_before"
    )


def number_rows(df: DataFrame, sort: Sequence[str | Column], name: str) -> DataFrame:
    """1..n over the whole frame without gathering it in one partition."""
    return rank_in_groups(df, [], sort, name)


def totals_before(
    df: DataFrame, keys: Sequence[str], sort: Sequence[str | Column], sums: Mapping[str, str]
) -> DataFrame:
    """For each row, the sums over all earlier rows of its group.

    ``sums`` maps output name to summed column. Sort columns must be unique within
    the group. Windows run per (group, partition), so no window sees a whole group.
    """
    laid = range_layout(df, keys, sort)
    spans = laid.groupBy(*keys, PART).agg(*[F.sum(col).alias(f"_sum_{out}") for out, col in sums.items()])
    offsets = _earlier_parts(spans, keys, {f"_off_{out}": f"_sum_{out}" for out in sums}).drop(
        *[f"_sum_{out}" for out in sums]
    )
    local = Window.partitionBy(*keys, PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    running = laid.select(
        "*", *[F.coalesce(F.sum(col).over(local), F.lit(0)).alias(f"_run_{out}") for out, col in sums.items()]
    )
    joined = lookup_join(running, offsets, [*keys, PART])
    return joined.select(
        *df.columns, *[(F.col(f"_run_{out}") + F.col(f"_off_{out}")).alias(out) for out in sums]
    )


def nearest_non_null(
    df: DataFrame, keys: Sequence[str], sort: Sequence[str | Column], payload: str,
    previous: str, following: str,
) -> DataFrame:
    """Closest earlier (or same-row) and later (or same-row) non-null ``payload``."""
    laid = range_layout(df, keys, sort)
    up = Window.partitionBy(*keys, PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, PART).orderBy(F.col(POS).desc()).rowsBetween(Window.unboundedPreceding, 0)
    edges = laid.where(F.col(payload).isNotNull()).groupBy(*keys, PART).agg(
        F.max_by(payload, POS).alias("_last"), F.min_by(payload, POS).alias("_head")
    )
    spans = match_join(laid.select(*keys, PART).distinct(), edges, [*keys, PART], "left")
    part_up = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    part_down = Window.partitionBy(*keys).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(
        *keys, PART,
        F.last("_last", ignorenulls=True).over(part_up).alias("_carry_up"),
        F.last("_head", ignorenulls=True).over(part_down).alias("_carry_down"),
    )
    local = laid.withColumn(previous, F.last(payload, ignorenulls=True).over(up)).withColumn(
        following, F.last(payload, ignorenulls=True).over(down)
    )
    joined = lookup_join(local, carried, [*keys, PART])
    return joined.select(
        *df.columns,
        F.coalesce(previous, "_carry_up").alias(previous),
        F.coalesce(following, "_carry_down").alias(following),
    )


def carried_forward(df: DataFrame, keys: Sequence[str], sort: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    """Each of ``columns`` replaced by its last non-null value at or before the row in its group."""
    laid = range_layout(df, keys, sort)
    up = Window.partitionBy(*keys, PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    ends = laid.groupBy(*keys, PART).agg(*[F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col(POS))).alias(f"_end_{name}") for name in columns])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, PART, *[F.last(f"_end_{name}", ignorenulls=True).over(earlier).alias(f"_carry_{name}") for name in columns])
    joined = lookup_join(laid.withColumns({f"_here_{name}": F.last(name, ignorenulls=True).over(up) for name in columns}), carried, [*keys, PART])
    return joined.select(*[F.coalesce(f"_here_{name}", f"_carry_{name}").alias(name) if name in columns else name for name in df.columns])


def consecutive_runs(
    observed: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK
) -> DataFrame:
    """Maximal runs of consecutive integers per group: keys, run_start, run_end, run_length.

    Orders are cut into blocks of ``block`` numbers, so a window never holds more
    than ``block`` distinct orders. Only runs that touch a block edge (at most two a
    block) are stitched in a second, far smaller pass.
    """
    bucket = F.floor(F.col(order) / block)
    orders = observed.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("bigint").alias(order)).distinct()
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    pieces = (
        orders.withColumn("_block", bucket)
        .withColumn("_island", F.col(order) - F.row_number().over(inside))
        .groupBy(*keys, "_block", "_island")
        .agg(F.min(order).alias("run_start"), F.max(order).alias("run_end"))
        .withColumn(
            "_edge",
            (F.pmod("run_start", F.lit(block)) == 0) | (F.pmod("run_end", F.lit(block)) == block - 1),
        )
    )
    along = Window.partitionBy(*keys).orderBy("run_start")
    stitched = (
        pieces.where("_edge")
        .withColumn("_new", (F.col("run_start") != F.lag("run_end").over(along) + 1).cast("int"))
        .withColumn("_chain", F.sum(F.coalesce("_new", F.lit(1))).over(along))
        .groupBy(*keys, "_chain")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
    )
    columns = [*keys, "run_start", "run_end"]
    runs = pieces.where(~F.col("_edge")).select(columns).unionByName(stitched.select(columns))
    return runs.withColumn("run_length", F.col("run_end") - F.col("run_start") + 1)


def next_orders(
    observed: DataFrame, keys: Sequence[str], order: str, previous: str | None = None,
    following: str = "next_order", block: int = BLOCK,
) -> DataFrame:
    """Distinct orders with their successor (and predecessor) in the group, block by block."""
    bucket = F.floor(F.col(order) / block)
    orders = observed.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("bigint").alias(order)).distinct()
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    blocked = orders.withColumn("_block", bucket)
    along = Window.partitionBy(*keys).orderBy("_block")
    edges = (
        blocked.groupBy(*keys, "_block").agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
        .withColumn("_after", F.lead("_low").over(along))
        .withColumn("_prior", F.lag("_high").over(along))
        .drop("_low", "_high")
    )
    linked = blocked.withColumn("_lead", F.lead(order).over(inside)).withColumn("_lag", F.lag(order).over(inside))
    joined = lookup_join(linked, edges, [*keys, "_block"])
    columns = [*keys, order, F.coalesce("_lead", "_after").alias(following)]
    if previous:
        columns.append(F.coalesce("_lag", "_prior").alias(previous))
    return joined.select(*columns)


def order_list_parts(members: DataFrame, keys: Sequence[str], order: str, block: int = BLOCK) -> DataFrame:
    """Order lists as text, cut into parts of at most ``block`` order numbers.

    Joining the parts of a group with ';' in part order gives the full list; no row
    grows with the group.
    """
    return (
        members.where(F.col(order).isNotNull())
        .select(*keys, F.col(order).cast("bigint").alias(order)).distinct()
        .withColumn("part", F.floor(F.col(order) / block))
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(order)).alias("_orders"))
        .select(
            *keys, "part", F.size("_orders").cast("bigint").alias("order_count"),
            F.array_join(F.col("_orders").cast("array<string>"), ";").alias("orders"),
        )
    )
