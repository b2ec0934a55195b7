"""Which defects occur together and which follow each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions import blank_to_null, is_analyzable
from linewise.operators.ordering import next_orders
from linewise.session import cut_lineage

SCOPE = "analysis_scope"


def category_events(defects: DataFrame, category: str | None = None) -> DataFrame:
    """Distinct (scope, order, category) of analyzable defects with a category."""
    name = category or ("defect_type" if "defect_type" in defects.columns else "cluster_id")
    rows = defects.where(is_analyzable(F.col("detection_type"))) if "detection_type" in defects.columns else defects
    scope = F.col(SCOPE) if SCOPE in defects.columns else F.lit("")
    return (
        rows.select(scope.alias(SCOPE), F.col("global_order").cast("bigint").alias("global_order"), blank_to_null(F.col(name)).alias("category"))
        .where("category is not null and global_order is not null").distinct()
    )


def _category_sets(events: DataFrame) -> DataFrame:
    """Sorted category set per product. A set is at most the category vocabulary."""
    return events.groupBy(SCOPE, "global_order").agg(F.sort_array(F.collect_set("category")).alias("categories"))


def cooccurrence(products: DataFrame, events: DataFrame) -> DataFrame:
    """Support, conditional probabilities and lift of category pairs within a product.

    Products are first grouped by their whole category set; pairs are then written
    once per distinct set with its product count as weight, not once per product.
    """
    # distinct sets with their weight: small, read by three branches below
    sets = cut_lineage(_category_sets(events).groupBy(SCOPE, "categories").agg(F.count("*").alias("_weight")))
    rest: Column = F.expr("slice(categories, _at + 2, size(categories))")
    pairs = (
        sets.select(SCOPE, "categories", "_weight", F.posexplode("categories").alias("_at", "left_category"))
        .select(SCOPE, "_weight", "left_category", F.explode(rest).alias("right_category"))
        .groupBy(SCOPE, "left_category", "right_category").agg(F.sum("_weight").alias("product_count"))
    )
    sizes = sets.select(SCOPE, "_weight", F.explode("categories").alias("category")).groupBy(SCOPE, "category").agg(
        F.sum("_weight").alias("_size")
    )
    scope = F.col(SCOPE) if SCOPE in products.columns else F.lit("")
    totals = products.groupBy(scope.alias(SCOPE)).agg(F.count("*").alias("_total"))
    left = sizes.select(SCOPE, F.col("category").alias("left_category"), F.col("_size").alias("_left"))
    right = sizes.select(SCOPE, F.col("category").alias("right_category"), F.col("_size").alias("_right"))
    rows = pairs.join(left, [SCOPE, "left_category"]).join(right, [SCOPE, "right_category"]).join(totals, SCOPE, "left")
    total = F.greatest(F.coalesce("_total", F.lit(1)), F.lit(1))
    lift = (F.col("product_count") / total) / ((F.col("_left") / total) * (F.col("_right") / total))
    return rows.select(
        SCOPE, "left_category", "right_category", "product_count",
        (F.col("product_count") / F.col("_left")).alias("p_right_given_left"),
        (F.col("product_count") / F.col("_right")).alias("p_left_given_right"), lift.alias("lift"),
    )


def transitions(events: DataFrame) -> DataFrame:
    """Category transitions between consecutive defective products of a scope.

    The successor is the next order with any category, however far. Set pairs are
    counted before categories are paired.
    """
    sets = cut_lineage(_category_sets(events))
    links = next_orders(sets, [SCOPE], "global_order").where("next_order is not null")
    following = sets.select(SCOPE, F.col("global_order").alias("next_order"), F.col("categories").alias("_next"))
    moves = cut_lineage(
        sets.join(links, [SCOPE, "global_order"]).join(following, [SCOPE, "next_order"])
        .groupBy(SCOPE, "categories", "_next")
        .agg(F.count("*").alias("_n"), F.sum(F.col("next_order") - F.col("global_order")).alias("_gap"))
    )
    left_counts = moves.select(SCOPE, "_n", F.explode("categories").alias("from_category")).groupBy(SCOPE, "from_category").agg(
        F.sum("_n").alias("_from")
    )
    pairs = (
        moves.select(SCOPE, "_n", "_gap", "_next", F.explode("categories").alias("from_category"))
        .select(SCOPE, "_n", "_gap", "from_category", F.explode("_next").alias("to_category"))
        .groupBy(SCOPE, "from_category", "to_category")
        .agg(F.sum("_n").alias("transition_count"), F.sum("_gap").alias("_gap"))
    )
    return pairs.join(left_counts, [SCOPE, "from_category"]).select(
        SCOPE, "from_category", "to_category", "transition_count",
        (F.col("transition_count") / F.col("_from")).alias("probability"),
        (F.col("_gap") / F.col("transition_count")).alias("mean_gap"),
    )


def neighbour_defects(detections: DataFrame, order: str = "global_order") -> DataFrame:
    """Previous and next defective product of every defective product."""
    return next_orders(detections, [], order, previous="previous_order", following="next_order")
