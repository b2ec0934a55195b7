"""Shared filtered result view: one set of filters applied to every result table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewise.config import AnalysisConfig
from linewise.functions import is_blank, is_defect_status, order_array
from linewise.operators.joining import match_join
from linewise.operators.ordering import nearest_non_null, number_rows
from linewise.operators.relations import category_events, cooccurrence, transitions
from linewise.operators.sequence import CODE_GROUP, pattern_image_links
from linewise.operators.sequence import code_patterns as find_code_patterns
from linewise.session import cut_lineage

PATTERN_KEYS = ["analysis_scope", "station_id", "cluster_id"]
SPACE_KEYS = ["analysis_scope", "canonical_code", "source_type", "spatial_type", "spatial_id"]
SECTIONS = ("periodic", "burst", "code", "trajectory", "cooccurrence", "transition", "other")


# --------------------------------------------------------------------- global filters

def filter_products(
    products: DataFrame, scope: str | None = None, camera: str | None = None, batch: str | None = None,
    orders: tuple[int, int] | None = None, times: tuple[object, object] | None = None,
) -> DataFrame:
    """Products of one scope, camera, batch, order range and time range."""
    rows = products
    if scope:
        rows = rows.where(F.col("analysis_scope") == scope)
    if camera:
        rows = rows.where(F.col("camera") == camera)
    batch_column = next((name for name in ("batch", "batch_id") if name in rows.columns), None)
    if batch and batch_column:
        rows = rows.where(F.col(batch_column) == batch)
    if orders:
        rows = rows.where(F.col("global_order").between(*orders))
    time = next((name for name in ("production_timestamp", "timestamp") if name in rows.columns), None)
    if times and time:
        rows = rows.where(F.col(time).between(*times))
    return rows


def filter_detections(
    products: DataFrame, detections: DataFrame, category: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Detections of the products; a chosen category also narrows the products."""
    kept = detections.join(products.select("global_order").distinct(), "global_order", "left_semi")
    if not category:
        return products, kept
    column = "defect_type" if "defect_type" in detections.columns else "cluster_id"
    chosen = kept.where(F.col(column).cast("string") == category)
    return products.join(chosen.select("global_order").distinct(), "global_order", "left_semi"), chosen


def filter_order_evidence(
    frame: DataFrame, orders: DataFrame, list_columns: Sequence[str] = (), scalar_columns: Sequence[str] = (),
    order: str = "global_order",
) -> DataFrame:
    """Rows whose order list or order column meets ``orders``; rows are never duplicated."""
    lists = [name for name in list_columns if name in frame.columns]
    scalars = [name for name in scalar_columns if name in frame.columns]
    if not lists and not scalars:
        return frame
    pieces: list[Column] = []
    for name in lists:
        is_array = dict(frame.dtypes)[name].startswith("array")
        pieces.append(F.coalesce(F.col(name).cast("array<bigint>"), F.array().cast("array<bigint>")) if is_array else order_array(F.col(name)))
    pieces += [F.array_compact(F.array(F.col(name).cast("bigint"))) for name in scalars]
    wanted = orders.select(F.col(order).cast("bigint").alias("_order")).where("_order is not null").distinct()
    # row numbers are stored, so a recomputed task cannot number its rows differently
    numbered = cut_lineage(frame.withColumn("_row", F.monotonically_increasing_id()))
    # only row numbers and orders meet the wanted orders; the columns travel once, with the rows that stay
    spread = numbered.select("_row", F.explode(F.array_distinct(F.concat(*pieces))).alias("_order"))
    kept = spread.join(wanted, "_order", "left_semi").select("_row").distinct()
    return numbered.join(kept, "_row", "left_semi").select(*frame.columns)


def search_all_columns(frame: DataFrame, pattern: str) -> DataFrame:
    """Rows where any column contains the text; * and ? are wildcards, case is ignored."""
    escaped = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    like = "%" + escaped.replace("*", "%").replace("?", "_") + "%"
    tests = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).ilike(like) for name in frame.columns]
    return frame.where(reduce(lambda a, b: a | b, tests)) if pattern else frame


def filter_choices(products: DataFrame, detections: DataFrame) -> DataFrame:
    """Distinct values offered by each filter, as (filter, value)."""
    category = "defect_type" if "defect_type" in detections.columns else "cluster_id"
    batch = next((name for name in ("batch", "batch_id") if name in products.columns), None)
    names = ["analysis_scope", "camera"] + ([batch] if batch else [])
    pairs = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(name).cast("string").alias("value")) for name in names if name in products.columns])
    rows = products.select(F.explode(pairs).alias("_p")).select("_p.*").unionByName(
        detections.select(F.lit("category").alias("filter"), F.col(category).cast("string").alias("value"))
    )
    return rows.where(~is_blank(F.col("value"))).distinct()


def remap_order_lists(frame: DataFrame, column: str, mapping: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Rewrite an order-list text through (from_order -> to_order); unknown orders vanish.

    List order and repeats are kept. ``key`` columns scope the mapping.
    """
    row = cut_lineage(frame.withColumn("_row", F.monotonically_increasing_id()))
    # only row numbers, positions and orders meet the mapping; the other columns travel once, to the new text
    parts = row.select("_row", *key, F.posexplode_outer(order_array(F.col(column), ";")).alias("_at", "from_order"))
    known = mapping.where("to_order is not null").select(*key, "from_order", "to_order")
    found = match_join(parts, known, [*key, "from_order"]).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", "to_order"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda item: item["to_order"].cast("string")), ";").alias("_text")
    others = [name for name in frame.columns if name != column]
    merged = row.select("_row", *others).join(found.select("_row", text), "_row", "left")
    return merged.select(*others, F.coalesce("_text", F.lit("")).alias(column)).select(*frame.columns)


def nearest_order(products: DataFrame, order: int) -> DataFrame:
    """The existing order closest to the asked one, the smaller on equal distance."""
    return products.select("global_order").orderBy(F.abs(F.col("global_order") - order), "global_order").limit(1)


def nearest_orders(asked: DataFrame, products: DataFrame, order: str = "asked_order") -> DataFrame:
    """For many asked orders the closest existing order, the smaller on equal distance."""
    known = products.select(F.col("global_order").cast("bigint").alias("_o"), F.col("global_order").cast("bigint").alias("_known")).distinct()
    axis = asked.select(F.col(order).cast("bigint").alias("_o")).distinct().withColumn("_asked", F.lit(True)).join(known, "_o", "full_outer")
    near = nearest_non_null(axis, [], ["_o"], "_known", "_prev", "_next").where("_asked")
    closer = F.when(F.col("_next").isNull() | (F.col("_o") - F.col("_prev") <= F.col("_next") - F.col("_o")), F.col("_prev")).otherwise(F.col("_next"))
    return near.select(F.col("_o").alias(order), closer.alias("global_order"))


# ------------------------------------------------------------------------ result view

@dataclass
class ResultView:
    products: DataFrame
    detections: DataFrame
    alerts: DataFrame
    sections: dict[str, DataFrame]
    counts: DataFrame


def code_links(frames: Mapping[str, DataFrame], products: DataFrame, source: str = "all") -> DataFrame:
    """Defective code-image links of the visible products and the chosen source."""
    links = frames["code_image_links"].join(products.select("global_order").distinct(), "global_order", "left_semi")
    if "code_status" in links.columns:
        links = links.where(is_defect_status(F.col("code_status")))
    if source != "all" and "source_type" in links.columns:
        links = links.where(F.col("source_type") == source)
    return links


def code_relationships(products: DataFrame, links: DataFrame, selected: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Co-occurrence and transitions of codes, only pairs that touch a selected code."""
    events = category_events(links.withColumn("defect_type", F.col("canonical_code")), "defect_type")
    pairs, moves = cooccurrence(products, events), transitions(events)
    if selected:
        codes = list(selected)
        pairs = pairs.where(F.col("left_category").isin(codes) | F.col("right_category").isin(codes))
        moves = moves.where(F.col("from_category").isin(codes) | F.col("to_category").isin(codes))
    return pairs, moves


def keep_by_evidence(frame: DataFrame, evidence: DataFrame, keys: Sequence[str], products: DataFrame) -> DataFrame:
    """Rows of ``frame`` with at least one evidence row (keys, global_order) among ``products``."""
    seen = evidence.join(products.select("global_order").distinct(), "global_order", "left_semi").select(*keys).distinct()
    return match_join(frame, seen, keys, "left_semi")


def result_view(
    frames: Mapping[str, DataFrame], products: DataFrame, detections: DataFrame, config: AnalysisConfig,
    selected_codes: Iterable[str] = (), code_source: str = "all", merge: bool = False,
) -> ResultView:
    """Apply products, codes and source to every result table.

    A chosen code narrows products through explicit links; spatial patterns, alerts
    and trajectories stay only if an association ties them to the code. Every table is
    filtered by its tall evidence table (``analyze`` stores them), whose global orders are
    on the axis of ``products``; station orders are never compared with them.
    """
    selected = sorted({str(code) for code in selected_codes if str(code)})
    scopes = products.select("analysis_scope").where("analysis_scope is not null").distinct()
    links = code_links(frames, products, code_source)
    if selected:
        chosen = links.where(F.col("canonical_code").isin(selected)).select("global_order").distinct()
        visible = products.join(chosen, "global_order", "left_semi")
    else:
        visible = products
    visible_detections = detections.join(visible.select("global_order").distinct(), "global_order", "left_semi")

    def scoped(name: str) -> DataFrame:
        return frames[name].join(scopes, "analysis_scope", "left_semi")

    patterns = keep_by_evidence(scoped("patterns"), frames["pattern_orders"].where("role = 'observed'"), PATTERN_KEYS, products)
    alerts = keep_by_evidence(scoped("alerts"), frames["alert_orders"], ["alert_id"], products)
    tracks = keep_by_evidence(scoped("trajectories"), frames["trajectory_orders"], ["trajectory_id"], products)
    if selected:
        ties = scoped("code_space").where(F.col("canonical_code").isin(selected))
        if code_source != "all" and "source_type" in ties.columns:
            ties = ties.where(F.col("source_type") == code_source)
        ties = keep_by_evidence(ties, frames["code_space_orders"], SPACE_KEYS, products)
        clusters = ties.where("spatial_type = 'cluster'").select(F.col("spatial_id").alias("cluster_id")).distinct()
        paths = ties.where("spatial_type = 'trajectory'").select(F.col("spatial_id").alias("trajectory_id")).distinct()
        patterns = patterns.join(clusters, "cluster_id", "left_semi")
        alerts = alerts.join(clusters, "cluster_id", "left_semi")
        tracks = tracks.join(paths, "trajectory_id", "left_semi")
    if selected and merge:
        coded = find_code_patterns(frames["normalized_codes"], config, selected, merge=True)
        coded = coded.join(scopes, "analysis_scope", "left_semi")
        coded_orders = pattern_image_links(frames["normalized_codes"], coded, frames["code_image_links"], selected, merge=True)
    else:
        coded, coded_orders = scoped("code_patterns"), frames["code_pattern_orders"]
        if selected:
            coded = coded.where(F.col("canonical_code").isin(selected))
    if code_source != "all" and "source_type" in coded.columns:
        coded = coded.where(F.col("source_type") == code_source)
    coded = keep_by_evidence(coded, coded_orders.where("role = 'observed'"), [*CODE_GROUP, "canonical_code"], products)
    pairs, moves = code_relationships(products, links, selected)
    conflicts = filter_order_evidence(scoped("code_conflicts"), visible, (), ("global_order",))
    sections = {
        "periodic": patterns.where("pattern_type = 'periodic'"), "burst": patterns.where("pattern_type = 'burst'"),
        "code": coded, "trajectory": tracks, "cooccurrence": pairs, "transition": moves,
        "other": patterns.where("pattern_type not in ('periodic', 'burst')"),
    }
    return ResultView(visible, visible_detections, alerts, sections,
                      view_counts(visible, visible_detections, conflicts, alerts, sections))


def view_counts(
    products: DataFrame, detections: DataFrame, conflicts: DataFrame, alerts: DataFrame, sections: Mapping[str, DataFrame]
) -> DataFrame:
    """The nine counters of a view, in one row."""
    kind = F.col("detection_type") if "detection_type" in detections.columns else F.lit("")
    cluster = F.col("cluster_id") if "cluster_id" in detections.columns else F.lit(None).cast("string")
    rows = products.agg(F.count("*").alias("analyzed_product_count")).crossJoin(detections.agg(
        F.count("*").alias("extracted_defect_count"), F.count_if(kind == "micro").alias("micro_defect_count"),
        F.count_if(kind == "local").alias("local_defect_count"),
        F.count_if(kind == "region_anomaly").alias("region_anomaly_count"),
        F.count_distinct(F.when(~is_blank(cluster), cluster)).alias("spatial_cluster_count"),
    )).crossJoin(conflicts.agg(F.count("*").alias("code_label_conflict_count"))).crossJoin(
        alerts.agg(F.count("*").alias("alert_count"))
    )
    found = reduce(lambda a, b: a.unionByName(b), [sections[name].select(F.lit(1).alias("_one")) for name in SECTIONS])
    return rows.crossJoin(found.agg(F.count("*").alias("discovered_pattern_count")))


def pattern_count(view: ResultView, section: str = "all") -> int:
    names = SECTIONS if section == "all" else (section,)
    return sum(view.sections[name].count() for name in names if name in view.sections)


# ------------------------------------------------------------------------- chart data

def cluster_timeline(assigned: DataFrame, minimum_repeat: int = 4) -> DataFrame:
    """Cluster row number, order and repeat flag of every clustered detection."""
    clustered = assigned.where(~is_blank(F.col("cluster_id")))
    sizes = clustered.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    rows = number_rows(sizes, ["cluster_id"], "cluster_row")
    return clustered.join(rows, "cluster_id").select(
        "cluster_id", "cluster_row", "global_order", "center_x_norm", "center_y_norm", (F.col("_n") >= minimum_repeat).alias("repeated")
    )


def alert_timeline(alerts: DataFrame) -> DataFrame:
    """Alert order and alert-type row for a replay chart."""
    kinds = alerts.select("alert_type").distinct().withColumn(
        "type_row", F.row_number().over(Window.orderBy("alert_type")).cast("bigint")  # five alert types at most
    )
    return alerts.join(F.broadcast(kinds), "alert_type").select("alert_type", "type_row", "alert_at_order", "severity")


def best_periodic(patterns: DataFrame) -> DataFrame:
    """The periodic pattern with the highest confidence."""
    return patterns.where("pattern_type = 'periodic'").agg(
        F.max_by(F.struct(*patterns.columns), F.struct("confidence", "cluster_id" if "cluster_id" in patterns.columns else "canonical_code")).alias("_p")
    ).where("_p is not null").select("_p.*")


def preview_orders(detections: DataFrame, limit: int = 8) -> DataFrame:
    """The first products with detections (a preview list)."""
    return detections.select("global_order").distinct().orderBy("global_order").limit(limit)
