"""The defect-analysis job: products, passes and detections to every result table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.config import AnalysisConfig
from linewise.operators import evidence, relations, sequence, spatial
from linewise.operators.joining import match_join
from linewise.session import cut_lineage
from linewise.sources.tables import RunFolder, run_summary
from linewise.streaming import replay


STATION = ["analysis_scope", "station_id"]


@dataclass
class AnalysisResult:
    frames: dict[str, DataFrame]
    summary: DataFrame


def _on_task_axis(rows: DataFrame, order: str, on_line: DataFrame) -> DataFrame:
    """Rows with a station's order, with the global order of the product at that place."""
    place = on_line.withColumnRenamed("production_order", order)
    return match_join(rows, place, [*STATION, order])


def pattern_orders(patterns: DataFrame, tracked: DataFrame, on_line: DataFrame) -> DataFrame:
    """scope, station, cluster, role (observed / missing), global_order: the evidence of every pattern, one order a row."""
    keys = [*STATION, "cluster_id"]
    observed = tracked.where("cluster_id is not null and production_order is not null").select(*keys, "production_order").distinct()
    observed = match_join(observed, patterns.select(*keys).distinct(), keys, "left_semi")
    gaps = sequence.missing_slots(
        patterns.where("pattern_type = 'periodic'"), observed, keys, "production_order", on_line.select(*STATION, "production_order"), STATION
    )
    seen = _on_task_axis(observed, "production_order", on_line).select(*keys, F.lit("observed").alias("role"), "global_order")
    return seen.unionByName(_on_task_axis(gaps, "missing_order", on_line).select(*keys, F.lit("missing").alias("role"), "global_order"))


def alert_orders(alerts: DataFrame, tracked: DataFrame, on_line: DataFrame, config: AnalysisConfig) -> DataFrame:
    """alert_id, global_order: the evidence of every alert, one order a row."""
    rows = replay.alert_evidence(alerts, tracked, tolerance=config.period_order_tolerance)
    return _on_task_axis(rows, "evidence_order", on_line).select("alert_id", "global_order")


def analyze(
    products: DataFrame, detections: DataFrame, passes: DataFrame, config: AnalysisConfig,
    catalog: DataFrame | None = None, warps: DataFrame | None = None,
) -> AnalysisResult:
    """Clusters, patterns, alerts, code evidence, trajectories and attribution.

    ``products`` carry global_order, analysis_scope, station_id, production_order and
    the event ids; ``detections`` carry global_order and 0..1 coordinates. Sequences
    use the production order of the product's own station; products without one keep
    their detections but stay out of sequence analysis.
    """
    spark = products.sparkSession
    orders = products.select("global_order", "analysis_scope", "station_id", "production_order", "dmc_raw")
    placed = detections.select(*[name for name in detections.columns if name not in orders.columns or name == "global_order"]).join(
        orders, "global_order"
    )
    assigned = cut_lineage(spatial.assign_clusters(placed, config))
    aligned = spatial.apply_registration(assigned, warps, config.registration_min_score)
    tracked, trajectories = spatial.trajectories(aligned, config)
    tracked = cut_lineage(tracked)
    alerts, active = replay.replay_batch(products, tracked, config)
    patterns = replay.spatial_patterns(products, tracked, active, config)
    names = evidence.builtin_catalog(spark) if catalog is None else catalog
    loaded, issues = evidence.load_catalog(names)
    codes = cut_lineage(evidence.normalize_codes(passes, loaded).join(
        products.select("analysis_scope").distinct(), "analysis_scope", "left_semi"
    ))
    links = cut_lineage(evidence.map_codes(products, codes))
    code_patterns = sequence.code_patterns(codes, config)
    code_space = evidence.code_spatial(products, links, tracked)
    on_line = orders.where("production_order is not null").select(*STATION, "production_order", "global_order").distinct()
    alerts, patterns = cut_lineage(alerts), cut_lineage(patterns)
    conflicts = evidence.label_conflicts(products, links)
    attribution = evidence.attribution(code_patterns, trajectories, code_space, products, tracked)
    events = relations.category_events(tracked, "cluster_id")
    frames = {
        "extracted_defects": tracked, "spatial_clusters": spatial.cluster_summary(tracked),
        "discovered_patterns": patterns, "alerts": alerts, "normalized_defect_codes": codes,
        "defect_code_catalog": loaded, "defect_code_catalog_issues": issues, "code_image_links": links,
        "code_patterns": code_patterns, "spatial_trajectories": trajectories, "code_spatial_associations": code_space,
        "pattern_orders": pattern_orders(patterns, tracked, on_line), "alert_orders": alert_orders(alerts, tracked, on_line, config),
        "trajectory_orders": tracked.where("trajectory_id is not null").select("trajectory_id", "global_order").distinct(),
        "code_pattern_orders": sequence.pattern_image_links(codes, code_patterns, links),
        "code_space_orders": evidence.code_spatial_support(links, tracked),
        "code_label_conflicts": conflicts, "station_attribution": attribution,
        "defect_cooccurrence": relations.cooccurrence(products, events), "defect_transitions": relations.transitions(events),
    }
    return AnalysisResult(frames, run_summary(products, tracked, patterns, alerts))


def view_frames(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a run by the names ``views.result_view`` uses."""
    names = {
        "patterns": "discovered_patterns", "trajectories": "spatial_trajectories", "code_space": "code_spatial_associations",
        "code_conflicts": "code_label_conflicts", "normalized_codes": "normalized_defect_codes",
    }
    same = ("alerts", "code_patterns", "code_image_links", "pattern_orders", "alert_orders", "trajectory_orders", "code_pattern_orders", "code_space_orders")
    return {name: frames[source] for name, source in [*names.items(), *zip(same, same, strict=True)]}


def run_analysis(
    products: DataFrame, detections: DataFrame, passes: DataFrame, config: AnalysisConfig, root: str, task: str,
    catalog: DataFrame | None = None, warps: DataFrame | None = None,
) -> str:
    """Analyse and store everything in a new run folder; returns the folder."""
    spark = products.sparkSession
    with RunFolder(spark, root, task) as folder:
        result = analyze(products, detections, passes, config, catalog, warps)
        frames = folder.write(result.frames)  # each plan runs once; what follows reads the files
        folder.write_by_scope({
            "products": products, **{name: frame for name, frame in frames.items() if "analysis_scope" in frame.columns},
        })
        summary = run_summary(products, frames["extracted_defects"], frames["discovered_patterns"], frames["alerts"])
        folder.write_json({"analysis_summary": summary.withColumn("task_name", F.lit(task)), "settings": config.snapshot(spark)})
    return folder.final
