"""The measurement-quality job and the process-relationship job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.operators import process, quality
from linewise.session import cut_lineage
from linewise.sources import worksheets

DIMENSIONS = ("variant", "batch", "line", "ttnr")


def analyze_measurements(
    rows: DataFrame, mapping: Mapping[str, str] | None = None, profile: str = "auto"
) -> dict[str, DataFrame]:
    """Every quality table of landed measurement sheets."""
    layout = worksheets.measurement_layout(rows, mapping, profile)
    tall = worksheets.measurement_tall(rows, layout)
    keys = [*worksheets.SHEET, "source_row"]
    evaluated = cut_lineage(quality.with_tolerance(tall))
    records = cut_lineage(quality.record_verdicts(worksheets.measurement_records(rows, layout), evaluated, keys))
    cells = worksheets.categorical_cells(rows, layout)
    counts = cells.groupBy("profile", "field", "value").agg(F.count("*").alias("value_count"))
    totals = counts.groupBy("profile", "field").agg(F.sum("value_count").alias("_total"))
    return {
        "standardized_data": records, "parameter_specs": worksheets.parameter_specs(tall),
        "parameter_statistics": quality.parameter_stats(evaluated, "source_row"),
        "tolerance_violations": quality.violations(evaluated, keys),
        "judgement_conflicts": records.where("judgement_conflict"),
        "group_quality": quality.group_quality(records, DIMENSIONS),
        "quality_trend": quality.quality_trend(records, "timestamp"),
        "categorical_statistics": counts.join(totals, ["profile", "field"]).select(
            "profile", "field", "value", "value_count", (F.col("value_count") / F.col("_total")).alias("share")
        ),
        "summary": quality.quality_summary(records, "timestamp"),
    }


def relate_process(
    products: DataFrame, detections: DataFrame, parameters: DataFrame, codes: DataFrame | None = None,
    tolerance_seconds: float = 60, right_order: Sequence[str] = (), batch: str | None = None,
) -> tuple[dict[str, DataFrame], dict[str, object]]:
    """Metrics, binned rates and model importance of process parameters for all targets."""
    joined, key = process.join_process(products, parameters, tolerance_seconds, right_order)
    joined = cut_lineage(process.defect_counts(joined, detections))
    names = process.parameter_names(parameters)
    columns = [f"{name}_process" if f"{name}_process" in joined.columns else name for name in names]
    renamed = joined.select("*", *[F.col(c).alias(f"_v_{n}") for n, c in zip(names, columns)])
    tall = process.tall_parameters(renamed, [f"_v_{name}" for name in names]).withColumn("parameter", F.expr("substring(parameter, 4)"))
    targets = cut_lineage(process.build_targets(products, detections, codes))
    values = process.ranked_values(tall)
    importance, model = process.logistic_importance(joined, columns, batch=batch)
    return {
        "joined": joined, "targets": targets, "parameter_metrics": process.parameter_metrics(tall, targets, values),
        "binned_rates": process.binned_rates(tall, targets, values), "model_importance": importance,
        "summary": process.relationship_summary(joined, key, names),
    }, model
