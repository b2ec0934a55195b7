"""Measurement quality on tall rows and data-quality reports.

A tall row is one cell: record key, parameter, value, tolerance text. Every
statistic is one or two mergeable group-bys, so partial aggregation runs before
the shuffle and a hot parameter or batch costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.functions import (
    blank_to_null, is_blank, out_of_tolerance, test_state, tolerance_bounds, verdict, verdicts_conflict,
)
from linewise.operators.ordering import rank_in_groups


def to_tall(records: DataFrame, pairs: Sequence[tuple[str, str, str | None]], keys: Sequence[str]) -> DataFrame:
    """Unpivot (parameter, value column, tolerance column) triples in one pass."""
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("parameter"), F.col(f"`{value}`").cast("string").alias("raw_value"),
            (F.col(f"`{bounds}`").cast("string") if bounds else F.lit(None).cast("string")).alias("tolerance_raw"),
            F.lit(bounds is not None).alias("has_tolerance"),
        )
        for name, value, bounds in pairs
    ])
    return records.select(*keys, F.explode(cells).alias("_cell")).select(
        *keys, "_cell.parameter", F.trim("_cell.raw_value").try_cast("double").alias("value"),
        "_cell.tolerance_raw", "_cell.has_tolerance",
    )


def with_tolerance(tall: DataFrame) -> DataFrame:
    """Add bounds and the evaluated / violated flags to tall rows."""
    bounded = tall.withColumn("_b", tolerance_bounds(F.col("tolerance_raw"))).select(
        *tall.columns, F.col("_b.lower").alias("lower"), F.col("_b.upper").alias("upper")
    )
    evaluated = F.col("value").isNotNull() & F.col("lower").isNotNull()
    return bounded.withColumn("evaluated", evaluated).withColumn(
        "violated", F.col("evaluated") & out_of_tolerance(F.col("value"), F.col("lower"), F.col("upper"))
    )


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def parameter_stats(evaluated: DataFrame, position: str) -> DataFrame:
    """Per parameter: counts, range, mean, usual bounds, violations, tolerance status.

    The usual bounds are the most frequent pair; among equals the first seen by
    ``position``. Counting pairs first keeps the second group-by tiny.
    """
    by_bounds = evaluated.groupBy("parameter", "lower", "upper").agg(
        F.count("*").alias("rows"), F.count("value").alias("valid"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.sum("value").alias("total"), _count(F.col("evaluated")).alias("evaluated"),
        _count(F.col("violated")).alias("violated"),
        F.min(F.when(F.col("evaluated"), F.col(position))).alias("first_seen"),
        _count(F.col("lower").isNull() & ~is_blank(F.col("tolerance_raw"))).alias("unreadable"),
        F.max(F.col("has_tolerance").cast("int")).alias("has_tolerance"),
    )
    usual = F.max(
        F.when(
            F.col("evaluated") > 0,
            F.struct("evaluated", (-F.col("first_seen")).alias("s"), F.col("lower").alias("l"), F.col("upper").alias("u")),
        )
    )
    merged = by_bounds.groupBy("parameter").agg(
        F.sum("rows").alias("rows"), F.sum("valid").alias("valid_count"), F.min("low").alias("minimum"),
        F.max("high").alias("maximum"), F.sum("total").alias("_total"), usual.alias("_usual"),
        F.sum("evaluated").alias("evaluable_count"), F.sum("violated").alias("violation_count"),
        F.sum("unreadable").alias("_unreadable"), _count(F.col("lower").isNotNull()).alias("_pairs"),
        F.max("has_tolerance").alias("_has"),
    )
    status = (
        F.when(F.col("_has") == 0, "missing_tolerance").when(F.col("_pairs") == 0, "no_valid_tolerance")
        .when(F.col("_unreadable") > 0, "partially_invalid").otherwise("valid")
    )
    return merged.select(
        "parameter", "valid_count", (1 - F.col("valid_count") / F.col("rows")).alias("missing_rate"),
        "minimum", "maximum", F.try_divide("_total", "valid_count").alias("mean"),
        F.col("_usual.l").alias("usual_lower"), F.col("_usual.u").alias("usual_upper"),
        "evaluable_count", "violation_count",
        F.try_divide("violation_count", "evaluable_count").alias("violation_rate"),
        status.alias("tolerance_status"),
    )


def violations(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    return evaluated.where("violated").select(*keys, "parameter", "value", "lower", "upper", "tolerance_raw")


def record_verdicts(records: DataFrame, evaluated: DataFrame, keys: Sequence[str], state: str | None = "state") -> DataFrame:
    """Recorded and recomputed verdict of every record, with the conflict flag."""
    counts = evaluated.groupBy(*keys).agg(
        _count(F.col("evaluated")).alias("evaluated_parameter_count"),
        _count(F.col("violated")).alias("tolerance_violation_count"),
    )
    joined = records.join(counts, list(keys), "left").fillna(
        0, ["evaluated_parameter_count", "tolerance_violation_count"]
    )
    recorded = test_state(F.col(state)) if state else F.lit("UNKNOWN")
    return (
        joined.withColumn("state_result", recorded)
        .withColumn(
            "tolerance_result",
            verdict(F.col("evaluated_parameter_count"), F.col("tolerance_violation_count")),
        )
        .withColumn("judgement_conflict", verdicts_conflict(F.col("state_result"), F.col("tolerance_result")))
    )


def _nok(column: str) -> Column:
    return _count(F.col(column) == "NOK")


def _known_rate(column: str) -> Column:
    return F.try_divide(_nok(column), _count(F.col(column) != "UNKNOWN"))


def group_quality(records: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Verdict counts and rates per dimension value; all-blank dimensions are left out."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value")) for name in dimensions
    ])
    spread = records.select(F.explode(pairs).alias("_d"), "state_result", "tolerance_result", "judgement_conflict")
    groups = spread.groupBy("_d.dimension", "_d.value").agg(
        F.count("*").alias("record_count"), _nok("state_result").alias("state_nok_count"),
        _known_rate("state_result").alias("state_nok_rate"),
        _nok("tolerance_result").alias("tolerance_nok_count"),
        _known_rate("tolerance_result").alias("tolerance_nok_rate"),
        _count(F.col("judgement_conflict")).alias("conflict_count"),
    )
    used = groups.where(~is_blank(F.col("value"))).select("dimension").distinct()
    return groups.join(used, "dimension", "left_semi")


def quality_trend(records: DataFrame, time: str) -> DataFrame:
    """Daily counts and shares; the shares divide by all records of the day."""
    return records.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(
        F.count("*").alias("records"),
        (_nok("state_result") / F.count("*")).alias("state_nok_rate"),
        (_nok("tolerance_result") / F.count("*")).alias("tolerance_nok_rate"),
    )


def categorical_stats(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Value counts and shares of non-blank text per field."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("field"), blank_to_null(F.col(f"`{name}`")).alias("value")) for name in fields
    ])
    counts = (
        records.select(F.explode(pairs).alias("_p")).select("_p.*").where("value is not null")
        .groupBy("field", "value").agg(F.count("*").alias("value_count"))
    )
    totals = counts.groupBy("field").agg(F.sum("value_count").alias("_total"))
    return counts.join(totals, "field").select(
        "field", "value", "value_count", (F.col("value_count") / F.col("_total")).alias("share")
    )


def quality_summary(records: DataFrame, time: str | None) -> DataFrame:
    """One row of totals; rates divide by the records with a known verdict."""
    stamp = F.col(time) if time else F.lit(None).cast("timestamp_ntz")
    return records.agg(
        F.count("*").alias("record_count"), _count(F.col("state_result") == "OK").alias("state_ok_count"),
        _nok("state_result").alias("state_nok_count"), _known_rate("state_result").alias("state_nok_rate"),
        _nok("tolerance_result").alias("tolerance_nok_count"),
        _known_rate("tolerance_result").alias("tolerance_nok_rate"),
        F.coalesce(F.sum("tolerance_violation_count"), F.lit(0)).alias("violation_event_count"),
        _count(F.col("judgement_conflict")).alias("judgement_conflict_count"),
        F.min(stamp).alias("date_start"), F.max(stamp).alias("date_end"),
    )


def top_violations(stats: DataFrame, limit: int = 15) -> DataFrame:
    """The parameters with most violations (a top-k report)."""
    return stats.orderBy(F.col("violation_count").desc(), "parameter").limit(limit)


# ---------------------------------------------------------------- validation reports

def _report(rows: DataFrame, entries: Sequence[tuple[Column, str, str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into (level, item, result) rows; entries hold a condition."""
    items = F.array(*[
        F.when(condition, F.struct(F.lit(level).alias("level"), F.lit(item).alias("item"), result.cast("string").alias("result")))
        for condition, level, item, result in entries
    ])
    return rows.select(F.explode(F.filter(items, lambda entry: entry.isNotNull())).alias("_e")).select("_e.*")


def _null_cells(columns: Sequence[str]) -> Column:
    return F.coalesce(
        F.sum(reduce(lambda a, b: a + b, [F.col(f"`{name}`").isNull().cast("bigint") for name in columns])), F.lit(0)
    )


def validate_products(products: DataFrame, position: str | None = None) -> DataFrame:
    """Errors, warnings and metrics of a product table as report rows.

    ``position`` names the column that holds the row order; order checks need it.
    """
    columns = [name for name in products.columns if name != position]
    missing = sorted({"global_order", "camera", "e_image_path"} - set(columns))
    has_order, has_camera = "global_order" in columns, "camera" in columns
    number = F.col("global_order").try_cast("double") if has_order else F.lit(None).cast("double")
    sums = products.agg(
        F.count("*").alias("n"), _null_cells(columns).alias("nulls"),
        F.count_if(number.isNull()).alias("invalid"),
        (F.count("*") - F.count_distinct(number) - F.least(F.count_if(number.isNull()), F.lit(1))).alias("duplicates"),
        F.min(number).alias("low"), F.max(number).alias("high"),
        (F.array_join(F.sort_array(F.collect_set(F.col("camera").cast("string"))), ", ") if has_camera else F.lit("-")).alias("cameras"),
    )
    if has_order and position:
        placed = rank_in_groups(
            rank_in_groups(products.where(number.isNotNull()).select(number.alias("_v"), position), [], [position], "_p"),
            [], ["_v", position], "_o",
        )
        sums = sums.crossJoin(placed.agg(F.count_if(F.col("_p") != F.col("_o")).alias("unordered")))
    else:
        sums = sums.withColumn("unordered", F.lit(0))
    full, some = F.col("n") > 0, F.col("n")
    always = F.lit(True)
    return _report(sums, [
        (F.lit(bool(missing)), "error", "missing_columns", F.lit(", ".join(missing))),
        (F.lit(not {"a_image_path", "v_image_path"} & set(columns)), "error", "missing_image_path", F.lit("a_image_path")),
        (~full, "error", "empty", F.lit("no rows")),
        (full & F.lit(has_order) & (F.col("invalid") > 0), "error", "invalid_order", F.col("invalid")),
        (full & F.lit(has_order) & (F.col("duplicates") > 0), "error", "duplicate_order", F.col("duplicates")),
        (full & (F.col("unordered") > 0), "error", "order_not_increasing", F.col("unordered")),
        (full & (F.col("nulls") > 0), "warning", "empty_cells", F.col("nulls")),
        (full & F.col("low").isNotNull(), "info", "order_range",
         F.concat_ws("~", F.col("low").cast("bigint").cast("string"), F.col("high").cast("bigint").cast("string"))),
        (full, "info", "product_count", some), (full, "info", "column_count", F.lit(len(columns))),
        (full, "info", "null_cells", F.col("nulls")), (always & full, "info", "cameras", F.col("cameras")),
    ])


def validate_parameters(parameters: DataFrame) -> DataFrame:
    """Key presence, numeric columns and duplicates of a process-parameter table."""
    from linewise.fixed_values import EXACT_KEYS, TIME_KEYS

    columns = parameters.columns
    exact = [name for name in EXACT_KEYS if name in columns]
    timed = [name for name in TIME_KEYS if name in columns]
    numeric = numeric_columns(parameters, exclude=("global_order",))
    repeated = (F.count("*") - F.count_distinct(exact[0]) - F.least(F.count_if(F.col(exact[0]).isNull()), F.lit(1))) if exact else F.lit(0)
    sums = parameters.agg(F.count("*").alias("n"), _null_cells(columns).alias("nulls"), repeated.alias("repeated"))
    full = F.col("n") > 0
    return _report(sums, [
        (~full, "error", "empty", F.lit("no rows")),
        (full & F.lit(not exact and not timed), "error", "missing_key", F.lit(", ".join(EXACT_KEYS + TIME_KEYS))),
        (full & F.lit(not numeric), "error", "no_numeric_parameter", F.lit("0")),
        (full & (F.col("repeated") > 0), "warning", "duplicate_key", F.col("repeated")),
        (full, "info", "record_count", F.col("n")), (full, "info", "numeric_parameters", F.lit(len(numeric))),
        (full, "info", "join_keys", F.lit(", ".join(exact + timed) or "none")),
        (full, "info", "null_cells", F.col("nulls")),
    ])


def validate_defects(defects: DataFrame) -> DataFrame:
    missing = sorted({"global_order", "center_x", "center_y", "component_area"} - set(defects.columns))
    touched = F.count_distinct("global_order") if "global_order" in defects.columns else F.lit(0)
    sums = defects.agg(F.count("*").alias("n"), touched.alias("orders"))
    always = F.lit(True)
    return _report(sums, [
        (F.lit(bool(missing)), "error", "missing_columns", F.lit(", ".join(missing))),
        (always, "info", "defect_count", F.col("n")), (always, "info", "product_count", F.col("orders")),
    ])


def report_with_issues(report: DataFrame, issues: DataFrame) -> DataFrame:
    """Stack a report and source issues (level, dmc_raw, file, issue) into report rows."""
    text = F.concat_ws("; ", F.col("issue"), blank_to_null(F.col("file")))
    return report.unionByName(
        issues.select("level", F.concat_ws(" ", F.lit("product"), "dmc_raw").alias("item"), text.alias("result"))
    )


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [name for name, kind in df.dtypes if (kind in kinds or kind.startswith("decimal")) and name not in exclude]
