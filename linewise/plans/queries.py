"""Named queries over whole tables; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise import functions as fn
from linewise.config import AnalysisConfig
from linewise.operators import evidence, ordering, process, quality, relations, sequence, spatial, truth
from linewise.operators.joining import match_join
from linewise.plans import analysis, views
from linewise.session import cut_lineage
from linewise.sources import images, starschema as star, stations, tables, worksheets
from linewise.streaming import replay, trend

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = AnalysisConfig()
CODE_KEYS = [*sequence.CODE_GROUP, "canonical_code"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on row order in their last digits; reports show fewer decimals."""
    return df.withColumns({name: F.round(F.col(name), digits) for name in names})


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    catalog, _ = evidence.load_catalog(evidence.builtin_catalog(spark))
    return cut_lineage(evidence.normalize_codes(star.ordered_passes(spark, folder), catalog))


# ------------------------------------------------------------------- scalar functions

@query
def scalar_pass_codes(spark, folder):
    rows = star.passes(spark, folder)
    aoi, vi = fn.aoi_code(F.col("aoi_failure_code")), fn.vi_code(F.col("block_code"))
    return rows.select(
        "event_id", fn.norm_key(F.col("source_sheet")).alias("sheet_key"), fn.pass_state(F.col("state_raw")).alias("state"),
        fn.scope_of_station(F.col("station_id")).alias("scope"), aoi.alias("aoi_code"), vi.alias("vi_code"),
        fn.aoi_code_status(aoi, F.col("state")).alias("aoi_status"), fn.vi_code_status(vi, F.col("state")).alias("vi_status"),
    )


@query
def scalar_number_text(spark, folder):
    return star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fn.number_text(F.col("l_quantity")).alias("quantity_text"),
        fn.number_text(F.col("l_discount")).alias("discount_text"),
    )


@query
def scalar_test_state(spark, folder):
    return star.orders_as_records(spark, folder).select("source_row", fn.test_state(F.col("state")).alias("state_result"))


@query
def scalar_mixed_dates(spark, folder):
    ts = F.col("ts")
    text = (
        F.when(F.col("user_id") % 5 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("user_id") % 5 == 1, F.date_format(ts, "dd/MM/yyyy HH:mm"))
        .when(F.col("user_id") % 5 == 2, F.date_format(ts, "dd.MM.yyyy")).when(F.col("user_id") % 5 == 3, F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .otherwise(F.concat(F.lit("not a date "), F.date_format(ts, "yyyy")))
    )
    return star.table(spark, folder, "events").select("event_id", fn.mixed_timestamp(text).alias("read_time"))


@query
def scalar_tolerance_bounds(spark, folder):
    rows = quality.with_tolerance(star.measurements(spark, folder))
    return rows.groupBy("parameter", "tolerance_raw", "lower", "upper", "value", "evaluated", "violated").agg(F.count("*").alias("cells"))


@query
def scalar_image_names(spark, folder):
    return images.parse_image_names(star.image_files(spark, folder)).select(
        "event_id", "dmc_raw", "capture_date", "family_code", F.col("view").alias("view_code")
    )


def _blobs(spark: SparkSession, folder: str) -> DataFrame:
    cameras = F.array(*map(F.lit, ["5S", "5X", "7S", "7X"]))
    quantity, line = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    return star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.get(cameras, F.pmod("l_suppkey", F.lit(4)).cast("int")).alias("camera"),
        quantity.alias("width"), (quantity * line).alias("height"), F.floor(F.col("l_discount") * 100 * F.col("l_quantity") * F.col("l_quantity")).cast("int").alias("component_area"),
        F.lit(100).alias("image_width"), F.lit(120).alias("image_height"),
        (F.lit(1600) + F.pmod("l_partkey", F.lit(40))).cast("int").alias("reference_width"), F.lit(1920).alias("reference_height"),
        (quantity + 0.25).alias("center_x"), (quantity + 0.5).alias("center_y"), quantity.alias("bbox_x1"), quantity.alias("bbox_y1"),
        (quantity + 3).alias("bbox_x2"), (quantity * 2 + 3).alias("bbox_y2"),
    )


@query
def scalar_blob_types(spark, folder):
    typed = spatial.classify_blobs(_blobs(spark, folder), CONFIG.profile_frame(spark))
    return typed.groupBy("camera", "width", "height", "component_area", "detection_type").agg(F.count("*").alias("blobs"))


@query
def scalar_reference_coordinates(spark, folder):
    mapped = spatial.map_to_reference(_blobs(spark, folder))
    rows = mapped.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "center_x", "center_y", "center_x_norm", "center_y_norm",
        *[F.col(name).cast("bigint").alias(name) for name in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")],
    )
    return rounded(rows, "center_x", "center_y", "center_x_norm", "center_y_norm")


def _warps(ordered: DataFrame) -> DataFrame:
    angle = F.col("value") / 10000
    return ordered.where(F.col("event_type") != "purchase").select(
        (F.col("seq") + 1).alias("global_order"), (F.lit(1.0) - angle / 8).alias("m00"), (-angle).alias("m01"), (F.col("value") / 100).alias("m02"),
        angle.alias("m10"), (F.lit(1.0) - angle / 8).alias("m11"), F.lit(-2.0).alias("m12"),
        F.when(F.col("event_type") != "error", F.lit(1.0) - F.col("value") / 200).alias("score"),
        F.lit(512.0).alias("frame_width"), F.lit(384.0).alias("frame_height"),
    )


@query
def scalar_registration(spark, folder):
    rows = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    aligned = spatial.apply_registration(star.detections_of_passes(rows), _warps(rows), CONFIG.registration_min_score)
    return rounded(
        aligned.select("detected_id", "aligned_x_norm", "aligned_y_norm", "registration_score", "registration_quality"),
        "aligned_x_norm", "aligned_y_norm", "registration_score",
    )


@query
def scalar_detection_verdicts(spark, folder):
    """Confusion counts of recorded verdict against detection, per scope."""
    rows = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    products = process.defect_counts(star.products_of_passes(rows), star.detections_of_passes(rows))
    verdict = fn.detection_verdict(F.col("aoi_state"), F.col("has_detected_defect") == 1)
    return products.groupBy("analysis_scope", verdict.alias("verdict")).agg(F.count("*").alias("products"))


@query
def filter_search_parts(spark, folder):
    return views.search_all_columns(star.table(spark, folder, "part"), "RED*BOLT").select("p_partkey", "p_name")


@query
def filter_products_and_detections(spark, folder):
    products = views.filter_products(
        star.orders_as_products(spark, folder), scope="F", batch="2-HIGH",
        times=(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-12-31").cast("timestamp_ntz")),
    )
    kept, detections = views.filter_detections(products, star.returned_lines(spark, folder), "Brand#3")
    counts = detections.groupBy("global_order").agg(F.count("*").alias("detections"))
    return kept.join(counts, "global_order").select("global_order", "batch", "detections")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return star.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat_ws(";", "l_partkey", F.lit("bad"), F.concat("l_suppkey", F.lit(".0")), F.col("l_orderkey") * 3).alias("orders_text"),
    )


@query
def filter_order_lists(spark, folder):
    wanted = star.table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("global_order"))
    return views.filter_order_evidence(_listed(spark, folder), wanted, ("orders_text",), ("l_orderkey",)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


@query
def remap_order_lists(spark, folder):
    mapping = star.table(spark, folder, "orders").select(F.col("o_orderkey").alias("from_order"), F.col("o_custkey").alias("to_order"))
    return views.remap_order_lists(_listed(spark, folder), "orders_text", mapping)


# ----------------------------------------------------------------------------- sources

@query
def station_catalog_checks(spark, folder):
    """Checks of the station catalog as used by the passes (unused stations are missing)."""
    used = star.passes(spark, folder).select("station_id").distinct()
    return stations.check_stations(stations.stations(spark).join(used, "station_id", "left_semi"), stations.image_profiles(spark), expected=17)


@query
def station_usage(spark, folder):
    rows = star.passes(spark, folder).groupBy("station_id").agg(F.count("*").alias("passes"))
    catalog = stations.stations(spark).join(stations.image_profiles(spark), "image_profile")
    return rows.join(F.broadcast(catalog), "station_id").select(
        "station_id", "station_group", "location", "image_profile", "family_code", F.size("views").cast("bigint").alias("views"), "passes"
    )


def _catalog_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    parts = star.table(spark, folder, "part")
    override = parts.select(
        (F.col("p_partkey") + 2).alias("row"), F.when(F.col("p_size") % 3 == 0, "L5").when(F.col("p_size") % 3 == 1, "layer 7").otherwise("9").alias("Layer"),
        F.concat(F.lit("c"), (F.lit(5000) + F.col("p_partkey") % 90).cast("string")).alias("CODE"), F.col("p_name").alias("Name"),
        F.col("p_brand").alias("region"), F.when(F.col("p_size") % 5 == 0, "Off").otherwise("yes").alias("enabled"),
    )
    return evidence.builtin_catalog(spark), override


@query
def catalog_override(spark, folder):
    catalog, _ = evidence.load_catalog(*_catalog_sources(spark, folder))
    return catalog.select("layer", "code", "name", "region", "enabled", "source", F.col("row").alias("source_row"))


@query
def catalog_issues(spark, folder):
    _, issues = evidence.load_catalog(*_catalog_sources(spark, folder))
    return issues.select(F.col("source").cast("bigint").alias("source"), F.col("row").alias("source_row"), "issue")


@query
def catalog_code_names(spark, folder):
    catalog, _ = evidence.load_catalog(*_catalog_sources(spark, folder))
    return evidence.catalog_names(catalog)


@query
def image_product_index(spark, folder):
    parsed = images.parse_image_names(star.image_files(spark, folder))
    products, _ = images.product_index(parsed, stations.stations(spark), stations.image_profiles(spark), star.expected_products(spark, folder))
    return images.number_products(products).drop("task_order", "order_code", "station_location")


@query
def image_issues(spark, folder):
    parsed = images.parse_image_names(star.image_files(spark, folder))
    _, issues = images.product_index(parsed, stations.stations(spark), stations.image_profiles(spark), star.expected_products(spark, folder))
    return issues.groupBy("level", "station_id", "issue").agg(F.count("*").alias("files"), F.count_distinct("dmc_raw").alias("products"))


@query
def declared_location_mismatches(spark, folder):
    rows = star.passes(spark, folder)
    codes = [row["location"] for row in stations.stations(spark).collect()]  # the fixed 18 locations
    declared = F.when(F.col("event_type") == "view", "").otherwise(
        F.get(F.array(*map(F.lit, sorted(codes))), F.pmod(F.col("user_id") * 5, F.lit(len(codes))).cast("int"))
    )
    sources = rows.select(F.concat_ws("/", "batch", "station_id", "event_type").alias("source"), "station_id", declared.alias("location")).distinct()
    return stations.location_mismatches(sources, stations.stations(spark))


def _sheet_tables(spark, folder):
    blocks = worksheets.worksheet_blocks(star.worksheet_rows(spark, folder))
    return worksheets.station_tables(blocks, stations.stations(spark))


@query
def worksheet_events(spark, folder):
    events, _, _ = _sheet_tables(spark, folder)
    return events.select(
        "event_id", "dmc_raw", "station_id", "station_title", "test_date", "state", "source_file", "source_sheet", "source_row",
        "ttnr", "aoi_failure_code", "block_code", "failure_codes", F.col("parameter_count").cast("bigint").alias("parameter_count"),
    )


@query
def worksheet_parameters(spark, folder):
    _, parameters, _ = _sheet_tables(spark, folder)
    return parameters.select("source_file", "event_id", "parameter_name", "raw_value", "numeric_value", "tolerance_raw", "parameter_type")


@query
def worksheet_unresolved(spark, folder):
    events, _, _ = _sheet_tables(spark, folder)
    return worksheets.unresolved_events(events).groupBy("line", "st", "wp").agg(F.count("*").alias("passes"))


@query
def measurement_records(spark, folder):
    rows = star.measurement_sheet_rows(spark, folder)
    records = worksheets.measurement_records(rows, worksheets.measurement_layout(rows))
    return records.select("file", "source_row", "dmc_raw", "state", "variant", "batch", "ttnr", "line", "test_date", "result_timestamp", "timestamp", "profile")


@query
def measurement_parameter_specs(spark, folder):
    rows = star.measurement_sheet_rows(spark, folder)
    return worksheets.parameter_specs(worksheets.measurement_tall(rows, worksheets.measurement_layout(rows))).select(
        "file", "parameter", "lower", "upper", "unreadable_count", "parse_status"
    )


# ------------------------------------------------------------------- passes and truth

@query
def production_order(spark, folder):
    return star.ordered_passes(spark, folder).select("event_id", "station_id", "test_date", "production_order")


@query
def scope_and_task_order(spark, folder):
    orders = star.orders_as_products(spark, folder).select("global_order", "analysis_scope", "production_timestamp")
    numbered = ordering.number_rows(orders, ["production_timestamp", "global_order"], "task_order")
    return ordering.rank_in_groups(numbered, ["analysis_scope"], ["task_order"], "scope_order").select(
        "global_order", "analysis_scope", "task_order", "scope_order"
    )


@query
def union_parts_renumbered(spark, folder):
    """Parts with different columns stacked and numbered anew."""
    first = star.table(spark, folder, "supplier").select(F.col("s_name").alias("dmc_raw"), F.lit("supplier").alias("part"), F.col("s_nationkey").alias("nation"))
    second = star.table(spark, folder, "customer").select(F.col("c_name").alias("dmc_raw"), F.lit("customer").alias("part"), F.col("c_mktsegment").alias("segment"))
    return ordering.number_rows(first.unionByName(second, allowMissingColumns=True), ["part", "dmc_raw"], "global_order")


@query
def clean_pass_history(spark, folder):
    counts = star.pass_parameters(spark, folder).groupBy("event_id").agg(F.count("*").alias("parameter_count"))
    rows = star.passes(spark, folder).withColumn("test_date", F.date_trunc("day", "test_date").cast("timestamp_ntz"))
    events = rows.join(counts, "event_id", "left").fillna(0, ["parameter_count"])
    cleaned = worksheets.clean_events(events.select("event_id", "dmc_raw", "station_id", "test_date", "source_sheet", "source_row", "parameter_count"))
    return cleaned.select("event_id", "dmc_raw", "station_id", "test_date", "parameter_count")


@query
def first_product_fields(spark, folder):
    return worksheets.first_product_fields(star.passes(spark, folder))


@query
def latest_process_values(spark, folder):
    return worksheets.latest_process_values(star.pass_parameters(spark, folder))


WORK_STATIONS = [f"{line}_wp{place}" for line in ("35", "57") for place in range(1, 6)]


@query
def process_value_pivot(spark, folder):
    latest = worksheets.latest_process_values(star.pass_parameters(spark, folder))
    names = [f"{station}.Result.{name}" for station in WORK_STATIONS for name in ("Value", "K")]
    wide = worksheets.process_frame(latest, names)
    return wide.select("dmc_raw", *[F.col(f"`{name}`").alias(name.replace(".", "_").lower()) for name in names])


def _asked_products(spark, folder):
    moved = F.date_add(F.to_date("test_date"), F.when(F.col("value") > 60, 1).otherwise(0))
    return star.passes(spark, folder).where("station_type = 'aoi'").select(
        "station_id", "dmc_raw", moved.alias("capture_date"), (F.col("event_type") != "signup").alias("has_primary_pair")
    ).distinct()


@query
def truth_match(spark, folder):
    events = star.ordered_passes(spark, folder).where("station_type = 'aoi'")
    return truth.match_truth(_asked_products(spark, folder), events).select(
        "station_id", "dmc_raw", "capture_date", "has_primary_pair", "aoi_event_id", "aoi_test_date", "aoi_state", "production_order",
        "truth_match", "event_match_status", "evidence_status",
    )


def _followed(spark, folder):
    ordered = star.ordered_passes(spark, folder)
    products = star.products_of_passes(ordered)
    return truth.match_followup(products, ordered.where("station_type = 'vi'"), star.follow_up(spark)), ordered


@query
def followup_match(spark, folder):
    products, _ = _followed(spark, folder)
    return products.select("global_order", "station_id", "dmc_raw", "vi_event_id", "vi_test_date", "vi_state", "vi_defect_code")


def _mapped(spark, folder):
    products, ordered = _followed(spark, folder)
    products = cut_lineage(products)
    catalog, _ = evidence.load_catalog(evidence.builtin_catalog(spark))
    codes = cut_lineage(evidence.normalize_codes(ordered, catalog))
    return products, ordered, cut_lineage(evidence.map_codes(products, codes))


@query
def normalized_codes(spark, folder):
    return _codes(spark, folder).select(
        "analysis_scope", "station_id", "event_id", "dmc_raw", "production_order", "source_type", "raw_code", "canonical_code",
        "defect_name", "state", "code_status",
    )


@query
def code_product_links(spark, folder):
    _, _, mapped = _mapped(spark, folder)
    return mapped.select("analysis_scope", "source_type", "event_id", "dmc_raw", "canonical_code", "code_status", "global_order")


@query
def unsequenced_detections(spark, folder):
    """Detections whose product has no clear event keep their rows but leave the sequence."""
    ordered = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    clear = star.products_of_passes(ordered).where("evidence_status = 'evaluable'").select("global_order")
    return star.detections_of_passes(ordered).join(clear, "global_order", "left_anti").select("detected_id", "global_order", "station_id", "detection_type")


@query
def product_timelines(spark, folder):
    return truth.timelines(star.passes(spark, folder)).select("dmc_raw", "visit", "test_date", "station_id", "state")


@query
def recent_product_parameters(spark, folder):
    return truth.recent_parameters(star.pass_parameters(spark, folder)).select("dmc_raw", "event_id", "parameter_name", "numeric_value", "recency")


# -------------------------------------------------------------------------- sequences

@query
def longest_code_runs(spark, folder):
    codes = _codes(spark, folder)
    return sequence.longest_run(sequence.defect_code_orders(codes), CODE_KEYS, "production_order")


@query
def burst_runs(spark, folder):
    """All bursts of any pass kind at a station."""
    ordered = star.ordered_passes(spark, folder)
    runs = ordering.consecutive_runs(ordered, ["station_id", "event_type"], "production_order")
    return runs.where(F.col("run_length") >= CONFIG.burst_minimum_length)


def _carrier(spark, folder):
    slots = star.carrier_slots(spark, folder)
    return slots.where("flag <> 'A'"), slots


@query
def period_of_carrier_places(spark, folder):
    observed, slots = _carrier(spark, folder)
    return sequence.fit_period(observed, ["place"], "position", CONFIG, slots, [])


@query
def period_of_carrier_places_wide(spark, folder):
    """The longest legal period range."""
    observed, slots = _carrier(spark, folder)
    return sequence.fit_period(observed, ["place"], "position", AnalysisConfig(maximum_period=1_000_000), slots, [])


@query
def period_of_carrier_places_tolerant(spark, folder):
    observed, slots = _carrier(spark, folder)
    config = AnalysisConfig(period_order_tolerance=1, minimum_period_coverage=0.3)
    return sequence.fit_period(observed, ["place"], "position", config, slots, [])


@query
def missing_carrier_slots(spark, folder):
    observed, slots = _carrier(spark, folder)
    fits = cut_lineage(sequence.fit_period(observed, ["place"], "position", CONFIG, slots, []))
    return sequence.missing_slots(fits, observed, ["place"], "position", slots, [])


@query
def carrier_slot_schedule(spark, folder):
    observed, slots = _carrier(spark, folder)
    fits = cut_lineage(sequence.fit_period(observed, ["place"], "position", CONFIG, slots, []))
    return sequence.slot_schedule(fits, ["place"], slots, [], "position", CONFIG.warning_lead_products)


@query
def carrier_evidence_strip(spark, folder):
    observed, slots = _carrier(spark, folder)
    fits = cut_lineage(sequence.fit_period(observed, ["place"], "position", CONFIG, slots, []))
    missing = sequence.missing_slots(fits, observed, ["place"], "position", slots, []).withColumnRenamed("missing_order", "position")
    info = slots.groupBy("position").agg(F.when(F.count("*") > 3, "unavailable").otherwise("evaluable").alias("evidence_status"))
    return sequence.evidence_strip(observed, missing, info, ["place"], "position")


@query
def code_patterns(spark, folder):
    return sequence.code_patterns(_codes(spark, folder), CONFIG)


@query
def code_patterns_merged(spark, folder):
    return sequence.code_patterns(_codes(spark, folder), CONFIG, ["5011", "5020"], merge=True)


@query
def code_pattern_links(spark, folder):
    products, ordered, mapped = _mapped(spark, folder)
    catalog, _ = evidence.load_catalog(evidence.builtin_catalog(spark))
    codes = cut_lineage(evidence.normalize_codes(ordered, catalog))
    patterns = cut_lineage(sequence.code_patterns(codes, CONFIG, with_ids=False))
    return sequence.pattern_image_links(codes, patterns, mapped)


@query
def code_order_lists(spark, folder):
    return ordering.order_list_parts(sequence.defect_code_orders(_codes(spark, folder)), CODE_KEYS, "production_order")


@query
def neighbour_defects(spark, folder):
    return relations.neighbour_defects(star.returned_lines(spark, folder))


@query
def nearest_existing_orders(spark, folder):
    asked = star.table(spark, folder, "lineitem").select((F.col("l_partkey") * 3 + F.col("l_linenumber")).alias("asked_order"))
    existing = star.returned_lines(spark, folder).select("global_order")
    return views.nearest_orders(asked, existing)


@query
def average_ranks(spark, folder):
    rows = star.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    return process.average_rank(rows, ["l_returnflag"], "l_quantity")


# ------------------------------------------------------------------ measurement quality

def _evaluated(spark, folder):
    return quality.with_tolerance(star.measurements(spark, folder))


def _verdicts(spark, folder):
    return quality.record_verdicts(star.orders_as_records(spark, folder), _evaluated(spark, folder), ["source_row"])


@query
def parameter_statistics(spark, folder):
    return rounded(quality.parameter_stats(_evaluated(spark, folder), "source_row"), "mean", "missing_rate", "violation_rate")


@query
def tolerance_violations(spark, folder):
    return quality.violations(_evaluated(spark, folder), ["source_row"])


@query
def record_verdicts(spark, folder):
    return _verdicts(spark, folder).select(
        "source_row", "state_result", "tolerance_result", "judgement_conflict", "evaluated_parameter_count", "tolerance_violation_count"
    )


@query
def group_quality(spark, folder):
    return quality.group_quality(_verdicts(spark, folder), ["variant", "batch", "line", "ttnr"])


@query
def quality_trend(spark, folder):
    return quality.quality_trend(_verdicts(spark, folder), "timestamp")


@query
def quality_trend_windows(spark, folder):
    windows = trend.live_trend(_verdicts(spark, folder), "timestamp", width="7 days")
    return windows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "records", "state_nok_rate", "tolerance_nok_rate")


@query
def quality_trend_sliding(spark, folder):
    """Two weeks, every week."""
    windows = trend.live_trend(_verdicts(spark, folder), "timestamp", width="14 days", slide="7 days")
    return windows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "records", "state_nok_rate", "tolerance_nok_rate")


@query
def quality_sessions(spark, folder):
    """Records of a variant on a line without a pause of ten days."""
    found = trend.live_sessions(_verdicts(spark, folder), "timestamp", ["variant", "line"], "10 days")
    return found.select(
        "variant", "line", *[F.col(name).cast("timestamp_ntz").alias(name) for name in ("session_start", "session_end")], "records", "state_nok_rate", "tolerance_nok_rate"
    )


@query
def quality_summary(spark, folder):
    return quality.quality_summary(_verdicts(spark, folder), "timestamp")


@query
def categorical_statistics(spark, folder):
    return quality.categorical_stats(star.passes(spark, folder), ["aoi_failure_code", "block_code", "source_sheet", "ttnr"])


@query
def top_violated_parameters(spark, folder):
    rows = quality.with_tolerance(star.measurements(spark, folder).withColumn("parameter", F.concat_ws("@", "parameter", "tolerance_raw")))
    return quality.top_violations(quality.parameter_stats(rows, "source_row"), 15).select("parameter", "violation_count", "evaluable_count")


@query
def validate_products(spark, folder):
    rows = star.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("global_order"), F.col("l_returnflag").alias("camera"),
        F.when(F.col("l_linenumber") < 6, F.lit("e.png")).alias("e_image_path"), F.lit("a.png").alias("a_image_path"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax").alias("position"),
    )
    return quality.validate_products(rows, "position")


@query
def validate_parameters(spark, folder):
    return quality.validate_parameters(star.process_parameters(spark, folder))


@query
def validate_defects(spark, folder):
    rows = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    return quality.validate_defects(star.detections_of_passes(rows).withColumnRenamed("center_x_norm", "center_x"))


@query
def quality_report(spark, folder):
    """Validation report with the image issues stacked below it."""
    parsed = images.parse_image_names(star.image_files(spark, folder))
    _, issues = images.product_index(parsed, stations.stations(spark), stations.image_profiles(spark))
    report = quality.report_with_issues(quality.validate_parameters(star.process_parameters(spark, folder)), issues)
    return report.groupBy("level", "item").agg(F.count("*").alias("entries"), F.min("result").alias("first_result"))


# ---------------------------------------------------------------- relations, evidence

@query
def defect_cooccurrence(spark, folder):
    events = relations.category_events(star.returned_lines(spark, folder))
    return relations.cooccurrence(star.orders_as_products(spark, folder), events)


@query
def defect_transitions(spark, folder):
    return relations.transitions(relations.category_events(star.returned_lines(spark, folder)))


@query
def code_spatial_associations(spark, folder):
    products, ordered, mapped = _mapped(spark, folder)
    return evidence.code_spatial(products, mapped, star.detections_of_passes(ordered))


@query
def code_spatial_support(spark, folder):
    _, ordered, mapped = _mapped(spark, folder)
    return evidence.code_spatial_support(mapped, star.detections_of_passes(ordered))


@query
def label_conflicts(spark, folder):
    products, _, mapped = _mapped(spark, folder)
    return evidence.label_conflicts(products, mapped)


def _upstream_inputs(spark, folder):
    rows = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    sites = rows.select(
        (F.col("seq") + 1).alias("global_order"), "dmc_raw", "station_id", F.col("test_date").alias("aoi_test_date"),
        F.when(F.col("value") >= 110, "ambiguous_event").otherwise("evaluable").alias("evidence_status"),
    )
    spots = star.detections_of_passes(rows, only_aoi=False).withColumn("aligned_y_norm", F.col("center_y_norm")).withColumn(
        "trajectory_id", F.concat(F.col("station_id"), F.lit("-T"), F.floor(F.col("center_y_norm") * 10).cast("string"))
    )
    tracks = spots.select(
        "trajectory_id", "analysis_scope", "station_id", F.lit("linear_drift").alias("pattern_type"), F.lit("high").alias("registration_quality")
    ).distinct()
    return tracks, sites, spots


@query
def upstream_checks(spark, folder):
    tracks, sites, spots = _upstream_inputs(spark, folder)
    return evidence.upstream_checks(tracks, sites, spots, "aoi_test_date")


@query
def station_attribution(spark, folder):
    tracks, sites, spots = _upstream_inputs(spark, folder)
    products, ordered, mapped = _mapped(spark, folder)
    patterns = sequence.code_patterns(_codes(spark, folder), CONFIG)
    pairs = evidence.code_spatial(products, mapped, star.detections_of_passes(ordered))
    return evidence.attribution(patterns, tracks, pairs, sites, spots).select(
        "evidence_id", "analysis_scope", "station_id", "evidence_source", "pattern_type", "association_level", "equipment_conclusion"
    )


# ---------------------------------------------------------------- process parameters

def _process(spark, folder):
    products, lines = star.orders_as_products(spark, folder), star.returned_lines(spark, folder)
    joined, key = process.exact_process_join(products, star.process_parameters(spark, folder))
    joined = process.defect_counts(joined, lines)
    names = ["quantity", "price_cents", "discount_pct", "line_number"]
    return products, lines, joined, key, names


@query
def exact_process_join(spark, folder):
    _, _, joined, _, names = _process(spark, folder)
    return joined.select("global_order", *names, "ship_time", "match_quality", "detected_defect_count", "has_detected_defect")


@query
def nearest_time_join(spark, folder):
    events = star.table(spark, folder, "events").withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    left = events.where("event_type = 'error'").select("event_id", F.col("minute").alias("timestamp"))
    right = events.where("event_type = 'view'").select(F.col("event_id").alias("reading_id"), F.col("value").alias("reading"), F.col("minute").alias("read_at"))
    return process.nearest_time_join(left, right, "timestamp", "read_at", 300, ["reading_id"])


@query
def process_targets(spark, folder):
    products, ordered, mapped = _mapped(spark, folder)
    named = products.withColumn("vi_defect_code", F.regexp_replace("vi_defect_code", " ", ";"))
    return process.build_targets(named, star.detections_of_passes(ordered), mapped)


def _relation_inputs(spark, folder):
    products, lines, joined, _, names = _process(spark, folder)
    return process.tall_parameters(joined, names), process.build_targets(products, lines)


@query
def parameter_metrics(spark, folder):
    tall, targets = _relation_inputs(spark, folder)
    metrics = process.rank_parameters(process.parameter_metrics(tall, targets))
    return rounded(metrics, "missing_rate", "defect_mean", "normal_mean", "spearman", "effect_size", "minimum", "maximum", digits=4)


@query
def binned_defect_rates(spark, folder):
    tall, targets = _relation_inputs(spark, folder)
    return rounded(process.binned_rates(tall, targets), "lower", "upper", "defect_rate")


@query
def score_auc(spark, folder):
    lines = star.table(spark, folder, "lineitem").select(
        "l_linestatus", F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    return rounded(process.auc(lines, ["l_linestatus"], "score", "label"), "auc")


@query
def relationship_summary(spark, folder):
    _, _, joined, key, names = _process(spark, folder)
    return process.relationship_summary(joined, key, names)


@query
def logistic_importance(spark, folder):
    _, _, joined, _, names = _process(spark, folder)
    table, summary = process.logistic_importance(joined, names, batch="batch")
    return table.select("*", F.lit(summary["validation_method"]).alias("validation_method"), F.lit(summary["validation_auc"]).cast("double").alias("validation_auc"))


# ----------------------------------------------------------- positions, replay, views

@query
def cell_cluster_summary(spark, folder):
    summary = spatial.cluster_summary(star.detections_of_passes(star.ordered_passes(spark, folder)))
    return rounded(summary, "center_x_norm", "center_y_norm")


def _assigned(spark, folder):
    ordered = star.ordered_passes(spark, folder)
    detections = star.detections_of_passes(ordered).drop("cluster_id")
    return star.products_of_passes(ordered), spatial.assign_clusters(detections, CONFIG), ordered


@query
def leader_clusters(spark, folder):
    _, assigned, _ = _assigned(spark, folder)
    return rounded(spatial.cluster_summary(assigned), "center_x_norm", "center_y_norm")


@query
def horizontal_bands(spark, folder):
    ordered = star.ordered_passes(spark, folder)
    aligned = spatial.apply_registration(star.detections_of_passes(ordered), None, CONFIG.registration_min_score)
    bands = spatial.y_bands(aligned.where("detection_type <> 'region_anomaly'"), CONFIG.horizontal_y_tolerance_norm)
    return rounded(bands.groupBy("analysis_scope", "station_id", "band").agg(
        F.count("*").alias("detections"), F.min("aligned_y_norm").alias("lowest"), F.max("aligned_y_norm").alias("highest")
    ), "lowest", "highest")


@query
def spatial_trajectories(spark, folder):
    ordered = star.ordered_passes(spark, folder)
    aligned = spatial.apply_registration(star.detections_of_passes(ordered), _warps(ordered), CONFIG.registration_min_score)
    return rounded(
        spatial.trajectories(aligned, CONFIG)[1], "mean_y_norm", "x_span_norm", "y_span_norm", "spearman_order_x", "minimum_registration_score"
    )


@query
def alert_replay(spark, folder):
    products, assigned, _ = _assigned(spark, folder)
    return rounded(replay.replay_batch(products, assigned, CONFIG)[0], "confidence")


@query
def carrier_alerts(spark, folder):
    """All five kinds: places of a carrier recur with its length, suppliers repeat and run together."""
    return rounded(replay.replay_batch(*star.carrier_lines(spark, folder), CONFIG)[0], "confidence")


@query
def carrier_active_periods(spark, folder):
    return replay.replay_batch(*star.carrier_lines(spark, folder), CONFIG)[1]


@query
def carrier_patterns(spark, folder):
    """Periodic, burst and fixed places of the carrier lines, with the next expected order."""
    products, seen = star.carrier_lines(spark, folder)
    _, active = replay.replay_batch(products, seen, CONFIG)
    return rounded(replay.spatial_patterns(products, seen, active, CONFIG), "precision", "coverage", "confidence")


@query
def pattern_alerts(spark, folder):
    """Alerts that report a new pattern: burst, confirmed period, fixed position."""
    products, assigned, _ = _assigned(spark, folder)
    alerts = replay.replay_batch(products, assigned, CONFIG)[0]
    kinds = ["burst_detected", "periodic_pattern_confirmed", "fixed_position_repeat_confirmed"]
    return rounded(alerts.where(F.col("alert_type").isin(kinds)).select(
        "analysis_scope", "station_id", "cluster_id", "alert_type", "severity", "alert_at_order", "predicted_order", "confidence", "period", "phase"
    ), "confidence")


@query
def leader_patterns(spark, folder):
    """Final pattern classes of leader clusters."""
    products, assigned, _ = _assigned(spark, folder)
    keys = ["analysis_scope", "station_id", "cluster_id"]
    observed = cut_lineage(assigned.where("cluster_id is not null").select(*keys, "production_order"))
    return sequence.classify_sequences(
        observed, keys, "production_order", CONFIG, products, keys[:2], "fixed_position_repeat", burst_reports_run=True
    ).drop("run_start", "run_end")


@query
def spatial_patterns(spark, folder):
    products, assigned, _ = _assigned(spark, folder)
    assigned = cut_lineage(assigned)
    _, active = replay.replay_batch(products, assigned, CONFIG)
    return rounded(replay.spatial_patterns(products, assigned, active, CONFIG), "precision", "coverage", "confidence")


@query
def cell_patterns(spark, folder):
    """Patterns of coarse position cells: the same classes without order-dependent clusters."""
    ordered = star.ordered_passes(spark, folder)
    detections = star.detections_of_passes(ordered).where("cluster_id is not null")
    keys = ["analysis_scope", "station_id", "cluster_id"]
    return sequence.classify_sequences(
        detections, keys, "production_order", CONFIG, star.products_of_passes(ordered), keys[:2], "fixed_position_repeat", burst_reports_run=True
    ).drop("run_start", "run_end")


@query
def run_summary(spark, folder):
    ordered = star.ordered_passes(spark, folder)
    products, detections = star.products_of_passes(ordered), star.detections_of_passes(ordered)
    patterns = sequence.code_patterns(_codes(spark, folder), CONFIG, with_ids=False)
    alerts, _ = replay.replay_batch(products, detections, CONFIG)
    return tables.run_summary(products, detections, patterns, alerts)


@query
def filter_choices(spark, folder):
    ordered = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    return views.filter_choices(star.products_of_passes(ordered), star.detections_of_passes(ordered))


def _view(spark, folder, selected=("5020",), source="AOI_FAILURE"):
    products, ordered, mapped = _mapped(spark, folder)
    detections = star.detections_of_passes(ordered)
    codes = _codes(spark, folder)
    keys = ["analysis_scope", "station_id", "cluster_id"]
    patterns = cut_lineage(sequence.classify_sequences(
        detections.where("cluster_id is not null"), keys, "production_order", CONFIG, products, keys[:2], "fixed_position_repeat", burst_reports_run=True
    ))
    alerts = cut_lineage(replay.replay_batch(products, detections, CONFIG)[0])
    tracks = detections.select("analysis_scope", F.concat_ws("-", "station_id", "cluster_id").alias("trajectory_id"), "global_order")
    space = cut_lineage(evidence.code_spatial(products, mapped, detections))
    code_patterns = cut_lineage(sequence.code_patterns(codes, CONFIG, with_ids=False))
    frames = {
        "patterns": patterns, "alerts": alerts, "trajectories": tracks,
        "pattern_orders": detections.select(*keys, F.lit("observed").alias("role"), "global_order").distinct(),
        "alert_orders": analysis.alert_orders(alerts, detections, products, CONFIG), "trajectory_orders": tracks.select("trajectory_id", "global_order"),
        "code_pattern_orders": sequence.pattern_image_links(codes, code_patterns, mapped),
        "code_space_orders": evidence.code_spatial_support(mapped, detections),
        "code_patterns": code_patterns, "code_image_links": mapped, "code_space": space,
        "code_conflicts": evidence.label_conflicts(products, mapped), "normalized_codes": codes,
    }
    return views.result_view(frames, products, detections, CONFIG, selected, source)


@query
def view_counts(spark, folder):
    return _view(spark, folder).counts


@query
def view_section_sizes(spark, folder):
    sections = _view(spark, folder).sections
    parts = [frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("section"), "row_count") for name, frame in sections.items()]
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


@query
def view_code_cooccurrence(spark, folder):
    products, _, mapped = _mapped(spark, folder)
    links = views.code_links({"code_image_links": mapped}, products)
    return views.code_relationships(products, links, ["5020"])[0]


@query
def view_code_transitions(spark, folder):
    products, _, mapped = _mapped(spark, folder)
    links = views.code_links({"code_image_links": mapped}, products)
    return views.code_relationships(products, links, ["5020"])[1]


@query
def cluster_timeline(spark, folder):
    ordered = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    return rounded(views.cluster_timeline(star.detections_of_passes(ordered)), "center_x_norm", "center_y_norm")


@query
def alert_chart(spark, folder):
    products, assigned, _ = _assigned(spark, folder)
    both = [replay.replay_batch(*rows, CONFIG)[0] for rows in ((products, assigned), star.carrier_lines(spark, folder))]
    return views.alert_timeline(both[0].unionByName(both[1]))


@query
def best_periodic_place(spark, folder):
    observed, slots = _carrier(spark, folder)
    fits = sequence.fit_period(observed, ["place"], "position", CONFIG, slots, [])
    named = fits.withColumn("pattern_type", F.lit("periodic")).withColumn("cluster_id", F.col("place").cast("string"))
    return views.best_periodic(named).select("cluster_id", "period", "phase_start", "confidence")


@query
def preview_orders(spark, folder):
    return views.preview_orders(star.returned_lines(spark, folder), 8)


@query
def defect_counts(spark, folder):
    ordered = star.passes(spark, folder).withColumn("production_order", F.lit(None).cast("bigint"))
    return process.defect_counts(star.products_of_passes(ordered), star.detections_of_passes(ordered)).select(
        "global_order", "detected_defect_count", "has_detected_defect"
    )


@query
def common_orders(spark, folder):
    """Orders that hold both a returned line and an open line (set intersection)."""
    lines = star.table(spark, folder, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_orderkey").intersect(lines.where("l_linestatus = 'O'").select("l_orderkey"))


@query
def full_analysis_summary(spark, folder):
    """The whole defect-analysis job, down to its run summary."""
    products, ordered = _followed(spark, folder)
    products = cut_lineage(products)
    detections = star.detections_of_passes(ordered).drop("cluster_id", "production_order", "dmc_raw", "analysis_scope", "station_id")
    return analysis.analyze(products, detections, ordered, CONFIG, warps=_warps(ordered)).summary


__all__ = ["CONFIG", "QUERIES", "Column", "match_join", "query"]
