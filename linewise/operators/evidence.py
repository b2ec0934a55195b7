"""Inspection-code evidence: catalog, normalised codes, code-product links, conflicts, attribution."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.fixed_values import (
    AOI_CODE_HEADERS, DEFECT_CODES, DISABLED_WORDS, VI_CODE_HEADER, VI_SHEET_KEY,
)
from linewise.functions import (
    aoi_code, aoi_code_status, association_strength, blank_to_null, clean_text, is_blank, is_defect_status,
    layer_of_scope, norm_key, scope_of_station, vi_code, vi_code_status,
)
from linewise.operators.joining import lookup_join, match_join

CATALOG_FIELDS = ["layer", "code", "name", "region", "description", "enabled", "version"]
CODE_FIELDS = [
    "analysis_scope", "station_id", "event_id", "dmc_raw", "production_order", "test_date", "batch",
    "source_type", "source_sheet", "raw_code", "canonical_code", "defect_name", "state", "code_status",
]


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


# ------------------------------------------------------------------------- catalog

def builtin_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFECT_CODES, ", ".join(f"{name} string" for name in CATALOG_FIELDS)).coalesce(1)


def load_catalog(builtin: DataFrame, override: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, issues): later sources win per (layer, code, region); bad rows are issues."""
    parts, issues = [], []
    for rank, source in enumerate([builtin] if override is None else [builtin, override]):
        names = {header_key(name): name for name in source.columns}
        if not {"layer", "code", "name"} <= set(names):
            issues.append(source.limit(1).select(
                F.lit(rank).alias("source"), F.lit(0).cast("bigint").alias("row"),
                F.lit("missing layer/code/name column").alias("issue"),
            ))
            continue

        def text(field: str, default: str = "") -> Column:
            return clean_text(F.col(f"`{names[field]}`")) if field in names else F.lit(default)

        row = F.col("`row`").cast("bigint") if "row" in source.columns else F.monotonically_increasing_id() + 2
        read = source.select(
            F.lit(rank).alias("source"), row.alias("row"),
            F.regexp_extract(text("layer"), "[57]", 0).alias("layer"),
            F.regexp_extract(text("code"), r"\d{4}", 0).alias("code"), text("name").alias("name"),
            text("region").alias("region"), text("description").alias("description"),
            (~F.lower(text("enabled", "true")).isin(DISABLED_WORDS)).alias("enabled"),
            text("version").alias("version"),
        )
        bad = (F.col("layer") == "") | (F.col("code") == "") | (F.col("name") == "")
        issues.append(read.where(bad).select("source", "row", F.lit("invalid layer/code/name").alias("issue")))
        parts.append(read.where(~bad))
    issue_rows = issues[0]
    for more in issues[1:]:
        issue_rows = issue_rows.unionByName(more)
    if not parts:
        raise ValueError("no catalog source has layer, code and name columns")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    kept = rows.groupBy("layer", "code", "region").agg(
        F.max_by(F.struct("name", "description", "enabled", "version", "source", "row"), F.struct("source", "row")).alias("_r")
    )
    return kept.select("layer", "code", "region", "_r.*"), issue_rows


def catalog_names(catalog: DataFrame) -> DataFrame:
    """Enabled names per (layer, code), distinct, in file order, joined by ' / '."""
    return (
        catalog.where("enabled").groupBy("layer", "code")
        .agg(F.sort_array(F.collect_list(F.struct("source", "row", "name"))).alias("_n"))
        .select(
            "layer", "code",
            F.array_join(F.array_distinct(F.transform("_n", lambda item: item["name"])), " / ").alias("defect_name"),
        )
    )


# ------------------------------------------------------------------ normalised codes

def _first_text(columns: Sequence[str]) -> Column:
    return F.coalesce(*[blank_to_null(F.col(f"`{name}`")) for name in columns], F.lit("")) if columns else F.lit("")


def normalize_codes(passes: DataFrame, catalog: DataFrame) -> DataFrame:
    """AOI and VI code events of station passes; the two sources stay independent."""
    aoi_fields = [name for name in passes.columns if header_key(name) in AOI_CODE_HEADERS]
    vi_fields = [name for name in passes.columns if header_key(name) == VI_CODE_HEADER]
    station = clean_text(F.col("station_id"))
    state = F.when(is_blank(F.col("state")), "UNKNOWN").otherwise(F.upper(clean_text(F.col("state"))))
    batch = F.col("batch") if "batch" in passes.columns else F.lit(None).cast("string")
    base = passes.select(
        scope_of_station(station).alias("analysis_scope"), station.alias("station_id"),
        clean_text(F.col("event_id")).alias("event_id"), clean_text(F.col("dmc_raw")).alias("dmc_raw"),
        "production_order", "test_date", batch.alias("batch"),
        clean_text(F.col("source_sheet")).alias("source_sheet"), state.alias("state"),
        _first_text(aoi_fields).alias("_aoi"),
        F.filter(
            F.array(*[blank_to_null(F.col(f"`{name}`")) for name in vi_fields]) if vi_fields else F.array().cast("array<string>"),
            lambda item: item.isNotNull(),
        ).alias("_vi"),
    )
    aoi = (
        base.where(F.col("station_id").endswith("_aoi"))
        .withColumn("source_type", F.lit("AOI_FAILURE")).withColumn("raw_code", F.col("_aoi"))
        .withColumn("canonical_code", aoi_code(F.col("raw_code")))
        .withColumn("code_status", aoi_code_status(F.col("canonical_code"), F.col("state")))
    )
    vi = (
        base.where(F.col("station_id").endswith("_vi") & (norm_key(F.col("source_sheet")) == VI_SHEET_KEY))
        .withColumn("source_type", F.lit("VI_BLOCK"))
        .withColumn("raw_code", F.explode(F.when(F.size("_vi") > 0, F.col("_vi")).otherwise(F.array(F.lit("")))))
        .withColumn("canonical_code", vi_code(F.col("raw_code")))
        .withColumn("code_status", vi_code_status(F.col("canonical_code"), F.col("state")))
    )
    names = catalog_names(catalog).select(
        F.col("layer").alias("_layer"), F.col("code").alias("canonical_code"), "defect_name"
    )
    rows = aoi.unionByName(vi).withColumn("_layer", layer_of_scope(F.col("analysis_scope")))
    named = lookup_join(rows, names, ["_layer", "canonical_code"], "left")  # a few codes hold most rows
    return named.withColumn("defect_name", F.coalesce("defect_name", F.lit(""))).select(*CODE_FIELDS)


# ------------------------------------------------------------------- code -> product

def map_codes(products: DataFrame, codes: DataFrame) -> DataFrame:
    """Code events with the product image they belong to.

    The recorded event id decides. Codes without a match fall back to the product
    code, only when exactly one such code event and exactly one unambiguous product
    exist; both uniqueness tests are group-bys, not pairings.
    """
    parts = []
    for source, event_column in (("AOI_FAILURE", "aoi_event_id"), ("VI_BLOCK", "vi_event_id")):
        own = codes.where(F.col("source_type") == source)
        remaining = own
        if event_column in products.columns and "event_id" in codes.columns:
            keyed = products.where(~is_blank(F.col(event_column))).select(
                "analysis_scope", F.col(event_column).alias("event_id"), "global_order"
            ).distinct()
            coded = own.where(~is_blank(F.col("event_id")))
            parts.append(coded.join(keyed, ["analysis_scope", "event_id"]).select(*codes.columns, "global_order"))
            remaining = own.join(keyed.select("analysis_scope", "event_id").distinct(), ["analysis_scope", "event_id"], "left_anti")
        clear = products
        if "evidence_status" in products.columns:
            clear = clear.where(F.coalesce("evidence_status", F.lit("")) != "ambiguous_event")
        single_product = clear.groupBy("analysis_scope", "dmc_raw").agg(
            F.min("global_order").alias("global_order"), F.max("global_order").alias("_other")
        ).where("global_order = _other").drop("_other")
        single_code = remaining.groupBy("analysis_scope", "dmc_raw").agg(
            F.count("*").alias("_n"), F.first(F.struct(*[F.col(name) for name in codes.columns if name not in ("analysis_scope", "dmc_raw")])).alias("_c")
        ).where("_n = 1").select("analysis_scope", "dmc_raw", "_c.*")
        parts.append(single_code.join(single_product, ["analysis_scope", "dmc_raw"]).select(*codes.columns, "global_order"))
    mapped = parts[0]
    for more in parts[1:]:
        mapped = mapped.unionByName(more)
    identity = [name for name in ("source_type", "event_id", "canonical_code", "global_order") if name in mapped.columns]
    rest = [name for name in mapped.columns if name not in identity]
    # of equal identities the least row stays, whatever order the tasks ran in
    return mapped.groupBy(*identity).agg(F.min(F.struct(*rest)).alias("_r")).select(*identity, "_r.*").select(*mapped.columns)


# ------------------------------------------------------------- associations, conflicts

def spatial_members(detections: DataFrame) -> DataFrame:
    """(analysis_scope, spatial_type, spatial_id, station_id, global_order) of clustered detections."""
    kinds = [("cluster", "cluster_id")] + ([("trajectory", "trajectory_id")] if "trajectory_id" in detections.columns else [])
    station = F.col("station_id") if "station_id" in detections.columns else F.lit(None).cast("string")
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("spatial_type"), F.col(name).cast("string").alias("spatial_id")) for kind, name in kinds
    ])
    return (
        detections.select("analysis_scope", station.alias("station_id"), "global_order", F.explode(pairs).alias("_p"))
        .select("analysis_scope", "_p.spatial_type", "_p.spatial_id", "station_id", "global_order")
        .where(~is_blank(F.col("spatial_id")))
    )


def code_spatial(products: DataFrame, mapped: DataFrame, detections: DataFrame) -> DataFrame:
    """Association of codes with clusters and trajectories, per scope.

    ``mapped`` comes from ``map_codes``. Both sides are made distinct per product
    before the join, so one product adds at most (#codes x #spatial ids) rows.
    """
    code_key = ["analysis_scope", "source_type", "canonical_code"]
    space_key = ["analysis_scope", "spatial_type", "spatial_id"]
    defects = mapped.where(is_defect_status(F.col("code_status")))
    code_orders = defects.select(*code_key, "global_order").distinct()
    members = spatial_members(detections)
    space_orders = members.select(*space_key, "global_order").distinct()
    support = code_orders.join(space_orders, ["analysis_scope", "global_order"]).groupBy(
        *code_key, "spatial_type", "spatial_id"
    ).agg(F.count("*").alias("support_products"))
    code_sizes = code_orders.groupBy(*code_key).agg(F.count("*").alias("code_products"))
    space_sizes = space_orders.groupBy(*space_key).agg(F.count("*").alias("spatial_products"))
    totals = products.groupBy("analysis_scope").agg(F.count_distinct("global_order").alias("_total"))
    names = defects.where(~is_blank(F.col("defect_name"))).groupBy(*code_key).agg(
        F.array_join(F.sort_array(F.collect_set("defect_name")), " / ").alias("defect_name")
    )
    stations = members.where(F.col("station_id").isNotNull()).groupBy(*space_key).agg(
        F.array_join(F.sort_array(F.collect_set("station_id")), ";").alias("station_id")
    )
    rows = (
        support.join(code_sizes, code_key).join(space_sizes, space_key).join(totals, "analysis_scope")
        .join(names, code_key, "left").join(stations, space_key, "left")
    )
    lift = (F.col("support_products") / F.col("_total")) / (
        (F.col("code_products") / F.col("_total")) * (F.col("spatial_products") / F.col("_total"))
    )
    scored = (
        rows.withColumn("p_spatial_given_code", F.col("support_products") / F.col("code_products"))
        .withColumn("p_code_given_spatial", F.col("support_products") / F.col("spatial_products"))
        .withColumn("lift", lift)
    )
    return scored.select(
        "analysis_scope", F.coalesce("station_id", F.lit("")).alias("station_id"), "source_type", "canonical_code",
        F.coalesce("defect_name", F.lit("")).alias("defect_name"), "spatial_type", "spatial_id",
        "support_products", "code_products", "spatial_products", "p_spatial_given_code",
        "p_code_given_spatial", "lift",
        association_strength(
            F.col("support_products"), F.col("p_spatial_given_code"), F.col("p_code_given_spatial"), F.col("lift")
        ).alias("association_strength"),
    )


def code_spatial_support(mapped: DataFrame, detections: DataFrame) -> DataFrame:
    """Products behind each association, one row per product."""
    code_key = ["analysis_scope", "source_type", "canonical_code"]
    left = mapped.where(is_defect_status(F.col("code_status"))).select(*code_key, "global_order").distinct()
    right = spatial_members(detections).select("analysis_scope", "spatial_type", "spatial_id", "global_order").distinct()
    return left.join(right, ["analysis_scope", "global_order"]).select(*code_key, "spatial_type", "spatial_id", "global_order")


def label_conflicts(products: DataFrame, mapped: DataFrame) -> DataFrame:
    """AOI codes against VI codes of the same product; neither is treated as the truth."""
    rows = mapped.where(is_defect_status(F.col("code_status")))

    def codes_of(source: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("source_type") == source, F.col("canonical_code"))))

    sets = rows.groupBy("analysis_scope", "global_order", "dmc_raw").agg(
        codes_of("AOI_FAILURE").alias("_aoi"), codes_of("VI_BLOCK").alias("_vi")
    )
    status = (
        F.when((F.size("_aoi") > 0) & (F.size("_vi") == 0), "missing_vi")
        .when((F.size("_vi") > 0) & (F.size("_aoi") == 0), "missing_aoi")
        .when(F.arrays_overlap("_aoi", "_vi"), "consistent").otherwise("label_conflict")
    )
    if "production_order" in products.columns:
        orders = products.groupBy("global_order").agg(F.min("production_order").alias("production_order"))
        sets = sets.join(orders, "global_order", "left")
    else:
        sets = sets.withColumn("production_order", F.lit(None).cast("bigint"))
    return sets.select(
        "analysis_scope", "global_order", "production_order", "dmc_raw",
        F.array_join("_aoi", ";").alias("aoi_codes"), F.array_join("_vi", ";").alias("vi_codes"),
        status.alias("comparison_status"),
        F.when(status == "label_conflict", "parallel evidence, raw codes unchanged").otherwise("").alias("review_note"),
    )


# ---------------------------------------------------------------- station attribution

def upstream_checks(
    trajectories: DataFrame, products: DataFrame, detections: DataFrame, time: str, near: float = 0.02
) -> DataFrame:
    """Per trajectory: samples with an evaluable earlier station, and how many were clean there.

    Only the earliest time per (product, station) matters for "was there an earlier
    pass elsewhere", so both sides shrink to that before any join; the position test
    joins on (product, y-cell) and never pairs a product's rows with each other.
    """
    stamp = F.col(time).cast("timestamp_ntz")
    sites = products.select("global_order", "dmc_raw", F.coalesce("station_id", F.lit("")).alias("station_id"), stamp.alias("_time"), *(
        ["evidence_status"] if "evidence_status" in products.columns else []
    ))
    usable = sites.where(F.col("_time").isNotNull())
    if "evidence_status" in products.columns:
        usable = usable.where(F.col("evidence_status") == "evaluable")
    keys = trajectories.select("trajectory_id", F.col("station_id").alias("_own")).distinct()
    members = detections.join(keys, "trajectory_id")
    centres = members.groupBy("trajectory_id").agg(F.avg("aligned_y_norm").alias("_mean_y"))
    samples = (
        members.select("trajectory_id", "_own", "global_order", "dmc_raw").distinct()
        .join(sites.groupBy("global_order").agg(F.min("_time").alias("_time")), "global_order")
        .where(F.col("_time").isNotNull())
    )
    earliest = usable.groupBy("dmc_raw", "station_id").agg(F.min("_time").alias("_first"))
    by_piece = earliest.groupBy("dmc_raw").agg(F.collect_list(F.struct("station_id", "_first")).alias("_sites"))
    comparable = samples.join(by_piece, "dmc_raw").where(
        F.exists("_sites", lambda s: (s["station_id"] != F.col("_own")) & (s["_first"] < F.col("_time")))
    ).drop("_sites")
    y = F.coalesce("aligned_y_norm", "center_y_norm") if "center_y_norm" in detections.columns else F.col("aligned_y_norm")
    spots = (
        detections.select("global_order", y.alias("_y")).where("_y is not null")
        .join(usable.select("global_order", "dmc_raw", "station_id", "_time"), "global_order")
        .groupBy("dmc_raw", "station_id", "_y").agg(F.min("_time").alias("_first"))
        .withColumn("_cell", F.floor(F.col("_y") / near))
    )
    wanted = (
        comparable.select("trajectory_id", "_own", "dmc_raw").distinct().join(centres, "trajectory_id")
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_mean_y") / near) - 1, F.floor(F.col("_mean_y") / near) + 1)))
    )
    hits = (
        wanted.join(spots, ["dmc_raw", "_cell"])
        .where((F.col("station_id") != F.col("_own")) & (F.abs(F.col("_y") - F.col("_mean_y")) <= near))
        .groupBy("trajectory_id", "dmc_raw").agg(F.min("_first").alias("_hit"))
    )
    judged = comparable.join(hits, ["trajectory_id", "dmc_raw"], "left")
    clean = F.col("_hit").isNull() | (F.col("_hit") >= F.col("_time"))
    return judged.groupBy("trajectory_id").agg(
        F.count("*").alias("comparable"), F.count_if(clean).alias("upstream_clean")
    )


def attribution(
    code_patterns: DataFrame, trajectories: DataFrame, associations: DataFrame,
    products: DataFrame | None = None, detections: DataFrame | None = None,
) -> DataFrame:
    """Cautious station attribution of every piece of evidence; never a claim of cause."""
    conclusion = F.lit("equipment cause unconfirmed").alias("equipment_conclusion")
    no_upstream = F.lit("pattern sits at one station; no clean upstream comparison of the same product")

    def level(station: Column) -> Column:
        return F.when(is_blank(station), "observed_pattern").otherwise("suspected_station")

    columns = ["evidence_id", "analysis_scope", "station_id", "evidence_source", "pattern_type", "association_level", "equipment_conclusion", "reason"]
    from_codes = code_patterns.select(
        F.col("pattern_id").alias("evidence_id"), "analysis_scope", clean_text(F.col("station_id")).alias("station_id"),
        F.lit("code").alias("evidence_source"), "pattern_type",
        level(F.col("station_id")).alias("association_level"), conclusion, no_upstream.alias("reason"),
    )
    time = next(
        (name for name in ("aoi_test_date", "test_date", "capture_date") if products is not None and name in products.columns),
        None,
    )
    checked = trajectories.withColumn("comparable", F.lit(0)).withColumn("upstream_clean", F.lit(0))
    if time and detections is not None and {"global_order", "dmc_raw", "station_id"} <= set(products.columns):
        checks = upstream_checks(trajectories.where(F.col("registration_quality") == "high"), products, detections, time)
        checked = trajectories.join(checks, "trajectory_id", "left").fillna(0, ["comparable", "upstream_clean"])
    high = F.col("registration_quality") == "high"
    strong = high & ~is_blank(F.col("station_id")) & (F.col("comparable") >= 5) & (F.col("upstream_clean") / F.col("comparable") >= 0.80)
    from_trajectories = checked.select(
        F.col("trajectory_id").alias("evidence_id"), "analysis_scope", clean_text(F.col("station_id")).alias("station_id"),
        F.lit("spatial_trajectory").alias("evidence_source"), "pattern_type",
        F.when(strong, "strong_station_link").when(high, "suspected_station").otherwise(level(F.col("station_id"))).alias("association_level"),
        conclusion,
        F.when(strong, F.format_string("%d comparable upstream samples, %d without the feature", "comparable", "upstream_clean"))
        .when(high, "trajectory with reliable alignment at one station; upstream comparison insufficient")
        .otherwise(no_upstream).alias("reason"),
    )
    from_pairs = associations.where(F.col("association_strength").isin("strong", "medium")).select(
        F.concat_ws(":", "source_type", "canonical_code", "spatial_id").alias("evidence_id"), "analysis_scope",
        clean_text(F.col("station_id")).alias("station_id"), F.lit("code_spatial").alias("evidence_source"),
        F.col("spatial_type").alias("pattern_type"), F.lit("suspected_station").alias("association_level"), conclusion,
        F.lit("codes and positions are associated; association is not cause").alias("reason"),
    )
    return from_codes.select(columns).unionByName(from_trajectories.select(columns)).unionByName(from_pairs.select(columns))
