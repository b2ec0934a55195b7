"""Landed worksheet rows (file, sheet, row_idx, cells) to typed tables.

Header logic (unique names, aliases, tolerance pairing, profile) is array arithmetic
on the few header rows; data rows then pick cells by position. Nothing is pivoted or
shuffled to find a column, and no window runs over a sheet.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.fixed_values import (
    AOI_CODE_HEADERS, AOI_PROFILE_HEADER, CATEGORICAL_FIELDS, FAILURE_CODE_TOKENS, MEASUREMENT_HEADER_ALIASES,
    RESULT_LABEL_TOKENS, STATION_HEADER_ALIASES, VI_CODE_HEADER, VI_PROFILE_HEADERS,
)
from linewise.functions import blank_to_null, clean_text, is_blank, mixed_timestamp, norm_key, pass_state, tolerance_bounds
from linewise.session import cut_lineage
from linewise.sources.stations import resolve_station

SHEET = ["file", "sheet"]
STATION_KEYS = ["identno", "uniquepartidentno"]


# --------------------------------------------------------------- header expressions

def originals(cells: Column) -> Column:
    return F.transform(cells, lambda cell: F.trim(F.coalesce(cell, F.lit(""))))


def normalised(cells: Column) -> Column:
    return F.transform(cells, norm_key)


def unique_headers(cells: Column) -> Column:
    """Blank headers become Unnamed_i, repeats get __2, __3, ..."""
    bases = F.transform(
        cells, lambda cell, i: F.when(is_blank(cell), F.concat(F.lit("Unnamed_"), (i + 1).cast("string"))).otherwise(F.trim(cell))
    )

    def numbered(base: Column, i: Column) -> Column:
        seen = F.size(F.filter(F.slice(bases, F.lit(1), i + 1), lambda other: other == base))
        return F.when(seen == 1, base).otherwise(F.concat(base, F.lit("__"), seen.cast("string")))

    return F.transform(bases, numbered)


def alias_position(keys: Column, aliases: Sequence[str], last: bool) -> Column:
    """1-based position of the first alias present; ``last`` picks the last of equal headers."""
    def where(alias: str) -> Column:
        at = F.array_position(F.reverse(keys), alias) if last else F.array_position(keys, alias)
        return F.when(at > 0, F.size(keys) - at + 1 if last else at)

    return F.coalesce(*[where(alias).cast("int") for alias in aliases])


def pick(cells: Column, position: Column) -> Column:
    return F.when(position.isNotNull() & (position <= F.size(cells)), F.get(cells, position - 1))


# ----------------------------------------------------------------- station worksheets

def worksheet_blocks(rows: DataFrame) -> DataFrame:
    """Data rows with the block (header, title, column roles) they belong to.

    A row with an identity header opens a block. The title is the row before it when
    that row has exactly one filled cell, else the sheet name. A title row is not
    data; every other row stays. Column roles are worked out once per header row;
    the blocks of a sheet travel as one array to its rows (a sheet has few headers),
    so data rows are neither sorted nor shuffled to find theirs.
    """
    is_header = F.exists(normalised(F.col("cells")), lambda key: key.isin(STATION_KEYS))
    filled = F.filter("cells", lambda cell: ~is_blank(cell))
    titles = rows.where(F.size(filled) == 1).select(
        *SHEET, (F.col("row_idx") + 1).alias("row_idx"), F.col("row_idx").alias("title_row"),
        blank_to_null(F.get("cells", F.lit(0))).alias("title"),
    )
    headers = rows.where(is_header).join(titles, [*SHEET, "row_idx"], "left").select(
        *SHEET, F.col("row_idx").alias("block_row"), "title_row", F.coalesce("title", "sheet").alias("title"),
        normalised(F.col("cells")).alias("keys"), originals(F.col("cells")).alias("names"),
    )
    roles = _column_roles(cut_lineage(headers))
    fields = [name for name in roles.columns if name not in SHEET]
    blocks = roles.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_blocks"))
    placed = rows.where(~is_blank(F.get("cells", F.lit(0)))).join(blocks, SHEET).where(
        ~F.exists("_blocks", lambda b: (b["block_row"] == F.col("row_idx")) | b["title_row"].eqNullSafe(F.col("row_idx")))
    )
    own = F.try_element_at(F.filter("_blocks", lambda b: b["block_row"] <= F.col("row_idx")), F.lit(-1))
    return placed.select(*SHEET, "row_idx", "cells", own.alias("block")).where("block is not null")


def _column_roles(headers: DataFrame) -> DataFrame:
    """Canonical positions, parameter columns and result labels of every header row."""
    placed = headers.withColumns({
        f"at_{name}": alias_position(F.col("keys"), aliases, last=True) for name, aliases in STATION_HEADER_ALIASES.items()
    })
    core = F.array_compact(F.array(*[F.col(f"at_{name}") for name in STATION_HEADER_ALIASES]))
    columns = F.transform("names", lambda name, i: F.struct(
        name.alias("name"), F.get("keys", i).alias("key"), (i + 1).alias("at"),
        F.when(F.coalesce(F.get("keys", i + 1), F.lit("")).startswith("tolerance"), i + 2).alias("tolerance_at"),
        F.array_contains(F.slice("names", i + 2, F.size("names")), name).alias("again"),
    ))
    listed = placed.withColumn("columns", columns).withColumn("core", core)
    is_parameter = lambda c: (c["name"] != "") & ~F.array_contains("core", c["at"]) & ~c["key"].startswith("tolerance")
    return listed.select(
        *SHEET, "block_row", "title_row", "title", *[f"at_{name}" for name in STATION_HEADER_ALIASES],
        F.array_contains("keys", "uniquepartidentno").alias("is_package"),
        F.filter("columns", is_parameter).alias("parameters"),
        F.filter("columns", lambda c: _has_token(c["key"], RESULT_LABEL_TOKENS)).alias("labels"),
        F.filter("columns", lambda c: (c["name"] != "") & ~c["again"]).alias("named"),
    )


def sheets_without_blocks(rows: DataFrame) -> DataFrame:
    """Sheets that hold no identity header and are therefore skipped."""
    is_header = F.exists(normalised(F.col("cells")), lambda key: key.isin(STATION_KEYS))
    return rows.groupBy(*SHEET).agg(F.max(is_header.cast("int")).alias("_found")).where("_found = 0").select(*SHEET)


def station_tables(blocks: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, parameters, package) of worksheet blocks, before event clean-up."""
    fields = list(STATION_HEADER_ALIASES)
    typed = blocks.select(
        *SHEET, "row_idx", "cells", "block",
        *[blank_to_null(pick(F.col("cells"), F.col(f"block.at_{name}"))).alias(name) for name in fields],
    ).where("dmc_raw is not null")
    values = lambda entries: F.filter(
        F.transform(entries, lambda c: F.struct(
            c["name"].alias("name"), c["key"].alias("key"), pick(F.col("cells"), c["at"]).alias("value"),
            pick(F.col("cells"), c["tolerance_at"]).alias("tolerance"),
        )),
        lambda c: ~is_blank(c["value"]),
    )
    named = F.transform("block.named", lambda c: F.struct(c["name"].alias("key"), pick(F.col("cells"), c["at"]).alias("value")))
    package = typed.where("block.is_package").select(
        "dmc_raw", F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"), F.col("row_idx").alias("source_row"),
        F.map_from_entries(named).alias("fields"),
    )
    events = typed.where("not block.is_package").select(
        F.concat_ws(":", "sheet", "block.title", "row_idx").alias("event_id"), "dmc_raw", F.col("block.title").alias("station_title"),
        mixed_timestamp(F.col("test_date")).alias("test_date"), F.coalesce("state_raw", F.lit("")).alias("state_raw"),
        pass_state(F.col("state_raw")).alias("state"), F.col("file").alias("source_file"), F.col("sheet").alias("source_sheet"),
        F.col("row_idx").alias("source_row"), "line", "st", "si", "fu", "wp", "tp", "ttnr", "variant", "batch",
        values(F.col("block.labels")).alias("_labels"), values(F.col("block.parameters")).alias("_cells"),
    )
    resolved = resolve_station(events, stations)
    codes = F.filter("_labels", lambda c: _has_token(c["key"], FAILURE_CODE_TOKENS))
    finished = resolved.select(
        *[name for name in resolved.columns if name not in ("_labels", "_cells")],
        _first_label(F.col("_labels"), AOI_CODE_HEADERS).alias("aoi_failure_code"),
        _first_label(F.col("_labels"), [VI_CODE_HEADER]).alias("block_code"),
        F.array_join(F.transform(codes, lambda c: F.trim(c["value"])), ";").alias("failure_codes"),
        F.size("_cells").alias("parameter_count"),
    )
    cells = resolved.select(
        "event_id", "dmc_raw", "station_id", "test_date", "source_file", "source_sheet", "source_row", F.explode("_cells").alias("_c")
    )
    number = F.trim("_c.value").try_cast("double")
    parameters = cells.select(
        "event_id", "dmc_raw", "station_id", "test_date", F.col("_c.name").alias("parameter_name"),
        F.col("_c.value").alias("raw_value"), number.alias("numeric_value"), F.col("_c.tolerance").alias("tolerance_raw"),
        F.when(number.isNotNull(), "numeric").otherwise("categorical").alias("parameter_type"),
        "source_file", "source_sheet", "source_row",
    )
    return finished, parameters, package


def _has_token(key: Column, tokens: Sequence[str]) -> Column:
    return key.rlike("|".join(tokens))


def _first_label(labels: Column, keys: Sequence[str]) -> Column:
    return F.trim(F.get(F.filter(labels, lambda cell: cell["key"].isin(list(keys))), F.lit(0))["value"])


def clean_events(events: DataFrame) -> DataFrame:
    """Drop empty AOI history next to detailed history; latest-wins per product, station, time.

    Of repeated passes the one with most parameters stays, the last among equals.
    """
    detailed = events.groupBy("dmc_raw", "station_id").agg(F.max("parameter_count").alias("_most"))
    joined = events.join(detailed, ["dmc_raw", "station_id"])
    redundant = F.col("station_id").endswith("_aoi") & (F.col("_most") > 0) & (F.col("parameter_count") == 0)
    rest = joined.where(~redundant).drop("_most")
    columns = [name for name in rest.columns if name not in ("dmc_raw", "station_id", "test_date")]
    source = [name for name in ("source_file", "source_sheet", "source_row", "event_id") if name in rest.columns]
    return rest.groupBy("dmc_raw", "station_id", "test_date").agg(
        F.max_by(F.struct(*columns), F.struct("parameter_count", *source)).alias("_row")
    ).select("dmc_raw", "station_id", "test_date", "_row.*")


def unresolved_events(events: DataFrame) -> DataFrame:
    """Passes whose location fields name no station."""
    return events.where(F.col("station_id") == "").select("source_sheet", "source_row", "line", "st", "si", "fu", "wp")


def first_product_fields(events: DataFrame, fields: Sequence[str] = ("ttnr", "variant", "batch")) -> DataFrame:
    """Per product the first non-null master fields in time order, unknown times last."""
    source = [name for name in ("source_file", "source_sheet", "source_row", "event_id") if name in events.columns]
    position = F.struct(F.col("test_date").isNull().alias("n"), F.col("test_date").alias("t"), *source)
    return events.groupBy("dmc_raw").agg(*[
        F.min_by(name, F.when(F.col(name).isNotNull(), position)).alias(name) for name in fields
    ])


def latest_process_values(parameters: DataFrame) -> DataFrame:
    """(dmc_raw, feature, value): last numeric WP1-WP5 value per product and feature."""
    source = [name for name in ("source_file", "source_sheet", "source_row", "event_id") if name in parameters.columns]
    position = F.struct(F.col("test_date").isNull().alias("n"), F.col("test_date").alias("t"), *source)
    rows = parameters.where(F.col("station_id").rlike("_wp[1-5]$") & F.col("numeric_value").isNotNull())
    return rows.groupBy("dmc_raw", F.concat_ws(".", "station_id", "parameter_name").alias("feature")).agg(
        F.max_by("numeric_value", position).alias("value")
    )


def process_frame(latest: DataFrame, features: Sequence[str]) -> DataFrame:
    """One wide row per product; the caller names the features, so no scan looks for them."""
    return latest.groupBy("dmc_raw").pivot("feature", list(features)).agg(F.first("value"))


# -------------------------------------------------------------- measurement worksheets

def sheet_headers(rows: DataFrame) -> DataFrame:
    """First row of every sheet: names, keys and unique names."""
    return rows.where(F.col("row_idx") == 1).select(
        *SHEET, originals(F.col("cells")).alias("names"), normalised(F.col("cells")).alias("keys"),
        unique_headers(F.col("cells")).alias("unique_names"),
    )


def preview(rows: DataFrame, file: str, sheet: str, limit: int = 50) -> DataFrame:
    """The first data rows of one sheet, for a look before import."""
    return rows.where((F.col("file") == file) & (F.col("sheet") == sheet) & (F.col("row_idx") > 1)).orderBy("row_idx").limit(limit)


def query_parameters(rows: DataFrame, sheet: str = "Query parameter") -> DataFrame:
    """(file, key, value) of the key-value sheet, title row skipped, last value per key."""
    key = F.trim(F.get("cells", F.lit(0)))
    return (
        rows.where(F.col("sheet") == sheet).select("file", "row_idx", key.alias("key"), F.get("cells", F.lit(1)).alias("value"))
        .where((F.col("key") != "") & (norm_key(F.col("key")) != "queryparameter"))
        .groupBy("file", "key").agg(F.max_by("value", "row_idx").alias("value"))
    )


def resolve_profile(keys: Column, requested: str = "auto") -> Column:
    if requested not in ("auto", "wp", "aoi", "vi"):
        raise ValueError(f"unknown profile {requested!r}")
    if requested != "auto":
        return F.lit(requested)
    return (
        F.when(F.arrays_overlap(keys, F.array(*map(F.lit, VI_PROFILE_HEADERS))), "vi")
        .when(F.array_contains(keys, AOI_PROFILE_HEADER), "aoi").otherwise("wp")
    )


def measurement_layout(rows: DataFrame, mapping: Mapping[str, str] | None = None, profile: str = "auto") -> DataFrame:
    """Per sheet: field positions, profile, and (result, tolerance) column pairs.

    A result column takes the next tolerance column before the next result column.
    ``mapping`` overrides canonical fields by unique column name.
    """
    head = cut_lineage(sheet_headers(rows))
    given = {name: source for name, source in (mapping or {}).items() if source}
    fields = {}
    for name, aliases in MEASUREMENT_HEADER_ALIASES.items():
        automatic = alias_position(F.col("keys"), aliases, last=False)
        chosen = F.nullif(F.array_position("unique_names", given[name]), F.lit(0)).cast("int") if name in given else automatic
        fields[f"at_{name}"] = chosen
    count = F.size("names")
    is_result = lambda i: F.lower(F.get("names", i)).startswith("result.") & (F.get("keys", i) != "resulttimestamping")
    stops = lambda i: F.lower(F.get("names", i)).startswith("result.")

    def tolerance_of(i: Column) -> Column:
        later = F.filter(F.sequence(i + 1, F.greatest(count - 1, i + 1)), lambda j: j < count)
        stop = F.coalesce(F.get(F.filter(later, stops), F.lit(0)), count)
        hit = F.filter(later, lambda j: (j < stop) & F.get("keys", j).startswith("tolerance"))
        return F.get(hit, F.lit(0))

    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), count - 1), is_result),
        lambda i: F.struct(
            F.get("names", i).alias("parameter"), F.get("unique_names", i).alias("value_column"), (i + 1).alias("value_at"),
            (tolerance_of(i) + 1).alias("tolerance_at"), F.get("unique_names", tolerance_of(i)).alias("tolerance_column"),
        ),
    )
    layout = head.select(
        *SHEET, "names", "keys", "unique_names", *[c.alias(n) for n, c in fields.items()],
        resolve_profile(F.col("keys"), profile).alias("profile"), pairs.alias("pairs"),
    )
    return cut_lineage(layout)  # one row per sheet, read by every later step


def mapping_errors(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """User mappings that point at a column the sheet does not have."""
    entries = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(v).alias("column")) for k, v in mapping.items() if v])
    return sheet_headers(rows).select(*SHEET, "unique_names", F.explode(entries).alias("_m")).where(
        ~F.array_contains("unique_names", F.col("_m.column"))
    ).select(*SHEET, "_m.field", "_m.column")


def _data_rows(rows: DataFrame, layout: DataFrame) -> DataFrame:
    return rows.where(F.col("row_idx") > 1).join(layout, SHEET)


def measurement_records(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Typed core fields of every record; source_row is the sheet row."""
    data = _data_rows(rows, layout)

    def text(name: str) -> Column:
        return clean_text(pick(F.col("cells"), F.col(f"at_{name}")))

    stamps = {name: mixed_timestamp(pick(F.col("cells"), F.col(f"at_{name}"))) for name in ("test_date", "result_timestamp")}
    return data.select(
        *SHEET, F.col("row_idx").alias("source_row"), text("dmc_raw").alias("dmc_raw"), F.upper(text("state")).alias("state"),
        *[text(name).alias(name) for name in ("variant", "batch", "ttnr", "line")],
        stamps["test_date"].alias("test_date"), stamps["result_timestamp"].alias("result_timestamp"),
        F.when(F.col("at_result_timestamp").isNotNull(), stamps["result_timestamp"]).otherwise(stamps["test_date"]).alias("timestamp"),
        "profile",
    )


def measurement_tall(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """One row per record and numeric result column, with its tolerance text.

    Result columns without a single number are not parameters and are left out.
    """
    cells = _data_rows(rows, layout).select(*SHEET, F.col("row_idx").alias("source_row"), "cells", F.explode("pairs").alias("_p"))
    tall = cells.select(
        *SHEET, "source_row", F.col("_p.parameter").alias("parameter"), F.col("_p.value_column").alias("value_column"),
        F.trim(pick(F.col("cells"), F.col("_p.value_at"))).try_cast("double").alias("value"),
        pick(F.col("cells"), F.col("_p.tolerance_at")).alias("tolerance_raw"),
        F.col("_p.tolerance_at").isNotNull().alias("has_tolerance"),
    )
    numeric = tall.groupBy(*SHEET, "value_column").agg(F.count("value").alias("_n")).where("_n > 0").drop("_n")
    return tall.join(numeric, [*SHEET, "value_column"], "left_semi")


def parameter_specs(tall: DataFrame) -> DataFrame:
    """Most frequent readable bounds and the tolerance status of every parameter column."""
    bounded = tall.withColumn("_b", tolerance_bounds(F.col("tolerance_raw")))
    counts = bounded.groupBy(*SHEET, "parameter", "value_column", "has_tolerance", "_b.lower", "_b.upper").agg(
        F.count("*").alias("_n"), F.min("source_row").alias("_first"),
        F.count_if(F.col("_b").isNull() & ~is_blank(F.col("tolerance_raw"))).alias("_bad"),
    )
    merged = counts.groupBy(*SHEET, "parameter", "value_column", "has_tolerance").agg(
        F.max(F.when(F.col("lower").isNotNull(), F.struct("_n", (-F.col("_first")).alias("f"), "lower", "upper"))).alias("_u"),
        F.sum("_bad").alias("unreadable_count"),
    )
    status = (
        F.when(~F.col("has_tolerance"), "missing_tolerance").when(F.col("_u").isNull(), "no_valid_tolerance")
        .when(F.col("unreadable_count") > 0, "partially_invalid").otherwise("valid")
    )
    return merged.select(
        *SHEET, "parameter", "value_column", F.col("_u.lower").alias("lower"), F.col("_u.upper").alias("upper"),
        "unreadable_count", status.alias("parse_status"),
    )


def categorical_cells(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """(profile, field, value) of the categorical fields each sheet's profile counts."""
    wanted = F.coalesce(*[
        F.when(F.col("profile") == name, F.array(*map(F.lit, fields))) for name, fields in CATEGORICAL_FIELDS.items() if fields
    ], F.array().cast("array<string>"))
    cells = F.transform("names", lambda name, i: F.struct(
        name.alias("field"), F.get("keys", i).alias("key"), blank_to_null(F.when(i < F.size("cells"), F.get("cells", i))).alias("value")
    ))
    return _data_rows(rows, layout).select(
        *SHEET, "profile", F.explode(F.filter(cells, lambda cell: F.array_contains(wanted, cell["key"]) & cell["value"].isNotNull())).alias("_c")
    ).select(*SHEET, "profile", "_c.field", "_c.value")


def relationship_columns(records: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Keys, times, groups and measured columns that a process relation may use."""
    wanted = ["dmc_raw", "timestamp", "test_date", "result_timestamp", "ttnr", "variant", "batch", "line"]
    kept = [name for name in wanted if name in records.columns]
    return records.select(*[F.col(f"`{name}`") for name in [*kept, *[p for p in parameters if p in records.columns and p not in kept]]])
