"""Order, line-item and event tables read as production-line tables.

Every function maps whole tables: passes and detections come from events, measurements
and process parameters from line items, products from orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.fixed_values import FOLLOW_UP_STATION, IMAGE_PROFILES, STATIONS
from linewise.functions import detection_verdict, pass_state, scope_of_station  # noqa: F401
from linewise.operators.sequence import production_order


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _station_array(field: int) -> Column:
    return F.array(*[F.lit(row[field]) for row in STATIONS])


def _by_station(field: int) -> Column:
    return F.get(_station_array(field), F.pmod("user_id", F.lit(len(STATIONS))).cast("int"))


def _by_type(mapping: dict[str, str | None], other: str | None) -> Column:
    chain = None
    for kind, value in mapping.items():
        test = F.col("event_type") == kind
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain.otherwise(F.lit(other))


def passes(spark: SparkSession, folder: str) -> DataFrame:
    """Station passes without a production order."""
    value = F.col("value")
    state = (
        F.when(value < 20, " ok").when(value < 60, "nok").when(value < 90, "Scrapped part")
        .when(value < 110, "Others: rework").otherwise("")
    )
    aoi = _by_type({"view": "100000000000", "error": "501100000000xxx", "click": "F5020-01", "purchase": "552099"}, "-")
    vi = _by_type({"error": "175011_", "click": "17-50-20", "purchase": "17 55 20", "view": "12"}, None)
    kind = _by_station(4)
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("E"), F.col("event_id")).alias("event_id"),
        F.concat(F.lit("D"), F.expr("event_id div 4")).alias("dmc_raw"), _by_station(0).alias("station_id"),
        kind.alias("station_type"), F.col("ts").alias("test_date"), "event_type", "value", "user_id", "props",
        state.alias("state_raw"),
        F.when(kind == "aoi", aoi).alias("aoi_failure_code"), F.when(kind == "vi", vi).alias("block_code"),
        F.when(kind == "aoi", "AOI").when(kind == "vi", F.when(F.col("event_type") == "view", "Other").otherwise("MS0335 all"))
        .otherwise("WP").alias("source_sheet"),
        F.col("event_id").alias("source_row"), F.concat(F.lit("B"), F.date_format("ts", "yyyyMMdd")).alias("batch"),
        F.concat(F.lit("V"), F.col("user_id") % 3).alias("variant"),
        F.when(~(value > 100), F.concat(F.lit("T"), F.col("user_id") % 5)).alias("ttnr"),
    )
    return rows.withColumn("state", pass_state(F.col("state_raw"))).withColumn(
        "failure_codes", F.coalesce("block_code", F.lit(""))
    )


def ordered_passes(spark: SparkSession, folder: str) -> DataFrame:
    return production_order(passes(spark, folder))


def pass_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Tall parameters of passes: a reading, a counter and a kind; weak passes have none."""
    rows = passes(spark, folder).where(F.col("value") >= 5)
    cells = F.array(
        F.struct(F.lit("Result.Value").alias("parameter_name"), F.col("value").cast("string").alias("raw_value")),
        F.struct(F.lit("Result.K").alias("parameter_name"), F.get_json_object("props", "$.k").alias("raw_value")),
        F.struct(F.lit("Result.Kind").alias("parameter_name"), F.col("event_type").alias("raw_value")),
    )
    return rows.select("event_id", "dmc_raw", "station_id", "test_date", "source_sheet", "source_row", F.explode(cells).alias("_c")).select(
        "event_id", "dmc_raw", "station_id", "test_date", "_c.parameter_name", "_c.raw_value",
        F.trim("_c.raw_value").try_cast("double").alias("numeric_value"), "source_sheet", "source_row",
    )


def products_of_passes(ordered: DataFrame) -> DataFrame:
    """AOI passes as products; some have no event id, no usable pair or an unclear event."""
    kind = F.col("event_type")
    status = F.when(F.col("value") >= 110, "ambiguous_event").when(kind != "signup", "evaluable").otherwise("unavailable")
    return ordered.where(F.col("station_type") == "aoi").select(
        (F.col("seq") + 1).alias("global_order"), scope_of_station(F.col("station_id")).alias("analysis_scope"), "station_id",
        scope_of_station(F.col("station_id")).alias("camera"), "dmc_raw", "production_order", "batch",
        F.when(kind != "purchase", F.col("event_id")).alias("aoi_event_id"), F.col("test_date").alias("aoi_test_date"),
        F.col("state").alias("aoi_state"), F.to_date("test_date").alias("capture_date"), status.alias("evidence_status"),
        (kind != "signup").alias("has_primary_pair"),
    )


def spot_columns() -> dict[str, Column]:
    value = F.col("value")
    return {
        "center_x_norm": F.expr("(value * 7.31D) % 1.0D"), "center_y_norm": F.expr("(value * 3.17D) % 1.0D"),
        "detection_type": F.when(F.col("event_type") == "signup", "region_anomaly").when(F.col("event_type") == "click", "micro").otherwise("local"),
        "component_area": F.floor(value).cast("int"),
    }


def detections_of_passes(ordered: DataFrame, only_aoi: bool = True) -> DataFrame:
    """One positioned detection per pass with a high reading, with a coarse cell as cluster."""
    rows = ordered.where(F.col("value") >= 20)
    if only_aoi:
        rows = rows.where(F.col("station_type") == "aoi")
    placed = rows.select(
        F.concat(F.lit("X"), F.col("seq")).alias("detected_id"), (F.col("seq") + 1).alias("global_order"),
        scope_of_station(F.col("station_id")).alias("analysis_scope"), "station_id", "dmc_raw", "production_order",
        *[column.alias(name) for name, column in spot_columns().items()],
    )
    cell = F.concat(F.lit("K"), (F.floor(F.col("center_x_norm") * 6) * 6 + F.floor(F.col("center_y_norm") * 6)).cast("string"))
    return placed.withColumn("cluster_id", F.when(F.col("detection_type") != "region_anomaly", cell))


def orders_as_products(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("global_order"), F.col("o_orderstatus").alias("analysis_scope"),
        F.col("o_orderpriority").alias("batch"), F.col("o_orderdate").alias("production_timestamp"),
        F.when(F.col("o_totalprice") > 250000, "NOK").otherwise("OK").alias("aoi_state"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("dmc_raw"),
    )


def orders_as_records(spark: SparkSession, folder: str) -> DataFrame:
    """Measurement records: verdict text, groups and time; ttnr is blank everywhere."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("source_row"),
        F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", " ng ").otherwise("?").alias("state"),
        F.col("o_orderpriority").alias("variant"), F.date_format("o_orderdate", "yyyy-MM").alias("batch"),
        F.concat(F.lit("L"), F.col("o_custkey") % 7).alias("line"), F.lit("").alias("ttnr"), F.col("o_orderdate").alias("timestamp"),
    )


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """Tall measured values of orders with tolerance texts in several notations."""
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("5 ... "), size))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("2 ~ "), size))
        .when(F.col("l_linenumber") == 3, "bad").when(F.col("l_linenumber") == 4, F.concat(F.lit("3 - "), size))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("−5 … "), size)).when(F.col("l_linenumber") == 6, F.lit(None))
        .otherwise(F.concat(F.lit("0 to "), size, F.lit(".5")))
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    return lines.join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("source_row"), F.concat(F.lit("Result."), "p_type").alias("parameter"),
        F.col("l_quantity").alias("value"), text.alias("tolerance_raw"), F.lit(True).alias("has_tolerance"),
    )


def process_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Process readings per order; several rows of one order are averaged by the join."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("global_order"), F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("discount_pct"),
        F.col("l_shipdate").alias("ship_time"), F.col("l_linenumber").alias("line_number"),
    )


def returned_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Returned line items as defects of their order, category = part brand."""
    lines = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("global_order"), F.col("o_orderstatus").alias("analysis_scope"), F.col("p_brand").alias("defect_type"),
    )


def carrier_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Line items on a carrier with seven places: position = order * 7 + place."""
    return table(spark, folder, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("place"), (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("position"),
        F.col("l_returnflag").alias("flag"),
    )


def carrier_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(products, clustered detections) of three carrier lines: places with a defect flag come round every 21 positions, suppliers do not."""
    rows = table(spark, folder, "lineitem").select(
        F.lit("5S").alias("analysis_scope"), F.concat(F.lit("K"), F.col("l_orderkey") % 3).alias("station_id"),
        (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("production_order"), "l_linenumber", "l_returnflag", "l_suppkey",
    )
    place = F.concat(F.lit("P"), F.col("l_linenumber").cast("string"))
    supplier = F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string"))
    key = ["analysis_scope", "station_id", "production_order"]
    seen = rows.where("l_returnflag <> 'A'").select(*key, place.alias("cluster_id")).unionByName(rows.select(*key, supplier.alias("cluster_id")))
    return rows.select(*key), seen


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image paths per station: right and wrong families, unknown views, other suffixes."""
    families = {profile: family for profile, family, _views, _pair in IMAGE_PROFILES}
    own = F.get(F.array(*[F.lit(families[row[5]]) for row in STATIONS]), F.pmod("user_id", F.lit(len(STATIONS))).cast("int"))
    view = _by_type({"view": "A", "error": "E", "click": "C", "purchase": "x"}, "Q")
    return table(spark, folder, "events").select(
        "event_id", _by_station(0).alias("station_id"),
        F.concat(
            F.lit("/plant/"), _by_station(0), F.lit("/U"), F.col("user_id"), F.lit("-"),
            F.date_format("ts", "yyyyMMdd"), F.when(F.col("value") < 2, "20249901").otherwise(F.date_format("ts", "yyyyMMdd")),
            F.when(F.col("value") > 150, "G").otherwise(own), view,
            F.when(F.col("value") < 1, ".txt").when(F.col("value") < 30, ".PNG").otherwise(".jpg"),
        ).alias("path"),
    )


def expected_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products the worksheets know: every user on the fifth of January."""
    return table(spark, folder, "events").select(
        _by_station(0).alias("station_id"), F.concat(F.lit("U"), F.col("user_id"), F.lit("-20240105")).alias("dmc_raw")
    ).distinct()


SHEET_HEADER = [
    "Ident No.", "State", "Line", "ST", "SI", "FU", "WP", "TP", "Test Date", "TTNR", "Result.Value", "Tolerance",
    "Result.AOIFailureCode", "Block Code", "Result.Kind",
]


def worksheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Landed rows of one file per day: three sheets, two titled blocks each."""
    base = passes(spark, folder)
    location = F.split(_by_station(3), r"\.")
    half = F.floor(F.hour("test_date") / 12)
    key = [F.concat(F.lit("F"), F.date_format("test_date", "yyyyMMdd")).alias("file"), F.concat(F.lit("S"), F.col("user_id") % 3).alias("sheet")]
    wp = F.when(F.col("value") > 200, "99").otherwise(location[4])
    stamp = F.when(F.col("user_id") % 2 == 0, F.date_format("test_date", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("test_date", "dd.MM.yyyy HH:mm:ss"))
    si = F.when(F.col("value") > 120, "9").otherwise(location[2])
    cells = F.array(
        F.col("dmc_raw"), F.col("state_raw"), location[0], location[1], si, location[3], wp, F.lit("1"), stamp,
        F.col("ttnr"), F.col("value").cast("string"), F.lit("5 ... 60"), F.col("aoi_failure_code"), F.col("block_code"), F.col("event_type"),
    )
    data = base.select(*key, (F.col("seq") * 4 + 3).alias("row_idx"), cells.alias("cells"))
    starts = base.groupBy(*key, half.alias("half")).agg(F.min("seq").alias("seq"))
    heads = starts.select("file", "sheet", (F.col("seq") * 4 + 2).alias("row_idx"), F.array(*map(F.lit, SHEET_HEADER)).alias("cells"))
    titles = starts.select(
        "file", "sheet", (F.col("seq") * 4 + 1).alias("row_idx"),
        F.array(F.concat(F.lit("Block "), F.col("half").cast("string")), F.lit(None).cast("string")).alias("cells"),
    )
    return data.unionByName(heads).unionByName(titles)


def measurement_sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One measurement sheet per order month: a header row and one row per order."""
    header = ["Ident No.", "TTNR", "Variant", "Batch", "State", "Line", "Test Date", "Result.Total", "Tolerance",
              "Result.Key", "Tolerance", "Result.Note", "", "Result.TimeStamping"]
    orders = table(spark, folder, "orders")
    file = F.concat(F.lit("M"), F.date_format("o_orderdate", "yyyyMM")).alias("file")
    state = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "NOK").otherwise("")
    low = F.when(F.col("o_custkey") % 5 == 0, "n/a").otherwise("1000 ... 300000")
    data = orders.select(
        file, F.lit("Data").alias("sheet"), (F.col("o_orderkey") + 2).alias("row_idx"),
        F.array(
            F.concat(F.lit("C"), F.col("o_custkey")), F.lit("T1"), F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM"), state,
            F.concat(F.lit("L"), F.col("o_custkey") % 7), F.date_format("o_orderdate", "yyyy/MM/dd"), F.col("o_totalprice").cast("string"),
            low, F.col("o_orderkey").cast("string"), F.lit("0 to 10000"), F.lit("text"), F.lit(None).cast("string"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"),
        ).alias("cells"),
    )
    heads = orders.select(file, F.lit("Data").alias("sheet"), F.lit(1).cast("bigint").alias("row_idx"), F.array(*map(F.lit, header)).alias("cells")).distinct()
    return data.unionByName(heads)


def follow_up(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FOLLOW_UP_STATION.items()), "station_id string, vi_station_id string")
