"""Station and image-profile dimensions, their checks, and station resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.fixed_values import IMAGE_PROFILES, STATIONS
from linewise.functions import clean_text

STATION_SCHEMA = (
    "station_id string, station_group string, station_name string, location string, "
    "station_type string, image_profile string, excel_profile string"
)
PROFILE_SCHEMA = "image_profile string, family_code string, views array<string>, primary_pair array<string>"


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, STATION_SCHEMA)


def image_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMAGE_PROFILES, PROFILE_SCHEMA)


def check_stations(catalog: DataFrame, profiles: DataFrame, expected: int = 18) -> DataFrame:
    """Problems of a station catalog as (check, detail) rows; empty when it is sound."""
    size = catalog.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(
        F.lit("station_count").alias("check"), F.col("n").cast("string").alias("detail")
    )

    def repeated(column: str) -> DataFrame:
        return catalog.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(
            F.lit(f"duplicate_{column}").alias("check"), F.col(column).cast("string").alias("detail")
        )

    unknown = catalog.join(profiles, "image_profile", "left_anti").select("image_profile").distinct().select(
        F.lit("unknown_image_profile").alias("check"), F.col("image_profile").alias("detail")
    )
    short = profiles.where(F.size("primary_pair") != 2).select(
        F.lit("primary_pair").alias("check"), F.col("image_profile").alias("detail")
    )
    return size.unionByName(repeated("station_id")).unionByName(repeated("location")).unionByName(unknown).unionByName(short)


def resolve_station(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``station_id`` by full location, else by line, ST and WP when that is unique.

    The catalog has eighteen rows, so both lookups are broadcast.
    """
    parts = [clean_text(F.col(name)) for name in ("line", "st", "si", "fu", "wp")]
    exact = catalog.select(F.col("location").alias("_location"), F.col("station_id").alias("_exact"))
    split = F.split("location", r"\.")
    three = F.concat_ws(".", split[0], split[1], split[4])
    loose = (
        catalog.where(F.size(split) >= 5).groupBy(three.alias("_three"))
        .agg(F.count("*").alias("_n"), F.min("station_id").alias("_loose")).where("_n = 1").drop("_n")
    )
    keyed = rows.withColumn("_location", F.concat_ws(".", *parts)).withColumn(
        "_three", F.concat_ws(".", parts[0], parts[1], parts[4])
    )
    return (
        keyed.join(F.broadcast(exact), "_location", "left").join(F.broadcast(loose), "_three", "left")
        .withColumn("station_id", F.coalesce("_exact", "_loose", F.lit("")))
        .select(*[name for name in rows.columns if name != "station_id"], "station_id")
    )


def location_mismatches(declared: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sources whose declared location is not that of the chosen station.

    ``declared``: source, station_id, location. A blank location is a warning
    (not cross-checked), a different one an error.
    """
    own = catalog.select("station_id", F.col("location").alias("_own"))
    named = catalog.select(F.col("location").alias("_declared"), F.col("station_id").alias("declared_station"))
    rows = (
        declared.withColumn("_declared", clean_text(F.col("location")))
        .join(F.broadcast(own), "station_id", "left").join(F.broadcast(named), "_declared", "left")
        .where((F.col("_declared") == "") | ~F.col("_declared").eqNullSafe(F.col("_own")))
    )
    return rows.select(
        "source", "station_id", F.col("_declared").alias("location"),
        F.coalesce("declared_station", F.lit("unknown")).alias("declared_station"),
        F.when(F.col("_declared") == "", "warning").otherwise("error").alias("level"),
    )
