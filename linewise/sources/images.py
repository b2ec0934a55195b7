"""Image file listing, file-name parsing and the product index built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewise.fixed_values import IMAGE_STEM_PATTERN, IMAGE_SUFFIXES
from linewise.functions import is_blank
from linewise.operators.ordering import number_rows

VIEWS = ["A", "B", "C", "E", "X", "Y"]


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes of image files below ``root``; file content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", "modificationTime").where(has_image_suffix(F.col("path")))


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Size, modification time and SHA-256 of every input file."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at"),
        F.sha2("content", 256).alias("sha256"),
    )


def has_image_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(IMAGE_SUFFIXES)


def parse_image_names(files: DataFrame) -> DataFrame:
    """Add dmc_raw, capture_date, family_code and view; all null when the name is not usable."""
    stem = F.trim(F.regexp_extract("path", r"([^/\\]*)\.[^./\\]+$", 1))
    date = F.to_date(F.try_to_timestamp(F.regexp_extract(stem, IMAGE_STEM_PATTERN, 2), F.lit("yyyyMMdd")))
    good = has_image_suffix(F.col("path")) & date.isNotNull()
    return files.select(
        "*", F.when(good, F.trim(F.regexp_extract(stem, IMAGE_STEM_PATTERN, 1))).alias("dmc_raw"),
        F.when(good, date).alias("capture_date"),
        F.when(good, F.upper(F.regexp_extract(stem, IMAGE_STEM_PATTERN, 3))).alias("family_code"),
        F.when(good, F.upper(F.regexp_extract(stem, IMAGE_STEM_PATTERN, 4))).alias("view"),
    )


def _judged(parsed: DataFrame, stations: DataFrame, profiles: DataFrame) -> DataFrame:
    """Image files with their station's profile and the reason they cannot be used."""
    dimension = stations.join(profiles, "image_profile").select(
        "station_id", "location", "image_profile", F.col("family_code").alias("_family"), "views", "primary_pair"
    )
    rows = parsed.where(has_image_suffix(F.col("path"))).join(F.broadcast(dimension), "station_id")
    problem = (
        F.when(F.col("dmc_raw").isNull(), "file name does not follow the naming rule")
        .when(F.col("family_code") != F.col("_family"), F.concat(F.lit("image family "), "family_code", F.lit(" does not belong to profile "), "image_profile"))
        .when(~F.array_contains("views", F.col("view")), F.concat(F.lit("view "), "family_code", "view", F.lit(" is not configured")))
    )
    return rows.withColumn("problem", problem)


def product_index(
    parsed: DataFrame, stations: DataFrame, profiles: DataFrame, expected: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(products, issues) of all stations at once.

    ``parsed`` carries station_id; ``expected`` (station_id, dmc_raw) are the products
    the worksheets know. A view with several files gets no path and one error row per
    file. Counting per (product, view) comes first, so a product with very many files
    shuffles as six rows.
    """
    judged = _judged(parsed, stations, profiles)
    usable = judged.where("problem is null")
    per_view = usable.groupBy("station_id", "dmc_raw", "view").agg(
        F.count("*").alias("_files"), F.min("path").alias("_path"), F.min("capture_date").alias("_date")
    )
    single = F.when(F.col("_files") == 1, F.col("_path"))
    indexed = per_view.groupBy("station_id", "dmc_raw").agg(
        F.min("_date").alias("capture_date"),
        *[F.max(F.when(F.col("view") == view, single)).alias(f"view_{view}_path") for view in VIEWS],
    )
    if expected is None:
        merged = indexed.withColumn("has_excel_record", F.lit(None).cast("boolean"))
    else:
        wanted = expected.where(~is_blank(F.col("dmc_raw"))).select(
            "station_id", F.trim("dmc_raw").alias("dmc_raw"), F.lit(True).alias("_expected")
        ).distinct()
        merged = indexed.join(wanted, ["station_id", "dmc_raw"], "full_outer").withColumn(
            "has_excel_record", F.coalesce("_expected", F.lit(False))
        ).drop("_expected")
    dimension = stations.join(profiles, "image_profile").select(
        "station_id", F.col("location").alias("station_location"), F.col("image_profile").alias("camera"), "family_code", "primary_pair"
    )
    rows = merged.join(F.broadcast(dimension), "station_id")

    def path_of(view: Column) -> Column:
        return F.coalesce(*[F.when(view == name, F.col(f"view_{name}_path")) for name in VIEWS])

    products = rows.withColumn("a_image_path", path_of(F.col("primary_pair")[0])).withColumn(
        "e_image_path", path_of(F.col("primary_pair")[1])
    ).withColumn(
        "has_primary_pair", F.col("a_image_path").isNotNull() & F.col("e_image_path").isNotNull()
    )
    issues = _issue_rows(judged, per_view, usable, products)
    columns = [
        "station_id", "station_location", "camera", "dmc_raw", F.col("dmc_raw").alias("order_code"), "capture_date",
        "has_excel_record", *[f"view_{view}_path" for view in VIEWS], "a_image_path", "e_image_path", "has_primary_pair",
    ]
    return products.select(*columns), issues


def _issue_rows(judged: DataFrame, per_view: DataFrame, usable: DataFrame, products: DataFrame) -> DataFrame:
    bad = judged.where("problem is not null").select(
        F.lit("warning").alias("level"), "station_id", F.coalesce("dmc_raw", F.lit("")).alias("dmc_raw"),
        F.col("path").alias("file"), F.col("problem").alias("issue"),
    )
    crowded = per_view.where("_files > 1").select("station_id", "dmc_raw", "view")
    several = usable.join(crowded, ["station_id", "dmc_raw", "view"]).select(
        F.lit("error").alias("level"), "station_id", "dmc_raw", F.col("path").alias("file"),
        F.concat(F.lit("view "), "family_code", "view", F.lit(" has several candidate files")).alias("issue"),
    )
    unpaired = products.where(~F.col("has_primary_pair")).select(
        F.lit("warning").alias("level"), "station_id", "dmc_raw", F.lit("").alias("file"),
        F.concat(
            F.lit("missing primary pair "), "family_code", F.col("primary_pair")[0], F.lit("+"), "family_code",
            F.col("primary_pair")[1], F.lit("; record kept, image step skipped"),
        ).alias("issue"),
    )
    return bad.unionByName(several).unionByName(unpaired)


def number_products(products: DataFrame) -> DataFrame:
    """Task-wide 1..n numbers by capture date and product code, unknown dates last."""
    return number_rows(products, ["capture_date", "dmc_raw", "station_id"], "global_order").withColumn(
        "task_order", F.col("global_order")
    )
