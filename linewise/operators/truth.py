"""Matching product images to station passes and follow-up inspections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewise.functions import evidence_status
from linewise.operators.ordering import rank_in_groups

SOURCE = ("source_sheet", "source_row", "event_id")


def _position(events: DataFrame, names: Sequence[str] = SOURCE):
    ties = [name for name in names if name in events.columns]
    return F.struct(F.col("test_date").isNull().alias("n"), F.col("test_date").alias("t"), *ties)


def match_truth(products: DataFrame, events: DataFrame) -> DataFrame:
    """Attach the AOI pass of each product image.

    Same-day passes are preferred. One candidate is a match; with several the last
    is shown but its order is withheld. Passes are reduced to one row per (product,
    day) and per product before the join, so repeated passes never multiply rows.
    """
    carried = [name for name in (
        "test_date", "state", "state_raw", "event_id", "production_order", "batch", "variant", "ttnr",
        "source_sheet", "source_row", "aoi_failure_code",
    ) if name in events.columns]
    row, place = F.struct(*carried), _position(events)
    per_day = events.where(F.col("test_date").isNotNull()).groupBy(
        "station_id", "dmc_raw", F.to_date("test_date").alias("capture_date")
    ).agg(F.count("*").alias("_day_n"), F.max_by(row, place).alias("_day"))
    overall = events.groupBy("station_id", "dmc_raw").agg(F.count("*").alias("_all_n"), F.max_by(row, place).alias("_all"))
    base = [name for name in products.columns if name not in ("production_order", "batch", "variant", "ttnr")]
    joined = (
        products.select(*base).join(per_day, ["station_id", "dmc_raw", "capture_date"], "left")
        .join(overall, ["station_id", "dmc_raw"], "left")
    )
    chosen, count = F.coalesce("_day", "_all"), F.coalesce("_day_n", "_all_n")
    rows = joined.withColumn("_row", chosen).withColumn("_n", count)
    status = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "matched").otherwise("ambiguous_event")
    renamed = {"test_date": "aoi_test_date", "state": "aoi_state", "state_raw": "aoi_state_raw", "event_id": "aoi_event_id"}
    pair = F.col("has_primary_pair") if "has_primary_pair" in products.columns else F.lit(True)
    return rows.select(
        *base,
        *[F.col(f"_row.{name}").alias(renamed.get(name, name)) for name in carried if name != "production_order"],
        F.when(F.col("_n") == 1, F.col("_row.production_order")).alias("production_order"),
        F.when(F.col("_n").isNull(), "unmatched").otherwise("matched").alias("truth_match"),
        status.alias("event_match_status"), evidence_status(status, pair).alias("evidence_status"),
    )


def match_followup(products: DataFrame, events: DataFrame, follow_up: DataFrame) -> DataFrame:
    """Attach the VI pass after each product's AOI pass.

    The last pass at or after the AOI time counts, otherwise the last of all. "Last
    at or after" is the last timed pass whenever that is late enough, so one row per
    product decides. ``follow_up``: station_id, vi_station_id.
    """
    row, place = F.struct("event_id", "test_date", "state", "state_raw", "failure_codes"), _position(events)
    best = events.groupBy(F.col("station_id").alias("vi_station_id"), "dmc_raw").agg(
        F.max_by(row, F.when(F.col("test_date").isNotNull(), place)).alias("_timed"), F.max_by(row, place).alias("_last")
    )
    joined = products.join(F.broadcast(follow_up), "station_id", "left").join(best, ["vi_station_id", "dmc_raw"], "left")
    later = F.col("_timed.test_date") >= F.col("aoi_test_date")
    chosen = F.when(later, F.col("_timed")).otherwise(F.col("_last"))
    rows = joined.withColumn("_vi", chosen)
    return rows.select(
        *products.columns, F.col("_vi.event_id").alias("vi_event_id"), F.col("_vi.test_date").alias("vi_test_date"),
        F.col("_vi.state").alias("vi_state"), F.col("_vi.state_raw").alias("vi_state_raw"),
        F.col("_vi.failure_codes").alias("vi_defect_code"),
    )


def timeline(events: DataFrame, dmc: str) -> DataFrame:
    """Passes of one product in time order; unknown times come last."""
    return events.where(F.col("dmc_raw") == dmc).orderBy(
        F.col("test_date").asc_nulls_last(), "source_sheet", "source_row", "event_id"
    )


def timelines(events: DataFrame) -> DataFrame:
    """Every pass with its visit number on the product's way across stations."""
    return rank_in_groups(events, ["dmc_raw"], ["test_date", "source_sheet", "source_row", "event_id"], "visit")


def recent_parameters(parameters: DataFrame, count: int = 20) -> DataFrame:
    """The last ``count`` numeric parameters of every product.

    The ``row_number <= count`` filter lets Spark keep only ``count`` rows per product
    in every task before the shuffle, so a busy product stays small.
    """
    latest = [F.col("test_date").desc_nulls_first(), *[F.col(name).desc() for name in ("source_row", "parameter_name", "event_id")]]
    rows = parameters.where(F.col("numeric_value").isNotNull())
    ranked = rows.withColumn("recency", F.row_number().over(Window.partitionBy("dmc_raw").orderBy(*latest)))
    return ranked.where(F.col("recency") <= count).withColumn("recency", F.col("recency").cast("bigint"))
