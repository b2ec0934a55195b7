"""Process relations, result views and the whole job."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from linewise.config import AnalysisConfig
from linewise.operators import process
from linewise.plans import views
from linewise.plans.measurement import relate_process

CONFIG = AnalysisConfig()


def sixty(spark):
    rows = [("5S", i, f"B{i // 12}") for i in range(1, 61)]
    products = spark.createDataFrame(rows, "analysis_scope string, global_order bigint, batch string")
    parameters = spark.createDataFrame([(i, 20 + 0.2 * i, math.sin(i)) for i in range(1, 61)], "global_order bigint, temperature double, pressure double")
    defects = spark.createDataFrame([("5S", i) for i in range(21, 61) if i % 3], "analysis_scope string, global_order bigint")
    return products, parameters, defects


def test_exact_relation_matches_pandas(spark):
    products, parameters, defects = sixty(spark)
    frames, model = relate_process(products, defects, parameters)
    summary = frames["summary"].first()
    assert (summary["join_key"], summary["match_rate"], summary["parameter_count"]) == ("global_order", 1.0, 2)
    wide = parameters.toPandas()
    wide["y"] = wide["global_order"].isin([r["global_order"] for r in defects.collect()]).astype(int)
    for row in frames["parameter_metrics"].collect():
        values = wide[row["parameter"]]
        assert abs(row["spearman"] - values.rank().corr(wide["y"].rank())) < 1e-9
        effect = (values[wide.y == 1].mean() - values[wide.y == 0].mean()) / values.std(ddof=1)
        assert abs(row["effect_size"] - effect) < 1e-9
    bins = frames["binned_rates"].where("parameter = 'pressure'").orderBy("bin").collect()
    cut = pd.qcut(wide["pressure"], 5)
    assert [r["sample_count"] for r in bins] == cut.value_counts(sort=False).tolist()
    assert [r["defect_count"] for r in bins] == wide.groupby(cut, observed=True)["y"].sum().tolist()
    weights = {r["parameter"]: r["coefficient"] for r in frames["model_importance"].collect()}
    assert weights["temperature"] > abs(weights["pressure"]) and model["validation_auc"] is not None


def test_nearest_time_equals_pandas(spark):
    rng = random.Random(4)
    left = pd.DataFrame({"id": range(300), "timestamp": pd.to_datetime("2026-01-01") + pd.to_timedelta([rng.randint(0, 4000) for _ in range(300)], unit="s")})
    right = pd.DataFrame({"row": range(200), "read_at": pd.to_datetime("2026-01-01") + pd.to_timedelta([rng.randint(0, 4000) // 5 * 5 for _ in range(200)], unit="s")})
    for tolerance in (1, 7, 60):
        got = process.nearest_time_join(spark.createDataFrame(left), spark.createDataFrame(right), "timestamp", "read_at", tolerance, ["row"]).toPandas()
        want = pd.merge_asof(left.sort_values("timestamp", kind="stable"), right.sort_values("read_at", kind="stable"), left_on="timestamp", right_on="read_at",
                             direction="nearest", tolerance=pd.Timedelta(seconds=tolerance))
        both = got.merge(want, on="id", suffixes=("", "_want"))
        assert np.array_equal(both["row"].fillna(-1), both["row_want"].fillna(-1))
        assert (both["match_quality"] == "unmatched").sum() == both["row_want"].isna().sum()


def test_auc_and_one_class(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.35, 1), ("a", 0.8, 1), ("b", 1.0, 1)]
    got = {r["k"]: r["auc"] for r in process.auc(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s", "y").collect()}
    assert got == {"a": 0.75, "b": None}


def test_repeated_parameter_rows_are_averaged(spark):
    products = spark.createDataFrame([(1, "x"), (2, "y")], "global_order bigint, tag string")
    parameters = spark.createDataFrame([(1, 2.0, "q"), (1, 4.0, "p")], "global_order bigint, v double, tag string")
    joined, key = process.exact_process_join(products, parameters)
    rows = {r["global_order"]: r for r in joined.collect()}
    assert (key, rows[1]["v"], rows[1]["tag"], rows[1]["tag_process"], rows[2]["match_quality"]) == ("global_order", 3.0, "x", "p", "unmatched")


def frames(spark):
    make = spark.createDataFrame
    return {
        "patterns": make([("5S", "S", "P1", "periodic", "C1"), ("5S", "S", "P2", "fixed_position_repeat", "C2")], "analysis_scope string, station_id string, pattern_id string, pattern_type string, cluster_id string"),
        "pattern_orders": make([("5S", "S", c, "observed", o) for c, o in (("C1", 1), ("C1", 2), ("C2", 3))], "analysis_scope string, station_id string, cluster_id string, role string, global_order bigint"),
        "alerts": make([("5S", "A1", "C1"), ("5S", "A2", "C2")], "analysis_scope string, alert_id string, cluster_id string"),
        "alert_orders": make([("A1", 2), ("A2", 3)], "alert_id string, global_order bigint"),
        "trajectories": make([("5S", "T1"), ("5S", "T2")], "analysis_scope string, trajectory_id string"),
        "trajectory_orders": make([("T1", 1), ("T1", 2), ("T2", 3)], "trajectory_id string, global_order bigint"),
        "code_patterns": make([("5S", "S", "AOI_FAILURE", "5520"), ("5S", "S", "AOI_FAILURE", "7000")], "analysis_scope string, station_id string, source_type string, canonical_code string"),
        "code_pattern_orders": make([("5S", "S", "AOI_FAILURE", c, "observed", o) for c, o in (("5520", 1), ("5520", 2), ("7000", 3))], "analysis_scope string, station_id string, source_type string, canonical_code string, role string, global_order bigint"),
        "code_image_links": make([("5S", 1, "5520", "AOI_FAILURE", "defect"), ("5S", 1, "6000", "AOI_FAILURE", "defect"), ("5S", 2, "5520", "AOI_FAILURE", "defect"), ("5S", 3, "7000", "AOI_FAILURE", "defect")],
                                 "analysis_scope string, global_order bigint, canonical_code string, source_type string, code_status string"),
        "code_space": make([("5S", "5520", "AOI_FAILURE", "cluster", "C1"), ("5S", "5520", "AOI_FAILURE", "trajectory", "T1"), ("5S", "7000", "AOI_FAILURE", "cluster", "C2")],
                           "analysis_scope string, canonical_code string, source_type string, spatial_type string, spatial_id string"),
        "code_space_orders": make([("5S", "5520", "AOI_FAILURE", "cluster", "C1", 1), ("5S", "5520", "AOI_FAILURE", "trajectory", "T1", 2), ("5S", "7000", "AOI_FAILURE", "cluster", "C2", 3)],
                                  "analysis_scope string, canonical_code string, source_type string, spatial_type string, spatial_id string, global_order bigint"),
        "code_conflicts": make([], "analysis_scope string, global_order bigint"),
    }


def test_chosen_code_filters_everything(spark):
    products = spark.createDataFrame([("5S", i) for i in (1, 2, 3)], "analysis_scope string, global_order bigint")
    detections = spark.createDataFrame([("5S", 1, "C1", "local"), ("5S", 2, "C1", "local"), ("5S", 3, "C2", "local")], "analysis_scope string, global_order bigint, cluster_id string, detection_type string")
    tables = frames(spark)
    view = views.result_view(tables, products, detections, CONFIG, {"5520"}, "AOI_FAILURE")
    assert sorted(r["global_order"] for r in view.products.collect()) == [1, 2]
    assert [r["pattern_id"] for r in view.sections["periodic"].collect()] == ["P1"]
    assert [r["canonical_code"] for r in view.sections["code"].collect()] == ["5520"]
    assert [r["trajectory_id"] for r in view.sections["trajectory"].collect()] == ["T1"]
    counts = view.counts.first()
    assert (counts["alert_count"], counts["local_defect_count"]) == (1, 2)
    assert counts["discovered_pattern_count"] == views.pattern_count(view)
    bare = views.result_view({**tables, "code_space": tables["code_space"].limit(0)}, products, detections, CONFIG, {"5520"})
    assert bare.sections["periodic"].count() == 0 and bare.alerts.count() == 0 and bare.sections["code"].count() == 1


def test_model_is_scored_after_an_observed_write(spark):
    """A session that has observed a write cannot travel with the summary of a fit."""
    products, parameters, defects = sixty(spark)
    seen = Observation()
    products.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 60
    joined = process.defect_counts(process.exact_process_join(products, parameters)[0], defects)
    table, summary = process.logistic_importance(joined, ["temperature", "pressure"], batch="batch")
    weights = {r["parameter"]: r["coefficient"] for r in table.collect()}
    assert weights["temperature"] > abs(weights["pressure"]) and summary["validation_auc"] is not None


def test_order_lists_of_repeated_rows_keep_every_row(spark):
    """Equal rows, repeated and null orders, a mapping with several and null targets, and mappings by key."""
    mapping = spark.createDataFrame([(1, 2), (1, 3), (2, None), (4, 8)], "from_order bigint, to_order bigint")
    lists = spark.createDataFrame([(1, "1;4;1"), (1, "1;4;1"), (2, "2"), (3, None), (None, "4")], "i int, o string")
    got = sorted((r["i"] or 0, r["o"]) for r in views.remap_order_lists(lists, "o", mapping).collect())
    assert got == [(0, "8"), (1, "2;3;8;2;3"), (1, "2;3;8;2;3"), (2, ""), (3, "")]
    keyed = spark.createDataFrame([(1, 4, 5), (None, 4, 6)], "i int, from_order bigint, to_order bigint")
    got = sorted((r["i"] or 0, r["o"]) for r in views.remap_order_lists(lists, "o", keyed, ["i"]).collect())
    assert got == [(0, "6"), (1, "5"), (1, "5"), (2, ""), (3, "")]
    orders = spark.createDataFrame([(4,), (4,), (None,), (9,)], "global_order bigint")
    kept = views.filter_order_evidence(lists, orders, ("o",), ("i",))
    assert kept.columns == ["i", "o"] and sorted((r["i"] or 0, r["o"]) for r in kept.collect()) == [(0, "4"), (1, "1;4;1"), (1, "1;4;1")]


def test_order_lists_are_spread_without_their_columns(spark):
    """The exploded rows hold numbers only, so what is shuffled does not grow with the text times its orders."""
    mapping = spark.createDataFrame([(1, 2)], "from_order bigint, to_order bigint")
    lists = spark.createDataFrame([(1, "1;4;1", "x")], "i int, o string, note string")
    orders = spark.createDataFrame([(4,)], "global_order bigint")
    for made in (views.remap_order_lists(lists, "o", mapping), views.filter_order_evidence(lists, orders, ("o",), ("i",))):
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        spread = [line for line in plan if "Generate" in line]
        assert len(spread) == 1 and "note#" not in spread[0]
        below = plan[plan.index(spread[0]):plan.index(spread[0]) + 2]
        assert not any("note#" in line for line in below if "Project" in line)


def test_lists_search_and_nearest(spark):
    mapping = spark.createDataFrame([(1, 2), (2, 4), (3, 7)], "from_order bigint, to_order bigint")
    lists = spark.createDataFrame([(1, "bad;2;99"), (2, "3;1;3"), (3, "")], "i int, o string")
    assert {r["i"]: r["o"] for r in views.remap_order_lists(lists, "o", mapping).collect()} == {1: "4", 2: "7;2;7", 3: ""}
    parts = spark.createDataFrame([(1, "Red steel bolt"), (2, "100% blue")], "i int, n string")
    assert [r["i"] for r in views.search_all_columns(parts, "red*BOLT").collect()] == [1]
    assert [r["i"] for r in views.search_all_columns(parts, "0%").collect()] == [2]
    orders = spark.createDataFrame([(2,), (6,)], "global_order bigint")
    assert views.nearest_order(orders, 4).first()[0] == 2
    asked = spark.createDataFrame([(i,) for i in (0, 2, 4, 5, 9)], "asked_order bigint")
    assert {r["asked_order"]: r["global_order"] for r in views.nearest_orders(asked, orders).collect()} == {0: 2, 2: 2, 4: 2, 5: 6, 9: 6}


def test_whole_job_writes_every_table(spark, tmp_path):
    from linewise.plans.analysis import run_analysis

    products = spark.createDataFrame([("5S", "35_5s_aoi", i, i, f"D{i}", f"A{i}", "evaluable", f"2026-06-10 10:{i:02d}:00") for i in range(1, 9)],
                                     "analysis_scope string, station_id string, global_order bigint, production_order bigint, dmc_raw string, aoi_event_id string, evidence_status string, aoi_test_date string")
    detections = spark.createDataFrame([(f"X{i}", i, 0.3, 0.3, "local", 12) for i in range(1, 9)], "detected_id string, global_order bigint, center_x_norm double, center_y_norm double, detection_type string, component_area int")
    passes = spark.createDataFrame([(f"A{i}", f"D{i}", "35_5s_aoi", "NOK", "AOI", i, "501100000000") for i in range(1, 9)],
                                   "event_id string, dmc_raw string, station_id string, state string, source_sheet string, production_order bigint, aoi_failure_code string").withColumn("test_date", F.lit(None).cast("timestamp_ntz"))
    folder = run_analysis(products, detections, passes, CONFIG, str(tmp_path), "job")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    assert read("discovered_patterns").first()["pattern_type"] == "burst"
    assert read("code_patterns").first()["canonical_code"] == "5011"
    assert read("code_spatial_associations").first()["lift"] == 1.0
    assert {r["evidence_source"] for r in read("station_attribution").collect()} == {"code"}
    assert read("scopes/alerts").where("analysis_scope = '5S'").count() == read("alerts").count() > 0
    total = spark.read.json(f"{folder}/analysis_summary").where("analysis_scope is null").first()
    assert (total["product_count"], total["defect_count"], total["burst_pattern_count"]) == (8, 8, 1)


def test_view_of_the_engines_own_output_on_another_axis(spark):
    """Global orders are not station orders: nothing may vanish from an unfiltered view, and a filter must use the task axis."""
    from linewise.plans.analysis import analyze, view_frames

    products = spark.createDataFrame([("5S", "35_5s_aoi", 1000 + i, i, f"D{i}", f"A{i}", "evaluable", f"2026-06-10 10:{i:02d}:00") for i in range(1, 41)],
                                     "analysis_scope string, station_id string, global_order bigint, production_order bigint, dmc_raw string, aoi_event_id string, evidence_status string, aoi_test_date string")
    marks = [(f"X{i}", 1000 + i, 0.3, 0.3, "local", 12) for i in range(11, 17)] + [(f"Y{i}", 1000 + i, 0.8, 0.7, "local", 12) for i in range(3, 41, 6)]
    detections = spark.createDataFrame(marks, "detected_id string, global_order bigint, center_x_norm double, center_y_norm double, detection_type string, component_area int")
    passes = spark.createDataFrame([(f"A{i}", f"D{i}", "35_5s_aoi", "NOK", "AOI", i, "501100000000" if 11 <= i < 17 else "100000000000") for i in range(1, 41)],
                                   "event_id string, dmc_raw string, station_id string, state string, source_sheet string, production_order bigint, aoi_failure_code string").withColumn("test_date", F.lit(None).cast("timestamp_ntz"))
    frames = view_frames(analyze(products, detections, passes, CONFIG).frames)
    tracked = detections.withColumn("cluster_id", F.lit(None).cast("string"))
    whole = views.result_view(frames, products, tracked, CONFIG)
    assert whole.sections["periodic"].count() == 1 and whole.sections["burst"].count() == 1
    assert "5011" in {r["canonical_code"] for r in whole.sections["code"].collect()}
    assert whole.alerts.count() == frames["alerts"].count() > 2
    burst_only = views.result_view(frames, products.where("global_order between 1013 and 1014"), tracked, CONFIG)
    assert burst_only.sections["periodic"].count() == 0 and burst_only.sections["burst"].count() == 1
    orders = frames["pattern_orders"].where("role = 'observed'").groupBy("cluster_id").agg(F.min("global_order").alias("a"), F.max("global_order").alias("b")).collect()
    assert {(r["a"], r["b"]) for r in orders} == {(1011, 1016), (1003, 1039)}
    none = views.result_view(frames, products.where("global_order = 1001"), tracked, CONFIG)
    assert all(none.sections[name].count() == 0 for name in ("periodic", "burst", "other", "trajectory")) and none.alerts.count() == 0
