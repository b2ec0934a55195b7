"""Codes, links, associations, attribution, co-occurrence and transitions."""

from pyspark.sql import functions as F

from linewise.operators import evidence, relations

PASS = "event_id string, dmc_raw string, station_id string, t string, state string, source_sheet string, source_row int, `Result.AOIFailureCode` string, BlockCode string"


def passes(spark):
    rows = [
        ("a1", "D1", "35_5s_aoi", "2026-06-10 10:00:00", "NOK", "AOI", 2, "501100000000", None),
        ("a2", "D2", "35_5s_aoi", "2026-06-10 10:01:00", "OK", "AOI", 3, "100000000000", None),
        ("a3", "D3", "35_5s_aoi", "2026-06-10 10:02:00", "SCRAPPED", "AOI", 4, None, None),
        ("v1", "D1", "35_5s_vi", "2026-06-10 10:05:00", "NOK", "MS0335all", 2, None, "175520_"),
        ("v2", "D2", "35_5s_vi", "2026-06-10 10:06:00", "NOK", "Other", 3, None, "175520_"),
    ]
    return spark.createDataFrame(rows, PASS).withColumn("test_date", F.col("t").cast("timestamp_ntz")).withColumn(
        "production_order", F.lit(1).cast("bigint"))


def test_normalised_codes_keep_sources_apart(spark):
    catalog, issues = evidence.load_catalog(evidence.builtin_catalog(spark))
    assert catalog.count() == 34 and issues.count() == 0
    got = {r["event_id"]: r for r in evidence.normalize_codes(passes(spark), catalog).collect()}
    assert set(got) == {"a1", "a2", "a3", "v1"}
    assert (got["a1"]["canonical_code"], got["a1"]["code_status"], got["a1"]["defect_name"]) == ("5011", "defect", "折皱-活性区")
    assert (got["a2"]["code_status"], got["a3"]["code_status"], got["v1"]["canonical_code"]) == ("normal", "scrapped", "5520")


def test_catalog_override_wins_and_bad_rows_are_issues(spark):
    override = spark.createDataFrame([("5", "5011", "new", "活性区", "no"), ("9", "5011", "x", "", ""), ("7", "70", "x", "", "")], "Layer string, Code string, NAME string, region string, enabled string")
    catalog, issues = evidence.load_catalog(evidence.builtin_catalog(spark), override)
    row = catalog.where("code = '5011' and region = '活性区'").first()
    assert (row["name"], row["enabled"]) == ("new", False)
    assert issues.count() == 2


def linked(spark, with_conflict=True):
    products = spark.createDataFrame([("5S", f"D{i}", i + 1) for i in range(10)], "analysis_scope string, dmc_raw string, global_order bigint")
    rows = []
    for i in range(5):
        rows.append(("5S", "st", f"A{i}", f"D{i}", i, "AOI_FAILURE", "5011", "fold", "defect"))
        rows.append(("5S", "st", f"V{i}", f"D{i}", i, "VI_BLOCK", "5011" if i < 4 else "5520", "", "defect"))
    codes = spark.createDataFrame(rows, "analysis_scope string, station_id string, event_id string, dmc_raw string, production_order bigint, source_type string, canonical_code string, defect_name string, code_status string")
    return products, evidence.map_codes(products, codes)


def test_association_and_conflict(spark):
    products, mapped = linked(spark)
    detections = spark.createDataFrame([("5S", i, "C1") for i in range(1, 6)], "analysis_scope string, global_order bigint, cluster_id string")
    rows = {(r["source_type"], r["canonical_code"]): r for r in evidence.code_spatial(products, mapped, detections).collect()}
    assert rows[("AOI_FAILURE", "5011")]["association_strength"] == "strong"
    assert rows[("AOI_FAILURE", "5011")]["lift"] == 2.0
    conflicts = {r["dmc_raw"]: r["comparison_status"] for r in evidence.label_conflicts(products, mapped).collect()}
    assert conflicts == {"D0": "consistent", "D1": "consistent", "D2": "consistent", "D3": "consistent", "D4": "label_conflict"}


def test_repeated_product_uses_the_event_id(spark):
    products = spark.createDataFrame([("5S", "D1", 1, "A1"), ("5S", "D1", 2, "A2")], "analysis_scope string, dmc_raw string, global_order bigint, aoi_event_id string")
    codes = spark.createDataFrame([("5S", "D1", "A1", "AOI_FAILURE", "5011", "", "defect"), ("5S", "D1", "A2", "AOI_FAILURE", "5520", "", "defect"), ("5S", "D1", "A9", "AOI_FAILURE", "5020", "", "defect")],
                                  "analysis_scope string, dmc_raw string, event_id string, source_type string, canonical_code string, defect_name string, code_status string")
    mapped = evidence.map_codes(products, codes)
    assert {(r["canonical_code"], r["global_order"]) for r in mapped.collect()} == {("5011", 1), ("5520", 2)}


def test_clean_upstream_makes_a_strong_link(spark):
    rows, spots = [], []
    for i in range(5):
        rows += [(i + 1, f"D{i}", "upstream", f"2026-01-01 08:0{i}:00", "evaluable"), (i + 6, f"D{i}", "target", f"2026-01-01 09:0{i}:00", "evaluable")]
        spots.append((i + 6, f"D{i}", "target-T001", 0.5))
    products = spark.createDataFrame(rows, "global_order bigint, dmc_raw string, station_id string, aoi_test_date string, evidence_status string")
    detections = spark.createDataFrame(spots, "global_order bigint, dmc_raw string, trajectory_id string, aligned_y_norm double")
    tracks = spark.createDataFrame([("target-T001", "5S", "target", "linear_drift", "high")], "trajectory_id string, analysis_scope string, station_id string, pattern_type string, registration_quality string")
    none = spark.createDataFrame([], "pattern_id string, analysis_scope string, station_id string, pattern_type string")
    pairs = spark.createDataFrame([], "source_type string, canonical_code string, spatial_id string, analysis_scope string, station_id string, spatial_type string, association_strength string")
    row = evidence.attribution(none, tracks, pairs, products, detections).first()
    assert (row["association_level"], row["equipment_conclusion"]) == ("strong_station_link", "equipment cause unconfirmed")
    marked = detections.unionByName(spark.createDataFrame([(1, "D0", None, 0.51), (2, "D1", None, 0.49)], detections.schema))
    row = evidence.attribution(none, tracks, pairs, products, marked).first()
    assert row["association_level"] == "suspected_station"


def test_cooccurrence_and_transitions(spark):
    products = spark.range(1, 7).select(F.col("id").alias("global_order"))
    defects = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A"), (3, "B"), (5, "B")], "global_order bigint, cluster_id string")
    events = relations.category_events(defects)
    row = relations.cooccurrence(products, events).first()
    assert (row["left_category"], row["right_category"], row["product_count"]) == ("A", "B", 2)
    assert abs(row["lift"] - (2 / 6) / (3 / 6 * 3 / 6)) < 1e-12
    moves = {(r["from_category"], r["to_category"]): (r["transition_count"], r["probability"], r["mean_gap"]) for r in relations.transitions(events).collect()}
    assert moves[("A", "A")] == (2, 2 / 3, 1.0) and moves[("A", "B")] == (2, 2 / 3, 1.5)


def test_scopes_never_mix(spark):
    events = relations.category_events(spark.createDataFrame([("5S", 1, "A"), ("5X", 2, "B")], "analysis_scope string, global_order bigint, defect_type string"))
    products = spark.createDataFrame([("5S", 1), ("5X", 2)], "analysis_scope string, global_order bigint")
    assert relations.cooccurrence(products, events).count() == 0 and relations.transitions(events).count() == 0
