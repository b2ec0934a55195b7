"""File names, worksheets, measurement quality, tables and sinks."""

import pytest
from pyspark.sql import functions as F

from linewise.operators import quality, truth
from linewise.plans.measurement import analyze_measurements
from linewise.sources import images, stations, tables, worksheets

ROWS = "file string, sheet string, row_idx bigint, cells array<string>"


def sheet(spark, rows, name="S", file="f.xlsx"):
    return spark.createDataFrame([(file, name, i, [None if c is None else str(c) for c in row]) for i, row in enumerate(rows, 1)], ROWS)


def test_station_catalog(spark):
    catalog, profiles = stations.stations(spark), stations.image_profiles(spark)
    assert stations.check_stations(catalog, profiles).count() == 0
    broken = catalog.unionByName(catalog.limit(1))
    assert {r["check"] for r in stations.check_stations(broken, profiles).collect()} == {"station_count", "duplicate_station_id", "duplicate_location"}
    declared = spark.createDataFrame([("a", "35_5s_aoi", "3003.10.1.1.1"), ("b", "35_5s_aoi", "3003.10.1.1.6"), ("c", "35_5s_aoi", None)], "source string, station_id string, location string")
    got = {r["source"]: r["level"] for r in stations.location_mismatches(declared, catalog).collect()}
    assert got == {"a": "error", "c": "warning"}


def test_image_index(spark):
    dmc = "LW7ROLL0042"
    names = [f"/r/{dmc}20250624{code}.png" for code in ("DA", "DC", "DE", "DX", "DY")] + ["/r/X20250624EA.png", "/r/Y20259924DA.png", "/r/Z20250624DA.png", "/q/Z20250624DA.jpg"]
    files = spark.createDataFrame([(n, "35_5s_aoi") for n in names], "path string, station_id string")
    parsed = images.parse_image_names(files)
    first = parsed.where(F.col("path").endswith("ROLL004220250624DA.png")).first()
    assert (first["dmc_raw"], str(first["capture_date"]), first["family_code"] + first["view"]) == (dmc, "2025-06-24", "DA")
    expected = spark.createDataFrame([("35_5s_aoi", dmc), ("35_5s_aoi", "NOIMAGE")], "station_id string, dmc_raw string")
    products, issues = images.product_index(parsed, stations.stations(spark), stations.image_profiles(spark), expected)
    rows = {r["dmc_raw"]: r for r in images.number_products(products).collect()}
    assert rows[dmc]["has_primary_pair"] and rows[dmc]["a_image_path"].endswith("DA.png") and rows[dmc]["global_order"] == 1
    assert not rows["NOIMAGE"]["has_primary_pair"] and rows["NOIMAGE"]["has_excel_record"]
    assert rows["Z"]["view_A_path"] is None and not rows["Z"]["has_excel_record"]
    levels = {(r["level"], r["dmc_raw"]) for r in issues.collect()}
    assert {("error", "Z"), ("warning", "NOIMAGE"), ("warning", "X"), ("warning", "")} <= levels
    assert "X" not in rows


def test_flat_sheet(spark):
    """One header for all rows: the station comes from each row's place columns, a tolerance from the column after its value."""
    rows = sheet(spark, [
        ["Ident No.", "State Test", "Test Date", "Line", "ST", "SI", "FU", "WP", "TP", "Result.Gap", "Tolerance", "Result.Torque", "Tolerance "],
        ["LW-7", "NOK", "2025-02-11 06:30:00", 3004, 20, 1, 1, 5, 1, 0.25, "0.1 ... 0.3", None, None],
        ["LW-8", "OK", "2025-02-11 06:31:00", 3004, 20, 1, 1, 2, 1, None, None, 12, "10 ... 14"],
        ["LW-7", "OK", "2025-02-12 06:30:00", 3004, 20, 1, 1, 5, 1, 0.2, "0.1 ... 0.3", 11, None],
    ])
    events, parameters, _ = worksheets.station_tables(worksheets.worksheet_blocks(rows), stations.stations(spark))
    assert [(r["dmc_raw"], r["station_id"], r["state"]) for r in events.orderBy("source_row").collect()] == [("LW-7", "57_wp5", "NOK"), ("LW-8", "57_wp2", "OK"), ("LW-7", "57_wp5", "OK")]
    got = {(r["parameter_name"], r["numeric_value"], r["tolerance_raw"]) for r in parameters.collect()}
    assert got == {("Result.Gap", 0.25, "0.1 ... 0.3"), ("Result.Torque", 12.0, "10 ... 14"), ("Result.Gap", 0.2, "0.1 ... 0.3"), ("Result.Torque", 11.0, None)}
    wide = worksheets.process_frame(worksheets.latest_process_values(parameters), ["57_wp5.Result.Gap", "57_wp2.Result.Torque", "57_wp5.Result.Torque"])
    assert {tuple(r) for r in wide.collect()} == {("LW-7", 0.2, None, 11.0), ("LW-8", None, 12.0, None)}


def test_stacked_blocks_and_package(spark):
    """Blocks with a title row each; a packaging sheet with a repeated header."""
    head = ["Ident No.", "Test Date", "State", "Line", "ST", "SI", "FU", "WP", "TP"]
    at = lambda wp: [3004, 20, 1, 1, wp, 1]
    rows = sheet(spark, [
        ["5-7 WP4"], [*head, "Result.Glue"], ["LW-1", "2025-02-11 06:00:00", "OK", *at(4), 7], ["LW-2", "2025-02-11 06:01:00", "NOK", *at(4), 9],
        ["5-7 WP5", None], [*head, "Result.Light"], ["LW-2", "2025-02-11 06:05:00", "OK", *at(5), 510], ["LW-3", "2025-02-11 06:06:00", "OK", *at(1), 490],
    ], name="Day", file="g.xlsx")
    pack = sheet(spark, [["Unique Part Ident No.", "Packaging Date", "Tray", "Tray"], ["LW-2", "2025-02-13", "T9", "T4"]], name="Out", file="g.xlsx")
    events, parameters, package = worksheets.station_tables(worksheets.worksheet_blocks(rows.unionByName(pack)), stations.stations(spark))
    got = [(r["dmc_raw"], r["station_id"], r["event_id"]) for r in events.orderBy("source_row").collect()]
    assert got == [("LW-1", "57_wp4", "Day:5-7 WP4:3"), ("LW-2", "57_wp4", "Day:5-7 WP4:4"), ("LW-2", "57_wp5", "Day:5-7 WP5:7"), ("LW-3", "57_wp1", "Day:5-7 WP5:8")]
    assert {(r["parameter_name"], r["numeric_value"]) for r in parameters.collect()} == {("Result.Glue", 7.0), ("Result.Glue", 9.0), ("Result.Light", 510.0), ("Result.Light", 490.0)}
    assert (package.count(), package.first()["fields"]["Tray"]) == (1, "T4")
    assert worksheets.sheets_without_blocks(sheet(spark, [["notes"], ["none"]], name="Notes")).count() == 1


def test_truth_takes_the_same_day_pass(spark):
    """A product seen on three days; a day without a pass and a product without a day."""
    events = spark.createDataFrame(
        [(f"p{n}", dmc, "57_5x_aoi", day, state, n) for n, (dmc, day, state) in enumerate([
            ("LW-1", "2025-02-10 22:10:00", "OK"), ("LW-2", "2025-02-11 05:00:00", "OK"), ("LW-1", "2025-02-12 07:45:00", "NOK"), ("LW-1", "2025-02-14 01:00:00", "OK")], 1)],
        "event_id string, dmc_raw string, station_id string, t string, state string, production_order bigint",
    ).withColumn("test_date", F.col("t").cast("timestamp_ntz"))
    asked = [("LW-1", "2025-02-10"), ("LW-1", "2025-02-12"), ("LW-1", "2025-02-13"), ("LW-2", None), ("LW-9", "2025-02-11")]
    products = spark.createDataFrame([("57_5x_aoi", *a) for a in asked], "station_id string, dmc_raw string, d string").withColumn("capture_date", F.col("d").cast("date"))
    rows = {(r["dmc_raw"], r["d"]): r for r in truth.match_truth(products, events).collect()}
    assert [(rows[a]["aoi_event_id"], rows[a]["aoi_state"], rows[a]["production_order"]) for a in asked[:2]] == [("p1", "OK", 1), ("p3", "NOK", 3)]
    assert (rows[asked[2]]["event_match_status"], rows[asked[2]]["production_order"]) == ("ambiguous_event", None)
    assert rows[asked[4]]["truth_match"] == "unmatched"


def measurement_rows(spark):
    """Five passes of three measured values with tolerances and one time value without."""
    head = ["Ident No.", "Batch", "TTNR", "Variant", "State", "Line", "Test Date", "Result.Gap", "Tolerance", "Result.Torque", "Tolerance", "Result.Charge", "Tolerance", "Result.TimeStamping", "Tolerance"]
    measured = [("OK", 0.2, 12, -40), ("OK", 0.5, 12, -40), ("NOK", 0.2, 15, 900), ("NOK", 0.2, 12, 30), ("OK", 0.3, 11, 20)]
    rows = [
        [f"LW-{n}", f"K{n % 2}", f"T{n % 3}", "07", state, 3100 + n % 2, f"2025-02-1{n} 08:00:00", gap, "0.1 ... 0.3", torque, "10 ~ 14" if n != 5 else "open", charge, "-250 … 250", f"2025-02-1{n} 08:00:05", None]
        for n, (state, gap, torque, charge) in enumerate(measured, 1)
    ]
    query = sheet(spark, [["Query parameter"], ["Location(s)", "3004.20.1.1.5"]], name="Query parameter")
    return sheet(spark, [head, *rows], name="Data").unionByName(query)


def test_measurement_quality(spark):
    rows = measurement_rows(spark)
    assert worksheets.query_parameters(rows).first()["value"] == "3004.20.1.1.5"
    data = rows.where("sheet = 'Data'")
    layout = worksheets.measurement_layout(data).first()
    assert [(p["value_column"], p["tolerance_column"]) for p in layout["pairs"]] == [
        ("Result.Gap", "Tolerance"), ("Result.Torque", "Tolerance__2"), ("Result.Charge", "Tolerance__3")]
    frames = analyze_measurements(data)
    summary = frames["summary"].first()
    # pass 2 breaks the gap though OK; pass 3 breaks torque and charge; pass 4 is NOK without a broken value
    assert (summary["record_count"], summary["state_nok_count"], summary["tolerance_nok_count"], summary["judgement_conflict_count"]) == (5, 2, 2, 2)
    assert frames["tolerance_violations"].count() == 3
    assert {r["dimension"] for r in frames["group_quality"].collect()} == {"variant", "batch", "line", "ttnr"}
    specs = {r["parameter"]: (r["lower"], r["parse_status"]) for r in frames["parameter_specs"].collect()}
    assert specs["Result.Charge"] == (-250, "valid") and specs["Result.Torque"][1] == "partially_invalid"
    assert worksheets.mapping_errors(data, {"state": "Absent", "line": "Line"}).count() == 1


def test_previews_projections_and_listings(spark, tmp_path):
    rows = measurement_rows(spark)
    assert [r["row_idx"] for r in worksheets.preview(rows, "f.xlsx", "Data", 2).collect()] == [2, 3]
    records = spark.createDataFrame([("LW-1", "K1", 3.0, "x")], "dmc_raw string, batch string, `Result.Gap` double, note string")
    assert worksheets.relationship_columns(records, ["Result.Gap", "Absent"]).columns == ["dmc_raw", "batch", "Result.Gap"]
    tall = quality.to_tall(records.withColumn("tol", F.lit("1 ... 2")), [("gap", "Result.Gap", "tol"), ("note", "note", None)], ["dmc_raw"])
    assert {(r["parameter"], r["value"], r["tolerance_raw"], r["has_tolerance"]) for r in tall.collect()} == {("gap", 3.0, "1 ... 2", True), ("note", None, None, False)}
    for name in ("a/one.PNG", "a/b/two.jpeg", "a/three.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    assert sorted((r["path"].rsplit("/", 1)[-1], r["length"]) for r in images.list_images(spark, str(tmp_path)).collect()) == [("one.PNG", 5), ("two.jpeg", 5)]
    (tmp_path / "p.csv").write_text("dmc_raw,speed\nLW-1,2.5\n")
    assert tables.read_parameters(spark, str(tmp_path / "p.csv")).first()["speed"] == 2.5
    assert tables.read_parameters(spark, str(tmp_path / "p.csv"), "dmc_raw string, speed string").first()["speed"] == "2.5"
    seen = spark.createDataFrame([("e2", "LW-1", None, "S", 1), ("e1", "LW-1", "2025-02-11 08:00:00", "S", 2), ("e3", "LW-2", None, "S", 3)], "event_id string, dmc_raw string, t string, source_sheet string, source_row bigint")
    assert [r["event_id"] for r in truth.timeline(seen.withColumn("test_date", F.col("t").cast("timestamp_ntz")), "LW-1").collect()] == ["e1", "e2"]


def test_visual_inspection_profile(spark):
    """Visual inspection sheets hold categories only; states come from the result column."""
    head = ["Ident No.", "StationNo", "Result.From", "Result.AOI Result", "Block code", "Failures code", "Failures area", "fail1", "Document Version"]
    rows = sheet(spark, [head, ["LW-1", "31", "VI", "NOK", "K7", "022010", "[4]", "edge", "D2"], ["LW-2", "31", "AOI", "NOK", "K7", "022010", "", "", "D2"], ["LW-3", "32", "AOI", "OK", "K8", "", "", "", "D2"]])
    frames = analyze_measurements(rows)
    assert frames["parameter_specs"].count() == 0 and frames["summary"].first()["state_nok_count"] == 2
    counts = {(r["field"], r["value"]): r["value_count"] for r in frames["categorical_statistics"].collect()}
    assert (counts[("StationNo", "31")], counts[("StationNo", "32")], counts[("Failures code", "022010")]) == (2, 1, 2)


def test_validations(spark):
    bad = spark.createDataFrame([(1, "5S", 0), (1, "5S", 1), (0, None, 2)], "global_order bigint, camera string, p int")
    items = {r["item"]: r["result"] for r in quality.validate_products(bad, "p").collect()}
    assert items["duplicate_order"] == "1" and items["missing_columns"] == "e_image_path" and int(items["order_not_increasing"]) > 0 and items["empty_cells"] == "1"
    none = spark.createDataFrame([("a",)], "dmc_raw string")
    assert "no_numeric_parameter" in {r["item"] for r in quality.validate_parameters(none).collect()}


def test_tables_and_run_folder(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    with open(path, "w") as handle:
        handle.write("global_order,order_code,dmc_raw,camera,a_image_path,e_image_path\n1,o,d,5s,a,e\n2,o,d2,5x,a,e\n")
    products = tables.with_scope_order(tables.read_products(spark, path))
    assert {(r["analysis_scope"], r["scope_order"]) for r in products.collect()} == {("5S", 1), ("5X", 1)}
    with pytest.raises(ValueError, match="lacks"):
        tables.read_products(spark, path, "x string")
    assert [r["bytes"] for r in images.fingerprints(spark, [path]).collect()] and len(images.fingerprints(spark, [path]).first()["sha256"]) == 64
    folders = []
    for _ in range(2):
        with tables.RunFolder(spark, str(tmp_path / "runs"), 'my: "task"') as folder:
            folder.write({"products": products})
            folder.write_by_scope({"products": products})
            folder.write({"rows": products}, csv=True)
        folders.append(folder.final)
    assert folders[0] != folders[1]
    assert spark.read.parquet(f"{folders[0]}/scopes/products").where("analysis_scope = '5X'").count() == 1
    with pytest.raises(RuntimeError):
        with tables.RunFolder(spark, str(tmp_path / "runs"), "bad") as folder:
            folder.write({"products": products})
            raise RuntimeError
    assert [tables.run_status(spark, f) for f in (*folders, folder.final)] == ["complete", "complete", "failed"]
    assert tables.folder_name("Straße / week 7 " + "x" * 200) == "Straße-week-7-" + "x" * 200
    with pytest.raises(ValueError):
        tables.folder_name(" .")
