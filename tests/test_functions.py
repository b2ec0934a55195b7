"""Scalar expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linewise import functions as fn
from linewise.config import AnalysisConfig


def column(spark, values, kind, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression(F.col("v"))).collect()]


def test_code_parsers(spark):
    assert column(spark, ["506100000000xxx", "501100000000", "bad", None], "string", fn.aoi_code) == ["5061", "5011", "", ""]
    assert column(spark, ["175520_", "17-55-20", "12"], "string", fn.vi_code) == ["5520", "5520", ""]


def test_states(spark):
    assert column(spark, [" ok", "NOK", "was scrapped", "others x", "", None], "string", fn.pass_state) == [
        "OK", "NOK", "SCRAPPED", "OTHERS", "UNKNOWN", "UNKNOWN"]
    assert column(spark, ["good", "Passed", "ng", "FAIL", "?"], "string", fn.test_state) == ["OK", "OK", "NOK", "NOK", "UNKNOWN"]


def test_tolerances(spark):
    got = column(spark, ["25 ... 70", "0 ~ 6", "-1500 … 1500", "bad", "5 - 9", "5-9", "9 to 5", "1,000～2,000", "−5 to 5", ""], "string", fn.tolerance_bounds)
    assert [tuple(item) if item else None for item in got] == [
        (25, 70), (0, 6), (-1500, 1500), None, (5, 9), None, None, (1000, 2000), (-5, 5), None]


def test_dates(spark):
    got = column(spark, ["2026-07-03 10:00:00", "03.07.2026 1:02:03 PM", "7/13/2026 12:00:00 AM", "2026/7/3", "bad", "31.02.2026"], "string", fn.mixed_timestamp)
    assert got == [dt.datetime(2026, 7, 3, 10), dt.datetime(2026, 7, 3, 13, 2, 3), dt.datetime(2026, 7, 13), dt.datetime(2026, 7, 3), None, None]


def test_text_keys_scopes_lists(spark):
    assert column(spark, [7.0, 7.5, None], "double", fn.number_text) == ["7", "7.5", ""]
    assert column(spark, ["Ident No.", None], "string", fn.norm_key) == ["identno", ""]
    assert column(spark, ["35_5s_aoi", "conveyor_7x_vi", "35_wp1"], "string", fn.scope_of_station) == ["5S", "7X", ""]
    assert column(spark, ["bad;2;99,7.0"], "string", fn.order_array) == [[2, 99, 7]]


def test_detection_verdicts(spark):
    rows = spark.createDataFrame([("NOK", True), ("NOK", False), ("OK", True), ("OK", False), ("", True)], "s string, d boolean")
    got = [row[0] for row in rows.select(fn.detection_verdict(F.col("s"), F.col("d"))).collect()]
    assert got == ["hit", "miss_candidate", "false_alarm_candidate", "correct", "not_evaluable"]


def test_settings_are_checked(spark):
    assert AnalysisConfig().maximum_period == 200
    with pytest.raises(ValueError, match="minimum_period exceeds"):
        AnalysisConfig(minimum_period=10, maximum_period=5)
    with pytest.raises(ValueError, match="lack"):
        AnalysisConfig.from_mapping({})
    flat = AnalysisConfig.from_mapping({"red_min": 99, "detection_profiles": {"5X": {"red_min": 120}}}, require_all=False)
    assert (flat.profile("5s").red_min, flat.profile("5X").red_min) == (99, 120)
    assert flat.snapshot(spark).where("setting = '5X.red_min'").first()["value"] == "120"
