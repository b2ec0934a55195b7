"""The live trend as a stream: watermark, sliding windows, sessions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from linewise.streaming import trend

SCHEMA = "line string, at timestamp, state_result string, tolerance_result string"


def day(number, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=number - 1, hours=hour)


def streamed(spark, tmp_path, batches, make):
    """Batches arrive one a trigger; what append mode writes."""
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out"))


def test_a_late_record_is_dropped_and_one_in_time_counts(spark, tmp_path):
    batches = [
        [("a", day(1), "NOK", "OK"), ("a", day(2), "OK", "OK")],
        [("a", day(20), "OK", "NOK")],
        [("a", day(2, 5), "NOK", "NOK"), ("a", day(19), "NOK", "OK")],  # behind the watermark of day 18, and ahead of it
        [("a", day(40), "OK", "OK")],
        [("a", day(41), "OK", "OK")],
    ]
    out = streamed(spark, tmp_path, batches, lambda rows: trend.live_trend(rows, "at", "2 days"))
    got = {r["window_start"]: (r["records"], r["state_nok_rate"], r["tolerance_nok_rate"]) for r in out.collect()}
    assert got == {day(1): (1, 1.0, 0.0), day(2): (1, 0.0, 0.0), day(19): (1, 1.0, 0.0), day(20): (1, 0.0, 1.0)}


@pytest.mark.parametrize("stream", [True, False])
def test_sliding_windows_and_sessions(spark, tmp_path, stream):
    rows = [("a", day(1), "NOK", "OK"), ("a", day(1, 3), "OK", "OK"), ("a", day(3), "OK", "NOK"), ("b", day(1, 1), "NOK", "NOK")]
    ends = [("z", day(60), "OK", "OK")], [("z", day(61), "OK", "OK")]
    sliding = lambda frame: trend.live_trend(frame, "at", "1 day", "2 days", "1 day")
    sessions = lambda frame: trend.live_sessions(frame, "at", ["line"], "6 hours", "1 day")
    results = []
    for name, make in (("sliding", sliding), ("sessions", sessions)):
        if stream:
            (tmp_path / name).mkdir()
            results.append(streamed(spark, tmp_path / name, [rows, *ends], make))
        else:
            results.append(make(spark.createDataFrame(rows, SCHEMA)))
    early = {r["window_start"]: r["records"] for r in results[0].where(F.col("window_start") < F.lit(day(50))).collect()}
    assert early == {day(0): 3, day(1): 3, day(2): 1, day(3): 1}
    found = {(r["line"], r["session_start"], r["session_end"], r["records"]) for r in results[1].where("line <> 'z'").collect()}
    assert found == {("a", day(1), day(1, 9), 2), ("a", day(3), day(3, 6), 1), ("b", day(1, 1), day(1, 7), 1)}
