"""Scalar expressions on keys, states, codes, tolerances, dates and order lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewise.fixed_values import (
    DEFECT_STATUSES, NOK_WORDS, OK_WORDS, SCOPE_TOKENS, TOLERANCE_PATTERN,
)


def norm_key(value: Column) -> Column:
    """Lower-case text with everything but letters and digits removed."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def clean_text(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def number_text(value: Column) -> Column:
    """Text of a double; whole numbers lose their decimal point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9.0e18)
    return (
        F.when(value.isNull() | F.isnan(value), "")
        .when(whole, value.cast("decimal(20,0)").cast("string"))
        .otherwise(F.trim(value.cast("string")))
    )


def is_blank(value: Column) -> Column:
    return clean_text(value) == ""


def blank_to_null(value: Column) -> Column:
    cleaned = F.trim(value.cast("string"))
    return F.when(cleaned != "", cleaned)


def pass_state(value: Column) -> Column:
    """Verdict text of a station pass."""
    text = F.upper(clean_text(value))
    return (
        F.when(text.isin("OK", "NOK"), text)
        .when(text.contains("SCRAP"), "SCRAPPED")
        .when(text.startswith("OTHER"), "OTHERS")
        .otherwise("UNKNOWN")
    )


def test_state(value: Column) -> Column:
    """Verdict text of a measurement record."""
    text = F.upper(clean_text(value))
    return F.when(text.isin(OK_WORDS), "OK").when(text.isin(NOK_WORDS), "NOK").otherwise("UNKNOWN")


test_state.__test__ = False  # not a pytest case


def scope_of_station(station_id: Column) -> Column:
    text = F.lower(F.coalesce(station_id, F.lit("")))
    return reduce(
        lambda chain, pair: chain.when(text.contains(pair[0]), pair[1]),
        SCOPE_TOKENS[1:],
        F.when(text.contains(SCOPE_TOKENS[0][0]), SCOPE_TOKENS[0][1]),
    ).otherwise("")


def layer_of_scope(scope: Column) -> Column:
    return F.regexp_extract(F.coalesce(scope, F.lit("")), r"^\s*([57])", 1)


def aoi_code(value: Column) -> Column:
    """First four digits of the first digit run, '' when it is shorter."""
    digits = F.regexp_extract(clean_text(value), "[0-9]+", 0)
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4)).otherwise("")


def vi_code(value: Column) -> Column:
    """Last four digits once everything else is removed, '' when there are fewer."""
    digits = F.regexp_replace(clean_text(value), "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise("")


def aoi_code_status(code: Column, state: Column) -> Column:
    has_code = code != ""
    return (
        F.when((code == "1000") & (state == "OK"), "normal")
        .when(~has_code & (state == "SCRAPPED"), "scrapped")
        .when(has_code & (code != "1000") & (state != "OK"), "defect")
        .when(has_code, "state_code_conflict")
        .otherwise("unknown")
    )


def vi_code_status(code: Column, state: Column) -> Column:
    return F.when(code != "", "defect").when(state == "SCRAPPED", "scrapped").otherwise("unknown")


def is_defect_status(status: Column) -> Column:
    return status.isin(DEFECT_STATUSES)


def is_analyzable(detection_type: Column) -> Column:
    """Region anomalies are kept for review but never enter statistics."""
    return detection_type.isNull() | (detection_type != "region_anomaly")


def tolerance_bounds(value: Column) -> Column:
    """``struct<lower,upper>`` of a tolerance text, null when it cannot be read."""
    text = F.translate(F.trim(value.cast("string")), "−,", "-")
    lower = F.regexp_extract(text, TOLERANCE_PATTERN, 1).try_cast("double")
    upper = F.regexp_extract(text, TOLERANCE_PATTERN, 2).try_cast("double")
    return F.when(lower <= upper, F.struct(lower.alias("lower"), upper.alias("upper")))


def out_of_tolerance(value: Column, lower: Column, upper: Column) -> Column:
    """Bounds themselves are within tolerance."""
    return (value < lower) | (value > upper)


def verdict(evaluated: Column, violated: Column) -> Column:
    return F.when(evaluated == 0, "UNKNOWN").when(violated > 0, "NOK").otherwise("OK")


def verdicts_conflict(recorded: Column, recomputed: Column) -> Column:
    return (recorded != "UNKNOWN") & (recomputed != "UNKNOWN") & (recorded != recomputed)


_CLOCK = r"(?:[ T]+\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?\s*(?:[AaPp][Mm])?)?$"
_DATE_TEXT = r"^(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})" + _CLOCK


def mixed_timestamp(value: Column) -> Column:
    """Timestamp of year-first or day-first text; unreadable text gives null.

    A day-first text whose second number cannot be a month is read month-first. One
    check and one split per text; the numbers are then only rearranged.
    """
    text = F.trim(value.cast("string"))
    half = F.upper(F.right(text, F.lit(2)))

    def rearranged(parts: Column) -> Column:
        first, second, third = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
        year_first = F.length(first) == 4
        swapped = ~year_first & (second.cast("int") > 12)
        year = F.when(year_first, first).otherwise(third)
        month = F.when(year_first | ~swapped, second).otherwise(first)
        day = F.when(year_first, third).when(swapped, second).otherwise(first)
        number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
        hour = number(3) + F.when((half == "PM") & (number(3) < 12), 12).when((half == "AM") & (number(3) == 12), -12).otherwise(0)
        fraction = F.coalesce(F.nullif(F.get(parts, F.lit(6)), F.lit("")), F.lit("0"))
        two = lambda column: F.lpad(column.cast("string"), 2, "0")
        return F.concat(
            year, F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(number(4)),
            F.lit(":"), two(number(5)), F.lit("."), fraction,
        )

    parts = F.array(F.split(text, "[^0-9]+"))
    return F.when(text.rlike(_DATE_TEXT), F.get(F.transform(parts, rearranged), F.lit(0))).try_cast("timestamp_ntz")


def order_array(value: Column, separators: str = "[;,]") -> Column:
    """Numbers of an order-list text, in text order; parts that are not numbers vanish."""
    parts = F.split(F.coalesce(value.cast("string"), F.lit("")), separators)
    numbers = F.transform(parts, lambda item: F.trim(item).try_cast("double").try_cast("bigint"))
    return F.filter(numbers, lambda item: item.isNotNull())


def order_text(orders: Column) -> Column:
    return F.array_join(F.transform(orders, lambda item: item.cast("string")), ";")


def detection_verdict(aoi_state: Column, detected: Column) -> Column:
    """Compare the algorithm's finding with the recorded station verdict."""
    return (
        F.when(aoi_state == "NOK", F.when(detected, "hit").otherwise("miss_candidate"))
        .when(aoi_state == "OK", F.when(detected, "false_alarm_candidate").otherwise("correct"))
        .otherwise("not_evaluable")
    )


def evidence_status(match_status: Column, has_pair: Column) -> Column:
    return (
        F.when(match_status.isin("ambiguous_event", "unmatched"), "ambiguous_event")
        .when(F.coalesce(has_pair, F.lit(False)), "evaluable")
        .otherwise("unavailable")
    )


def association_strength(support: Column, p_left: Column, p_right: Column, lift: Column) -> Column:
    return (
        F.when((support >= 5) & (F.least(p_left, p_right) >= 0.70) & (lift >= 1.50), "strong")
        .when((support >= 4) & (lift >= 1.20), "medium")
        .otherwise("weak")
    )


def alert_severity(alert_type: Column) -> Column:
    return (
        F.when(alert_type == "burst_detected", "critical")
        .when(alert_type == "fixed_position_repeat_confirmed", "notice")
        .otherwise("warning")
    )


def file_prefix(value: Column) -> Column:
    """Text reduced to characters that are safe in ids."""
    return F.regexp_replace(value, "[^A-Za-z0-9_-]+", "-")
