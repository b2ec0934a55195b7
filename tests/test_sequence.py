"""Positions, runs and periods, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from linewise.config import AnalysisConfig
from linewise.operators import ordering, process, sequence
from linewise.plans.queries import QUERIES

CONFIG = AnalysisConfig()


def brute_period(orders, config, eligible):
    """Direct reading of the definition, for small series."""
    values, best = sorted(set(orders)), None
    tolerance, minimum = config.period_order_tolerance, config.minimum_repeat_occurrences
    for period in range(config.minimum_period, config.maximum_period + 1):
        for residue in sorted({v % period for v in values}):
            hits = [v for v in values if min((v - residue) % period, (residue - v) % period) <= tolerance]
            slots = len([v for v in range(hits[0], hits[-1] + 1, period) if v in eligible]) if len(hits) >= minimum else 0
            if not slots:
                continue
            p, c = len(hits) / len(values), min(1.0, len(hits) / slots)
            if p >= config.minimum_period_precision and c >= config.minimum_period_coverage:
                key = (2 * p * c / (p + c), c, p, -period, -residue)
                if best is None or key > best[0]:
                    best = (key, period, hits[0])
    return None if best is None else best[1:]


def frame(spark, groups):
    return spark.createDataFrame([(k, o) for k, orders in groups.items() for o in orders], "k string, o bigint")


def test_period_prefers_the_fundamental_and_tolerates_misses(spark):
    orders = [v for v in range(13, 501, 24) if v not in (85, 373)]
    eligible = spark.range(1, 501).withColumnRenamed("id", "o")
    row = sequence.fit_period(frame(spark, {"a": orders}), ["k"], "o", CONFIG, eligible, []).first()
    assert (row["period"], row["phase_start"]) == (24, 13)
    observed = frame(spark, {"a": orders})
    fits = sequence.fit_period(observed, ["k"], "o", CONFIG, eligible, [])
    missing = sequence.missing_slots(fits, observed, ["k"], "o", eligible, [])
    assert sorted(r["missing_order"] for r in missing.collect()) == [85, 373]


@pytest.mark.parametrize("tolerance", [0, 1])
def test_period_equals_brute_force(spark, tolerance):
    rng = random.Random(5 + tolerance)
    config = AnalysisConfig(maximum_period=24, period_order_tolerance=tolerance, minimum_period_coverage=0.4)
    groups, eligible = {}, sorted(rng.sample(range(1, 200), 150))
    for i in range(40):
        period, phase = rng.randint(2, 20), rng.randint(1, 20)
        series = [v for v in range(phase, 199, period) if rng.random() > 0.2] + rng.sample(range(1, 199), rng.randint(0, 4))
        groups[f"g{i}"] = [v for v in series if v in set(eligible)]
    groups = {k: v for k, v in groups.items() if v}
    slots = spark.createDataFrame([(v,) for v in eligible], "o bigint")
    rows = sequence.fit_period(frame(spark, groups), ["k"], "o", config, slots, []).collect()
    got = {r["k"]: (r["period"], r["phase_start"]) for r in rows}
    want = {k: brute_period(v, config, set(eligible)) for k, v in groups.items()}
    assert got == {k: v for k, v in want.items() if v}
    assert len(got) > 5


def brute_candidates(orders, config):
    """(period, residue, matched) of every class that passes, counted one by one."""
    values, tolerance = sorted(set(orders)), config.period_order_tolerance
    for period in range(config.minimum_period, config.maximum_period + 1):
        for residue in sorted({v % period for v in values}):
            hits = sum(min((v - residue) % period, (residue - v) % period) <= tolerance for v in values)
            if hits >= config.minimum_repeat_occurrences and hits / len(values) >= config.minimum_period_precision:
                yield period, residue, hits


@pytest.mark.parametrize("tolerance,low,limit", [(0, 2, 10_000), (1, 1, 10_000), (2, 30, 10_000), (9, 2, 10_000), (1, 2, 100)])
def test_pruned_periods_equal_all_periods(spark, monkeypatch, tolerance, low, limit):
    monkeypatch.setattr(sequence, "PRUNED_PERIODS", limit)
    rng = random.Random(tolerance)
    config = AnalysisConfig(minimum_period=low, period_order_tolerance=tolerance)
    groups = {f"noise{i}": rng.sample(range(900), 25) for i in range(4)}
    for period in (8, 27, 36, 97, 128, 144, 180):
        groups[f"p{period}"] = [v + rng.randint(-tolerance, tolerance) for v in range(20, 2000, period)] + rng.sample(range(2000), 1)
    rows = sequence.period_candidates(frame(spark, groups), ["k"], "o", config).collect()
    got = sorted((r["k"], r["period"], r["residue"], r["matched"]) for r in rows)
    assert got == sorted((k, *found) for k, orders in groups.items() for found in brute_candidates(orders, config))


def test_tolerant_periods_are_pruned(spark, monkeypatch):
    """Each order meets the periods tested first and then only those that can still pass, not all 199."""
    counted, count = [], sequence._residue_counts

    def seen(observed, keys, order, periods, tolerance):
        counted.append(observed.select(F.explode(periods)).count() / 40)
        return count(observed, keys, order, periods, tolerance)

    monkeypatch.setattr(sequence, "_residue_counts", seen)
    orders = list(range(5, 5 + 40 * 36, 36))
    rows = sequence.period_candidates(frame(spark, {"a": orders}), ["k"], "o", AnalysisConfig(period_order_tolerance=1)).collect()
    assert 36 in {r["period"] for r in rows} and sum(counted) < 70


def test_tolerant_query_searches_the_default_range(spark, tmp_path):
    items = [(o, n, "R" if o % 6 == 0 else "A") for o in range(1, 200) for n in (1, 2)]
    spark.createDataFrame(items, "l_orderkey bigint, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["place"]: (r["period"], r["phase_start"]) for r in QUERIES["period_of_carrier_places_tolerant"](spark, str(tmp_path)).collect()}
    config = AnalysisConfig(period_order_tolerance=1, minimum_period_coverage=0.3)
    eligible = {o * 7 + n for o, n, _ in items}
    assert got == {n: brute_period([o * 7 + n for o, m, f in items if f == "R" and m == n], config, eligible) for n in (1, 2)}
    assert {period for period, _ in got.values()} == {42}


def test_runs_and_neighbours_across_blocks(spark):
    rng = random.Random(3)
    groups = {k: sorted({v for v in range(-40, 200) if rng.random() < share}) for k, share in (("a", 0.3), ("b", 0.9), ("c", 1.0))}
    observed = frame(spark, groups)
    got = {}
    for row in ordering.consecutive_runs(observed, ["k"], "o", block=7).collect():
        got.setdefault(row["k"], []).append((row["run_start"], row["run_end"]))
    for key, orders in groups.items():
        runs, start = [], orders[0]
        for left, right in zip(orders, orders[1:] + [None]):
            if right != left + 1:
                runs.append((start, left))
                start = right
        assert sorted(got[key]) == runs
    for row in ordering.next_orders(observed, ["k"], "o", "p", "n", block=7).collect():
        orders = groups[row["k"]]
        at = orders.index(row["o"])
        assert row["p"] == (orders[at - 1] if at else None)
        assert row["n"] == (orders[at + 1] if at + 1 < len(orders) else None)
    first = {r["k"]: (r["run_length"], r["run_start"]) for r in sequence.longest_run(observed, ["k"], "o").collect()}
    assert first["c"] == (240, -40)


def test_ranks_totals_and_carries_of_one_hot_group(spark):
    rows = [("hot", None if i % 50 == 0 else i * 37 % 1000, i) for i in range(3000)] + [(None, 5, 1), ("cold", 1, 2), ("cold", 1, 1)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint").repartition(8)
    got = {(r["k"], r["i"]): r["r"] for r in ordering.rank_in_groups(df, ["k"], ["t", "i"], "r").collect()}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    assert [got[("hot", r[2])] for r in hot] == list(range(1, 3001))
    assert (got[("cold", 1)], got[("cold", 2)], got[(None, 1)]) == (1, 2, 1)
    totals = {(r["k"], r["i"]): r["s"] for r in ordering.totals_before(df, ["k"], ["t", "i"], {"s": "i"}).collect()}
    running = 0
    for row in hot:
        assert totals[("hot", row[2])] == running
        running += row[2]
    carried = ordering.nearest_non_null(df.withColumn("v", F.when(F.col("i") % 97 == 0, F.col("i"))), ["k"], ["i"], "v", "p", "n")
    for row in carried.where("k = 'hot'").collect():
        assert row["p"] == row["i"] // 97 * 97
        assert row["n"] == (-(-row["i"] // 97) * 97 if -(-row["i"] // 97) * 97 < 3000 else None)


def test_average_rank_matches_pandas(spark):
    rows = [(i % 2, float(i * i % 11)) for i in range(60)]
    got = process.average_rank(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").toPandas()
    assert (got.groupby("k")["v"].rank(method="average") == got["average_rank"]).all()


def code_rows(spark):
    rows = [("5S", "35_5s_aoi", f"E{i}", f"D{i}", o, "AOI_FAILURE", "5011" if i < 4 else "5020", "", "NOK", "defect")
            for i, o in enumerate([1, 3, 5, 7, 2, 4, 6, 8])]
    return spark.createDataFrame(rows, "analysis_scope string, station_id string, event_id string, dmc_raw string, production_order bigint, "
                                       "source_type string, canonical_code string, defect_name string, state string, code_status string")


def test_codes_alone_or_as_a_family(spark):
    config, codes = AnalysisConfig(maximum_period=30), code_rows(spark)
    alone = sequence.code_patterns(codes, config, ["5011", "5020"])
    assert {r["canonical_code"] for r in alone.collect()} == {"5011", "5020"}
    merged = sequence.code_patterns(codes, config, ["5011", "5020"], merge=True)
    row = merged.first()
    assert (row["pattern_id"], row["canonical_code"], row["pattern_type"]) == ("CP0001", "5011+5020", "burst")
    links = codes.withColumn("global_order", F.substring("event_id", 2, 3).cast("bigint") + 101)
    evidence = sequence.pattern_image_links(codes, merged, links, ["5011", "5020"], merge=True)
    assert sorted(r["global_order"] for r in evidence.where("role = 'observed'").collect()) == list(range(101, 109))


def test_passes_keep_retests_and_unknown_times(spark):
    rows = [("later", "D1", "S", "2026-01-01 10:02:00", 3), ("first", "D1", "S", "2026-01-01 10:01:00", 2), ("none", "D2", "S", None, 4)]
    events = spark.createDataFrame(rows, "event_id string, dmc_raw string, station_id string, t string, source_row int").withColumn(
        "test_date", F.col("t").cast("timestamp_ntz"))
    got = {r["event_id"]: r["production_order"] for r in sequence.production_order(events).collect()}
    assert got == {"first": 1, "later": 2, "none": None}


def test_evidence_strip(spark):
    observed = spark.createDataFrame([("P", 1), ("P", 3)], "pattern_id string, global_order bigint")
    missing = spark.createDataFrame([("P", 2)], "pattern_id string, global_order bigint")
    products = spark.createDataFrame([(1, "evaluable"), (2, "evaluable"), (3, "unavailable")], "global_order bigint, evidence_status string")
    got = {r["global_order"]: r["status"] for r in sequence.evidence_strip(observed, missing, products, ["pattern_id"]).collect()}
    assert got == {1: "observed", 2: "missing", 3: "unavailable"}


def test_order_lists_are_cut_by_block(spark):
    members = spark.createDataFrame([("a", o) for o in (1, 2, 9, 12, 2)], "k string, o bigint")
    parts = ordering.order_list_parts(members, ["k"], "o", block=10).orderBy("part").collect()
    assert [r["orders"] for r in parts] == ["1;2;9", "12"]


@pytest.mark.parametrize("precision", [0.75, 0.9, 1.0, 0.6])
def test_periods_up_to_the_legal_end(spark, precision):
    """Shared divisors of gaps leave out no class; periods of hundreds of thousands are found."""
    rng = random.Random(8)
    groups = {"far": [5 + 700_003 * k for k in range(6)] + [12], "two": [3, 1_000_003], "run": list(range(50, 60))}
    for number in range(30):
        period, phase = rng.choice([1, 2, 6, 12, 35, 97]), rng.randint(1, 40)
        groups[f"g{number}"] = [phase + period * k for k in sorted(rng.sample(range(60), rng.randint(3, 12)))] + rng.sample(range(1, 900), rng.randint(0, 4))
    config = AnalysisConfig(minimum_period=1, maximum_period=120, minimum_period_precision=precision, minimum_repeat_occurrences=2)
    rows = sequence.period_candidates(frame(spark, groups), ["k"], "o", config).collect()
    want = {(k, *found) for k, orders in groups.items() for found in brute_candidates(orders, config)}
    assert {(r["k"], r["period"], r["residue"], r["matched"]) for r in rows} == want
    if precision >= 0.75:
        wide = AnalysisConfig(maximum_period=1_000_000, minimum_period_precision=precision)
        found = {(r["k"], r["period"]) for r in sequence.period_candidates(frame(spark, groups), ["k"], "o", wide).collect()}
        assert (("far", 700_003) in found) == (precision < 0.85)
