"""Ordered-sequence operators: production order, runs, periods, pattern classes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.config import AnalysisConfig
from linewise.functions import is_defect_status
from linewise.operators.joining import lookup_join, match_join
from linewise.operators.ordering import BLOCK, consecutive_runs, next_orders, number_rows, rank_in_groups
from linewise.session import cut_lineage

PRUNED_PERIODS = 10_000  # a table of the divisors of longer tolerant ranges is too much for a plan
CODE_GROUP = ["analysis_scope", "station_id", "source_type"]


def production_order(
    passes: DataFrame, time: str = "test_date", ties: Sequence[str] = ("source_sheet", "source_row", "event_id"),
    station: str = "station_id",
) -> DataFrame:
    """Rank every pass of a station by real time; passes without a time get no rank."""
    present = [name for name in ties if name in passes.columns]
    ranked = rank_in_groups(passes, [station], [time, *present], "production_order")
    return ranked.withColumn("production_order", F.when(F.col(time).isNotNull(), F.col("production_order")))


def longest_run(observed: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First longest run of consecutive orders per group."""
    runs = consecutive_runs(observed, keys, order)
    best = runs.groupBy(*keys).agg(
        F.max(F.struct("run_length", (-F.col("run_start")).alias("_start"), "run_end")).alias("_best")
    )
    return best.select(
        *keys, F.col("_best.run_length").alias("run_length"),
        (-F.col("_best._start")).alias("run_start"), F.col("_best.run_end").alias("run_end"),
    )


def _primes(limit: int) -> list[int]:
    return [n for n in range(2, limit + 1) if all(n % d for d in range(2, int(n**0.5) + 1))]


def tested_periods(config: AnalysisConfig) -> list[int]:
    """Periods to count before their multiples: primes, and with a tolerance all up to three times the width of a class."""
    high, tolerance = config.maximum_period, config.period_order_tolerance
    if tolerance > 0 and high > PRUNED_PERIODS:
        return []
    return sorted({*_primes(high), *range(4, min(high, 3 * (2 * tolerance + 1)) + 1)})


def _residue_counts(
    observed: DataFrame, keys: Sequence[str], order: str, periods: Column, tolerance: int
) -> DataFrame:
    """Matched count, first and last order per (group, period, observed residue)."""
    spread = observed.select(*keys, order, F.explode(periods).alias("period"))
    own = spread.groupBy(*keys, "period", F.pmod(order, "period").alias("residue")).agg(
        F.count("*").alias("matched"), F.min(order).alias("first_match"), F.max(order).alias("last_match")
    )
    if tolerance == 0:
        return own
    # counted residues reach their neighbours, so the tolerance multiplies residues, not orders
    reach = F.least(F.lit(tolerance), F.floor(F.col("period") / 2))
    near = F.array_distinct(F.transform(F.sequence(-reach, reach), lambda k: F.pmod(F.col("residue") + k, F.col("period"))))
    reached = own.withColumn("_from", F.col("residue")).withColumn("residue", F.explode(near))
    return (
        reached.groupBy(*keys, "period", "residue")
        .agg(
            F.sum("matched").alias("matched"), F.min("first_match").alias("first_match"),
            F.max("last_match").alias("last_match"), F.bool_or(F.col("_from") == F.col("residue")).alias("_own"),
        )
        .where("_own").drop("_own")
    )


def _shared_divisors(orders: DataFrame, sizes: DataFrame, keys: Sequence[str], order: str, config: AnalysisConfig) -> DataFrame:
    """keys, _open: the periods that divide enough gaps between neighbouring orders of a group.

    Of n orders at most k = floor((1 - precision) * n) lie outside a class, and each of them spoils two gaps at most, so a
    period that can pass divides at least n - 1 - 2 * k of the n - 1 gaps; with a precision of 3/4 or more that is at least
    one gap. Divisors come from distinct gaps, so the longest period does not matter for the work.
    """
    gaps = next_orders(orders, keys, order).where("next_order is not null").groupBy(*keys, (F.col("next_order") - F.col(order)).alias("gap")).agg(F.count("*").alias("times"))
    root = F.floor(F.sqrt("gap") + F.lit(1e-9)).cast("bigint")
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), root), lambda d: F.col("gap") % d == 0)
    divisors = F.array_distinct(F.concat(small, F.transform(small, lambda d: F.floor(F.col("gap") / d))))
    legal = F.filter(divisors, lambda d: d.between(config.minimum_period, config.maximum_period))
    divided = gaps.select(*keys, "times", F.explode(legal).alias("period")).groupBy(*keys, "period").agg(F.sum("times").alias("divided"))
    outside = F.floor(F.col("occurrences") * F.lit(1 - config.minimum_period_precision) + F.lit(1e-9))
    enough = match_join(divided, sizes, keys).where(F.col("divided") >= F.col("occurrences") - 1 - 2 * outside)
    return enough.groupBy(*keys).agg(F.collect_list("period").alias("_open"))


def period_candidates(
    observed: DataFrame, keys: Sequence[str], order: str, config: AnalysisConfig
) -> DataFrame:
    """(group, period, residue) with enough matches and precision.

    A residue class of a period, tolerance included, lies inside the class of each of its
    divisors, so a group whose share is too small for a divisor cannot pass any multiple
    of it. Without a tolerance, and where three quarters of the orders must match, only divisors that gaps share are
    counted. Otherwise primes are counted first and composites only for the groups left over. With a
    tolerance, classes of small divisors hold nearly all orders and rule out nothing, so
    every period up to three times the width of a class is counted first too.
    """
    low, high, tolerance = config.minimum_period, config.maximum_period, config.period_order_tolerance
    orders = observed.where(F.col(order).isNotNull()).select(*keys, F.col(order).cast("bigint").alias(order)).distinct()
    sizes = (
        orders.groupBy(*keys).agg(F.count("*").alias("occurrences"))
        .where(F.col("occurrences") >= config.minimum_repeat_occurrences)
    )

    def passing(counts: DataFrame) -> DataFrame:
        """Counts meet the group sizes after aggregation, so the orders are never joined."""
        frequent = counts.where(F.col("matched") >= config.minimum_repeat_occurrences)
        return match_join(frequent, sizes, keys).where(F.col("matched") / F.col("occurrences") >= config.minimum_period_precision)

    if tolerance == 0 and config.minimum_period_precision >= 0.75:
        shared = lookup_join(orders, _shared_divisors(orders, sizes, keys, order, config), keys)
        return passing(_residue_counts(shared, keys, order, F.col("_open"), 0))
    tested = tested_periods(config)
    if not tested:
        periods = F.sequence(F.lit(low), F.lit(high))
        return passing(_residue_counts(orders, keys, order, periods, tolerance))
    # few rows survive; stored once because the next steps read them again
    first = cut_lineage(passing(_residue_counts(orders, keys, order, F.array(*map(F.lit, tested)), tolerance)))
    kept = first.where(F.col("period") >= low)
    if low == 1:
        kept = kept.unionByName(passing(_residue_counts(orders, keys, order, F.array(F.lit(1)), tolerance)))
    held = set(tested)
    composites = [n for n in range(max(low, 4), high + 1) if n not in held]
    if not composites:
        return kept
    factor_rows = F.array(*[
        F.struct(F.lit(n).alias("period"), F.array(*[F.lit(p) for p in tested if n % p == 0]).alias("factors"))
        for n in composites
    ])
    open_periods = first.groupBy(*keys).agg(F.collect_set("period").alias("_passed")).select(
        *keys,
        F.transform(
            F.filter(factor_rows, lambda item: F.size(F.array_except(item["factors"], "_passed")) == 0),
            lambda item: item["period"],
        ).alias("_open"),
    ).where(F.size("_open") > 0)
    rest = lookup_join(orders, open_periods, keys)
    return kept.unionByName(passing(_residue_counts(rest, keys, order, F.col("_open"), tolerance)))


def _on_line(
    fits: DataFrame, start: str, slots: DataFrame, slot: str, slot_keys: Sequence[str]
) -> DataFrame:
    """Slots that are whole periods away from ``start``, for every row of ``fits``.

    Each slot is expanded only to the periods its group really has, then meets the
    fits by equality on (group, period, slot mod period); no pair is tried in vain.
    """
    lines = fits.withColumn("_line", F.pmod(start, "period"))
    periods = lines.groupBy(*slot_keys).agg(F.collect_set("period").alias("_periods"))
    spread = lookup_join(slots, periods, slot_keys).select(*slot_keys, slot, F.explode("_periods").alias("period"))
    return lookup_join(
        spread.withColumn("_line", F.pmod(slot, "period")), lines, [*slot_keys, "period", "_line"]
    ).drop("_line")


def fit_period(
    observed: DataFrame, keys: Sequence[str], order: str, config: AnalysisConfig,
    eligible: DataFrame | None = None, eligible_keys: Sequence[str] = (), eligible_order: str | None = None,
) -> DataFrame:
    """Best period per group by (confidence, coverage, precision, shorter, smaller residue).

    ``eligible`` lists the orders at which an occurrence was possible, per
    ``eligible_keys`` (a part of ``keys``); without it every slot counts.
    """
    candidates = period_candidates(observed, keys, order, config)
    identity = [*keys, "occurrences", "period", "residue", "matched", "first_match", "last_match"]
    if eligible is None:
        slotted = candidates.withColumn(
            "slots", F.floor((F.col("last_match") - F.col("first_match")) / F.col("period")) + 1
        )
    else:
        eligible_order = eligible_order or order
        slots = (
            eligible.where(F.col(eligible_order).isNotNull())
            .select(*eligible_keys, F.col(eligible_order).cast("bigint").alias("_slot")).distinct()
        )
        reached = _on_line(candidates, "first_match", slots, "_slot", eligible_keys).where(
            F.col("_slot").between(F.col("first_match"), F.col("last_match"))
        )
        slotted = reached.groupBy(*identity).agg(F.count("*").alias("slots"))
    precision = F.col("matched") / F.col("occurrences")
    scored = (
        slotted.withColumn("precision", precision)
        .withColumn("coverage", F.least(F.lit(1.0), F.col("matched") / F.col("slots")))
        .where(F.col("coverage") >= config.minimum_period_coverage)
        .withColumn(
            "confidence",
            F.lit(2.0) * F.col("precision") * F.col("coverage") / (F.col("precision") + F.col("coverage")),
        )
    )
    best = scored.groupBy(*keys).agg(
        F.max(
            F.struct(
                "confidence", "coverage", "precision", (-F.col("period")).alias("p"),
                (-F.col("residue")).alias("r"), "first_match", "last_match", "matched", "occurrences",
            )
        ).alias("b")
    )
    return best.select(
        *keys, (-F.col("b.p")).cast("bigint").alias("period"), F.col("b.first_match").alias("phase_start"),
        F.col("b.precision").alias("precision"), F.col("b.coverage").alias("coverage"),
        F.col("b.confidence").alias("confidence"), F.col("b.matched").alias("matched_count"),
        F.col("b.occurrences").alias("occurrence_count"),
    )


def missing_slots(
    fits: DataFrame, observed: DataFrame, keys: Sequence[str], order: str,
    eligible: DataFrame, eligible_keys: Sequence[str], eligible_order: str | None = None,
) -> DataFrame:
    """Eligible slots of a fitted period, up to the group's last order, with nothing observed."""
    eligible_order = eligible_order or order
    last = observed.groupBy(*keys).agg(F.max(order).cast("bigint").alias("_last"))
    slots = (
        eligible.where(F.col(eligible_order).isNotNull())
        .select(*eligible_keys, F.col(eligible_order).cast("bigint").alias("missing_order")).distinct()
    )
    bounded = match_join(fits.select(*keys, "period", "phase_start"), last, keys)
    expected = _on_line(bounded, "phase_start", slots, "missing_order", eligible_keys).where(
        F.col("missing_order").between(F.col("phase_start"), F.col("_last"))
    )
    seen = observed.select(*keys, F.col(order).cast("bigint").alias("missing_order")).distinct()
    return match_join(expected, seen, [*keys, "missing_order"], "left_anti").select(*keys, "missing_order")


def classify_sequences(
    observed: DataFrame, keys: Sequence[str], order: str, config: AnalysisConfig,
    eligible: DataFrame, eligible_keys: Sequence[str], repeat_name: str,
    eligible_order: str | None = None, burst_reports_run: bool = False,
) -> DataFrame:
    """One row per group with enough occurrences: periodic, burst or ``repeat_name``.

    ``burst_reports_run`` makes a burst row count the run only.
    """
    runs = consecutive_runs(observed, keys, order).groupBy(*keys).agg(
        F.min("run_start").alias("_min"), F.max("run_end").alias("_max"), F.sum("run_length").alias("_n"),
        F.max(F.struct("run_length", (-F.col("run_start")).alias("_start"), "run_end")).alias("_run"),
    )
    fits = fit_period(observed, keys, order, config, eligible, eligible_keys, eligible_order)
    fits = fits.drop("occurrence_count", "matched_count")
    flat = runs.select(
        *keys, "_min", "_max", "_n", F.col("_run.run_length").alias("run_length"),
        (-F.col("_run._start")).alias("run_start"), F.col("_run.run_end").alias("run_end"),
    )
    rows = match_join(flat, fits, keys, "left")
    periodic = F.col("period").isNotNull()
    burst = ~periodic & (F.col("run_length") >= config.burst_minimum_length)
    rows = rows.where(
        periodic | burst | (F.col("_n") >= config.minimum_repeat_occurrences)
    )
    run_only = burst if burst_reports_run else F.lit(False)
    metric = {name: F.when(periodic, F.col(name)).when(burst, F.lit(1.0)) for name in ("precision", "coverage", "confidence")}
    return rows.select(
        *keys,
        F.when(periodic, "periodic").when(burst, "burst").otherwise(repeat_name).alias("pattern_type"),
        F.when(run_only, F.col("run_length")).otherwise(F.col("_n")).alias("occurrence_count"),
        F.when(run_only, F.col("run_start")).otherwise(F.col("_min")).alias("first_order"),
        F.when(run_only, F.col("run_end")).otherwise(F.col("_max")).alias("last_order"),
        "period",
        F.when(periodic, F.col("phase_start")).when(burst, F.col("run_start")).alias("phase_start"),
        *[column.alias(name) for name, column in metric.items()],
        "run_start", "run_end",
    )


def code_patterns(
    codes: DataFrame, config: AnalysisConfig, selected: Iterable[str] = (), merge: bool = False,
    with_ids: bool = True,
) -> DataFrame:
    """Periodic, burst and recurrent inspection codes per (scope, station, source, code).

    With ``merge`` the selected codes are analysed as one family named "a+b".
    Every coded event of the same scope, station and source makes its order eligible.
    """
    wanted = sorted({str(code) for code in selected if str(code)})
    keys = [*CODE_GROUP, "canonical_code"]
    observed = defect_code_orders(codes, wanted, merge)
    names = (
        observed.where(F.coalesce(F.col("defect_name"), F.lit("")) != "")
        .groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("defect_name")), " / ").alias("defect_name"))
    )
    eligible = codes.select(*CODE_GROUP, "production_order")
    found = classify_sequences(
        observed, keys, "production_order", config, eligible, CODE_GROUP, "recurrent"
    ).where(F.col("occurrence_count") >= config.minimum_repeat_occurrences)
    named = match_join(found, names, keys, "left").select(
        F.lit("code").alias("evidence_source"), *keys,
        F.coalesce("defect_name", F.lit("")).alias("defect_name"), "pattern_type", "occurrence_count",
        F.col("first_order").alias("first_production_order"),
        F.col("last_order").alias("last_production_order"), "period",
        F.col("phase_start").alias("phase_start_production_order"), "precision", "coverage", "confidence",
    )
    if not with_ids:
        return named
    numbered = number_rows(named, keys, "_number")
    return numbered.select(F.format_string("CP%04d", F.col("_number")).alias("pattern_id"), *named.columns)


def defect_code_orders(codes: DataFrame, selected: Sequence[str] = (), merge: bool = False) -> DataFrame:
    """Orders at which a defective code was seen, one row per code event."""
    rows = codes.where(is_defect_status(F.col("code_status")))
    if selected:
        rows = rows.where(F.col("canonical_code").isin(list(selected)))
        if merge:
            rows = rows.withColumn("member_code", F.col("canonical_code")).withColumn(
                "canonical_code", F.lit("+".join(selected))
            )
    if "member_code" not in rows.columns:
        rows = rows.withColumn("member_code", F.col("canonical_code"))
    return rows.where(F.col("production_order").isNotNull())


def code_pattern_missing(codes: DataFrame, patterns: DataFrame, selected: Sequence[str] = (), merge: bool = False) -> DataFrame:
    """Missing production orders of the periodic code patterns, one row per slot."""
    keys = [*CODE_GROUP, "canonical_code"]
    fits = patterns.where(F.col("pattern_type") == "periodic").withColumn(
        "phase_start", F.col("phase_start_production_order")
    )
    return missing_slots(
        fits, defect_code_orders(codes, selected, merge), keys, "production_order",
        codes.select(*CODE_GROUP, "production_order"), CODE_GROUP,
    )


def pattern_image_links(
    codes: DataFrame, patterns: DataFrame, links: DataFrame, selected: Sequence[str] = (), merge: bool = False
) -> DataFrame:
    """Product images behind each code pattern: keys, role (observed / missing), global_order."""
    keys = [*CODE_GROUP, "canonical_code"]
    orders = match_join(
        defect_code_orders(codes, selected, merge).select(*keys, "member_code", "production_order").distinct(),
        patterns.select(*keys), keys, "left_semi",
    )
    link = links.where(F.col("global_order").isNotNull()).select(
        *CODE_GROUP, F.col("canonical_code").alias("member_code"), "production_order", "global_order"
    ).distinct()
    observed = match_join(orders, link, [*CODE_GROUP, "member_code", "production_order"]).select(
        *keys, F.lit("observed").alias("role"), "global_order"
    )
    missing = match_join(
        code_pattern_missing(codes, patterns, selected, merge).withColumnRenamed("missing_order", "production_order"),
        link.drop("member_code"), [*CODE_GROUP, "production_order"],
    ).select(*keys, F.lit("missing").alias("role"), "global_order")
    return observed.unionByName(missing).distinct()


def slot_schedule(
    patterns: DataFrame, keys: Sequence[str], products: DataFrame, product_keys: Sequence[str], order: str,
    lead: int,
) -> DataFrame:
    """Expected slots of fitted periods that fall on an existing product, with their warning order."""
    slots = products.select(*product_keys, F.col(order).cast("bigint").alias("slot_order")).distinct()
    fits = patterns.select(*keys, "period", "phase_start")
    return _on_line(fits, "phase_start", slots, "slot_order", product_keys).where(
        F.col("slot_order") >= F.col("phase_start")
    ).withColumn("warn_at_order", F.col("slot_order") - lead).select(
        *keys, "period", "phase_start", "slot_order", "warn_at_order"
    )


def evidence_strip(
    observed: DataFrame, missing: DataFrame, products: DataFrame, keys: Sequence[str], order: str = "global_order"
) -> DataFrame:
    """Observed and missing orders of each pattern with a review status per order."""
    orders = (
        observed.select(*keys, order, F.lit(0).alias("_missing"))
        .unionByName(missing.select(*keys, order, F.lit(1).alias("_missing")))
        .groupBy(*keys, order).agg(F.max("_missing").alias("_missing"))
    )
    extra = [name for name in ("evidence_status", "production_order") if name in products.columns]
    info = products.select(order, *extra)
    joined = match_join(orders, info, [order], "left")
    status = F.when(F.col("_missing") == 1, "missing").otherwise("observed")
    if "evidence_status" in extra:
        status = F.when(F.col("evidence_status").isin("unavailable", "ambiguous_event"), "unavailable").otherwise(status)
    rest = [name for name in extra if name != "evidence_status"]
    return joined.select(*keys, order, status.alias("status"), *rest)


__all__ = [
    "BLOCK", "CODE_GROUP", "classify_sequences", "code_pattern_missing", "code_patterns",
    "defect_code_orders", "evidence_strip", "fit_period", "longest_run", "missing_slots",
    "pattern_image_links", "period_candidates", "production_order", "slot_schedule",
]
