"""Per-station alert state: what has been seen, which periods are active.

The state grows with clusters, never with products: period evidence is kept as
counters per (period, residue), runs as start and length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from linewise.config import AnalysisConfig

ALERT_COLUMNS = [
    "alert_at_order", "alert_type", "cluster_no", "confidence", "predicted_order",
    "evidence_kind", "evidence_from", "evidence_to", "period", "phase",
]


def new_station(config: AnalysisConfig) -> dict:
    periods = np.arange(config.minimum_period, config.maximum_period + 1, dtype=np.int64)
    return {"last": None, "eligible": np.zeros(int(periods.sum()), dtype=np.int64), "clusters": {}, "active": []}


def _new_cluster() -> dict:
    empty = np.zeros(0, dtype=np.int64)
    return {
        "n": 0, "first": None, "last": None, "run_start": 0, "run": 0, "best_start": 0, "best": 0, "burst": False,
        "fixed": False, "active": None, "slot": empty,
        "table": np.zeros((5, 0), dtype=np.int64),  # matched, own, first, eligible before first, eligible at last
    }


class StationReplay:
    """Replays one (scope, station) order by order and returns the alerts of each order."""

    def __init__(self, config: AnalysisConfig, state: dict | None = None,
                 is_product: Callable[[int], bool | None] = lambda order: None) -> None:
        self.config = config
        self.state = state or new_station(config)
        self.is_product = is_product  # True / False / None when the future is unknown
        self.periods = np.arange(config.minimum_period, config.maximum_period + 1, dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.periods)[:-1]])
        self.slot_period = np.repeat(self.periods, self.periods)
        self.slot_residue = np.arange(len(self.slot_period)) - np.repeat(self.offsets, self.periods)
        self.pending: list[int] = []  # products not yet in the eligible counters
        self._set_wake()

    def step(self, order: int, seen: Iterable[int]) -> list[tuple]:
        """Process product ``order`` with the clusters found on it."""
        state, seen = self.state, sorted(set(seen))
        before, state["last"] = state["last"], order
        self.pending.append(order)
        if len(self.pending) >= 4096:
            self.flush()
        if not seen and order < self.wake:
            return []  # nothing observed and no expected slot is near
        if seen:
            self.flush()
        for number in seen:
            self._observe(state["clusters"].setdefault(number, _new_cluster()), order)
        alerts: list[tuple] = []
        for number in list(state["active"]):
            alerts += self._check_active(number, state["clusters"][number], order, before, number in seen)
        for number in seen:
            alerts += self._check_cluster(number, state["clusters"][number], order)
        self._set_wake()
        return alerts

    def flush(self) -> None:
        """Count the pending products per (period, residue)."""
        if self.pending:
            orders = np.asarray(self.pending, dtype=np.int64)[:, None]
            slots = (self.offsets + orders % self.periods).ravel()
            self.state["eligible"] += np.bincount(slots, minlength=len(self.state["eligible"]))
            self.pending.clear()

    def _set_wake(self) -> None:
        """First order at which an active period can need attention."""
        lead = self.config.warning_lead_products
        active = [self.state["clusters"][number]["active"]["next"] - lead for number in self.state["active"]]
        self.wake = min(active) if active else float("inf")

    # ------------------------------------------------------------------ evidence

    def _observe(self, cluster: dict, order: int) -> None:
        consecutive = cluster["last"] is not None and order == cluster["last"] + 1
        cluster["run"] = cluster["run"] + 1 if consecutive else 1
        if not consecutive:
            cluster["run_start"] = order
        if cluster["run"] > cluster["best"]:
            cluster["best"], cluster["best_start"] = cluster["run"], cluster["run_start"]
        cluster["n"] += 1
        cluster["last"] = order
        cluster["first"] = order if cluster["first"] is None else cluster["first"]
        tolerance = self.config.period_order_tolerance
        near = np.unique(np.concatenate([self.offsets + (order + k) % self.periods for k in range(-tolerance, tolerance + 1)]))
        fresh = np.setdiff1d(near, cluster["slot"], assume_unique=True)
        if len(fresh):
            at = np.searchsorted(cluster["slot"], fresh)
            cluster["slot"] = np.insert(cluster["slot"], at, fresh)
            cluster["table"] = np.insert(cluster["table"], at, 0, axis=1)
        table, where = cluster["table"], np.searchsorted(cluster["slot"], near)
        new = where[table[0, where] == 0]
        table[0, where] += 1
        table[1, np.searchsorted(cluster["slot"], self.offsets + order % self.periods)] = 1
        eligible = self.state["eligible"]
        table[2, new] = order
        line = self._line(cluster["slot"][where], table[2, where])
        table[3, new] = eligible[self._line(cluster["slot"][new], table[2, new])] - 1
        table[4, where] = eligible[line]

    def _line(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Counter of the orders that are whole periods away from the first match."""
        period = self.slot_period[slots]
        return slots - self.slot_residue[slots] + first % period

    def _fit(self, cluster: dict) -> dict | None:
        config = self.config
        if cluster["n"] < config.minimum_repeat_occurrences:
            return None
        matched, own, first, low, high = cluster["table"]
        good = (own == 1) & (matched >= config.minimum_repeat_occurrences) & (
            matched / cluster["n"] >= config.minimum_period_precision
        ) & (high > low)
        at = np.flatnonzero(good)
        if not len(at):
            return None
        precision = matched[at] / cluster["n"]
        coverage = np.minimum(1.0, matched[at] / (high[at] - low[at]))
        kept = coverage >= config.minimum_period_coverage
        if not kept.any():
            return None
        at, precision, coverage = at[kept], precision[kept], coverage[kept]
        confidence = 2 * precision * coverage / (precision + coverage)
        slots = cluster["slot"][at]
        period, residue = self.slot_period[slots], self.slot_residue[slots]
        best = np.lexsort((-residue, -period, precision, coverage, confidence))[-1]
        return {
            "period": int(period[best]), "phase": int(first[at[best]]), "precision": float(precision[best]),
            "coverage": float(coverage[best]), "confidence": float(confidence[best]),
        }

    # -------------------------------------------------------------------- alerts

    def _known(self, slot: int, order: int, before: int | None, active: dict) -> bool | None:
        if slot == order or slot == before or slot == active.get("checked"):
            return True
        return False if slot < order else self.is_product(slot)

    def _check_active(self, number: int, cluster: dict, order: int, before: int | None, observed: bool) -> list[tuple]:
        active, period = cluster["active"], cluster["active"]["period"]
        while (known := self._known(active["next"], order, before, active)) is False:
            active["next"] += period
        if known:
            active["checked"] = active["next"]
        alerts = []
        if order == active["next"] and observed:
            active["next"] += period
        elif order > active["next"] + self.config.missing_order_tolerance:
            alerts.append(self._alert(order, "expected_occurrence_missing", number, active["confidence"], active["next"], "all", cluster["first"], cluster["last"]))
            while active["next"] < order:
                active["next"] += period
            if active["next"] == order and observed:
                active["next"] += period
        if order == active["next"] - self.config.warning_lead_products:
            alerts.append(self._alert(order, "upcoming_periodic_defect", number, active["confidence"], active["next"], "all", cluster["first"], cluster["last"]))
        return alerts

    def _check_cluster(self, number: int, cluster: dict, order: int) -> list[tuple]:
        config, alerts = self.config, []
        if cluster["best"] >= config.burst_minimum_length and not cluster["burst"]:
            cluster["burst"] = True
            alerts.append(self._alert(order, "burst_detected", number, 1.0, None, "run", cluster["best_start"], cluster["best_start"] + cluster["best"] - 1))
        fit = self._fit(cluster)
        if fit and cluster["active"] is None:
            following = fit["phase"] + ((order - fit["phase"]) // fit["period"] + 1) * fit["period"]
            cluster["active"] = {**fit, "next": following, "confirmed": order}
            self.state["active"].append(number)
            alerts.append(self._alert(order, "periodic_pattern_confirmed", number, fit["confidence"], following, "matched", fit["phase"], order, fit["period"], fit["phase"]))
        elif fit:
            cluster["active"].update({name: fit[name] for name in ("precision", "coverage", "confidence")})
        elif cluster["n"] >= config.minimum_repeat_occurrences and cluster["best"] < config.burst_minimum_length and not cluster["fixed"]:
            cluster["fixed"] = True
            alerts.append(self._alert(order, "fixed_position_repeat_confirmed", number, 0.5, None, "all", cluster["first"], cluster["last"]))
        return alerts

    @staticmethod
    def _alert(order, kind, number, confidence, predicted, evidence, start, end, period=None, phase=None) -> tuple:
        return (order, kind, number, confidence, predicted, evidence, start, end, period, phase)
