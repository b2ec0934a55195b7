"""Analysis settings: frozen values with the legal ranges and cross-field rules."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from linewise.fixed_values import FLOAT_RANGES, IMAGE_PROFILES, INTEGER_RANGES

PROFILE_NAMES = tuple(profile[0] for profile in IMAGE_PROFILES)
REQUIRED_KEYS = (
    "spatial_cluster_radius_norm", "minimum_repeat_occurrences", "minimum_period",
    "maximum_period", "minimum_period_precision", "minimum_period_coverage",
    "burst_minimum_length", "warning_lead_products", "output_directory",
)


@dataclass(frozen=True)
class DetectionProfile:
    red_min: int = 150
    red_dominance: int = 40
    morph_kernel_size: int = 3
    min_component_area: int = 1
    max_component_area: int = 5000
    micro_max_component_area: int = 7
    region_min_width_ratio: float = 0.4
    region_min_height_ratio: float = 0.4


def _default_profiles() -> dict[str, DetectionProfile]:
    return {name: DetectionProfile() for name in PROFILE_NAMES}


@dataclass(frozen=True)
class AnalysisConfig:
    spatial_cluster_radius_norm: float = 0.03
    minimum_repeat_occurrences: int = 4
    minimum_period: int = 2
    maximum_period: int = 200
    period_order_tolerance: int = 0
    minimum_period_precision: float = 0.75
    minimum_period_coverage: float = 0.65
    burst_minimum_length: int = 4
    missing_order_tolerance: int = 0
    warning_lead_products: int = 3
    registration_min_score: float = 0.80
    horizontal_y_tolerance_norm: float = 0.02
    horizontal_min_x_span_norm: float = 0.05
    trajectory_min_occurrences: int = 4
    linear_drift_min_abs_spearman: float = 0.80
    evaluation_center_tolerance_px: float = 10.0
    output_directory: str = "analysis_results"
    preview_count: int = 8
    detection_profiles: dict[str, DetectionProfile] = field(default_factory=_default_profiles)

    def __post_init__(self) -> None:
        problems = _range_problems(self)
        for name, profile in self.detection_profiles.items():
            problems += [f"{name}: {text}" for text in _range_problems(profile)]
            if profile.min_component_area > profile.max_component_area:
                problems.append(f"{name}: min_component_area exceeds max_component_area")
            if profile.micro_max_component_area < profile.min_component_area:
                problems.append(f"{name}: micro_max_component_area below min_component_area")
            if profile.morph_kernel_size % 2 == 0:
                problems.append(f"{name}: morph_kernel_size must be odd")
        if self.minimum_period > self.maximum_period:
            problems.append("minimum_period exceeds maximum_period")
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any], require_all: bool = True) -> AnalysisConfig:
        """Build from a settings mapping; flat detection keys apply to every profile."""
        if require_all:
            missing = sorted(set(REQUIRED_KEYS) - set(values))
            if missing:
                raise ValueError(f"settings lack {missing}")
        detection_keys = {item.name for item in fields(DetectionProfile)}
        flat = {key: values[key] for key in detection_keys if key in values}
        given = values.get("detection_profiles") or {}
        profiles = {
            name: DetectionProfile(**{**flat, **dict(given.get(name) or {})})
            for name in PROFILE_NAMES
        }
        known = {item.name for item in fields(cls)} - {"detection_profiles"}
        return cls(
            **{key: value for key, value in values.items() if key in known},
            detection_profiles=profiles,
        )

    def profile(self, camera: str) -> DetectionProfile:
        name = str(camera).upper()
        if name not in self.detection_profiles:
            raise ValueError(f"no detection profile for {camera!r}")
        return self.detection_profiles[name]

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    def profile_frame(self, spark: SparkSession) -> DataFrame:
        """Detection thresholds as a four-row dimension keyed by camera."""
        rows = [(name, *asdict(profile).values()) for name, profile in self.detection_profiles.items()]
        names = ["camera", *(item.name for item in fields(DetectionProfile))]
        types = ["string"] + ["int"] * 6 + ["double"] * 2
        schema = ", ".join(f"{name} {kind}" for name, kind in zip(names, types))
        return spark.createDataFrame(rows, schema)

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The resolved settings as (setting, value) rows, to be stored next to results."""
        flat = {key: value for key, value in asdict(self).items() if key != "detection_profiles"}
        for name, profile in self.detection_profiles.items():
            flat |= {f"{name}.{key}": value for key, value in asdict(profile).items()}
        return spark.createDataFrame(
            [(key, str(value)) for key, value in flat.items()], "setting string, value string"
        )


def _range_problems(settings: Any) -> list[str]:
    problems = []
    for item in fields(settings):
        low, high = {**INTEGER_RANGES, **FLOAT_RANGES}.get(item.name, (None, None))
        value = getattr(settings, item.name)
        if low is not None and not low <= value <= high:
            problems.append(f"{item.name}={value} outside {low}..{high}")
    return problems
