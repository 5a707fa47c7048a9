"""Settings of the analysis, validated when they are made."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields
from typing import Any


def _positive(name: str, value: float, whole: bool = False) -> None:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value > 0
    if not ok or whole and value != int(value):
        raise ValueError(f"{name} must be a positive {'integer' if whole else 'number'}, not {value!r}")


def _share(name: str, value: float) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not 0 <= value <= 1:
        raise ValueError(f"{name} must lie in [0, 1], not {value!r}")


@dataclass(frozen=True)
class Area:
    west: float = 81.5
    south: float = 23.2
    east: float = 83.5
    north: float = 25.2

    def __post_init__(self) -> None:
        if not (-180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90):
            raise ValueError("the area must be west < east and south < north within the globe")


@dataclass(frozen=True)
class Models:
    event_spatial_km: float = 2.0
    event_temporal_hours: float = 24.0
    event_min_samples: int = 2
    site_min_events: int = 3
    site_max_diameter_km: float = 1.5
    min_history_events: int = 6
    isolation_min_training_events: int = 32
    isolation_trees: int = 100
    isolation_refit_days: int = 30
    isolation_max_training_events: int = 20_000
    min_calibration_events: int = 32
    history_window_days: int = 2557
    seasonal_window_days: int = 45
    seasonal_min_events: int = 12
    tuning_repeats: int = 3
    anomaly_percentile: float = 0.95
    random_state: int = 26162

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name not in ("anomaly_percentile", "random_state", "seasonal_window_days"):
                _positive(f.name, getattr(self, f.name), whole=f.type == "int")
        _share("anomaly_percentile", self.anomaly_percentile)


@dataclass(frozen=True)
class Peers:
    enabled: bool = True
    min_events: int = 32
    min_days: int = 8
    min_cells: int = 3
    radius_km: float = 100.0
    exclude_radius_km: float = 2.0
    season_window_days: int = 45
    history_window_days: int = 2557
    gap_days: int = 7
    cell_km: float = 5.0
    max_events: int = 2000

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name != "enabled":
                _positive(f"peers.{f.name}", getattr(self, f.name), whole=f.type == "int")
        if self.max_events < self.min_events or self.exclude_radius_km >= self.radius_km or self.season_window_days > 183:
            raise ValueError("peer limits contradict each other")


@dataclass(frozen=True)
class Context:
    worldcover_radius_m: float = 500.0
    industrial_near_km: float = 2.0
    industrial_context_km: float = 5.0
    vegetation_fraction: float = 0.6
    min_coverage: float = 0.8

    def __post_init__(self) -> None:
        _positive("worldcover_radius_m", self.worldcover_radius_m)
        _share("vegetation_fraction", self.vegetation_fraction)
        if self.industrial_near_km > self.industrial_context_km:
            raise ValueError("industrial_near_km must not exceed industrial_context_km")


@dataclass(frozen=True)
class Evidence:
    max_events: int | None = 180
    candidate_policy: str = "priority"
    days_before: float = 45
    days_after: float = 30
    recent_days: float = 90
    vegetation_reserved_fraction: float = 0.2
    recent_reserved_fraction: float = 0.2
    max_scene_cloud: float = 70
    max_scenes_per_side: int = 12
    max_pair_attempts: int = 4
    min_local_valid_fraction: float = 0.4
    dnbr_threshold: float = 0.1
    min_affected_fraction: float = 0.1
    swir_relative_threshold: float = 0.2
    normalized_swir_threshold: float = 0.02
    collections: tuple[str, ...] = ("sentinel-2-c1-l2a", "sentinel-2-l2a", "sentinel-2-pre-c1-l2a")


@dataclass(frozen=True)
class Settings:
    area: Area = field(default_factory=Area)
    models: Models = field(default_factory=Models)
    peers: Peers = field(default_factory=Peers)
    context: Context = field(default_factory=Context)
    evidence: Evidence = field(default_factory=Evidence)
    expected_years: tuple[int, ...] = (2019, 2020, 2021, 2022, 2023, 2024, 2025)
    accepted_sensors: tuple[str, ...] = ("VIIRS_SNPP", "VIIRS_NOAA20")

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> Settings:
        """Settings from a configuration document; keys that aren't known are ignored."""

        def part(kind: type, values: dict[str, Any]) -> Any:
            known = {f.name for f in fields(kind)}
            return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})

        inputs = raw.get("inputs", {})
        box = raw.get("aoi", {}).get("bbox")
        return cls(
            Area(*map(float, box)) if box else Area(),
            part(Models, raw.get("models", {})),
            part(Peers, raw.get("vegetation_peers", {})),
            part(Context, raw.get("context", {})),
            part(Evidence, raw.get("sentinel", {})),
            tuple(inputs.get("expected_years", cls.expected_years)),
            tuple(inputs.get("accepted_sensors", cls.accepted_sensors)),
        )

    @classmethod
    def read(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))
