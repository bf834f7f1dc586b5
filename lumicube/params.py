"""Operator parameters: frozen dataclasses with range and value-set checks at plan time."""

from __future__ import annotations

from dataclasses import dataclass


def _within(name: str, value: float, lo: float, hi: float) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must lie in [{lo}, {hi}], not be {value}")


def _one_of(name: str, value: str, options: tuple[str, ...]) -> None:
    if value not in options:
        raise ValueError(f"{name} must be one of {', '.join(options)}, not {value}")


@dataclass(frozen=True)
class DropoutParams:
    neighbour_bands: int = 5
    neighbourhood: str = "N4"

    def __post_init__(self) -> None:
        _within("neighbour_bands", self.neighbour_bands, 1, 62)
        _one_of("neighbourhood", self.neighbourhood, ("N4", "N8"))


@dataclass(frozen=True)
class DestripingParams:
    smoothing_order: int = 27
    slit_correction: bool = True
    strict_mask: bool = False  # test the mask at x - 1 as well

    def __post_init__(self) -> None:
        _within("smoothing_order", self.smoothing_order, 11, 99)


@dataclass(frozen=True)
class ClusterParams:
    clusters: int = 14
    iterations: int = 30
    seed: int = 31415

    def __post_init__(self) -> None:
        _within("clusters", self.clusters, 2, 99)
        _within("iterations", self.iterations, 1, 999)


@dataclass(frozen=True)
class AtmosphereParams:
    aot550: float = 0.0
    initial_water_vapour: float = 1.0
    cloud_threshold: float = 0.05
    adjacency: bool = False
    polishing: bool = False
    water_vapour_map: bool = False

    def __post_init__(self) -> None:
        _within("aot550", self.aot550, 0.0, 1.0)
        _within("initial_water_vapour", self.initial_water_vapour, 0.0, 5.0)


@dataclass(frozen=True)
class GeometryParams:
    use_target_altitude: bool = True
    include_pitch_and_roll: bool = False
