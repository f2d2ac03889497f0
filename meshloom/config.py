"""Run settings as frozen dataclasses.

The defaults are fixed values that results depend on (material constants,
thresholds, ranges, ratios); they are parameters, not logic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FAMILIES = (
    "block_with_holes",
    "l_bracket",
    "elongated_bar",
    "plate_3d",
    "block_with_fillet",
)
BUCKETS = ("small", "medium", "large")
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Material:
    youngs_modulus: float = 210.0e9
    poisson_ratio: float = 0.3
    sigma_yield: float = 420.0e6

    @property
    def lame_lambda(self) -> float:
        e, nu = self.youngs_modulus, self.poisson_ratio
        return e * nu / ((1 + nu) * (1 - 2 * nu))

    @property
    def lame_mu(self) -> float:
        return self.youngs_modulus / (2 * (1 + self.poisson_ratio))


@dataclass(frozen=True)
class Scale:
    length_range: tuple[float, float] = (0.02, 2.0)
    mesh_size_fraction: float = 0.05
    buckets: tuple[str, ...] = BUCKETS
    edges: tuple[float, ...] = (0.02, 0.15, 0.6, 2.0)

    def __post_init__(self) -> None:
        if len(self.edges) != len(self.buckets) + 1:
            raise ValueError(
                f"{len(self.buckets)} buckets need {len(self.buckets) + 1} edges, "
                f"got {len(self.edges)}"
            )


@dataclass(frozen=True)
class LoadScaling:
    percentile: float = 0.95
    safety_factors: tuple[float, ...] = (1.2, 1.5, 2.0, 3.0, 5.0)
    peak_stress_cap: float = 432.0e6
    min_reference_p95: float = 1.0


@dataclass(frozen=True)
class LinearityGate:
    bulk_families: tuple[str, ...] = ("block_with_holes", "block_with_fillet", "l_bracket")
    bending_families: tuple[str, ...] = ("elongated_bar", "plate_3d")
    bulk_threshold: float = 0.05
    bending_length_threshold: float = 0.05
    bending_thickness_threshold: float = 0.5


@dataclass(frozen=True)
class Sampling:
    family_weights: tuple[float, ...] = (0.2, 0.2, 0.2, 0.2, 0.2)
    min_per_stratum: int = 250
    total_target: int = 5000
    seed: int = 42


@dataclass(frozen=True)
class Splitting:
    ratios: tuple[float, float, float] = (0.80, 0.10, 0.10)
    large_holdout: float = 0.5
    radius_ratio_holdout: tuple[float, float] = (0.10, 0.20)
    seed: int = 42


@dataclass(frozen=True)
class Checks:
    coherence_tolerance: float = 0.05
    linearity_sample_rate: float = 0.01
    linearity_tolerance: float = 0.01
    max_family_failure_rate: float = 0.05
    min_multihot_samples: int = 50
    receptive_field_hops: int = 15


@dataclass(frozen=True)
class HoleBlockRanges:
    base_dims: tuple[float, float] = (0.8, 1.2)
    hole_count: tuple[int, int] = (1, 4)
    hole_radius_fraction: tuple[float, float] = (0.05, 0.20)


@dataclass(frozen=True)
class LBracketRanges:
    block_aspect: tuple[float, float] = (0.6, 1.5)
    notch_depth_fraction: tuple[float, float] = (0.25, 0.50)
    notch_width_fraction: tuple[float, float] = (0.25, 0.50)
    radius_ratio: tuple[float, float] = (0.02, 0.30)


@dataclass(frozen=True)
class BarRanges:
    aspect_ratio: tuple[float, float] = (8.0, 15.0)
    cross_section_aspect: tuple[float, float] = (0.5, 2.0)
    hole_probability: float = 0.4
    hole_count: tuple[int, int] = (1, 3)
    hole_position: tuple[float, float] = (0.15, 0.85)
    hole_radius: tuple[float, float] = (0.08, 0.25)


@dataclass(frozen=True)
class PlateRanges:
    thickness_fraction: tuple[float, float] = (0.02, 0.10)
    width_length_ratio: tuple[float, float] = (0.3, 1.0)
    hole_probability: float = 0.3
    hole_count: tuple[int, int] = (1, 3)
    hole_position: tuple[float, float] = (0.15, 0.85)
    hole_radius: tuple[float, float] = (0.03, 0.12)


@dataclass(frozen=True)
class FilletBlockRanges:
    block_aspect: tuple[float, float] = (0.5, 1.5)
    fillet_radius_fraction: tuple[float, float] = (0.05, 0.25)
    num_fillets: tuple[int, int] = (1, 4)
    edge_count: int = 12


@dataclass(frozen=True)
class Settings:
    material: Material = field(default_factory=Material)
    scale: Scale = field(default_factory=Scale)
    loads: LoadScaling = field(default_factory=LoadScaling)
    gate: LinearityGate = field(default_factory=LinearityGate)
    sampling: Sampling = field(default_factory=Sampling)
    splitting: Splitting = field(default_factory=Splitting)
    checks: Checks = field(default_factory=Checks)
    hole_block: HoleBlockRanges = field(default_factory=HoleBlockRanges)
    l_bracket: LBracketRanges = field(default_factory=LBracketRanges)
    bar: BarRanges = field(default_factory=BarRanges)
    plate: PlateRanges = field(default_factory=PlateRanges)
    fillet_block: FilletBlockRanges = field(default_factory=FilletBlockRanges)


DEFAULTS = Settings()
