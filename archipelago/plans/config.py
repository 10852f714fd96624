"""Build settings: dataclasses, derived sizes, validation and profiles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from math import isfinite, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


class BuildProfile(Enum):
    CONSERVATIVE = "conservative"
    SPARSE = "sparse"
    UNPRUNED = "unpruned"


class BuildStatus(Enum):
    SUCCESS = "success"
    CANCELLED = "cancelled"
    INVALID_CONFIGURATION = "invalid_configuration"
    INVALID_MESH = "invalid_mesh"
    QUERY_INITIALIZATION_FAILED = "query_initialization_failed"
    QUERY_FAILED = "query_failed"


def _auto(explicit: float, extent: float, ratio: float) -> float:
    return explicit if explicit > 0 else extent * ratio


@dataclass(frozen=True)
class Gap:
    horizontal: float
    up: float
    down: float


@dataclass(frozen=True)
class MassAware:
    enabled: bool = False
    suppress_small: bool = False
    percentile: float = 0.99
    suppressed_percent: float = 0.0
    target_preference: float = 0.0
    target_preference_ratio: float = 0.0
    low_radius_scale: float = 1.0
    high_radius_scale: float = 1.0

    def preference(self, horizontal: float) -> float:
        return _auto(self.target_preference, horizontal, self.target_preference_ratio)


@dataclass(frozen=True)
class Cells:
    """A switch with a cell size (0: extent times ratio)."""

    enabled: bool
    size: float = 0.0
    ratio: float = 0.25

    def cell(self, extent: float) -> float:
        return _auto(self.size, extent, self.ratio)


@dataclass(frozen=True)
class GlobalPrune:
    enabled: bool = False
    size: float = 0.0
    ratio: float = 0.5
    low_radius_scale: float = 1.0
    high_radius_scale: float = 1.0

    def cell(self, extent: float) -> float:
        return _auto(self.size, extent, self.ratio)


@dataclass(frozen=True)
class Spanner:
    enabled: bool = False
    path_ratio: float = 1.5


@dataclass(frozen=True)
class Reserve:
    enabled: bool = False
    least: int = 0
    most: int = 0
    mass_power: float = 1.0

    def budget(self, mass: float, mass_aware: bool) -> int:
        """How many distinct targets an island keeps against pruning."""
        if not self.enabled or not self.most:
            return 0
        if not mass_aware:
            return self.most
        if self.least >= self.most:
            return self.most
        weighted = min(1.0, max(0.0, mass)) ** self.mass_power
        return min(self.most, int(self.least + (self.most - self.least) * weighted))

    def budget_of(self, mass: Column, mass_aware: bool) -> Column:
        """The same of a column of masses."""
        if not mass_aware or not self.enabled or self.least >= self.most:
            return F.lit(self.budget(0.0, mass_aware))
        weighted = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass)), F.lit(self.mass_power))
        return F.least(F.lit(self.most), (self.least + (self.most - self.least) * weighted).cast("int"))


@dataclass(frozen=True)
class Density:
    vertical_ratio: float = 0.25
    pair_scan: Cells = Cells(False)
    recovery: Cells = Cells(False, 0.0, 0.2)
    candidates: Cells = Cells(True)
    local: Cells = Cells(True)
    overall: GlobalPrune = GlobalPrune()
    spanner: Spanner = Spanner()
    reserve: Reserve = Reserve()


@dataclass(frozen=True)
class Boundaries:
    dedup: Cells = Cells(True, 0.0, 0.125)
    representatives: Cells = Cells(False)
    direction_buckets: int = 8
    least: int = 0
    most: int = 0
    mass_power: float = 1.0
    budget_scale: float = 0.0
    ranker: Callable | None = None

    @property
    def budgeted(self) -> bool:
        return self.most > 0 or self.budget_scale > 0

    def budget(self, mass: float, mass_aware: bool, available: int) -> int:
        """Representatives kept on an island; 0 keeps none when budgeted."""
        if not self.budgeted:
            return 0
        if not mass_aware:
            return self.most
        weighted = min(1.0, max(0.0, mass)) ** self.mass_power
        if self.budget_scale > 0:
            whole = self.least + self.budget_scale * sqrt(available) * weighted
        elif self.least < self.most:
            whole = self.least + (self.most - self.least) * weighted
        else:
            whole = self.most
        return min(int(whole), self.most) if self.most else int(whole)


@dataclass(frozen=True)
class Query:
    max_nodes: int = 8192
    include_flags: int = 0xFFFF
    exclude_flags: int = 0


@dataclass(frozen=True)
class BuildConfig:
    """``polygon_filter`` takes nothing and returns a Column over ``polygons``;
    ``outbound`` and ``link_ranker`` likewise over islands and links."""

    gap: Gap
    boundaries: Boundaries = field(default_factory=Boundaries)
    query: Query = Query()
    mass: MassAware = MassAware()
    density: Density = field(default_factory=Density)
    polygon_filter: Callable | None = None
    outbound: Callable | None = None
    link_ranker: Callable | None = None

    @classmethod
    def of(cls, horizontal: float, up: float, down: float, profile: BuildProfile = BuildProfile.CONSERVATIVE) -> BuildConfig:
        config = cls(Gap(horizontal, up, down))
        d, b = config.density, config.boundaries
        on = lambda c: replace(c, enabled=True)
        off = lambda c: replace(c, enabled=False)
        if profile is BuildProfile.SPARSE:
            d = replace(d, pair_scan=on(d.pair_scan), recovery=on(d.recovery), spanner=on(d.spanner))
            return replace(config, density=d, boundaries=replace(b, representatives=on(b.representatives)))
        if profile is BuildProfile.UNPRUNED:
            d = replace(
                d, pair_scan=off(d.pair_scan), recovery=off(d.recovery), candidates=off(d.candidates),
                local=off(d.local), overall=off(d.overall), spanner=off(d.spanner),
            )
            return replace(config, density=d, boundaries=replace(b, dedup=off(b.dedup), representatives=off(b.representatives)))
        return config

    @property
    def extent(self) -> float:
        return max(self.gap.horizontal, self.gap.up, self.gap.down)

    @property
    def symmetric(self) -> bool:
        return abs(self.gap.up - self.gap.down) <= 1e-3

    @property
    def spherical(self) -> bool:
        return self.symmetric and abs(self.gap.horizontal - self.gap.up) <= 1e-3

    @property
    def vertical_window(self) -> float:
        rise = max(self.gap.up, self.gap.down)
        base = min(self.gap.horizontal, rise) if rise > 0 else self.gap.horizontal
        return max(self.density.vertical_ratio * base, 0.5)

    @property
    def recovery_gap(self) -> float:
        return min(self.density.recovery.cell(self.gap.horizontal), self.gap.horizontal)

    def problem(self) -> str | None:
        """The first thing wrong with the settings, or None."""

        def positive(x: float) -> bool:
            return isfinite(x) and x > 0

        def natural(x: float) -> bool:
            return isfinite(x) and x >= 0

        def sizes(c) -> bool:
            return not c.enabled or (natural(c.size) and positive(c.ratio))

        g, b, m, d = self.gap, self.boundaries, self.mass, self.density
        checks = [
            ("gap.horizontal must be positive", positive(g.horizontal)),
            ("gap.up must not be negative", natural(g.up)),
            ("gap.down must not be negative", natural(g.down)),
            ("boundaries.dedup needs a cell size", sizes(b.dedup)),
            ("boundaries.representatives needs sizes, buckets and powers", sizes(b.representatives) and (not b.representatives.enabled or (b.direction_buckets > 0 and positive(b.mass_power) and natural(b.budget_scale)))),
            ("query.max_nodes must be 1 to 65535", 0 < self.query.max_nodes <= 65535),
            ("mass.percentile must be in (0, 1]", positive(m.percentile) and m.percentile <= 1),
            ("mass.suppressed_percent must be in [0, 1)", natural(m.suppressed_percent) and m.suppressed_percent < 1),
            ("mass.target_preference must not be negative", natural(m.target_preference)),
            ("mass.target_preference_ratio must not be negative", natural(m.target_preference_ratio)),
            ("mass.low_radius_scale must be positive", positive(m.low_radius_scale)),
            ("mass.high_radius_scale must be positive", positive(m.high_radius_scale)),
            ("density.vertical_ratio must be in (0, 1]", positive(d.vertical_ratio) and d.vertical_ratio <= 1),
            ("density.pair_scan needs a cell size", sizes(d.pair_scan)),
            ("density.recovery needs a gap and a ratio in (0, 1]", sizes(d.recovery) and (not d.recovery.enabled or d.recovery.ratio <= 1)),
            ("density.candidates needs a cell size", sizes(d.candidates)),
            ("density.local needs a radius", sizes(d.local)),
            ("density.overall needs a radius and mass scales", sizes(d.overall) and (not d.overall.enabled or (positive(d.overall.low_radius_scale) and positive(d.overall.high_radius_scale)))),
            ("density.spanner.path_ratio must be at least 1", not d.spanner.enabled or (isfinite(d.spanner.path_ratio) and d.spanner.path_ratio >= 1)),
            ("density.reserve needs least <= most and a power", not d.reserve.enabled or (d.reserve.least <= d.reserve.most and positive(d.reserve.mass_power))),
        ]
        return next((text for text, holds in checks if not holds), None)
