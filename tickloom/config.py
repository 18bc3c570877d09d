"""Study parameters in one place. Defaults are the full study's; HOURLY fits the one-month event tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Detect:
    """Windows in bars, and thresholds, of the four detectors."""

    cum_window: int = 24
    sigma_window: int = 8640
    high_window: int = 24
    margin: float = 0.5
    volume_window: int = 96
    edge: float = 0.20
    multiple: float = 4.0
    dominance: float = 0.70
    ratio: float = 3.0
    stack: int = 3
    climax_window: int = 2016
    climax_quantile: float = 0.95


@dataclass(frozen=True)
class Study:
    start_ms: int = 1_656_633_600_000
    end_ms: int = 1_782_863_999_000
    is_end_ms: int = 1_735_689_599_000
    oos_start_ms: int = 1_735_689_600_000
    # in-sample stretches, first and last ms: the second half of 2022, 2023, 2024
    stretches: tuple[tuple[int, int], ...] = ((1_656_633_600_000, 1_672_531_199_000), (1_672_531_200_000, 1_704_067_199_000), (1_704_067_200_000, 1_735_689_599_000))
    bar_ms: int = 300_000
    delta: float = 25.0
    warmup: int = 8640
    gap: int = 6
    horizons: tuple[int, ...] = (1, 3, 6, 12, 48)
    material_horizon: int = 6
    fee_bp: float = 5.0
    spread_bp: float = 1.0
    min_events: int = 300
    min_bp: float = 18.0
    q: float = 0.10
    reps: int = 2_000_000
    ic_reps: int = 10_000
    placebo_reps: int = 10_000
    grid_reps: int = 10_000
    min_shift: int = 2016
    detect: Detect = field(default_factory=Detect)

    @property
    def n_bars(self) -> int:
        return (self.end_ms - self.start_ms) // self.bar_ms + 1

    @property
    def round_trip(self) -> float:
        return 2 * (self.fee_bp + self.spread_bp) / 1e4


SIGNALS = ("H1", "H2", "H3", "H6")

_JAN = 1_704_067_200_000
HOURLY = Study(
    start_ms=_JAN, end_ms=_JAN + 30 * DAY_MS - 1, is_end_ms=_JAN + 20 * DAY_MS - 1, oos_start_ms=_JAN + 20 * DAY_MS,
    stretches=((_JAN, _JAN + 5 * DAY_MS - 1), (_JAN + 5 * DAY_MS, _JAN + 13 * DAY_MS - 1), (_JAN + 13 * DAY_MS, _JAN + 20 * DAY_MS - 1)),
    bar_ms=3_600_000, delta=10.0, warmup=60, horizons=(1, 3, 6, 12), min_events=10, min_bp=1.0, reps=20_000, ic_reps=500, placebo_reps=400, min_shift=48,
    detect=Detect(cum_window=6, sigma_window=48, high_window=6, volume_window=24, multiple=3.0, ratio=2.0, stack=2, climax_window=48, climax_quantile=0.80),
)
#: HOURLY with few replicates, for draws that are given and not random.
GIVEN = replace(HOURLY, reps=300, ic_reps=60, placebo_reps=200)
