"""Thresholds, horizons and quality limits that the operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass

HOUR = 3600
DAY = 86400

# Placeholder address of a mint or burn, plausible bounds of a conversion rate.
ZERO_ADDRESS = "0x" + "0" * 40
RATE_BOUNDS = (0.5, 3.0)

# Severity names counted as severe, and status names of a cross-check.
SEVERE = ("major", "collapse")
STATUSES = ("confirmed", "partial", "contradicted", "unverified")


@dataclass(frozen=True)
class Rules:
    """Labelling rules. The defaults are those of hourly stablecoin prices."""

    theta_usd: float = 0.01
    theta_eth: float = 0.02
    min_run: int = 2
    severe: float = 0.05
    band_frac: float = 0.5
    recovery: int = 24
    gap_fill: int = 3
    rate_fill_hours: int = 72
    trailing_hours: int = 168
    trailing_min: int = 24
    min_confidence: float = 0.9
    flat_share: float = 0.9
    horizons: tuple[int, ...] = (24, 72)
    tiers: tuple[tuple[float, str], ...] = ((0.05, "minor"), (0.2, "major"), (1.0, "collapse"))
    snapback_dev: float = -0.30
    snapback_hours: int = 12
    cluster_assets: int = 3
    dead_dev: float = -0.50
    dead_hours: int = 24
    rate_low: float = RATE_BOUNDS[0]
    rate_high: float = RATE_BOUNDS[1]
    train_end: int = 0
    valid_end: int = 0
    severe_level: float = 0.05
