"""Settings of the engine, and those derived from the shape of the data.

Fixed values throughout: the published defaults and tiers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class BoostSettings:
    """objective: logistic, squared, huber, poisson or custom; ``compat`` keeps quirks of published behaviour (see ``fit``).

    ``loss``, for a custom objective: a function of margins and labels (arrays) to gradients and hessians.  Such a model
    starts at the mean label, is validated by squared error and predicts its margin; a saved one keeps no function."""

    objective: str = "logistic"
    trees: int = 1000
    learning_rate: float = 0.05
    depth: int = 6
    min_samples_split: int = 100
    min_child_weight: float = 5.0
    reg_lambda: float = 2.0
    gamma: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.7
    patience: int = 75
    bins: int = 32
    mi_weight: float = 0.3
    scale_pos_weight: float = 1.0
    huber_delta: float = 1.0
    seed: int = 1
    compat: bool = False
    loss: Callable | None = None

    def __post_init__(self):
        if not 2 <= self.bins <= 255:
            raise ValueError("bins must be from 2 to 255")
        if self.objective not in ("logistic", "squared", "huber", "poisson", "custom"):
            raise ValueError(f"unknown objective {self.objective}")


#: First match of (share of positives below, or above its complement).
IMBALANCE = ((0.02, "extreme"), (0.10, "high"), (0.20, "moderate"))
RATES = {"trivial": 0.15, "simple": 0.10, "standard": 0.08, "complex": 0.05}
DEPTHS = {
    "trivial": {},
    "simple": {"extreme": 4, "high": 4},
    "standard": {"extreme": 4, "high": 5},
    "complex": {"extreme": 8, "high": 7},
}
USUAL_DEPTH = {"trivial": 4, "simple": 5, "standard": 6, "complex": 6}
TREES = {"trivial": (100, 500), "simple": (200, 800), "standard": (300, 1000), "complex": (700, 2000)}
PATIENCE = ((5_000, 50), (20_000, 40), (100_000, 35), (math.inf, 30))
LAMBDAS = {"extreme": 0.8, "high": 0.12}
CHILD = {"extreme": (0.02, 2.0, 10.0), "high": (0.01, 1.5, 8.0)}
MI = {"extreme": 0.25, "high": 0.20, "moderate": 0.15}


def imbalance(pos_ratio: float) -> str:
    return next((name for edge, name in IMBALANCE if pos_ratio < edge or pos_ratio > 1 - edge), "balanced")


def complexity(n: int, features: int) -> str:
    if n < 1000 or features < 10:
        return "trivial"
    if n < 10_000 and features < 50:
        return "simple"
    return "complex" if n > 100_000 or features > 200 else "standard"


def derive(n: int, features: int, pos_ratio: float, **overrides) -> BoostSettings:
    """Settings for a binary model of n rows; explicit values win."""
    level, size = imbalance(pos_ratio), complexity(n, features)
    low, high = TREES[size]
    share, least, most = CHILD.get(level, (0.005, 1.0, 5.0))
    found = BoostSettings(
        learning_rate=0.025 if level == "extreme" else RATES[size],
        depth=DEPTHS[size].get(level, USUAL_DEPTH[size]),
        trees=max(low, min(high, int(50 * math.log(max(n, 1))))),
        patience=next(p for edge, p in PATIENCE if n < edge) + {"extreme": 20, "high": 10}.get(level, 0),
        reg_lambda=LAMBDAS.get(level, 0.10) * math.sqrt(features),
        gamma=0.1,
        min_child_weight=max(least, min(most, n * pos_ratio * share)),
        min_samples_split=0,
        subsample=0.8,
        colsample=0.6 if features > 100 else 0.8,
        mi_weight=MI.get(level, 0.05),
        scale_pos_weight=(1 - pos_ratio) / max(pos_ratio, 1e-6),
    )
    return replace(found, **overrides)


def derive_regression(n: int, features: int, outliers: float, mad: float, **overrides) -> BoostSettings:
    robust = outliers > 0.05
    found = BoostSettings(
        objective="huber" if robust else "squared",
        huber_delta=1.35 * mad,
        learning_rate=0.1 if n < 5000 else 0.05,
        depth=max(4, min(8, int(math.log(features)) + 3)),
        reg_lambda=0.1 * math.sqrt(features),
        trees=max(200, min(2000, 100 * int(math.log(max(n, 1))))),
        mi_weight=0.0,
    )
    return replace(found, **overrides)


@dataclass(frozen=True)
class DriftSettings:
    """Thresholds of the adaptive loop."""

    alert_after: int = 1
    adapt_after: int = 2
    buffer: int = 10_000
    cooldown: int = 5_000
    degradation: float = 0.10
    recovered: float = 0.95
    tolerance: float = 0.98
    dead_below: float = 0.15
    decay: float = 0.0005
    prune_at: float = 0.8
    ema_alpha: float = 0.1
    validate_on: int = 2_000
    least_buffer: int = 1_000
    #: Scores of batches that are averaged, and the fewest that tell anything.
    recent: int = 5
    least_recent: int = 3
    #: Errors over this count as vulnerable; so many of the newest are remembered.
    error_over: float = 0.2
    remembered: int = 5_000
    holdout: bool = False

    @classmethod
    def for_rows(cls, n: int, **overrides) -> DriftSettings:
        """By the size of the training set."""
        tiers = ((50_000, (1, 2, 10_000, 5_000)), (200_000, (2, 3, 15_000, 10_000)), (math.inf, (3, 5, 20_000, 15_000)))
        a, b, buffer, cooldown = next(v for edge, v in tiers if n < edge)
        return cls(**{"alert_after": a, "adapt_after": b, "buffer": buffer, "cooldown": cooldown} | overrides)


@dataclass(frozen=True)
class RegressionDrift:
    """Fixed values of the adaptive regression."""

    #: RMSE of the newest three batches, oldest first.
    rmse_weights: tuple[float, float, float] = (0.2, 0.3, 0.5)
    degradation: float = 0.10
    #: Over so many baselines of average error the data count as noisy, and more degradation is let pass.
    noisy_over: float = 2.0
    noisy_factor: float = 1.5
    vulnerable_over: float = 1.5
    #: The first model must beat this share of the labels' spread.
    learned_under: float = 0.95
    least_baseline: float = 0.001
    rollback_over: float = 1.02
    new_baseline_under: float = 1.1
    #: Of the buffer, what is validated on: a third (at least ``least_validation``) up to 4,000 rows, then 2,000, then a fifth.
    least_validation: int = 500
    diagnose_on: int = 2_000
    mean_shift_rows: int = 2_000
    entropy_over: float = 1.2
    prune_share: float = 0.7
    prune_at: tuple[tuple[str, float], ...] = (("systemic", 0.95), ("feature_shift", 0.90), ("localized", 1.0))
    #: Complexity from which a level holds, and its factor of the learning rate.
    rate_factors: tuple[tuple[float, float], ...] = ((2.5, 0.9), (1.2, 1.0), (-math.inf, 1.1))
    rate_multiplier: float = 1.5
    most_rate: float = 0.05
    lambda_factor: float = 5.0
    gamma_factor: float = 2.0
    #: Gradients of a larger norm are scaled down to it; at ``stop_factor`` times it no tree is added.
    gradient_norm: float = 5_000.0
    stop_factor: float = 5.0
    #: Margins further from the mean label than this times its size are clamped; a mean margin further off than ``reset_over`` times starts anew.
    clamp_factor: float = 100.0
    reset_over: float = 10.0

    def validation_rows(self, n: int) -> int:
        return min(n, max(n // 3, self.least_validation)) if n <= 4_000 else 2_000 if n <= 15_000 else max(n // 5, 2_000)


@dataclass(frozen=True)
class PartitionDrift:
    """Fixed values of partitions: a moving error over ``factor`` baselines (at least ``least``) has drifted."""

    alpha: float = 0.1
    factor: float = 1.3
    least: float = 0.01
    least_rows: int = 10
    retrain_rows: int = 50
