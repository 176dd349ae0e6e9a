"""Sums in reduced precision, chosen by the size of the numbers.

numpy has half precision; the 8-bit-mantissa format is a float rounded to its
upper 16 bits.
"""

from __future__ import annotations

import numpy as np


def half(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.float64).astype(np.float16).astype(np.float32)


def brain(x: np.ndarray) -> np.ndarray:
    """float32 rounded (half to even) to its upper 16 bits."""
    u = np.asarray(x, np.float32).view(np.uint32)
    return ((u + np.uint32(0x7FFF) + ((u >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)).view(np.float32)


def _tiered(size: float, low: float, high: float):
    return half if size < low else brain if size < high else lambda x: np.asarray(x, np.float64)


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """Half below 100, the brain format below 10,000, else double."""
    size = max((float(np.abs(x).max(initial=0.0)) for x in (a, b)), default=0.0)
    cast = _tiered(size, 100.0, 10_000.0)
    return float((cast(a) * cast(b)).sum())


def weighted_sum(values: np.ndarray, weights: np.ndarray) -> float:
    """Half below 50, the brain format below 5,000, else double."""
    size = max(float(np.abs(values).max(initial=0.0)), float(np.abs(weights).max(initial=0.0)))
    cast = _tiered(size, 50.0, 5_000.0)
    return float((cast(values) * cast(weights)).sum(dtype=np.float64))


def gradient_sum(g: np.ndarray) -> float:
    """Half below 1e-4, the brain format below 1, else double."""
    return float(_tiered(float(np.abs(g).max(initial=0.0)), 1e-4, 1.0)(g).sum(dtype=np.float64))
