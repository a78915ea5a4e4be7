"""Voxel displacement probabilities of a Gaussian blur, as small lookup tables.

A molecule lies anywhere in its voxel with equal chance and is displaced by a normal
offset. The chance to end d voxels on is the normal density averaged over both voxels,
that is, the second difference of the density's second integral on the voxel grid.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-5  # tables end where the probability falls below this
_REACH = 4.5  # standard deviations beyond which a normal variable has less mass than EPS


def _beyond(x: np.ndarray, sigma: float) -> np.ndarray:
    """Mean excess of a normal variable over x >= 0: its density, integrated twice from infinity."""
    z = x / sigma
    tail = np.array([0.5 * math.erfc(v / math.sqrt(2.0)) for v in z])
    return sigma * np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi) - x * tail


def displacement_probs(voxel_size: float, sigma: float) -> list[float]:
    """P(move by d voxels) for d = 0, 1, ... down to ``EPS``."""
    far = 2 + math.ceil(_REACH * sigma / voxel_size)
    excess = _beyond(voxel_size * np.arange(far + 2), sigma)
    p = np.empty(far + 1)
    p[1:] = (excess[2:] - 2.0 * excess[1:-1] + excess[:-2]) / voxel_size
    p[0] = 1.0 - 2.0 * (excess[0] - excess[1]) / voxel_size
    last = np.flatnonzero(p[1:] >= EPS)
    return p[: (last[-1] if len(last) else -1) + 2].tolist()


def mirrored(one_sided: list[float]) -> list[float]:
    """Two-sided table for d = -n ... n."""
    return one_sided[:0:-1] + one_sided
