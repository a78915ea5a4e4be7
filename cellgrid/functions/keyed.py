"""Random numbers from row keys.

A draw depends only on the seed and the row's key, never on partitioning or on
the rows that share a batch, so a lost task recomputes the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellgrid.functions.literals import doubles

_MANTISSA = (1 << 53) - 1


def row_key(seed: int, *parts: Column | str | int) -> Column:
    """64-bit key of a row for one purpose (put the purpose among the parts)."""
    cols = [F.lit(seed).cast("bigint")]
    for p in parts:
        cols.append(F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p)
    return F.xxhash64(*cols)


def uniform(key: Column, draw: int = 0) -> Column:
    """Uniform on (0, 1)."""
    bits = F.xxhash64(key, F.lit(draw)).bitwiseAND(F.lit(_MANTISSA))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(_MANTISSA + 1))


def normal(key: Column, draw: int = 0) -> Column:
    return F.sqrt(F.lit(-2.0) * F.log(uniform(key, 2 * draw))) * F.cos(F.lit(2.0 * math.pi) * uniform(key, 2 * draw + 1))


def inverse_cdf(probs: list[float], u: Column) -> Column:
    """0-based index drawn from ``probs`` (normalised here)."""
    total, acc, cum = sum(probs), 0.0, []
    for p in probs[:-1]:
        acc += p / total
        cum.append(acc)
    if not cum:
        return F.lit(0)
    return F.size(F.filter(doubles(cum), lambda c: c < u))


_SCALE = float(1 << 20)


def exact_sum(value: Column) -> Column:
    """Sum in fixed point, so the result does not depend on the order of addition."""
    return F.sum(F.round(value * F.lit(_SCALE)).cast("decimal(38,0)")).cast("double") / F.lit(_SCALE)
