"""Column expressions for the model's closed-form functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Isoperimetric constant and its surface correction.
ISOPERIMETRIC = 9.43 * 4.0 * math.pi


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def odds_to_prob(q: Column) -> Column:
    return q / (F.lit(1.0) + q)


def normal_logpdf(mu: Column, sigma: Column, x: Column) -> Column:
    z = (x - mu) / sigma
    return F.lit(-0.5 * math.log(2.0 * math.pi)) - F.log(sigma) - z * z / 2.0


def halfnormal_logpdf(sigma: float, x: Column) -> Column:
    return F.lit(-0.5 * math.log(2.0 * math.pi) - math.log(sigma)) - x * x / (2.0 * sigma * sigma)


def inverse_isoperimetric_quotient(surface: Column, volume: Column) -> Column:
    """ln(max(1, s^2 / (c v))), 0 for an empty cell."""
    surface = surface.cast("double")
    volume = volume.cast("double")
    ratio = surface * surface / (F.lit(ISOPERIMETRIC) * F.greatest(volume, F.lit(1.0)))
    return F.when(volume <= 0, F.lit(0.0)).otherwise(F.log(F.greatest(F.lit(1.0), ratio)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def affine_x(coef: tuple[float, float, float], px: Column, py: Column) -> Column:
    a, b, c = coef
    return px * F.lit(a) + py * F.lit(b) + F.lit(c)


def affine_det(xt: tuple[float, float, float], yt: tuple[float, float, float]) -> float:
    return xt[0] * yt[1] - xt[1] * yt[0]
