"""Closed-form posterior expectations of the count model, as plain aggregations and joins.

``lab`` is a labelled count table (``gene, k0, density, n, cell``); rates are
per (gene, layer, density).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.scalar import dot
from cellgrid.operators.density import region_volume
from cellgrid.operators.grid import Grid

RATE_KEY = ["gene", "k0", "density"]


def volumes(binned: DataFrame, grid: Grid) -> DataFrame:
    return region_volume(binned, grid).withColumnRenamed("bin", "density")


def full_index(lab: DataFrame, layers: int, bins: int) -> DataFrame:
    """Every (gene, layer, density), generated from each gene."""
    regions = [F.struct(F.lit(k).cast("bigint").alias("k0"), F.lit(d).cast("bigint").alias("density")) for k in range(layers) for d in range(bins)]
    genes = lab.select("gene").distinct()
    return genes.select("gene", F.explode(F.array(*regions)).alias("r")).select("gene", "r.k0", "r.density")


def background_shape_rate(background: DataFrame, index: DataFrame, volume: DataFrame, shape: float = 1.0, rate: float = 1.0) -> DataFrame:
    """Gamma posterior of each background rate: ``shape + x`` and ``rate + V``."""
    n = background.groupBy(*RATE_KEY).agg(F.sum("n").alias("n"))
    return index.join(n, RATE_KEY, "left").join(volume, "density", "left").select(
        *RATE_KEY, (F.lit(shape) + F.coalesce("n", F.lit(0))).alias("shape"), (F.lit(rate) + F.coalesce("volume", F.lit(0.0))).alias("rate")
    )


def background_rate_mean(background: DataFrame, index: DataFrame, volume: DataFrame) -> DataFrame:
    post = background_shape_rate(background, index, volume)
    return post.select(*RATE_KEY, (F.col("shape") / F.col("rate")).alias("rate"))


def expression_rate(phi: DataFrame, theta: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rate of each (cell, gene) pair: inner product of cell and gene factors."""
    return pairs.join(phi, "cell").join(theta, "gene").withColumn("lam", dot(F.col("phi"), F.col("theta"))).drop("phi", "theta")


def expected_foreground(assigned: DataFrame, phi: DataFrame, theta: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected foreground molecules: n * lam / (lam + background rate)."""
    lam = expression_rate(phi, theta, assigned).join(rates, RATE_KEY)
    return lam.withColumn("expected", F.col("n") * F.col("lam") / (F.col("lam") + F.col("rate")))


def expected_latent(foreground: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """Expected counts per (cell, latent): each molecule split in proportion to phi * theta."""
    both = foreground.join(phi, "cell").join(theta, "gene")
    weights = F.zip_with("phi", "theta", lambda a, b: a * b)
    share = both.select("cell", "n", weights.alias("w"), dot(F.col("phi"), F.col("theta")).alias("s"))
    return share.select("cell", F.posexplode("w").alias("latent", "w"), "n", "s").groupBy("cell", "latent").agg(
        F.sum(F.col("n") * F.col("w") / F.col("s")).alias("expected")
    )


def phi_posterior_mean(latent: DataFrame, cells: DataFrame, r: float, s: float, theta_sum: float) -> DataFrame:
    """Mean of the Gamma posterior of a factor: (r + x) * s / (1 + s * ev * sum(theta))."""
    ev = F.col("ev") * F.lit(theta_sum)
    return latent.join(cells, "cell").withColumn("mean", (F.lit(r) + F.col("x")) * F.lit(s) / (F.lit(1.0) + F.lit(s) * ev))


def component_stats(cells: DataFrame) -> DataFrame:
    """Population, volume and molecules of each mixture component."""
    return cells.groupBy("z").agg(F.count(F.lit(1)).alias("population"), F.sum("ev").alias("volume"), F.sum("x").alias("molecules"))


def volume_posterior(cells: DataFrame, sigma: float, mu0: float, sigma0: float) -> DataFrame:
    """Mean and variance of the normal posterior of each component's log volume."""
    a = cells.groupBy("z").agg(F.sum(F.log("ev")).alias("slv"), F.count(F.lit(1)).alias("m"))
    v = F.lit(1.0) / (F.lit(1.0 / sigma0**2) + F.col("m") / F.lit(sigma**2))
    return a.select("z", (v * (F.lit(mu0 / sigma0**2) + F.col("slv") / F.lit(sigma**2))).alias("mean"), v.alias("variance"))


def log_likelihood(assigned: DataFrame, background: DataFrame, phi: DataFrame, theta: DataFrame, exposure: DataFrame, rates: DataFrame, volume: DataFrame) -> DataFrame:
    """sum x ln(lam) - sum ev * phi . sum(theta) + sum bg (x ln(rate) - rate V), one row."""
    pairs = assigned.groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    first = expression_rate(phi, theta, pairs).agg(F.sum(F.col("n") * F.log("lam")).alias("v"))
    second = exposure.agg((-F.sum(F.col("ev") * F.col("phi_theta"))).alias("v"))
    bg = rates.join(background, RATE_KEY, "left").join(volume, "density", "left")
    third = bg.agg(F.sum(F.coalesce("n", F.lit(0)) * F.log("rate") - F.col("rate") * F.coalesce("volume", F.lit(0.0))).alias("v"))
    return first.unionByName(second).unionByName(third).agg(F.sum("v").alias("log_likelihood"))
