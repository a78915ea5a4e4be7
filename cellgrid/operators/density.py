"""Local transcript density and its quantile bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.offsets import diamond
from cellgrid.operators.grid import VOXEL, Grid, shift
from cellgrid.operators.skew import order_statistics, shuffled
from cellgrid.session import materialize

TAIL = 1e-3  # kernel weight below which molecules are ignored
REACH = 3  # voxels around occupied ones that also get a density


def local_density(voxelized: DataFrame, grid: Grid, bandwidth: float = 0.5) -> DataFrame:
    """Gaussian kernel density at the centre of each (i, j) near an occupied voxel.

    Scatter and sum: each molecule adds its weight to the few centres in
    reach, so crowded spots combine map-side and no range join is needed. The
    sum is rounded so that it does not depend on the order of addition.
    """
    radius2 = -2.0 * bandwidth**2 * math.log(TAIL)
    reach = math.floor(math.sqrt(radius2) / grid.voxel_size + 0.5)
    span = range(-reach, reach + 1)
    mols = voxelized.select("i", "j", F.lit(0).cast("bigint").alias("k"), "x", "y", "n")
    near = shift(mols, [(a, b, 0) for a in span for b in span]).where("i >= 0 AND j >= 0")
    d2 = (grid.center_x(F.col("i")) - F.col("x")) ** 2 + (grid.center_y(F.col("j")) - F.col("y")) ** 2
    weight = F.col("n") * F.exp(-d2 / F.lit(2.0 * bandwidth**2)) * F.lit(bandwidth * math.sqrt(2.0 * math.pi))
    terms = near.withColumn("d2", d2).where(F.col("d2") <= F.lit(radius2)).select("i", "j", weight.alias("w"), F.lit(0).alias("seen"))
    # voxels to evaluate: occupied columns and the diamond around them
    occupied = voxelized.select("i", "j", F.lit(0).cast("bigint").alias("k")).distinct()
    wanted = shift(occupied, diamond(REACH)).where("i >= 0 AND j >= 0").select("i", "j", F.lit(0.0).alias("w"), F.lit(1).alias("seen"))
    return (
        terms.unionByName(wanted).groupBy("i", "j")
        .agg(F.round(F.sum("w"), 9).alias("density"), F.max("seen").alias("seen"))
        .where("seen = 1").drop("seen")
    )


def density_edges(density: DataFrame, bins: int = 5) -> list[float]:
    """Upper edges of the bins: order statistics at 1/B ... B/B."""
    n = density.count()
    return order_statistics(density, "density", [min(n - 1, int(b / bins * n)) for b in range(1, bins + 1)])


def density_bins(density: DataFrame, bins: int = 5) -> DataFrame:
    """Bin = number of edges at or below the density, at most ``bins - 1``."""
    density = materialize(density, "density")  # each pass of the order statistics reads it
    edges = density_edges(density, bins)
    passed = sum((F.when(F.col("density") >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return density.select("i", "j", F.least(F.lit(bins - 1), passed).cast("bigint").alias("bin"))


def region_volume(binned: DataFrame, grid: Grid) -> DataFrame:
    """Volume of one layer's worth of each density bin."""
    return binned.groupBy("bin").agg((F.count(F.lit(1)) * F.lit(grid.voxel_volume)).alias("volume"))


def attach_origin(counts: DataFrame, binned: DataFrame) -> DataFrame:
    """Counts with the layer and density bin of their observed voxel (never changes later)."""
    return counts.join(shuffled(binned), ["i", "j"], "left").select(
        *VOXEL, "gene", F.col("k").alias("k0"), F.coalesce("bin", F.lit(0)).cast("bigint").alias("density"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("di", "dj", "dk")], "n",
    )
