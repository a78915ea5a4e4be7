"""Aggregates over the voxel grid: volumes, surfaces, centroids, count matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.offsets import MOORE_2D
from cellgrid.operators.grid import VOXEL, Grid, neighbour_messages
from cellgrid.operators.skew import shuffled

COUNT_KEY = [*VOXEL, "gene", "k0", "density", "di", "dj", "dk"]


def layer_volume_surface(states: DataFrame, grid: Grid) -> DataFrame:
    """Voxels and exposed Moore faces of every (cell, layer).

    Each voxel reports to itself and its eight neighbours; grouped by (voxel,
    cell), the number of reports is one plus the like neighbours.
    """
    occupied = states.where(F.col("cell").isNotNull()).select(*VOXEL, "cell")
    reports = neighbour_messages(occupied, grid, [(0, 0, 0), *MOORE_2D])
    own = (F.col("di") == 0) & (F.col("dj") == 0)
    per_voxel = reports.groupBy("tu", "tv", *VOXEL, "cell").agg(F.max(own).alias("own"), F.count(F.lit(1)).alias("m"))
    return (
        per_voxel.where("own").groupBy("cell", "k")
        .agg(F.count(F.lit(1)).alias("volume"), F.sum(9 - F.col("m")).alias("surface"))
    )


def volume_surface(per_layer: DataFrame) -> DataFrame:
    return per_layer.groupBy("cell").agg(F.sum("volume").alias("volume"), F.sum("surface").alias("surface"))


def centroids(states: DataFrame, grid: Grid) -> DataFrame:
    """Mean voxel centre of each cell."""
    return (
        states.where(F.col("cell").isNotNull()).groupBy("cell")
        .agg(
            F.avg(grid.center_x(F.col("i"))).alias("centroid_x"),
            F.avg(grid.center_y(F.col("j"))).alias("centroid_y"),
            F.avg(grid.center_z(F.col("k"))).alias("centroid_z"),
            F.count(F.lit(1)).alias("volume"),
        )
    )


def label_counts(counts: DataFrame, states: DataFrame) -> DataFrame:
    """Counts with the cell that owns their current voxel (NULL for background)."""
    return counts.join(shuffled(states.select(*VOXEL, "cell")), VOXEL, "left")


def cell_gene_counts(labelled: DataFrame) -> DataFrame:
    """Assigned molecules by cell, gene, and layer and density of their origin."""
    return (
        labelled.where(F.col("cell").isNotNull())
        .groupBy("cell", "gene", "k0", "density").agg(F.sum("n").alias("n"))
    )


def unassigned_counts(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("cell").isNull()).groupBy("gene", "k0", "density").agg(F.sum("n").alias("n"))


def gene_totals(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("gene").agg(F.sum("n").alias("total_count"))


def running_mean(samples: DataFrame, keys: list[str], n_samples: int) -> DataFrame:
    """Mean over samples of sparse counts; a missing entry counts as zero."""
    return samples.groupBy(*keys).agg((F.sum("n") / F.lit(float(n_samples))).alias("mean"))


def transitions(moves: DataFrame) -> DataFrame:
    """Molecules moved from one cell to another."""
    return (
        moves.where(F.col("from_cell").isNotNull() & F.col("to_cell").isNotNull())
        .groupBy("from_cell", "to_cell").agg(F.sum("n").alias("n"))
    )


def merge_deltas(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Apply signed changes and drop emptied entries."""
    return (
        counts.select(*COUNT_KEY, "n").unionByName(deltas.select(*COUNT_KEY, "n"))
        .groupBy(*COUNT_KEY).agg(F.sum("n").alias("n")).where("n <> 0")
    )
