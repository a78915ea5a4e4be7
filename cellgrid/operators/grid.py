"""Voxel grid geometry: projection to voxels, tiles, and neighbour exchange."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions.literals import offset_structs
from cellgrid.functions.offsets import Offset

VOXEL = ["i", "j", "k"]


@dataclass(frozen=True)
class Grid:
    """Origin, voxel size and tiling of the segmentation grid.

    ``quad`` is the edge length, in voxels, of the square blocks that bound
    outward expansion; ``tile`` is the block edge used to shuffle neighbours
    together.
    """

    xmin: float
    ymin: float
    zmin: float
    voxel_size: float
    layers: int
    quad: int = 75
    tile: int = 64

    @property
    def voxel_size_z(self) -> float:
        return 1.0 / self.layers

    @property
    def voxel_volume(self) -> float:
        return self.voxel_size * self.voxel_size * self.voxel_size_z

    def finer(self, scale: int) -> Grid:
        return replace(self, voxel_size=self.voxel_size / scale, quad=self.quad * scale)

    # -- column expressions -------------------------------------------------
    def i(self, x: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((x - F.lit(self.xmin)) / F.lit(self.voxel_size)).cast("bigint"))

    def j(self, y: Column) -> Column:
        return F.greatest(F.lit(0), F.floor((y - F.lit(self.ymin)) / F.lit(self.voxel_size)).cast("bigint"))

    def k(self, z: Column) -> Column:
        layer = ((z - F.lit(self.zmin)) / F.lit(self.voxel_size_z)).cast("bigint")
        return F.least(F.lit(self.layers - 1), F.greatest(F.lit(0), layer)).cast("bigint")

    def center_x(self, i: Column) -> Column:
        return (i + F.lit(0.5)) * F.lit(self.voxel_size) + F.lit(self.xmin)

    def center_y(self, j: Column) -> Column:
        return (j + F.lit(0.5)) * F.lit(self.voxel_size) + F.lit(self.ymin)

    def center_z(self, k: Column) -> Column:
        return (k + F.lit(0.5)) * F.lit(self.voxel_size_z) + F.lit(self.zmin)


def grid_for(
    transcripts: DataFrame, voxel_size: float, layers: int, quad_size: float = 150.0
) -> Grid:
    """Grid whose origin is the minimum of the data (one small aggregate)."""
    low = transcripts.agg(F.min("x"), F.min("y"), F.min("z")).first()
    if low[0] is None:
        raise ValueError("no transcripts left to build a grid from")
    return Grid(
        xmin=low[0], ymin=low[1], zmin=low[2], voxel_size=voxel_size, layers=layers,
        quad=max(1, math.floor(quad_size / voxel_size + 0.5)),
    )


def coordinate_span(transcripts: DataFrame) -> DataFrame:
    """Bounding box and multiplicity-weighted mean depth."""
    lo_hi = [f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    n = F.col("n")
    return transcripts.agg(*lo_hi, (F.sum(F.col("z") * n) / F.sum(n)).alias("z_mean"))


def voxelize(transcripts: DataFrame, grid: Grid) -> DataFrame:
    return transcripts.withColumns(
        {"i": grid.i(F.col("x")), "j": grid.j(F.col("y")), "k": grid.k(F.col("z"))}
    )


def voxel_counts(voxelized: DataFrame) -> DataFrame:
    """Molecules per (voxel, gene), all still at their observed position."""
    return voxelized.groupBy(*VOXEL, "gene").agg(F.sum("n").alias("n"))


def shift(df: DataFrame, offsets: list[Offset]) -> DataFrame:
    """One row per (row, offset), with the shifted voxel in place of ``i, j, k``."""
    keep = [c for c in df.columns if c not in VOXEL]
    return df.select(*VOXEL, *keep, F.explode(offset_structs(offsets)).alias("o")).select(
        (F.col("i") + F.col("o.di")).alias("i"),
        (F.col("j") + F.col("o.dj")).alias("j"),
        (F.col("k") + F.col("o.dk")).alias("k"),
        *keep,
        F.col("o.di").alias("di"), F.col("o.dj").alias("dj"), F.col("o.dk").alias("dk"),
    )


def tile_of(c: Column, tile: int) -> Column:
    return F.floor(c / F.lit(float(tile))).cast("bigint")


def by_tile(df: DataFrame, grid: Grid) -> DataFrame:
    """Shuffle voxel rows so that each tile and its one-voxel halo share a task.

    Only rows on a tile border are copied (to at most three more tiles), so the
    shuffle carries little more than the input; neighbour messages are then
    expanded after the shuffle and aggregated without another one. A tile
    holds one row per voxel, which bounds its size whatever the data density.
    """
    t = grid.tile
    lo_u, hi_u = tile_of(F.col("i") - 1, t), tile_of(F.col("i") + 1, t)
    lo_v, hi_v = tile_of(F.col("j") - 1, t), tile_of(F.col("j") + 1, t)
    tiles = F.array_distinct(
        F.array(*[F.struct(a.alias("tu"), b.alias("tv")) for a in (lo_u, hi_u) for b in (lo_v, hi_v)])
    )
    cols = df.columns
    return (
        df.select(*cols, F.explode(tiles).alias("t"))
        .select(*cols, F.col("t.tu").alias("tu"), F.col("t.tv").alias("tv"))
        .repartition("tu", "tv")
    )


def in_own_tile(grid: Grid) -> Column:
    return (tile_of(F.col("i"), grid.tile) == F.col("tu")) & (tile_of(F.col("j"), grid.tile) == F.col("tv"))


def neighbour_messages(df: DataFrame, grid: Grid, offsets: list[Offset]) -> DataFrame:
    """Copy every voxel row to the voxels at ``offsets``, partitioned by tile.

    Rows carry ``tu, tv`` and the offset travelled; aggregations keyed by
    ``tu, tv, i, j, k`` need no further shuffle.
    """
    return shift(by_tile(df, grid), offsets).where(in_own_tile(grid) & in_grid(grid))


def in_grid(grid: Grid) -> Column:
    return (F.col("i") >= 0) & (F.col("j") >= 0) & F.col("k").between(0, grid.layers - 1)


def halo_rows(states: DataFrame, grid: Grid) -> DataFrame:
    """Border voxels replicated into the quads they touch, for quad-local reads."""
    q = float(grid.quad)
    own_u, own_v = F.floor(F.col("i") / F.lit(q)).cast("bigint"), F.floor(F.col("j") / F.lit(q)).cast("bigint")
    near = F.array_distinct(
        F.array(*[
            F.struct(
                F.floor((F.col("i") + a) / F.lit(q)).cast("bigint").alias("u"),
                F.floor((F.col("j") + b) / F.lit(q)).cast("bigint").alias("v"),
            )
            for a in (-1, 0, 1) for b in (-1, 0, 1)
        ])
    )
    rows = states.select(*VOXEL, "cell", F.explode(near).alias("q"), own_u.alias("ou"), own_v.alias("ov"))
    rows = rows.select(F.col("q.u").alias("u"), F.col("q.v").alias("v"), *VOXEL, "cell", "ou", "ov")
    return rows.where(
        ((F.col("u") != F.col("ou")) | (F.col("v") != F.col("ov"))) & (F.col("u") >= 0) & (F.col("v") >= 0)
    ).drop("ou", "ov")
