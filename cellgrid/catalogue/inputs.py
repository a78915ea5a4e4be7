"""Prepared tables the catalogue queries start from."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.catalogue import ctes as C
from cellgrid.operators import density, initial, measures, prep
from cellgrid.operators.grid import Grid, grid_for, voxel_counts, voxelize
from cellgrid.session import materialize
from cellgrid.sources import fixtures as fx


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.transcripts(spark, sf_dir)


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered transcripts with normalised assignments (the SQL's ``tx``)."""
    t = prep.exclude_genes(prep.quality_filter(raw(spark, sf_dir), C.MIN_QV), C.EXCLUDED)
    t = prep.normalize_assignment(t, "cell_id", "UNASSIGNED", "overlaps_nucleus", "1")
    return t.select(
        "transcript_id", "gene", F.col("x_location").alias("x"), F.col("y_location").alias("y"),
        F.col("z_location").alias("z"), F.lit(1).cast("bigint").alias("n"), F.col("fov_name").alias("fov"), "cell", "nucleus",
    )


def memo(fn):
    """Keep the result of a shared stage for the session: a table written once, then scanned."""
    return lru_cache(maxsize=8)(fn)


@memo
def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Transcripts with scaled depth, laid out by tile, and the grid over them."""
    t = prep.clip_and_scale_z(materialize(canonical(spark, sf_dir), "canonical"))
    return materialize(prep.cluster_spatially(t), "transcripts"), grid_for(t, C.VOXEL_SIZE, C.LAYERS, C.QUAD * C.VOXEL_SIZE)


def voxelized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    t, grid = prepared(spark, sf_dir)
    return voxelize(t, grid), grid


def counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    v, grid = voxelized(spark, sf_dir)
    return voxel_counts(v), grid


def compute_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, _ = voxelized(spark, sf_dir)
    return initial.states_from_assignments(v, C.NUCLEAR_REASSIGNMENT, C.PRIOR_REASSIGNMENT)


@memo
def keyed_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    return materialize(compute_states(spark, sf_dir), "keyed"), prepared(spark, sf_dir)[1]


@memo
def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    s, grid = keyed_states(spark, sf_dir)
    return materialize(initial.recode_cells(s, initial.used_cells(s)), "states"), grid


@memo
def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, grid = voxelized(spark, sf_dir)
    return materialize(density.density_bins(density.local_density(v, grid, C.BANDWIDTH), C.BINS), "bins")


@memo
def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """Counts with origin layer, density and current cell."""
    c, grid = counts(spark, sf_dir)
    s, _ = states(spark, sf_dir)
    return materialize(measures.label_counts(density.attach_origin(c, binned(spark, sf_dir)), s), "labelled"), grid


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})
