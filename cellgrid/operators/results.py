"""Result tables derived from the final voxel states and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.operators.grid import VOXEL, Grid
from cellgrid.operators.outline import polygons
from cellgrid.operators.skew import packed_vote, salted_prefix, unpack_candidate

BLOCK = 65536.0  # positions per block of the interval join


def voxel_totals(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Occupied voxels with their molecule totals: union and one aggregation, no join."""
    own = states.where(F.col("cell").isNotNull()).select(*VOXEL, "cell", F.lit(0).cast("bigint").alias("n"))
    mols = counts.select(*VOXEL, F.lit(None).cast(own.schema["cell"].dataType).alias("cell"), F.col("n").cast("bigint"))
    return (
        own.unionByName(mols).groupBy(*VOXEL).agg(F.max("cell").alias("cell"), F.sum("n").alias("n"))
        .where(F.col("cell").isNotNull())
    )


def consensus_votes(states: DataFrame, counts: DataFrame) -> DataFrame:
    """Dominant cell of each (i, j) column; a cell that wins none keeps its fullest voxel.

    Ties go to the lowest cell id, and to the first voxel. Cell ids are dense integers.
    """
    totals = voxel_totals(states, counts)
    votes = totals.groupBy("i", "j", "cell").agg(F.sum("n").alias("n"))
    won = votes.groupBy("i", "j").agg(unpack_candidate(F.max(packed_vote(F.col("n"), F.col("cell")))).alias("cell"))
    fullest = totals.groupBy("cell").agg(F.min(F.struct((-F.col("n")).alias("w"), "i", "j")).alias("b"))
    lost = fullest.join(won.select("cell").distinct(), "cell", "left_anti").select("b.i", "b.j", "cell")
    return won.unionByName(lost.select("i", "j", "cell"))


def consensus_polygons(states: DataFrame, counts: DataFrame, grid: Grid) -> DataFrame:
    voxels = consensus_votes(states, counts).withColumn("k", F.lit(0).cast("bigint"))
    return polygons(voxels, grid).drop("k")


def split_foreground(labelled: DataFrame, foreground: DataFrame) -> DataFrame:
    """Divide each count entry into foreground and background molecules.

    ``foreground(cell, gene, n_fg)`` is the budget; entries of a (cell, gene)
    use it up in voxel order. Background voxels have none.
    """
    inside = salted_prefix(labelled.where(F.col("cell").isNotNull()), ["cell", "gene"], [*VOXEL, "di", "dj", "dk"], "n")
    inside = inside.join(foreground, ["cell", "gene"], "left")
    left = F.coalesce("n_fg", F.lit(0)) - F.col("earlier")
    inside = inside.withColumn("fg", F.greatest(F.lit(0), F.least(F.col("n"), left)))
    cols = [*VOXEL, "gene", "di", "dj", "dk", "cell", "n", "fg"]
    outside = labelled.where(F.col("cell").isNull()).withColumn("fg", F.lit(0).cast("bigint"))
    return inside.select(*cols).unionByName(outside.select(*cols))


def transcript_metadata(voxelized: DataFrame, split: DataFrame, grid: Grid) -> DataFrame:
    """Give every observed transcript one molecule of its origin voxel and gene.

    Identical transcripts are first merged into runs. Runs of an origin (voxel,
    gene) and its count entries (foreground parts first) both lay out
    consecutive slots, and overlapping intervals are joined; a run that meets
    several entries is split. ``n`` is the number of molecules of a row. The
    cell is NULL unless the molecule is foreground.
    """
    key = [*VOXEL, "gene"]
    about = ["x", "y", "z", *[c for c in ("transcript_id", "fov") if c in voxelized.columns]]
    runs = voxelized.groupBy(*key, *about).agg(F.sum("n").alias("n"))
    runs = salted_prefix(runs, key, about, "n", "lo").withColumn("hi", F.col("lo") + F.col("n")).drop("n")
    parts = split.select(
        *[(F.col(c) - F.col(f"d{c}")).alias(c) for c in VOXEL], "gene", "di", "dj", "dk", "cell",
        F.explode(F.array(
            F.struct(F.lit(0).alias("late"), F.col("fg").alias("m")),
            F.struct(F.lit(1).alias("late"), (F.col("n") - F.col("fg")).alias("m")),
        )).alias("p"),
    ).select("*", "p.*").where("m > 0")
    slots = Window.partitionBy(*key).orderBy("late", "dk", "dj", "di").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("slot", F.coalesce(F.sum("m").over(slots), F.lit(0)))
    parts = parts.select(
        *key, "di", "dj", "dk", F.when(F.col("late") == 0, F.col("cell")).alias("assigned"), "slot", (F.col("slot") + F.col("m")).alias("slot_end")
    )
    # blocks of positions keep the interval join local and spread a crowded key
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.lit(BLOCK)), F.floor((F.col(b) - 1) / F.lit(BLOCK))))
    runs, parts = runs.withColumn("block", reach("lo", "hi")), parts.withColumn("block", reach("slot", "slot_end"))
    both = runs.join(parts, [*key, "block"]).where("lo < slot_end AND slot < hi")
    start, end = F.greatest("lo", "slot", F.col("block") * F.lit(BLOCK)), F.least("hi", "slot_end", (F.col("block") + 1) * F.lit(BLOCK))
    vs = F.lit(grid.voxel_size)
    return both.select(
        *[c for c in ("transcript_id", "fov") if c in about], "gene",
        F.col("x").alias("observed_x"), F.col("y").alias("observed_y"), F.col("z").alias("observed_z"),
        (F.col("x") + F.col("di") * vs).alias("x"), (F.col("y") + F.col("dj") * vs).alias("y"),
        (F.col("z") + F.col("dk") * F.lit(grid.voxel_size_z)).alias("z"),
        F.col("assigned").alias("assignment"), F.col("assigned").isNull().alias("background"),
        (end - start).cast("bigint").alias("n"),
    ).where("n > 0")


def cell_metadata(states: DataFrame, shapes: DataFrame, grid: Grid, cells: DataFrame) -> DataFrame:
    """One row per cell: centroid, volume in cubic microns, surface, cluster and scale.

    ``shapes(cell, volume, surface)`` counts voxels; ``cells`` holds
    ``cell, original_cell_id, cluster, scale``.
    """
    sums = states.where(F.col("cell").isNotNull()).groupBy("cell").agg(
        F.avg(grid.center_x(F.col("i"))).alias("centroid_x"),
        F.avg(grid.center_y(F.col("j"))).alias("centroid_y"),
        F.avg(grid.center_z(F.col("k"))).alias("centroid_z"),
    )
    return sums.join(shapes, "cell").join(cells, "cell").select(
        "cell", "original_cell_id", "centroid_x", "centroid_y", "centroid_z", "cluster",
        (F.col("volume") * F.lit(grid.voxel_volume)).alias("volume"), F.col("surface").alias("surface_area"), "scale",
    )


def gene_metadata(transcripts: DataFrame, expected: DataFrame, rates: DataFrame, layers: int, bins: int) -> DataFrame:
    """Totals per gene and one background-rate column per (density, layer)."""
    totals = transcripts.groupBy("gene").agg(F.sum("n").alias("total_count"))
    assigned = expected.groupBy("gene").agg(F.sum("mean").alias("expected_assigned_count"))
    wide = rates.groupBy("gene").agg(*[
        F.max(F.when((F.col("density") == d) & (F.col("k0") == k), F.col("rate"))).alias(f"lambda_bg_{d}_{k}")
        for d in range(bins) for k in range(layers)
    ])
    out = totals.join(assigned, "gene", "left").join(wide, "gene", "left")
    return out.withColumn("expected_assigned_count", F.coalesce("expected_assigned_count", F.lit(0.0)))
