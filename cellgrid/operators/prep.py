"""Filters, dictionaries and numeric preparation of a transcript table.

Canonical columns: ``gene, x, y, z, n`` and, where known, ``transcript_id,
fov, cell, nucleus``. ``cell`` and ``nucleus`` hold the cell's key, NULL for
background; ``n`` is the number of identical molecules the row stands for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.skew import dense_index, order_statistics
from cellgrid.operators.spatial import range_semi_join

_UNSUPPORTED_REGEX = re.compile(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<")


def quality_filter(df: DataFrame, min_qv: float, qv: str = "qv") -> DataFrame:
    """Drop rows below ``min_qv``; a missing column, NULL or NaN quality is kept."""
    if qv not in df.columns:
        return df
    # NaN sorts above every number, so the comparison keeps it; this form reaches the Parquet scan
    return df.where((F.col(qv) >= F.lit(float(min_qv))) | F.col(qv).isNull())


def check_pattern(pattern: str) -> str:
    """Only patterns of a linear-time matcher: no look-around, no back-references."""
    if _UNSUPPORTED_REGEX.search(pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern!r}")
    return pattern


def exclude_genes(df: DataFrame, pattern: str | None, gene: str = "gene") -> DataFrame:
    """Drop genes the pattern matches anywhere in the name."""
    return df if not pattern else df.where(~F.col(gene).rlike(check_pattern(pattern)))


def cell_key(cell: Column, fov: Column | None) -> Column:
    """Key of a cell; with per-fov ids the fov is part of it (length-prefixed, so unambiguous)."""
    if fov is None:
        return cell
    return F.concat(F.length(fov).cast("string"), F.lit(":"), fov, F.lit(":"), cell)


def normalize_assignment(
    df: DataFrame,
    cell_id: str,
    unassigned: str | None,
    compartment: str | None = None,
    nuclear: str | None = None,
    assignment: str | None = None,
    assignment_unassigned: str | None = None,
    fov: str | None = None,
) -> DataFrame:
    """Add nullable ``cell`` and ``nucleus`` keys from the raw assignment columns."""
    raw = F.col(cell_id).cast("string")
    known = raw.isNotNull()
    if unassigned is not None:
        known = known & (raw != F.lit(unassigned))
    if assignment is not None and assignment_unassigned is not None:
        a = F.col(assignment).cast("string")
        known = known & a.isNotNull() & (a != F.lit(assignment_unassigned))
    cell = F.when(known, cell_key(raw, F.col(fov) if fov else None))
    nuclear_row = F.lit(True) if compartment is None else F.col(compartment).cast("string") == F.lit(nuclear)
    return df.withColumn("cell", cell).withColumn("nucleus", F.when(nuclear_row, F.col("cell")))


def scale_coordinates(df: DataFrame, scale: float) -> DataFrame:
    """Scale x and y, never z."""
    return df.withColumns({"x": F.col("x") * F.lit(float(scale)), "y": F.col("y") * F.lit(float(scale))})


def expressed_genes(df: DataFrame) -> DataFrame:
    """Genes with at least one molecule, renumbered in name order."""
    return gene_dictionary(df)


def gene_dictionary(df: DataFrame) -> DataFrame:
    return dense_index(df.select("gene"), ["gene"], "gene_id")


def fov_dictionary(df: DataFrame) -> DataFrame:
    return dense_index(df.select("fov"), ["fov"], "fov_id")


def cell_dictionary(df: DataFrame, by: list[str]) -> DataFrame:
    """Dense cell ids; ``by`` is the cell key alone or (fov, cell key)."""
    return dense_index(df.where(F.col(by[-1]).isNotNull()), by, "cell_index")


def unfactored_gene_order(df: DataFrame) -> DataFrame:
    """Genes by descending total count (ties by name); the first few stay unfactored."""
    totals = df.groupBy("gene").agg(F.sum("n").alias("n"))
    order = dense_index(totals.withColumn("neg", -F.col("n")), ["neg", "gene"], "gene_rank")
    return order.select("gene", (-F.col("neg")).alias("n"), "gene_rank")


def nuclei_population(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """Molecules per prior nucleus, flagged where suspiciously large."""
    return (
        df.where(F.col("nucleus").isNotNull())
        .groupBy("nucleus")
        .agg(F.sum("n").alias("n"))
        .withColumn("too_large", F.col("n") > F.lit(limit))
    )


def prior_centroids(df: DataFrame) -> DataFrame:
    n = F.col("n")
    return (
        df.where(F.col("cell").isNotNull())
        .groupBy("cell")
        .agg(
            (F.sum(F.col("x") * n) / F.sum(n)).alias("cx"),
            (F.sum(F.col("y") * n) / F.sum(n)).alias("cy"),
        )
    )


def drop_cellfree(df: DataFrame, max_distance: float = 60.0) -> DataFrame:
    """Keep transcripts within ``max_distance`` of some prior cell centroid."""
    return range_semi_join(df, prior_centroids(df), max_distance)


def tilt_coefficients(df: DataFrame) -> DataFrame:
    """Least-squares plane z ~ 1 + x + y, from one pass of sums."""
    s = df.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"),
        F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumns({
        "slope_x": F.coalesce(F.try_divide(F.col("yy") * F.col("xz") - F.col("xy") * F.col("yz"), det), F.lit(0.0)),
        "slope_y": F.coalesce(F.try_divide(F.col("xx") * F.col("yz") - F.col("xy") * F.col("xz"), det), F.lit(0.0)),
    })
    return s.select((F.col("mz") - F.col("slope_x") * F.col("mx") - F.col("slope_y") * F.col("my")).alias("b0"), "slope_x", "slope_y")


def regress_out_tilt(df: DataFrame) -> DataFrame:
    """Replace z by its residual from the fitted plane; constant z is left alone."""
    flat = df.agg(F.min("z").alias("a"), F.max("z").alias("b")).first()
    if flat["a"] == flat["b"]:
        return df
    c = tilt_coefficients(df).first()
    return df.withColumn("z", F.col("z") - F.lit(c["b0"]) - F.lit(c["slope_x"]) * F.col("x") - F.lit(c["slope_y"]) * F.col("y"))


def clip_and_scale_z(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip z to its 1 % and 99 % order statistics (over rows) and scale to [0, 1]."""
    rows = df.where(F.col("z").isNotNull()).count()
    zmin, zmax = order_statistics(df, "z", [int(low * rows), min(rows - 1, int(high * rows))])
    span = zmax - zmin or 1.0
    clipped = F.least(F.greatest(F.col("z"), F.lit(zmin)), F.lit(zmax))
    return df.withColumn("z", (clipped - F.lit(zmin)) / F.lit(span))


def normalize_z(df: DataFrame) -> DataFrame:
    return clip_and_scale_z(regress_out_tilt(df))


def cluster_spatially(df: DataFrame, block: float = 128.0) -> DataFrame:
    """Lay rows out by square blocks before a table that is scanned many times.

    Molecules of a voxel end up side by side, so later aggregations by voxel
    combine before they shuffle. A rebalance, unlike a plain repartition, lets
    adaptive execution split a crowded block and merge sparse ones.
    """
    blocks = [F.floor(F.col(c) / F.lit(block)).cast("bigint").alias(f"_{c}") for c in ("x", "y")]
    return df.select("*", *blocks).hint("rebalance", "_x", "_y").drop("_x", "_y")


def stitch_fovs(df: DataFrame, offsets: DataFrame, pixel_size: float) -> DataFrame:
    """Local pixel positions to global microns: each field of view has its own origin, y points down."""
    return df.join(offsets, "fov_name").withColumns({
        "x": F.col("x") * F.lit(pixel_size) - F.col("x_fov"),
        "y": -(F.col("y") * F.lit(pixel_size)) - F.col("y_fov"),
    })
