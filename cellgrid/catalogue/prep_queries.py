"""Queries on filters, dictionaries, joins and numeric preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrid.catalogue import ctes as C
from cellgrid.catalogue.inputs import canonical, prepared, raw, rounded
from cellgrid.operators import prep
from cellgrid.operators.grid import coordinate_span
from cellgrid.operators.spatial import nearest_center
from cellgrid.sources import fixtures as fx
from cellgrid.sources import visium

COSMX_SCALE = 0.12028
NUCLEUS_LIMIT = 150
MAX_DISTANCE = 5.0


def quality_filter(spark, sf):
    return prep.quality_filter(raw(spark, sf), C.MIN_QV).select("transcript_id", "gene", "qv")


def gene_exclusion_regex(spark, sf):
    return prep.exclude_genes(raw(spark, sf), C.EXCLUDED).select("transcript_id", "gene")


def assign_normalize(spark, sf):
    t = prep.normalize_assignment(raw(spark, sf), "cell_id", "UNASSIGNED", "overlaps_nucleus", "1", fov="fov_name")
    return t.select("transcript_id", "cell", "nucleus")


def scale_coords(spark, sf):
    t = canonical(spark, sf)
    return rounded(prep.scale_coordinates(t, COSMX_SCALE).select("transcript_id", "x", "y", "z"), "x", "y")


def expressed_genes(spark, sf):
    return prep.expressed_genes(prep.exclude_genes(fx.bin_counts(spark, sf), "^g1"))


def nuclei_population(spark, sf):
    return prep.nuclei_population(canonical(spark, sf), NUCLEUS_LIMIT)


def gene_dictionary(spark, sf):
    return prep.gene_dictionary(canonical(spark, sf))


def fov_dictionary(spark, sf):
    return prep.fov_dictionary(canonical(spark, sf))


def cell_dictionary_by_fov(spark, sf):
    return prep.cell_dictionary(canonical(spark, sf), ["fov", "cell"])


def unfactored_gene_order(spark, sf):
    return prep.unfactored_gene_order(canonical(spark, sf))


def barcode_position_join(spark, sf):
    pos = visium.place_barcodes(fx.barcode_positions(spark, sf), 0.5)
    return visium.place_counts(fx.bin_counts(spark, sf), pos).select("gene", "x", "y", "z", "n")


def cell_centroids_prior(spark, sf):
    return rounded(prep.prior_centroids(canonical(spark, sf)), "cx", "cy")


def cellfree_filter(spark, sf):
    return prep.drop_cellfree(canonical(spark, sf), MAX_DISTANCE).select("transcript_id", "x", "y")


def tilt_coefficients(spark, sf):
    return rounded(prep.tilt_coefficients(canonical(spark, sf)), "b0", "slope_x", "slope_y")


def tilt_residuals(spark, sf):
    return rounded(prep.regress_out_tilt(canonical(spark, sf)).select("transcript_id", "x", "y", "z"), "z")


def z_quantile_clip(spark, sf):
    return rounded(prepared(spark, sf)[0].select("transcript_id", "x", "y", "z"), "z")


def span(spark, sf):
    return rounded(coordinate_span(canonical(spark, sf)), "z_mean")


def fov_stitch(spark, sf):
    t = prep.stitch_fovs(
        raw(spark, sf).select("transcript_id", F.col("fov_name"), F.col("x_location").alias("x"), F.col("y_location").alias("y")),
        fx.fov_offsets(spark, sf), COSMX_SCALE,
    )
    return rounded(t.select("transcript_id", "fov_name", "x", "y"), "x", "y")


def nearest_centroid(spark, sf):
    t = canonical(spark, sf)
    centers = prep.prior_centroids(t).select("cell", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))
    points = t.select(F.struct("x", "y").alias("at"), "x", "y").distinct()
    near = nearest_center(points, centers, "at", size=12.0)
    return rounded(near.select("at.x", "at.y", "distance2", "nearest"), "distance2")


QUERIES = {
    "quality_filter": quality_filter,
    "gene_exclusion_regex": gene_exclusion_regex,
    "assign_normalize": assign_normalize,
    "scale_coords": scale_coords,
    "expressed_genes": expressed_genes,
    "nuclei_population": nuclei_population,
    "gene_dictionary": gene_dictionary,
    "fov_dictionary": fov_dictionary,
    "cell_dictionary_by_fov": cell_dictionary_by_fov,
    "unfactored_gene_order": unfactored_gene_order,
    "barcode_position_join": barcode_position_join,
    "cell_centroids_prior": cell_centroids_prior,
    "cellfree_filter": cellfree_filter,
    "tilt_coefficients": tilt_coefficients,
    "tilt_residuals": tilt_residuals,
    "z_quantile_clip": z_quantile_clip,
    "coordinate_span": span,
    "fov_stitch": fov_stitch,
    "nearest_centroid": nearest_centroid,
}


def sql() -> dict[str, str]:
    C.define("tiltc", """
SELECT mz - slope_x * mx - slope_y * my AS b0, slope_x, slope_y FROM (
  SELECT mx, my, mz, (yy * xz - xy * yz) / (xx * yy - xy * xy) AS slope_x, (xx * yz - xy * xz) / (xx * yy - xy * xy) AS slope_y FROM (
    SELECT AVG(x) AS mx, AVG(y) AS my, AVG(z) AS mz, VAR_POP(x) AS xx, VAR_POP(y) AS yy, COVAR_POP(x, y) AS xy,
      COVAR_POP(x, z) AS xz, COVAR_POP(y, z) AS yz FROM tx) s) b""")
    C.define("rcent", "SELECT cell, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy FROM prior_centroids")
    fov_key = "CONCAT(CAST(LENGTH(fov_name) AS VARCHAR), ':', fov_name, ':', cell_id)"
    q = {
        "quality_filter": f"SELECT transcript_id, gene, qv FROM fx_transcripts WHERE NOT qv < {C.MIN_QV}",
        "gene_exclusion_regex": f"SELECT transcript_id, gene FROM fx_transcripts WHERE NOT regexp_matches(gene, '{C.EXCLUDED}')",
        "assign_normalize": f"""SELECT transcript_id, CASE WHEN cell_id <> 'UNASSIGNED' THEN {fov_key} END AS cell,
  CASE WHEN cell_id <> 'UNASSIGNED' AND overlaps_nucleus = '1' THEN {fov_key} END AS nucleus FROM fx_transcripts""",
        "scale_coords": f"""SELECT transcript_id, ROUND(x * CAST({COSMX_SCALE} AS DOUBLE), 6) AS x,
  ROUND(y * CAST({COSMX_SCALE} AS DOUBLE), 6) AS y, z FROM tx""",
        "expressed_genes": """SELECT gene, DENSE_RANK() OVER (ORDER BY gene) - 1 AS gene_id FROM (
  SELECT DISTINCT gene FROM fx_bin_counts WHERE NOT regexp_matches(gene, '^g1') AND n > 0) t""",
        "nuclei_population": f"""SELECT nucleus, CAST(SUM(n) AS BIGINT) AS n, SUM(n) > {NUCLEUS_LIMIT} AS too_large
FROM tx WHERE nucleus IS NOT NULL GROUP BY nucleus""",
        "gene_dictionary": "SELECT gene, DENSE_RANK() OVER (ORDER BY gene) - 1 AS gene_id FROM (SELECT DISTINCT gene FROM tx) t",
        "fov_dictionary": "SELECT fov, DENSE_RANK() OVER (ORDER BY fov) - 1 AS fov_id FROM (SELECT DISTINCT fov FROM tx) t",
        "cell_dictionary_by_fov": """SELECT fov, cell, DENSE_RANK() OVER (ORDER BY fov, cell) - 1 AS cell_index
FROM (SELECT DISTINCT fov, cell FROM tx WHERE cell IS NOT NULL) t""",
        "unfactored_gene_order": """SELECT gene, CAST(n AS BIGINT) AS n, ROW_NUMBER() OVER (ORDER BY n DESC, gene) - 1 AS gene_rank
FROM (SELECT gene, SUM(n) AS n FROM tx GROUP BY gene) t""",
        "barcode_position_join": """SELECT gene, pxl_row_in_fullres * CAST(0.5 AS DOUBLE) AS x, pxl_col_in_fullres * CAST(0.5 AS DOUBLE) AS y,
  CAST(0 AS DOUBLE) AS z, n FROM fx_bin_counts c JOIN fx_barcode_positions p ON c.barcode = p.barcode""",
        "cell_centroids_prior": "SELECT cell, ROUND(cx, 6) AS cx, ROUND(cy, 6) AS cy FROM prior_centroids",
        "cellfree_filter": f"""SELECT transcript_id, x, y FROM tx t WHERE EXISTS (SELECT 1 FROM prior_centroids c
  WHERE (t.x - c.cx) * (t.x - c.cx) + (t.y - c.cy) * (t.y - c.cy) <= {MAX_DISTANCE**2})""",
        "tilt_coefficients": "SELECT ROUND(b0, 6) AS b0, ROUND(slope_x, 6) AS slope_x, ROUND(slope_y, 6) AS slope_y FROM tiltc",
        "tilt_residuals": "SELECT transcript_id, x, y, ROUND(z - b0 - slope_x * x - slope_y * y, 6) AS z FROM tx, tiltc",
        "z_quantile_clip": "SELECT transcript_id, x, y, ROUND(z, 6) AS z FROM prep",
        "coordinate_span": """SELECT MIN(x) AS x_min, MAX(x) AS x_max, MIN(y) AS y_min, MAX(y) AS y_max, MIN(z) AS z_min, MAX(z) AS z_max,
  ROUND(SUM(z * n) / SUM(n), 6) AS z_mean FROM tx""",
        "fov_stitch": f"""SELECT transcript_id, t.fov_name, ROUND(x_location * CAST({COSMX_SCALE} AS DOUBLE) - x_fov, 6) AS x,
  ROUND(-(y_location * CAST({COSMX_SCALE} AS DOUBLE)) - y_fov, 6) AS y
FROM fx_transcripts t JOIN fx_fov_offsets o ON t.fov_name = o.fov_name""",
        "nearest_centroid": """SELECT x, y, ROUND(d2, 6) AS distance2, cell AS nearest FROM (
  SELECT x, y, cell, d2, ROW_NUMBER() OVER (PARTITION BY x, y ORDER BY d2, cell) AS rn FROM (
    SELECT x, y, cell, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2
    FROM (SELECT DISTINCT x, y FROM tx) p CROSS JOIN rcent) d) r WHERE rn = 1""",
    }
    return {k: C.build(v) for k, v in q.items()}
