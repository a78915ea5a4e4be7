"""Queries on volumes, counts, outlines and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrid.catalogue import ctes as C
from cellgrid.catalogue.inputs import binned, canonical, counts, keyed_states, labelled, rounded, states, voxelized
from cellgrid.functions import scalar
from cellgrid.functions.offsets import MOORE_2D
from cellgrid.operators import density, initial, measures, outline, results
from cellgrid.operators.grid import VOXEL
from cellgrid.operators.spatial import bounding_box
from cellgrid.session import materialize
from cellgrid.sinks import baysor, matrix
from cellgrid.sources import fixtures as fx

LEVELS = 7  # line numbers, used as sample indices


def layer_volume_surface(spark, sf):
    s, grid = states(spark, sf)
    return measures.layer_volume_surface(s, grid)


def cell_volume_surface(spark, sf):
    return measures.volume_surface(layer_volume_surface(spark, sf))


def compactness(spark, sf):
    per_layer = layer_volume_surface(spark, sf)
    iiq = scalar.inverse_isoperimetric_quotient(F.col("surface"), F.col("volume"))
    out = per_layer.withColumn("iiq", iiq).withColumn("logp", scalar.halfnormal_logpdf(0.04, F.col("iiq")))
    return rounded(out, "iiq", "logp")


def cell_centroids(spark, sf):
    s, grid = states(spark, sf)
    return rounded(measures.centroids(s, grid), "centroid_x", "centroid_y", "centroid_z")


def cell_gene_counts(spark, sf):
    """Counted from the voxels up, so the join with the states is part of the query."""
    c, _ = counts(spark, sf)
    return measures.cell_gene_counts(measures.label_counts(density.attach_origin(c, binned(spark, sf)), states(spark, sf)[0]))


def unassigned_counts(spark, sf):
    return measures.unassigned_counts(labelled(spark, sf)[0])


def gene_totals(spark, sf):
    return measures.gene_totals(canonical(spark, sf))


def _samples(spark, sf):
    """Counts of seven pseudo-samples: one per original depth level."""
    t = canonical(spark, sf).where("cell IS NOT NULL")
    return t.groupBy("cell", "gene", F.col("z").cast("bigint").alias("sample")).agg(F.sum("n").alias("n"))


def running_mean_counts(spark, sf):
    return rounded(measures.running_mean(_samples(spark, sf), ["cell", "gene"], LEVELS), "mean")


def _moves(spark, sf):
    """Every count entry with at least two molecules sends one of them one voxel along i."""
    lab, _ = labelled(spark, sf)
    s, _ = states(spark, sf)
    out = lab.where("n >= 2").withColumn("n", F.lit(1).cast("bigint")).withColumnRenamed("cell", "from_cell")
    target = s.select((F.col("i") - 1).alias("i"), "j", "k", F.col("cell").alias("to_cell"))
    return out.join(target, VOXEL, "left")


def transition_matrix(spark, sf):
    return measures.transitions(_moves(spark, sf))


def _deltas(moves):
    leave = moves.withColumn("n", -F.col("n"))
    arrive = moves.withColumns({"i": F.col("i") + 1, "di": F.col("di") + 1})
    return leave.unionByName(arrive)


def _merged(spark, sf):
    return measures.merge_deltas(labelled(spark, sf)[0], _deltas(_moves(spark, sf)))


def merge_deltas(spark, sf):
    return _merged(spark, sf)


def transcript_metadata(spark, sf):
    """Observed transcripts matched to moved counts, half of each (cell, gene) foreground; summed per origin."""
    v, grid = voxelized(spark, sf)
    s, _ = states(spark, sf)
    lab = materialize(measures.label_counts(_merged(spark, sf), s), "labelled")
    half = lab.where("cell IS NOT NULL").groupBy("cell", "gene").agg(F.floor(F.sum("n") / 2).cast("bigint").alias("n_fg"))
    meta = results.transcript_metadata(v, results.split_foreground(lab, half), grid)
    moved = ((F.col("x") - F.col("observed_x")) / F.lit(grid.voxel_size))
    return meta.select(
        grid.i(F.col("observed_x")).alias("i"), grid.j(F.col("observed_y")).alias("j"), grid.k(F.col("observed_z")).alias("k"),
        "gene", F.round(moved).cast("bigint").alias("di"), "assignment", "n",
    ).groupBy("i", "j", "k", "gene", "di", "assignment").agg(F.sum("n").alias("n"))


def transcript_metadata_init(spark, sf):
    """Before any move: each transcript keeps its place and takes its voxel's cell."""
    v, _ = voxelized(spark, sf)
    s, _ = states(spark, sf)
    return v.drop("cell").join(s.select(*VOXEL, "cell"), VOXEL, "left").select(
        "transcript_id", "x", "y", "gene", F.col("cell").alias("assignment"), F.col("cell").isNull().alias("background")
    )


def baysor_export(spark, sf):
    v, _ = voxelized(spark, sf)
    s, _ = states(spark, sf)
    t = v.drop("cell").join(s.select(*VOXEL, "cell"), VOXEL, "left").select(
        "transcript_id", "x", "y", "z", F.col("cell").alias("assignment"), F.col("cell").isNull().alias("background")
    )
    return rounded(baysor.transcript_table(t), "z")


def consensus_vote(spark, sf):
    lab, _ = labelled(spark, sf)
    return results.consensus_votes(states(spark, sf)[0], lab)


def boundary_edges(spark, sf):
    s, _ = states(spark, sf)
    return outline.boundary_edges(s.where("cell IS NOT NULL")).select("cell", "k", "pi", "pj", F.col("dir").cast("bigint").alias("dir"))


def polygon_rings(spark, sf):
    """Signed ring areas and edge totals per (cell, layer)."""
    s, _ = states(spark, sf)
    ranked = outline.rank_rings(outline.link_edges(outline.boundary_edges(s.where("cell IS NOT NULL"))))
    return outline.ring_area(ranked).groupBy("cell", "k").agg(
        F.sum("area").alias("area"), F.sum("edges").alias("edges")
    )


def consensus_polygons(spark, sf):
    """Consensus outlines with their area."""
    lab, grid = labelled(spark, sf)
    p = results.consensus_polygons(states(spark, sf)[0], lab, grid)
    area = F.aggregate(F.transform("rings", outline.shoelace), F.lit(0.0), lambda a, b: a + b)
    return p.select("cell", F.size("rings").alias("parts"), F.round(area, 6).alias("area"))


def cell_metadata(spark, sf):
    keyed, grid = keyed_states(spark, sf)
    index = initial.used_cells(keyed)
    s = initial.recode_cells(keyed, index)
    shapes = measures.volume_surface(measures.layer_volume_surface(s, grid))
    cells = index.select(
        F.col("cell_id").alias("cell"), F.col("cell").alias("original_cell_id"), F.lit(0).alias("cluster"), F.lit(1.0).alias("scale")
    )
    out = results.cell_metadata(s, shapes, grid, cells)
    return rounded(out, "centroid_x", "centroid_y", "centroid_z", "volume")


def gene_metadata(spark, sf):
    """Gene table with posterior-mean background rates of the initial state."""
    from cellgrid.plans import expectations as X

    lab, grid = labelled(spark, sf)
    rates = X.background_rate_mean(measures.unassigned_counts(lab), X.full_index(lab, C.LAYERS, C.BINS), X.volumes(binned(spark, sf), grid))
    expected = measures.running_mean(_samples(spark, sf), ["cell", "gene"], LEVELS)
    out = results.gene_metadata(canonical(spark, sf), expected, rates, C.LAYERS, C.BINS)
    lams = [c for c in out.columns if c.startswith("lambda")]
    return rounded(out, "expected_assigned_count", *lams)


def mtx_triplets(spark, sf):
    lab, _ = labelled(spark, sf)
    counts = measures.cell_gene_counts(lab).groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    from cellgrid.operators.prep import gene_dictionary

    return matrix.triplets(counts, gene_dictionary(canonical(spark, sf)))


def ring_areas(spark, sf):
    """Outlines given as vertex rows, with their enclosed area."""
    rings = outline.rings_from_vertices(fx.polygon_vertices(spark, sf))
    return rings.select("cell_id", F.size("ring").cast("bigint").alias("vertices"), F.round(outline.shoelace(F.col("ring")), 6).alias("area"))


def mask_tiles(spark, sf):
    """Mask labels made unique over 16-pixel tiles."""
    p = initial.relabel_tiles(fx.mask_pixels(spark, sf).select("row_px", "col_px", "mask_id"), 16)
    return p.select("row_px", "col_px", F.col("mask_id").cast("bigint").alias("mask_id"))


def bounding_box_query(spark, sf):
    return bounding_box(canonical(spark, sf), (10.0, 20.0), (60.0, 50.0)).select("transcript_id", "gene", "x", "y")


def voxel_transcript_counts_by_cell(spark, sf):
    s, _ = states(spark, sf)
    return results.voxel_totals(s, labelled(spark, sf)[0])


QUERIES = {
    "layer_volume_surface": layer_volume_surface,
    "cell_volume_surface": cell_volume_surface,
    "compactness": compactness,
    "cell_centroids": cell_centroids,
    "cell_gene_counts": cell_gene_counts,
    "unassigned_counts": unassigned_counts,
    "gene_totals": gene_totals,
    "running_mean_counts": running_mean_counts,
    "transition_matrix": transition_matrix,
    "merge_deltas": merge_deltas,
    "transcript_metadata_init": transcript_metadata_init,
    "transcript_metadata": transcript_metadata,
    "baysor_export": baysor_export,
    "consensus_vote": consensus_vote,
    "voxel_totals": voxel_transcript_counts_by_cell,
    "boundary_edges": boundary_edges,
    "polygon_rings": polygon_rings,
    "consensus_polygons": consensus_polygons,
    "cell_metadata": cell_metadata,
    "gene_metadata": gene_metadata,
    "mtx_triplets": mtx_triplets,
    "ring_areas": ring_areas,
    "mask_tiles": mask_tiles,
    "bounding_box": bounding_box_query,
}


def sql() -> dict[str, str]:
    from cellgrid.catalogue import voxel_queries

    voxel_queries.sql()  # density expressions
    vs, nl = C.VOXEL_SIZE, C.LAYERS
    C.define("o8", C.values(MOORE_2D))
    C.define("layershape", """
SELECT a.cell, a.k, COUNT(DISTINCT a.i * 1000000 + a.j) AS volume,
  CAST(SUM(CASE WHEN b.cell IS DISTINCT FROM a.cell THEN 1 ELSE 0 END) AS BIGINT) AS surface
FROM occ a CROSS JOIN o8 o LEFT JOIN occ b ON b.i = a.i + o.di AND b.j = a.j + o.dj AND b.k = a.k GROUP BY a.cell, a.k""")
    C.define("lab", """
SELECT c.i, c.j, c.k, c.gene, c.k AS k0, COALESCE(d.bin, 0) AS density, c.n, s.cell
FROM counts c LEFT JOIN dbin d ON c.i = d.i AND c.j = d.j LEFT JOIN states s ON c.i = s.i AND c.j = s.j AND c.k = s.k""")
    C.define("samples", "SELECT cell, gene, CAST(z AS BIGINT) AS sample, SUM(n) AS n FROM tx WHERE cell IS NOT NULL GROUP BY cell, gene, CAST(z AS BIGINT)")
    C.define("moves", """
SELECT l.i, l.j, l.k, l.gene, l.k0, l.density, l.cell AS from_cell, s.cell AS to_cell, 1 AS n
FROM lab l LEFT JOIN states s ON s.i = l.i + 1 AND s.j = l.j AND s.k = l.k WHERE l.n >= 2""")
    C.define("merged", """
SELECT i, j, k, gene, k0, density, di, 0 AS dj, 0 AS dk, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT i, j, k, gene, k0, density, 0 AS di, n FROM lab
  UNION ALL SELECT i, j, k, gene, k0, density, 0, -n FROM moves
  UNION ALL SELECT i + 1, j, k, gene, k0, density, 1, n FROM moves) u
GROUP BY i, j, k, gene, k0, density, di HAVING SUM(n) <> 0""")
    C.define("mlab", "SELECT m.*, s.cell FROM merged m LEFT JOIN states s ON m.i = s.i AND m.j = s.j AND m.k = s.k")
    C.define("msplit", """
SELECT i, j, k, gene, di, cell, n, CASE WHEN cell IS NULL THEN 0
  ELSE GREATEST(0, LEAST(n, FLOOR(CAST(total AS DOUBLE) / 2) - before)) END AS fg FROM (
  SELECT *, SUM(n) OVER (PARTITION BY cell, gene) AS total,
    COALESCE(SUM(n) OVER (PARTITION BY cell, gene ORDER BY i, j, k, di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM mlab) t""")
    C.define("totals", "SELECT o.i, o.j, o.k, o.cell, CAST(COALESCE(SUM(c.n), 0) AS BIGINT) AS n FROM occ o LEFT JOIN counts c ON o.i = c.i AND o.j = c.j AND o.k = c.k GROUP BY o.i, o.j, o.k, o.cell")
    C.define("conwin", """
SELECT i, j, cell FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY n DESC, cell) AS rn
  FROM (SELECT i, j, cell, SUM(n) AS n FROM totals GROUP BY i, j, cell) v) t WHERE rn = 1""")
    C.define("consensus", """
SELECT i, j, cell FROM conwin UNION ALL
SELECT i, j, cell FROM (SELECT i, j, cell, ROW_NUMBER() OVER (PARTITION BY cell ORDER BY n DESC, i, j) AS rn FROM totals
  WHERE cell NOT IN (SELECT cell FROM conwin)) t WHERE rn = 1""")
    C.define("iqq", f"""SELECT *, CASE WHEN volume = 0 THEN 0 ELSE LN(GREATEST(CAST(1 AS DOUBLE), CAST(surface AS DOUBLE) * surface
  / (CAST({scalar.ISOPERIMETRIC!r} AS DOUBLE) * volume))) END AS iiq FROM layershape""")
    C.define("outside", """
SELECT a.cell, a.k, a.i + CASE WHEN dir IN (1, 2) THEN 1 ELSE 0 END AS pi, a.j + CASE WHEN dir IN (2, 3) THEN 1 ELSE 0 END AS pj, CAST(dir AS BIGINT) AS dir
FROM occ a CROSS JOIN (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) d(dir, ni, nj)
LEFT JOIN occ b ON b.i = a.i + d.ni AND b.j = a.j + d.nj AND b.k = a.k WHERE a.cell IS DISTINCT FROM b.cell""")
    C.define("bgn", "SELECT gene, k0, density, SUM(n) AS n FROM lab WHERE cell IS NULL GROUP BY gene, k0, density")
    C.define("rvol", f"SELECT bin, COUNT(*) * CAST({vs * vs / nl} AS DOUBLE) AS volume FROM dbin GROUP BY bin")
    C.define("bgrate", f"""
SELECT g.gene, l.k0, d.density, (1 + COALESCE(b.n, 0)) / (1 + COALESCE(v.volume, 0)) AS rate
FROM (SELECT DISTINCT gene FROM lab) g CROSS JOIN (SELECT UNNEST(RANGE(0, {nl})) AS k0) l
CROSS JOIN (SELECT UNNEST(RANGE(0, {C.BINS})) AS density) d
LEFT JOIN bgn b ON b.gene = g.gene AND b.k0 = l.k0 AND b.density = d.density LEFT JOIN rvol v ON v.bin = d.density""")
    lams = ", ".join(
        f"ROUND(MAX(CASE WHEN density = {d} AND k0 = {k} THEN rate END), 6) AS lambda_bg_{d}_{k}" for d in range(C.BINS) for k in range(nl)
    )
    cx = f"(i + CAST(0.5 AS DOUBLE)) * {vs} + xmin"
    cy = f"(j + CAST(0.5 AS DOUBLE)) * {vs} + ymin"
    cz = f"(k + CAST(0.5 AS DOUBLE)) * CAST({1 / nl} AS DOUBLE) + zmin"
    q = {
        "layer_volume_surface": "SELECT * FROM layershape",
        "cell_volume_surface": "SELECT cell, CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(surface) AS BIGINT) AS surface FROM layershape GROUP BY cell",
        "compactness": """SELECT cell, k, volume, surface, ROUND(iiq, 6) AS iiq,
  ROUND(-LN(SQRT(2 * PI())) - LN(CAST(0.04 AS DOUBLE)) - iiq * iiq / (2 * CAST(0.04 AS DOUBLE) * CAST(0.04 AS DOUBLE)), 6) AS logp FROM iqq""",
        "cell_centroids": f"""SELECT cell, ROUND(AVG({cx}), 6) AS centroid_x, ROUND(AVG({cy}), 6) AS centroid_y,
  ROUND(AVG({cz}), 6) AS centroid_z, COUNT(*) AS volume FROM occ, origin GROUP BY cell""",
        "cell_gene_counts": "SELECT cell, gene, k0, density, CAST(SUM(n) AS BIGINT) AS n FROM lab WHERE cell IS NOT NULL GROUP BY cell, gene, k0, density",
        "unassigned_counts": "SELECT gene, k0, density, CAST(n AS BIGINT) AS n FROM bgn",
        "gene_totals": "SELECT gene, CAST(SUM(n) AS BIGINT) AS total_count FROM tx GROUP BY gene",
        "running_mean_counts": f"SELECT cell, gene, ROUND(SUM(n) / CAST({LEVELS} AS DOUBLE), 6) AS mean FROM samples GROUP BY cell, gene",
        "transition_matrix": """SELECT from_cell, to_cell, CAST(SUM(n) AS BIGINT) AS n FROM moves
WHERE from_cell IS NOT NULL AND to_cell IS NOT NULL GROUP BY from_cell, to_cell""",
        "merge_deltas": "SELECT * FROM merged",
        "transcript_metadata_init": """SELECT transcript_id, x, y, gene, s.cell AS assignment, s.cell IS NULL AS background
FROM vox v LEFT JOIN states s ON v.i = s.i AND v.j = s.j AND v.k = s.k""",
        "transcript_metadata": """SELECT i, j, k, gene, di, assignment, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT i - di AS i, j, k, gene, di, cell AS assignment, fg AS n FROM msplit
  UNION ALL SELECT i - di, j, k, gene, di, NULL, n - fg FROM msplit) t WHERE n > 0 GROUP BY i, j, k, gene, di, assignment""",
        "baysor_export": """SELECT transcript_id, CASE WHEN s.cell IS NULL THEN '' ELSE CONCAT('cell-', CAST(s.cell AS VARCHAR)) END AS cell,
  s.cell IS NULL AS is_noise, x, y, ROUND(z, 6) AS z FROM vox v LEFT JOIN states s ON v.i = s.i AND v.j = s.j AND v.k = s.k""",
        "consensus_vote": "SELECT i, j, cell FROM consensus",
        "voxel_totals": "SELECT i, j, k, cell, n FROM totals",
        "boundary_edges": "SELECT cell, k, pi, pj, dir FROM outside",
        "polygon_rings": """SELECT v.cell, v.k, v.area, e.edges FROM (SELECT cell, k, CAST(COUNT(*) AS DOUBLE) AS area FROM occ GROUP BY cell, k) v
JOIN (SELECT cell, k, COUNT(*) AS edges FROM outside GROUP BY cell, k) e ON v.cell = e.cell AND v.k = e.k""",
        "cell_metadata": f"""SELECT o.cell, u.cell AS original_cell_id, centroid_x, centroid_y, centroid_z, 0 AS cluster,
  ROUND(s.volume * CAST({vs * vs / nl} AS DOUBLE), 6) AS volume, s.surface AS surface_area, CAST(1 AS DOUBLE) AS scale
FROM (SELECT cell, ROUND(AVG({cx}), 6) AS centroid_x, ROUND(AVG({cy}), 6) AS centroid_y, ROUND(AVG({cz}), 6) AS centroid_z
  FROM occ, origin GROUP BY cell) o
JOIN used u ON u.cell_id = o.cell
JOIN (SELECT cell, CAST(SUM(volume) AS BIGINT) AS volume, CAST(SUM(surface) AS BIGINT) AS surface FROM layershape GROUP BY cell) s ON s.cell = o.cell""",
        "gene_metadata": f"""SELECT t.gene, t.total_count, ROUND(COALESCE(e.expected, 0), 6) AS expected_assigned_count, r.* EXCLUDE (rgene)
FROM (SELECT gene, CAST(SUM(n) AS BIGINT) AS total_count FROM tx GROUP BY gene) t
LEFT JOIN (SELECT gene, SUM(n) / CAST({LEVELS} AS DOUBLE) AS expected FROM samples GROUP BY gene) e ON t.gene = e.gene
LEFT JOIN (SELECT gene AS rgene, {lams} FROM bgrate GROUP BY gene) r ON r.rgene = t.gene""",
        "ring_areas": """SELECT a.cell_id, COUNT(*) + 1 AS vertices, ROUND(ABS(SUM(a.x * b.y - b.x * a.y)) / 2, 6) AS area
FROM fx_polygon_vertices a JOIN fx_polygon_vertices b ON a.polygon = b.polygon AND a.vertex + 1 = b.vertex GROUP BY a.cell_id""",
        "mask_tiles": """SELECT row_px, col_px, CAST(mask_id + start AS BIGINT) AS mask_id FROM fx_mask_pixels m JOIN (
  SELECT tr, tc, COALESCE(SUM(top) OVER (ORDER BY tr, tc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (
    SELECT FLOOR(row_px / CAST(16 AS DOUBLE)) AS tr, FLOOR(col_px / CAST(16 AS DOUBLE)) AS tc, MAX(mask_id) AS top
    FROM fx_mask_pixels GROUP BY FLOOR(row_px / CAST(16 AS DOUBLE)), FLOOR(col_px / CAST(16 AS DOUBLE))) g) t
  ON t.tr = FLOOR(row_px / CAST(16 AS DOUBLE)) AND t.tc = FLOOR(col_px / CAST(16 AS DOUBLE))""",
        "bounding_box": "SELECT transcript_id, gene, x, y FROM tx WHERE x BETWEEN 10 AND 60 AND y BETWEEN 20 AND 50",
        "mtx_triplets": """SELECT cell + 1 AS row, gene_id + 1 AS col, CAST(SUM(n) AS BIGINT) AS value FROM lab l
JOIN (SELECT gene, DENSE_RANK() OVER (ORDER BY gene) - 1 AS gene_id FROM (SELECT DISTINCT gene FROM tx) t) g ON l.gene = g.gene
WHERE cell IS NOT NULL GROUP BY cell, gene_id""",
    }
    return {k: C.build(v) for k, v in q.items()}
