"""Queries on voxel votes, initial states, expansion, density and halos."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgrid.catalogue import ctes as C
from cellgrid.catalogue.inputs import binned, compute_states, counts, keyed_states, prepared, rounded, states, voxelized
from cellgrid.functions.offsets import VERTICAL, VON_NEUMANN, VON_NEUMANN_XY, diamond
from cellgrid.operators import density, initial
from cellgrid.operators import grid as G
from cellgrid.operators.grid import Grid
from cellgrid.sources import fixtures as fx
from cellgrid.sources import visium

MASK_X = (0.5, 0.1, 3.0)
MASK_Y = (-0.05, 0.5, 4.0)
MASK_GRID = Grid(0.0, 0.0, 0.0, 2.0, 1)
BARCODE_GRID = Grid(0.0, 0.0, 0.0, 3.0, 1)
LOGS = ("log_prior", "log_1m_prior")


def voxelize(spark, sf):
    return voxelized(spark, sf)[0].select("transcript_id", "x", "y", "i", "j", "k")


def voxel_counts(spark, sf):
    return counts(spark, sf)[0]


def prior_votes(spark, sf):
    return initial.prior_votes(voxelized(spark, sf)[0])


def nucleus_vote_winner(spark, sf):
    votes = initial.prior_votes(voxelized(spark, sf)[0]).where("n_nucleus > 0")
    return initial.vote_winners(votes, G.VOXEL, "n_nucleus")


def cell_vote_prior(spark, sf):
    return rounded(keyed_states(spark, sf)[0].where("cell IS NULL").drop("cell"), *LOGS)


def used_cells(spark, sf):
    return initial.used_cells(keyed_states(spark, sf)[0])


def initial_states(spark, sf):
    s = compute_states(spark, sf)
    return rounded(initial.recode_cells(s, initial.used_cells(s)), *LOGS)


def barcode_states(spark, sf):
    placed = visium.place_barcodes(fx.barcode_positions(spark, sf), 0.5)
    return rounded(initial.states_from_barcodes(fx.barcode_mappings(spark, sf), placed, BARCODE_GRID, 0.0), *LOGS)


def _mask_votes(spark, sf):
    return initial.mask_votes(fx.mask_pixels(spark, sf), MASK_GRID, MASK_X, MASK_Y, 0)


def mask_pixel_votes(spark, sf):
    return rounded(_mask_votes(spark, sf), "weight")


def mask_states(spark, sf):
    s = initial.states_from_masks(_mask_votes(spark, sf), MASK_GRID, MASK_X, MASK_Y)
    return rounded(s, *LOGS)


def polygon_rasterize(spark, sf):
    return initial.rasterize_polygons(fx.polygon_vertices(spark, sf), prepared(spark, sf)[1])


def polygon_states(spark, sf):
    return rounded(initial.states_from_polygons(fx.polygon_vertices(spark, sf), prepared(spark, sf)[1]), *LOGS)


def expand_cells_once(spark, sf):
    s, grid = states(spark, sf)
    return initial.expand_cells(s, grid).select("i", "j", "k", "cell", "prior_cell")


def expand_vertical(spark, sf):
    s, grid = states(spark, sf)
    return initial.expand_vertically(s, grid).select("i", "j", "k", "cell")


def pop_bubbles(spark, sf):
    s, grid = states(spark, sf)
    return initial.pop_bubbles(s, grid).select("i", "j", "k", "cell", "prior_cell")


def mismatch_edges(spark, sf):
    s, grid = states(spark, sf)
    return initial.mismatch_edges(s, grid)


def halo_rows(spark, sf):
    s, grid = states(spark, sf)
    return G.halo_rows(s, grid)


def upsample_states(spark, sf):
    return initial.upsample(states(spark, sf)[0], 2).select("i", "j", "k", "cell", "prior_cell")


def density_kde(spark, sf):
    v, grid = voxelized(spark, sf)
    return rounded(density.local_density(v, grid, C.BANDWIDTH), "density")


def density_bins(spark, sf):
    return binned(spark, sf)


def region_volume(spark, sf):
    return rounded(density.region_volume(binned(spark, sf), prepared(spark, sf)[1]), "volume")


def gene_voxel_dump(spark, sf):
    """Count dump with voxel centres and offsets, at the start of a run."""
    c, grid = counts(spark, sf)
    zero = F.lit(0).cast("bigint")
    return rounded(c.select(
        "gene", F.col("n").alias("count"), grid.center_x(F.col("i")).alias("x"), grid.center_y(F.col("j")).alias("y"),
        grid.center_z(F.col("k")).alias("z"), zero.alias("dx"), zero.alias("dy"), zero.alias("dz"),
    ), "x", "y", "z")


QUERIES = {
    "voxelize": voxelize,
    "voxel_counts": voxel_counts,
    "prior_votes": prior_votes,
    "nucleus_vote_winner": nucleus_vote_winner,
    "cell_vote_prior": cell_vote_prior,
    "used_cells": used_cells,
    "initial_states": initial_states,
    "barcode_states": barcode_states,
    "mask_pixel_votes": mask_pixel_votes,
    "mask_states": mask_states,
    "polygon_rasterize": polygon_rasterize,
    "polygon_states": polygon_states,
    "expand_cells_once": expand_cells_once,
    "expand_vertical": expand_vertical,
    "pop_bubbles": pop_bubbles,
    "mismatch_edges": mismatch_edges,
    "halo_rows": halo_rows,
    "upsample_states": upsample_states,
    "density_kde": density_kde,
    "density_bins": density_bins,
    "region_volume": region_volume,
    "voxel_counts_dump": gene_voxel_dump,
}


def _claims(name: str, source: str, offsets: str, where: str) -> None:
    """One growth round: free voxels next to a cell, lowest claimant first."""
    C.define(f"{name}_claim", f"""
SELECT s.i + o.di AS i, s.j + o.dj AS j, s.k + o.dk AS k, MIN(s.cell) AS cell
FROM {source} s CROSS JOIN {offsets} o
WHERE s.cell IS NOT NULL AND s.i + o.di >= 0 AND s.j + o.dj >= 0 AND s.k + o.dk BETWEEN 0 AND {C.LAYERS - 1} AND {where}
GROUP BY s.i + o.di, s.j + o.dj, s.k + o.dk""")
    C.define(name, f"""
SELECT COALESCE(s.i, c.i) AS i, COALESCE(s.j, c.j) AS j, COALESCE(s.k, c.k) AS k,
  COALESCE(s.cell, c.cell) AS cell, s.prior_cell
FROM {source} s FULL JOIN {name}_claim c ON s.i = c.i AND s.j = c.j AND s.k = c.k""")


def sql() -> dict[str, str]:
    vs, q = C.VOXEL_SIZE, C.QUAD
    C.define("o6", C.values(VON_NEUMANN))
    C.define("o4", C.values(VON_NEUMANN_XY))
    C.define("oz", C.values(VERTICAL))
    C.define("o25", C.values(diamond(3)))

    def quad(c):
        return f"FLOOR(CAST({c} AS DOUBLE) / {q})"

    same_quad = f"{quad('s.i')} = {quad('s.i + o.di')} AND {quad('s.j')} = {quad('s.j + o.dj')}"
    C.define("st", "SELECT i, j, k, cell, prior_cell FROM states")
    _claims("grown", "st", "o6", same_quad)
    _claims("up1", "st", "oz", "TRUE")
    _claims("up2", "up1", "oz", "TRUE")
    _claims("up3", "up2", "oz", "TRUE")
    C.define("bubble", f"""
SELECT s.i + o.di AS i, s.j + o.dj AS j, s.k, MIN(s.cell) AS cell FROM occ s CROSS JOIN o4 o
WHERE s.i + o.di >= 0 AND s.j + o.dj >= 0 GROUP BY s.i + o.di, s.j + o.dj, s.k
HAVING COUNT(*) = 4 AND MIN(s.cell) = MAX(s.cell)""")
    xt = f"(col_px + CAST(0.5 AS DOUBLE)) * CAST({MASK_X[0]} AS DOUBLE) + (row_px + CAST(0.5 AS DOUBLE)) * CAST({MASK_X[1]} AS DOUBLE) + CAST({MASK_X[2]} AS DOUBLE)"
    yt = f"(col_px + CAST(0.5 AS DOUBLE)) * CAST({MASK_Y[0]} AS DOUBLE) + (row_px + CAST(0.5 AS DOUBLE)) * CAST({MASK_Y[1]} AS DOUBLE) + CAST({MASK_Y[2]} AS DOUBLE)"
    C.define("maskv", f"""
SELECT i, j, CAST(0 AS BIGINT) AS k, mask_id, FALSE AS frozen,
  SUM(CAST(0.5 AS DOUBLE) + CAST(0.425 AS DOUBLE) * (CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + EXP(-CAST(cellprob_logit AS DOUBLE))))) AS weight
FROM (SELECT *, CAST(GREATEST(0, FLOOR(({xt}) / CAST(2 AS DOUBLE))) AS BIGINT) AS i,
  CAST(GREATEST(0, FLOOR(({yt}) / CAST(2 AS DOUBLE))) AS BIGINT) AS j FROM fx_mask_pixels) p GROUP BY i, j, mask_id""")
    det = abs(MASK_X[0] * MASK_Y[1] - MASK_X[1] * MASK_Y[0])
    C.define("maskwin", """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j, k ORDER BY ROUND(weight, 9) DESC, mask_id) AS rn FROM maskv) t WHERE rn = 1""")
    C.define("polyvox", f"""
SELECT i, j, CAST(MAX(polygon) AS BIGINT) AS polygon FROM (
  SELECT p.polygon, v.i, v.j, SUM(CASE WHEN (p.y1 <= v.cy) <> (p.y2 <= v.cy)
      AND v.cx < p.x1 + (v.cy - p.y1) * (p.x2 - p.x1) / (CASE WHEN p.y2 = p.y1 THEN 1 ELSE p.y2 - p.y1 END) THEN 1 ELSE 0 END) AS crossings
  FROM (SELECT a.polygon, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM fx_polygon_vertices a JOIN fx_polygon_vertices b ON a.polygon = b.polygon AND a.vertex + 1 = b.vertex) p
  JOIN (SELECT i, j, xmin + (i + CAST(0.5 AS DOUBLE)) * {vs} AS cx, ymin + (j + CAST(0.5 AS DOUBLE)) * {vs} AS cy
        FROM origin, (SELECT UNNEST(RANGE(0, (SELECT CAST(MAX(x) AS BIGINT) FROM fx_polygon_vertices))) AS i) a,
             (SELECT UNNEST(RANGE(0, (SELECT CAST(MAX(y) AS BIGINT) FROM fx_polygon_vertices))) AS j) b) v
    ON v.cy BETWEEN LEAST(p.y1, p.y2) - 20 AND GREATEST(p.y1, p.y2) + 20
  GROUP BY p.polygon, v.i, v.j) t WHERE crossings % 2 = 1 GROUP BY i, j""")
    h = C.BANDWIDTH
    r2 = "(-2.0 * 0.25 * LN(CAST(0.001 AS DOUBLE)))"
    C.define("near9", "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ") t(a, b)")
    C.define("kde_pairs", f"""
SELECT i + a AS i, j + b AS j, n,
  POWER(((i + a) + CAST(0.5 AS DOUBLE)) * CAST({vs} AS DOUBLE) + xmin - x, 2) + POWER(((j + b) + CAST(0.5 AS DOUBLE)) * CAST({vs} AS DOUBLE) + ymin - y, 2) AS d2
FROM vox CROSS JOIN near9 CROSS JOIN origin""")
    C.define("kde", f"""
SELECT w.i, w.j, ROUND(COALESCE(m.density, 0), 9) AS density
FROM (SELECT DISTINCT i + di AS i, j + dj AS j FROM (SELECT DISTINCT i, j FROM vox) v CROSS JOIN o25 WHERE i + di >= 0 AND j + dj >= 0) w
LEFT JOIN (SELECT i, j, SUM(n * EXP(-d2 / CAST({2 * h * h} AS DOUBLE)) * CAST({h} AS DOUBLE) * SQRT(2 * PI())) AS density
  FROM kde_pairs WHERE d2 <= {r2} GROUP BY i, j) m ON w.i = m.i AND w.j = m.j""")
    C.define("kde_rank", "SELECT density, ROW_NUMBER() OVER (ORDER BY density) - 1 AS r, COUNT(*) OVER () AS m FROM kde")
    C.define("kde_edge", f"""
SELECT b, MIN(density) AS edge FROM kde_rank JOIN (SELECT UNNEST(RANGE(1, {C.BINS + 1})) AS b) s
  ON r = LEAST(m - 1, CAST(TRUNC(CAST(b AS DOUBLE) / {C.BINS} * m) AS BIGINT)) GROUP BY b""")
    C.define("dbin", f"""
SELECT i, j, LEAST({C.BINS - 1}, (SELECT COUNT(*) FROM kde_edge e WHERE e.edge <= kde.density)) AS bin FROM kde""")
    rp = "ROUND(log_prior, 6) AS log_prior, ROUND(log_1m_prior, 6) AS log_1m_prior"
    ln_p = "ROUND(LN(CAST({} AS DOUBLE)), 6)"
    q_ = {
        "voxelize": "SELECT transcript_id, x, y, i, j, k FROM vox",
        "voxel_counts": "SELECT * FROM counts",
        "prior_votes": "SELECT * FROM votes",
        "nucleus_vote_winner": "SELECT * FROM nucwin",
        "cell_vote_prior": f"SELECT i, j, k, prior_cell, {rp} FROM states0 WHERE cell IS NULL",
        "used_cells": "SELECT * FROM used",
        "initial_states": f"SELECT i, j, k, cell, prior_cell, {rp} FROM states",
        "barcode_states": f"""SELECT i, j, CAST(0 AS BIGINT) AS k, cell_id AS cell, cell_id AS prior_cell,
  {ln_p.format(0.8)} AS log_prior, {ln_p.format(1.0 - 0.8)} AS log_1m_prior FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY square_002um) AS rn FROM (
    SELECT square_002um, cell_id, CAST(FLOOR(pxl_row_in_fullres * 0.5 / CAST(3 AS DOUBLE)) AS BIGINT) AS i,
      CAST(FLOOR(pxl_col_in_fullres * 0.5 / CAST(3 AS DOUBLE)) AS BIGINT) AS j
    FROM fx_barcode_mappings m JOIN fx_barcode_positions p ON m.square_002um = p.barcode
    WHERE in_nucleus AND cell_id IS NOT NULL) a) b WHERE rn = 1""",
        "mask_pixel_votes": "SELECT i, j, k, mask_id, frozen, ROUND(weight, 6) AS weight FROM maskv",
        "mask_states": f"""SELECT i, j, k, CAST(mask_id AS VARCHAR) AS cell, CAST(mask_id AS VARCHAR) AS prior_cell,
  ROUND(LN(p), 6) AS log_prior, ROUND(LN(1 - p), 6) AS log_1m_prior, frozen
FROM (SELECT *, LEAST(CAST(0.99 AS DOUBLE), ROUND(weight, 9) / CAST({4.0 / det!r} AS DOUBLE)) AS p FROM maskwin) t""",
        "polygon_rasterize": "SELECT i, j, polygon FROM polyvox",
        "polygon_states": f"""SELECT i, j, CAST(0 AS BIGINT) AS k, CONCAT('c', CAST(polygon AS VARCHAR)) AS cell,
  CONCAT('c', CAST(polygon AS VARCHAR)) AS prior_cell, {ln_p.format(0.5)} AS log_prior, {ln_p.format(0.5)} AS log_1m_prior FROM polyvox""",
        "expand_cells_once": "SELECT * FROM grown",
        "expand_vertical": "SELECT i, j, k, cell FROM up3",
        "pop_bubbles": """SELECT COALESCE(s.i, b.i) AS i, COALESCE(s.j, b.j) AS j, COALESCE(s.k, b.k) AS k,
  COALESCE(s.cell, b.cell) AS cell, s.prior_cell FROM st s FULL JOIN bubble b ON s.i = b.i AND s.j = b.j AND s.k = b.k""",
        "mismatch_edges": f"""SELECT a.i AS a_i, a.j AS a_j, a.k AS a_k, a.i + o.di AS b_i, a.j + o.dj AS b_j, a.k + o.dk AS b_k,
  a.cell AS cell_a, b.cell AS cell_b FROM occ a CROSS JOIN (SELECT * FROM o6 WHERE di + dj + dk > 0) o
  LEFT JOIN occ b ON b.i = a.i + o.di AND b.j = a.j + o.dj AND b.k = a.k + o.dk
WHERE a.cell IS DISTINCT FROM b.cell AND a.k + o.dk < {C.LAYERS}
UNION ALL SELECT b.i - o.di, b.j - o.dj, b.k - o.dk, b.i, b.j, b.k, NULL, b.cell FROM occ b
  CROSS JOIN (SELECT * FROM o6 WHERE di + dj + dk > 0) o
  LEFT JOIN occ a ON a.i = b.i - o.di AND a.j = b.j - o.dj AND a.k = b.k - o.dk
WHERE a.cell IS NULL AND b.i - o.di >= 0 AND b.j - o.dj >= 0 AND b.k - o.dk >= 0""",
        "halo_rows": f"""SELECT DISTINCT CAST({quad('i + a')} AS BIGINT) AS u, CAST({quad('j + b')} AS BIGINT) AS v, i, j, k, cell FROM st CROSS JOIN near9
WHERE ({quad('i + a')} <> {quad('i')} OR {quad('j + b')} <> {quad('j')}) AND i + a >= 0 AND j + b >= 0""",
        "upsample_states": """SELECT i * 2 + a AS i, j * 2 + b AS j, k, cell, prior_cell FROM st
CROSS JOIN (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b)""",
        "density_kde": "SELECT i, j, ROUND(density, 6) AS density FROM kde",
        "density_bins": "SELECT i, j, bin FROM dbin",
        "region_volume": f"SELECT bin, ROUND(COUNT(*) * CAST({vs * vs / C.LAYERS} AS DOUBLE), 6) AS volume FROM dbin GROUP BY bin",
        "voxel_counts_dump": f"""SELECT gene, n AS count, ROUND((i + CAST(0.5 AS DOUBLE)) * {vs} + xmin, 6) AS x,
  ROUND((j + CAST(0.5 AS DOUBLE)) * {vs} + ymin, 6) AS y, ROUND((k + CAST(0.5 AS DOUBLE)) * CAST({1 / C.LAYERS} AS DOUBLE) + zmin, 6) AS z,
  CAST(0 AS BIGINT) AS dx, CAST(0 AS BIGINT) AS dy, CAST(0 AS BIGINT) AS dz FROM counts, origin""",
    }
    return {k: C.build(v) for k, v in q_.items()}
