"""Common table expressions shared by the SQL counterparts."""

from __future__ import annotations

import re

# Parameters shared with the Spark side of the catalogue.
MIN_QV = 20
EXCLUDED = "^Brand#1[0-2]"
VOXEL_SIZE = 2.0
LAYERS = 4
QUAD = 20
BANDWIDTH = 0.5
BINS = 5
NUCLEAR_REASSIGNMENT = 0.2
PRIOR_REASSIGNMENT = 0.5

CTE: dict[str, str] = {}


def define(name: str, body: str) -> None:
    CTE[name] = body


def build(select: str) -> str:
    """Prefix ``select`` with the expressions it refers to, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTE and word not in ordered:
                visit(CTE[word])
                if word not in ordered:
                    ordered.append(word)

    visit(select)
    if not ordered:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in ordered) + "\n" + select


def values(offsets) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(str(o) for o in offsets) + ") t(di, dj, dk)"


define("fx_transcripts", """
SELECT l_orderkey * 8 + l_linenumber AS transcript_id, p_brand AS gene, l_quantity AS qv,
  CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS overlaps_nucleus,
  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'UNASSIGNED'
       ELSE CONCAT('c', CAST(l_suppkey AS VARCHAR(20))) END AS cell_id,
  CONCAT('fov', CAST(l_suppkey % 4 AS VARCHAR(20))) AS fov_name,
  (l_suppkey % 10) * 12 + ((l_partkey * 7919 + l_orderkey * 31) % 1000) / CAST(100 AS DOUBLE) AS x_location,
  CAST(FLOOR(l_suppkey / CAST(10 AS DOUBLE)) AS BIGINT) * 12
    + ((l_orderkey * 104729 + l_partkey * 17) % 1000) / CAST(100 AS DOUBLE) AS y_location,
  CAST(l_linenumber AS DOUBLE) AS z_location
FROM lineitem JOIN part ON l_partkey = p_partkey""")
define("fx_fov_offsets", """
SELECT CONCAT('fov', CAST(r_regionkey AS VARCHAR(20))) AS fov_name,
  CAST(r_regionkey * 500 AS DOUBLE) AS x_fov, CAST(r_regionkey * -250 AS DOUBLE) AS y_fov FROM region""")
define("fx_barcode_positions", """
SELECT CONCAT('bc', CAST(p_partkey AS VARCHAR(20))) AS barcode,
  CAST((p_partkey % 40) * 2 AS DOUBLE) AS pxl_row_in_fullres,
  CAST(CAST(FLOOR(p_partkey / CAST(40 AS DOUBLE)) AS BIGINT) * 2 AS DOUBLE) AS pxl_col_in_fullres FROM part""")
define("fx_barcode_mappings", """
SELECT CONCAT('bc', CAST(p_partkey AS VARCHAR(20))) AS square_002um,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE CONCAT('cell', CAST(p_size AS VARCHAR(20))) END AS cell_id,
  p_partkey % 3 <> 0 AS in_nucleus FROM part""")
define("fx_bin_counts", """
SELECT CONCAT('bc', CAST(l_partkey AS VARCHAR(20))) AS barcode,
  CONCAT('g', CAST(l_suppkey % 20 AS VARCHAR(20))) AS gene, COUNT(*) AS n
FROM lineitem GROUP BY l_partkey, l_suppkey % 20""")
define("fx_mask_pixels", """
SELECT CAST(p_partkey % 50 AS INT) AS row_px, CAST(FLOOR(p_partkey / CAST(50 AS DOUBLE)) AS INT) AS col_px,
  CAST(1 + (p_partkey % 50) % 7 AS INT) AS mask_id, (p_size - 25) / CAST(10 AS DOUBLE) AS cellprob_logit
FROM part WHERE p_size % 6 <> 0""")
define("fx_polygon_vertices", """
SELECT s_suppkey AS polygon, CONCAT('c', CAST(s_suppkey AS VARCHAR(20))) AS cell_id, v AS vertex,
  (s_suppkey % 10) * 12 + CAST(CASE WHEN v IN (1, 2) THEN 9.5 ELSE 0.25 END AS DOUBLE) AS x,
  CAST(FLOOR(s_suppkey / CAST(10 AS DOUBLE)) AS BIGINT) * 12
    + CAST(CASE WHEN v IN (2, 3) THEN 9.5 ELSE 0.25 END AS DOUBLE) AS y
FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(v)""")

define("tx", f"""
SELECT transcript_id, gene, x_location AS x, y_location AS y, z_location AS z, CAST(1 AS BIGINT) AS n, fov_name AS fov,
  CASE WHEN cell_id <> 'UNASSIGNED' THEN cell_id END AS cell,
  CASE WHEN cell_id <> 'UNASSIGNED' AND overlaps_nucleus = '1' THEN cell_id END AS nucleus
FROM fx_transcripts WHERE NOT qv < {MIN_QV} AND NOT regexp_matches(gene, '{EXCLUDED}')""")
define("prior_centroids", "SELECT cell, AVG(x) AS cx, AVG(y) AS cy FROM tx WHERE cell IS NOT NULL GROUP BY cell")
define("zrank", "SELECT z, ROW_NUMBER() OVER (ORDER BY z) - 1 AS r, COUNT(*) OVER () AS m FROM tx")
define("zlim", """
SELECT MIN(CASE WHEN r = CAST(TRUNC(0.01 * m) AS BIGINT) THEN z END) AS lo,
  MIN(CASE WHEN r = CAST(TRUNC(0.99 * m) AS BIGINT) THEN z END) AS hi FROM zrank""")
define("prep", """
SELECT transcript_id, gene, x, y, (LEAST(GREATEST(z, lo), hi) - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END) AS z,
  n, fov, cell, nucleus FROM tx, zlim""")
define("origin", "SELECT MIN(x) AS xmin, MIN(y) AS ymin, MIN(z) AS zmin FROM prep")
define("vox", f"""
SELECT prep.*, CAST(GREATEST(0, FLOOR((x - xmin) / CAST({VOXEL_SIZE} AS DOUBLE))) AS BIGINT) AS i,
  CAST(GREATEST(0, FLOOR((y - ymin) / CAST({VOXEL_SIZE} AS DOUBLE))) AS BIGINT) AS j,
  LEAST({LAYERS - 1}, GREATEST(0, CAST(TRUNC((z - zmin) / CAST({1.0 / LAYERS} AS DOUBLE)) AS BIGINT))) AS k
FROM prep, origin""")
define("counts", "SELECT i, j, k, gene, CAST(SUM(n) AS BIGINT) AS n FROM vox GROUP BY i, j, k, gene")
define("votes", """
SELECT i, j, k, cell, CAST(SUM(n) AS BIGINT) AS n_cell,
  CAST(SUM(CASE WHEN nucleus IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_nucleus
FROM vox WHERE cell IS NOT NULL GROUP BY i, j, k, cell""")
define("nucwin", """
SELECT i, j, k, cell, n_nucleus FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j, k ORDER BY n_nucleus DESC, cell) AS rn
  FROM votes WHERE n_nucleus > 0) t WHERE rn = 1""")
define("cellwin", """
SELECT i, j, k, cell FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY i, j, k ORDER BY n_cell DESC, cell) AS rn
  FROM votes) t WHERE rn = 1""")
define("states0", f"""
SELECT i, j, k, cell, cell AS prior_cell, LN(CAST({1.0 - NUCLEAR_REASSIGNMENT} AS DOUBLE)) AS log_prior,
  LN(CAST({NUCLEAR_REASSIGNMENT} AS DOUBLE)) AS log_1m_prior FROM nucwin
UNION ALL
SELECT i, j, k, NULL, cell, LN(CAST({1.0 - PRIOR_REASSIGNMENT} AS DOUBLE)), LN(CAST({PRIOR_REASSIGNMENT} AS DOUBLE)) FROM cellwin c
WHERE NOT EXISTS (SELECT 1 FROM nucwin w WHERE w.i = c.i AND w.j = c.j AND w.k = c.k)
  AND cell IN (SELECT cell FROM nucwin)""")
define("used", "SELECT cell, DENSE_RANK() OVER (ORDER BY cell) - 1 AS cell_id FROM (SELECT DISTINCT cell FROM nucwin) t")
define("states", """
SELECT i, j, k, a.cell_id AS cell, b.cell_id AS prior_cell, log_prior, log_1m_prior
FROM states0 s LEFT JOIN used a ON s.cell = a.cell LEFT JOIN used b ON s.prior_cell = b.cell""")
define("occ", "SELECT i, j, k, cell FROM states WHERE cell IS NOT NULL")
