import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions.offsets import MOORE, MOORE_2D, VERTICAL, VON_NEUMANN, VON_NEUMANN_XY, diamond
from cellgrid.operators import initial, measures, outline, prep, results, spatial
from cellgrid.operators.grid import Grid, neighbour_messages
from cellgrid.operators.spatial import nearest_center, range_semi_join

GRID = Grid(0.0, 0.0, 0.0, 1.0, 2, quad=8, tile=4)
STATE = "i long, j long, k long, cell long, prior_cell long, log_prior double, log_1m_prior double"


def states(spark, rows):
    return spark.createDataFrame([(*r[:3], r[3], None, None, None) if len(r) == 4 else r for r in rows], STATE)


def test_offset_tables():
    assert [len(x) for x in (MOORE, MOORE_2D, VON_NEUMANN, VON_NEUMANN_XY, VERTICAL, diamond(3))] == [26, 8, 6, 4, 2, 25]


def test_voxel_bounds(spark):
    df = spark.createDataFrame([(-1.0, 2.5, -0.2), (3.999, 0.0, 1.0), (4.0, 7.0, 0.49)], "x double, y double, z double")
    got = df.select(GRID.i(F.col("x")), GRID.j(F.col("y")), GRID.k(F.col("z"))).collect()
    assert [tuple(r) for r in got] == [(0, 2, 0), (3, 0, 1), (4, 7, 0)]


def test_messages_reach_every_neighbour_once(spark):
    rows = [(i, j, 0, 1) for i in range(10) for j in range(10)]
    sent = neighbour_messages(states(spark, rows).select("i", "j", "k", "cell"), GRID, MOORE_2D)
    got = {(r.i, r.j): r["count"] for r in sent.groupBy("i", "j").count().collect()}
    assert got[(0, 0)] == 3 and got[(4, 4)] == 8 and got[(10, 10)] == 1 and got[(3, 0)] == 5


def test_vote_tie_goes_to_lowest_cell(spark):
    vox = spark.createDataFrame(
        [(0, 0, 0, "b", "b", 2), (0, 0, 0, "a", "a", 2), (1, 0, 0, "c", None, 3), (1, 0, 0, "a", None, 1), (2, 0, 0, "a", None, 1)],
        "i long, j long, k long, cell string, nucleus string, n long")
    got = {(r.i, r.cell, r.prior_cell) for r in initial.states_from_assignments(vox).collect()}
    # cell c owns no nuclear voxel: dropped, although it wins voxel 1
    assert got == {(0, "a", "a"), (2, None, "a")}


def test_surface_of_small_shapes(spark):
    s = states(spark, [(0, 0, 0, 1), (5, 5, 0, 2), (5, 6, 0, 2), (5, 5, 1, 2)])
    got = {(r.cell, r.k): (r.volume, r.surface) for r in measures.layer_volume_surface(s, GRID).collect()}
    assert got == {(1, 0): (1, 8), (2, 0): (2, 14), (2, 1): (1, 8)}


def test_bubble_and_expansion(spark):
    ring = [(i, j, 0, 7) for i in range(1, 4) for j in range(1, 4) if (i, j) != (2, 2)]
    filled = initial.pop_bubbles(states(spark, ring), GRID).collect()
    assert (2, 2, 0, 7) in {(r.i, r.j, r.k, r.cell) for r in filled}
    grown = initial.expand_cells(states(spark, [(7, 0, 0, 1), (5, 0, 0, 2)]), GRID).collect()
    got = {(r.i, r.j, r.k): r.cell for r in grown}
    assert got[(6, 0, 0)] == 1 and (8, 0, 0) not in got  # rivals: lowest id; quad border holds
    assert got[(7, 0, 1)] == 1
    up = initial.expand_vertically(states(spark, [(0, 0, 0, 3)]), GRID).collect()
    assert {(r.k, r.cell) for r in up} == {(0, 3), (1, 3)}


def test_edges(spark):
    got = initial.mismatch_edges(states(spark, [(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 2)]), GRID).collect()
    pairs = {((r.a_i, r.a_j, r.a_k), (r.b_i, r.b_j, r.b_k)): (r.cell_a, r.cell_b) for r in got}
    assert pairs[((1, 0, 0), (2, 0, 0))] == (1, 2)
    assert ((0, 0, 0), (1, 0, 0)) not in pairs
    assert pairs[((2, 0, 0), (3, 0, 0))] == (2, None)
    assert len(pairs) == 8


def polygons(spark, cells):
    df = spark.createDataFrame([(c, i, j, 0) for c, v in cells.items() for i, j in v], "cell long, i long, j long, k long")
    return {r.cell: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in outline.polygons(df, GRID).collect()}


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2


def test_outlines(spark):
    block = [(i, j) for i in range(3) for j in range(3)]
    got = polygons(spark, {
        1: [p for p in block if p != (1, 1)],  # hole
        2: [(0, 0), (1, 1)],  # diagonal pair
        3: [(0, 0), (1, 0), (0, 1)],  # L shape
        4: [p for p in block if p not in ((1, 1), (2, 2))],  # pinched hole
    })
    assert [area(r) for r in got[1]] == [9.0] and len(got[1][0]) == 5
    assert sorted(area(r) for r in got[2]) == [1.0, 1.0]
    assert [area(r) for r in got[3]] == [3.0] and len(got[3][0]) == 7
    assert [area(r) for r in got[4]] == [8.0]


def test_outlines_of_random_blobs(spark):
    rnd = random.Random(5)
    cells = {}
    for c in range(6):
        blob = {(20, 20)}
        while len(blob) < 60:
            i, j = rnd.choice(sorted(blob))
            di, dj = rnd.choice([(1, 0), (-1, 0), (0, 1), (0, -1)])
            blob.add((i + di, j + dj))
        cells[c] = blob
    for c, rings in polygons(spark, cells).items():
        assert len(rings) == 1 and rings[0][0] == rings[0][-1]
        assert area(rings[0]) >= len(cells[c])  # holes are filled
        assert len(set(rings[0])) == len(rings[0]) - 1  # no corner visited twice


def test_consensus_keeps_every_cell(spark):
    s = states(spark, [(0, 0, 0, 1), (0, 0, 1, 2), (1, 0, 0, 2), (1, 0, 1, 3)])
    counts = spark.createDataFrame([(0, 0, 0, "g", 3), (0, 0, 1, "g", 1), (1, 0, 0, "g", 2), (1, 0, 1, "g", 2)], "i long, j long, k long, gene string, n long")
    got = {(r.i, r.j, r.cell) for r in results.consensus_votes(s, counts).collect()}
    assert got == {(0, 0, 1), (1, 0, 2), (1, 0, 3)}


def test_range_semi_join_against_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, "g", rnd.uniform(-50, 50), 0.0 if i < 100 else rnd.uniform(-50, 50)) for i in range(400)]
    cen = [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(12)]
    p = spark.createDataFrame(pts, "id long, gene string, x double, y double")
    c = spark.createDataFrame(cen, "cx double, cy double")
    got = {r.id for r in range_semi_join(p, c, 9.0).collect()}
    assert got == {i for i, _, x, y in pts if any((x - a) ** 2 + (y - b) ** 2 <= 81.0 for a, b in cen)}


def test_votes_are_ranked_once(spark):
    rows = [(0, 0, 0, "a", "a", 1), (0, 0, 0, "b", None, 5), (1, 0, 0, "a", None, 2), (2, 0, 0, "c", None, 2)]
    found = initial.states_from_assignments(spark.createDataFrame(rows, "i long, j long, k long, cell string, nucleus string, n long"))
    assert found.inputFiles() and all("ranked-" in f for f in found.inputFiles())
    assert {(r.i, r.cell, r.prior_cell) for r in found.collect()} == {(0, "a", "a"), (1, None, "a")}


def test_nearest_center_against_brute_force(spark):
    rnd = random.Random(6)
    pts = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(200)] + [(999, 500.0, -300.0)]
    cen = [(f"c{k}", rnd.uniform(0, 40), rnd.uniform(0, 40)) for k in range(9)]
    got = {r.id: r.nearest for r in nearest_center(
        spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(cen, "cell string, cx double, cy double"), "id", 2.0).collect()}
    want = {i: min(cen, key=lambda c: (c[1] - x) ** 2 + (c[2] - y) ** 2)[0] for i, x, y in pts}
    assert got == want


def test_nearest_center_sorts_no_pairs_and_pairs_only_crowded_buckets(spark, monkeypatch):
    rnd = random.Random(7)
    pts = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(300)] + [(-1, None, 3.0)]
    cen = [(f"c{k}", rnd.uniform(0, 60), rnd.uniform(0, 60)) for k in range(60)] + [(f"d{k}", 20 + rnd.random(), 20 + rnd.random()) for k in range(30)]
    want = {i: None if x is None else min(cen, key=lambda c: (c[1] - x) ** 2 + (c[2] - y) ** 2)[0] for i, x, y in pts}
    points = spark.createDataFrame(pts, "id long, x double, y double")
    centers = spark.createDataFrame(cen, "cell string, cx double, cy double")
    plan = spatial._in_reach(points, centers, "id", 12.0, "cell")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan
    for listed in (spatial.LISTED, 20, 0):
        monkeypatch.setattr(spatial, "LISTED", listed)
        assert {r.id: r.nearest for r in nearest_center(points.union(points), centers, "id", 12.0).collect()} == want


def test_nearest_center_of_far_clusters_takes_few_jobs(spark):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal((-4e4, 7e4), 30, (150, 2)), rng.normal((9e5, -3e5), 30, (150, 2))]).round(1)
    at = np.concatenate([at, at[:20]])  # places taken twice: the lower key counts
    centers = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "cell long, cx double, cy double")
    where = np.concatenate([at[::7], rng.uniform(-1e6, 1e6, (150, 2)), [[4.3e5, -1.15e5], [-4e4, 7e4]]]).round(1)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(where)] + [(-1, None, 2.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double")
    sc = spark.sparkContext
    sc.setJobGroup("nearest", "nearest centres")
    got = {r.id: (r.nearest, r.distance2) for r in nearest_center(points, centers, "id", size=5.0).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("nearest"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    d2 = ((where[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    assert len(got) == len(rows) and got.pop(-1) == (None, None)
    assert {i: n for i, (n, _) in got.items()} == {i: int(n) for i, n in enumerate(d2.argmin(axis=1))}
    assert all(abs(d - d2[i].min()) <= 1e-6 * max(d2[i].min(), 1.0) for i, (_, d) in got.items())
    assert jobs < 40, jobs  # doubling buckets takes 19 rounds and repeats the earlier ones in each

def _inside(x, y, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def test_rasterize_concave_polygon(spark):
    ring = [(0.2, 0.1), (9.7, 1.3), (5.1, 4.2), (8.8, 9.4), (1.1, 7.9), (0.2, 0.1)]
    v = spark.createDataFrame([(0, "a", k, x, y) for k, (x, y) in enumerate(ring)], "polygon long, cell_id string, vertex int, x double, y double")
    got = {(r.i, r.j) for r in initial.rasterize_polygons(v, GRID).collect()}
    assert got == {(i, j) for i in range(12) for j in range(12) if _inside(i + 0.5, j + 0.5, ring)}


def test_rasterize_excludes_centres_on_edges(spark):
    ring = [(0.5, 0.5), (3.5, 0.5), (3.5, 3.5), (0.5, 3.5), (0.5, 0.5)]
    v = spark.createDataFrame([(0, "a", k, x, y) for k, (x, y) in enumerate(ring)], "polygon long, cell_id string, vertex int, x double, y double")
    assert {(r.i, r.j) for r in initial.rasterize_polygons(v, GRID).collect()} == {(i, j) for i in (1, 2) for j in (1, 2)}


def test_filters_keep_missing_quality(spark):
    df = spark.createDataFrame([(1, 30.0), (2, 5.0), (3, float("nan")), (4, None)], "id long, qv double")
    assert {r.id for r in prep.quality_filter(df, 20).collect()} == {1, 3, 4}
    assert prep.quality_filter(df.drop("qv"), 20).count() == 4
    with pytest.raises(ValueError):
        prep.check_pattern("a(?=b)")


def test_constant_depth(spark):
    df = spark.createDataFrame([("g", 0.0, 1.0, 5.0, 1), ("g", 2.0, 3.0, 5.0, 1)], "gene string, x double, y double, z double, n long")
    assert {r.z for r in prep.normalize_z(df).collect()} == {0.0}


def test_ids_per_field_of_view(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "a")], "fov string, cell_id string")
    assert prep.normalize_assignment(df, "cell_id", "0").select("cell").distinct().count() == 1
    assert prep.normalize_assignment(df, "cell_id", "0", fov="fov").select("cell").distinct().count() == 2


def test_density_grid_volume():
    assert math.isclose(GRID.voxel_volume, 0.5)
    assert GRID.finer(2).voxel_size == 0.5 and GRID.finer(2).quad == 16
