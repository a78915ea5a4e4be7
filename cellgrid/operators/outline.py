"""Cell outlines from voxels: boundary edges, rings, polygons.

Directions are 0: +i, 1: +j, 2: -i, 3: -j; edges run counter-clockwise round
their voxel, so outer rings turn left and holes turn right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.grid import Grid
from cellgrid.session import materialize

_DI = (1, 0, -1, 0)
_DJ = (0, 1, 0, -1)
NODE = ["cell", "k", "pi", "pj", "dir"]


def _pick(values: tuple[int, ...], d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), d + 1)


def boundary_edges(voxels: DataFrame) -> DataFrame:
    """Unit edges between a cell and anything else, per (cell, layer).

    Every voxel lists its four sides; a side shared by two voxels of the cell
    is listed twice and drops out.
    """
    # per side: offset of its lower corner, axis (0 along i, 1 along j), direction
    sides = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(d % 2).alias("axis"), F.lit(d).alias("dir"))
        for a, b, d in ((0, 0, 0), (1, 0, 1), (0, 1, 2), (0, 0, 3))
    ])
    listed = voxels.select("cell", "k", "i", "j", F.explode(sides).alias("s")).select(
        "cell", "k", (F.col("i") + F.col("s.a")).alias("ci"), (F.col("j") + F.col("s.b")).alias("cj"),
        F.col("s.axis").alias("axis"), F.col("s.dir").alias("dir"),
    )
    once = listed.groupBy("cell", "k", "ci", "cj", "axis").agg(F.count(F.lit(1)).alias("m"), F.max("dir").alias("dir"))
    back = F.col("dir") >= 2  # runs from the upper corner to the lower one
    return once.where("m = 1").select(
        "cell", "k",
        (F.col("ci") + F.when(back & (F.col("axis") == 0), 1).otherwise(0)).alias("pi"),
        (F.col("cj") + F.when(back & (F.col("axis") == 1), 1).otherwise(0)).alias("pj"),
        "dir",
    )


def link_edges(edges: DataFrame) -> DataFrame:
    """Each edge with the edge before it on its ring.

    Where two voxels touch only at a corner the path stays on its own voxel
    (turns left), so diagonal voxels do not merge.
    """
    leave = edges.select("cell", "k", F.col("pi").alias("vi"), F.col("pj").alias("vj"), F.lit(None).cast("int").alias("into"), F.col("dir").alias("out"))
    enter = edges.select(
        "cell", "k", (F.col("pi") + _pick(_DI, F.col("dir"))).alias("vi"), (F.col("pj") + _pick(_DJ, F.col("dir"))).alias("vj"),
        F.col("dir").alias("into"), F.lit(None).cast("int").alias("out"),
    )
    corner = leave.unionByName(enter).groupBy("cell", "k", "vi", "vj").agg(
        F.collect_list("into").alias("into"), F.max("out").alias("out")  # at most two of each
    )
    path = corner.select("cell", "k", "vi", "vj", "out", F.size("into").alias("m"), F.explode("into").alias("d"))
    out = F.when(F.col("m") == 2, (F.col("d") + 1) % 4).otherwise(F.col("out"))
    return path.select(
        "cell", "k", F.col("vi").alias("pi"), F.col("vj").alias("pj"), out.alias("dir"),
        (F.col("vi") - _pick(_DI, F.col("d"))).alias("qi"), (F.col("vj") - _pick(_DJ, F.col("d"))).alias("qj"), F.col("d").alias("qdir"),
    )


def rank_rings(links: DataFrame) -> DataFrame:
    """Ring leader and position of every edge, by pointer doubling.

    Each round joins an edge to the one its pointer names, doubling how far it
    looks back, so a ring of n edges needs log2(n) shuffles and no ring is ever
    walked inside one task. The leader is the lexicographically first edge.
    """
    longest = links.groupBy("cell", "k").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0] or 0
    me = F.struct("pi", "pj", "dir")
    state = links.select(*NODE, "qi", "qj", "qdir", me.alias("lead"), F.lit(0).cast("bigint").alias("rank"), (F.col("qdir") != F.col("dir")).alias("corner"))
    for r in range(max(0, math.ceil(math.log2(longest))) if longest > 1 else 0):
        state = materialize(state, "rings")
        far = state.select(
            "cell", "k", F.col("pi").alias("qi"), F.col("pj").alias("qj"), F.col("dir").alias("qdir"),
            F.col("qi").alias("ri"), F.col("qj").alias("rj"), F.col("qdir").alias("rdir"), F.col("lead").alias("flead"), F.col("rank").alias("frank"),
        )
        better = F.col("flead") < F.col("lead")
        state = state.join(far, ["cell", "k", "qi", "qj", "qdir"]).select(
            *NODE, F.col("ri").alias("qi"), F.col("rj").alias("qj"), F.col("rdir").alias("qdir"),
            F.when(better, F.col("flead")).otherwise(F.col("lead")).alias("lead"),
            F.when(better, F.col("frank") + (1 << r)).otherwise(F.col("rank")).alias("rank"), "corner",
        )
    return state.select(*NODE, "lead", "rank", "corner")


def ring_area(ranked: DataFrame) -> DataFrame:
    """Signed area of each ring in voxels: positive outside, negative for holes."""
    step = F.col("pi") * _pick(_DJ, F.col("dir")) - F.col("pj") * _pick(_DI, F.col("dir"))
    return ranked.groupBy("cell", "k", "lead").agg((F.sum(step) / F.lit(2.0)).alias("area"), F.count(F.lit(1)).alias("edges"))


def cut_loops(ranked: DataFrame) -> DataFrame:
    """Drop the part of a ring between two visits to the same corner.

    Corners met twice are found by counting; what lies between the visits is
    removed by an anti join on the few such stretches.
    """
    ring = ["cell", "k", "lead"]
    stretch = ranked.groupBy(*ring, "pi", "pj").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    same = [F.col(f"r.{c}") == F.col(f"s.{c}") for c in ring]
    between = (F.col("r.rank") > F.col("s.first")) & (F.col("r.rank") <= F.col("s.last"))
    return ranked.alias("r").join(stretch.alias("s"), [*same, between], "left_anti")


def polygons(voxels: DataFrame, grid: Grid) -> DataFrame:
    """Closed exterior rings of each (cell, layer), in microns, holes dropped.

    ``voxels`` has ``cell, i, j, k``. Only turning points are gathered, so the
    one array per ring is the outline the output format needs.
    """
    ranked = materialize(rank_rings(link_edges(boundary_edges(voxels))), "ranked")
    outer = ring_area(ranked).where("area > 0").select("cell", "k", "lead")
    kept = cut_loops(ranked.join(outer, ["cell", "k", "lead"], "left_semi")).where("corner")
    vs = F.lit(grid.voxel_size)
    point = F.struct((F.col("pi") * vs + F.lit(grid.xmin)).alias("x"), (F.col("pj") * vs + F.lit(grid.ymin)).alias("y"))
    rings = kept.groupBy("cell", "k", "lead").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", point.alias("p")))), lambda r: r["p"]).alias("ring")
    )
    closed = F.concat("ring", F.slice("ring", 1, 1))
    return rings.groupBy("cell", "k").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lead", closed.alias("ring")))), lambda r: r["ring"]).alias("rings")
    )


def flattened_polygons(states: DataFrame, grid: Grid) -> DataFrame:
    """Outline of each cell's footprint over all layers."""
    flat = states.where(F.col("cell").isNotNull()).select("cell", "i", "j", F.lit(0).cast("bigint").alias("k")).distinct()
    return polygons(flat, grid).drop("k")


def shoelace(ring: Column) -> Column:
    """Unsigned area of one closed ring."""
    following = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    crosses = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(crosses, F.lit(0.0), lambda s, v: s + v)) / 2.0


def largest_ring(rings: Column) -> Column:
    """The ring with the largest area."""
    sized = F.transform(rings, lambda r: F.struct(shoelace(r).alias("a"), r.alias("r")))
    return F.array_max(sized)["r"]


def rings_from_vertices(vertices: DataFrame) -> DataFrame:
    """One closed ring per cell from vertex rows in order."""
    point = F.struct("vertex", F.struct("x", "y").alias("p"))
    ring = F.transform(F.array_sort(F.collect_list(point)), lambda v: v["p"])
    return vertices.groupBy("cell_id").agg(ring.alias("ring")).withColumn(
        "ring", F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1))))
