"""Boundary updates in tile passes.

The grid is cut into square tiles (the quads of the grid), coloured like a checkerboard of
four colours.  A pass works on the tiles of one colour, so targets of different tiles never
touch.  In every tile it draws boundary edges in hashed order and keeps those whose targets
are not adjacent, up to a quota set by the tile's area; their neighbourhoods and molecules
are then the same whatever the others decide, and are fetched by joins for all proposals at
once.  What proposals of a tile share are the volumes and surfaces of their cells and the
number of edges; these are carried along while the tile decides its proposals in order.

Edges between unlike voxels are a table of their own.  A flip changes the six pairs around
it, so a pass adds those rows and rewrites nothing; an edge is mirrored into the tiles of
both its ends when a pass reads it.  After the last pass the flips are merged into states,
layer shapes and edges once.

A cell that lies in several tiles of one colour is changed by each of them as if the others
stood still; the changes are summed after the pass.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.functions import keyed
from cellgrid.functions.literals import doubles, offset_structs
from cellgrid.functions.offsets import MOORE, VON_NEUMANN
from cellgrid.functions.scalar import ISOPERIMETRIC
from cellgrid.operators.grid import VOXEL, Grid, in_grid, shift, tile_of
from cellgrid.operators.initial import STATE, mismatch_edges
from cellgrid.operators.skew import no_match, shuffled
from cellgrid.options import Options
from cellgrid.plans.morphology import TARGET, articulates, count_gain, layer_changes, merge_flips, tallies
from cellgrid.plans.state import ModelState
from cellgrid.session import materialize

COLOURS = 4
PAIR = [f"{s}_{c}" for s in "ab" for c in VOXEL]
EDGE = [*PAIR, "cell_a", "cell_b"]
_TILE = ["tu", "tv"]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def changed_edges(flips: DataFrame) -> DataFrame:
    """The six voxel pairs around each flip (``around``: the neighbours' cells, -1 for background, NULL outside the grid) as they are after it."""
    rows = flips.select(*TARGET, F.col("prop").alias("own"), F.explode(F.arrays_zip(offset_structs(VON_NEUMANN).alias("d"), F.col("around").alias("cell"))).alias("n")).where("n.cell IS NOT NULL")
    other = F.when(F.col("n.cell") >= 0, F.col("n.cell"))
    ahead = F.col("n.d.di") + F.col("n.d.dj") + F.col("n.d.dk") > 0
    here = {c: F.col(f"t{c}") for c in VOXEL}
    there = {c: F.col(f"t{c}") + F.col(f"n.d.d{c}") for c in VOXEL}
    pick = lambda x, y: F.when(ahead, x).otherwise(y)
    return rows.select(
        *[pick(here[c], there[c]).alias(f"a_{c}") for c in VOXEL], *[pick(there[c], here[c]).alias(f"b_{c}") for c in VOXEL],
        pick(F.col("own"), other).alias("cell_a"), pick(other, F.col("own")).alias("cell_b"),
    )


def _versions(edges: DataFrame, flips: list[DataFrame]) -> DataFrame:
    """Edges and all later rows of their pairs, numbered by pass."""
    parts = [edges.select(*EDGE, F.lit(-1).alias("version"))]
    return _union(parts + [changed_edges(f).select(*EDGE, F.lit(n).alias("version")) for n, f in enumerate(flips)])


def merged_edges(edges: DataFrame, flips: list[DataFrame]) -> DataFrame:
    """The edge table after the flips."""
    last = _versions(edges, flips).groupBy(*PAIR).agg(F.max(F.struct("version", "cell_a", "cell_b")).alias("e"))
    return last.select(*PAIR, "e.cell_a", "e.cell_b").where(~F.col("cell_a").eqNullSafe(F.col("cell_b")))


def mirrored(rows: DataFrame, grid: Grid) -> DataFrame:
    """Edge rows once for each tile that an end lies in."""
    q = grid.quad
    tiles = [F.struct(tile_of(F.col(f"{s}_i"), q).alias("tu"), tile_of(F.col(f"{s}_j"), q).alias("tv")) for s in "ab"]
    return rows.select("*", F.explode(F.array_distinct(F.array(*tiles))).alias("t")).select(*rows.columns, "t.tu", "t.tv")


def _colour() -> Column:
    return 2 * F.pmod(F.col("tu"), F.lit(2)) + F.pmod(F.col("tv"), F.lit(2))


def _draw(grid: Grid, quota: int):
    """Per tile: edges in hashed order whose targets lie in the tile and are not adjacent."""
    q, layers = grid.quad, grid.layers

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tu, tv = int(rows["tu"].iat[0]), int(rows["tv"].iat[0])
        rows = rows.sort_values([*PAIR, "version"]).drop_duplicates(PAIR, keep="last")
        rows = rows[rows["cell_a"] != rows["cell_b"]]
        ends = [("b", "a", "h0"), ("a", "b", "h1")]
        directed = pd.DataFrame({
            **{f"t{c}": np.concatenate([rows[f"{t}_{c}"] for t, _, _ in ends]) for c in VOXEL},
            "cur": np.concatenate([rows[f"cell_{t}"] for t, _, _ in ends]), "src": np.concatenate([rows[f"cell_{s}"] for _, s, _ in ends]),
            "h": np.concatenate([rows[h] for _, _, h in ends]), "held": np.concatenate([rows["held"]] * 2),
        })
        inside = (directed["ti"] // q == tu) & (directed["tj"] // q == tv) & ~directed["held"].astype(bool)
        directed = directed[inside].sort_values(["h", *TARGET])
        taken = np.zeros((q + 2, q + 2, layers + 2), bool)
        at = np.stack([directed["ti"] - tu * q, directed["tj"] - tv * q, directed["tk"]], axis=1)
        chosen = []
        for n, (i, j, k) in enumerate(at.tolist()):
            if len(chosen) == quota:
                break
            if not taken[i + 1, j + 1, k + 1]:
                taken[i : i + 3, j : j + 3, k : k + 3] = True
                chosen.append(n)
        out = directed.iloc[chosen].drop(columns="held")
        return out.assign(tu=tu, tv=tv, edges=len(rows))[["tu", "tv", "h", *TARGET, "cur", "src", "edges"]]

    return run


def draw(edges: DataFrame, flips: list[DataFrame], state: ModelState, opts: Options, colour: int) -> DataFrame:
    """Proposals of one colour: tile, h, target, cur, src, prop, edges (of the tile).  Frozen cells are left out before the draw."""
    rows = mirrored(_versions(edges, flips), state.grid).where(_colour() == colour).withColumn("held", F.lit(False))
    if state.frozen is not None:
        for c in ("cell_a", "cell_b"):
            cold = state.frozen.select(F.col("cell").alias("_c"), F.lit(True).alias("cold"))
            rows = rows.withColumn("_c", no_match(F.col(c), *PAIR)).join(cold, "_c", "left").withColumn("held", F.col("held") | F.coalesce("cold", F.lit(False))).drop("_c", "cold")
    key = [F.xxhash64(F.lit(opts.seed).cast("bigint"), F.lit(state.iteration).cast("bigint"), *PAIR, F.lit(w)).alias(f"h{w}") for w in (0, 1)]
    rows = rows.select(*_TILE, *PAIR, *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("cell_a", "cell_b")], "version", "held", *key)
    quota = max(1, opts.morphology_steps_per_iter // COLOURS)
    drawn = rows.groupBy(*_TILE).applyInPandas(_draw(state.grid, quota), "tu long, tv long, h long, ti long, tj long, tk long, cur long, src long, edges long")
    for c in ("cur", "src"):
        drawn = drawn.withColumn(c, F.when(F.col(c) >= 0, F.col(c)))
    fresh = F.col("src").isNotNull() & (keyed.uniform(F.col("h"), 1) < F.lit(opts.ab_nihlo_bubble_prob))
    drawn = drawn.withColumn("prop", F.when(~fresh, F.col("src")))
    return drawn.where(~F.col("cur").eqNullSafe(F.col("prop")))


def surroundings(proposals: DataFrame, states: DataFrame, flips: list[DataFrame], grid: Grid) -> DataFrame:
    """``proposals`` with tallies of like neighbours, the target's prior, and the cells of its six neighbours."""
    keep = [c for c in proposals.columns if c not in TARGET]
    marked = proposals.select(*[F.col(t).alias(v) for t, v in zip(TARGET, VOXEL, strict=True)], *TARGET, *keep)
    got = shift(marked, [(0, 0, 0), *MOORE]).where(in_grid(grid)).join(shuffled(states.select(*STATE)), VOXEL, "left")
    if flips:
        moved = _union([f.select(*[F.col(t).alias(v) for t, v in zip(TARGET, VOXEL, strict=True)], F.col("prop").alias("to"), F.lit(True).alias("flipped")) for f in flips])
        got = got.join(moved, VOXEL, "left").withColumn("cell", F.when(F.col("flipped"), F.col("to")).otherwise(F.col("cell")))
    at = lambda d: (F.col("di") == d[0]) & (F.col("dj") == d[1]) & (F.col("dk") == d[2])
    around = F.array(*[F.max(F.when(at(d), F.coalesce("cell", F.lit(-1)).cast("bigint"))) for d in VON_NEUMANN])
    return got.groupBy(*TARGET).agg(*[F.max(c).alias(c) for c in keep], *tallies(), around.alias("around"))


def _with_cells(p: DataFrame, state: ModelState, flips: list[DataFrame]) -> DataFrame:
    """Both cells' parameters, and their shapes as of the flips so far."""
    layers = state.layers.select("cell", "k", "volume", "surface")
    if flips:
        layers = _union([layers, *map(layer_changes, flips)]).groupBy("cell", "k").agg(F.sum("volume").alias("volume"), F.sum("surface").alias("surface"))
    totals = layers.groupBy("cell").agg(F.sum("volume").alias("voxels"))
    pick = lambda a: F.element_at(doubles(a), F.col("z") + 1)
    cells = state.cells.join(totals, "cell").select(
        F.col("cell").alias("_c"), "voxels", (F.col("scale") * F.col("phi_sum")).alias("pull"), pick(state.components.mu).alias("mu"), pick(state.components.sigma).alias("sigma"))
    shapes = layers.select(F.col("cell").alias("_c"), F.col("k").alias("tk"), "volume", "surface")
    for side in ("cur", "prop"):
        named = lambda df, keys, side=side: df.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in keys])
        p = p.withColumn("_c", no_match(F.col(side), *TARGET)).join(named(cells, ["_c"]), "_c", "left").join(named(shapes, ["_c", "tk"]), ["_c", "tk"], "left").drop("_c")
    zero = [f"{c}_{s}" for s in ("cur", "prop") for c in ("voxels", "volume", "surface", "pull", "mu", "sigma")]
    return p.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zero})


def _compactness(surface: float, volume: float, sigma: float) -> float:
    if volume <= 0:
        return 0.0
    return -math.log(max(1.0, surface * surface / (ISOPERIMETRIC * volume))) ** 2 / (2.0 * sigma * sigma)


def _decide(grid: Grid, opts: Options, temperature: float):
    """Per tile: the proposals' scores in hashed order, each after the accepted ones before it."""
    unit, sigma, bubble = grid.voxel_volume, opts.cell_compactness, opts.ab_nihlo_bubble_prob

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", *TARGET]).reset_index(drop=True)
        voxels: dict[int, float] = {}
        floor: dict[int, float] = {}
        shape: dict[tuple[int, int], list[float]] = {}
        for side in ("cur", "prop"):
            for c, k, v, a, s in zip(rows[side].tolist(), rows["tk"].tolist(), rows[f"voxels_{side}"].tolist(), rows[f"volume_{side}"].tolist(), rows[f"surface_{side}"].tolist(), strict=True):
                voxels[c] = v
                # a cell that may reach other tiles of this colour keeps most of its voxels, whatever these do
                floor[c] = 1.0 if v <= grid.quad else math.ceil(0.75 * v)
                shape[c, k] = [a, s]
        edges = float(rows["edges"].iat[0])
        delta, score, accepted = np.zeros(len(rows)), np.full(len(rows), np.nan), np.zeros(len(rows), bool)

        def chance(like: int, cell: int, unlike: int, total: float) -> float:
            return ((1.0 - bubble) * like + (bubble * unlike if cell < 0 else 0.0)) / (2.0 * max(1.0, total))

        names = ["cur", "prop", "tk", "near", "n_cur", "n_prop", "m_cur", "m_prop", "local", "logu", "split", "pull_cur", "mu_cur", "sigma_cur", "pull_prop", "mu_prop", "sigma_prop"]
        for n, (cur, prop, k, near, n_cur, n_prop, m_cur, m_prop, local, logu, split, *own) in enumerate(zip(*(rows[c].tolist() for c in names), strict=True)):
            d = local
            sides = [(cur, -1, m_cur, own[:3]), (prop, 1, m_prop, own[3:])]
            for cell, step, like, (pull, mu, sd) in sides:
                if cell >= 0:
                    v0, v1 = voxels[cell] * unit, (voxels[cell] + step) * unit
                    l0, l1 = math.log(v0), math.log(max(v1, 1e-12))
                    a, s = shape[cell, k]
                    d += -pull * step * unit + ((l0 - mu) ** 2 - (l1 - mu) ** 2) / (2.0 * sd * sd) + l0 - l1
                    d += _compactness(s + step * (8 - 2 * like), a + step, sigma) - _compactness(s, a, sigma)
            delta[n] = d
            if split or (cur >= 0 and voxels[cur] <= floor[cur]):
                continue
            if temperature >= 1.0:
                forward, backward = chance(n_prop, prop, near - n_cur, edges), chance(n_cur, cur, near - n_prop, edges + n_cur - n_prop)
                if backward <= 0.0:
                    continue
                d += math.log(backward) - math.log(forward)
            else:
                d /= temperature
            score[n] = d
            if logu < d:
                accepted[n] = True
                edges += n_cur - n_prop
                for cell, step, like, _ in sides:
                    if cell >= 0:
                        voxels[cell] += step
                        shape[cell, k][0] += step
                        shape[cell, k][1] += step * (8 - 2 * like)
        return rows[[*_TILE, *TARGET, "cur", "prop", "m_cur", "m_prop", "around"]].assign(place=np.arange(len(rows)), delta=delta, score=score, accepted=accepted)

    return run


def evaluate(proposals: DataFrame, state: ModelState, opts: Options, temperature: float) -> DataFrame:
    """Decided proposals: target, cur, prop, place in the tile's order, delta, score, accepted, around."""
    p = proposals.join(count_gain(proposals, state), TARGET, "left")
    agree = lambda side: F.when(F.col(side).eqNullSafe(F.col("prior_cell")), F.col("log_prior")).otherwise(F.col("log_1m_prior"))
    prior = F.when(F.col("log_prior").isNotNull(), agree("prop") - agree("cur")).otherwise(F.lit(0.0))
    split = F.lit(False)
    if opts.enforce_connectivity:
        split = (F.col("cur").isNotNull() & articulates("mask_cur")) | (F.col("prop").isNotNull() & articulates("mask_prop"))
    p = p.withColumns({"local": prior + F.coalesce("gain", F.lit(0.0)), "split": split, "logu": F.log(keyed.uniform(F.col("h"), 2))})
    p = p.withColumns({c: F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("cur", "prop")})
    decided = p.groupBy(*_TILE).applyInPandas(
        _decide(state.grid, opts, temperature),
        "tu long, tv long, ti long, tj long, tk long, cur long, prop long, m_cur long, m_prop long, around array<long>, place long, delta double, score double, accepted boolean",
    )
    return decided.withColumns({**{c: F.when(F.col(c) >= 0, F.col(c)) for c in ("cur", "prop")}, "score": F.when(~F.isnan("score"), F.col("score"))})


def tile_passes(state: ModelState, opts: Options, temperature: float = 1.0) -> tuple[ModelState, list[DataFrame]]:
    """One pass of each colour; returns the new state and the decided proposals of each pass.

    Writes two tables a pass and three at the end, whatever the number of proposals.
    """
    edges = state.edges if state.edges is not None else materialize(mismatch_edges(state.states, state.grid), "edges")
    flips: list[DataFrame] = []
    decided: list[DataFrame] = []
    for colour in range(COLOURS):
        proposals = surroundings(draw(edges, flips, state, opts, colour), state.states, flips, state.grid)
        proposals = materialize(_with_cells(proposals, state, flips), "proposals")
        decided.append(materialize(evaluate(proposals, state, opts, temperature), "decided"))
        flips.append(decided[-1].where("accepted"))
    every = _union(flips)
    layers = _union([state.layers.select("cell", "k", "volume", "surface"), layer_changes(every)]).groupBy("cell", "k").agg(
        F.sum("volume").alias("volume"), F.sum("surface").alias("surface")).where("volume > 0")
    return replace(
        state, states=materialize(merge_flips(state.states, every), "states"), layers=materialize(layers, "layers"),
        edges=materialize(merged_edges(edges, flips), "edges"),
    ), decided
