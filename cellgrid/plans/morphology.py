"""Metropolis-Hastings updates of cell boundaries as DataFrame sweeps.

A sweep picks boundary edges by hashed priority. Each cell keeps its first
edge, and an edge is proposed only if it is first for both of its cells, so
the proposals of a sweep touch disjoint cells and are all evaluated against
the same state. That is at most one voxel per cell and sweep; :mod:`cellgrid.plans.passes`
proposes by area.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cellgrid.functions import keyed
from cellgrid.functions.literals import doubles
from cellgrid.functions.offsets import MOORE
from cellgrid.functions.scalar import dot, halfnormal_logpdf, inverse_isoperimetric_quotient
from cellgrid.operators.grid import VOXEL, Grid, in_grid, shift
from cellgrid.operators.initial import STATE, mismatch_edges
from cellgrid.operators.skew import no_match, shuffled
from cellgrid.options import Options
from cellgrid.plans.state import ModelState
from cellgrid.session import materialize

TARGET = ["ti", "tj", "tk"]
_ADJACENT = np.array([[max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for q in MOORE] for p in MOORE])


@pandas_udf(T.BooleanType())
def articulates(mask: pd.Series) -> pd.Series:
    """Whether removing the centre disconnects the marked ones of its 26 neighbours.

    Bit b of the mask marks neighbour b; neighbours count as connected if a
    path of at most four steps through marked neighbours joins them.
    """
    marks, back = np.unique(mask.to_numpy(dtype=np.int64), return_inverse=True)
    on = ((marks[:, None] >> np.arange(26)) & 1).astype(bool)
    link = (_ADJACENT[None] | np.eye(26, dtype=bool)[None]) & on[:, :, None] & on[:, None, :]
    reach = link.astype(np.int32)
    reach = ((reach @ reach) > 0).astype(np.int32)
    reach = (reach @ reach) > 0
    apart = on[:, :, None] & on[:, None, :] & ~reach
    return pd.Series(apart.any(axis=(1, 2))[back])


def propose(states: DataFrame, grid: Grid, seed: int, stage: Column, bubble: float, frozen: DataFrame | None = None) -> DataFrame:
    """One proposal per selected edge: target voxel, current and proposed cell, edge counts.

    ``e_cur, e_src, e_pair`` are the boundary edges of the target's cell, the
    source's cell, and between the two; the selection probability of an edge
    is one over the directed edges of either cell.
    """
    edges = mismatch_edges(states, grid)
    ends = F.array(
        F.struct(*[F.col(f"b_{c}").alias(f"t{c}") for c in VOXEL], F.col("cell_b").alias("cur"), F.col("cell_a").alias("src"), F.lit(0).alias("way")),
        F.struct(*[F.col(f"a_{c}").alias(f"t{c}") for c in VOXEL], F.col("cell_a").alias("cur"), F.col("cell_b").alias("src"), F.lit(1).alias("way")),
    )
    pos = [F.col(f"{s}_{c}") for s in "ab" for c in VOXEL]
    directed = edges.select(F.array(*pos).alias("at"), F.explode(ends).alias("e")).select("at", "e.*")
    key = F.xxhash64(F.lit(seed).cast("bigint"), stage, "at", "way")
    directed = directed.select(key.alias("h"), *TARGET, "cur", "src")
    # each edge reports to its one or two cells, and to the pair of them
    lo, hi = F.least("cur", "src"), F.greatest("cur", "src")
    owners = F.filter(F.array(
        F.struct(F.col("cur").alias("c1"), F.lit(None).cast("bigint").alias("c2")),
        F.struct(F.col("src").alias("c1"), F.lit(None).cast("bigint").alias("c2")),
        F.struct(F.when(F.col("cur").isNotNull() & F.col("src").isNotNull(), lo).alias("c1"), hi.alias("c2")),
    ), lambda o: o["c1"].isNotNull())
    edge = F.struct("h", *TARGET, "cur", "src")
    first = directed.select(edge.alias("e"), F.explode(owners).alias("o")).groupBy("o.c1", "o.c2").agg(
        F.min("e").alias("e"), (F.count(F.lit(1)) / 2).alias("m")
    )
    own = F.col("c2").isNull()
    chosen = first.groupBy("e").agg(
        F.count(F.when(own, 1)).alias("wins"),
        F.max(F.when(own & F.col("c1").eqNullSafe(F.col("e.cur")), F.col("m"))).alias("e_cur"),
        F.max(F.when(own & F.col("c1").eqNullSafe(F.col("e.src")), F.col("m"))).alias("e_src"),
        F.max(F.when(~own, F.col("m"))).alias("e_pair"),
    )
    needed = F.when(F.col("e.cur").isNotNull(), 1).otherwise(0) + F.when(F.col("e.src").isNotNull(), 1).otherwise(0)
    chosen = chosen.where(F.col("wins") == needed).select("e.*", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("e_cur", "e_src", "e_pair")])
    # two cells may still want the same background voxel: the first keeps it
    rest = ["h", "cur", "src", "e_cur", "e_src", "e_pair"]
    chosen = chosen.groupBy(*TARGET).agg(F.min(F.struct(*rest)).alias("r")).select(*TARGET, "r.*")
    if frozen is not None:
        for c in ("cur", "src"):
            chosen = chosen.join(frozen.select(F.col("cell").alias(c)), c, "left_anti")
    fresh = F.col("src").isNotNull() & (keyed.uniform(F.col("h"), 1) < F.lit(bubble))
    chosen = chosen.withColumn("prop", F.when(~fresh, F.col("src")))
    return chosen.where(~F.col("cur").eqNullSafe(F.col("prop")))


def neighbourhood(proposals: DataFrame, states: DataFrame, grid: Grid) -> DataFrame:
    """Tallies of like neighbours around each target, and the target's own prior."""
    marked = proposals.select(*[F.col(t).alias(v) for t, v in zip(TARGET, VOXEL, strict=True)], *TARGET, "cur", "prop")
    near = shift(marked, [(0, 0, 0), *MOORE]).where(in_grid(grid))
    return near.join(shuffled(states.select(*STATE)), VOXEL, "left").groupBy(*TARGET).agg(*tallies())


def tallies() -> list[Column]:
    """Aggregates over the rows (offset, cell) around a target: like neighbours, masks of them, and the target's own prior."""
    away = F.abs("di") + F.abs("dj") + F.abs("dk")
    is_cur, is_prop = F.col("cell").eqNullSafe(F.col("cur")), F.col("cell").eqNullSafe(F.col("prop"))
    # number of the neighbour in the offset table, which lists a 3 x 3 x 3 cube without its centre
    cube = "((di + 1) * 9 + (dj + 1) * 3 + (dk + 1))"
    bit = F.expr(f"shiftleft(1L, {cube} - CASE WHEN {cube} > 13 THEN 1 ELSE 0 END)")
    near6, flat8, own = away == 1, (away > 0) & (F.col("dk") == 0), away == 0

    def tally(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    return [
        tally(near6).alias("near"), tally(near6 & is_cur).alias("n_cur"), tally(near6 & is_prop).alias("n_prop"),
        tally(near6 & F.col("cell").isNull()).alias("n_bg"),
        tally(flat8 & is_cur).alias("m_cur"), tally(flat8 & is_prop).alias("m_prop"),
        F.sum(F.when(~own & is_cur, bit).otherwise(0)).alias("mask_cur"),
        F.sum(F.when(~own & is_prop, bit).otherwise(0)).alias("mask_prop"),
        F.max(F.when(own, F.col("prior_cell"))).alias("prior_cell"),
        F.max(F.when(own, F.col("log_prior"))).alias("log_prior"),
        F.max(F.when(own, F.col("log_1m_prior"))).alias("log_1m_prior"),
    ]


def count_gain(proposals: DataFrame, state: ModelState) -> DataFrame:
    """Change in count log likelihood if each target's molecules change cell.

    Only the molecules at the targets are looked at: they are laid out twice,
    for the losing and the gaining cell, and meet each cell's factors once in a
    join by cell; the factors are reduced to a rate right there.
    """
    u, h = state.unfactored, max(state.hidden, 1)
    here = state.counts.select(*[F.col(v).alias(t) for t, v in zip(TARGET, VOXEL, strict=True)], "gene", "k0", "density", "n")
    here = here.join(proposals.select(*TARGET, "cur", "prop"), TARGET)
    here = here.groupBy(*TARGET, "cur", "prop", "gene", "k0", "density").agg(F.sum("n").alias("n"))
    sides = F.array(
        F.struct(F.col("cur").alias("cell"), F.lit(-1.0).alias("sign")), F.struct(F.col("prop").alias("cell"), F.lit(1.0).alias("sign"))
    )
    rows = here.select(*TARGET, "gene", "k0", "density", "n", F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    rows = rows.join(state.background(), ["gene", "k0", "density"], "left").join(state.loadings(), "gene")
    own = F.element_at("phi", F.coalesce("slot", F.lit(0)) + 1)
    mixed = dot(F.slice("phi", u + 1, h), F.coalesce("theta", F.array().cast("array<double>")))
    bg = F.coalesce("rate", F.lit(0.0))
    inside = rows.where(F.col("cell").isNotNull()).join(state.cells.select("cell", "phi"), "cell")
    inside = inside.withColumn("lam", F.when(F.col("slot").isNotNull(), own).otherwise(mixed) + bg)
    outside = rows.where(F.col("cell").isNull()).withColumn("lam", bg)
    cols = [*TARGET, "n", "sign", "lam"]
    terms = inside.select(*cols).unionByName(outside.select(*cols))
    gain = F.col("sign") * F.col("n") * F.log(F.greatest("lam", F.lit(1e-30)))
    return terms.groupBy(*TARGET).agg(F.round(F.sum(gain), 9).alias("gain"))


def _cell_terms(side: str, change: int, like: str, grid: Grid, sigma_iiq: float) -> Column:
    """Exposure, volume and compactness terms when a cell loses (-1) or gains (+1) the target."""
    c = {n: F.col(f"{n}_{side}") for n in ("voxels", "volume", "surface", "scale", "phi_sum", "mu", "sigma")}
    vv = grid.voxel_volume
    v0, v1 = c["voxels"] * F.lit(vv), (c["voxels"] + change) * F.lit(vv)
    l0, l1 = F.log(v0), F.log(F.greatest(v1, F.lit(1e-12)))
    turned = 8 - 2 * F.col(like)  # faces gained on joining, lost on leaving
    s1, a1 = c["surface"] + change * turned, c["volume"] + change
    shape = halfnormal_logpdf(sigma_iiq, inverse_isoperimetric_quotient(s1, a1)) - halfnormal_logpdf(
        sigma_iiq, inverse_isoperimetric_quotient(c["surface"], c["volume"]))
    norm = ((l0 - c["mu"]) ** 2 - (l1 - c["mu"]) ** 2) / (F.lit(2.0) * c["sigma"] ** 2) + l0 - l1
    return -c["scale"] * F.lit(float(change) * vv) * c["phi_sum"] + norm + shape


def evaluate(proposals: DataFrame, state: ModelState, opts: Options, temperature: float) -> DataFrame:
    """Log acceptance ratio of every proposal."""
    totals = state.layers.groupBy("cell").agg(F.sum("volume").alias("voxels"))
    comp = state.components
    pick = lambda a: F.element_at(doubles(a), F.col("z") + 1)
    cells = state.cells.join(totals, "cell").select(
        "cell", "voxels", "scale", "phi_sum",
        pick(comp.mu).alias("mu"), pick(comp.sigma).alias("sigma"),
    )
    p = proposals.join(neighbourhood(proposals, state.states, state.grid), TARGET)
    for side in ("cur", "prop"):
        # about half of all proposals have background on one side
        p = p.withColumn("_c", no_match(F.col(side), *TARGET))
        p = p.join(cells.select(*[F.col(c).alias("_c" if c == "cell" else f"{c}_{side}") for c in cells.columns]), "_c", "left")
        layer = state.layers.select(
            F.col("cell").alias("_c"), F.col("k").alias("tk"), F.col("volume").alias(f"volume_{side}"), F.col("surface").alias(f"surface_{side}"))
        p = p.join(layer, ["_c", "tk"], "left").drop("_c")
        p = p.withColumns({f"{c}_{side}": F.coalesce(f"{c}_{side}", F.lit(0)) for c in ("volume", "surface")})
    p = materialize(p, "proposals")
    p = p.join(count_gain(p, state), TARGET, "left")

    has_prior = F.col("log_prior").isNotNull()
    agree = lambda side: F.when(F.col(side).eqNullSafe(F.col("prior_cell")), F.col("log_prior")).otherwise(F.col("log_1m_prior"))
    delta = F.when(has_prior, agree("prop") - agree("cur")).otherwise(F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))
    delta = delta + F.when(F.col("cur").isNotNull(), _cell_terms("cur", -1, "m_cur", state.grid, opts.cell_compactness)).otherwise(F.lit(0.0))
    delta = delta + F.when(F.col("prop").isNotNull(), _cell_terms("prop", 1, "m_prop", state.grid, opts.cell_compactness)).otherwise(F.lit(0.0))

    # edges of either cell before and after the flip
    b = F.lit(opts.ab_nihlo_bubble_prob)
    e_prop = F.when(F.col("prop").isNotNull(), F.col("e_src")).otherwise(F.lit(0.0))
    pair = F.when(F.col("prop").isNotNull(), F.col("e_pair")).otherwise(F.lit(0.0))
    before = F.col("e_cur") + e_prop - pair
    lost = F.when(F.col("cur").isNotNull(), F.col("near") - F.col("n_cur")).otherwise(F.col("n_prop"))
    gained = F.when(F.col("prop").isNotNull(), F.col("near") - F.col("n_prop")).otherwise(F.col("n_cur"))
    after = F.greatest(F.lit(1.0), before - lost + gained)

    def chance(like: str, cell: str, other: str, total: Column) -> Column:
        direct = (1.0 - b) * F.col(like)
        return F.when(F.col(cell).isNotNull(), direct).otherwise(direct + b * (F.col("near") - F.col(other))) / (2.0 * total)

    forward = chance("n_prop", "prop", "n_cur", F.greatest(F.lit(1.0), before))
    backward = chance("n_cur", "cur", "n_prop", after)
    log_ratio = F.when(backward > 0, F.log(F.greatest(backward, F.lit(1e-300))) - F.log(F.greatest(forward, F.lit(1e-300))))
    score = delta + log_ratio if temperature >= 1.0 else delta / F.lit(temperature)
    # a cell never gives up its last voxel
    possible = F.col("cur").isNull() | (F.col("voxels_cur") > 1)
    p = p.withColumn("delta", delta).withColumn("score", F.when(possible, score))
    if opts.enforce_connectivity:
        split = (F.col("cur").isNotNull() & articulates("mask_cur")) | (F.col("prop").isNotNull() & articulates("mask_prop"))
        p = p.withColumn("score", F.when(~split, F.col("score")))
    return p


def apply_moves(state: ModelState, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New voxel states and layer shapes after the accepted flips."""
    layers = state.layers.unionByName(layer_changes(accepted)).groupBy("cell", "k").agg(
        F.sum("volume").alias("volume"), F.sum("surface").alias("surface")).where("volume > 0")
    return merge_flips(state.states, accepted), layers


def merge_flips(states: DataFrame, accepted: DataFrame) -> DataFrame:
    """Voxel states after the accepted flips."""
    own = states.select(*STATE, F.lit(None).cast("bigint").alias("to"), F.lit(0).alias("moved"))
    flips = accepted.select(
        *[F.col(t).alias(v) for t, v in zip(TARGET, VOXEL, strict=True)], F.lit(None).cast("bigint").alias("cell"),
        F.lit(None).cast("bigint").alias("prior_cell"), F.lit(None).cast("double").alias("log_prior"),
        F.lit(None).cast("double").alias("log_1m_prior"), F.col("prop").alias("to"), F.lit(1).alias("moved"),
    )
    return own.unionByName(flips).groupBy(*VOXEL).agg(
        F.when(F.max("moved") == 1, F.max("to")).otherwise(F.max("cell")).alias("cell"),
        *[F.max(c).alias(c) for c in ("prior_cell", "log_prior", "log_1m_prior")],
    ).where("cell IS NOT NULL OR log_prior IS NOT NULL")


def layer_changes(accepted: DataFrame) -> DataFrame:
    """(cell, k, volume, surface): what each flip adds to the shapes of its two cells."""
    side = F.array(
        F.struct(F.col("cur").alias("cell"), F.lit(-1).alias("dv"), (2 * F.col("m_cur") - 8).alias("ds")),
        F.struct(F.col("prop").alias("cell"), F.lit(1).alias("dv"), (8 - 2 * F.col("m_prop")).alias("ds")),
    )
    return accepted.select(F.col("tk").alias("k"), F.explode(side).alias("s")).where("s.cell IS NOT NULL").select(
        "s.cell", "k", F.col("s.dv").cast("bigint").alias("volume"), F.col("s.ds").cast("bigint").alias("surface"))


def sweep(state: ModelState, opts: Options, number: int, temperature: float = 1.0) -> tuple[ModelState, DataFrame]:
    """One round of proposals; returns the new state and the accepted flips."""
    stage = F.xxhash64(F.lit(state.iteration).cast("bigint"), F.lit(number).cast("bigint"))
    proposals = materialize(propose(state.states, state.grid, opts.seed, stage, opts.ab_nihlo_bubble_prob, state.frozen), "chosen")
    scored = evaluate(proposals, state, opts, temperature)
    accepted = scored.where(F.log(keyed.uniform(F.col("h"), 2)) < F.col("score"))
    accepted = materialize(accepted.select(*TARGET, "cur", "prop", "m_cur", "m_prop", "delta", "score"), "accepted")
    states, layers = apply_moves(state, accepted)
    return replace(state, edges=None, states=materialize(states, "states"), layers=materialize(layers, "layers")), accepted


def flip_transitions(state: ModelState, accepted: DataFrame) -> DataFrame:
    """Molecules carried from cell to cell by accepted flips."""
    mols = state.counts.groupBy(*VOXEL).agg(F.sum("n").alias("n"))
    at = accepted.select(*[F.col(t).alias(v) for t, v in zip(TARGET, VOXEL, strict=True)], F.col("cur").alias("from_cell"), F.col("prop").alias("to_cell"))
    return at.where("from_cell IS NOT NULL AND to_cell IS NOT NULL").join(mols, VOXEL).groupBy("from_cell", "to_cell").agg(F.sum("n").alias("n"))
