"""Transcript repositioning: molecules propose to move to nearby voxels."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from cellgrid.functions import keyed, variates
from cellgrid.functions.diffusion import EPS, displacement_probs, mirrored
from cellgrid.functions.literals import doubles
from cellgrid.functions.scalar import dot
from cellgrid.operators.grid import VOXEL, Grid, tile_of
from cellgrid.operators.measures import COUNT_KEY, label_counts, merge_deltas, transitions
from cellgrid.operators.skew import no_match, shuffled
from cellgrid.options import Options
from cellgrid.plans.gibbs import binomial_udf
from cellgrid.plans.state import ModelState
from cellgrid.session import materialize

OFFSET = ["di", "dj", "dk"]


def _lookup(probs: list[float], d: Column) -> Column:
    return F.coalesce(F.try_element_at(doubles(probs), F.abs(d).cast("int") + 1), F.lit(EPS))


def distance_prior(opts: Options, grid: Grid, di: Column, dj: Column, dk: Column) -> Column:
    """Prior of a total offset: near or far blur in the plane, one blur in depth."""
    near = displacement_probs(grid.voxel_size, opts.sigma_near)
    far = displacement_probs(grid.voxel_size, opts.sigma_far)
    deep = displacement_probs(grid.voxel_size_z, opts.diffusion_sigma_z)
    p = opts.diffusion_probability
    plane = F.lit(p) * _lookup(far, di) * _lookup(far, dj) + F.lit(1.0 - p) * _lookup(near, di) * _lookup(near, dj)
    return _lookup(deep, dk) * plane


def _split(probs: list[float]):
    """Arrow function that shares ``n`` molecules out over the displacements of ``probs``."""
    half = len(probs) // 2
    kind = T.ArrayType(T.StructType([T.StructField("d", T.LongType()), T.StructField("m", T.LongType())]))

    def run(key: pa.Array, n: pa.Array) -> pa.Array:
        w = np.broadcast_to(np.asarray(probs), (len(n), len(probs)))
        shares = variates.multinomial(variates.stream(key.to_numpy(zero_copy_only=False), 0), n.to_numpy(zero_copy_only=False), w)
        row, k = np.nonzero(shares)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(n)))])
        parts = pa.StructArray.from_arrays([pa.array(k - half, pa.int64()), pa.array(shares[row, k], pa.int64())], ["d", "m"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)

    return arrow_udf(run, kind)


def propose_moves(labelled: DataFrame, grid: Grid, opts: Options, iteration: int) -> DataFrame:
    """Draw displacements for all molecules and count equal ones: ``mi, mj, mk, m``.

    Each entry is split axis by axis with multinomials, so its cost does not
    grow with its size. ``labelled`` has a row per entry, so its shares are
    counted already and nothing is shuffled.
    """
    plane = mirrored(displacement_probs(grid.voxel_size, opts.diffusion_proposal_sigma))
    deep = mirrored(displacement_probs(grid.voxel_size_z, opts.diffusion_proposal_sigma_z))
    moved, done = labelled.select(*COUNT_KEY, "cell", F.col("n").alias("m")), []
    for axis, probs in (("mk", deep), ("mj", plane), ("mi", plane)):
        at = keyed.row_key(opts.seed, iteration, F.lit(f"split {axis}"), *COUNT_KEY, *done)
        # an outer explode, as Spark looks for empty arrays before an inner one, by a second call
        moved = moved.withColumn("s", _split(probs)(at, F.col("m"))).drop("m").withColumn("s", F.explode_outer("s")).where("s IS NOT NULL")
        moved = moved.select(*COUNT_KEY, "cell", *done, F.col("s.d").alias(axis), F.col("s.m").alias("m"))
        done.append(axis)
    moved = moved.where("mi <> 0 OR mj <> 0 OR mk <> 0")
    return moved.where((F.col("i") + F.col("mi") >= 0) & (F.col("j") + F.col("mj") >= 0) & (F.col("k") + F.col("mk")).between(0, grid.layers - 1))


def _rate(phi: str, unfactored: int, hidden: int) -> Column:
    own = F.element_at(phi, F.coalesce("slot", F.lit(0)) + 1)
    mixed = dot(F.slice(phi, unfactored + 1, max(hidden, 1)), F.coalesce("theta", F.array().cast("array<double>")))
    return F.when(F.col(phi).isNull(), F.lit(0.0)).when(F.col("slot").isNotNull(), own).otherwise(mixed)


def score_moves(moves: DataFrame, state: ModelState, opts: Options) -> DataFrame:
    """Destination cell and acceptance probability of each group of moves."""
    q = state.grid.quad
    quads = state.counts.select("i", "j").unionByName(state.states.select("i", "j")).select(
        tile_of(F.col("i"), q).alias("qu"), tile_of(F.col("j"), q).alias("qv")).distinct()
    dest = state.states.where("cell IS NOT NULL").select(
        (F.col("i")).alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"), F.col("cell").alias("to_cell"))
    m = moves.withColumns({f"n{v}": F.col(v) + F.col(f"m{v}") for v in VOXEL})
    m = m.withColumns({"qu": tile_of(F.col("ni"), q), "qv": tile_of(F.col("nj"), q)}).join(quads, ["qu", "qv"], "left_semi").drop("qu", "qv")
    m = materialize(m.join(shuffled(dest), ["ni", "nj", "nk"], "left"), "proposed")  # drawn once, read three times below
    phi = state.cells.select("cell", "phi")
    # rate of every (cell, gene) that some move starts from or ends in, computed once
    pairs = m.select("cell", "gene").unionByName(m.select(F.col("to_cell").alias("cell"), "gene")).where("cell IS NOT NULL").distinct()
    lam = pairs.join(phi, "cell").join(state.loadings(), "gene").select("cell", "gene", _rate("phi", state.unfactored, state.hidden).alias("lam"))
    lam = materialize(lam, "rates")
    for cell, rate in (("cell", "lam_from"), ("to_cell", "lam_to")):  # background has no cell and no rate
        m = m.withColumn("_c", no_match(F.col(cell), *VOXEL, "mi", "mj", "mk"))
        m = m.join(shuffled(lam.select(F.col("cell").alias("_c"), "gene", F.col("lam").alias(rate))), ["_c", "gene"], "left").drop("_c")
    m = m.join(state.background(), ["gene", "k0", "density"], "left")
    bg = F.coalesce("rate", F.lit(0.0))
    now = distance_prior(opts, state.grid, *[F.col(c) for c in OFFSET]) * (F.coalesce("lam_from", F.lit(0.0)) + bg)
    then = distance_prior(opts, state.grid, *[F.col(f"d{v}") + F.col(f"m{v}") for v in VOXEL]) * (F.coalesce("lam_to", F.lit(0.0)) + bg)
    return m.withColumn("p", F.least(F.lit(1.0), F.coalesce(F.try_divide(then, now), F.lit(1.0))))


def reposition(state: ModelState, opts: Options) -> tuple[ModelState, DataFrame]:
    """Move molecules; returns the new state and transitions between cells."""
    it = state.iteration
    lab = label_counts(state.counts, state.states)
    scored = score_moves(propose_moves(lab, state.grid, opts, it), state, opts)
    key = keyed.row_key(opts.seed, it, F.lit("accept"), *COUNT_KEY, "mi", "mj", "mk")
    done = scored.withColumn("n", binomial_udf(key, F.col("m"), F.col("p"))).where("n > 0")
    done = materialize(done.select(*COUNT_KEY, "mi", "mj", "mk", F.col("cell").alias("from_cell"), "to_cell", "n"), "moves")
    leave = done.withColumn("n", -F.col("n"))
    arrive = done.withColumns({**{v: F.col(v) + F.col(f"m{v}") for v in VOXEL}, **{f"d{v}": F.col(f"d{v}") + F.col(f"m{v}") for v in VOXEL}})
    counts = merge_deltas(state.counts, leave.select(*COUNT_KEY, "n").unionByName(arrive.select(*COUNT_KEY, "n")))
    return replace(state, counts=materialize(counts, "counts")), transitions(done)
