"""The segmentation run: prepare, initialise, burn in, refine, sample, derive results."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.operators import density, initial, measures, prep, results
from cellgrid.operators.grid import Grid, grid_for, voxel_counts, voxelize
from cellgrid.options import Options
from cellgrid.plans import expectations, gibbs, morphology, passes, repositioning
from cellgrid.plans.consistency import census, check_consistency
from cellgrid.plans.state import Components, Metrics, ModelState
from cellgrid.session import Scratch, materialize

StatesFn = Callable[[DataFrame, Grid], DataFrame]


@dataclass(frozen=True)
class Result:
    """Final tables; ``cells`` maps dense ids to original ones."""

    state: ModelState
    transcripts: DataFrame
    voxelized: DataFrame
    index: DataFrame
    genes: DataFrame
    expected: DataFrame | None
    transitions: DataFrame | None
    metrics: tuple[Metrics, ...] = ()  # one for each iteration


def prepare(transcripts: DataFrame, opts: Options) -> DataFrame:
    """Drop transcripts far from any cell and normalise depth."""
    t = materialize(transcripts, "input")  # read several times below; the source is read once
    has_cells = not t.where(F.col("cell").isNotNull()).isEmpty() if "cell" in t.columns else False
    if has_cells:
        huge = prep.nuclei_population(t).where("too_large").take(1)
        if huge:
            warnings.warn(f"nucleus {huge[0]['nucleus']} has {huge[0]['n']} transcripts; are cell ids unique across fields of view?", stacklevel=2)
        # depth is ranked in several passes; the distance join runs once
        t = materialize(prep.drop_cellfree(t, opts.max_transcript_nucleus_distance), "near")
    t = t.withColumn("z", F.lit(0.0)) if opts.ignore_z_coord else prep.normalize_z(t)
    return materialize(prep.cluster_spatially(t), "transcripts")


def layers_for(transcripts: DataFrame, opts: Options) -> int:
    span = transcripts.agg(F.min("z"), F.max("z")).first()
    return 1 if span[0] == span[1] else opts.voxel_layers


def clean(states: DataFrame, grid: Grid, opts: Options, frozen: DataFrame | None) -> DataFrame:
    """Expansion, vertical growth and bubble filling, in that order."""
    s = initial.expand_cells(states, grid, opts.expand_initialized_cells, lottery=True, frozen=frozen)
    s = initial.expand_vertically(s, grid, lottery=True)
    return initial.pop_bubbles(s, grid)


def count_tables(transcripts: DataFrame, grid: Grid, opts: Options) -> tuple[DataFrame, DataFrame]:
    """Voxel counts with origin layer and density, and the density bins."""
    v = voxelize(transcripts, grid)
    binned = materialize(density.density_bins(density.local_density(v, grid, opts.density_bandwidth), opts.density_bins), "bins")
    counts = materialize(density.attach_origin(voxel_counts(v), binned), "counts")
    return counts, binned


def initialize(transcripts: DataFrame, opts: Options, states_fn: StatesFn | None = None) -> tuple[ModelState, DataFrame]:
    """Starting state and the index of the cells in it."""
    grid = grid_for(transcripts, opts.first_voxel_size, layers_for(transcripts, opts), opts.quad_size)
    counts, binned = count_tables(transcripts, grid, opts)
    if states_fn is None:
        keyed = initial.states_from_assignments(voxelize(transcripts, grid), opts.nuclear_reassignment_prob, opts.prior_seg_reassignment_prob)
    else:
        keyed = states_fn(transcripts, grid)
    keyed = materialize(keyed, "keyed")
    index = materialize(initial.used_cells(keyed), "index")
    frozen = None
    if "frozen" in keyed.columns:
        ids = index.withColumnRenamed("cell", "key")
        frozen = keyed.where("frozen").select(F.col("cell").alias("key")).distinct().join(ids, "key").select(F.col("cell_id").alias("cell"))
        frozen = materialize(frozen, "frozen")
    states = materialize(clean(initial.recode_cells(keyed, index), grid, opts, frozen), "states")
    order = prep.unfactored_gene_order(transcripts)
    ngenes = order.count()
    unfactored = ngenes if opts.no_factorization or opts.nunfactored >= ngenes else opts.nunfactored
    hidden = 0 if unfactored == ngenes else opts.nhidden
    base = index.select(F.col("cell_id").alias("cell"))
    assigned = materialize(measures.cell_gene_counts(measures.label_counts(counts, states)), "assigned")
    z = gibbs.initial_components(assigned, base, opts.ncomponents, opts.seed)
    cells = gibbs.initial_phi(z.withColumn("scale", F.lit(1.0)), unfactored + hidden, opts.seed)
    theta = gibbs.initial_theta(order, unfactored, hidden, opts.seed)
    rates = expectations.full_index(counts, grid.layers, opts.density_bins).withColumn("rate", F.lit(0.0))
    state = ModelState(
        grid=grid, states=states, counts=counts, layers=materialize(measures.layer_volume_surface(states, grid), "layers"),
        cells=materialize(cells, "cells"), theta=theta, rates=materialize(rates, "rates"),
        region=expectations.volumes(binned, grid), components=Components.start(opts.ncomponents, unfactored + hidden),
        unfactored=unfactored, hidden=hidden, genes=ngenes, bins=opts.density_bins, frozen=frozen,
        census=census(counts) if opts.check_consistency else None,
    )
    return state, index


def refine(
    state: ModelState, transcripts: DataFrame, opts: Options, scale: int, states_fn: StatesFn | None = None, index: DataFrame | None = None
) -> ModelState:
    """Continue on a finer grid; counts return to their observed positions.

    Frozen cells are not upsampled but voted again from their masks.
    """
    if scale == 1:
        return state
    grid = state.grid.finer(scale)
    counts, binned = count_tables(transcripts, grid, opts)
    states = initial.upsample(state.states, scale)
    if state.frozen is not None and states_fn is not None and index is not None:
        loose = materialize(states.join(state.frozen, "cell", "left_anti").select(*initial.STATE), "loose")
        held = initial.recode_cells(states_fn(transcripts, grid).where("frozen"), index).where("cell IS NOT NULL")
        held = held.join(loose.select("i", "j", "k"), ["i", "j", "k"], "left_anti")
        states = initial.expand_vertically(loose.unionByName(held.select(*initial.STATE)), grid, lottery=True, frozen=state.frozen)
    states = materialize(states, "states")
    return replace(
        state, grid=grid, states=states, counts=counts, edges=None, layers=materialize(measures.layer_volume_surface(states, grid), "layers"),
        region=expectations.volumes(binned, grid), census=census(counts) if opts.check_consistency else None,
    )


def iterate(state: ModelState, opts: Options, burnin: bool, temperature: float, record: bool) -> ModelState:
    """One iteration: boundary updates, repositioning, parameters."""
    flows = [] if state.transitions is None else [state.transitions]
    if not opts.sweeps_per_iter:
        previous = state
        state, decided = passes.tile_passes(state, opts, temperature)
        if record:
            flips = union_all([d.where("accepted") for d in decided])
            flows.append(materialize(morphology.flip_transitions(previous, flips), "flips"))
    for n in range(opts.sweeps_per_iter):
        previous = state
        state, accepted = morphology.sweep(state, opts, n, temperature)
        if record:
            flows.append(materialize(morphology.flip_transitions(previous, accepted), "flips"))
    if not burnin and not opts.no_diffusion:
        state, moved = repositioning.reposition(state, opts)
        if record:
            flows.append(materialize(moved, "flows"))
    state = gibbs.gibbs_step(state, opts, burnin)
    if opts.check_consistency:
        check_consistency(state)
    if not record:
        return state
    sums = state.foreground if state.expected is None else state.expected.unionByName(state.foreground)
    return replace(
        state, recorded=state.recorded + 1,
        expected=materialize(sums.groupBy("cell", "gene").agg(F.sum("n").alias("n")), "expected"),
        transitions=materialize(union_all(flows).groupBy("from_cell", "to_cell").agg(F.sum("n").alias("n")), "transitions"),
    )


def segment(transcripts: DataFrame, opts: Options, states_fn: StatesFn | None = None) -> Result:
    """Run the whole schedule on canonical transcripts.

    After every iteration the tables of the previous one are deleted, so the
    shared folder holds about two generations of the state.
    """
    with Scratch(transcripts.sparkSession) as scratch:
        return _segment(transcripts, opts, states_fn, scratch)


def _segment(transcripts: DataFrame, opts: Options, states_fn: StatesFn | None, scratch: Scratch) -> Result:
    t = prepare(transcripts, opts)
    state, index = initialize(t, opts, states_fn)

    def settle(s: ModelState) -> ModelState:
        scratch.release([t, index, *s.frames()])
        return s

    for _ in range(opts.init_iterations):
        state = settle(gibbs.gibbs_step(state, opts, burnin=True, sample_z=False))
    for _ in range(opts.burnin_samples):
        state = settle(iterate(state, opts, True, 1.0, False))
    state = settle(refine(state, t, opts, opts.resolution_scale, states_fn, index))
    cooling = math.exp(math.log(0.01) / max(1, opts.cooling_iters or opts.burnin_samples))
    temperature = 1.0
    for it in range(opts.samples + opts.hillclimb):
        if it > opts.samples:
            temperature *= cooling
        record = opts.samples - opts.recorded_samples <= it < opts.samples
        state = settle(iterate(state, opts, False, temperature, record))
    if state.foreground is None:
        state = gibbs.gibbs_step(state, opts, burnin=False)
    expected = measures.running_mean(state.expected, ["cell", "gene"], state.recorded) if state.expected is not None else None
    return Result(state, t, voxelize(t, state.grid), index, prep.gene_dictionary(t), expected, state.transitions, state.metrics)


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# -- result tables --------------------------------------------------------------
def result_transcripts(r: Result) -> DataFrame:
    lab = materialize(measures.label_counts(r.state.counts, r.state.states), "labelled")
    budget = r.state.foreground.withColumnRenamed("n", "n_fg")
    return results.transcript_metadata(r.voxelized, results.split_foreground(lab, budget), r.state.grid)


def result_cells(r: Result) -> DataFrame:
    ids = r.index.select(F.col("cell_id").alias("cell"), F.col("cell").alias("original_cell_id"))
    cells = r.state.cells.select("cell", F.col("z").alias("cluster"), "scale").join(ids, "cell")
    return results.cell_metadata(r.state.states, measures.volume_surface(r.state.layers), r.state.grid, cells)


def result_genes(r: Result, bins: int) -> DataFrame:
    expected = r.expected if r.expected is not None else r.state.foreground.select("cell", "gene", F.col("n").cast("double").alias("mean"))
    return results.gene_metadata(r.transcripts, expected, r.state.rates, r.state.grid.layers, bins)


def metagene_rates(r: Result) -> DataFrame:
    """Cell factors as columns ``phi0, phi1, ...``."""
    return r.state.cells.select("cell", *[F.col("phi")[k].alias(f"phi{k}") for k in range(r.state.latents)])


def metagene_loadings(r: Result) -> DataFrame:
    """Gene loadings as columns ``theta0, theta1, ...``."""
    u = r.state.unfactored
    own = [F.when(F.col("slot") == k, 1.0).otherwise(0.0).alias(f"theta{k}") for k in range(u)]
    mixed = [F.coalesce(F.try_element_at("theta", F.lit(k + 1)), F.lit(0.0)).alias(f"theta{u + k}") for k in range(r.state.hidden)]
    return r.state.theta.select("gene", *own, *mixed)
