"""Tile passes: scores against full recomputation, kept edges, quotas, metrics and consistency."""

import math
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cellgrid.operators.initial import mismatch_edges
from cellgrid.operators.measures import cell_gene_counts, label_counts, unassigned_counts
from cellgrid.plans import consistency, gibbs, passes, segment
from test_model import _total


@pytest.fixture(scope="module")
def tiled(small):
    """The small model on tiles of nine voxels, so that every colour has several."""
    opts, t, state, _ = small
    opts = replace(opts, sweeps_per_iter=0, morphology_steps_per_iter=160, cell_compactness=5.0)
    # equal rates in all cells, so that many flips are accepted
    cells = state.cells.withColumns({"phi": F.transform("phi", lambda _: F.lit(0.02)), "phi_sum": F.lit(0.02 * state.latents)})
    return opts, t, replace(state, cells=cells, grid=replace(state.grid, quad=9), census=consistency.census(state.counts))


@pytest.fixture(scope="module")
def passed(tiled):
    opts, _, state = tiled
    after, decided = passes.tile_passes(state, opts)
    return after, [d.orderBy("tu", "tv", "place").collect() for d in decided]


def rows_of(state, columns):
    return sorted(map(tuple, state.select(*columns).collect()), key=str)


def test_scores_equal_full_recomputation(tiled, passed):
    opts, _, state = tiled
    cells = {(r.i, r.j, r.k): r.cell for r in state.states.collect()}
    priors = {(r.i, r.j, r.k): (r.prior_cell, r.log_prior, r.log_1m_prior) for r in state.states.where("log_prior IS NOT NULL").collect()}
    mols = defaultdict(list)
    for r in state.counts.collect():
        mols[(r.i, r.j, r.k)].append((r.gene, r.k0, r.density, r.n))
    known = state.cells.collect()
    phi, scale, z = ({r.cell: r[k] for r in known} for k in ("phi", "scale", "z"))
    theta = {r.gene: (r.slot, r.theta) for r in state.theta.collect()}
    rates = {(r.gene, r.k0, r.density): r.rate for r in state.rates.collect()}
    args = (state, opts, mols, phi, scale, z, theta, rates, priors)
    checked = flips = 0
    for decided in passed[1]:
        tiles = defaultdict(list)
        for r in decided:
            tiles[r.tu, r.tv].append(r)
        changed = {}
        for own in tiles.values():
            here = dict(cells)
            for r in own:
                v = (r.ti, r.tj, r.tk)
                assert here.get(v) == r.cur and r.cur != r.prop
                if checked < 250:
                    assert math.isclose(_total({**here, v: r.prop}, *args) - _total(here, *args), r.delta, rel_tol=1e-6, abs_tol=1e-5)
                    checked += 1
                if r.accepted:
                    here[v] = changed[v] = r.prop
                    flips += 1
        cells.update(changed)
    after = {(r.i, r.j, r.k): r.cell for r in passed[0].states.where("cell IS NOT NULL").collect()}
    assert after == {v: c for v, c in cells.items() if c is not None}
    assert checked > 40 and flips > 5


def test_targets_of_a_pass_are_apart_and_within_the_quota(tiled, passed):
    opts, _, state = tiled
    for colour, decided in enumerate(passed[1]):
        targets = {(r.ti, r.tj, r.tk) for r in decided}
        assert len(targets) == len(decided)
        for i, j, k in targets:
            assert not any((i + a, j + b, k + c) in targets for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0))
            assert 2 * (i // 9 % 2) + j // 9 % 2 == colour
        tiles = defaultdict(int)
        for r in decided:
            tiles[r.tu, r.tv] += 1
        assert all(n <= opts.morphology_steps_per_iter // 4 for n in tiles.values())
    assert sum(map(len, passed[1])) > 40


def test_kept_tables_equal_fresh_ones(tiled, passed):
    opts, _, _ = tiled
    state = passed[0]
    flips = 0
    for n in range(3):
        state, decided = passes.tile_passes(replace(state, iteration=state.iteration + 1 + n), opts, 1.0)
        flips += sum(d.where("accepted").count() for d in decided)
    assert flips > 15
    assert rows_of(state.edges, passes.EDGE) == rows_of(mismatch_edges(state.states, state.grid), passes.EDGE)
    consistency.check_consistency(state)


def test_a_fault_in_any_kept_table_is_found(passed):
    state = passed[0]
    faults = {
        "layer": replace(state, layers=state.layers.withColumn("surface", F.when(F.col("cell") == 1, F.col("surface") + 1).otherwise(F.col("surface")))),
        "edges": replace(state, edges=state.edges.where("a_i + a_j > 0").unionByName(state.edges.limit(1))),
        "counts": replace(state, counts=state.counts.withColumn("n", F.when(F.col("gene") == state.counts.first()["gene"], F.col("n") + 1).otherwise(F.col("n")))),
    }
    for name, broken in faults.items():
        with pytest.raises(AssertionError, match=name):
            consistency.check_consistency(broken)


def test_frozen_cells_are_left_out_before_the_draw(tiled):
    opts, _, state = tiled
    held = state.states.where("cell IS NOT NULL").select("cell").distinct().orderBy("cell").limit(4)
    names = {r.cell for r in held.collect()}
    frozen = replace(state, frozen=held)
    free, drawn = ([r for c in range(4) for r in passes.draw(mismatch_edges(s.states, s.grid), [], s, replace(opts, morphology_steps_per_iter=16), c).collect()] for s in (state, frozen))
    assert not any(r.cur in names or r.src in names for r in drawn)
    assert any(r.cur in names or r.src in names for r in free)
    assert len(drawn) > len([r for r in free if r.cur not in names and r.src not in names])  # their places go to others


def test_twelve_tables_at_most(tiled, monkeypatch):
    opts, _, state = tiled
    written = []
    real = passes.materialize
    monkeypatch.setattr(passes, "materialize", lambda df, name="t": written.append(name) or real(df, name))
    passes.tile_passes(replace(state, edges=None), replace(opts, morphology_steps_per_iter=40))
    assert len(written) <= 12


def test_same_result_for_any_partitioning(spark, tiled, passed):
    opts, _, state = tiled
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        after, _ = passes.tile_passes(state, opts)
        assert rows_of(after.states, ["i", "j", "k", "cell"]) == rows_of(passed[0].states, ["i", "j", "k", "cell"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_metrics_equal_plain_queries(spark, tiled):
    """The figures observed while tables were written, computed again from the tables."""
    opts, _, state = tiled
    after = gibbs.gibbs_step(state, opts, burnin=True)
    m = after.metrics[-1]
    names = {"counts": state.counts, "states": state.states, "fg": after.foreground, "cells": state.cells, "theta": state.theta, "layers": state.layers, "rates": after.rates, "region": state.region}
    for name, df in names.items():
        df.createOrReplaceTempView(f"m_{name}")
    one = lambda q: spark.sql(q).first()[0]
    assert m.iteration == state.iteration and len(after.metrics) == len(state.metrics) + 1
    assert m.molecules == one("SELECT SUM(n) FROM m_counts")
    assert m.assigned == one("SELECT SUM(c.n) FROM m_counts c JOIN m_states s USING (i, j, k) WHERE s.cell IS NOT NULL")
    assert m.foreground == one("SELECT SUM(n) FROM m_fg") and 0 < m.foreground_share <= m.assigned_share <= 1
    u = state.unfactored
    gain = one(f"""SELECT SUM(n * LN(CASE WHEN slot IS NOT NULL THEN element_at(phi, COALESCE(slot, 0) + 1)
      ELSE aggregate(zip_with(slice(phi, {u + 1}, {state.hidden}), theta, (a, b) -> a * b), 0D, (a, v) -> a + v) END))
      FROM m_fg JOIN m_cells USING (cell) JOIN m_theta USING (gene)""")
    exposure = one(f"SELECT SUM(v * {state.grid.voxel_volume} * phi_sum) FROM (SELECT cell, SUM(volume) AS v FROM m_layers GROUP BY cell) JOIN m_cells USING (cell)")
    labelled = label_counts(state.counts, state.states)
    shares = gibbs.allocate(state, cell_gene_counts(labelled), opts, state.iteration)  # the same draws again
    unassigned_counts(labelled).unionByName(shares.where("latent < 0").select("gene", "k0", "density", F.col("x").alias("n"))).createOrReplaceTempView("m_back")
    background = one("""SELECT SUM(COALESCE(x, 0) * LN(rate) - rate * COALESCE(volume, 0)) FROM m_rates LEFT JOIN m_region USING (density)
      LEFT JOIN (SELECT gene, k0, density, SUM(n) AS x FROM m_back GROUP BY ALL) USING (gene, k0, density)""")
    assert math.isclose(m.log_likelihood, gain - exposure + background, rel_tol=1e-9)


def test_iterations_use_passes_and_stay_consistent(spark, tiled):
    opts, _, state = tiled
    opts = replace(opts, check_consistency=True, morphology_steps_per_iter=80)
    after = segment.iterate(state, opts, burnin=False, temperature=1.0, record=True)
    assert after.edges is not None and after.transitions is not None and len(after.metrics) == len(state.metrics) + 1
