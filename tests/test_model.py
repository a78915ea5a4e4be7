"""Sampling steps: moments, determinism, invariants, and scores against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import variates as V
from cellgrid.functions.diffusion import displacement_probs, mirrored
from cellgrid.functions.offsets import MOORE, MOORE_2D, VON_NEUMANN
from cellgrid.operators import density, measures
from cellgrid.plans import gibbs, morphology, repositioning, segment
from cellgrid.session import materialize

KEYS = V.stream(np.arange(100_000), 0)


def close(sample, mean, var):
    se = math.sqrt(var / len(sample))
    assert abs(sample.mean() - mean) < 5 * se
    assert abs(sample.var() / var - 1) < 0.1


@pytest.mark.parametrize("a", [0.1, 0.9, 2.5, 40.0])
def test_gamma(a):
    close(V.gamma(KEYS, a), a, a)


@pytest.mark.parametrize("n,p", [(7, 0.4), (90, 0.1), (4000, 0.8)])
def test_binomial(n, p):
    b = V.binomial(KEYS, n, p)
    assert b.min() >= 0 and b.max() <= n
    close(b, n * p, n * p * (1 - p))


@pytest.mark.parametrize("h,z", [(0.6, 0.0), (1.0, 2.0), (6.0, -3.0), (70.0, 1.0)])
def test_polyagamma(h, z):
    s = V.polyagamma(KEYS, h, z)
    close(s, V.polyagamma_mean(h, z), float(V.polyagamma_var(h, z)))


def test_tables_and_multinomial():
    t = V.tables(KEYS, 25, 1.5)
    close(t, sum(1.5 / (1.5 + i) for i in range(25)), t.var())
    m = V.multinomial(KEYS[:20000], 9, np.tile([1.0, 0.0, 3.0], (20000, 1)))
    assert (m.sum(axis=1) == 9).all() and (m[:, 1] == 0).all()
    close(m[:, 2], 6.75, 9 * 0.75 * 0.25)


def test_tables_of_large_counts():
    r, n = 2.0, 100_000
    t = V.tables(KEYS[:20000], n, r)
    p = r / (r + np.arange(n))
    close(t, p.sum(), (p * (1 - p)).sum())


def test_large_entries_split_like_small_ones(spark, small):
    opts, _, state, _ = small
    one = state.counts.limit(1).withColumns({"i": F.lit(50).cast("bigint"), "j": F.lit(50).cast("bigint"), "cell": F.lit(0).cast("bigint")})
    deep = [repositioning.propose_moves(one.withColumn("n", F.lit(m).cast("bigint")), state.grid, opts, 1).collect() for m in (60_000,)]
    few = repositioning.propose_moves(
        spark.range(3000).selectExpr("id AS g").crossJoin(one.withColumn("n", F.lit(20).cast("bigint")).drop("gene")).withColumn("gene", F.col("g").cast("string")).drop("g"),
        state.grid, opts, 1).groupBy("mi").agg(F.sum("m").alias("m")).collect()
    a, b = defaultdict(int), {r.mi: r.m for r in few}
    for r in deep[0]:
        a[r.mi] += r.m
    assert abs(sum(a.values()) / sum(b.values()) - 1) < 0.02
    for d in (-2, -1, 0, 1, 2):
        assert abs(a[d] - b[d]) < 6 * math.sqrt(a[d] + b[d])


def test_draws_do_not_depend_on_batch():
    assert (V.gamma(KEYS[:50], 0.3)[10:20] == V.gamma(KEYS[10:20], 0.3)).all()
    assert (V.binomial(KEYS[:50], 100, 0.3)[10:20] == V.binomial(KEYS[10:20], 100, 0.3)).all()


def test_displacement_table_sums_to_one():
    for vs, sigma in ((1.0, 4.0), (2.0, 1.0), (0.25, 0.2)):
        p = mirrored(displacement_probs(vs, sigma))
        assert len(p) % 2 == 1 and abs(sum(p) - 1) < 2e-3 and p == p[::-1]
        # chance of each voxel by many start positions
        start = (np.arange(20_000) + 0.5) / 20_000 * vs
        below = np.vectorize(lambda x: 0.5 * math.erfc(-x / (sigma * math.sqrt(2.0))))
        for d in range(len(p) // 2 + 1):
            assert abs(p[len(p) // 2 + d] - (below((d + 1) * vs - start) - below(d * vs - start)).mean()) < 1e-8


def test_articulation(spark):
    def mask(*on):
        return sum(1 << MOORE.index(d) for d in on)

    cases = [(mask((-1, 0, 0), (1, 0, 0)), True), (mask((-1, 0, 0), (-1, 1, 0), (0, 1, 0)), False), (mask((1, 0, 0)), False), (0, False), ((1 << 26) - 1, False)]
    df = spark.createDataFrame([(m,) for m, _ in cases], "m long")
    got = [r[0] for r in df.select(morphology.articulates("m")).collect()]
    assert got == [w for _, w in cases]


def _iiq(s, v):
    return 0.0 if v == 0 else math.log(max(1.0, s * s / (9.43 * 4 * math.pi * v)))


def _total(cells, state, opts, mols, phi, scale, z, theta, rates, priors):
    """Log posterior of a labelling, up to terms no flip changes."""
    vv, c = state.grid.voxel_volume, state.components
    by = defaultdict(set)
    for v, cell in cells.items():
        if cell is not None:
            by[cell].add(v)
    out = 0.0
    for v, (pc, lp, l1m) in priors.items():
        out += lp if cells.get(v) == pc else l1m
    for v, entries in mols.items():
        cell = cells.get(v)
        for g, k0, d, n in entries:
            lam = 0.0
            if cell is not None:
                slot, th = theta[g]
                lam = phi[cell][slot] if slot is not None else sum(a * b for a, b in zip(phi[cell][state.unfactored:], th, strict=True))
            out += n * math.log(max(lam + rates[(g, k0, d)], 1e-30))
    for cell, vox in by.items():
        vol = len(vox) * vv
        mu, sd = c.mu[z[cell]], c.sigma[z[cell]]
        out += -scale[cell] * vol * sum(phi[cell]) - (math.log(vol) - mu) ** 2 / (2 * sd * sd) - math.log(vol)
        for k in range(state.grid.layers):
            lay = {v for v in vox if v[2] == k}
            s = sum((v[0] + a, v[1] + b, k) not in lay for v in lay for a, b, _ in MOORE_2D)
            out += -_iiq(s, len(lay)) ** 2 / (2 * opts.cell_compactness**2)
    return out


def test_flip_scores_equal_full_recomputation(spark, small):
    opts, _, state, _ = small
    cells = {(r.i, r.j, r.k): r.cell for r in state.states.collect()}
    priors = {(r.i, r.j, r.k): (r.prior_cell, r.log_prior, r.log_1m_prior) for r in state.states.where("log_prior IS NOT NULL").collect()}
    mols = defaultdict(list)
    for r in state.counts.collect():
        mols[(r.i, r.j, r.k)].append((r.gene, r.k0, r.density, r.n))
    rows = state.cells.collect()
    phi, scale, z = ({r.cell: r[k] for r in rows} for k in ("phi", "scale", "z"))
    theta = {r.gene: (r.slot, r.theta) for r in state.theta.collect()}
    rates = {(r.gene, r.k0, r.density): r.rate for r in state.rates.collect()}
    args = (state, opts, mols, phi, scale, z, theta, rates, priors)
    before = _total(cells, *args)
    checked = 0
    for stage in range(6):
        p = morphology.propose(state.states, state.grid, opts.seed, F.lit(stage), 0.3)
        for r in morphology.evaluate(p, state, opts, 1.0).collect():
            v = (r.ti, r.tj, r.tk)
            assert cells.get(v) == r.cur and r.cur != r.prop
            flipped = {**cells, v: r.prop}
            assert math.isclose(_total(flipped, *args) - before, r.delta, rel_tol=1e-6, abs_tol=1e-5)
            near = [(v[0] + a, v[1] + b, v[2] + c) for a, b, c in VON_NEUMANN]
            near = [n for n in near if n[0] >= 0 and n[1] >= 0 and 0 <= n[2] < state.grid.layers]
            assert r.near == len(near) and r.n_cur == sum(cells.get(n) == r.cur for n in near)
            checked += 1
    assert checked > 20


def test_sweep_proposals_touch_disjoint_cells(spark, small):
    opts, _, state, _ = small
    p = morphology.propose(state.states, state.grid, opts.seed, F.lit(11), 0.05).collect()
    used = [c for r in p for c in (r.cur, r.src) if c is not None]
    assert len(used) == len(set(used))
    assert len({(r.ti, r.tj, r.tk) for r in p}) == len(p)


def test_sweeps_keep_layer_shapes(spark, small):
    opts, _, state, _ = small
    for n in range(3):
        state, _ = morphology.sweep(state, opts, n, 0.2)
    segment.check_consistency(state)


def test_repositioning_conserves_molecules(spark, small):
    opts, _, state, _ = small
    after, _ = repositioning.reposition(state, opts)
    key = ["gene", (F.col("i") - F.col("di")).alias("oi"), (F.col("j") - F.col("dj")).alias("oj"), (F.col("k") - F.col("dk")).alias("ok"), "k0", "density"]

    def origins(s):
        return {tuple(r) for r in s.counts.groupBy(*key).agg(F.sum("n")).collect()}

    assert origins(after) == origins(state)
    assert after.counts.where("di <> 0 OR dj <> 0 OR dk <> 0").count() > 0
    assert after.counts.agg(F.min("n")).first()[0] > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_voxels_are_never_broadcast_to_counts(spark, small):
    _, _, state, _ = small
    bins = state.counts.select("i", "j", F.lit(0).cast("bigint").alias("bin")).distinct()
    moved = state.counts.select("i", "j", "k").limit(9).toDF("ti", "tj", "tk").withColumns({c: F.lit(None).cast("bigint") for c in ("cur", "prop")})
    for joined in (
        measures.label_counts(state.counts, state.states), density.attach_origin(state.counts, bins),
        morphology.neighbourhood(moved, state.states, state.grid),
    ):
        assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)


def test_moves_are_drawn_once(small, monkeypatch):
    opts, _, state, _ = small
    plans = defaultdict(list)

    def spy(df, name="t"):
        plans[name].append(plan(df))
        return materialize(df, name)

    monkeypatch.setattr(repositioning, "materialize", spy)
    repositioning.reposition(state, opts)
    assert plans["proposed"][0].count("ArrowEvalPython") == 3  # a call for each axis
    assert "explode" not in plans["rates"][0] + plans["moves"][0]
    assert not any(f"BroadcastHashJoin [{c}" in plans["proposed"][0] + plans["moves"][0] for c in ("ni#", "i#", "_c#"))


def test_the_distance_join_of_a_run_is_made_once(spark, sf, small, monkeypatch):
    from cellgrid.catalogue.inputs import canonical

    opts, _, _, _ = small
    ranked, normalize = [], segment.prep.normalize_z
    monkeypatch.setattr(segment.prep, "normalize_z", lambda t: ranked.append(plan(t)) or normalize(t))
    segment.prepare(canonical(spark, sf), opts)
    assert len(ranked) == 1 and "LeftSemi" not in ranked[0]


def test_allocation_uses_every_molecule(spark, small):
    from cellgrid.operators.measures import cell_gene_counts, label_counts

    opts, _, state, _ = small
    assigned = cell_gene_counts(label_counts(state.counts, state.states))
    alloc = gibbs.allocate(state, assigned, opts, 5)
    key = ["cell", "gene", "k0", "density"]
    a = {tuple(r) for r in assigned.collect()}
    b = {tuple(r) for r in alloc.groupBy(*key).agg(F.sum("x")).collect()}
    assert a == b
    assert alloc.where("latent >= 0").groupBy("latent").count().count() > state.unfactored


def test_same_seed_same_result_for_any_partitioning(spark, small):
    opts, _, state, _ = small
    results = []
    for parts in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            s = segment.iterate(state, opts, burnin=False, temperature=1.0, record=True)
            results.append((
                sorted(map(tuple, s.states.select("i", "j", "k", "cell").collect()), key=str),
                sorted(map(tuple, s.counts.collect()), key=str),
                sorted((r.cell, r.z, tuple(r.phi)) for r in s.cells.collect()), s.components.s.tolist(),
                sorted(map(tuple, s.rates.collect())),
            ))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_planted_cells_are_recovered(spark):
    """Two round cells with opposite profiles: sweeps move noisy borders towards the truth."""
    from cellgrid.options import Options, validate

    rnd = np.random.default_rng(0)
    rows = []
    for c, (cx, cy) in enumerate([(8.0, 10.0), (19.0, 10.0)]):
        for _ in range(900):
            r, a = 5.5 * math.sqrt(rnd.random()), 2 * math.pi * rnd.random()
            x, y = cx + r * math.cos(a), cy + r * math.sin(a)
            gene = f"g{c}{rnd.integers(4)}" if rnd.random() < 0.95 else f"g{1 - c}{rnd.integers(4)}"
            known = math.hypot(x - cx, y - cy) < 2.5  # only the nucleus is annotated
            rows.append((gene, float(x), float(y), 0.0, 1, f"c{c}" if known else None, f"c{c}"))
    t = spark.createDataFrame(rows, "gene string, x double, y double, z double, n long, cell string, truth string")
    t = t.withColumn("nucleus", F.col("cell"))
    opts = validate(Options(burnin_voxel_size=1.0, voxel_size=1.0, voxel_layers=1, ncomponents=1, nunfactored=10, cell_compactness=1.0, seed=2))
    state, index = segment.initialize(t.drop("truth"), opts)
    names = {r.cell_id: r.cell for r in index.collect()}

    def agreement(s):
        lab = morphology.VOXEL
        from cellgrid.operators.grid import voxelize

        j = voxelize(t, s.grid).drop("cell").join(s.states.select(*lab, "cell"), lab, "left").select("truth", "cell").collect()
        return sum(names.get(r.cell) == r.truth for r in j) / len(j)

    start = agreement(state)
    for _ in range(2):
        state = gibbs.gibbs_step(state, opts, burnin=True, sample_z=False)
    n = 0
    for _ in range(2):
        for _ in range(9):
            state, _acc = morphology.sweep(state, opts, n, 1.0)
            n += 1
        state = gibbs.gibbs_step(state, opts, burnin=True)
    assert agreement(state) > start + 0.03


def test_masks_with_fixed_cells_through_both_resolutions(spark, tmp_path):
    """Fixed cells keep exactly their voxels; connectivity, scales and free dispersion run."""
    from cellgrid.options import Options, validate
    from cellgrid.plans.run import prior_states

    rnd = np.random.default_rng(1)
    rows = [(f"g{rnd.integers(6)}", float(x), float(y), 0.0, 1) for x, y in rnd.random((1500, 2)) * 24]
    t = spark.createDataFrame(rows, "gene string, x double, y double, z double, n long").withColumns({c: F.lit(None).cast("string") for c in ("cell", "nucleus")})
    masks, fixed = np.zeros((24, 24), "u4"), np.zeros((24, 24), "u4")
    masks[2:8, 2:8], masks[2:8, 10:16], fixed[12:18, 4:10] = 1, 2, 1
    for name, a in (("m", masks), ("f", fixed)):
        np.save(tmp_path / f"{name}.npy", a)
    opts = validate(Options(
        burnin_voxel_size=2.0, voxel_size=1.0, voxel_layers=1, ncomponents=2, nhidden=2, nunfactored=3, sweeps_per_iter=2, init_iterations=1,
        burnin_samples=1, samples=1, recorded_samples=1, hillclimb=0, cellpose_masks=str(tmp_path / "m.npy"), cellpose_masks_fixed=str(tmp_path / "f.npy"),
        unmodeled_fixed_cells=True, enforce_connectivity=True, use_scaled_cells=True, variable_burnin_dispersion=True, expand_initialized_cells=1,
        cell_compactness=1.0, check_consistency=True,
    ))
    r = segment.segment(t, opts, prior_states(spark, "", opts))
    names = {x.cell_id: x.cell for x in r.index.collect()}
    assert sorted(names.values()) == ["1", "1-fixed", "2"]
    held = next(c for c, n in names.items() if n == "1-fixed")
    got = {(x.i, x.j) for x in r.state.states.where(F.col("cell") == held).collect()}
    g = r.state.grid
    want = {(int((c + 0.5 - g.xmin) // 1), int((q + 0.5 - g.ymin) // 1)) for q in range(12, 18) for c in range(4, 10)}
    assert got == want
    fg = r.state.foreground.where(F.col("cell") == held).agg(F.sum("n")).first()[0]
    from cellgrid.operators.measures import label_counts

    assert fg == label_counts(r.state.counts, r.state.states).where(F.col("cell") == held).agg(F.sum("n")).first()[0]


def test_superseded_tables_are_deleted(spark, small):
    import os

    from cellgrid.session import Scratch, materialize

    with Scratch(spark) as scratch:
        a = materialize(spark.range(3), "a")
        b = materialize(a.selectExpr("id + 1 AS id"), "b")
        lazy = b.where("id > 1")
        assert len(scratch.paths) == 2
        scratch.release([lazy])
        left = list(scratch.paths)
    assert len(left) == 1 and os.path.basename(left[0]).startswith("b-") and os.path.isdir(left[0].removeprefix("file:"))
    assert lazy.count() == 2
