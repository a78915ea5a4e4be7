"""Queries on the count model: expectations with SQL counterparts, and seeded sampling steps."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from cellgrid.catalogue import ctes as C
from cellgrid.catalogue.inputs import binned, canonical, labelled, rounded, states
from cellgrid.functions import scalar
from cellgrid.functions.diffusion import EPS
from cellgrid.operators import measures
from cellgrid.options import Options, validate
from cellgrid.plans import expectations as X
from cellgrid.plans import gibbs, morphology, passes, repositioning, segment
from cellgrid.sources import fixtures as fx

R, S = 1.5, 0.7
SIGMA = 0.8
RUN = validate(Options(
    burnin_voxel_size=2.0, voxel_size=2.0, voxel_layers=C.LAYERS, ncomponents=3, nhidden=4, nunfactored=8,
    init_iterations=1, burnin_samples=1, samples=1, recorded_samples=1, hillclimb=0, seed=7,
))


def _parts(spark, sf):
    """Labelled counts with simple two-factor parameters computed from the data."""
    lab, grid = labelled(spark, sf)
    assigned = measures.cell_gene_counts(lab)
    back = measures.unassigned_counts(lab)
    vol = states(spark, sf)[0].where("cell IS NOT NULL").groupBy("cell").agg(F.count(F.lit(1)).alias("v"))
    n = assigned.groupBy("cell").agg(F.sum("n").alias("n"))
    phi = vol.join(n, "cell", "left").select("cell", F.array(
        (1 + F.coalesce("n", F.lit(0))) / (10 + F.col("v")), F.lit(1.0) / (1 + F.col("v"))).alias("phi"), "v", F.coalesce("n", F.lit(0)).alias("n"))
    totals = measures.gene_totals(canonical(spark, sf))
    size = totals.agg(F.sum("total_count"), F.count(F.lit(1))).first()
    theta = totals.select("gene", F.array(F.col("total_count") / F.lit(float(size[0])), F.lit(1.0 / size[1])).alias("theta"))
    region = X.volumes(binned(spark, sf), grid)
    rates = X.background_rate_mean(back, X.full_index(lab, C.LAYERS, C.BINS), region)
    return grid, assigned, back, phi, theta, rates, region


def background_rate_mean(spark, sf):
    return rounded(_parts(spark, sf)[5], "rate")


def expected_foreground(spark, sf):
    _, assigned, _, phi, theta, rates, _ = _parts(spark, sf)
    e = X.expected_foreground(assigned, phi.select("cell", "phi"), theta, rates)
    return rounded(e.groupBy("cell", "gene").agg(F.sum("n").alias("n"), F.sum("expected").alias("expected")), "expected")


def expected_latent(spark, sf):
    _, assigned, _, phi, theta, _, _ = _parts(spark, sf)
    return rounded(X.expected_latent(assigned, phi.select("cell", "phi"), theta), "expected").withColumn("latent", F.col("latent").cast("bigint"))


def phi_posterior_mean(spark, sf):
    grid, assigned, _, phi, _, _, _ = _parts(spark, sf)
    x = assigned.groupBy("cell", F.col("k0").alias("latent")).agg(F.sum("n").alias("x"))
    ev = phi.select("cell", (F.col("v") * F.lit(grid.voxel_volume)).alias("ev"))
    return rounded(X.phi_posterior_mean(x, ev, R, S, 1.0).select("cell", "latent", "x", "mean"), "mean")


def _components(spark, sf):
    grid, _, _, phi, _, _, _ = _parts(spark, sf)
    return phi.select("cell", (F.col("cell") % 3).alias("z"), (F.col("v") * F.lit(grid.voxel_volume)).alias("ev"), F.col("n").alias("x"))


def component_stats(spark, sf):
    return rounded(X.component_stats(_components(spark, sf)), "volume")


def volume_posterior(spark, sf):
    return rounded(X.volume_posterior(_components(spark, sf), SIGMA, 3.9, 3.0), "mean", "variance")


def log_likelihood(spark, sf):
    grid, assigned, back, phi, theta, rates, region = _parts(spark, sf)
    sums = theta.agg(F.sum(F.col("theta")[0]), F.sum(F.col("theta")[1])).first()
    exposure = phi.select((F.col("v") * F.lit(grid.voxel_volume)).alias("ev"),
                          (F.col("phi")[0] * F.lit(sums[0]) + F.col("phi")[1] * F.lit(sums[1])).alias("phi_theta"))
    return rounded(X.log_likelihood(assigned, back, phi.select("cell", "phi"), theta, exposure, rates, region), "log_likelihood", digits=3)


def diffusion_prior(spark, sf):
    """Prior weight of each voxel's offset from the corner of its cell."""
    s, grid = states(spark, sf)
    occ = s.where("cell IS NOT NULL").select("i", "j", "k", "cell")
    low = occ.groupBy("cell").agg(F.min("i").alias("i0"), F.min("j").alias("j0"), F.min("k").alias("k0"))
    off = occ.join(low, "cell").select("cell", (F.col("i") - F.col("i0")).alias("di"), (F.col("j") - F.col("j0")).alias("dj"), (F.col("k") - F.col("k0")).alias("dk"))
    p = repositioning.distance_prior(Options(), grid, F.col("di"), F.col("dj"), F.col("dk"))
    return off.withColumn("logp", F.round(F.log(p), 6))


def negbin_logpmf(spark, sf):
    line = fx.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax").distinct()
    r = F.col("l_tax") * 10 + 0.25
    p = (F.col("l_discount") + 0.05) * 2
    return rounded(line.select("l_quantity", "l_discount", "l_tax", gibbs.negbin_udf(r, p, F.col("l_quantity")).alias("logp")), "logp")


def scalar_functions(spark, sf):
    line = fx.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax").distinct()
    x = (F.col("l_quantity") - 25.0) / 5.0
    return rounded(line.select(
        "l_quantity", "l_discount", "l_tax", scalar.logistic(x).alias("logistic"), scalar.odds_to_prob(F.col("l_discount")).alias("prob"),
        scalar.normal_logpdf(F.col("l_tax"), F.col("l_discount") + 0.5, x).alias("normal"),
    ), "logistic", "prob", "normal")


@lru_cache(maxsize=4)
def _started(spark, sf):
    t = segment.prepare(canonical(spark, sf), RUN)
    state, index = segment.initialize(t, RUN)
    return t, gibbs.gibbs_step(state, RUN, burnin=True, sample_z=False), index


def kmeans_init(spark, sf):
    lab, _ = labelled(spark, sf)
    cells = states(spark, sf)[0].where("cell IS NOT NULL").select("cell").distinct()
    return gibbs.initial_components(measures.cell_gene_counts(lab), cells, 3, seed=7)


def gibbs_step(spark, sf):
    state = gibbs.gibbs_step(_started(spark, sf)[1], RUN, burnin=False)
    return state.cells.select("cell", F.col("z").cast("bigint").alias("z"), F.round(F.aggregate("phi", F.lit(0.0), lambda a, v: a + v), 6).alias("phi_sum"))


def voxel_sweep(spark, sf):
    return morphology.sweep(_started(spark, sf)[1], RUN, 0)[1]


def voxel_passes(spark, sf):
    """Decided proposals of one iteration's tile passes."""
    decided = passes.tile_passes(_started(spark, sf)[1], RUN)[1]
    return segment.union_all(decided).select("tu", "tv", "ti", "tj", "tk", "cur", "prop", F.round("delta", 6).alias("delta"), "accepted")


def transcript_repo(spark, sf):
    state, _ = repositioning.reposition(_started(spark, sf)[1], RUN)
    return state.counts


def kmeans_cells(spark, sf):
    """Every cell once, with a component that exists."""
    return kmeans_init(spark, sf).select("cell", F.col("z").between(0, 2).alias("known"))


def transcript_repo_totals(spark, sf):
    """Molecules by column of origin after a step of moves: none is lost, made, or given to another origin."""
    origin = [(F.col(v) - F.col(f"d{v}")).alias(v) for v in ("i", "j")]
    return transcript_repo(spark, sf).select(*origin, "gene", "n").groupBy("i", "j", "gene").agg(F.sum("n").cast("bigint").alias("n"))


def segment_small(spark, sf):
    """A complete run on a short schedule: final cell table."""
    return segment.result_cells(segment.segment(canonical(spark, sf), RUN))


QUERIES = {
    "background_rate_mean": background_rate_mean,
    "expected_foreground": expected_foreground,
    "expected_latent": expected_latent,
    "phi_posterior_mean": phi_posterior_mean,
    "component_stats": component_stats,
    "volume_posterior": volume_posterior,
    "log_likelihood": log_likelihood,
    "diffusion_prior": diffusion_prior,
    "negbin_logpmf": negbin_logpmf,
    "scalar_functions": scalar_functions,
    "kmeans_init": kmeans_init,
    "gibbs_step": gibbs_step,
    "voxel_sweep": voxel_sweep,
    "voxel_passes": voxel_passes,
    "transcript_repo": transcript_repo,
    "segment_small": segment_small,
    "kmeans_cells": kmeans_cells,
    "transcript_repo_totals": transcript_repo_totals,
}


def sql() -> dict[str, str]:
    from cellgrid.catalogue import shape_queries

    shape_queries.sql()  # count expressions
    vv = C.VOXEL_SIZE**2 / C.LAYERS
    C.define("cvol", "SELECT o.cell, o.v, COALESCE(l.n, 0) AS n FROM (SELECT cell, COUNT(*) AS v FROM occ GROUP BY cell) o LEFT JOIN (SELECT cell, SUM(n) AS n FROM lab WHERE cell IS NOT NULL GROUP BY cell) l ON o.cell = l.cell")
    C.define("phi", "SELECT cell, v, n, CAST(1 + n AS DOUBLE) / (10 + v) AS p1, CAST(1 AS DOUBLE) / (1 + v) AS p2 FROM cvol")
    C.define("theta", """SELECT gene, CAST(total_count AS DOUBLE) / SUM(total_count) OVER () AS t1, CAST(1 AS DOUBLE) / COUNT(*) OVER () AS t2
FROM (SELECT gene, SUM(n) AS total_count FROM tx GROUP BY gene) g""")
    C.define("asg", "SELECT cell, gene, k0, density, SUM(n) AS n FROM lab WHERE cell IS NOT NULL GROUP BY cell, gene, k0, density")
    C.define("comps", f"SELECT cell, cell % 3 AS z, v * CAST({vv} AS DOUBLE) AS ev, n AS x FROM phi")
    C.define("celloff", """SELECT o.cell, o.i - MIN(o.i) OVER (PARTITION BY o.cell) AS di, o.j - MIN(o.j) OVER (PARTITION BY o.cell) AS dj,
  o.k - MIN(o.k) OVER (PARTITION BY o.cell) AS dk FROM occ o""")
    for name, size, sigma in (("pnear", C.VOXEL_SIZE, 1.0), ("pfar", C.VOXEL_SIZE, 4.0), ("pdeep", 1.0 / C.LAYERS, 0.1)):
        # Simpson's rule for the normal density under the triangle of start and end voxel
        t, dist = f"({size!r} * (x.i / 2000.0 - 1))", f"(y.d * {size!r} + {size!r} * (x.i / 2000.0 - 1))"
        C.define(name, f"""SELECT d, p FROM (SELECT y.d, SUM(CASE WHEN x.i IN (0, 4000) THEN 1 WHEN x.i % 2 = 1 THEN 4 ELSE 2 END
  * ({size!r} - ABS({t})) * EXP(-{dist} * {dist} / {2.0 * sigma * sigma!r})) / 6000.0 / SQRT(2 * PI()) / {sigma!r} AS p
  FROM (SELECT UNNEST(RANGE(0, 4001)) AS i) x CROSS JOIN (SELECT UNNEST(RANGE(0, 64)) AS d) y GROUP BY y.d) q WHERE d = 0 OR p >= {EPS}""")
    lp = "LEAST(CAST(0.999999 AS DOUBLE), (l_discount + 0.05) * 2)"
    lr = "(l_tax * 10 + 0.25)"
    x = "((l_quantity - 25.0) / 5.0)"
    one = "CAST(1 AS DOUBLE)"
    q = {
        "background_rate_mean": "SELECT gene, k0, density, ROUND(rate, 6) AS rate FROM bgrate",
        "expected_foreground": """SELECT cell, gene, CAST(SUM(n) AS BIGINT) AS n, ROUND(SUM(n * lam / (lam + rate)), 6) AS expected FROM (
  SELECT a.cell, a.gene, a.n, p.p1 * t.t1 + p.p2 * t.t2 AS lam, b.rate FROM asg a JOIN phi p ON a.cell = p.cell JOIN theta t ON a.gene = t.gene
  JOIN bgrate b ON a.gene = b.gene AND a.k0 = b.k0 AND a.density = b.density) e GROUP BY cell, gene""",
        "expected_latent": """SELECT cell, l.latent, ROUND(SUM(n * CASE WHEN l.latent = 0 THEN w1 ELSE w2 END / (w1 + w2)), 6) AS expected FROM (
  SELECT a.cell, a.n, p.p1 * t.t1 AS w1, p.p2 * t.t2 AS w2 FROM asg a JOIN phi p ON a.cell = p.cell JOIN theta t ON a.gene = t.gene) e
CROSS JOIN (SELECT UNNEST(RANGE(0, 2)) AS latent) l GROUP BY cell, l.latent""",
        "phi_posterior_mean": f"""SELECT a.cell, a.latent, a.x, ROUND(({R} + a.x) * CAST({S} AS DOUBLE) / (1 + CAST({S} AS DOUBLE) * p.v * CAST({vv} AS DOUBLE)), 6) AS mean
FROM (SELECT cell, k0 AS latent, CAST(SUM(n) AS BIGINT) AS x FROM asg GROUP BY cell, k0) a JOIN phi p ON a.cell = p.cell""",
        "component_stats": "SELECT z, COUNT(*) AS population, ROUND(SUM(ev), 6) AS volume, CAST(SUM(x) AS BIGINT) AS molecules FROM comps GROUP BY z",
        "volume_posterior": f"""SELECT z, ROUND(v * (CAST({3.9 / 9.0!r} AS DOUBLE) + slv / CAST({SIGMA**2!r} AS DOUBLE)), 6) AS mean, ROUND(v, 6) AS variance FROM (
  SELECT z, SUM(LN(ev)) AS slv, 1 / (CAST({1 / 9.0!r} AS DOUBLE) + COUNT(*) / CAST({SIGMA**2!r} AS DOUBLE)) AS v FROM comps GROUP BY z) c""",
        "log_likelihood": f"""SELECT ROUND(a + b + c, 3) AS log_likelihood FROM
 (SELECT SUM(x.n * LN(p1 * t1 + p2 * t2)) AS a FROM (SELECT cell, gene, SUM(n) AS n FROM asg GROUP BY cell, gene) x
   JOIN phi ON x.cell = phi.cell JOIN theta ON x.gene = theta.gene) q1,
 (SELECT -SUM(v * CAST({vv} AS DOUBLE) * (p1 * s1 + p2 * s2)) AS b FROM phi, (SELECT SUM(t1) AS s1, SUM(t2) AS s2 FROM theta) s) q2,
 (SELECT SUM(COALESCE(b.n, 0) * LN(r.rate) - r.rate * COALESCE(v.volume, 0)) AS c FROM bgrate r
   LEFT JOIN bgn b ON b.gene = r.gene AND b.k0 = r.k0 AND b.density = r.density LEFT JOIN rvol v ON v.bin = r.density) q3""",
        "kmeans_cells": "SELECT DISTINCT cell, TRUE AS known FROM occ",
        "transcript_repo_totals": "SELECT i, j, gene, CAST(SUM(n) AS BIGINT) AS n FROM counts GROUP BY i, j, gene",
        "diffusion_prior": f"""SELECT cell, di, dj, dk, ROUND(LN(COALESCE(z.p, {EPS}) * (0.2 * COALESCE(fi.p, {EPS}) * COALESCE(fj.p, {EPS})
  + 0.8 * COALESCE(ni.p, {EPS}) * COALESCE(nj.p, {EPS}))), 6) AS logp FROM celloff
LEFT JOIN pdeep z ON z.d = dk LEFT JOIN pfar fi ON fi.d = di LEFT JOIN pfar fj ON fj.d = dj
LEFT JOIN pnear ni ON ni.d = di LEFT JOIN pnear nj ON nj.d = dj""",
        "negbin_logpmf": f"""SELECT DISTINCT l_quantity, l_discount, l_tax,
  ROUND(LGAMMA({lr} + l_quantity) - LGAMMA({lr}) - LGAMMA(l_quantity + 1) + l_quantity * LN({lp}) + {lr} * LN(1 - {lp}), 6) AS logp FROM lineitem""",
        "scalar_functions": f"""SELECT DISTINCT l_quantity, l_discount, l_tax, ROUND({one} / ({one} + EXP(-{x})), 6) AS logistic,
  ROUND(l_discount / (1 + l_discount), 6) AS prob,
  ROUND(-0.5 * LN(2 * PI()) - LN(l_discount + 0.5) - POWER(({x} - l_tax) / (l_discount + 0.5), 2) / 2, 6) AS normal FROM lineitem""",
    }
    return {k: C.build(v) for k, v in q.items()}
