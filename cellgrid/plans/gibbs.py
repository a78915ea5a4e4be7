"""One Gibbs update of the count model.

Joins and aggregations prepare each conditional; random draws run on Arrow
batches with per-row keys; only T x K component parameters reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cellgrid.functions import keyed, variates
from cellgrid.operators.measures import cell_gene_counts, label_counts, unassigned_counts
from cellgrid.options import Options
from cellgrid.plans.state import (
    ALPHA_BG, ALPHA_THETA, ALPHA_VOLUME, BETA_BG, BETA_VOLUME, MU0_VOLUME, SIGMA0_VOLUME, TAU_SCALE,
    Components, Metrics, ModelState, rng, volumes,
)
from cellgrid.session import materialize

_FIX = float(1 << 20)
_EMBEDDING = 25
_NORM = 100.0


@pandas_udf(T.DoubleType())
def gamma_udf(key: pd.Series, shape: pd.Series) -> pd.Series:
    return pd.Series(variates.gamma(variates.stream(key.to_numpy(), 0), shape.to_numpy()))


@pandas_udf(T.LongType())
def binomial_udf(key: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(variates.binomial(variates.stream(key.to_numpy(), 0), n.to_numpy(), p.to_numpy()))


@pandas_udf(T.DoubleType())
def negbin_udf(r: pd.Series, p: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(variates.negbin_logpmf(r.to_numpy(), p.to_numpy(), k.to_numpy()))


# -- initial values -----------------------------------------------------------
def initial_components(assigned: DataFrame, cells: DataFrame, components: int, seed: int) -> DataFrame:
    """Starting component of each cell: k-means on a random projection of its expression."""
    if components == 1:
        return cells.select("cell", F.lit(0).alias("z"))
    totals = assigned.groupBy("cell").agg(F.sum("n").alias("total"))
    counts = assigned.groupBy("cell", "gene").agg(F.sum("n").alias("n")).join(totals, "cell")
    weight = F.log1p(F.lit(_NORM) * F.col("n") / F.col("total"))
    axes = {f"e{d}": keyed.normal(keyed.row_key(seed, "gene", F.lit("projection")), d) for d in range(_EMBEDDING)}
    genes = assigned.select("gene").distinct().select("gene", *[e.alias(c) for c, e in axes.items()])
    norms = genes.agg(*[keyed.exact_sum(F.col(c) ** 2).alias(c) for c in axes]).first()
    flat = counts.select("cell", "gene", weight.alias("w")).join(genes, "gene")
    sums = flat.groupBy("cell").agg(*[(keyed.exact_sum(F.col("w") * F.col(c)) / F.lit((norms[c] or 1.0) ** 0.5)).alias(c) for c in axes])
    points = cells.select("cell").join(sums, "cell", "left").select(
        "cell", array_to_vector(F.array(*[F.coalesce(c, F.lit(0.0)) for c in axes])).alias("features")
    )
    points = materialize(points, "embedding")
    model = KMeans(k=components, seed=seed, maxIter=500, predictionCol="z").fit(points)
    return model.transform(points).select("cell", F.col("z").cast("int"))


def initial_phi(cells: DataFrame, latents: int, seed: int) -> DataFrame:
    """exp of a standard normal per (cell, latent)."""
    key = keyed.row_key(seed, "cell", F.lit("phi"))
    draw = F.transform(F.sequence(F.lit(0), F.lit(latents - 1)), lambda k: F.exp(
        F.sqrt(F.lit(-2.0) * F.log(_hashed(key, k * 2))) * F.cos(F.lit(2.0 * np.pi) * _hashed(key, k * 2 + 1))))
    return cells.withColumn("phi", draw).withColumn("phi_sum", F.aggregate("phi", F.lit(0.0), lambda a, v: a + v))


def _hashed(key, draw):
    bits = F.xxhash64(key, draw).bitwiseAND(F.lit((1 << 53) - 1))
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def initial_theta(gene_order: DataFrame, unfactored: int, hidden: int, seed: int) -> DataFrame:
    """The ``unfactored`` most abundant genes get latents of their own, others random loadings."""
    key = keyed.row_key(seed, "gene", F.lit("theta"))
    load = F.transform(F.sequence(F.lit(0), F.lit(max(hidden, 1) - 1)), lambda k: F.exp(
        F.sqrt(F.lit(-2.0) * F.log(_hashed(key, k * 2))) * F.cos(F.lit(2.0 * np.pi) * _hashed(key, k * 2 + 1))))
    own = F.col("gene_rank") < unfactored
    theta = gene_order.select(
        "gene", F.when(own, F.col("gene_rank").cast("int")).alias("slot"), F.when(~own, load).alias("theta")
    )
    return _normalize_theta(theta, hidden)


def _normalize_theta(theta: DataFrame, hidden: int) -> DataFrame:
    """Scale each latent's loadings to sum to one over genes (K sums, exact)."""
    theta = materialize(theta, "theta")
    if not hidden:
        return theta
    sums = theta.where(F.col("theta").isNotNull()).agg(
        *[keyed.exact_sum(F.col("theta")[k] * F.lit(1e3)).alias(f"s{k}") for k in range(hidden)]
    ).first()
    if sums[0] is None:
        return theta
    scale = F.array(*[F.lit(1e3 / v if v else 1.0) for v in sums])
    return theta.withColumn("theta", F.zip_with("theta", scale, lambda a, b: a * b))


# -- allocation of molecules ---------------------------------------------------
def _allocate(seed: int, unfactored: int):
    """Foreground coin and latent split for a batch of count entries; one row per non-zero share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = b["key"].to_numpy()
            slot, lam, n = b["slot"].to_numpy(dtype=np.float64), b["lam"].to_numpy(), b["n"].to_numpy()
            fixed = b["frozen"].to_numpy(dtype=bool)
            p = np.where(fixed, 1.0, lam / np.maximum(lam + b["rate"].to_numpy(), 1e-300))
            fg = variates.binomial(variates.stream(key, 1), n, p)
            parts = [pd.DataFrame({"at": np.arange(len(b)), "latent": -1, "x": n - fg})]
            own = ~np.isnan(slot)
            parts.append(pd.DataFrame({"at": np.flatnonzero(own), "latent": slot[own].astype(np.int64), "x": fg[own]}))
            mix = np.flatnonzero(~own & (fg > 0))
            if mix.size:
                w = np.stack(b["weights"].to_numpy()[mix])
                split = variates.multinomial(variates.stream(key[mix], 2), fg[mix], w)
                row, k = np.nonzero(split)
                parts.append(pd.DataFrame({"at": mix[row], "latent": k + unfactored, "x": split[row, k]}))
            out = pd.concat(parts, ignore_index=True)
            out = out[out["x"] > 0]
            b["log_lam"] = np.log(np.maximum(lam, 1e-300))
            who = b[["cell", "gene", "k0", "density", "log_lam"]].iloc[out["at"].to_numpy()].reset_index(drop=True)
            yield pd.concat([who, out[["latent", "x"]].reset_index(drop=True)], axis=1)[["cell", "gene", "k0", "density", "latent", "x", "log_lam"]]

    return run


def allocate(state: ModelState, assigned: DataFrame, opts: Options, iteration: int) -> DataFrame:
    """Split assigned counts into background (latent -1) and latent factors; ``log_lam`` is the log rate of the cell's own part."""
    u, h = state.unfactored, state.hidden
    phi = state.cells.select("cell", "phi")
    both = assigned.join(phi, "cell").join(state.loadings(), "gene").join(state.background(), ["gene", "k0", "density"], "left")
    weights = F.when(F.col("slot").isNull(), F.zip_with(F.slice("phi", u + 1, max(h, 1)), "theta", lambda a, b: a * b))
    lam = F.when(F.col("slot").isNotNull(), F.element_at("phi", F.coalesce("slot", F.lit(0)) + 1)).otherwise(
        F.aggregate(F.coalesce("weights", F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + v))
    both = both.withColumn("weights", weights).withColumn("lam", lam).withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    if opts.unmodeled_fixed_cells and state.frozen is not None:
        both = both.join(state.frozen.select("cell", F.lit(True).alias("frozen")), "cell", "left")
        both = both.withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    else:
        both = both.withColumn("frozen", F.lit(False))
    both = both.select(
        "cell", "gene", "k0", "density", "n", "slot", "lam", "rate", "weights", "frozen",
        keyed.row_key(opts.seed, iteration, F.lit("allocate"), "cell", "gene", "k0", "density").alias("key"),
    )
    gene_type = assigned.schema["gene"].dataType.simpleString()
    return both.mapInPandas(_allocate(opts.seed, u), f"cell bigint, gene {gene_type}, k0 bigint, density bigint, latent bigint, x bigint, log_lam double")


# -- per-cell conditionals -----------------------------------------------------
def _sparse(batch: pd.DataFrame, latents: int) -> np.ndarray:
    """Dense latent counts of a batch of cells."""
    x = np.zeros((len(batch), latents), dtype=np.int64)
    for at, (ks, xs) in enumerate(zip(batch["ks"], batch["xs"], strict=True)):
        if ks is not None:
            x[at, np.asarray(ks, dtype=np.int64)] = np.asarray(xs, dtype=np.int64)
    return x


def _component_scores(x, ev, lv, c: Components, weighted: bool) -> np.ndarray:
    """Log probability of every cell under every component, up to a constant."""
    scores = np.empty((len(ev), len(c.mu)))
    row, k = np.nonzero(x)
    xs = x[row, k].astype(np.float64)
    for t in range(len(c.mu)):
        odds = ev[:, None] * c.s[t][None, :]
        dense = -(np.log1p(odds) * c.r[t][None, :]).sum(axis=1)
        o = odds[row, k]
        r = c.r[t][k]
        sparse = variates.lgamma(r + xs) - variates.lgamma(r) - variates.lgamma(xs + 1.0) + xs * np.log(np.minimum(o / (1.0 + o), 0.999999))
        z = (lv - c.mu[t]) / c.sigma[t]
        scores[:, t] = dense + np.bincount(row, sparse, minlength=len(ev)) - np.log(c.sigma[t]) - 0.5 * z * z
    return scores + c.log_pi if weighted else scores


def _update_cells(c: Components, latents: int, weighted: bool, choose: bool):
    """New component and expression factors of a batch of cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, ev, z = b["key"].to_numpy(), b["ev"].to_numpy(), b["z"].to_numpy(dtype=np.int64)
            x = _sparse(b, latents)
            if choose:
                s = _component_scores(x, ev, np.log(ev), c, weighted)
                p = np.exp(s - s.max(axis=1, keepdims=True))
                cut = variates.uniform(variates.stream(key, 1), 0) * p.sum(axis=1)
                z = np.minimum((np.cumsum(p, axis=1) < cut[:, None]).sum(axis=1), p.shape[1] - 1)
            wide = variates.stream(key, 2)[:, None] + np.arange(latents, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
            rate = c.s[z] / (1.0 + c.s[z] * ev[:, None])
            phi = variates.gamma(wide, c.r[z] + x) * rate
            yield pd.DataFrame({"cell": b["cell"], "z": z, "scale": b["scale"], "ev": ev, "phi": list(phi), "phi_sum": phi.sum(axis=1), "ks": b["ks"], "xs": b["xs"]})

    return run


def _component_sums(c: Components, latents: int, what: str):
    """Fixed-point sums by (component, latent) that the r and s updates need."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, ev, z = b["key"].to_numpy(), b["ev"].to_numpy(), b["z"].to_numpy(dtype=np.int64)
            x = _sparse(b, latents)
            wide = variates.stream(key, 3)[:, None] + np.arange(latents, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
            r, s = c.r[z], c.s[z]
            if what == "r":
                first = variates.tables(wide, x, r).astype(np.float64)
                second = np.log1p(s * ev[:, None])
            else:
                first = variates.polyagamma(wide, x + r, np.log(s * ev[:, None]))
                second = (x - r) / 2.0 - first * np.log(ev)[:, None]
            for t in np.unique(z):
                on = z == t
                yield pd.DataFrame({
                    "t": t, "k": np.arange(latents),
                    "a": np.rint(first[on] * _FIX).astype(np.int64).sum(axis=0), "b": np.rint(second[on] * _FIX).astype(np.int64).sum(axis=0),
                })

    return run


def _update_scales(c: Components, latents: int):
    """Cell scale given Polya-Gamma variables (opt-in)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, ev, z = b["key"].to_numpy(), b["ev"].to_numpy(), b["z"].to_numpy(dtype=np.int64)
            x = _sparse(b, latents)
            wide = variates.stream(key, 4)[:, None] + np.arange(latents, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
            r, s = c.r[z], c.s[z]
            w = variates.polyagamma(wide, x + r, np.log(s * ev[:, None]))
            lv = np.log(ev / b["scale"].to_numpy())
            tau = TAU_SCALE + w.sum(axis=1)
            mean = ((x - r) / 2.0 - w * (np.log(s) + lv[:, None])).sum(axis=1) / tau
            scale = np.exp(mean + variates.normal(variates.stream(key, 5)) / np.sqrt(tau))
            yield pd.DataFrame({"cell": b["cell"], "z": z, "scale": scale, "phi": b["phi"], "phi_sum": b["phi_sum"]})

    return run


def _grid_sums(rows, components: int, latents: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.zeros((components, latents)), np.zeros((components, latents))
    for r in rows:
        a[r["t"], r["k"]], b[r["t"], r["k"]] = float(r["a"]) / _FIX, float(r["b"]) / _FIX
    return a, b


def _sums(cells: DataFrame, c: Components, latents: int, what: str) -> tuple[np.ndarray, np.ndarray]:
    part = cells.mapInPandas(_component_sums(c, latents, what), "t long, k long, a long, b long")
    total = part.groupBy("t", "k").agg(F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b"))
    return _grid_sums(total.collect(), *c.r.shape)  # T x K rows


def _volume_parameters(cells: DataFrame, c: Components, seed: int, it: int) -> Components:
    """Mean and spread of log volume per component, conjugate normal and inverse gamma."""
    lv = F.log("volume")
    rows = cells.groupBy("z").agg(F.count(F.lit(1)).alias("n"), keyed.exact_sum(lv).alias("s1"), keyed.exact_sum(lv * lv).alias("s2")).collect()
    n, s1, s2 = (np.zeros(len(c.mu)) for _ in range(3))
    for r in rows:
        n[r["z"]], s1[r["z"]], s2[r["z"]] = r["n"], r["s1"], r["s2"]
    g = rng(seed, it, 1)
    v = 1.0 / (1.0 / SIGMA0_VOLUME**2 + n / c.sigma**2)
    mu = v * (MU0_VOLUME / SIGMA0_VOLUME**2 + s1 / c.sigma**2) + np.sqrt(v) * g.standard_normal(len(n))
    spread = np.maximum(n * mu**2 - 2.0 * mu * s1 + s2, 0.0)
    sigma = 1.0 / np.sqrt(g.gamma(ALPHA_VOLUME + n / 2.0) / (BETA_VOLUME + spread / 2.0))
    return replace(c, mu=mu, sigma=sigma)


def gibbs_step(state: ModelState, opts: Options, burnin: bool, sample_z: bool = True) -> ModelState:
    """Update every model parameter once, given voxels and counts."""
    it, seed, k_all = state.iteration, opts.seed, state.latents
    vol = volumes(state.layers).select("cell", (F.col("voxels") * F.lit(state.grid.voxel_volume)).alias("volume"))
    cells = state.cells.join(vol, "cell")
    comp = _volume_parameters(cells, state.components, seed, it)

    seen = {name: Observation() for name in ("counts", "shares", "exposure", "background")}  # filled by the writes below
    labelled = label_counts(state.counts, state.states)
    lab = materialize(labelled.observe(seen["counts"], F.sum("n").alias("molecules"), F.sum(F.when(F.col("cell").isNotNull(), F.col("n"))).alias("assigned")), "labelled")
    own = F.col("latent") >= 0
    shares = allocate(state, cell_gene_counts(lab), opts, it).observe(
        seen["shares"], F.sum(F.when(own, F.col("x"))).alias("foreground"), F.sum(F.when(own, F.col("x") * F.col("log_lam"))).alias("gain"))
    alloc = materialize(shares.drop("log_lam"), "alloc")
    inside = alloc.where("latent >= 0")
    foreground = inside.groupBy("cell", "gene").agg(F.sum("x").alias("n"))

    per_cell = inside.groupBy("cell", "latent").agg(F.sum("x").alias("x")).groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("latent", "x"))).alias("lx")  # at most one entry per latent
    )
    rows = cells.join(per_cell, "cell", "left").select(
        "cell", "z", "scale", "phi", "phi_sum", (F.col("volume") * F.col("scale") if opts.use_scaled_cells else F.col("volume")).alias("ev"),
        F.col("lx.latent").alias("ks"), F.col("lx.x").alias("xs"),
        keyed.row_key(seed, it, F.lit("cell"), "cell").alias("key"),
    )
    updated = rows.observe(seen["exposure"], F.sum(F.col("ev") * F.col("phi_sum")).alias("exposure")).drop("phi_sum").mapInPandas(
        _update_cells(comp, k_all, opts.use_mixture_weights, sample_z),
        "cell long, z int, scale double, ev double, phi array<double>, phi_sum double, ks array<long>, xs array<long>",
    )
    updated = materialize(updated.withColumn("key", keyed.row_key(seed, it, F.lit("cell"), "cell")), "cells")

    g = rng(seed, it, 2)
    population = np.zeros(len(comp.mu))
    for r in updated.groupBy("z").count().collect():
        population[r["z"]] = r["count"]
    comp = replace(comp, log_pi=np.log(np.maximum(g.dirichlet(1.0 + population), 1e-300)))

    fixed = opts.dispersion if opts.dispersion is not None else (opts.burnin_dispersion if burnin and not opts.variable_burnin_dispersion else None)
    if fixed is not None:
        comp = replace(comp, r=np.full_like(comp.r, fixed))
    else:
        tables, logs = _sums(updated, comp, k_all, "r")
        r = g.gamma(opts.hyperparam_e_phi + tables) / (1.0 / opts.hyperparam_f_phi + logs)
        comp = replace(comp, r=np.maximum(r, 2e-4))
    omega, lean = _sums(updated, comp, k_all, "s")
    tau = opts.hyperparam_tau_phi + omega
    mean = (-opts.hyperparam_neg_mu_phi * opts.hyperparam_tau_phi + lean) / tau
    comp = replace(comp, s=np.exp(mean + g.standard_normal(tau.shape) / np.sqrt(tau)))

    if opts.use_scaled_cells:
        new_cells = updated.mapInPandas(_update_scales(comp, k_all), "cell long, z int, scale double, phi array<double>, phi_sum double")
        new_cells = materialize(new_cells, "scaled")
    else:
        new_cells = updated.select("cell", "z", F.lit(1.0).alias("scale"), "phi", "phi_sum")

    theta = _sample_theta(state, inside, seed, it)
    rates = _sample_rates(state, lab, alloc, seed, it, seen["background"])
    figures = {k: v or 0 for o in seen.values() for k, v in o.get.items()}
    metrics = Metrics(it, figures["molecules"], figures["assigned"], figures["foreground"], float(figures["gain"] - figures["exposure"] + figures["background"]))
    return replace(
        state, components=comp, cells=new_cells, theta=theta, rates=rates, foreground=foreground, iteration=it + 1, metrics=(*state.metrics, metrics),
    )


def _sample_theta(state: ModelState, inside: DataFrame, seed: int, it: int) -> DataFrame:
    """Loadings of factored genes: independent Gammas, normalised per latent."""
    if not state.hidden:
        return state.theta
    u = state.unfactored
    by_gene = inside.where(F.col("latent") >= u).groupBy("gene", "latent").agg(F.sum("x").alias("x"))
    maps = by_gene.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct((F.col("latent") - u).cast("int"), "x"))).alias("m"))
    factored = state.theta.where(F.col("theta").isNotNull()).select("gene").join(maps, "gene", "left")
    long = factored.select("gene", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(state.hidden - 1)),
        lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0)))).alias("k", "x"))
    drawn = long.withColumn("v", gamma_udf(keyed.row_key(seed, it, F.lit("theta"), "gene", "k"), F.lit(ALPHA_THETA) + F.col("x")))
    wide = drawn.groupBy("gene").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda e: e["v"]).alias("theta"))
    fresh = wide.select("gene", F.lit(None).cast("int").alias("slot"), "theta")
    return _normalize_theta(state.theta.where(F.col("slot").isNotNull()).unionByName(fresh), state.hidden)


def _sample_rates(state: ModelState, lab: DataFrame, alloc: DataFrame, seed: int, it: int, seen: Observation) -> DataFrame:
    """Background rates: Gamma(1 + x) / (1 + V) per (gene, layer, density)."""
    from cellgrid.plans.expectations import background_shape_rate

    back = unassigned_counts(lab).unionByName(alloc.where("latent = -1").select("gene", "k0", "density", F.col("x").alias("n")))
    post = background_shape_rate(back, state.rates.select("gene", "k0", "density"), state.region, ALPHA_BG, BETA_BG)
    draw = gamma_udf(keyed.row_key(seed, it, F.lit("rate"), "gene", "k0", "density"), F.col("shape").cast("double"))
    drawn = post.select("gene", "k0", "density", (draw / F.col("rate")).alias("rate"), (F.col("shape") - ALPHA_BG).alias("n"), (F.col("rate") - BETA_BG).alias("volume"))
    part = F.col("n") * F.log("rate") - F.col("rate") * F.col("volume")
    return materialize(drawn.observe(seen, F.sum(part).alias("background")).drop("n", "volume"), "rates")
