"""Tables and small arrays that make up a running segmentation."""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.grid import Grid

MU0_VOLUME = float(np.log(10.0 * 10.0 * 0.5))
SIGMA0_VOLUME, ALPHA_VOLUME, BETA_VOLUME = 3.0, 4.0, 1.0
ALPHA_THETA, ALPHA_BG, BETA_BG, TAU_SCALE = 0.1, 1.0, 1.0, 10.0


@dataclass(frozen=True)
class Components:
    """Parameters per mixture component (and latent), small by construction: T x K numbers."""

    mu: np.ndarray
    sigma: np.ndarray
    log_pi: np.ndarray
    r: np.ndarray
    s: np.ndarray

    @classmethod
    def start(cls, components: int, latents: int) -> Components:
        return cls(
            np.full(components, MU0_VOLUME), np.full(components, SIGMA0_VOLUME), np.zeros(components),
            np.ones((components, latents)), np.ones((components, latents)),
        )


@dataclass(frozen=True)
class Metrics:
    """Progress of one iteration, observed while its tables were written.

    The log likelihood is that of the foreground and background counts; foreground rates
    are those the counts were allocated with, background rates the new ones.  Tasks that
    run again after a loss may count twice here; nothing else reads these figures.
    """

    iteration: int
    molecules: int
    assigned: int
    foreground: int
    log_likelihood: float

    @property
    def assigned_share(self) -> float:
        return self.assigned / self.molecules if self.molecules else 0.0

    @property
    def foreground_share(self) -> float:
        return self.foreground / self.molecules if self.molecules else 0.0


@dataclass(frozen=True)
class ModelState:
    """Everything one iteration reads and the next one replaces.

    states  i, j, k, cell, prior_cell, log_prior, log_1m_prior
    counts  i, j, k, gene, k0, density, di, dj, dk, n
    layers  cell, k, volume, surface (in voxels)
    cells   cell, z, scale, phi, phi_sum
    theta   gene, slot, theta (slot set: the gene has a latent of its own)
    rates   gene, k0, density, rate
    region  density, volume
    """

    grid: Grid
    states: DataFrame
    counts: DataFrame
    layers: DataFrame
    cells: DataFrame
    theta: DataFrame
    rates: DataFrame
    region: DataFrame
    components: Components
    unfactored: int
    hidden: int
    genes: int
    bins: int
    iteration: int = 0
    frozen: DataFrame | None = None
    edges: DataFrame | None = None  # unlike voxel pairs (a, b, cell_a, cell_b), kept by flips; None: to be made from states
    foreground: DataFrame | None = None
    expected: DataFrame | None = None  # cell, gene, n: foreground summed over recorded samples
    recorded: int = 0
    transitions: DataFrame | None = None  # from_cell, to_cell, n: summed likewise
    metrics: tuple[Metrics, ...] = ()
    census: tuple[int, int, int] | None = None  # fingerprint of the counts by origin, if consistency is checked

    @property
    def latents(self) -> int:
        return self.unfactored + self.hidden

    def frames(self) -> list[DataFrame | None]:
        return [getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)]

    def loadings(self) -> DataFrame:
        """``theta`` for a join by gene."""
        return if_small(self.theta, self.genes, 8 * self.hidden + 64)

    def background(self) -> DataFrame:
        """``rates`` for a join by (gene, layer, density)."""
        return if_small(self.rates, self.genes * self.grid.layers * self.bins, 64)


BROADCAST_LIMIT = 128 << 20


def if_small(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Broadcast a table whose counted rows fit the limit; larger ones are joined by shuffle."""
    return F.broadcast(df) if rows * width <= BROADCAST_LIMIT else df


def rng(seed: int, iteration: int, stage: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, iteration, stage])))


def volumes(layers: DataFrame) -> DataFrame:
    return layers.groupBy("cell").agg(F.sum("volume").alias("voxels"))
