"""Comparison of tables that are kept by changes with fresh ones, without sorting or shuffling their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.operators import measures
from cellgrid.operators.initial import mismatch_edges
from cellgrid.plans.passes import EDGE
from cellgrid.plans.state import ModelState

Fingerprint = tuple[int, int, int]


def fingerprint(df: DataFrame, columns: list[str]) -> Fingerprint:
    """Rows, sum and exclusive or of two row hashes: equal for equal multisets of rows in any order, NULLs told apart from values."""
    fields = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    total = F.sum(F.xxhash64(F.lit(1), *fields).cast("decimal(38,0)"))
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(total, F.lit(0)).alias("s"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(2), *fields)), F.lit(0)).alias("x")).first()
    return int(got["n"]), int(got["s"]), int(got["x"])


def census(counts: DataFrame) -> Fingerprint:
    """Of molecules by gene and by the voxel, layer and density where they were observed; moves leave it as it is."""
    origin = [(F.col(c) - F.col(f"d{c}")).alias(f"o{c}") for c in "ijk"]
    by = ["oi", "oj", "ok", "gene", "k0", "density"]
    return fingerprint(counts.select(*origin, "gene", "k0", "density", "n").groupBy(*by).agg(F.sum("n").cast("bigint").alias("n")), [*by, "n"])


def check_consistency(state: ModelState) -> None:
    """Raise if layer shapes, edges or counts that were kept by changes differ from recomputed ones."""
    shape = ["cell", "k", "volume", "surface"]
    fresh = measures.layer_volume_surface(state.states, state.grid)
    if fingerprint(fresh, shape) != fingerprint(state.layers, shape):
        raise AssertionError("inconsistent layer shape")
    if state.edges is not None and fingerprint(mismatch_edges(state.states, state.grid), EDGE) != fingerprint(state.edges, EDGE):
        raise AssertionError("inconsistent edges")
    if state.census is not None and census(state.counts) != state.census:
        raise AssertionError("inconsistent counts")
