"""Whole runs: pick the input, segment it, write the requested outputs; and conversion of a written store."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid import __version__
from cellgrid.operators import initial, measures, outline, results
from cellgrid.operators.grid import Grid
from cellgrid.options import Options, complete
from cellgrid.plans import segment as S
from cellgrid.session import materialize
from cellgrid.sinks import baysor, geojson, matrix, tables
from cellgrid.sinks import spatialdata as store
from cellgrid.sources import npy, transcripts, visium
from cellgrid.sources import spatialdata as sd


def load(spark: SparkSession, path: str, opts: Options, kind: str = "table", table: str | None = None) -> DataFrame:
    """Canonical transcripts of a ``table``, ``binned`` folder, ``anndata`` or ``spatialdata`` store."""
    c = opts.columns
    if kind == "binned":
        t = visium.read_binned(spark, path, opts.excluded_genes)
        return t.withColumns({"fov": F.lit("0"), "cell": F.lit(None).cast("string"), "nucleus": F.lit(None).cast("string")})
    if kind == "anndata":
        return sd.read_anndata(spark, path, opts.excluded_genes, c.gene, c.cell_id, c.cell_id_unassigned or "", scale=opts.coordinate_scale)
    if kind == "spatialdata":
        return sd.read_spatial(spark, path, opts, table)
    if kind == "table":
        return transcripts.read_transcripts(spark, path, opts)
    raise ValueError(f"unknown input kind {kind!r}")


def prior_states(spark: SparkSession, path: str, opts: Options, barcode_positions: DataFrame | None = None) -> S.StatesFn | None:
    """How to initialise voxels, if not from the transcripts' own assignments."""
    if opts.cellpose_masks:
        xt, yt = opts.mask_transforms

        def from_masks(t: DataFrame, grid: Grid) -> DataFrame:
            pixels = npy.read_masks(spark, opts.cellpose_masks, opts.cellpose_cellprobs, opts.cellpose_masks_fixed)
            votes = initial.mask_votes(pixels, grid, xt, yt, grid.layers // 2, opts.prior_seg_reassignment_prob, opts.cellpose_cellprob_discount)
            return initial.states_from_masks(votes, grid, xt, yt, not opts.compat_mask_prior)

        return from_masks
    if opts.spaceranger_barcode_mappings:

        def from_barcodes(t: DataFrame, grid: Grid) -> DataFrame:
            mappings = spark.read.parquet(opts.spaceranger_barcode_mappings)
            positions = barcode_positions
            if positions is None:
                root = f"{path.rstrip('/')}/{visium.BINNED}/spatial"
                scale = visium.read_scale(spark, f"{root}/scalefactors_json.json")
                positions = visium.place_barcodes(spark.read.parquet(f"{root}/tissue_positions.parquet"), scale)
            lost = initial.unmatched_barcodes(mappings, positions).take(1)
            if lost:
                raise ValueError(f"no position for square {lost[0]['square_002um']}")
            z = t.agg((F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("z")).first()["z"]
            return initial.states_from_barcodes(mappings, positions, grid, z, opts.nuclear_reassignment_prob)

        return from_barcodes
    if opts.zarr_shape:

        def from_outlines(t: DataFrame, grid: Grid) -> DataFrame:
            rings = sd.read_outlines(spark, path, opts.zarr_shape, opts.zarr_shape_geometry_column, opts.zarr_shape_cell_id_column, opts.coordinate_scale)
            return initial.states_from_polygons(rings, grid, opts.prior_seg_reassignment_prob)

        return from_outlines
    return None


def run(
    spark: SparkSession, path: str, options: Options, kind: str = "table", table: str | None = None, outputs: dict[str, str] | None = None,
    overwrite: bool = False, include_transcripts: bool = True,
) -> S.Result:
    """Segment ``path`` and write ``outputs``, a map from output name to path.

    Names: spatialdata, counts, expected_counts, cell_metadata, transcript_metadata,
    gene_metadata, metagene_rates, metagene_loadings, cell_polygons,
    union_cell_polygons, cell_polygon_layers, voxel_counts.
    """
    began = time.time()
    opts = complete(options)
    if outputs and "spatialdata" in outputs and not overwrite:
        store.prepare_target(outputs["spatialdata"], False)
    t = load(spark, path, opts, kind, table)
    result = S.segment(t, opts, prior_states(spark, path, opts))
    write_outputs(result, opts, outputs or {}, {"version": __version__, "args": repr(options), "duration": f"{time.time() - began:.1f}"}, overwrite, include_transcripts)
    return result


def write_outputs(r: S.Result, opts: Options, outputs: dict[str, str], about: dict[str, str], overwrite: bool = False, include_transcripts: bool = True) -> None:
    state = r.state
    lab = materialize(measures.label_counts(state.counts, state.states), "labelled")
    counts = lab.where("cell IS NOT NULL").groupBy("cell", "gene").agg(F.sum("n").alias("n"))
    ncells, ngenes = r.index.count(), r.genes.count()
    writers = {
        "counts": lambda p: matrix.write_matrix(matrix.triplets(counts, r.genes), p, ncells, ngenes),
        "expected_counts": lambda p: matrix.write_matrix(matrix.triplets(
            r.expected.withColumnRenamed("mean", "n") if r.expected is not None else counts, r.genes), p, ncells, ngenes),
        "cell_metadata": lambda p: tables.write_table(S.result_cells(r), p),
        "transcript_metadata": lambda p: tables.write_table(tables.transcript_schema(S.result_transcripts(r)), p),
        "gene_metadata": lambda p: tables.write_table(S.result_genes(r, opts.density_bins), p),
        "metagene_rates": lambda p: tables.write_table(S.metagene_rates(r), p),
        "metagene_loadings": lambda p: tables.write_table(S.metagene_loadings(r), p),
        "cell_polygons": lambda p: geojson.write_polygons(results.consensus_polygons(state.states, lab, state.grid), p),
        "union_cell_polygons": lambda p: geojson.write_polygons(outline.flattened_polygons(state.states, state.grid), p),
        "cell_polygon_layers": lambda p: geojson.write_polygons(outline.polygons(state.states.where("cell IS NOT NULL"), state.grid), p, layered=True),
        "voxel_counts": lambda p: tables.write_table(tables.voxel_count_dump(state.counts, state.grid), p),
        "spatialdata": lambda p: store.write_store(
            p, S.result_cells(r), S.result_genes(r, opts.density_bins), r.genes, counts, r.transitions,
            results.consensus_polygons(state.states, lab, state.grid),
            tables.transcript_schema(S.result_transcripts(r)) if include_transcripts else None, about, overwrite),
    }
    unknown = set(outputs) - set(writers)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}; choose from {sorted(writers)}")
    for name, target in outputs.items():
        writers[name](target)


def convert(spark: SparkSession, source: str, transcripts_out: str, polygons_out: str) -> None:
    """Written store to the transcript CSV and geometry collection of the other tool's layout."""
    points = sd.read_own_points(spark, source)
    tables.write_table(baysor.transcript_table(points), transcripts_out, "csv")
    geojson.write_geometry_collection(baysor.outlines(sd.read_own_outlines(spark, source), points), polygons_out)
