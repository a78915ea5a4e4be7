"""Spatial object store: count table, outlines and transcripts, written by chunk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.functions.wkb import to_wkb
from cellgrid.sinks.geoparquet import write_geoparquet
from cellgrid.sources.files import exists, read_bytes, resolve, write_bytes
from cellgrid.sources.zarr2 import write_array, write_group

TABLE, SHAPES, POINTS = "table", "cell_boundaries", "transcripts"
_DICT = {"encoding-type": "dict", "encoding-version": "0.1.0"}
_ARRAY = {"encoding-type": "array", "encoding-version": "0.2.0"}
_STRINGS = {"encoding-type": "string-array", "encoding-version": "0.2.0"}
_BLOCK = 1 << 16


def prepare_target(path: str, overwrite: bool) -> None:
    """Refuse an existing target; with ``overwrite`` delete it only if it is such a store."""
    if not exists(path):
        return
    if not overwrite:
        raise FileExistsError(f"{path} exists; ask for overwriting explicitly")
    if read_bytes(f"{path}/.zgroup") is None:
        raise FileExistsError(f"{path} is not an array store, refusing to delete it")
    fs, inner = resolve(path)
    fs.delete_dir(inner)


def running_total(df: DataFrame, value: str) -> DataFrame:
    """``idx, start``: sum of ``value`` before each dense ``idx``; blocks are summed first."""
    b = df.withColumn("b", F.floor(F.col("idx") / F.lit(float(_BLOCK))))
    blocks = b.groupBy("b").agg(F.sum(value).alias("v"))
    over = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per 65536 cells
    base = blocks.select("b", F.coalesce(F.sum("v").over(over), F.lit(0)).alias("base"))
    inner = Window.partitionBy("b").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return b.join(base, "b").select("idx", (F.col("base") + F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("start"), value)


def write_csr(entries: DataFrame, path: str, rows: int, cols: int, dtype: str = "<u4") -> None:
    """Compressed sparse rows from 0-based ``row, col, value``."""
    spark = entries.sparkSession
    sizes = entries.groupBy("row").agg(F.count(F.lit(1)).alias("m"))
    every = spark.range(rows).select(F.col("id").alias("idx")).join(sizes.withColumnRenamed("row", "idx"), "idx", "left")
    starts = running_total(every.select("idx", F.coalesce("m", F.lit(0)).alias("m")), "m")
    inside = Window.partitionBy("row").orderBy("col")
    placed = entries.join(starts.select(F.col("idx").alias("row"), "start"), "row").select(
        (F.col("start") + F.row_number().over(inside) - 1).alias("idx"), "col", "value")
    total = entries.count()
    write_group(path, {"encoding-type": "csr_matrix", "encoding-version": "0.1.0", "shape": [rows, cols]})
    write_array(placed, f"{path}/data", total, dtype, ["value"])
    write_array(placed, f"{path}/indices", total, "<i4", ["col"])
    ends = starts.select((F.col("idx") + 1).alias("idx"), (F.col("start") + F.col("m")).alias("value"))
    zero = spark.range(1).select(F.col("id").alias("idx"), F.lit(0).cast("bigint").alias("value"))
    write_array(zero.unionByName(ends), f"{path}/indptr", rows + 1, "<i8", ["value"])


def _frame(path: str, df: DataFrame, size: int, index: str, columns: dict[str, str]) -> None:
    write_group(path, {"encoding-type": "dataframe", "encoding-version": "0.2.0", "_index": index, "column-order": [c for c in columns if c != index]})
    for name, dtype in columns.items():
        write_array(df, f"{path}/{name}", size, dtype, [name], _STRINGS if dtype == "|O" else _ARRAY)


def _scalar(path: str, value: str) -> None:
    body = value.encode()
    meta = {"zarr_format": 2, "shape": [], "chunks": [], "dtype": "|O", "compressor": None, "fill_value": "", "order": "C", "filters": [{"id": "vlen-utf8"}]}
    write_bytes(f"{path}/.zarray", json.dumps(meta).encode())
    write_bytes(f"{path}/.zattrs", json.dumps({"encoding-type": "string", "encoding-version": "0.2.0"}).encode())
    write_bytes(f"{path}/0", (1).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)


def _identity(axes: list[str]) -> list[dict]:
    side = lambda name: {"axes": [{"name": a, "type": "space", "unit": "unit"} for a in axes], "name": name}
    return [{"input": side("".join(axes)), "output": side("global"), "type": "identity"}]


def write_store(
    path: str, cells: DataFrame, genes: DataFrame, gene_ids: DataFrame, counts: DataFrame, transitions: DataFrame | None,
    polygons: DataFrame, transcripts: DataFrame | None, run: dict[str, str], overwrite: bool = False,
) -> None:
    """``cells`` is the cell table with dense ``cell`` ids, ``counts`` holds (cell, gene, n)."""
    prepare_target(path, overwrite)
    ncells, ngenes = cells.count(), gene_ids.count()
    write_group(path)
    table = f"{path}/tables/{TABLE}"
    write_group(f"{path}/tables")
    write_group(table, {
        "encoding-type": "anndata", "encoding-version": "0.1.0", "instance_key": None, "region": None, "region_key": None,
        "spatialdata-encoding-type": "ngff:regions_table", "version": "0.1",
    })
    entries = counts.join(gene_ids, "gene").select(F.col("cell").alias("row"), F.col("gene_id").alias("col"), F.col("n").alias("value"))
    write_csr(entries, f"{table}/X", ncells, ngenes)
    obs = cells.withColumnRenamed("cluster", "component").select(
        F.col("cell").alias("idx"), "cell", F.col("cell").cast("string").alias("_index"), F.lit(SHAPES).alias("region"), "original_cell_id",
        "centroid_x", "centroid_y", "centroid_z", "component", "volume", "surface_area", "scale")
    _frame(f"{table}/obs", obs, ncells, "_index", {
        "_index": "|O", "cell": "<u4", "region": "|O", "original_cell_id": "|O", "centroid_x": "<f4", "centroid_y": "<f4", "centroid_z": "<f4",
        "component": "<u2", "volume": "<f4", "surface_area": "<f4", "scale": "<f4",
    })
    lams = [c for c in genes.columns if c.startswith("lambda_bg")]
    var = genes.join(gene_ids, "gene").select(F.col("gene_id").alias("idx"), "gene", "total_count", *lams)
    _frame(f"{table}/var", var, ngenes, "gene", {"gene": "|O", "total_count": "<u4", **{c: "<f4" for c in lams}})
    write_group(f"{table}/obsm", _DICT)
    write_array(obs, f"{table}/obsm/spatial", ncells, "<f4", ["centroid_x", "centroid_y"], _ARRAY)
    write_group(f"{table}/obsp", _DICT)
    if transitions is not None:
        flows = transitions.select(F.col("from_cell").alias("row"), F.col("to_cell").alias("col"), F.col("n").alias("value"))
        write_csr(flows, f"{table}/obsp/transition_counts", ncells, ncells)
    for name in ("layers", "varm", "varp", "uns", "uns/spatialdata_attrs", "uns/run"):
        write_group(f"{table}/{name}", _DICT)
    for key, value in (("region", SHAPES), ("region_key", "region"), ("instance_key", "cell")):
        _scalar(f"{table}/uns/spatialdata_attrs/{key}", value)
    for key, value in run.items():
        _scalar(f"{table}/uns/run/{key}", value)

    write_group(f"{path}/shapes")
    write_group(f"{path}/shapes/{SHAPES}", {
        "spatialdata_attrs": {"version": "0.2"}, "encoding-type": "ngff:shapes", "axes": ["x", "y"], "coordinateTransformations": _identity(["x", "y"])})
    shapes = polygons.select("cell", to_wkb("rings").alias("geometry")).repartitionByRange("cell").sortWithinPartitions("cell")
    write_geoparquet(shapes, f"{path}/shapes/{SHAPES}/shapes.parquet")
    write_group(f"{path}/points")
    if transcripts is not None:
        write_group(f"{path}/points/{POINTS}", {
            "spatialdata_attrs": {"version": "0.2", "feature_key": "gene"}, "encoding-type": "ngff:points", "axes": ["x", "y", "z"],
            "coordinateTransformations": _identity(["x", "y", "z"])})
        transcripts.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/points/{POINTS}/points.parquet")
