"""Transcripts and outlines from array-store objects: count tables, point tables, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.functions.wkb import from_wkb
from cellgrid.operators import prep
from cellgrid.operators.skew import dense_index
from cellgrid.options import Options
from cellgrid.sources import zarr2
from cellgrid.sources.files import exists

DEFAULT_GENE = "gene"


def read_anndata(
    spark: SparkSession, path: str, excluded: str | None = None, gene_column: str | None = None, cell_column: str | None = None,
    unassigned: str = "", coordinate_key: str = "spatial", scale: float | None = None,
) -> DataFrame:
    """Spot x gene counts with spot coordinates; every assigned spot counts as nuclear.

    The index pointer says at which entry each spot starts. Entries and spot
    starts are sorted together inside fixed blocks of positions and every entry
    takes the last start before it; a spot that spans blocks is listed in each.
    """
    if path.endswith(".zip"):
        raise ValueError("zipped stores are not supported, unpack the directory first")
    kind = zarr2.attributes(f"{path}/X").get("encoding-type")
    if kind != "csr_matrix":
        raise ValueError(f"counts must be stored as csr_matrix, not {kind!r}")
    entries = zarr2.read_array(spark, f"{path}/X/data").select("idx", F.col("value").cast("bigint").alias("n")).join(
        zarr2.read_array(spark, f"{path}/X/indices").select("idx", F.col("value").alias("gene_idx")), "idx")
    ptr = zarr2.read_array(spark, f"{path}/X/indptr")
    nxt = ptr.select((F.col("idx") - 1).alias("idx"), F.col("value").alias("end"))
    spots = ptr.join(nxt, "idx").select(F.col("idx").alias("spot"), F.col("value").alias("start"), "end").where("start < end")
    block = 1 << 16
    first, last = F.floor(F.col("start") / F.lit(float(block))), F.floor((F.col("end") - 1) / F.lit(float(block)))
    starts = spots.withColumn("block", F.explode(F.sequence(first, last))).select(
        "block", F.greatest("start", F.col("block") * block).alias("idx"), F.lit(0).alias("entry"), "spot",
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("gene_idx"))
    marked = entries.select(
        F.floor(F.col("idx") / F.lit(float(block))).alias("block"), "idx", F.lit(1).alias("entry"), F.lit(None).cast("bigint").alias("spot"),
        "n", F.col("gene_idx").cast("bigint").alias("gene_idx"))
    upto = Window.partitionBy("block").orderBy("idx", "entry").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = starts.unionByName(marked).withColumn("spot", F.last("spot", ignorenulls=True).over(upto)).where("entry = 1")
    var = zarr2.attributes(f"{path}/var")
    gene = gene_column or var.get("_index", "_index")
    genes = zarr2.read_array(spark, f"{path}/var/{gene}").select(F.col("idx").alias("gene_idx"), F.col("value").alias("gene"))
    genes = prep.exclude_genes(genes, excluded)
    xy = zarr2.read_array(spark, f"{path}/obsm/{coordinate_key}")
    if len(xy.columns) != 3:
        raise ValueError("spot coordinates must have two columns")
    s = F.lit(1.0 if scale is None else float(scale))
    where = xy.select(F.col("idx").alias("spot"), (F.col("v0").cast("double") * s).alias("x"), (F.col("v1").cast("double") * s).alias("y"))
    if cell_column is not None:
        ids = zarr2.read_array(spark, f"{path}/obs/{cell_column}")
        raw = F.col("value").cast("string")
        where = where.join(ids.select(F.col("idx").alias("spot"), F.when(raw != F.lit(unassigned), raw).alias("cell")), "spot")
    else:
        where = where.withColumn("cell", F.lit(None).cast("string"))
    return (
        rows.select("spot", "gene_idx", "n").where("n > 0").join(genes, "gene_idx").join(where, "spot")
        .select("gene", "x", "y", F.lit(0.0).alias("z"), "n", F.lit("0").alias("fov"), "cell", F.col("cell").alias("nucleus"))
    )


def read_points(spark: SparkSession, path: str, opts: Options) -> DataFrame:
    """Point table of a spatial object; a missing depth is 0, assigned points count as nuclear."""
    c = opts.columns
    df = spark.read.parquet(f"{path}/points/transcripts/points.parquet")
    z = F.col(c.z).cast("double") if c.z and c.z in df.columns and not opts.ignore_z_coord else F.lit(0.0)
    raw = F.col(c.cell_id).cast("string") if c.cell_id else F.lit(None).cast("string")
    cell = F.when(raw != F.lit(c.cell_id_unassigned or ""), raw)
    t = df.select(
        F.col(c.gene or DEFAULT_GENE).cast("string").alias("gene"), F.col(c.x or "x").cast("double").alias("x"), F.col(c.y or "y").cast("double").alias("y"),
        z.alias("z"), F.lit(1).cast("bigint").alias("n"), F.lit("0").alias("fov"), cell.alias("cell"), cell.alias("nucleus"),
    )
    t = prep.exclude_genes(t, opts.excluded_genes)
    return t if opts.coordinate_scale is None else prep.scale_coordinates(t, opts.coordinate_scale)


def read_spatial(spark: SparkSession, path: str, opts: Options, table: str | None = None) -> DataFrame:
    """Transcripts from the named count table if given, else from the points."""
    if table is None:
        return read_points(spark, path, opts)
    c = opts.columns
    return read_anndata(spark, f"{path}/tables/{table}", opts.excluded_genes, c.gene, c.cell_id, c.cell_id_unassigned or "", scale=opts.coordinate_scale)


def read_outlines(spark: SparkSession, path: str, shapes: str, geometry: str = "geometry", cell: str = "cell_id", scale: float | None = None) -> DataFrame:
    """Exterior rings as ``polygon, cell_id, vertex, x, y``; a ring number per polygon part, in cell order."""
    df = spark.read.parquet(f"{path}/shapes/{shapes}/shapes.parquet")
    s = F.lit(1.0 if scale is None else float(scale))
    parts = df.select(F.col(cell).cast("string").alias("cell_id"), F.posexplode(from_wkb(geometry)).alias("part", "ring"))
    ids = dense_index(parts.select("cell_id", "part"), ["cell_id", "part"], "polygon")
    return parts.join(ids, ["cell_id", "part"]).select("polygon", "cell_id", F.posexplode("ring").alias("vertex", "p")).select(
        "polygon", "cell_id", "vertex", (F.col("p.x") * s).alias("x"), (F.col("p.y") * s).alias("y"))


def read_own_points(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts of a store written by this package, by column name."""
    where = f"{path}/points/transcripts/points.parquet"
    if not exists(where):
        raise ValueError(f"{path} holds no transcripts (they were excluded when it was written)")
    return spark.read.parquet(where)


def read_own_outlines(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/shapes/cell_boundaries/shapes.parquet")
    return df.select(F.col("cell").cast("bigint").alias("cell"), from_wkb("geometry").alias("rings"))
