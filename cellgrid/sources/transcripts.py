"""Transcript tables in CSV and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import prep
from cellgrid.options import Options

FORMATS = {".csv.gz": "csv-gz", ".csv": "csv", ".parquet": "parquet"}


def infer_format(name: str) -> str:
    for suffix, fmt in FORMATS.items():
        if name.rstrip("/").endswith(suffix):
            return fmt
    raise ValueError(f"cannot infer a table format from {name!r}; expected one of {sorted(FORMATS)}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Untyped scan; Parquet keeps its types and prunes columns, CSV columns stay text."""
    fmt = infer_format(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    df = spark.read.csv(path, header=True)
    # one gzip stream is a single split: spread it before the real work
    return df.repartition(spark.sparkContext.defaultParallelism) if fmt == "csv-gz" else df


def _need(df: DataFrame, name: str | None, what: str) -> str:
    if name is None:
        raise ValueError(f"no {what} column given")
    if name not in df.columns:
        raise ValueError(f"{what} column {name!r} is not in the table: {df.columns}")
    return name


def _text(column: str):
    # backticks keep names with dots whole
    return F.col("`" + re.sub("`", "``", column) + "`")


def canonical(df: DataFrame, opts: Options) -> DataFrame:
    """Project, filter and normalise any transcript table to the canonical columns."""
    c = opts.columns
    present = lambda name: name is not None and name in df.columns
    cols = {
        "gene": _text(_need(df, c.gene, "gene")).cast("string"),
        "x": _text(_need(df, c.x, "x")).cast("double"),
        "y": _text(_need(df, c.y, "y")).cast("double"),
        "z": F.lit(0.0) if opts.ignore_z_coord or not present(c.z) else _text(c.z).cast("double"),
        "n": F.lit(1).cast("bigint"),
    }
    if present(c.transcript_id):
        cols["transcript_id"] = _text(c.transcript_id).cast("bigint")
    raw = {"_cell": c.cell_id, "_compartment": c.compartment, "_assignment": c.cell_assignment}
    cols.update({k: _text(v).cast("string") for k, v in raw.items() if present(v)})
    if c.fov is not None:
        cols["fov"] = _text(c.fov).cast("string") if present(c.fov) else F.lit("0")
    else:
        cols["fov"] = F.lit("0")
    if present(c.qv):
        # a cast would keep the quality test from reaching the Parquet scan
        cols["qv"] = _text(c.qv).cast("double") if df.schema[c.qv].dataType.typeName() == "string" else _text(c.qv)
    t = df.select(*[v.alias(k) for k, v in cols.items()])
    if opts.min_qv is not None:
        t = prep.quality_filter(t, opts.min_qv)
    t = prep.exclude_genes(t, opts.excluded_genes)
    if opts.coordinate_scale is not None:
        t = prep.scale_coordinates(t, opts.coordinate_scale)
    if "_cell" in t.columns:
        t = prep.normalize_assignment(
            t, "_cell", "" if c.cell_id_unassigned is None else c.cell_id_unassigned,
            "_compartment" if "_compartment" in t.columns else None, c.compartment_nuclear,
            "_assignment" if "_assignment" in t.columns else None, c.cell_assignment_unassigned,
            "fov" if opts.non_unique_cell_ids else None,
        )
    else:
        t = t.withColumns({"cell": F.lit(None).cast("string"), "nucleus": F.lit(None).cast("string")})
    return t.drop("_cell", "_compartment", "_assignment", "qv")


def read_transcripts(spark: SparkSession, path: str, opts: Options) -> DataFrame:
    return canonical(read_table(spark, path), opts)
