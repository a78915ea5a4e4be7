"""Flat result tables as CSV, gzip CSV or Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.grid import Grid
from cellgrid.operators.skew import expand_copies
from cellgrid.sources.transcripts import infer_format


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    fmt = fmt or infer_format(path)
    w = df.write.mode(mode)
    if fmt == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif fmt in ("csv", "csv-gz"):
        w.option("header", True).option("compression", "gzip" if fmt == "csv-gz" else "none").csv(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}")


def transcript_schema(transcripts: DataFrame) -> DataFrame:
    """Output columns of the transcript table, one row per molecule, single-precision coordinates."""
    t = transcripts if "transcript_id" in transcripts.columns else transcripts.withColumn("transcript_id", F.lit(None).cast("bigint"))
    t = expand_copies(t)
    single = ["x", "y", "z", "observed_x", "observed_y", "observed_z"]
    return t.select("transcript_id", *[F.col(c).cast("float").alias(c) for c in single], "gene", F.col("assignment").cast("bigint").alias("assignment"), "background")


def voxel_count_dump(counts: DataFrame, grid: Grid) -> DataFrame:
    """Count entries with voxel centres and offsets, for inspection."""
    return counts.select(
        "gene", F.col("n").alias("count"), grid.center_x(F.col("i")).alias("x"), grid.center_y(F.col("j")).alias("y"),
        grid.center_z(F.col("k")).alias("z"), F.col("di").alias("dx"), F.col("dj").alias("dy"), F.col("dk").alias("dz"),
    )
