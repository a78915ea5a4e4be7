"""Transcript table and geometry collection in the layout of another segmentation tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.operators.outline import largest_ring


def transcript_table(transcripts: DataFrame) -> DataFrame:
    """``cell-N`` labels, empty for background; a missing transcript id becomes 0."""
    cell = F.when(F.col("assignment").isNull(), F.lit("")).otherwise(F.concat(F.lit("cell-"), F.col("assignment").cast("string")))
    return transcripts.select(
        F.coalesce("transcript_id", F.lit(0)).alias("transcript_id"), cell.alias("cell"),
        F.col("background").alias("is_noise"), "x", "y", "z",
    )


def outlines(polygons: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Largest ring of each cell that has a transcript."""
    used = transcripts.where(F.col("assignment").isNotNull()).select(F.col("assignment").alias("cell"))
    return polygons.join(used, "cell", "left_semi").select("cell", largest_ring(F.col("rings")).alias("ring"))
