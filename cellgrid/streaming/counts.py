"""Incremental voxel counts and votes.

The grid operators are plain DataFrame functions, so they also run on a
stream; the grid must be given, since its origin cannot be known in advance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from cellgrid.operators.grid import Grid, voxel_counts, voxelize
from cellgrid.operators.initial import prior_votes
from cellgrid.options import Options
from cellgrid.sources.transcripts import canonical


def transcript_stream(spark: SparkSession, folder: str, schema: StructType, opts: Options) -> DataFrame:
    """Canonical transcripts of Parquet files as they arrive in ``folder``."""
    return canonical(spark.readStream.schema(schema).parquet(folder), opts)


def stream_voxel_counts(transcripts: DataFrame, grid: Grid) -> DataFrame:
    return voxel_counts(voxelize(transcripts, grid))


def stream_prior_votes(transcripts: DataFrame, grid: Grid) -> DataFrame:
    return prior_votes(voxelize(transcripts, grid))


def write_updates(counts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write changed totals of each batch to ``target/batch=N``; replays overwrite their own batch."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
