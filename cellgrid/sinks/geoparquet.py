"""Outline tables that geometry tools can open: Parquet parts whose footers name the geometry column."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame

# Fixed value: the `geo` metadata of GeoParquet 1.0.
_VERSION = "1.0.0"


def geo_metadata(column: str = "geometry") -> bytes:
    return json.dumps({"version": _VERSION, "primary_column": column, "columns": {column: {"encoding": "WKB", "geometry_types": []}}}).encode()


def write_geoparquet(df: DataFrame, path: str, column: str = "geometry", compression: str = "zstd") -> int:
    """Replace ``path`` by one part per partition of ``df``; returns the number of rows.

    Tasks write under names of their own and rename when complete, so an attempt that is
    lost leaves no part, and a repeated one leaves the same part.
    """
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(target, True)
    files.mkdirs(target)
    folder = files.makeQualified(target).toString()

    def write(batches):
        from pyarrow import fs

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))
        name, rows, writer = f"part-{context.partitionId():05d}.parquet", 0, None
        draft = f"{base}/_{name}-{context.taskAttemptId()}"
        for batch in batches:
            if writer is None:
                schema = batch.schema.with_metadata({b"geo": geo_metadata(column)})
                writer = pq.ParquetWriter(draft, schema, filesystem=system, compression=compression)
            writer.write_table(pa.Table.from_batches([batch]).cast(schema))
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            system.move(draft, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    return df.mapInArrow(write, "rows long").groupBy().sum("rows").first()[0] or 0
