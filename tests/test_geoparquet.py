import glob
import json

import pyarrow.parquet as pq

from cellgrid.sinks.geoparquet import write_geoparquet


def test_every_part_names_its_geometry(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS cell", "CAST(CAST(id AS STRING) AS BINARY) AS geometry").repartitionByRange(3, "cell")
    path = str(tmp_path / "shapes.parquet")
    assert write_geoparquet(df, path) == 100
    assert write_geoparquet(df, path) == 100  # replaced, not added
    parts = glob.glob(f"{path}/part-*.parquet")
    assert len(parts) == 3 and not glob.glob(f"{path}/_*")
    for part in parts:
        geo = json.loads(pq.read_schema(part).metadata[b"geo"])
        assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB"
    assert {(r.cell, bytes(r.geometry)) for r in spark.read.parquet(path).collect()} == {(i, str(i).encode()) for i in range(100)}
    assert write_geoparquet(df.limit(0), path) == 0
