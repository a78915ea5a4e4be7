from pyspark.sql import functions as F

from cellgrid.operators.grid import Grid, voxel_counts, voxelize
from cellgrid.options import Columns, Options
from cellgrid.sources import fixtures
from cellgrid.sources.transcripts import canonical
from cellgrid.streaming import counts as stream


def test_streamed_counts_equal_batch(spark, sf, tmp_path):
    raw = fixtures.transcripts(spark, sf)
    opts = Options(columns=Columns(gene="gene", x="x_location", y="y_location", z="z_location", cell_id="cell_id", cell_id_unassigned="UNASSIGNED"))
    grid = Grid(0.0, 0.0, 0.0, 2.0, 4)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    halves = raw.randomSplit([0.5, 0.5], 1)
    for at, part in enumerate(halves):
        part.coalesce(1).write.mode("append").parquet(src)
        q = stream.write_updates(stream.stream_voxel_counts(stream.transcript_stream(spark, src, raw.schema, opts), grid), out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert not q.isActive and spark.read.parquet(out).select("batch").distinct().count() == at + 1
    last = spark.read.parquet(out).groupBy("i", "j", "k", "gene").agg(F.max_by("n", "batch").alias("n"))
    want = voxel_counts(voxelize(canonical(raw, opts), grid))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}
