import pytest

from cellgrid.__main__ import OUTPUTS, main, options_of, parser
from cellgrid.options import Options


def test_flags_become_options():
    args = parser().parse_args([
        "segment", "in.parquet", "--preset", "xenium", "--voxel-layers", "2", "--no-diffusion", "--cellpose-x-transform", "1", "0", "5",
        "--column-gene", "g", "--min-qv", "20.5", "--output-counts", "c.mtx.gz",
    ])
    o = options_of(args)
    assert (o.preset, o.voxel_layers, o.no_diffusion, o.cellpose_x_transform, o.columns.gene, o.min_qv) == ("xenium", 2, True, (1.0, 0.0, 5.0), "g", 20.5)
    assert getattr(args, "output-counts") == "c.mtx.gz"
    assert options_of(parser().parse_args(["segment", "x"])) == Options()


def test_bad_arguments_stop():
    for argv in ([], ["segment"], ["segment", "x", "--preset", "nothing"], ["convert", "a"]):
        with pytest.raises(SystemExit):
            parser().parse_args(argv)


def test_segment_from_the_command_line(spark, tmp_path):
    rows = [(i, float(i % 20), float(i // 20), 1.0 + i % 3, f"g{i % 4}", f"c{i % 20 // 10}", "1") for i in range(400)]
    spark.createDataFrame(rows, "t long, x double, y double, z double, g string, c string, nuc string").write.parquet(str(tmp_path / "in.parquet"))
    main([
        "segment", str(tmp_path / "in.parquet"), "--column-gene", "g", "--column-transcript-id", "t", "--column-x", "x", "--column-y", "y", "--column-z", "z",
        "--column-cell-id", "c", "--column-cell-id-unassigned", "none", "--column-compartment", "nuc", "--column-compartment-nuclear", "1",
        "--burnin-samples", "0", "--samples", "0", "--recorded-samples", "0", "--hillclimb", "0", "--init-iterations", "1", "--sweeps-per-iter", "1",
        "--ncomponents", "2", "--nhidden", "2", "--nunfactored", "2", "--voxel-size", "1", "--burnin-voxel-size", "2", "--voxel-layers", "1",
        "--output-cell-metadata", str(tmp_path / "cells.parquet"),
    ])
    assert spark.read.parquet(str(tmp_path / "cells.parquet")).count() == 2
    assert set(OUTPUTS) >= {"counts", "spatialdata"}
