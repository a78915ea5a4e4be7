"""Readers, writers and round trips on small hand-made files."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import wkb
from cellgrid.operators.skew import dense_index
from cellgrid.options import PRESETS, Columns, Options, complete, validate
from cellgrid.plans import run as R
from cellgrid.plans import segment as S
from cellgrid.sinks import geojson, matrix, tables, text
from cellgrid.sinks import spatialdata as store
from cellgrid.sources import npy, transcripts, visium, zarr2
from cellgrid.sources import spatialdata as sd


def test_formats():
    assert [transcripts.infer_format(f"a{s}") for s in (".csv", ".csv.gz", ".parquet")] == ["csv", "csv-gz", "parquet"]
    with pytest.raises(ValueError):
        transcripts.infer_format("a.txt")


def test_presets_fill_and_yield():
    o = complete(Options(preset="xenium"))
    assert o.columns.gene == "feature_name" and o.min_qv == 20.0 and o.excluded_genes.startswith("^(Deprecated")
    o = complete(Options(preset="cosmx", columns=Columns(x="myx"), coordinate_scale=0.5))
    assert o.columns.x == "myx" and o.columns.y == "y_global_px" and o.coordinate_scale == 0.5 and o.non_unique_cell_ids
    assert complete(Options(preset="cosmx", include_neg_ctrls=True)).excluded_genes is None
    o = complete(Options(preset="visiumhd", spaceranger_barcode_mappings="m"))
    assert o.voxel_layers == 1 and o.resolution_scale == 1 and o.ignore_z_coord
    assert complete(Options(preset="xenium", use_cell_initialization=True)).columns.compartment is None
    assert set(PRESETS) == {"xenium", "cosmx", "cosmx_micron", "merscope", "merfish", "visiumhd"}


@pytest.mark.parametrize("bad", [
    {"voxel_layers": 257}, {"recorded_samples": 300}, {"ncomponents": 0}, {"burnin_voxel_size": 1.5, "voxel_size": 1.0},
    {"cellpose_x_transform": (1.0, 0.0, 0.0)}, {"preset": "visiumhd"}, {"cellpose_masks": "a", "spaceranger_barcode_mappings": "b"},
])
def test_validation(bad):
    with pytest.raises(ValueError):
        validate(Options(**bad))


def test_csv_reader(spark, tmp_path):
    path = str(tmp_path / "t.csv.gz")
    body = "target,x_global_px,y_global_px,z,CellComp,fov,cell,cell_ID\n" + "".join(
        f"{g},{x},2,1,{comp},{fov},{cell},{cid}\n" for g, x, comp, fov, cell, cid in
        [("A", 10, "Nuclear", 1, "c1", 7), ("B", 20, "Membrane", 2, "c1", 7), ("NegPrb1", 1, "Nuclear", 1, "c1", 7), ("C", 5, "Nuclear", 1, "c9", 0)])
    with open(path, "wb") as f:  # two gzip members in one file
        f.write(gzip.compress(body[:60].encode()) + gzip.compress(body[60:].encode()))
    got = {r.gene: r for r in transcripts.read_transcripts(spark, path, complete(Options(preset="cosmx"))).collect()}
    assert set(got) == {"A", "B", "C"}
    assert abs(got["A"].x - 1.2028) < 1e-9 and got["A"].z == 1.0
    assert got["A"].cell != got["B"].cell and got["A"].nucleus == got["A"].cell
    assert got["B"].nucleus is None and got["C"].cell is None
    with pytest.raises(ValueError):
        transcripts.read_transcripts(spark, path, Options())


def test_parquet_reader_prunes(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([("g", 1, 1, "a", "f", 1.0, 2.0, 3.0, 30.0, "x"), ("g", 2, 0, "UNASSIGNED", "f", 1.0, 2.0, 3.0, 10.0, "x")],
        "feature_name string, transcript_id long, overlaps_nucleus int, cell_id string, fov_name string, x_location float, y_location float, z_location float, qv float, never_read string"
    ).write.parquet(path)
    df = transcripts.read_transcripts(spark, path, complete(Options(preset="xenium")))
    assert [(r.transcript_id, r.cell, r.nucleus) for r in df.collect()] == [(1, "a", "a")]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    assert "never_read" not in plan and "GreaterThanOrEqual(qv" in plan


def visium_folder(tmp_path, spark):
    root = tmp_path / "binned" / "square_002um"
    (root / "raw_feature_bc_matrix").mkdir(parents=True)
    (root / "spatial").mkdir()
    put = lambda name, s: (root / name).write_bytes(gzip.compress(s.encode()))
    put("raw_feature_bc_matrix/features.tsv.gz", "id1\tA\tx\nid2\tB\tx\nid3\tC\tx\n")
    put("raw_feature_bc_matrix/barcodes.tsv.gz", "s1\ns2\n")
    put("raw_feature_bc_matrix/matrix.mtx.gz", "%%MatrixMarket\n%comment\n3 2 3\n1 1 4\n2 2 1\n3 1 2\n")
    (root / "spatial" / "scalefactors_json.json").write_text('{"microns_per_pixel": 0.5}')
    spark.createDataFrame([("s1", 10.0, 20.0), ("s2", 30.0, 40.0)], "barcode string, pxl_row_in_fullres double, pxl_col_in_fullres double").write.parquet(
        str(root / "spatial" / "tissue_positions.parquet"))
    return str(tmp_path / "binned")


def test_binned_reader(spark, tmp_path):
    got = {(r.gene, r.x, r.y, r.n) for r in visium.read_binned(spark, visium_folder(tmp_path, spark), "^C").collect()}
    assert got == {("A", 5.0, 10.0, 4), ("B", 15.0, 20.0, 1)}


@pytest.mark.parametrize("zipped", [False, True])
def test_masks(spark, tmp_path, zipped):
    masks, fixed, probs = np.array([[0, 1, 1], [2, 0, 0]], "u4"), np.array([[5, 5, 0], [0, 0, 5]], "u4"), np.full((2, 3), 0.25, "f4")
    paths = []
    for name, a in (("m", masks), ("f", fixed), ("p", probs)):
        path = tmp_path / f"{name}.npy{'.gz' if zipped else ''}"
        with (gzip.open(path, "wb") if zipped else open(path, "wb")) as f:
            np.save(f, a)
        paths.append(str(path))
    got = {(r.row_px, r.col_px, r.mask_id, r.frozen) for r in npy.read_masks(spark, paths[0], paths[2], paths[1]).collect()}
    assert got == {(0, 1, 1, False), (0, 2, 1, False), (1, 0, 2, False), (0, 0, 5, True), (1, 2, 5, True)}


def test_wkb_round_trip(spark):
    hole = struct.pack("<BII", 1, 3, 2) + b"".join(
        struct.pack("<I", len(r)) + np.array(r, "<f8").tobytes() for r in ([(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]))
    assert wkb.decode(hole) == [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]
    rings = [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}], [{"x": 5.0, "y": 5.0}]]
    df = spark.createDataFrame([(rings,)], f"rings {wkb.RINGS.simpleString()}")
    back = df.select(wkb.from_wkb(wkb.to_wkb("rings"))).first()[0]
    assert [[(p.x, p.y) for p in r] for r in back] == [[(0.0, 1.0), (2.0, 3.0)], [(5.0, 5.0)]]
    with pytest.raises(ValueError):
        wkb.decode(struct.pack("<BI", 1, 1))


def test_array_store_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(zarr2, "guess_chunk", lambda size, item, target=0: 3)
    df = spark.range(8).select(F.col("id").alias("idx"), (F.col("id") * 1.5).alias("value"), F.concat(F.lit("n-é"), F.col("id")).alias("name"))
    zarr2.write_array(df, f"{tmp_path}/a", 8, "<f4", ["value"])
    zarr2.write_array(df, f"{tmp_path}/s", 8, "|O", ["name"])
    zarr2.write_array(df.withColumn("twin", F.col("idx")), f"{tmp_path}/m", 8, "<f8", ["value", "twin"])
    assert [r.value for r in zarr2.read_array(spark, f"{tmp_path}/a").orderBy("idx").collect()] == [1.5 * i for i in range(8)]
    assert [r.value for r in zarr2.read_array(spark, f"{tmp_path}/s").orderBy("idx").collect()] == [f"n-é{i}" for i in range(8)]
    assert [(r.v0, r.v1) for r in zarr2.read_array(spark, f"{tmp_path}/m").orderBy("idx").collect()] == [(1.5 * i, float(i)) for i in range(8)]
    with pytest.raises(ValueError):
        zarr2.write_array(df, f"{tmp_path}/b", 9, "<f4", ["value"])


def test_blosc_frames():
    import pyarrow as pa

    raw = np.arange(300, dtype="<u4").tobytes()
    shuffled = np.frombuffer(raw, np.uint8).reshape(-1, 4).T.tobytes()
    streams = [pa.Codec("lz4_raw").compress(shuffled[i * 300 : (i + 1) * 300]).to_pybytes() for i in range(4)]
    body = b"".join(struct.pack("<i", len(s)) + s for s in streams)
    frame = bytes([2, 1, 0x01 | (1 << 5), 4]) + struct.pack("<III", len(raw), len(raw), 20 + len(body)) + struct.pack("<I", 20) + body
    assert zarr2._unblosc(frame) == raw
    plain = bytes([2, 1, 0x02, 4]) + struct.pack("<III", len(raw), len(raw), 16 + len(raw)) + raw
    assert zarr2._unblosc(plain) == raw


def test_counts_store(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/x"
    rows = [("g0", 0, 3), ("g1", 0, 1), ("g2", 2, 5)]
    counts = spark.createDataFrame(rows, "gene string, row long, value long")
    genes = dense_index(counts.select("gene"), ["gene"], "col")
    store.write_csr(counts.join(genes, "gene"), f"{path}/X", 3, 3)
    names = genes.select(F.col("col").alias("idx"), "gene")
    zarr2.write_group(f"{path}/var", {"_index": "gene"})
    zarr2.write_array(names, f"{path}/var/gene", 3, "|O", ["gene"])
    xy = spark.range(3).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("a"), F.lit(7.0).alias("b"))
    zarr2.write_array(xy, f"{path}/obsm/spatial", 3, "<f4", ["a", "b"])
    ids = spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("v"))
    zarr2.write_array(ids, f"{path}/obs/cell", 3, "<i4", ["v"])
    got = {(r.gene, r.x, r.y, r.n, r.cell) for r in sd.read_anndata(spark, path, None, None, "cell", "0", scale=2.0).collect()}
    assert got == {("g0", 0.0, 14.0, 3, None), ("g1", 0.0, 14.0, 1, None), ("g2", 4.0, 14.0, 5, "2")}
    with pytest.raises(ValueError):
        sd.read_anndata(spark, "a.zip")


def test_matrix_and_geojson(spark, tmp_path):
    e = spark.createDataFrame([(2, 1, 1.0), (1, 3, 2.256)], "row long, col long, value double")
    matrix.write_matrix(e, f"{tmp_path}/m", 2, 3)
    text.join_parts(spark, f"{tmp_path}/m", f"{tmp_path}/m.mtx.gz")
    assert gzip.open(f"{tmp_path}/m.mtx.gz", "rt").read().splitlines() == ["%%MatrixMarket matrix coordinate real general", "2 3 2", "1 3 2.26", "2 1 1.00"]
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]
    p = spark.createDataFrame([(c, [ring]) for c in (3, 1, 2)], f"cell long, rings {wkb.RINGS.simpleString()}")
    geojson.write_polygons(p, f"{tmp_path}/g")
    text.join_parts(spark, f"{tmp_path}/g", f"{tmp_path}/g.json.gz")
    doc = json.load(gzip.open(f"{tmp_path}/g.json.gz"))
    assert [f["properties"]["cell"] for f in doc["features"]] == [1, 2, 3]
    assert doc["features"][0]["geometry"] == {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]]}


def test_overwrite_guard(spark, tmp_path):
    target = tmp_path / "out.zarr"
    store.prepare_target(str(target), False)
    target.mkdir()
    with pytest.raises(FileExistsError):
        store.prepare_target(str(target), False)
    with pytest.raises(FileExistsError):  # not a store of ours
        store.prepare_target(str(target), True)
    zarr2.write_group(str(target))
    store.prepare_target(str(target), True)
    assert not target.exists()


def test_run_write_and_convert(spark, sf, tmp_path):
    from cellgrid.sources import fixtures

    src = str(tmp_path / "in.parquet")
    fixtures.transcripts(spark, sf).withColumnRenamed("gene", "feature_name").write.parquet(src)
    opts = Options(preset="xenium", burnin_voxel_size=2.0, voxel_size=1.0, voxel_layers=2, ncomponents=2, nhidden=3, nunfactored=4, sweeps_per_iter=1,
                   init_iterations=1, burnin_samples=0, samples=1, recorded_samples=1, hillclimb=0, check_consistency=True)
    out = {k: f"{tmp_path}/{k}{x}" for k, x in (
        ("spatialdata", ".zarr"), ("transcript_metadata", ".parquet"), ("cell_metadata", ".csv.gz"), ("expected_counts", ".mtx"), ("metagene_loadings", ".parquet"))}
    r = R.run(spark, src, opts, outputs=out)
    n = transcripts.read_transcripts(spark, src, complete(opts)).count()
    meta = spark.read.parquet(out["transcript_metadata"])
    assert meta.count() == n and meta.where("background = (assignment IS NOT NULL)").count() == 0
    fg = meta.where("NOT background").groupBy("assignment", "gene").count()
    assert {tuple(x) for x in fg.collect()} == {(x.cell, x.gene, x.n) for x in r.state.foreground.collect()}
    assert spark.read.parquet(out["metagene_loadings"]).columns[:2] == ["gene", "theta0"]
    R.convert(spark, out["spatialdata"], f"{tmp_path}/b.csv", f"{tmp_path}/b.json")
    assert spark.read.csv(f"{tmp_path}/b.csv", header=True).count() == n
    outlines = sd.read_outlines(spark, out["spatialdata"], "cell_boundaries", cell="cell")
    assert outlines.select("cell_id").distinct().count() == r.index.count()
    with pytest.raises(FileExistsError):
        R.run(spark, src, opts, outputs={"spatialdata": out["spatialdata"]})
    assert S.metagene_rates(r).columns[:2] == ["cell", "phi0"]


def test_write_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    for s in (".csv", ".csv.gz", ".parquet"):
        tables.write_table(df, f"{tmp_path}/t{s}")
    assert spark.read.csv(f"{tmp_path}/t.csv.gz", header=True).columns == ["x", "y"]
