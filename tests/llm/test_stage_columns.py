"""Every stage keeps columns of any name, and leaves no tables behind."""

import glob
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_samples import frame, nasty_texts  # noqa: E402

import corpus_pipeline  # noqa: E402
from cellgrid.llm import store, warc  # noqa: E402
from cellgrid.session import work_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["__n_words", "__words", "__trusted", "__row", "__id", "__th", "__spans", "__items", "__kept", "__score", "marks", "column0", "Text2"]


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_any_name(spark, number):
    docs = frame(spark, [r for r in nasty_texts() if r[1] is None or len(r[1]) < 50_000])
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(700 + k))
    plain = frame(spark, [r for r in nasty_texts() if r[1] is None or len(r[1]) < 50_000])
    stage = corpus_pipeline.STAGES[number][1]
    got, want = stage(spark, docs, SF), stage(spark, plain, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[name] == 700 + k for r in rows for k, name in enumerate(NAMES))
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted((str(r.doc_id), r.text or "") for r in want.collect())


def test_temporary_tables_are_deleted(spark):
    with store.temporary() as outer:
        with store.temporary() as keep:
            a, b = store.write_table(spark.range(3), "a"), keep(store.write_table(spark.range(4), "b"))
        assert b.count() == 4
        c = outer(store.write_table(spark.range(5), "c"))
    exists = lambda t: os.path.isdir(t._stored_at.removeprefix("file:"))
    assert [exists(t) for t in (a, b, c)] == [False, False, True]
    with pytest.raises(ValueError), store.temporary():
        d = store.write_table(spark.range(3), "d")
        raise ValueError
    assert not exists(d)


def test_a_run_leaves_only_what_its_result_reads(spark):
    folder = work_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/*"))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = [os.path.basename(p) for p in set(glob.glob(f"{folder}/*")) - before]
    assert not any(p.startswith(("rows", "sketches", "classes", "marks", "suffixes", "spans", "ranges", "quality_rules", "near_dedup", "substring_dedup")) for p in left)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id) AS html").repartition(40)
    manifest = warc.write_archives(pages, f"{tmp_path}/w")
    archives = manifest.select("path").distinct().count()
    read = warc.read_archives(manifest)
    assert archives > 3 and read.rdd.getNumPartitions() >= archives and read.count() == 400
