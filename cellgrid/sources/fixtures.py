"""Adapter views: the transcript-shaped inputs derived from the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per molecule; cells are overlapping ~10x10 um patches on a 12 um lattice."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey * 8 + l_linenumber AS transcript_id",
        "p_brand AS gene",
        "l_quantity AS qv",
        "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS overlaps_nucleus",
        "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'UNASSIGNED'"
        " ELSE CONCAT('c', CAST(l_suppkey AS STRING)) END AS cell_id",
        "CONCAT('fov', CAST(l_suppkey % 4 AS STRING)) AS fov_name",
        "(l_suppkey % 10) * 12 + ((l_partkey * 7919 + l_orderkey * 31) % 1000) / CAST(100 AS DOUBLE) AS x_location",
        "CAST(FLOOR(l_suppkey / CAST(10 AS DOUBLE)) AS BIGINT) * 12"
        " + ((l_orderkey * 104729 + l_partkey * 17) % 1000) / CAST(100 AS DOUBLE) AS y_location",
        "CAST(l_linenumber AS DOUBLE) AS z_location",
    )


def fov_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "CONCAT('fov', CAST(r_regionkey AS STRING)) AS fov_name",
        "CAST(r_regionkey * 500 AS DOUBLE) AS x_fov",
        "CAST(r_regionkey * -250 AS DOUBLE) AS y_fov",
    )


def barcode_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CONCAT('bc', CAST(p_partkey AS STRING)) AS barcode",
        "CAST((p_partkey % 40) * 2 AS DOUBLE) AS pxl_row_in_fullres",
        "CAST(CAST(FLOOR(p_partkey / CAST(40 AS DOUBLE)) AS BIGINT) * 2 AS DOUBLE) AS pxl_col_in_fullres",
    )


def barcode_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "CONCAT('bc', CAST(p_partkey AS STRING)) AS square_002um",
        "CASE WHEN p_size % 5 = 0 THEN NULL ELSE CONCAT('cell', CAST(p_size AS STRING)) END AS cell_id",
        "p_partkey % 3 <> 0 AS in_nucleus",
    )


def bin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return (
        line.groupBy("l_partkey", (F.col("l_suppkey") % 20).alias("g"))
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("CONCAT('bc', CAST(l_partkey AS STRING)) AS barcode", "CONCAT('g', CAST(g AS STRING)) AS gene", "n")
    )


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 6 <> 0").selectExpr(
        "CAST(p_partkey % 50 AS INT) AS row_px",
        "CAST(FLOOR(p_partkey / CAST(50 AS DOUBLE)) AS INT) AS col_px",
        "CAST(1 + (p_partkey % 50) % 7 AS INT) AS mask_id",
        "(p_size - 25) / CAST(10 AS DOUBLE) AS cellprob_logit",
    )


def polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("v"))
        .selectExpr(
            "s_suppkey AS polygon",
            "CONCAT('c', CAST(s_suppkey AS STRING)) AS cell_id",
            "v AS vertex",
            "(s_suppkey % 10) * 12 + CAST(CASE WHEN v IN (1, 2) THEN 9.5 ELSE 0.25 END AS DOUBLE) AS x",
            "CAST(FLOOR(s_suppkey / CAST(10 AS DOUBLE)) AS BIGINT) * 12"
            " + CAST(CASE WHEN v IN (2, 3) THEN 9.5 ELSE 0.25 END AS DOUBLE) AS y",
        )
    )
