"""Cell outlines as gzip GeoJSON documents, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.sinks.text import write_parts


def _ring(r: Column) -> Column:
    return F.transform(r, lambda p: F.array(p["x"], p["y"]))


def multipolygon(rings: Column) -> Column:
    coords = F.transform(rings, lambda r: F.array(_ring(r)))
    return F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))


def polygon(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(_ring(ring)).alias("coordinates"))


def features(polygons: DataFrame, properties: list[str]) -> DataFrame:
    """One JSON feature per row, ordered by its properties."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), multipolygon(F.col("rings")).alias("geometry"))
    return polygons.select(*properties, F.to_json(feature).alias("value"))


def _separated(items: DataFrame, order: list[str]) -> DataFrame:
    """Comma before every item but the first."""
    first = items.agg(F.min(F.struct(*order))).first()[0]
    if first is None:
        return items.select("value")
    lead = F.lit(True)
    for c in order:
        lead = lead & (F.col(c) == F.lit(first[c]))
    return items.orderBy(*order).select(F.concat(F.when(lead, F.lit("")).otherwise(F.lit(",")), "value").alias("value"))


def write_polygons(polygons: DataFrame, path: str, layered: bool = False) -> None:
    """FeatureCollection of one multipolygon per cell, or per (cell, layer)."""
    p = polygons.withColumnRenamed("k", "layer") if layered else polygons
    order = ["cell", "layer"] if layered else ["cell"]
    write_parts(path, _separated(features(p, order), order), ['{"type":"FeatureCollection","features":['], ["]}"])


def write_geometry_collection(outlines: DataFrame, path: str) -> None:
    """GeometryCollection with the cell id beside each polygon."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(_ring(F.col("ring"))).alias("coordinates"), F.col("cell").alias("cell"))
    items = outlines.select("cell", F.to_json(geometry).alias("value"))
    write_parts(path, _separated(items, ["cell"]), ['{"type":"GeometryCollection","geometries":['], ["]}"])
