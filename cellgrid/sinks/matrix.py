"""Sparse count matrices: 1-based triplets and coordinate-format text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.sinks.text import write_parts


def triplets(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """1-based (row, col, value) of non-zero entries; cells are dense ids."""
    return counts.join(genes, "gene").where("n <> 0").select(
        (F.col("cell") + 1).alias("row"), (F.col("gene_id") + 1).alias("col"), F.col("n").alias("value")
    )


def write_matrix(entries: DataFrame, path: str, rows: int, cols: int) -> None:
    """Gzip coordinate-format matrix: header parts first, then entries in (row, col) order.

    Each part is a gzip member, so the parts in name order are one valid file.
    Real values keep two decimals.
    """
    kind = "integer" if entries.schema["value"].dataType.typeName() in ("long", "integer") else "real"
    value = F.col("value").cast("string") if kind == "integer" else F.format_string("%.2f", "value")
    body = entries.orderBy("row", "col").select(F.concat_ws(" ", "row", "col", value).alias("value"))
    head = [f"%%MatrixMarket matrix coordinate {kind} general", f"{rows} {cols} {entries.count()}"]
    write_parts(path, body, head, [])
