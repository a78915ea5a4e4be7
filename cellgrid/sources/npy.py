"""Two-dimensional .npy arrays as (row, col, value) rows of the non-zero entries."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib import format as npformat
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.sources.files import resolve

_BLOCK = 1 << 22  # elements per read


def _header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = npformat.read_magic(f)
    return npformat.read_array_header_1_0(f) if version == (1, 0) else npformat.read_array_header_2_0(f)


def _open(path: str):
    """Stream, and whether it can seek (gzip, told by its magic number, cannot)."""
    fs, inner = resolve(path)
    f = fs.open_input_file(inner)
    zipped = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    return (gzip.GzipFile(fileobj=f), False) if zipped else (f, True)


def _entries(block: np.ndarray, first_row: int, keep_zero: bool) -> pd.DataFrame:
    row, col = np.nonzero(np.ones_like(block, dtype=bool) if keep_zero else block)
    return pd.DataFrame({"row_px": row + first_row, "col_px": col, "value": block[row, col].astype(np.float64)})


def read_matrix(spark: SparkSession, path: str, keep_zero: bool = False) -> DataFrame:
    """Executors seek to blocks of rows; only the header is read on the driver.

    A gzip file has a single reader by nature, which streams it block by block.
    """
    f, seekable = _open(path)
    with f:
        shape, fortran, dtype = _header(f)
        start = f.tell()
    if len(shape) != 2 or fortran:
        raise ValueError(f"{path}: expected a two-dimensional C-ordered array")
    rows, cols = shape
    step = max(1, _BLOCK // max(1, cols))
    blocks = -(-rows // step)

    def read(f, first: int) -> np.ndarray:
        count = min(step, rows - first)
        return np.frombuffer(f.read(count * cols * dtype.itemsize), dtype=dtype).reshape(count, cols)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in b["id"]:
                f, _ = _open(path)
                with f:
                    if seekable:
                        f.seek(start + int(at) * step * cols * dtype.itemsize)
                        yield _entries(read(f, int(at) * step), int(at) * step, keep_zero)
                    else:
                        f.read(start)
                        for first in range(0, rows, step):
                            yield _entries(read(f, first), first, keep_zero)

    tasks = spark.range(0, blocks if seekable else 1, 1, max(1, min(blocks, 4096)) if seekable else 1)
    return tasks.mapInPandas(scan, "row_px long, col_px long, value double")


def read_masks(spark: SparkSession, masks: str, probs: str | None = None, fixed: str | None = None) -> DataFrame:
    """Labelled pixels: ``row_px, col_px, mask_id, frozen`` and, with probabilities, ``cellprob_logit``.

    A pixel of the fixed mask counts only where the main mask has none.
    """
    at = ["row_px", "col_px"]
    out = read_matrix(spark, masks).select(*at, F.col("value").cast("bigint").alias("mask_id"), F.lit(False).alias("frozen"))
    if probs is not None:
        logits = read_matrix(spark, probs, keep_zero=True).withColumnRenamed("value", "cellprob_logit")
        out = out.join(logits, at)
    if fixed is not None:
        held = read_matrix(spark, fixed).select(*at, F.col("value").cast("bigint").alias("mask_id"), F.lit(True).alias("frozen"))
        held = held.join(out.select(*at), at, "left_anti")
        if probs is not None:
            held = held.withColumn("cellprob_logit", F.lit(0.0))
        out = out.unionByName(held)
    return out
