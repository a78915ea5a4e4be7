"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``BITS`` bits, the cell's place on the Hilbert curve through
all cells is computed, rows are ordered by that place, and the order is cut into runs of
equal row counts.  Neighbouring rows agree in several dimensions at once, so the files of
a shard have narrow ranges in each, and readers skip them by their statistics.

The order is a range sort over (place, tie breakers).  Rows of one crowded cell are spread
by their tie breakers.  Ranks come from one count per sorted part, so no part is larger
than another and nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import write_table

BITS = 5  # bits of a quantised dimension
N_SHARDS = 8


def by_value(column: str, bits: int = BITS) -> Column:
    """Cell of a categorical value: equal values share one.  Null is cell 0."""
    return F.coalesce(F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int") if column else F.lit(0)


def by_size(value: Column, bits: int = BITS) -> Column:
    """Cell of a count on a logarithmic scale, two cells for each doubling; the last cell is open.  Null is cell 0."""
    return F.least(F.floor(2 * F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place of each cell (one array per dimension) on the Hilbert curve.

    From the highest bit down, the set bits of each axis exchange or invert the lower
    bits of the first axis; a Gray decoding over all axes then gives the index, whose
    digits are interleaved.
    """
    x = [np.array(c, np.int64) for c in cells]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for axis in x:
            high = (axis & q) > 0
            swap = np.where(high, 0, (x[0] ^ axis) & low)
            flipped = np.where(high, x[0] ^ low, x[0])
            x[0][...] = flipped ^ swap
            axis ^= swap
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in reversed(range(bits)):
        for axis in x:
            index = (index << 1) | (((axis ^ turn) >> bit) & 1)
    return index


def hilbert(cells: Sequence[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy() for c in columns], bits))

    return place(*cells)


def shard(rows: DataFrame, dimensions: Sequence[Column], ties: Sequence[str], n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """``rows`` with ``__place`` (on the curve), ``__shard`` and ``__slot`` (0, 1, ... in its shard).

    ``dimensions`` are cells (see ``by_value``, ``by_size``).  Shard sizes differ by one row
    at most.  Rows equal in place and all ties are interchangeable; each takes a slot of
    its own.  No rows give no rows.
    """
    placed = rows.withColumn("__place", hilbert(dimensions, bits))
    keys = ["__place", *ties]
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = ordered.withColumn("__at", F.monotonically_increasing_id())
    stored = write_table(numbered.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1)), "ordered")
    counts = {r["__part"]: r["n"] for r in stored.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one number per sorted part
    parts = sorted(counts)
    total = sum(counts.values())
    before = rows.sparkSession.createDataFrame(pd.DataFrame({"__part": np.array(parts, np.int64), "__before": np.cumsum([0, *(counts[p] for p in parts)])[:-1].astype(np.int64)}), "__part long, __before long")
    rank = F.col("__before") + F.col("__at")
    # the first total % n_shards shards have one row more
    large, extra = total // n_shards + 1, total % n_shards
    over = rank - extra * large
    number = F.when(over < 0, F.floor(rank / large)).otherwise(extra + F.floor(over / max(total // n_shards, 1)))
    slot = F.when(over < 0, rank % large).otherwise(over % max(total // n_shards, 1))
    return stored.join(F.broadcast(before), "__part").select(*(f"`{c}`" for c in placed.columns), number.cast("int").alias("__shard"), slot.cast("long").alias("__slot"))


def document_dimensions() -> list[Column]:
    """Language, source and text length of a document."""
    return [by_value("lang"), by_value("source"), by_size(F.col("n_chars"))]


def write_shards(sharded: DataFrame, path: str, order: Sequence[str] = ("__shard", "__slot")) -> None:
    """Parquet files, one folder per shard, rows in curve order, so that files have narrow ranges in every dimension."""
    sharded.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("__shard").parquet(path)
