"""Well-known binary for polygons, as Arrow functions."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
_POLYGON, _MULTIPOLYGON = 3, 6


def _ring(ring) -> bytes:
    xy = np.array([(p["x"], p["y"]) for p in ring], dtype="<f8")
    return struct.pack("<I", len(xy)) + xy.tobytes()


def encode(rings) -> bytes:
    """Multipolygon with one exterior ring per part."""
    parts = [struct.pack("<BII", 1, _POLYGON, 1) + _ring(r) for r in rings]
    return struct.pack("<BII", 1, _MULTIPOLYGON, len(parts)) + b"".join(parts)


def decode(data: bytes) -> list[list[tuple[float, float]]]:
    """Exterior rings of a polygon or multipolygon; holes are read over."""
    pos = 0

    def header() -> tuple[str, int]:
        nonlocal pos
        order = "<" if data[pos] == 1 else ">"
        (kind,) = struct.unpack_from(order + "I", data, pos + 1)
        pos += 5
        return order, kind

    def polygon(order: str) -> list[tuple[float, float]]:
        nonlocal pos
        (rings,) = struct.unpack_from(order + "I", data, pos)
        pos += 4
        outer: list[tuple[float, float]] = []
        for at in range(rings):
            (m,) = struct.unpack_from(order + "I", data, pos)
            if at == 0:
                outer = [(float(x), float(y)) for x, y in np.frombuffer(data, order + "f8", 2 * m, pos + 4).reshape(m, 2)]
            pos += 4 + 16 * m
        return outer

    order, kind = header()
    if kind == _POLYGON:
        return [polygon(order)]
    if kind != _MULTIPOLYGON:
        raise ValueError(f"geometry type {kind} is not a polygon or multipolygon")
    (parts,) = struct.unpack_from(order + "I", data, pos)
    pos += 4
    out = []
    for _ in range(parts):
        inner, kind = header()
        out.append(polygon(inner))
    return out


@arrow_udf(T.BinaryType())
def to_wkb(rings: pa.Array) -> pa.Array:
    return pa.array([encode(r) for r in rings.to_pylist()], pa.binary())


@arrow_udf(RINGS)
def from_wkb(data: pa.Array) -> pa.Array:
    rows = [[[{"x": x, "y": y} for x, y in ring] for ring in decode(b)] for b in data.to_pylist()]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    return pa.array(rows, pa.list_(pa.list_(point)))
