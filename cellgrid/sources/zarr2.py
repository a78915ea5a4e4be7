"""Chunked arrays of a version-2 hierarchical array store, read and written by chunk.

Metadata is small JSON read on the driver; every chunk is one file handled by
one task. Chunks may be raw, zlib, gzip, zstd or blosc (lz4, zlib, zstd).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellgrid.sources.files import read_bytes, write_bytes


def attributes(path: str) -> dict:
    raw = read_bytes(f"{path}/.zattrs")
    return json.loads(raw) if raw else {}


def metadata(path: str) -> dict:
    raw = read_bytes(f"{path}/.zarray")
    if raw is None:
        raise ValueError(f"no array at {path}")
    meta = json.loads(raw)
    if meta.get("zarr_format") != 2 or meta.get("order", "C") != "C":
        raise ValueError(f"{path}: only C-ordered version-2 arrays are supported")
    return meta


def _unblosc(data: bytes) -> bytes:
    """Decode a blosc-1 frame with the codecs Arrow has."""
    flags, size, total, block = data[2], data[3], *struct.unpack_from("<II", data, 4)
    if flags & 0x02:
        return data[16 : 16 + total]
    codec = {0: None, 1: "lz4_raw", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None:
        raise ValueError("this blosc codec is not supported")
    starts = struct.unpack_from(f"<{-(-total // block)}I", data, 16)
    out = []
    for b, at in enumerate(starts):
        want = min(block, total - b * block)
        # full blocks are split into one stream per byte of the item unless flagged otherwise
        streams = size if not flags & 0x10 and want == block and 1 < size <= 16 and want // size >= 128 else 1
        piece = []
        for _ in range(streams):
            (n,) = struct.unpack_from("<i", data, at)
            raw, part = data[at + 4 : at + 4 + n], want // streams
            at += 4 + n
            if n == part:
                piece.append(raw)
            else:
                piece.append(zlib.decompress(raw) if codec == "zlib" else pa.Codec(codec).decompress(raw, part).to_pybytes())
        body = b"".join(piece)
        if flags & 0x01 and size > 1:
            whole = len(body) // size * size
            body = np.frombuffer(body[:whole], np.uint8).reshape(size, -1).T.tobytes() + body[whole:]
        out.append(body)
    return b"".join(out)


def _decompress(data: bytes, compressor: dict | None) -> bytes:
    if compressor is None:
        return data
    kind = compressor["id"]
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return zlib.decompress(data, 31)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "blosc":
        return _unblosc(data)
    raise ValueError(f"compressor {kind!r} is not supported")


def _strings(data: bytes) -> np.ndarray:
    """Variable-length UTF-8: count, then length-prefixed items."""
    (n,) = struct.unpack_from("<I", data, 0)
    pos, out = 4, []
    for _ in range(n):
        (m,) = struct.unpack_from("<I", data, pos)
        out.append(data[pos + 4 : pos + 4 + m].decode())
        pos += 4 + m
    return np.array(out, dtype=object)


def _chunk(path: str, meta: dict, index: tuple[int, ...]) -> np.ndarray | None:
    name = meta.get("dimension_separator", ".").join(map(str, index))
    raw = read_bytes(f"{path}/{name}")
    if raw is None:
        return None
    data = _decompress(raw, meta.get("compressor"))
    if meta["dtype"] == "|O":
        return _strings(data)
    return np.frombuffer(data, dtype=np.dtype(meta["dtype"])).reshape(meta["chunks"])


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """``idx`` and ``value`` of a one-dimensional array, or ``idx, v0, v1, ...`` of an n x m one."""
    meta = metadata(path)
    shape, chunks = meta["shape"], meta["chunks"]
    if len(shape) not in (1, 2) or (len(shape) == 2 and chunks[1] < shape[1]):
        raise ValueError(f"{path}: one-dimensional arrays or row-chunked matrices only")
    text, real = meta["dtype"] == "|O", np.dtype(meta["dtype"]).kind == "f" if meta["dtype"] != "|O" else False
    kind = "string" if text else "double" if real else "long"
    names = ["value"] if len(shape) == 1 else [f"v{c}" for c in range(shape[1])]
    fill = meta.get("fill_value") or ("" if text else 0)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c in b["id"]:
                first = int(c) * chunks[0]
                count = min(chunks[0], shape[0] - first)
                got = _chunk(path, meta, (int(c),) if len(shape) == 1 else (int(c), 0))
                if got is None:
                    got = np.full((chunks[0], len(names)), fill, dtype=object if text else None)
                got = got.reshape(-1, *([chunks[1]] if len(shape) == 2 else [1]))[:count, : len(names)]
                yield pd.DataFrame({"idx": np.arange(first, first + count), **{n: got[:, i] for i, n in enumerate(names)}})

    n = -(-shape[0] // chunks[0])
    return spark.range(0, n, 1, max(1, min(n, 4096))).mapInPandas(scan, ", ".join(["idx long", *[f"{c} {kind}" for c in names]]))


# -- writing ---------------------------------------------------------------------
def write_group(path: str, attrs: dict | None = None) -> None:
    write_bytes(f"{path}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    write_bytes(f"{path}/.zattrs", json.dumps(attrs or {}).encode())


def guess_chunk(size: int, item: int, target: int = 1 << 20) -> int:
    """Elements per chunk, about ``target`` bytes."""
    return max(1, min(size, target // max(1, item)))


def _pack(values: list[np.ndarray], dtype: str, chunk: int) -> bytes:
    if dtype == "|O":
        items = [("" if v is None else str(v)).encode() for v in values[0]]
        return struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(i)) + i for i in items)
    block = np.zeros((chunk, len(values)), dtype=dtype)
    for c, v in enumerate(values):
        block[: len(v), c] = v
    return block.tobytes()


def write_array(df: DataFrame, path: str, size: int, dtype: str, columns: list[str], attrs: dict | None = None) -> None:
    """Write ``columns`` of ``df(idx, ...)`` as one array; ``idx`` is dense, 0 ... size - 1.

    Rows are grouped by chunk number and each group, at most one chunk long,
    is written by its own task, under a final name, so retries are harmless.
    """
    item = 16 if dtype == "|O" else np.dtype(dtype).itemsize * len(columns)
    chunk = guess_chunk(size, item)
    flat = len(columns) == 1
    meta = {
        "zarr_format": 2, "shape": [size] if flat else [size, len(columns)], "chunks": [chunk] if flat else [chunk, len(columns)],
        "dtype": dtype, "compressor": None, "fill_value": "" if dtype == "|O" else 0, "order": "C",
        "filters": [{"id": "vlen-utf8"}] if dtype == "|O" else None,
    }
    write_bytes(f"{path}/.zarray", json.dumps(meta).encode())
    write_bytes(f"{path}/.zattrs", json.dumps(attrs or {}).encode())

    def put(key: tuple[int, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        c = int(key[0])
        write_bytes(f"{path}/{c}" if flat else f"{path}/{c}.0", _pack([pdf[n].to_numpy() for n in columns], dtype, chunk))
        return pd.DataFrame({"chunk": [c], "n": [len(pdf)]})

    from pyspark.sql import functions as F

    written = df.select("idx", *columns).groupBy(F.floor(F.col("idx") / F.lit(float(chunk))).cast("long").alias("chunk")).applyInPandas(put, "chunk long, n long")
    total = written.agg(F.sum("n")).first()[0] or 0
    if total != size:
        raise ValueError(f"{path}: {total} values for an array of {size}")
