"""Concatenate-and-cut packing of documents into fixed token windows.

Pass one tokenises each document once and writes its ids with the number of ids before
it in its partition.  The partitions' totals (one number each) are summed up in
partition order; pass two adds them, so that every document knows its place in the
endless row of ids, and cuts that row every ``window`` ids.  A document on a boundary
gives one piece on either side of it.  Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.store import arrow_map, write_table
from cellgrid.llm.words import slices, text_buffer

WINDOW, END = 2048, 1  # production parameters: ids in a sequence, id that ends a document
_TOKENS = "doc_id long, part int, before long, n_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END) -> DataFrame:
    """One row per document: ``ids`` (little-endian unsigned 32-bit, ``end_id`` last), ``before`` ids precede it in its ``part``."""

    def run(batches):
        from cellgrid.llm.tokens import Encoder

        encoder, part, before = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                ids, bounds = encoder.encode(piece.column("text"))
                bounds = bounds + np.arange(len(bounds))  # room for the end ids
                full = np.full(int(bounds[-1]), end_id, "<u4")
                inner = np.ones(len(full), bool)
                inner[bounds[1:] - 1] = False
                full[inner] = ids
                sizes = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + bounds[:-1]), pa.array(sizes), _binary(full, bounds)],
                    ["doc_id", "part", "before", "n_tokens", "ids"],
                )
                before += int(bounds[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS)


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value for each range of ``bounds`` (an Arrow batch stays below 2 GB by its size in bytes)."""
    offsets = (bounds * 4).astype(np.int32) if bounds[-1] * 4 < 2**31 else None
    if offsets is None:
        return pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.large_binary())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(ids).tobytes())])


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END) -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids.

    Columns: doc_id, start (ids of its document before the piece), length, doc_tokens,
    sequence_id, offset (place in the sequence), ids (binary, unsigned 32-bit little
    endian).  A null or empty text is its end id alone; null doc_ids are carried along;
    repeated rows are packed each on their own; no documents give no rows.  Only the
    last sequence is shorter than ``window``.  The order of sequences is that of the
    input partitions.
    """
    stored = write_table(tokenize(docs, tokenizer, end_id), "tokens")
    totals = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one number per input partition
    parts = np.array(sorted(totals), np.int64)
    sums = np.cumsum([0, *(totals[p] for p in parts)])[:-1]

    def cut(batch: pa.RecordBatch):
        part, before, size = (np.asarray(batch.column(k), np.int64) for k in (1, 2, 3))
        begin = sums[np.searchsorted(parts, part)] + before
        first, last = begin // window, (begin + size - 1) // window
        pieces = last - first + 1
        row = np.repeat(np.arange(len(size)), pieces)
        sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low, high = np.maximum(begin[row], sequence * window), np.minimum((begin + size)[row], (sequence + 1) * window)
        ids, at = text_buffer(batch.column(4))  # the pieces lie in it side by side
        values = _binary(ids.view("<u4"), np.append(at[row] // 4 + low - begin[row], at[-1] // 4))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), *map(pa.array, (low - begin[row], high - low, size[row], sequence, low - sequence * window)), values],
            ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )

    return arrow_map(stored, lambda b: (cut(s) for s in slices(b, "ids")), _PIECES)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The packed sequences: sequence_id and ``ids`` (array of ints) in order, at most ``window`` each."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    whole = pieces.groupBy("sequence_id").agg(ordered.alias("parts"))  # a sequence has at most ``window`` pieces

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return arrow_map(whole, join, "sequence_id long, ids array<int>")
