"""Removal of word sequences that repeat anywhere in the corpus, by partitioned suffix trees.

A suffix tree of all words of a large corpus fits no machine, so its suffixes are split by
prefixes of variable length into groups that fit a task, and only the parts of the tree
that can be deep enough are built:

1. Every window of ``window`` words is filed under its *anchor*: of its runs of ``prefix``
   words the one with the smallest fingerprint.  Neighbouring windows share anchors, so a
   document has one anchor in about twelve words, and equal windows have equal anchors.
2. Anchors are counted by prefix.  A prefix found once belongs to a leaf: no window filed
   there repeats.  What remains fetches the words around it.
3. A prefix with at most ``group_rows`` occurrences is one group: its suffixes (the windows'
   starts) are ranked by prefix doubling, as in suffix array construction, up to depth
   ``window``; suffixes of equal rank are leaves below one internal node of that depth.
4. A more frequent prefix is extended to the whole window.  Suffixes that share so long a
   prefix are below one deep node already; they are counted by a hash of 128 bits, with
   partial aggregation (also inside a task), so that no task meets a group.

Windows below deep nodes are maximal repeats' windows; the words they cover are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.cutting import cut_bytes
from cellgrid.llm.store import arrow_map, drop_table, own_columns, row_key, temporary, write_table
from cellgrid.llm.words import Lexer, Words, find_words, gram_hashes, mix, slices, text_buffer

WINDOW, PREFIX, GROUP_ROWS = 35, 12, 1_000
WORDS = Lexer("space")


def window_anchors(words: Words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, its anchor, fingerprints of all prefixes); of equal fingerprints the leftmost is the anchor."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    grams = gram_hashes(words.hash, prefix)
    span = window - prefix + 1
    at = np.arange(len(grams))
    width = 1
    while width < span:  # minimum over ever wider ranges, two ranges at a time
        shift = min(width, span - width)
        left, right = at[: len(at) - shift], at[shift:]
        at = np.where(grams[right] < grams[left], right, left)
        width += shift
    return starts, at[starts], grams


def _anchor_rows(batch: pa.RecordBatch, window: int, prefix: int):
    for piece in slices(batch, "text"):
        words = find_words(piece.column("text"), WORDS)
        _, anchors, grams = window_anchors(words, window, prefix)
        anchors = anchors[np.flatnonzero(np.diff(anchors, prepend=-1))] if len(anchors) else anchors
        doc = pa.array(words.doc[anchors])
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[anchors].view(np.int64)), piece.column("__id").take(doc), piece.column("__th").take(doc), pa.array((anchors - words.first[words.doc[anchors]]).astype(np.int32))],
            ["fp", "__id", "__th", "pos"],
        )


def _pack_ints(values: np.ndarray, bounds: np.ndarray, kind: str, width: int) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values.astype(kind)).tobytes())])


def _selected(piece: pa.RecordBatch, words: Words, window: int, prefix: int):
    """Windows whose anchor is listed: (start, anchor, fingerprint, frequent) in word indexes of the batch."""
    starts, anchors, grams = window_anchors(words, window, prefix)
    marks = piece.column("marks")
    flat = marks.flatten()
    rows = np.repeat(np.arange(piece.num_rows), np.asarray(_lengths(marks)))
    at = words.first[rows] + np.asarray(flat.field(0), np.int64)
    kind = np.zeros(len(words) + 1, np.int8)
    kind[at] = np.where(np.asarray(flat.field(1).cast(pa.int8())), 2, 1)
    chosen = kind[anchors] > 0
    return starts[chosen], anchors[chosen], grams, kind


def _lengths(lists: pa.Array) -> pa.Array:
    return pc.fill_null(pc.list_value_length(lists), 0)


def _suffix_rows(batch: pa.RecordBatch, window: int, prefix: int):
    """Suffixes filed under the listed anchors.

    For prefixes of ordinary frequency: the words that their windows cover, from the first
    window's start on (``fp``, ``context``).  For frequent prefixes: each window on its
    own, under a hash of its whole length (``fp``, ``more``, ``leaves`` 1).  Windows that
    the batch holds several times are below one node already: they come as ranges of words
    (``start``, ``last``), and once as two leaves without a place.
    """
    names = ["fp", "more", "leaves", "__id", "__th", "start", "last", "context"]
    nothing = lambda at, kind: pa.nulls(len(at), kind)
    for piece in slices(batch, "text"):
        words = find_words(piece.column("text"), WORDS)
        starts, anchors, grams, kind = _selected(piece, words, window, prefix)

        def rows(at: np.ndarray, fp=None, more=None, leaves=None, last=None, context=None, piece=piece, words=words) -> pa.RecordBatch:
            doc = words.doc[at]
            place = lambda x: pa.array((x - words.first[doc]).astype(np.int32))
            own = [piece.column(k).take(pa.array(doc)) for k in ("__id", "__th")]
            codes = [nothing(at, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (fp, more)]
            return pa.RecordBatch.from_arrays(
                [*codes, nothing(at, pa.int32()) if leaves is None else pa.array(np.full(len(at), leaves, np.int32)), *own, nothing(at, pa.int32()) if leaves == 2 else place(at), nothing(at, pa.int32()) if last is None else place(last), nothing(at, pa.string()) if context is None else context],
                names,
            )

        alone = starts[kind[anchors] == 2]
        if len(alone):
            codes = [gram_hashes(h, window)[alone] for h in (words.hash, mix(words.hash + np.uint64(1)))]
            both = pd.Series(codes[0] ^ mix(codes[1]))
            several = both.duplicated(keep=False).to_numpy()
            once, first = ~several, several & ~both.duplicated().to_numpy()
            yield rows(alone[once], *(c[once] for c in codes), leaves=1)
            yield rows(alone[first], *(c[first] for c in codes), leaves=2)
            deep = alone[several]
            joined = (np.diff(deep) == 1) & (np.diff(words.doc[deep]) == 0)
            low, high = deep[np.append(True, ~joined)[: len(deep)]], deep[np.append(~joined, True)[: len(deep)]]
            yield rows(low, last=high + window - 1)
        keep = kind[anchors] == 1
        starts, anchors = starts[keep], anchors[keep]
        if len(starts):
            first = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
            low, count = starts[first], np.diff(np.append(first, len(starts)))
            yield rows(low, fp=grams[anchors[first]], context=_text_of(words, low, low + count + window - 1))


def _text_of(words: Words, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """The text from word ``low`` to before word ``high`` (original white space included), one value each."""
    begin, end = words.start[low], words.end[high - 1]
    sizes = end - begin
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    index = np.repeat(begin - bounds[:-1], sizes) + np.arange(int(bounds[-1]))
    return pa.Array.from_buffers(pa.string(), len(low), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(words.data[index].tobytes())])


def deep_suffixes(words: Words, window: int) -> np.ndarray:
    """Whether the suffix at each word shares its first ``window`` words with another one.

    Prefix doubling: equal ranks at depth d and, d words on, at depth d mean equal ranks
    at depth 2d.  Suffixes that end before depth ``window`` are leaves of their own.
    """
    n = len(words)
    deep = np.zeros(n, bool)
    if n < window:
        return deep
    rank, depth = pd.factorize(words.hash)[0].astype(np.int64), 1
    while depth < window:
        shift = min(depth, window - depth)
        pairs = rank[: len(rank) - shift] * np.int64(n + 1) + rank[shift:]
        rank, depth = pd.factorize(pairs)[0].astype(np.int64), depth + shift
    starts = np.flatnonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])
    rank = rank[starts]
    deep[starts] = np.bincount(rank, minlength=1)[rank] > 1 if len(rank) else False
    return deep


def _subtrees(batches, window: int):
    """Rows come ordered by prefix; a batch's last group waits for the next batch."""

    def solve(table: pa.Table):
        table = table.combine_chunks()
        words = find_words(table.column("context"), WORDS)
        group = np.asarray(table.column("fp"))[words.doc].view(np.uint64)
        words.hash = mix(words.hash ^ mix(group))  # suffixes of different groups differ from the first word on
        deep = deep_suffixes(words, window)
        edge = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # a run stays in its row, as a row's last words start no whole window
        doc = words.doc[first]
        base = np.asarray(table.column("start"), np.int64)[doc] - words.first[doc]
        take = pa.array(doc)
        chunk = lambda k: table.column(k).combine_chunks() if isinstance(table.column(k), pa.ChunkedArray) else table.column(k)
        return pa.RecordBatch.from_arrays([chunk("__id").take(take), chunk("__th").take(take), pa.array(first + base), pa.array(end - 1 + base + window - 1)], ["__id", "__th", "first", "last"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for piece in slices(batch, "context"):
            fp = np.asarray(piece.column("fp"))
            if not len(fp):
                continue
            last = int(np.searchsorted(fp, fp[-1]))  # where the last group begins: rows are ordered
            if last == 0 and held and held[-1].column("fp")[-1].as_py() == int(fp[0]):
                held.append(piece)
                continue
            table = pa.Table.from_batches([*held, piece.slice(0, last)])
            if table.num_rows:
                yield solve(table)
            held = [piece.slice(last)]
    if held:
        yield solve(pa.Table.from_batches(held))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(__id, __th, __spans): for each document row with repeats (see ``row_key``) the ranges of words below deep nodes, unordered."""
    keyed = docs.select(*row_key(), "text")
    anchors = write_table(arrow_map(keyed, lambda b: _anchor_rows(b, window, prefix), "fp long, __id long, __th int, pos int"), "anchors")
    shared = write_table(anchors.groupBy("fp").count().filter("count > 1").select("fp", (F.col("count") > group_rows).alias("frequent")), "prefixes")
    marks = anchors.join(shared, "fp").groupBy("__id", "__th").agg(F.collect_set(F.struct("pos", "frequent")).alias("marks"))
    # texts meet marks and ranges by the same join at every size, so that disk and shuffle grow in proportion
    marked = keyed.join(write_table(marks, "marks").hint("merge"), ["__id", "__th"])
    suffixes = write_table(arrow_map(marked, lambda b: _suffix_rows(b, window, prefix), "fp long, more long, leaves int, __id long, __th int, start int, last int, context string"), "suffixes")
    drop_table(anchors)
    grouped = suffixes.filter("context is not null").select("fp", "__id", "__th", "start", "context").repartition("fp").sortWithinPartitions("fp")
    spans = write_table(grouped.mapInArrow(lambda batches: _subtrees(batches, window), "__id long, __th int, first long, last long"), "spans")
    alone = suffixes.filter("leaves is not null").select("fp", "more", "leaves", "__id", "__th", "start")
    nodes = write_table(alone.groupBy("fp", "more").agg(F.sum("leaves").alias("leaves")).filter("leaves > 1").select("fp", "more"), "nodes")
    below = alone.filter("start is not null").join(nodes, ["fp", "more"]).withColumn("last", F.col("start") + window - 1)
    known = suffixes.filter("last is not null")
    others = below.select("__id", "__th", "start", "last").unionByName(known.select("__id", "__th", "start", "last"))
    every = spans.unionByName(others.select("__id", "__th", F.col("start").cast("long").alias("first"), F.col("last").cast("long").alias("last")))
    return every.groupBy("__id", "__th").agg(F.collect_set(F.struct("first", "last")).alias("__spans"))


def _cover(piece: pa.RecordBatch, words: Words) -> np.ndarray:
    """Whether each word of the batch lies in a span of its row."""
    spans = piece.column("__spans")
    flat = spans.flatten()
    rows = np.repeat(np.arange(piece.num_rows), np.asarray(_lengths(spans)))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, words.first[rows] + np.asarray(flat.field(0), np.int64), 1)
    np.add.at(edge, words.first[rows] + np.asarray(flat.field(1), np.int64) + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, **options) -> DataFrame:
    with temporary() as keep:
        ranges = keep(write_table(repeated_ranges(docs, **options), "ranges"))
    return docs.select("*", *row_key()).join(ranges.hint("merge"), ["__id", "__th"], "left")


@own_columns
def remove_repeats(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``docs`` with its own columns; words below deep nodes are cut from ``text``.

    A null text stays null, an empty one empty.  Rows that repeat (also with equal ids,
    or without ids) are repeats of each other: their windows go from both.  A text that
    loses all its words stays as an empty text.  Documents without repeats keep their text.
    """
    names = docs.columns

    def cut(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            at = piece.schema.get_field_index("text")
            texts = piece.column(at)
            words = find_words(texts, WORDS)
            gone = _cover(piece, words)
            if gone.any():
                joined = gone[:-1] & gone[1:] & (words.doc[:-1] == words.doc[1:])
                first, last = np.flatnonzero(gone & ~np.append(False, joined)), np.flatnonzero(gone & ~np.append(joined, False))
                offsets, values = text_buffer(texts)[1], texts.to_pylist()
                ranges: dict[int, list[tuple[int, int]]] = {}
                for d, low, high in zip(words.doc[first].tolist(), words.start[first].tolist(), words.end[last].tolist(), strict=True):
                    ranges.setdefault(d, []).append((low - int(offsets[d]), high - int(offsets[d])))
                for d, cuts in ranges.items():
                    values[d] = cut_bytes(values[d].encode(), cuts).decode()
                texts = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([texts if i == at else piece.column(piece.schema.get_field_index(k)) for i, k in enumerate(names)], names)

    return arrow_map(_with_spans(docs, window=window, **options).select(*(f"`{k}`" for k in names), "__spans"), cut, docs.schema)


def removal_digest(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and the SHA-256 of the kept words joined by blanks."""

    def digest(batch: pa.RecordBatch):
        for piece in slices(batch, "text"):
            words = find_words(piece.column("text"), WORDS)
            gone = _cover(piece, words)
            sums = np.concatenate([[0], np.cumsum(gone)])
            kept = ~gone
            # kept words and one blank after each, side by side
            low, sizes = words.start[kept], (words.end - words.start)[kept] + 1
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            index = np.repeat(low - bounds[:-1], sizes) + np.arange(int(bounds[-1]))
            data = np.append(words.data, np.uint8(32))[np.minimum(index, len(words.data))] if len(index) else np.zeros(0, np.uint8)
            data[bounds[1:] - 1] = 32
            per_doc = np.concatenate([[0], np.cumsum(kept)])[words.first]
            edges = bounds[per_doc]
            raw = memoryview(data.tobytes())
            digests = [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(words.first)), pa.array(sums[words.first[1:]] - sums[words.first[:-1]]), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window=window, **options)
    return arrow_map(found.select("doc_id", "text", "__spans"), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
