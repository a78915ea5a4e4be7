"""Words of many texts at once, as arrays: where they lie and a 64-bit fingerprint of each.

Texts arrive as Arrow string columns, so all bytes of a batch lie in one buffer.  Word
boundaries are found on that buffer, and a word's fingerprint is a polynomial over its
bytes (random 64-bit byte values, odd multiplier, arithmetic modulo 2**64), read off a
running sum.  Nothing here loops over words or documents in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20  # bytes worked on at once; bounds scratch memory, not the input

_M = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_M), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _table(separators: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in separators_of(separators):
        table[first : last + 1] = True
    return table


def separators_of(name: str) -> list[tuple[int, int]]:
    """Byte ranges that end a word: ``space`` (ASCII white space) or ``alnum`` (all ASCII but digits and a-z)."""
    return {"space": [(0x20, 0x20), (0x09, 0x0D)], "alnum": [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]}[name]


@dataclass
class Lexer:
    """``separators``: see :func:`separators_of`.  ``lower``: A-Z count as a-z."""

    separators: str = "space"
    lower: bool = False

    def __post_init__(self):
        fold = np.arange(256)
        if self.lower:
            fold[65:91] += 32
        self.is_word = ~_table(self.separators)[fold]
        self.values = _BYTE_VALUES[fold]


@dataclass
class Words:
    """Words of a batch in text order.  ``doc`` is the row, ``first[d]:first[d+1]`` are the words of row d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def position(self) -> np.ndarray:
        """Index of each word in its own document."""
        return np.arange(len(self)) - self.first[self.doc]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of each run of n words that lies in one document."""
        if len(self) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self) - n + 1] == self.doc[n - 1 :])
        return at, gram_hashes(self.hash, n)[at]


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of ``hashes[i:i+n]`` for every i, order included."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _WORD_POWERS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[: len(hashes) - n + 1]) * down[: len(hashes) - n + 1] + np.uint64(n))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null rows are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, lexer: Lexer) -> Words:
    """The words of every text of a string column."""
    data, offsets = text_buffer(texts)
    starts, ends, hashes = [], [], []
    low = 0
    while low < len(data):
        high = min(low + BLOCK, len(data))
        while high < len(data):  # a block ends between words
            inside = np.flatnonzero(~lexer.is_word[data[max(low, high - 65536) : high]])
            if len(inside):
                high = max(low, high - 65536) + int(inside[-1]) + 1
                break
            nearest = offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high, "right")]
            if len(nearest):
                high = int(nearest[-1])
                break
            high = min(high + BLOCK, len(data))
        piece = data[low:high]
        inside = lexer.is_word[piece]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        begin[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        stop[edges] = inside[edges]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        up, down = _BYTE_POWERS.get(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(lexer.values[piece] * up[: len(piece)], out=sums[1:])
        starts.append(s + low)
        ends.append(e + low)
        hashes.append(mix((sums[e] - sums[s]) * down[s]))
        low = high
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end, hashed = join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(data, start, end, doc, first, hashed)


def slices(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text at most, or one row."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(low, high - low)
