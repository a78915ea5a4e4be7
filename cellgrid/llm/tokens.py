"""Token ids of many texts at once.

Public byte-level BPE vocabularies cut a text into pieces before they merge anything,
and no merge crosses a cut.  Every ASCII white space is such a cut (a single blank goes
with the word after it), so a text's ids are the ids of its blank-separated pieces, one
after the other.  Pieces repeat; each different one is tokenised once and remembered.
Pieces are merged by tiktoken with the tokenizer file's own ranks.  Texts with white space
outside ASCII, and texts that hold an added token's string (which is that token's id), go
through the tokenizer itself.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from cellgrid.llm.words import _BYTE_POWERS, _BYTE_VALUES, mix, text_buffer

_WIDE_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CUT = 1 << 20  # very long texts are cut into parts of about this size, between pieces


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> dict[str, int]:
    """Characters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: how byte-level BPE vocabularies of this kind cut a text.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranked(tokenizer):
    """The same vocabulary for a faster merger; ids are merge ranks, as in all vocabularies of this kind."""
    import tiktoken

    byte_of = _byte_characters()
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in tokenizer.get_vocab().items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``remember`` bounds the pieces held; at the bound the memory starts afresh, results do not change."""

    def __init__(self, path: str, remember: int = 1_500_000):
        self.tokenizer, self.remember = load_tokenizer(path), remember
        self.ranked = _ranked(self.tokenizer)
        (self.newline,) = self.ranked.encode_ordinary("\n")
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = [t.content.encode() for t in added]
        self.uncut = any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)  # blanks beside or in them count
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # where each key's ids are listed
        self.first = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        made, sizes = self._tokenize(pieces)
        slots = np.arange(len(keys)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.pool = np.concatenate([self.pool, made])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slot = np.insert(self.keys, at, keys[order]), np.insert(self.slot, at, slots[order])

    def _tokenize(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and each piece's number of ids: words in one call, a newline after each; white space singly."""
        spaces = [i for i, p in enumerate(pieces) if p.isspace()]
        held = set(spaces)
        words = [p for i, p in enumerate(pieces) if i not in held] if spaces else pieces
        joined = np.array(self.ranked.encode_ordinary("\n".join(words) + "\n") if words else [], np.uint32)
        breaks = np.flatnonzero(joined == self.newline)
        sizes = np.diff(breaks, prepend=-1) - 1
        made = joined[joined != self.newline]
        if not spaces:
            return made, sizes
        first = np.cumsum(sizes) - sizes
        at = np.array(spaces) - np.arange(len(spaces))  # words before each
        alone = [np.array(self.ranked.encode_ordinary(pieces[i]), np.uint32) for i in spaces]
        where = np.append(first, len(made))[at]
        return np.insert(made, np.repeat(where, [len(x) for x in alone]), np.concatenate(alone)), np.insert(sizes, at, [len(x) for x in alone])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and end); null is empty."""
        data, offsets = text_buffer(texts)
        raw = data.tobytes()
        marked = self._with_added(raw, offsets)
        whole = marked | {int(np.searchsorted(offsets, m.start(), "right") - 1) for m in _WIDE_SPACE.finditer(raw)}
        edges, owner = self._parts(data, offsets, marked if self.uncut else set())
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(offsets) - 1, np.int64)
        for first, last in self._runs(edges, owner, whole):
            low, high = int(edges[first]), int(edges[last])
            if int(owner[first]) in whole:
                made = np.array(self.tokenizer.encode(raw[low:high].decode(), add_special_tokens=False).ids, np.uint32)
                sizes = np.array([len(made)])
                owners = owner[first : first + 1]
            else:
                made, sizes = self._pieces(data[low:high], edges[first : last + 1] - low)
                owners = owner[first:last]
            ids.append(made)
            np.add.at(counts, owners, sizes)
        bounds = np.zeros(len(offsets), np.int64)
        np.cumsum(counts, out=bounds[1:])
        return np.concatenate(ids), bounds

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """Texts that hold the string of an added token."""
        out: set[int] = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right") - 1)
                inside = at + len(token) <= int(offsets[d + 1])  # not across two texts
                if inside:
                    out.add(d)
                at = raw.find(token, int(offsets[d + 1]) if inside else at + 1)
        return out

    @staticmethod
    def _parts(data: np.ndarray, offsets: np.ndarray, uncut: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Document edges, and further edges inside very long documents, at single blanks between words."""
        if not len(offsets) > 1 or int(np.diff(offsets).max()) <= 2 * _CUT:
            return offsets, np.arange(len(offsets) - 1)
        edges, owner = [0], []
        for d in range(len(offsets) - 1):
            low, end = int(offsets[d]), int(offsets[d + 1])
            while end - low > 2 * _CUT and d not in uncut:
                near = data[low + _CUT : low + 2 * _CUT]
                blank = np.flatnonzero((near[1:-1] == 0x20) & ~_SPACE[near[:-2]] & ~_SPACE[near[2:]])
                if not len(blank):
                    break
                low += _CUT + 1 + int(blank[0])
                edges.append(low)
                owner.append(d)
            edges.append(end)
            owner.append(d)
        return np.array(edges), np.array(owner, np.int64)

    @staticmethod
    def _runs(edges: np.ndarray, owner: np.ndarray, whole: set[int]):
        """Ranges of parts to work on at once: a document that goes whole, or others up to about 2 MB."""
        k = 0
        while k < len(owner):
            first, alone = k, int(owner[k]) in whole
            k += 1
            while k < len(owner) and (owner[k] == owner[first] if alone else int(owner[k]) not in whole and edges[k + 1] - edges[first] <= 2 * _CUT):
                k += 1
            yield first, k

    def _pieces(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts between ``edges`` in a row, and how many each has."""
        space = _SPACE[data]
        begin, stop = ~space, ~space
        begin[1:] &= space[:-1]
        stop[:-1] &= space[1:]
        inner = np.unique(edges[(edges > 0) & (edges < len(data))])
        begin[inner] = ~space[inner]
        stop[inner - 1] = ~space[inner - 1]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        part = np.searchsorted(edges, start, "right") - 1
        before = np.empty(len(start), np.int64)  # end of the word before, or of the part before
        before[:1] = 0
        before[1:] = end[:-1]
        before = np.maximum(before, edges[part])
        gap = start - before
        blank = (gap > 0) & (data[np.maximum(start - 1, 0)] == 0x20)
        several, single = gap > 1, (gap > 0) & ~blank
        last = np.searchsorted(start, edges[1:]) - 1
        tail = np.where(last >= 0, end[last] if len(end) else 0, 0)
        tail = np.maximum(tail, edges[:-1])
        rest = tail < edges[1:]
        low = np.concatenate([start - blank, before[several], start[single] - 1, tail[rest]])
        high = np.concatenate([end, start[several] - 1, start[single], edges[1:][rest]])
        order = np.argsort(low, kind="stable")
        low, high = low[order], high[order]
        up, down = _BYTE_POWERS.get(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
        code, keys = pd.factorize(mix((sums[high] - sums[low]) * down[low]))
        slot = self._slots(keys, code, data, low, high)[code]
        sizes = self.first[slot + 1] - self.first[slot]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        per_part = np.diff(np.concatenate([[0], ends])[np.searchsorted(low, edges)])
        return ids, per_part

    def _slots(self, keys: np.ndarray, code: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > self.remember:
                self._forget()
                new[:] = True
            where = np.zeros(len(keys), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            self._learn(keys[new], [raw[low[i] : high[i]].decode() for i in where[new]])
            at = np.searchsorted(self.keys, keys)
        return self.slot[at]
