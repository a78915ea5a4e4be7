"""Generalised suffix automaton of word sequences, and what of it occurs in other texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cellgrid.llm.words import Words, mix


class SuffixAutomaton:
    """States are sets of sub-sequences with the same ends; ``link`` leads to the longest shorter suffix elsewhere."""

    def __init__(self):
        self.length, self.link = [0], [-1]
        self.step: list[dict[int, int]] = [{}]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of ``target`` that holds only its suffixes reached from ``state``."""
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def extend(self, last: int, symbol: int) -> int:
        """Append a symbol to the sequence that ends in state ``last``."""
        known = self.step[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, symbol, known)
        made, state = self._state(self.length[last] + 1, 0, {}), last
        while state >= 0 and symbol not in self.step[state]:
            self.step[state][symbol] = made
            state = self.link[state]
        if state >= 0:
            target = self.step[state][symbol]
            self.link[made] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return made

    def add(self, symbols: list[int]) -> None:
        last = 0
        for symbol in symbols:
            last = self.extend(last, symbol)

    def walk(self, symbols: list[int]):
        """(state, length of the longest suffix that occurs here) after each symbol."""
        length, link, step, state, size = self.length, self.link, self.step, 0, 0
        for symbol in symbols:
            after = step[state].get(symbol)
            while after is None and state:
                state = link[state]
                size = length[state]
                after = step[state].get(symbol)
            if after is None:
                size = 0
            else:
                state, size = after, size + 1
            yield state, size


class Matcher:
    """Occurrences of item windows in documents.

    A window is ``window`` consecutive words of an item, or a whole shorter item.
    ``items``: (id, fingerprints of its words).
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        items = [(i, h) for i, h in items if len(h)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in items)]))
        coded = [(i, np.searchsorted(self.vocabulary, h).tolist()) for i, h in items]
        self.automaton = SuffixAutomaton()
        for _, codes in coded:
            self.automaton.add(codes)
        self.full: dict[int, set[str]] = {}  # state that holds a window -> items
        self.short: dict[int, dict[int, set[str]]] = {}  # state -> {length of a whole short item: items}
        for name, codes in coded:
            state = 0
            for state, size in self.automaton.walk(codes):
                if size >= window:
                    self.full.setdefault(self._holder(state, window), set()).add(name)
            if len(codes) < window:
                self.short.setdefault(self._holder(state, len(codes)), {}).setdefault(len(codes), set()).add(name)
        self.least = min([window, *(len(c) for _, c in coded)])
        pairs = [np.array([c[:-1], c[1:]], np.uint64) for _, c in coded if len(c) > 1]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.uint64), *((p[0] << np.uint64(32)) | p[1] for p in pairs)]))
        self.words_filter, self.pairs_filter = self._filter(self.vocabulary), self._filter(mix(self.pairs))

    def _holder(self, state: int, size: int) -> int:
        """The suffix state that holds the last ``size`` symbols of ``state``."""
        link, length = self.automaton.link, self.automaton.length
        while length[link[state]] >= size:
            state = link[state]
        return state

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << max(12, (16 * len(hashes)).bit_length()), bool)
        bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return bits

    @staticmethod
    def _find(sought: np.ndarray, hashed: np.ndarray, known: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Index in ``known`` of each value, -1 if it isn't there."""
        out = np.full(len(sought), -1, np.int64)
        maybe = np.flatnonzero(bits[(hashed & np.uint64(len(bits) - 1)).astype(np.int64)])
        if len(maybe) and len(known):
            at = np.minimum(np.searchsorted(known, sought[maybe]), len(known) - 1)
            out[maybe] = np.where(known[at] == sought[maybe], at, -1)
        return out

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last word, codes) of stretches whose neighbouring words all follow each other in some item."""
        codes = self._find(words.hash, words.hash, self.vocabulary, self.words_filter)
        together = (codes[:-1] >= 0) & (codes[1:] >= 0) & (words.doc[:-1] == words.doc[1:])
        at = np.flatnonzero(together)
        pair = (codes[at].astype(np.uint64) << np.uint64(32)) | codes[at + 1].astype(np.uint64)
        together[at] = self._find(pair, mix(pair), self.pairs, self.pairs_filter) >= 0
        edge = np.diff(np.concatenate([[False], together, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.least == 1:
            alone = np.flatnonzero(codes >= 0)
            inside = np.zeros(len(codes), bool)
            inside[:-1] |= together
            inside[1:] |= together
            alone = alone[~inside[alone]]
            first, last = np.concatenate([first, alone]), np.concatenate([last, alone])
            order = np.argsort(first)
            first, last = first[order], last[order]
        long = last - first + 1 >= self.least
        return first[long], last[long], codes

    def match(self, words: Words) -> tuple[list[tuple[int, int]], dict[int, set[str]]]:
        """Stretches (first, last word of the batch) that lie inside occurrences, and the items that occur in each row."""
        spans: list[tuple[int, int]] = []
        items: dict[int, set[str]] = {}
        first, last, codes = self.runs(words)
        link = self.automaton.link
        for low, high in zip(first.tolist(), last.tolist(), strict=True):
            found: set[str] = set()
            begin = end = -1
            for at, (state, size) in enumerate(self.automaton.walk(codes[low : high + 1].tolist()), low):
                reach = 0
                if size >= self.window:
                    found |= self.full[self._holder(state, self.window)]
                    reach = self.window
                if self.short:
                    below = state
                    while below > 0:
                        for length, names in self.short.get(below, {}).items():
                            if length <= size:
                                found |= names
                                reach = max(reach, length)
                        below = link[below]
                if reach:
                    if end >= 0 and at - reach + 1 <= end + 1:
                        begin, end = min(begin, at - reach + 1), at
                    else:
                        if end >= 0:
                            spans.append((begin, end))
                        begin, end = at - reach + 1, at
            if end >= 0:
                spans.append((begin, end))
                items.setdefault(int(words.doc[low]), set()).update(found)
        return spans, items


def lists(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))
