"""Removal of word ranges from texts."""

from __future__ import annotations

from collections.abc import Iterable


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges (first, last) as disjoint, ordered ranges that do not touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without byte ranges [first, end); at each cut the blanks around it become one newline or blank."""
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at:first])
        at = end
    kept.append(text[at:])
    out = kept[0]
    for part in kept[1:]:
        left, right = out.rstrip(b" \t\n\v\f\r"), part.lstrip(b" \t\n\v\f\r")
        gap = out[len(left) :] + part[: len(part) - len(right)]
        out = left + ((b"\n" if b"\n" in gap else b" " if gap else b"") if left and right else b"") + right
    return out
