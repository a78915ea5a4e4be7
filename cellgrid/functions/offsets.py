"""Neighbourhood offset tables, generated from their definitions."""

from __future__ import annotations

from itertools import product

Offset = tuple[int, int, int]

_CUBE = [d for d in product((-1, 0, 1), repeat=3) if d != (0, 0, 0)]

MOORE: list[Offset] = _CUBE
MOORE_2D: list[Offset] = [d for d in _CUBE if d[2] == 0]
VON_NEUMANN: list[Offset] = [d for d in _CUBE if sum(map(abs, d)) == 1]
VON_NEUMANN_XY: list[Offset] = [d for d in VON_NEUMANN if d[2] == 0]
VERTICAL: list[Offset] = [d for d in VON_NEUMANN if d[2] != 0]


def diamond(radius: int) -> list[Offset]:
    """Layer-wise offsets within Manhattan distance ``radius``, centre included."""
    span = range(-radius, radius + 1)
    return [(di, dj, 0) for di in span for dj in span if abs(di) + abs(dj) <= radius]
