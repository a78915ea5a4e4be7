"""Constant arrays as single parsed expressions (one call instead of one per element)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Iterable[float]) -> Column:
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def offset_structs(offsets: Iterable[tuple[int, int, int]]) -> Column:
    return F.expr("array(" + ", ".join(f"named_struct('di', {a}, 'dj', {b}, 'dk', {c})" for a, b, c in offsets) + ")")
