"""Ranks, arg-max and order statistics that never gather a whole key in one task."""

from __future__ import annotations

from bisect import bisect_right
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.session import materialize

_SPAN = Decimal(10**19)  # above every BIGINT, so a packed pair never overlaps


def packed_vote(votes: Column, candidate: Column) -> Column:
    """Vote count and candidate in one DECIMAL(38): max() = most votes, ties to the lowest id.

    Keeps arg-max on the hash-aggregate path with map-side combining, where a
    struct would sort. Holds every non-negative BIGINT on either side.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    top = F.lit(_SPAN - 1).cast("decimal(19,0)")
    return (wide(votes) * F.lit(_SPAN).cast("decimal(20,0)")).cast("decimal(38,0)") + (top - wide(candidate)).cast("decimal(20,0)")


def unpack_candidate(packed: Column) -> Column:
    return (F.lit(_SPAN - 1).cast("decimal(19,0)") - packed % F.lit(_SPAN).cast("decimal(20,0)")).cast("bigint")


def unpack_votes(packed: Column) -> Column:
    span = F.lit(_SPAN).cast("decimal(20,0)")
    return ((packed - packed % span) / span).cast("bigint")


def no_match(key: Column, *row: Column | str) -> Column:
    """``key``, or for NULL a negative number that differs from row to row.

    For left joins on ids from 0 on: rows without a key meet nothing, but are
    spread over the join's tasks instead of gathering in one.
    """
    return F.coalesce(key, -1 - F.pmod(F.xxhash64(*row), F.lit(1 << 40)))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast.

    For tables that grow with the data on both sides: files of voxels are many times
    smaller than their rows, so by their size Spark would send them through the driver.
    """
    return df.hint("merge")


def _split_points(rows: DataFrame, by: list[str], splits: int) -> list[Column]:
    """At most ``splits - 1`` values of ``by`` in order: those of the rows with the lowest hashes."""
    if splits <= 1:
        return []
    fields = {f.name: f.dataType for f in rows.schema.fields}
    sample = rows.orderBy(F.xxhash64(*by)).limit(splits - 1).select(*by).collect()
    return [F.struct(*[F.lit(v).cast(fields[c]).alias(c) for c, v in zip(by, r, strict=True)]) for r in sample]


def _range_of(points: list[Column], by: list[str]) -> Column:
    """How many split points are at or before the row."""
    key = F.struct(*by)
    return F.size(F.filter(F.array(*points), lambda p: p <= key)) if points else F.lit(0)


def dense_index(keys: DataFrame, by: list[str], out: str = "idx", splits: int | None = None) -> DataFrame:
    """0-based dense rank of distinct key rows ordered by ``by``, without a global window.

    A bounded sample of keys (lowest hashes) gives split points; each key falls
    in the range between two of them, ranges are counted, and the running
    count of earlier ranges is added to the rank inside the range. The split
    points only balance the work: any choice gives the same ranks.
    """
    spark = keys.sparkSession
    if splits is None:
        splits = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    uniq = materialize(keys.select(*by).distinct(), "keys")  # read three times below
    part = _range_of(_split_points(uniq, by, splits), by)
    ranged = uniq.withColumn("_p", part)
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("m")).collect()  # one row per range
    start, offsets = 0, {}
    for p, m in sorted((r["_p"], r["m"]) for r in sizes):
        offsets[p] = start
        start += m
    base = F.element_at(F.create_map(*[x for p, s in offsets.items() for x in (F.lit(p), F.lit(s))]), F.col("_p"))
    if not offsets:
        base = F.lit(0)
    w = Window.partitionBy("_p").orderBy(*by)
    return ranged.withColumn(out, (base + F.row_number().over(w) - 1).cast("bigint")).drop("_p")


def salted_prefix(
    df: DataFrame, keys: list[str], order: list[str], weight: str, out: str = "earlier", hot_rows: int = 1_000_000
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of each (non-null) key, in ``order``.

    Keys with more than ``hot_rows`` rows are found by a count first. Their rows
    are cut into ranges of ``order`` at sampled split points; each range is
    summed in its own task and shifted by the totals of the ranges before it.
    ``hot_rows`` and the split points only balance the work: the result is the
    same for all. ``order`` should identify the row.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > F.lit(hot_rows))
    hot = materialize(sizes.select(*keys, "_m"), "hot")
    rows = hot.agg(F.sum("_m").alias("m")).first()["m"]
    inner, ranged = [*keys], df
    if rows:
        marked = df.join(hot.select(*keys, F.lit(True).alias("_hot")), keys, "left")
        parts = 1 + -(-rows // hot_rows)
        points = _split_points(marked.where("_hot"), order, min(parts, max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
        inner = [*keys, "_s"]
        ranged = marked.withColumn("_s", F.when(F.col("_hot"), _range_of(points, order)).otherwise(0))
    before = Window.partitionBy(*inner).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
    if not rows:
        return ranked
    totals = ranged.where("_hot").groupBy(*inner).agg(F.sum(weight).alias("_v"))
    over = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("_base", F.coalesce(F.sum("_v").over(over), F.lit(0))).drop("_v")
    return ranked.join(bases, inner, "left").withColumn(out, F.col(out) + F.coalesce("_base", F.lit(0))).drop("_s", "_hot", "_base")


def order_statistics(df: DataFrame, col: str, ranks: list[int], bins: int = 4096) -> list[float]:
    """Exact values at 0-based ``ranks`` of the sorted column, by histogram refinement.

    Each pass aggregates to at most ``bins`` rows; the bin that holds a rank is
    narrowed to its own minimum and maximum until it holds one value. No sort,
    no shuffle of the data. NULL and NaN are not ranked; infinities come first
    and last.
    """
    values = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    answers: dict[int, float] = {}
    inf = float("inf")
    finite = F.when(F.abs("v") < F.lit(inf), F.col("v"))
    total = values.agg(
        F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("v").alias("n"), F.count(F.when(F.col("v") == F.lit(-inf), 1)).alias("low"), F.count(finite).alias("m")
    ).first()
    if not total["n"]:
        raise ValueError("no values to rank")
    # interval -> ranks wanted inside it, relative to its first element
    work: list[tuple[float, float, list[tuple[int, int]]]] = []
    places = {r: min(max(r, 0), total["n"] - 1) - total["low"] for r in ranks}
    answers.update({r: -inf if at < 0 else inf for r, at in places.items() if not 0 <= at < total["m"]})
    if total["m"]:
        work.append((total["lo"], total["hi"], [(r, at) for r, at in places.items() if 0 <= at < total["m"]]))
    while work:
        todo = []
        for lo, hi, wanted in work:
            if lo == hi:
                answers.update({r: lo for r, _ in wanted})
                continue
            scale = 1.0 if hi - lo < inf else 0.25  # the width itself may be beyond the largest double
            width = hi * scale - lo * scale
            b = F.least(F.lit(bins - 1), F.floor((F.col("v") * scale - F.lit(lo * scale)) / F.lit(width) * F.lit(float(bins))))
            hist = (
                values.where(F.col("v").between(lo, hi))
                .groupBy(b.alias("b"))
                .agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                .collect()
            )
            hist.sort(key=lambda r: r["b"])
            starts, acc = [], 0
            for r in hist:
                starts.append(acc)
                acc += r["m"]
            inside: dict[int, list[tuple[int, int]]] = {}
            for r, rel in wanted:
                at = bisect_right(starts, rel) - 1
                inside.setdefault(at, []).append((r, rel - starts[at]))
            todo += [(hist[at]["lo"], hist[at]["hi"], w) for at, w in inside.items()]
        work = todo
    return [answers[r] for r in ranks]


def expand_copies(df: DataFrame, n: str = "n", limit: int = 100_000) -> DataFrame:
    """One row per copy of rows that stand for ``n`` each.

    Rows with very many copies are first cut into chunks that are shuffled
    apart, so no single task writes them all out.
    """
    few = df.where(F.col(n) <= F.lit(limit))
    many = df.where(F.col(n) > F.lit(limit)).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(n) - 1) / F.lit(float(limit))))))
    many = many.withColumn(n, F.least(F.lit(limit), F.col(n) - F.col("_chunk") * F.lit(limit)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))  # a given number is not merged by size: the rows are few, their copies many
    many = many.repartition(parts, *[c for c in df.columns if c != n], "_chunk").drop("_chunk")
    cols = [c for c in df.columns if c != n]
    both = few.select(*cols, n).unionByName(many.select(*cols, n))
    return both.select(*cols, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))).alias("copy"))
