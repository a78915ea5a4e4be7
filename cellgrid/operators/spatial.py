"""Distance joins on bucketed coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.operators.skew import shuffled
from cellgrid.session import materialize

_STEP = 3  # bits by which bucket numbers shrink from one level of a pyramid to the next
LISTED = 1000  # centres within reach of a bucket that its points compare in place; above, they are paired by a join
_RING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _bucket(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def _spread(centers: DataFrame, size: float, salts: int = 1) -> DataFrame:
    """Copy each centre to its own and the eight adjacent buckets (and to every salt)."""
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _RING])
    out = centers.select("*", F.explode(near).alias("_o")).select(
        *centers.columns,
        (_bucket(F.col("cx"), size) + F.col("_o.a")).alias("bu"),
        (_bucket(F.col("cy"), size) + F.col("_o.b")).alias("bv"),
    )
    return out if salts == 1 else out.withColumn("bs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def range_semi_join(points: DataFrame, centers: DataFrame, radius: float, salts: int = 8) -> DataFrame:
    """Points with at least one centre within ``radius``.

    Equi semi join on a grid of ``radius``-sized buckets with the distance as
    residual. The few centres are copied to neighbouring buckets and salts;
    the many points move once, and one crowded bucket spreads over ``salts``
    tasks (more through adaptive splitting).
    """
    spread = _spread(centers.select("cx", "cy"), radius, salts).alias("c")
    p = points.withColumns({
        "bu": _bucket(F.col("x"), radius), "bv": _bucket(F.col("y"), radius),
        "bs": F.pmod(F.xxhash64("x", "y", "gene"), F.lit(salts)).cast("int"),
    }).alias("p")
    d2 = (F.col("p.x") - F.col("c.cx")) ** 2 + (F.col("p.y") - F.col("c.cy")) ** 2
    cond = (
        (F.col("p.bu") == F.col("c.bu")) & (F.col("p.bv") == F.col("c.bv")) & (F.col("p.bs") == F.col("c.bs"))
        & (d2 <= F.lit(radius * radius))
    )
    return p.join(shuffled(spread), cond, "left_semi").drop("bu", "bv", "bs")


def _closest(pairs: DataFrame, key: str, center_key: str) -> DataFrame:
    """Per point the closest of the centres it was paired with; of equally close ones the lowest key."""
    d2 = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    best = F.min(F.struct(d2.alias("d2"), F.col(center_key).alias("c"))).alias("b")
    return pairs.groupBy(key, "x", "y").agg(best).select(key, "x", "y", F.col("b.d2").alias("distance2"), F.col("b.c").alias("nearest"))


def _in_reach(points: DataFrame, centers: DataFrame, key: str, size: float, center_key: str) -> DataFrame:
    """Per point the closest centre in the 3x3 buckets around it, if there is one.

    A bucket's centres are one row with a list, so a point meets one row and nothing is
    sorted or grouped by point. Buckets with too many for a list are paired with each point.
    """
    at = ["bu", "bv"]
    points = points.withColumns({"bu": _bucket(F.col("x"), size), "bv": _bucket(F.col("y"), size)})
    spread = _spread(centers, size)
    crowded = spread.groupBy(*at).count().where(F.col("count") > F.lit(LISTED)).select(*at)
    paired = None
    if not crowded.isEmpty():
        paired = _closest(points.join(crowded, at, "left_semi").join(spread, at), key, center_key)
        points, spread = points.join(crowded, at, "left_anti"), spread.join(crowded, at, "left_anti")
    lists = spread.groupBy(*at).agg(F.collect_list(F.struct("cx", "cy", center_key)).alias("near"))
    d2 = lambda c: (F.col("x") - c["cx"]) ** 2 + (F.col("y") - c["cy"]) ** 2
    best = F.array_min(F.transform("near", lambda c: F.struct(d2(c).alias("d2"), c[center_key].alias("c"))))
    listed = points.join(lists.hint("shuffle_hash"), at, "left").select(key, "x", "y", best.alias("b"))
    listed = listed.select(key, "x", "y", F.col("b.d2").alias("distance2"), F.col("b.c").alias("nearest"))
    return listed if paired is None else listed.unionByName(paired)


def nearest_center(points: DataFrame, centers: DataFrame, key: str, size: float, center_key: str = "cell") -> DataFrame:
    """Squared distance from each point to its closest centre (ties: lowest centre key).

    Looks in the 3x3 buckets around a point; a hit no farther than one bucket
    is final. Points without one go down a pyramid of occupied buckets
    (:func:`_near_buckets`). Centres at one place count once; points without
    coordinates have no distance.
    """
    points = points.select(key, "x", "y").distinct()
    centers = centers.where("cx is not null and cy is not null").groupBy("cx", "cy").agg(F.min(center_key).alias(center_key))
    centers = materialize(centers, "centres")  # read several times below
    extent = centers.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if extent[0] is None:
        raise ValueError("no centres")
    first = materialize(_in_reach(points, centers, key, size, center_key), "nearest")
    done = F.coalesce(F.col("distance2") <= F.lit(size * size), F.col("x").isNull() | F.col("y").isNull())
    found, left = first.where(done).select(key, "distance2", "nearest"), first.where(~done).select(key, "x", "y")
    if left.isEmpty():
        return found
    left = left.withColumns({"qu": _bucket(F.col("x"), size), "qv": _bucket(F.col("y"), size)})
    leaves = centers.withColumns({"bu": _bucket(F.col("cx"), size), "bv": _bucket(F.col("cy"), size)})
    near = _near_buckets(left.select("qu", "qv").distinct(), leaves.select("bu", "bv").distinct(), [math.floor(v / size) for v in extent])
    rest = _closest(left.join(near, ["qu", "qv"]).join(leaves, ["bu", "bv"]), key, center_key)
    return found.unionByName(rest.select(key, "distance2", "nearest"))


def _near_buckets(queries: DataFrame, leaves: DataFrame, extent: list[int]) -> DataFrame:
    """Per query bucket (qu, qv) all occupied buckets (bu, bv) that may hold the closest centre of a point in it.

    A bucket of one level has 8 x 8 buckets of the next finer one. From at most
    2 x 2 buckets around everything (``extent``: lowest and highest bu, bv) each
    level keeps those not farther, at best, than the closest one is at worst. So
    the steps follow the logarithm of the extent, and a query meets a thin rim of
    buckets and never all centres. Many queries share a coarse bucket, which has
    at most 64 finer ones: adaptive execution splits that side.
    """
    umin, umax, vmin, vmax = extent
    top = 1
    while (umax >> _STEP * top) - (umin >> _STEP * top) > 1 or (vmax >> _STEP * top) - (vmin >> _STEP * top) > 1:
        top += 1
    roots = [F.struct(F.lit(u).cast("bigint").alias("pu"), F.lit(v).cast("bigint").alias("pv")) for u in {umin >> _STEP * top, umax >> _STEP * top} for v in {vmin >> _STEP * top, vmax >> _STEP * top}]
    kept = queries.select("qu", "qv", F.explode(F.array(*roots)).alias("r")).select("qu", "qv", "r.*")
    for level in range(top - 1, -1, -1):
        width = float(1 << _STEP * level)
        finer = leaves.select(F.shiftright("bu", _STEP * level).alias("bu"), F.shiftright("bv", _STEP * level).alias("bv")).distinct()
        pairs = kept.join(finer.withColumns({"pu": F.shiftright("bu", _STEP), "pv": F.shiftright("bv", _STEP)}), ["pu", "pv"])

        def gap(q: str, b: str) -> Column:
            return F.greatest(F.col(b) * width - F.col(q) - 1.0, F.col(q) - (F.col(b) + 1) * width, F.lit(0.0))

        def span(q: str, b: str) -> Column:
            return F.greatest((F.col(b) + 1) * width - F.col(q), F.col(q) + 1.0 - F.col(b) * width)

        low, high = gap("qu", "bu") ** 2 + gap("qv", "bv") ** 2, span("qu", "bu") ** 2 + span("qv", "bv") ** 2
        bound = F.min(high).over(Window.partitionBy("qu", "qv"))  # one query bucket's candidates, never many
        pairs = pairs.select("qu", "qv", "bu", "bv", low.alias("low"), bound.alias("bound"))
        kept = materialize(pairs.where(F.col("low") <= F.col("bound") * (1 + 1e-9)).select("qu", "qv", F.col("bu").alias("pu"), F.col("bv").alias("pv")), "near")
    return kept.select("qu", "qv", F.col("pu").alias("bu"), F.col("pv").alias("bv"))


def bounding_box(df: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows inside an axis-aligned box, borders included."""
    return df.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))
