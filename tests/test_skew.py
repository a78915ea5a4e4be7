import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators.skew import dense_index, no_match, order_statistics, packed_vote, salted_prefix, unpack_candidate, unpack_votes


@pytest.mark.parametrize("splits", [1, 2, 7, 64])
def test_dense_index_ignores_split_points(spark, splits):
    rnd = random.Random(4)
    keys = [(f"f{rnd.randrange(3)}", f"c{rnd.randrange(200)}") for _ in range(500)]
    df = spark.createDataFrame(keys, "fov string, cell string")
    got = {(r.fov, r.cell): r.idx for r in dense_index(df, ["fov", "cell"], splits=splits).collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(keys)))}


def test_dense_index_empty(spark):
    df = spark.createDataFrame([], "a string")
    assert dense_index(df, ["a"]).count() == 0


@pytest.mark.parametrize("hot", [3, 50, 10_000])
def test_salted_prefix_is_the_ordered_prefix(spark, hot):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(20)}", i, rnd.randrange(1, 4)) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, id long, w long")
    got = {(r.key, r.id): r.earlier for r in salted_prefix(df, ["key"], ["id"], "w", hot_rows=hot).collect()}
    want, sums = {}, {}
    for key, i, w in sorted(rows):
        want[key, i] = sums.get(key, 0)
        sums[key] = want[key, i] + w
    assert got == want


def test_no_match_spreads_null_keys(spark):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN id END AS cell")
    keyed = df.withColumn("c", no_match(F.col("cell"), "id"))
    assert keyed.where("cell IS NULL").where("c >= 0").count() == 0 and keyed.where("cell IS NOT NULL AND c <> cell").count() == 0
    sizes = [r["n"] for r in keyed.repartition(8, "c").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 1000 / 8


def test_expand_copies(spark):
    from cellgrid.operators.skew import expand_copies

    df = spark.createDataFrame([("a", 1), ("b", 25), ("c", 10)], "key string, n long")
    got = {r.key: r["count"] for r in expand_copies(df, limit=10).groupBy("key").count().collect()}
    assert got == {"a": 1, "b": 25, "c": 10}


def test_order_statistics_are_exact(spark):
    rnd = random.Random(2)
    values = [rnd.choice([0.0, 1.5, rnd.gauss(0, 1e6), rnd.random() * 1e-9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [0, 1, 30, 1500, 2969, 2999]
    assert order_statistics(df, "v", ranks, bins=8) == [sorted(values)[r] for r in ranks]


def test_order_statistics_without_nan(spark):
    nan, inf = float("nan"), float("inf")
    values = [nan, 3.0, -inf, 1.7e308, inf, -1.7e308, 5e-324, 0.0, nan, inf, 3.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    ranked = sorted(v for v in values if v == v)
    assert order_statistics(df, "v", list(range(len(ranked)))) == ranked


def test_packed_vote_holds_every_id(spark):
    top = (1 << 63) - 1
    for rows, best in (([(5, 9), (5, 2), (4, 1)], (2, 5)), ([(1 << 31, 1 << 40), (1 << 31, (1 << 40) + 1), (7, 0)], (1 << 40, 1 << 31)), ([(top, top), (top - 1, 0)], (top, top)), ([(0, 0)], (0, 0))):
        df = spark.createDataFrame(rows, "n long, c long")
        r = df.agg(F.max(packed_vote(F.col("n"), F.col("c"))).alias("p")).select(unpack_candidate(F.col("p")).alias("c"), unpack_votes(F.col("p")).alias("n")).first()
        assert (r.c, r.n) == best
