"""Joins by nearness in time against plain loops, in one slice and in many."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import sweep


def sides(spark, n, instants, seed):
    rng = random.Random(seed)
    a = [(f"a{i}", rng.choice([None, *range(instants)])) for i in range(n)]
    b = [(f"b{i}", rng.choice([None, *range(instants)])) for i in range(n)]
    a += a[:3]
    left = spark.createDataFrame(a, "a string, x long")
    return a, b, left, spark.createDataFrame(b, "b string, y long")


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
@pytest.mark.parametrize("instants", [1, 5, 400])
def test_window_pairs(spark, step, instants):
    a, b, left, right = sides(spark, 120, instants, 1)
    want = sorted((i, x, j, y) for i, x in a for j, y in b if x is not None and y is not None and -3 <= y - x <= 2)
    got = sorted(map(tuple, sweep.window_pairs(left, right, ("x", "y"), 3, 2, step).collect()))
    assert got == want


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
@pytest.mark.parametrize("instants", [1, 40, 4000])
def test_latest_before(spark, step, instants):
    a, b, left, right = sides(spark, 150, instants, 2)
    want = []
    for i, x in a:
        ahead = [(y, j) for j, y in b if x is not None and y is not None and y <= x]
        y, j = max(ahead, default=(None, None))
        want.append((i, x, j, y))
    got = sweep.latest_before(left, right, ("x", "y"), "b", step).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_empty_sides(spark):
    _, _, left, right = sides(spark, 5, 3, 3)
    none = right.where("false")
    assert sweep.window_pairs(left, none, ("x", "y"), 9, 9).count() == 0
    assert sweep.latest_before(left, none, ("x", "y"), "b").where("b is null").count() == left.count()
    assert sweep.latest_before(left.where("false"), right, ("x", "y"), "b").count() == 0


def test_a_busy_instant_spreads(spark):
    n = 3000
    left = spark.range(n).select(F.concat(F.lit("a"), "id").alias("a"), F.lit(5).cast("long").alias("x"))
    right = spark.range(n).select(F.concat(F.lit("b"), "id").alias("b"), F.lit(5).cast("long").alias("y"))
    pairs = sweep.window_pairs(left, right, ("x", "y"), 0, 0, 500)
    tasks = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == n * n and len(tasks) == 4
    assert max(r[1] for r in tasks) < 0.6 * n * n
