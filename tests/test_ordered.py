"""Sliced scans give what one-task windows give, also when one key holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions.ordered import group_quantiles, percent_ranks, previous, running_total


@pytest.fixture()
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(40) / 4.0) for i in range(400)]
    rng.shuffle(data)
    spark.conf.set("spark.ledgerscope.splitRows", "9")
    yield data, spark.createDataFrame(data, "k string, at int, v double")
    spark.conf.unset("spark.ledgerscope.splitRows")


def test_running_total_and_previous(rows):
    data, df = rows
    total = {r["at"]: r["t"] for r in running_total(df, ["k"], ["at"], F.col("at"), "t").collect()}
    before = {r["at"]: r["p"] for r in previous(df, ["k"], ["at"], "v", "p").collect()}
    for key in {k for k, _, _ in data}:
        run, last = 0, None
        for _, at, v in sorted(d for d in data if d[0] == key):
            assert total[at] == run and before[at] == last
            run, last = run + at, v


def test_quantiles_and_ranks(rows):
    data, df = rows
    got = {r["k"]: (r["m"], r["q"]) for r in group_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.25}).collect()}
    for key, (m, q) in got.items():
        vals = sorted(v for k, _, v in data if k == key)
        assert m == pytest.approx(statistics.median(vals))
        pos = 0.25 * (len(vals) - 1)
        lo = int(pos)
        assert q == pytest.approx(vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (pos - lo))
    ranks = {r["at"]: r["p"] for r in percent_ranks(df, {"v": "p"}).collect()}
    every = [v for _, _, v in data]
    for _, at, v in data:
        low, same = sum(x < v for x in every), every.count(v)
        assert ranks[at] == pytest.approx((low + (same + 1) / 2 - 1) / (len(every) - 1))
