"""Exact quantiles against a sort of each group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.operators import quantiles as Q

SHARES = [0.0, 0.02, 0.25, 0.5, 0.77, 0.98, 1.0]


def _want(rows, shares=SHARES):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    return {g: (len(v), np.quantile(v, shares).tolist()) for g, v in groups.items() if v}


def _rows(n=30_000):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1) if rng.random() < 0.5 else float(rng.randrange(5))) for _ in range(int(n * 0.95))]
    rows += [("ties", 7.0) for _ in range(500)] + [("wide", 10.0 ** rng.uniform(-200, 200)) for _ in range(400)] + [(None, float(k)) for k in range(300)]
    rows += [("one", 5.5), ("two", 1.0), ("two", 2.0), ("none", None), ("hot", None)]
    return rows


@pytest.mark.parametrize("gather", [10**9, 0])
def test_groups_with_one_of_95_per_cent(spark, monkeypatch, gather):
    monkeypatch.setattr(Q, "GATHER", gather)
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: (r["n"], r["q"]) for r in Q.exact_quantiles(df, "v", SHARES, ["g"]).collect()}
    want = _want(rows)
    assert got.keys() == want.keys()
    for g in want:
        assert got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], rel=1e-12), g


@pytest.mark.parametrize("bad", [False, True])
def test_whole_table_and_bounds_that_do_not_hold(spark, monkeypatch, bad):
    monkeypatch.setattr(Q, "GATHER", 0)
    if bad:
        monkeypatch.setattr(Q, "WIDTH", 1e-9)
        monkeypatch.setattr(Q, "ACCURACY", 3)
    rows = [("x", v) for _, v in _rows(8_000) if v is not None]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    (got,) = Q.exact_quantiles(df, F.col("v") * 2, [0.5, 0.5, 0.1]).collect()
    assert got["n"] == len(rows) and got["q"] == pytest.approx((2 * np.quantile([v for _, v in rows], [0.5, 0.5, 0.1])).tolist(), rel=1e-12)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0
    (row,) = Q.middle(df, "v").collect()
    assert (row["n"], row["m"]) == (0, None)


def test_no_task_ranks_more_than_a_range(spark, monkeypatch):
    """The ranked rows of a hot group lie in many ranges, and one value of most rows is one row."""
    monkeypatch.setattr(Q, "GATHER", 0)
    ranked = []
    plain = Q._ranked

    def watched(distinct, keys):
        ranked.append(distinct.count())
        return plain(distinct, keys)

    monkeypatch.setattr(Q, "_ranked", watched)
    df = spark.range(200_000).select(F.when(F.col("id") % 20 > 0, 3.0).otherwise(F.col("id").cast("double")).alias("v"))
    (row,) = Q.exact_quantiles(df, "v", [0.5, 0.975]).collect()
    want = np.quantile([3.0] * 190_000 + [float(k) for k in range(0, 200_000, 20)], [0.5, 0.975]).tolist()
    assert row["q"] == pytest.approx(want) and ranked[0] < 0.01 * 200_000
