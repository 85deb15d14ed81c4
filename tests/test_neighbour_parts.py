import random

from pyspark.sql import functions as F

from strataspark.operators import neighbours


def test_pairs_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 50)
    rng = random.Random(5)
    seen = [(g, rng.randrange(40)) for g in range(200) for _ in range(6)] + [(0, k) for k in range(40)]  # item 0 to 39 all in group 0
    df = spark.createDataFrame(seen, "g long, i long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shared = neighbours.co_occurrence(df, "i", "g")
        best = neighbours.best_partners(shared, F.col("shared"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    groups = {}
    for g, i in seen:
        groups.setdefault(g, set()).add(i)
    want = {(a, b): sum(a in m and b in m for m in groups.values()) for a in range(40) for b in range(a + 1, 40)}
    assert {(r["a"], r["b"]): r["shared"] for r in shared.collect()} == {k: v for k, v in want.items() if v}
    assert len(shared.inputFiles()) > 20  # 4 in all, however many pairs, before
    top = set()
    for a in range(40):
        own = sorted((-want[min(a, b), max(a, b)], b) for b in range(40) if b != a)[:2]
        top |= {(min(a, b), max(a, b), -n) for n, b in own}
    got = [tuple(r) for r in best.select("a", "b", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == top
