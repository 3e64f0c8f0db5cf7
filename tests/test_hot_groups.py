"""Groups that hold all rows are many tasks and give what one task would."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import context, windows


def greedy(rows, budget):
    out, used = {}, {}
    for g, s, k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2])):
        tokens = max(1, -(-n // 4))
        ok = used.get(g, 0) + tokens <= budget
        used[g] = used.get(g, 0) + (tokens if ok else 0)
        out[k] = (g, tokens, ok)
    return out


@pytest.mark.parametrize("groups", [["a"], [None, "a", "b"], [f"g{i}" for i in range(60)]])
def test_greedy_packing_of_hot_groups(spark, groups):
    rng = random.Random(len(groups))
    rows = [(rng.choice(groups), float(rng.randint(0, 30)), i, rng.choice([1, 7, 40, 200, 900])) for i in range(700)]
    df = spark.createDataFrame([(g, s, k, "x" * n) for g, s, k, n in rows], "g string, s double, k int, body string").repartition(5)
    for budget in (300, 7):
        got = context.pack_greedy(df, "g", "s", "k", "body", budget)
        assert {r["k"]: (r["g"], r["tokens"], r["accepted"]) for r in got.collect()} == greedy(rows, budget)
    if len(groups) == 1:  # the group is in more than one task
        assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_greedy_packing_of_nothing(spark):
    assert context.pack_greedy(spark.createDataFrame([], "g string, s double, k int, body string"), "g", "s", "k", "body", 5).collect() == []


@pytest.mark.parametrize("groups", [["a"], [None, "a", "b"]])
def test_prefix_packing_of_hot_groups(spark, groups):
    rng = random.Random(7)
    rows = [(rng.choice(groups), i, rng.randint(0, 60)) for i in range(500)]
    df = spark.createDataFrame([(g, o, "x" * n) for g, o, n in rows], "g string, o int, body string").repartition(5)
    for budget in (5, 400, 10_000):
        want, run = {}, {}
        for g, o, n in sorted(rows, key=lambda r: r[1]):
            run[g] = run.get(g, -1) + n + 1
            tokens = max(1, -(-run[g] // 4))
            if tokens <= budget:
                want[o] = tokens
        assert {r["o"]: r["tokens"] for r in context.pack_prefix(df, "g", "o", "body", budget).collect()} == want


def test_windows_of_a_hot_scope(spark):
    rng = random.Random(9)
    rows = [(None if i % 50 == 0 else "hot" if rng.random() < 0.9 else f"s{i % 7}", rng.choice([-1, 1]) * 500_000 + rng.randint(0, 200) * 5_000, i) for i in range(1500)]
    df = spark.createDataFrame(rows, "scope string, at long, id int")
    got = {r["id"]: (r["inLast"], r["limited"]) for r in windows.rate_limited(df, ["scope"], "at", 6).collect()}
    want = {i: sum(1 for s, t, _ in rows if s == scope and at - 60_000 <= t <= at) for scope, at, i in rows}
    assert got == {i: (n, n > 6) for i, n in want.items()}
    summed = {r["id"]: r["inLast"] for r in windows.in_last(df, ["scope"], "at", 60_000, F.col("id").cast("long")).collect()}
    assert summed == {i: sum(j for s, t, j in rows if s == scope and at - 60_000 <= t <= at) for scope, at, i in rows}
    assert df.withColumn("b", F.floor(F.col("at") / 60_000)).where("scope = 'hot'").select("b").distinct().count() > 20  # keys of the scope


def test_trends(spark):
    rows = [("p", 10, 5.0), ("p", 20, 7.0), ("p", 30, 4.0), (None, 10, 1.0), (None, 30, 2.0), ("q", 10, 3.0)]
    df = spark.createDataFrame(rows, "projectId string, createdAt long, savedPercent double")
    assert [r["createdAt"] for r in windows.trend(df, "p", 0, 2).collect()] == [20, 30]
    assert [r["createdAt"] for r in windows.trend(df, None, 15).collect()] == [30]
    assert {r["projectId"]: (r["savedPercent"], r["rows"]) for r in windows.trend_change(df, ("savedPercent",)).collect()} == {"p": (-1.0, 3), None: (1.0, 2), "q": (0.0, 1)}
