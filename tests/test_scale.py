"""Ordered and ranked building blocks against plain Python, with one key holding most rows."""
import random
import statistics

from pyspark.sql import functions as F

from gridloom.operators import aggregate as A
from gridloom.operators import scale as S


def skewed(n=400, seed=3):
    r = random.Random(seed)
    return [("hot" if i % 3 else f"k{i % 7}", i, r.randint(0, 9)) for i in range(n)]


def per_key(rows):
    out = {}
    for k, p, v in rows:
        out.setdefault(k, []).append((p, v))
    return {k: sorted(v) for k, v in out.items()}


def test_running_sums_and_carries_cross_chunks(spark):
    rows = [(k, i, v) for k, vs in per_key(skewed()).items() for i, (_, v) in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    got = S.running(df, ["k"], "p", {"s": F.col("v")}, {"c": F.when(F.col("v") > 6, F.col("v"))}, chunk=16)
    got = {(r.k, r.p): (r.s, r.c) for r in got.collect()}
    for k, vs in per_key(rows).items():
        total, last = 0, None
        for p, v in vs:
            total += v
            last = v if v > 6 else last
            assert got[(k, p)] == (total, last)


def test_neighbours_cross_chunks(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("p"), (F.col("id") * 2).alias("v"))
    got = {r.p: (r.b2, r.n1) for r in S.neighbours(df, ["k"], "p", {"b2": (F.col("v"), -2), "n1": (F.col("v"), 1)}, chunk=8).collect()}
    assert got == {i: (2 * (i - 2) if i > 1 else None, 2 * (i + 1) if i < 49 else None) for i in range(50)}


def test_numbered_matches_sorting(spark):
    rows = skewed()
    got = {(r.k, r.p): r.rn for r in S.numbered(spark.createDataFrame(rows, "k string, p long, v int"), ["k"], [F.desc("v"), F.col("p")]).collect()}
    for k, vs in per_key(rows).items():
        for i, (p, _) in enumerate(sorted(vs, key=lambda x: (-x[1], x[0])), 1):
            assert got[(k, p)] == i


def test_quantiles_are_exact(spark):
    rows = skewed()
    got = {r.k: (r.q1, r.q2) for r in S.quantiles(spark.createDataFrame(rows, "k string, p long, v int"), ["k"], "v", {"q1": 0.25, "q2": 0.5}).collect()}
    for k, vs in per_key(rows).items():
        xs = [v for _, v in vs]
        q = statistics.quantiles(xs, n=4, method="inclusive")
        assert got[k] == (q[0], q[1])


def test_runs(spark):
    df = spark.createDataFrame([("a", n) for n in (5, 6, 7, 9, 9)], "k string, n long")
    assert sorted((r.first, r.last) for r in A.runs(df, ["k"], "n").collect()) == [(5, 7), (9, 9)]


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(), "k string, p long, v int")
    plan = S.top_per_key(df, ["k"], [F.desc("v")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_take_budget(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(6)], "k string, i int, s int")
    assert A.take_budget(df, ["k"], [F.col("i")], "s", 35).count() == 3
