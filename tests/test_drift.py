"""Two versions of a set of tables: sketches, one-to-one assignment, planted drift."""
import itertools
import random

from pyspark.sql import functions as F

from gridloom.operators import drift as D, quality as Q


def test_assignment_has_the_largest_sum():
    rng = random.Random(2)
    for _ in range(150):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        score = [[rng.choice([0, .5, rng.random()]) for _ in range(m)] for _ in range(n)]
        got = D.assigned(score)
        assert len([j for j in got if j is not None]) == min(n, m) == len({j for j in got if j is not None})
        total = sum(score[i][j] for i, j in enumerate(got) if j is not None)
        short, long = (score, m) if n <= m else ([list(c) for c in zip(*score)], n)
        assert abs(total - max(sum(short[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(long), len(short)))) < 1e-9
    assert D.assigned([]) == []


def test_sketches_estimate_overlap(spark):
    df = spark.range(4000).select(F.col("id").alias("a"), (F.col("id") + 1000).alias("b"), (F.col("id") + 9000).alias("c"), F.lit(None).cast("string").alias("d"), F.lit(" ").alias("e"))
    s = D.sketches(df)
    assert s["d"] == s["e"] == {} and D.alike(s["d"], s["e"]) == 0 and D.alike(s["a"], s["a"]) == 1
    assert abs(D.alike(s["a"], s["b"]) - 3000 / 5000) < 0.15 and D.alike(s["a"], s["c"]) < 0.05
    assert D.sketches(df.repartition(7)) == s


def test_columns_pair_by_name_then_by_values(spark):
    old = D.sketches(spark.createDataFrame([(i, f"n{i}", i % 7, "x") for i in range(300)], "id long, name string, grade int, note string"))
    new = D.sketches(spark.createDataFrame([(f"n{i}", i % 7, i, "y") for i in range(300)], "who string, klass int, pupil_id long, remark string"))
    assert D.pair_columns(old, new) == {"id": "pupil_id", "name": "who", "grade": "klass", "note": None}


def test_planted_drift_over_tables(spark):
    sites = spark.createDataFrame([(i, f"site {i}", ["north", "south"][i % 2]) for i in range(80)], "site_id long, site string, zone string")
    visits = spark.createDataFrame([(i, i % 80, f"2026-01-{1 + i % 28:02d}", str(i * 3)) for i in range(400)], "visit_id long, site_id long, day string, amount string")
    staff = spark.createDataFrame([(i, f"person {i}") for i in range(30)], "staff_id long, person string")
    family = D.teach({"sites": sites, "visits": visits, "staff": staff}, kinds={"visits": {"day": "date", "amount": "number"}}, values={"sites": {"zone": ["north", "south"]}}, used={"visits": ["amount"]})
    same = D.contracts(spark, {"sites": sites, "visits": visits, "staff": staff}, family)
    assert same.count() == 0 and Q.status(same).first()[0] == "ok"
    now = {"places": sites.withColumnRenamed("site", "label").withColumn("zone", F.when(F.col("site_id") == 3, "West").otherwise(F.col("zone"))),
           "visits": visits.drop("amount").withColumn("day", F.when(F.col("visit_id") % 2 == 0, F.lit("soon")).otherwise(F.col("day"))), "rates": spark.range(900, 950).withColumnRenamed("id", "rate")}
    got = {tuple(r) for r in D.contracts(spark, now, family).select("table", "what", "name", "severity").collect()}
    assert got == {("sites", "renamed table", "places", 1), ("sites", "renamed column", "site", 1), ("sites", "new value", "zone", 1), ("staff", "missing table", "staff", 2),
                   ("visits", "missing column", "amount", 2), ("visits", "parse rate", "day", 2), ("rates", "new table", "rates", 1)}
    assert Q.status(D.contracts(spark, now, family)).first()[0] == "drift"
    gone = D.contracts(spark, {}, family)
    assert {r.what for r in gone.collect()} == {"missing table"} and gone.count() == 3
    assert {r.what for r in D.contracts(spark, {"a": sites}, {}).collect()} == {"new table"}
