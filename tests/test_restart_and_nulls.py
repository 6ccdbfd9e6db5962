"""Streams that go on after a restart, groups with NULL keys, and limits that are only there when asked for."""
import datetime as dt

from pyspark.sql import functions as F

from gridloom.operators import aggregate as A, labels as L, profile as R, vault as V
from gridloom.operators.detect import detect, exploded
from gridloom.plans.form import Form, Spec, run_form
from gridloom.session import scratch
from gridloom.streaming import jobs as ST

NONE = None


def test_a_restarted_stream_keeps_its_output_and_repeats_nothing(spark):
    src, out, ran = scratch(spark, "in"), scratch(spark, "once"), spark.sparkContext.accumulator(0)

    def arrive(*keys):
        spark.createDataFrame([(k, dt.datetime(2026, 1, 1)) for k in keys], "key string, t timestamp").write.mode("append").parquet(src)

    def act(df):
        n = df.count()
        ran.add(n)
        return df.select("key", F.lit("done").alias("result"))
    stream = lambda: spark.readStream.schema("key string, t timestamp").parquet(src)
    arrive("a", "b")
    assert sorted(r.key for r in ST.stream_once(stream(), out, act).collect()) == ["a", "b"]
    arrive("b", "c")
    assert sorted(r.key for r in ST.stream_once(stream(), out, act).collect()) == ["a", "b", "c"]
    assert sorted(r.key for r in ST.stream_once(stream(), out, act).collect()) == ["a", "b", "c"] and ran.value == 3


def test_a_restarted_tally_goes_on_counting(spark):
    src, out = scratch(spark, "votes"), scratch(spark, "tally")
    t0 = dt.datetime(2026, 1, 1)
    schema = "t timestamp, outcome string, seconds double"
    for n in (2, 3):
        spark.createDataFrame([(t0, "x", 1.0)] * n, schema).write.mode("append").parquet(src)
        got = ST.stream_tally(spark.readStream.schema(schema).parquet(src), out, late="1 day")
    assert [(r.outcome, r.n) for r in got.collect()] == [("x", 5)]


def test_null_keys_and_groups_without_values_stay(spark):
    df = spark.createDataFrame([(NONE, 1.0), (NONE, 3.0), ("a", 2.0), ("b", NONE), ("b", NONE)], "k string, x double")
    got = {r.k: r for r in A.spread(df, ["k"], "x").collect()}
    assert set(got) == {NONE, "a", "b"} and got[NONE].median == 2.0 and got["b"].median is NONE and got[NONE].top1 == 3.0
    assert A.spread(df, [], "x").first().median == 2.0
    ev = spark.createDataFrame([(m, "yes", "yes", True, s, 1.0) for m, s in ((NONE, 1.0), ("p", NONE), ("q", 2.0))], "model string, truth string, answer string, hard boolean, seconds double, cost double")
    assert {r.model: r.median_seconds for r in L.label_eval(ev).collect()} == {NONE: 1.0, "p": NONE, "q": 2.0}
    runs = spark.createDataFrame([(NONE, "k", True, True, False, 1.0), ("r", "k", True, False, True, NONE)], "run string, kind string, covered boolean, correct boolean, error boolean, seconds double")
    assert {r.run: r.median_seconds for r in L.run_summary(runs, ["k"]).collect()} == {NONE: 1.0, "r": NONE}
    assert {r.column: r.median for r in R.summary(spark.createDataFrame([(1.0, NONE)], "u double, v double"), ["u", "v"]).collect()} == {"u": 1.0, "v": NONE}
    n = spark.createDataFrame([(NONE, 1), (NONE, 2), (NONE, 5), ("a", 7), ("a", 7), ("a", NONE)], "k string, n long")
    assert {tuple(r) for r in A.runs(n, ["k"], "n").collect()} == {(NONE, 1, 2), (NONE, 5, 5), ("a", 7, 7)}
    top = spark.createDataFrame([(NONE, 9), ("a", 5), ("b", 1)], "k string, v long")
    assert {tuple(r) for r in A.top_with_others(top, "k", "v", 2).collect()} == {(NONE, 9), ("a", 5), ("Others", 1)}
    rest = A.compare(df, "k", "x", ["a"]).first()
    assert rest.rest_pooled == 2.0  # the rows without a group are the rest
    sessions = spark.createDataFrame([(NONE, dt.date(2026, 1, 5), 1.0, 2.0), (NONE, dt.date(2026, 5, 5), 1.0, 1.0)], "e string, d date, num double, den double")
    assert sorted((r.entry, r.elapsed) for r in A.cohorts(sessions, "e", "d", "num", "den").collect()) == [("2026-Q1", 0), ("2026-Q1", 1)]


def test_no_group_is_cut_unless_asked(spark):
    df = spark.range(250).select(F.col("id").cast("string").alias("c"), F.lit(1).alias("n"))
    form = Form(kinds={"c": "choice", "n": "number"})
    spec = {"measures": ["rows"], "group_by": ["c"]}
    assert run_form(df, form, Spec(**spec)).count() == 251 and run_form(df, form, Spec(**spec, limit=3)).count() == 4
    assert run_form(df, form, Spec(measures=[])).count() == 250


def test_short_names_long_addresses_and_other_digits_are_coded(spark):
    vault = spark.createDataFrame([("li", "Li", "person_name", "NAME", 1, "NAME_001")], "norm string, value string, class string, prefix string, number int, code string")
    docs = spark.createDataFrame([(1, "met Li and Asha Rao"), (2, "Lima is a city")], "id long, text string")
    out = V.redact(docs, "id", "text", vault)
    assert {r.id: r.redacted for r in out.collect()} == {1: "met NAME_001 and Asha Rao", 2: "Lima is a city"}
    assert [r.id for r in V.leaks(docs, "id", "text", vault).collect()] == [1] and V.leaks(out, "id", "redacted", vault).count() == 0
    mail = "a" * 127 + "@example.org"
    texts = spark.createDataFrame([(1, f"write to {mail} now"), (2, "call ९८७६५४३२१०")], "id long, text string")
    found = exploded(detect(texts, "text", "regex+digits", clean=True), ["id"], "text").collect()
    assert {(r.id, r.value) for r in found} == {(1, mail), (2, "९८७६५४३२१०")}
