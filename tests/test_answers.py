"""Specs, periods, search, quality and streams on planted cases."""
import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import labels as L
from gridloom.operators import quality as Q
from gridloom.operators import search as S
from gridloom.plans import form as fm
from gridloom.plans import steps as st
from gridloom.plans.periods import extract_period
from gridloom.plans.saved import Param, bind
from gridloom.streaming.jobs import safe_cut

AS_OF = dt.date(2025, 11, 18)


PHRASES = [
    ("last 7 days", ("2025-11-12", "2025-11-18")), ("sales last month", ("2025-10-01", "2025-10-31")), ("this FY", ("2025-04-01", "2025-11-18")),
    ("last financial year", ("2024-04-01", "2025-03-31")), ("july to sept", ("2025-07-01", "2025-09-30")), ("december", ("2024-12-01", "2024-12-31")),
    ("nov to feb", ("2024-11-01", "2025-02-28")), ("since july", ("2025-07-01", None)), ("after august", ("2025-09-01", None)), ("before march", (None, "2025-02-28")),
    ("01/09 to 15/09", ("2025-09-01", "2025-09-15")), ("08/26 to 10/26", ("2025-08-26", "2025-10-26")), ("2026-09-01 to 2026-09-30", ("2026-09-01", "2026-09-30")),
    ("in may 2024", ("2024-05-01", "2024-05-31")), ("it may rain", None), ("so far", None), ("on 5/3/25", ("2025-03-05", "2025-03-05")), ("last quarter", ("2025-07-01", "2025-09-30")),
    ("past week", ("2025-11-12", "2025-11-18")), ("ytd", ("2025-01-01", "2025-11-18")), ("31/02 to 05/03", None), ("until the start of june 2025", (None, "2025-06-30")),
    ("this month so far", ("2025-11-01", "2025-11-18")), ("after 30/12/24", ("2024-12-31", None)), ("march 2024", ("2024-03-01", "2024-03-31")), ("", None), (None, None)]


def test_period_phrases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PHRASES)], "i int, text string").withColumn("p", extract_period(F.col("text"), F.lit(AS_OF)))
    got = {r.i: tuple(d and d.isoformat() for d in r.p) for r in df.collect()}
    assert {PHRASES[i][0]: got[i] for i in got} == {t: want or (None, None) for t, want in PHRASES}


FORM = fm.Form(kinds={"ward": "choice", "amount": "number", "day": "date"}, known={"ward": ["A", "B", "C"]}, presets={"a": {"ward": ["A"]}})


def claims(spark):
    rows = [("A", 10.0, "2025-11-02"), ("a ", 20.0, "2025-10-31"), ("B", 5.0, None), (None, 7.0, "2025-11-05"), ("C", None, "2025-11-06")]
    return spark.createDataFrame(rows, "ward string, amount double, day string").withColumn("day", F.to_date("day"))


def test_not_filter_keeps_blanks_and_total_is_recomputed(spark):
    spec = fm.Spec(measures=["rows", "avg:amount"], group_by=["ward"], filters={"ward": {"not": "b"}})
    got = {(r.ward, r.is_total): (r.rows, r.avg_amount) for r in fm.run_form(claims(spark), FORM, spec).collect()}
    assert got[("(blank)", False)] == (1, 7.0) and got[("(total)", True)][0] == 4 and abs(got[("(total)", True)][1] - 37 / 3) < 1e-9


def test_two_exclusions_become_one_value(spark):
    spec = fm.normalise_spec(FORM, fm.Spec(filters={"ward": {"not": ["A", "b"]}}))
    assert spec.filters == {"ward": ["C"]}
    assert fm.normalise_spec(FORM, fm.Spec(filters={"ward": {"not": ["A"]}})).filters == {"ward": {"not": ["A"]}}


def test_spec_errors_and_phrases(spark):
    with pytest.raises(fm.SpecError):
        fm.run_form(claims(spark), FORM, fm.Spec(measures=["sum:ward"]))
    got = fm.run_form(claims(spark), FORM, fm.Spec(measures=["rows"], date={"column": "day", "text": "this month"}), as_of="2025-11-18").first()
    assert got.rows == 3


def test_plan_refuses_meaningless_steps(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for bad in (lambda: st.derive(df, "percent", "a", "a", "c"), lambda: st.derive(df, "ratio", "a", "b", "a"), lambda: st.derive(df, "percent", "a", "b", "c", ["a"]),
                lambda: st.group(df, ["a"], [("sum", "b", "s")], unique=["a"])):
        with pytest.raises(st.PlanError):
            bad()


def test_saved_parameters():
    p = {"s": Param("choice", options=("Open", "Paid")), "n": Param("number", 5), "d": Param("date")}
    assert bind(p, {"s": "open"}) == {"s": "Open", "n": 5.0, "d": None}
    with pytest.raises(ValueError):
        bind(p, {"x": 1})


DOCS = [(1, "border effects notes", "Border-effects matter.\nThe adivasi villages, trees."), (2, "plain", "effects at the border\nnothing"), (3, "other", "adivasis and tree lines; border effect border effects")]


def test_search_rules(spark):
    files = spark.createDataFrame([(d, n) for d, n, _ in DOCS], "doc int, name string")
    pages = spark.createDataFrame([(d, i + 1, t) for d, _, x in DOCS for i, t in enumerate(x.split("\n"))], "doc int, page int, text string")
    queries = spark.createDataFrame([(1, "border effects"), (2, '"border effects"'), (3, "the adivasis"), (4, "trees villages,"), (5, "absent")], "q int, query string")
    got = {}
    for r in S.search(files, pages, queries, "doc").collect():
        got.setdefault(r.q, {})[r.doc] = (r.phrase_hits, round(r.score, 6))
    assert {q: set(d) for q, d in got.items()} == {1: {1, 2, 3}, 2: {1, 3}, 3: {1, 3}, 4: {1}}
    assert got[1][3][0] == 2 and got[1][1][0] == 1 and got[1][2][0] == 0
    idf = round(math.log(1 + 3 / (1 + 2)), 3)
    assert got[3][1][1] == round(idf * math.log(2), 6)


def test_bm25_formula(spark):
    chunks = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "c c c c")], "id int, t string")
    got = {r.id: r.score for r in S.bm25(chunks, ["id"], "t", spark.createDataFrame([(1, "a c")], "q int, query string")).collect()}
    n, avg = 3, (5 + 3 + 7) / 3

    def part(f, df, size):
        return math.log(1 + (n - df + .5) / (df + .5)) * f * 2.2 / (f + 1.2 * (1 - .75 + .75 * size / avg))
    assert abs(got[1] - part(2, 1, 5)) < 1e-6 and abs(got[3] - part(4, 2, 7)) < 1e-6 and abs(got[2] - part(1, 2, 3)) < 1e-6


def test_line_chunks(spark):
    text = "h1,h2\n" + "".join(f"row {i},x\n" for i in range(30))
    got = [r.chunk for r in S.line_chunks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t", 100, F.lit(True)).orderBy("part").collect()]
    assert all(c.startswith("h1,h2\n") for c in got) and "".join(re.sub("^h1,h2\n", "", c) if i else c for i, c in enumerate(got)) == text


def test_find_files(spark):
    files = spark.createDataFrame([(1, "field_vars_indicators.xlsx", "Monitoring", "", "sheet", None), (2, "Budget 2024", "Finance", "rent salaries", "sheet", None), (3, "Photos", "Misc", "", "folder", None)],
                                  "id int, name string, path string, contents string, kind string, modified date")
    q = spark.createDataFrame([(1, "fieldvars indicators"), (2, "budgt 2024"), (3, "salaries"), (4, "zzzz")], "q int, query string").withColumns({"lo": F.lit(None).cast("date"), "hi": F.lit(None).cast("date"), "want": F.lit(None).cast("string")})
    got = {r.q: (r.id, r.score, r.status) for r in S.find_files(files, q).filter("place = 1").collect()}
    assert got[1] == (1, 0.98, "found") and got[2][0] == 2 and got[2][2] == "found" and got[3] == (2, 0.7, "found") and 4 not in got


def test_select_files_skips_what_does_not_fit(spark):
    s = spark.createDataFrame([(1, "a", 9.0, 50), (1, "b", 8.0, 80), (1, "c", 7.0, 40), (1, "d", 6.0, 10)], "q int, file string, score double, bytes int")
    assert [r.file for r in S.select_files(s, 6, 100).orderBy("place").collect()] == ["a", "c", "d"]


def test_fixes(spark):
    rows = [("number", "1O5", "105"), ("number", "approx 500", "500"), ("number", "n/a", ""), ("number", "10 or 20", None), ("number", "~1500?", "1500"), ("number", "~1,500?", None), ("number", "40+", "40"), ("number", "12 kg", "12"), ("number", "about -5", "-5"), ("number", "x7y", None), ("date", "99999", None), ("not_future", "13/12/2025", None), ("date", "45000", "15/03/2023"), ("date", "2024-03-05", "05/03/2024"),
            ("date", "TBD", ""), ("email", "a b@x.org.", "ab@x.org"), ("phone", "+91 98765 43210", "9876543210"), ("not_future", "05/12/2025", "12/05/2025")]
    found = spark.createDataFrame([(i, "c", v, r, "") for i, (r, v, _) in enumerate(rows)], "row_no int, column string, value string, rule string, message string")
    got = {r.row_no: r.fix for r in Q.suggest_fix(found, None, F.lit("2025-11-18").cast("date")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(rows)}


def test_contract_and_grounding(spark):
    df = spark.createDataFrame([("A", "x"), ("Z", "y")] * 3, "ward string, title_amount string")
    f = Q.contract(df, {"columns": {"Ward": "category", "Amount": "number", "Day": "date"}, "values": {"Ward": ["a"]}}, used=["Day"])
    assert {(r["what"], r["name"]) for r in f.collect()} == {("missing column", "Day"), ("renamed column", "Amount"), ("parse rate", "title_amount"), ("new value", "ward")}
    assert Q.status(f).first().status == "drift"
    t = spark.createDataFrame([(1, "1. There are 12 farms, two wells and 7 cows.")], "k int, t string")
    a = spark.createDataFrame([(1, 12.0), (1, 2.0)], "k int, value double")
    assert [r.value for r in Q.ungrounded_numbers(t, "k", "t", a).collect()] == [7.0]


def test_results_match(spark):
    a = spark.createDataFrame([("A", "2024-01-05", 10.0), ("B", "2024-01-06", 5.0)], "k string, d string, v double")
    b = spark.createDataFrame([("b ", "06/01/2024", "Rs. 5"), (" a", "5 Jan 2024", "10.00")], "k string, d string, v string")
    assert Q.results_match(a, b, ["k", "d"], ["v"]).count() == 0
    assert Q.results_match(a, b.filter("v <> '10.00'"), ["k", "d"], ["v"]).count() == 1


def test_choice_decision(spark):
    rows = [([("a", 0.5), ("b", 0.45)],), ([("a", 0.4), ("b", 0.3)],), ([("a", 0.42), ("b", 0.2)],)]
    df = spark.createDataFrame(rows, "s array<struct<answer:string,score:double>>")
    assert [r.x for r in df.select(L.decide_choice(F.col("s")).alias("x")).collect()] == ["a", "unsure", "a"]


def test_safe_cut():
    assert safe_cut("hello NAME_0") == 6 and safe_cut("hello") == 5 and safe_cut("see NAME") == 4 and safe_cut("see NAME_001 ok") == 15 and safe_cut("I") == 0


def test_map_parts_reads_whole_texts(spark):
    long = "é\n😀x" * 25_001
    docs = spark.createDataFrame([(1, long), (2, ""), (3, "y" * 7000), (4, "z" * 7001)], "k long, text string")
    for most, want in ((None, {1: long, 2: "", 3: "y" * 7000, 4: "z" * 7001}), (35_000, {1: long[:35_000], 2: "", 3: "y" * 7000, 4: "z" * 7001})):
        got, new = L.map_parts(docs, "k", "text", lambda s: s, lambda a: F.concat_ws("|", a), most=most)
        assert {r.k: r.result for r in got.collect()} == {k: "|".join(v[i:i + 7000] for i in range(0, max(len(v), 1), 7000)) for k, v in want.items()}
    whole, _ = L.map_parts(docs, "k", "text", lambda s: s, lambda a: F.concat_ws("", a))
    assert {r.k: r.result for r in whole.collect()}[1] == long
