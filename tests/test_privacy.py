"""Detection rules, vault invariants, restore(redact(x)) = x, no leaks."""
from pyspark.sql import functions as F

from gridloom.functions.checks import VERHOEFF_MULTIPLY, VERHOEFF_PERMUTE
from gridloom.operators import detect as D
from gridloom.operators import policy as P
from gridloom.operators import vault as V
from gridloom.session import cut


def check_digit_ok(digits):
    state = 0
    for place, ch in enumerate(digits[::-1]):
        state = int(VERHOEFF_MULTIPLY[state][int(VERHOEFF_PERMUTE[place % 8][int(ch)])])
    return state == 0


def aadhaar(prefix="23456789012"):
    return next(prefix + str(d) for d in range(10) if check_digit_ok(prefix + str(d)))


def spans_of(spark, text, kind="text", **options):
    df = spark.createDataFrame([(text,)], "text string")
    return [tuple(s) for s in df.select(D.detector(kind, **options)(F.col("text")).alias("s")).first().s]


def test_validators(spark):
    text = f"mail a.b@x.org, id {aadhaar()}, PAN ABCPK1234L, IFSC SBIN0001234, pay ravi@okaxis, call +91 98765 43210, car MH12AB1234, at 18.52, 73.85 on 2001-02-03"
    labels = {s[2] for s in spans_of(spark, text, "regex")}
    assert {"email", "aadhaar", "pan", "ifsc", "upi_id", "phone", "vehicle_number", "gps", "dob"} <= labels
    wrong = next(f"23456789012{d}" for d in range(10) if not check_digit_ok(f"23456789012{d}"))
    assert not [s for s in spans_of(spark, f"id {wrong} x, at 98.52, 73.85", "regex") if s[2] in ("aadhaar", "gps")]
    assert spans_of(spark, None) == spans_of(spark, "") == []


def test_prose_dates_need_a_birth_word(spark):
    spans = spans_of(spark, "Visited 03/04/2020. " + "x " * 40 + "Born 05/06/1999.")
    assert [s[0] for s in spans if s[2] == "dob"] == [105]


def test_names_spread_in_their_text(spark):
    text = "12/03/24, 9:16 - Asha Patil: hi\nasha patil said so"
    found = {(s[0], s[1]) for s in spans_of(spark, text) if s[2] == "person_name"}
    assert (32, 42) in found


def test_headings_and_a_batch_model(spark):
    @F.pandas_udf(D.SPAN)
    def model(s):
        return s.map(lambda v: [{"start": 0, "end": 4, "label": "person_name", "score": 0.5}, {"start": 5, "end": 9, "label": "person_name", "score": 0.9}])
    text = "Asha Ravi went. Full Name: 'Meera K' ; asha and ravi; meera k"
    got = spans_of(spark, text, headings={"Name": "village", "Full Name": "person_name"}, model=model)
    assert [(text[a:b], k, c) for a, b, k, c in got if c == 1.0] == [("Meera K", "person_name", 1.0)]
    assert sorted(text[a:b] for a, b, _, c in got if c == 0.9 and a > 9) == ["Meera K", "meera k", "ravi"]


def test_resolution_prefers_the_longest_from_the_left():
    assert D.resolve([(0, 4, "a", 1.0), (0, 9, "b", 1.0), (5, 12, "c", 1.0), (9, 11, "d", 1.0)]) == [(0, 9, "b", 1.0), (9, 11, "d", 1.0)]


def vault(spark, values):
    return cut(V.build_vault(spark.createDataFrame([(v, c, i) for i, (v, c) in enumerate(values)], "value string, class string, pos int")))


KNOWN = [("Asha Patil", "person_name"), ("Patil", "person_name"), ("+91 98765 43210", "phone"), ("asha  PATIL", "village"), ("NAME_009", "person_name"), ("Yerawada Ward", "village")]


def test_vault_is_unique_and_first_class_wins(spark):
    v = vault(spark, KNOWN)
    rows = {r.norm: (r.code, r["class"]) for r in v.collect()}
    assert rows["asha patil"] == ("NAME_001", "person_name") and "name_009" not in rows and rows["patil"][0] == "NAME_002"
    more = V.build_vault(spark.createDataFrame([("ASHA PATIL", "person_name", 1), ("Ravi", "person_name", 2)], "value string, class string, pos int"), v)
    assert [(r.norm, r.code) for r in more.collect()] == [("ravi", "NAME_003")]


def test_redact_and_restore(spark):
    v = vault(spark, KNOWN)
    texts = [(1, "(Asha Patil), then patil; call +91 98765 43210."), (2, "mail patil@x.org or see x.Patil"), (3, "nothing here"), (4, "Patilwadi is a place"), (5, "yerawada ward, Asha Patil")]
    docs = spark.createDataFrame(texts, "id int, t string")
    out = cut(V.redact(docs, "id", "t", v))
    got = {r.id: r.redacted for r in out.collect()}
    assert got == {1: "(NAME_001), then NAME_002; call PHONE_001.", 2: texts[1][1], 3: texts[2][1], 4: texts[3][1], 5: "PLACE_001, NAME_001"}
    assert V.leaks(out, "id", "redacted", v).count() == 0
    back = {r.id: r.restored for r in V.restore(out.select("id", "redacted"), "id", "redacted", v).collect()}
    assert {k: x.lower() for k, x in back.items()} == {i: t.lower() for i, t in texts}


def test_escaped_and_unknown_codes(spark):
    v = vault(spark, KNOWN)
    docs = spark.createDataFrame([(1, r"see NAME\_001 and NAME_777, \nNAME_002")], "id int, t string")
    assert V.restore(docs, "id", "t", v).first().restored == r"see Asha Patil and NAME_777, \nPatil"


def test_shelter_hides_values_that_touch_words(spark):
    docs = spark.createDataFrame([(1, "Tel123456789012.Call"), (2, "mail a.b@x.org."), (3, "again A.B@x.org here")], "id int, t string")
    out, v = V.shelter(docs, "id", "t")
    got = {r.id: r.redacted for r in out.collect()}
    assert got == {1: "TelNUMBER_001.Call", 2: "mail EMAIL_001.", 3: "again EMAIL_001 here"}


def test_near_values(spark):
    v = vault(spark, [("Yerawada Ward", "village"), ("Kolhapur", "village")])
    docs = spark.createDataFrame([(1, "from Yerwada today"), (2, "in Kolhapurr city"), (3, "nothing near")], "id int, t string")
    got = {r.id: r.redacted for r in V.redact_near(docs, "id", "t", v).collect()}
    assert got == {1: "from PLACE_001 today", 2: "in PLACE_002 city", 3: "nothing near"}


def test_classifier(spark):
    rows = [(f"Asha K. Patil{chr(97 + i % 26)}", f"9876{i:06d}", ["SC", "ST", "OBC"][i % 3], str(18 + i % 50), f"18.{520400 + i}") for i in range(80)]
    df = spark.createDataFrame(rows, "name string, mob string, cat string, age string, lat string")
    got = {r["column"]: r["class"] for r in P.classify_columns(df, df.columns).collect()}
    assert got["mob"] == "phone" and got["cat"] == "caste_category" and got["age"] == "age" and got["lat"] == "gps"


def test_matched_in_text(spark):
    vals = ["6", "92.6%", "2005", "1234", "18.5204", "Asha", " "]
    got = [r.m for r in spark.createDataFrame([(v,) for v in vals], "v string").select(P.matched_in_text(F.col("v")).alias("m")).collect()]
    assert got == [False, False, False, True, True, True, False]


def test_span_eval(spark):
    gold = spark.createDataFrame([("d", 0, 5, "phone"), ("d", 10, 15, "email")], "k string, start int, end int, label string")
    found = spark.createDataFrame([("d", 4, 8, "phone"), ("d", 20, 25, "phone")], "k string, start int, end int, label string")
    rows = {r.label: (r.recall, r.precision) for r in D.span_eval(gold, found, "k").collect()}
    assert rows["(all)"] == (0.5, 0.5) and rows["email"] == (0.0, None)


def test_a_model_reads_bounded_pieces(spark):
    import pandas as pd
    size = spark.sparkContext.accumulator(0)

    @F.pandas_udf(D.SPAN)
    def model(s):
        size.add(int((s.str.len() > 50).sum()))
        return pd.Series([[{"start": i, "end": min(i + 6, len(v)), "label": "x", "score": 1.0} for i in range(len(v)) if v.startswith("@", i)] for v in s])
    rows = [(1, "a" * 37 + "@bcdef" + "g" * 200 + "@hijkl" + "m" * 90 + "@no"), (2, "@short"), (3, ""), (4, None), (None, "@nobody")]
    got = D.model_spans(spark.createDataFrame(rows, "id int, t string"), "id", "t", model, size=50, overlap=10)
    assert sorted(map(repr, ((r.id, r.start, r.end) for r in got.collect()))) == sorted(map(repr, [(1, 37, 43), (1, 243, 249), (1, 339, 342), (2, 0, 6), (None, 0, 6)]))
    assert size.value == 0


def test_a_text_is_read_by_one_worker_once(spark):
    texts = spark.range(50).repartition(3).select("id", F.concat(F.lit("Call M. Rao at 98000"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("text"))
    found = D.exploded(D.detect(texts, "text", "text", clean=True), ["id"], "text")
    lines = D.scan_lines(texts, "id", "text")
    for df in (found, lines):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("EvalPython") == 1 and plan.index("EvalPython") < plan.index("Repartition"), plan
    assert found.count() == lines.count() == 100


def test_checks_of_one_value_are_those_of_columns(spark):
    values = [("aadhaar", aadhaar()), ("aadhaar", "2345 6789 0123"), ("aadhaar", "٣٤٥"), ("aadhaar", ""), ("gps", "12.50,\n77.25"), ("gps", "98.52, 73.85"), ("gps", "12.34, 77.12"),
              ("gps", "-89.99 , -180.00"), ("gps", "12.34, 180.01"), ("pan", "x")]
    df = spark.createDataFrame(values, "label string, value string")
    assert [bool(r[0]) for r in df.select(D.passes(F.col("label"), F.col("value"))).collect()] == [D.holds(*v) for v in values]
    assert D.born("was Born 1.") and D.born("जन्म 1") and not D.born("जन्मे 1") and not D.born("xborn") and not D.born("agedx") and D.born("(d.o.b 1")


def test_a_worker_splits_few_texts_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    from gridloom.operators import places
    monkeypatch.setattr(places, "SLICE", 100)
    texts = [None, "", "x" * 30, "y" * 250, *["z" * 40] * 6]
    cut_up = [p.column("t").to_pylist() for p in places.slices(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), "t")]
    assert [t for p in cut_up for t in p] == texts and max(len(p) for p in cut_up) <= 4
    assert not list(places.slices(pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())}), "t"))


def test_texts_are_worked_on_once(spark):
    vault = cut(V.build_vault(V.cells(spark.createDataFrame([(1, "Asha Devi"), (2, "Ravi K")], "k long, n string"), "k", {"n": "person_name"})))
    docs = spark.createDataFrame([(1, "met Asha Devi"), (2, "and ravi k."), (None, "Asha"), (3, None)], "k long, t string")
    done = V.redact(docs, "k", "t", vault)
    back = V.restore(done.select("k", F.col("redacted").alias("t")), "k", "t", vault)
    assert "MapInArrow" not in back._jdf.queryExecution().optimizedPlan().toString()  # the redaction is not in the plan twice, but cut before
    left = V.leaks(done, "k", "redacted", vault)
    assert "isnotnull(regexp_replace" not in left._jdf.queryExecution().optimizedPlan().toString().lower()
    assert left.count() == 0 and sorted(V.leaks(docs, "k", "t", vault).collect()) == [(1, "NAME_001", 1), (2, "NAME_002", 1)]


def test_a_detector_chosen_by_name_counts_what_it_finds(spark, tmp_path):
    from gridloom.queries import QUERIES
    texts = ["no. 1234 5678 9012 and 123456789", "call 98765 43210 or a@b.org", "nothing", "", None, "2001-02-03", "12345678"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["udf4_detector_choice"](spark, str(tmp_path)).collect())) == [("regex", 0), ("regex+digits", 3)]


def test_a_rule_finds_what_its_pattern_finds():
    import random
    import re
    rng = random.Random(8)
    pieces = ["a", "b.", "@", "@ybl", "@x.org", "@x.o", "ABCPK1234L", "SBIN0001234", "ABC1234567", "MH12AB1234", "MH 1 A 1234", "+91", "+", "0", "98765", "43210", " ", "-", ".", "/", "12", "2001-02-03",
              "1/2/99", "18.52", ", ", "73.85", "2345 6789 0123", "٣", "é", "_", "%", "\n", "A", "x@upi", ".."]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(4000)]
    starts = [([m.start() for m in re.finditer(r"\d+", t)], [m.start() for m in re.finditer("@", t)]) for t in texts]
    for rule in [*D.VALIDATORS, D.Rule("long_number", D.LONG_NUMBER, lead=0)]:
        assert rule.lead is not None
        find = D.matches(rule)
        assert [[m.span() for m in find(t, *at)] for t, at in zip(texts, starts)] == [[m.span() for m in re.finditer(rule.pattern, t)] for t in texts]


def test_only_texts_that_may_hold_codes_are_cleared_of_them(spark):
    known = vault(spark, KNOWN)
    texts = [(1, "plain Asha Patil"), (2, "NAME_001 and NAME\\_002, xPLACE_001"), (3, '{"a": "\\nPatil\\"", "b": "\\/Yerawada Ward"}'), (4, None), (5, "\\nNAME_001 Patil_NAME_001"), (6, "aNAME_001 is Patil")]
    found = V.leaks(spark.createDataFrame(texts, "id int, t string"), "id", "t", known)
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted((r.id, r.code) for r in found.collect()) == [(1, "NAME_001"), (1, "NAME_002"), (3, "NAME_002"), (3, "PLACE_001"), (6, "NAME_002")]
