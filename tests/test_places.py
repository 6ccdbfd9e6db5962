"""Known values in texts: words, links, numbers, borders, and that one scan finds what a plain search finds."""
import random
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import places as P, vault as V
from gridloom.session import cut

VAULT = "norm string, value string, class string, prefix string, number int, code string"


def vault(spark, values):
    return cut(spark.createDataFrame([(v.lower(), v, "x", "X", i, f"X_{i:03d}") for i, v in enumerate(values, 1)], VAULT))


def redacted(spark, values, *texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r.redacted for r in V.redact(docs, "id", "t", vault(spark, values), **options).orderBy("id").collect()]


def test_links(spark):
    got = redacted(spark, ["Satpur Kamil", "Zoë Ray", "O'Neil", "Rao-Singh"],
                   "http://w.org/wiki/Satpur_Kamil#x", "https://w.org/?q=satpur+kamil&r=Satpur%20Kamil", "https://w.org/Satpur-Kamilx/xSatpur-Kamil", "Satpur_Kamil outside",
                   "https://w.org/Zo%C3%AB_Ray/%zz", "http://w.org/O%27Neil and O'Neil", "http://w.org/rao%2Dsingh", "(http://w.org/Satpur_Kamil)Satpur Kamil", None)
    assert got == ["http://w.org/wiki/X_001#x", "https://w.org/?q=X_001&r=X_001", "https://w.org/Satpur-Kamilx/xSatpur-Kamil", "Satpur_Kamil outside",
                   "https://w.org/X_002/%zz", "http://w.org/X_003 and X_003", "http://w.org/X_004", "(http://w.org/X_001)X_001", None]


def test_numbers(spark):
    got = redacted(spark, ["73.7354", "1250.5", "-8001.25", "40312", "1998", "52", "92.6%", "0.0071"],
                   "at 73.73540, 73.7354. and 73.735400", "73.73541 173.7354 73.7354.2 x73.7354", "paid 1250.50 not 1250.55; -1250.5", "-8001.25 or 8001.25", "40312, 040312 403120 a40312 40312a 40312.0", "1998 52 92.6%", "0.00710 .0071")
    assert got == ["at X_001, X_001. and X_001", "73.73541 173.7354 73.7354.2 x73.7354", "paid X_002 not 1250.55; -X_002", "X_003 or 8001.25", "X_004, 040312 403120 a40312 40312a 40312.0", "1998 52 92.6%", "X_008 .0071"]


def test_words_and_borders(spark):
    got = redacted(spark, ["Asha Rao", "(Li)", "नमस्ते राम", "Rao", "mini"], "asha \n RAO, Rao; raop Rao@x.org x.Rao Rao.x Rao.", "(Li) Li a(Li)", "तो नमस्ते राम है", "Mini and mini", "", never=["Mini"])
    assert got == ["X_001, X_004; raop Rao@x.org x.Rao Rao.x X_004.", "X_002 Li a(Li)", "तो X_003 है", "Mini and mini", ""]


def test_leaks_see_links_and_numbers(spark):
    docs = spark.createDataFrame([(1, r'{"u": "http:\/\/w.org\/Satpur_Kamil"}'), (2, "73.73540"), (3, "X_001 and 73.7")], "id int, t string")
    assert {(r.id, r.code) for r in V.leaks(docs, "id", "t", vault(spark, ["Satpur Kamil", "73.7354"])).collect()} == {(1, "X_001"), (2, "X_002")}


@pytest.mark.parametrize("full", [False, True])
def test_one_scan_finds_what_a_plain_search_finds(spark, monkeypatch, full):
    if full:  # bitmaps that let everything pass change nothing but the work
        monkeypatch.setattr(P, "_sieve", lambda df, column: ~P._ZERO)
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdé" for b in ("", "x", "Q", "1")]
    values = sorted({" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)})
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", ", ", ". ", "-", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (99, None)], "id int, t string")
    got = {tuple(r) for r in P.known_places(docs.repartition(3), "id", "t", vault(spark, values)).collect()}
    want = set()
    for i, t in [*enumerate(texts), (None, texts[0])]:
        for n, v in enumerate(values, 1):
            for m in re.finditer(r"(?<!\w)(?=(" + r"\s+".join(map(re.escape, v.split())) + r")(?!\w))", t, re.I):
                before, after = re.search(r"\W*$", t[:m.start(1)]).group(), re.match(r"\W*", t[m.end(1):]).group()
                more = bool(re.search(r"\w", t[m.end(1):]))
                if P._boundary(before, after, more):
                    want.add((i, m.start(1), m.end(1), f"X_{n:03d}"))
    assert got == want and len(want) > 300


def test_no_word_is_shuffled(spark):
    docs = spark.createDataFrame([(i, "nothing known here " * 50 + ("Asha Rao" if i == 3 else "")) for i in range(200)], "id int, t string")
    found = P.known_places(docs, "id", "t", vault(spark, ["Asha Rao"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and found.count() == 1


def test_mixed_columns(spark):
    df = spark.createDataFrame([(1, "a@x.org", "b"), (2, "98765 43210", "c"), (3, "9876543210", None), (4, "Asha", "a@x.org"), (5, " ", "x"), (6, None, "y")], "id int, c string, n string")
    classes = {"c": ["person_name", "email", "phone"], "n": ["free_text_with_pii", "email"], "id": None}
    v = cut(V.build_vault(V.cells(df, "id", V.direct_columns(classes))))
    got = {r.id: (r.c, r.n) for r in V.pseudonymise(df, "id", classes, v).collect()}
    assert got == {1: ("EMAIL_001", "b"), 2: ("NAME_001", "c"), 3: ("PHONE_001", None), 4: ("NAME_002", "EMAIL_001"), 5: (" ", "x"), 6: (None, "y")}
    assert {r["class"] for r in v.collect()} == {"email", "phone", "person_name"}


def bitmap(places):
    out = P._ZERO.copy()
    for x in places:
        out[x >> 6] |= P.np.uint64(1 << (x & 63))
    return out


def scanned(values, texts):
    batch = P.pa.RecordBatch.from_pydict({"value": values, "code": [f"X_{i}" for i in range(len(values))]})
    forms = [r for b in P.needle_rows(iter([batch])) for r in b.to_pylist()]
    sizes = [sorted({r["size"] for r in forms if r["kind"] == k}) for k in "wu"]
    rows = P._place_rows(bitmap(r["head"] for r in forms), bitmap(r["bit"] for r in forms), bitmap(x for r in forms for x in r["begun"]), *sizes)
    docs = P.pa.RecordBatch.from_pydict({"_k": range(len(texts)), "_t": P.pa.array(texts, P.pa.string())})
    known = {(r["kind"], r["form"]) for r in forms}
    return [(r["_k"], r["start"], r["end"]) for b in rows(iter([docs])) for r in b.to_pylist() if (r["kind"], r["form"]) in known]


def test_a_common_first_word_costs_no_form(monkeypatch):
    made = []
    spaced = P._spaced
    monkeypatch.setattr(P, "_spaced", lambda text: made.append(text) or spaced(text))
    values = ["the.22@mail9.example.com", "the one and only", "a " * 30 + "end"]
    texts = ["the cat and the dog. a a a " * 500, "by The.22@mail9.example.com", "THE one  and\nonly one", "a " * 31 + "end", "a " * 30 + "End", None]
    made.clear()
    assert sorted(scanned(values, texts)) == [(1, 3, 27), (2, 0, 17), (3, 2, 65), (4, 0, 63)]
    assert len(made) < 200  # the first text alone has 2,500 places where a value's first word stands


def test_lower_case_that_depends_on_its_place_is_found(spark):
    values, texts = ["Rao İnci Bey", "Α ΟΔΟΣ", "No Ⅻ end", "x y ẞ"], ["rao i̇nci bey", "RAO İNCI BEY", "α οδος", "α οδοσ.", "no ⅻ END", "X Y ß"]
    got = redacted(spark, values, *texts)
    assert got == ["X_001", "X_001", "X_002", texts[3], "X_003", "X_004"]
