"""Similarity joins lose no pair against brute force; matching rules."""
import difflib
import itertools
import random

import duckdb
from pyspark.sql import functions as F

from gridloom.functions import similarity as SIM
from gridloom.operators import joins as J
from gridloom.operators import match as M


def words(n, seed):
    r = random.Random(seed)
    base = ["martha", "dwayne", "pune district", "ahmednagar", "satara", "kolhapur", "new widget", "red bolt"]
    out = set()
    while len(out) < n:
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice("abcdefgh ")
        out.add("".join(w).strip())
    return sorted(out)


def test_jaro_winkler_equals_duckdb():
    con = duckdb.connect()
    for a, b in itertools.product(words(15, 1), words(15, 2)):
        assert abs(SIM.jaro_winkler_pair(a, b) - con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]) < 1e-9


def test_similar_pairs_are_complete(spark):
    left, right = words(60, 3), words(60, 4)
    for kind, floor, score in (("jaro_winkler", 0.9, SIM.jaro_winkler_pair), ("ratio", 0.86, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())):
        got = {(r.l, r.r) for r in M.similar_pairs(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "a string"), kind, floor).collect()}
        assert got == {(a, b) for a in left for b in right if round(score(a, b), 12) >= floor}


def test_place_needs_a_clear_lead(spark):
    ref = spark.createDataFrame([("Ahmednagar",), ("Satara",), ("Sattra",)], "p string")
    names = spark.createDataFrame([(1, "Ahmadnagar District"), (2, "satara"), (3, "Sattara"), (4, "Ahmednager")], "id int, n string")
    got = {r.id: r.matched for r in M.match_place(names, "n", ref, "p").collect()}
    assert got == {1: "Ahmednagar", 2: "Satara", 3: None, 4: "Ahmednagar"}


def test_variant_groups(spark):
    vals = ["Soyabean"] * 5 + ["soyabean", "Soya bean", "Soyabeaan", "Wheat", "wheat ", "Rice"]
    got = [r.members for r in M.variant_groups(spark.createDataFrame([(v,) for v in vals], "v string"), "v").collect()]
    assert got == ["Soyabean | Soya bean | Soyabeaan | soyabean", "Wheat | wheat "]


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)], "l string, r string")
    nodes = spark.createDataFrame([(f"n{i:02d}",) for i in range(31)] + [("z",)], "k string")
    got = {r.k: r.label for r in M.components(nodes, edges).collect()}
    assert got["n30"] == "n00" and got["z"] == "z"


def test_lookup_first_name_only_when_unique(spark):
    people = spark.createDataFrame([("Asha Rao", 1), ("Ravi Patil", 2), ("Ravi Rao", 3)], "name string, id int")
    rows = spark.createDataFrame([("asha",), ("ravi",), (" ravi  rao",), ("zed",)], "who string")
    got = {r.who: r.p_id for r in J.lookup(rows, people, ("who", "name"), ["id"], "p_", first_name=True).collect()}
    assert got == {"asha": 1, "ravi": None, " ravi  rao": 3, "zed": None}


def test_join_contract(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    good, dup = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert J.safe_join(a, good, ["k"]).count() == 3
    row = J.check_join(a, dup, ["k"], "many_to_one").first()
    assert (row.unmatched, row.right_duplicates, row.ok) == (2, 1, False)
    try:
        J.safe_join(a, dup, ["k"]).collect()
        raise AssertionError("contract not enforced")
    except Exception as e:  # noqa: BLE001
        assert "join contract broken" in str(e)


def test_overlap_join_reports_a_pair_once(spark):
    a = spark.createDataFrame([("d", 0, 1000), ("d", 2000, 2010)], "k string, start int, end int")
    b = spark.createDataFrame([("d", 500, 900), ("d", 1000, 1001)], "k string, start int, end int")
    assert J.overlap_join(a, b, "k", step=64).count() == 1


def test_anti_join_with_null_in_the_list(spark):
    a = spark.createDataFrame([("x",), ("y",)], "v string")
    b = spark.createDataFrame([(" X ",), (None,)], "w string")
    assert [r.v for r in J.members(a, "v", b, "w", negate=True).collect()] == ["y"]
