"""Packing by all tasks, exact best matches, containment, query blocks, sifted similarity candidates, relabelling."""
import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import similarity as SIM
from gridloom.operators import fill, labels as L, match as M, profile as P, search as S
from gridloom.sources import files as FS, records as R


def texts(seed):
    rng = random.Random(seed)
    out = ["", "\n", "a", "x" * 500, "\n" * 300, None]
    for _ in range(25):
        out.append("".join("y" * rng.choice([0, 1, 5, 40, 95, 100, 101, 250]) + rng.choice(["\n", "\n\n", "\r\n", "\r", " \x0b", "\x85", " "]) for _ in range(rng.randint(0, 120))))
    return list(enumerate(out))


@pytest.mark.parametrize("stretch", [1 << 20, 150])
def test_pages_and_chunks_are_the_same_either_way(spark, monkeypatch, stretch):
    monkeypatch.setattr(fill, "STRETCH", stretch)
    monkeypatch.setattr(fill.filled, "__defaults__", (False, 0, stretch))
    df = spark.createDataFrame(texts(stretch), "id int, t string")
    rows = lambda out: sorted(map(tuple, out.collect()))
    assert rows(R.to_pages(df, "id", "t", 100, long=0)) == rows(R.to_pages(df, "id", "t", 100))
    csv = F.col("id") % 2 == 0
    assert rows(S.line_chunks(df, "id", "t", 100, csv, long=0)) == rows(S.line_chunks(df, "id", "t", 100, csv))


def test_one_long_text_is_spread_over_stretches(spark):
    lines = spark.range(20_000).select(F.lit(7).cast("long").alias("row"), F.col("id").alias("pos"), F.repeat(F.lit("z"), (F.col("id") % 9 + 1).cast("int")).alias("line"))
    got = fill.filled(lines, 100, stretch=1000).orderBy("page").collect()
    held, want = "", []
    for i in range(20_000):
        line = "z" * (i % 9 + 1)
        if held and len(held) + len(line) > 100:
            want.append(held)
            held = ""
        held += line
    assert [r.text for r in got] == [*want, held] and [r.page for r in got] == list(range(len(want) + 1))


def test_best_row_matches_are_exact(spark):
    rng = random.Random(3)
    words = ["red bolt", "blue nut", "12.50", "900", "gizmo", "zz", ""]
    truth = [(d, rng.choice(words), rng.choice(words)) for d in "ab" for _ in range(12)] + [("a", None, "q7"), ("c", "only", "here")]
    got = [(d, "".join(rng.sample(w, len(w))) if rng.random() < .4 else w, rng.choice(words)) for d in "ab" for w in rng.choices(words, k=9)] + [("c", "ëëë", "###")]
    schema = "doc string, x string, y string"
    out = {r.doc: r.similarity for r in L.row_match_eval(spark.createDataFrame(truth, schema), spark.createDataFrame(got, schema), "doc", ["x", "y"]).collect()}
    line = lambda r: " ".join((v or "").strip().lower() for v in r[1:])
    for d in "abc":
        best = [max(difflib.SequenceMatcher(None, line(t), line(g)).ratio() for g in got if g[0] == d) for t in truth if t[0] == d]
        assert abs(out[d] - sum(best) / len(best)) < 1e-9


def test_containment(spark):
    rng = random.Random(5)
    make = lambda: "".join(rng.choices("abcé", k=rng.randint(0, 6)))
    a, b = [make() for _ in range(60)], [make() + make() for _ in range(60)]
    one = lambda v: spark.createDataFrame([(x,) for x in v], "s string")
    for size in (1, 2, 3):
        got = {tuple(r) for r in M.contained(one(a), one(b), size).collect()}
        assert got == {(x, y) for x in a for y in b if x and x in y}
    assert M.contained(one([]), one(b)).count() == 0 and M.contained(one(a), one([])).count() == 0


def test_values_meant(spark):
    known = ["Yerawada Ward", "Kothrud Ward", "Hadapsar", "Aundh Gaon"]
    said = [" yerawada ward", "kothrud", "near Hadapsar today", "ward", "yearwada", "Hadapsr", "Aundh village", "zzz", "", None]
    got = {r.value: (r.matched, r.how) for r in M.match_value(spark.createDataFrame([(s,) for s in said], "s string"), "s", spark.createDataFrame([(k,) for k in known], "k string"), "k").collect()}
    assert got == {" yerawada ward": ("Yerawada Ward", "same"), "kothrud": ("Kothrud Ward", "contained"), "near Hadapsar today": ("Hadapsar", "contained"), "ward": (None, None) if got["ward"][0] is None else got["ward"],
                   "yearwada": ("Yerawada Ward", "close first word"), "Hadapsr": ("Hadapsar", "close"), "Aundh village": ("Aundh Gaon", "word close to first word"), "zzz": (None, None), "": (None, None)}


@pytest.mark.parametrize("sent", [0, 8 << 20])
def test_any_number_of_query_vectors(spark, monkeypatch, sent):
    monkeypatch.setattr(S, "SENT_BYTES", sent)
    monkeypatch.setattr(S, "QUERY_ROWS", 7)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(40, 6)), rng.normal(size=(5000, 6))
    chunks = spark.createDataFrame([(i, i % 5, v.tolist()) for i, v in enumerate(x)] + [(99, 0, [1.0, 2.0]), (98, 0, None)], "file int, chunk int, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(9999, None), (9998, [2.0, 4.0])], "q int, vec array<double>")
    got = {(r.q, r.file): r.score for r in S.vector_scores(chunks, ["file", "chunk"], "vec", queries, 0.9).collect()}
    cos = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    want = {(int(i), int(j)): round(float(cos[i, j]), 12) for i, j in zip(*np.nonzero(cos >= 0.9))}
    assert got.pop((9998, 99)) == 1.0 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 50


def names(n, seed):
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(c) for c in rng.choice([("bdgkmnprst", "aeiou") * 2, ("bdgkmnprst", "aeiou", "lnrs") * 2, ("aeiou", "lnrs", "bdgk", "aeiou", "ns")]))
    return sorted({f"{part()} {part()}" for _ in range(n)})


@pytest.mark.parametrize("kind,floor,most", [("jaro_winkler", 0.9, 0.05), ("ratio", 0.86, 0.05), ("ratio", 0.75, 0.15)])
def test_candidates_are_few_and_none_is_lost(spark, kind, floor, most):
    a, b = names(500, 1), names(500, 2)
    rng = random.Random(3)
    b += [w[:i] + rng.choice("aeiou") + w[i + rng.randint(0, 1):] for w in a[:80] for i in [rng.randrange(len(w))]]
    one = lambda v: spark.createDataFrame([(x,) for x in v], "s string")
    met = {tuple(r) for r in M.candidate_pairs(one(a), one(b), kind, floor).collect()}
    score = SIM.jaro_winkler_pair if kind == "jaro_winkler" else lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    want = {(x, y) for x in a for y in b if round(score(x, y), 12) >= floor}
    assert want <= met and len(want) > 60 and len(met) < most * len(a) * len(b)


def test_labels_are_one_per_record(spark):
    recs = spark.createDataFrame([(1, "yes now"), (2, "same"), (3, "fails"), (4, "new")], "id int, t string")
    sha = lambda s: F.sha2(F.lit(s), 256)
    old = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(i).alias("record_id"), F.lit(n).alias("name"), F.lit(v).alias("version"), F.lit("no").alias("label"), h.alias("source_hash"))
                                                    for i, n, v, h in ((1, "d", 1, sha("before")), (2, "d", 1, sha("same")), (3, "d", 1, sha("worked once")), (3, "d", 0, sha("x")), (1, "e", 1, sha("x")), (9, "d", 1, sha("gone")))])).alias("r")).select("r.*")
    scorer = lambda s: s.map(lambda v: None if v == "fails" else "yes" if v.startswith("yes") else "maybe")
    got = sorted(tuple(r) for r in L.relabel(recs, "id", "t", old, "d", 1, ["yes", "no"], scorer).select("record_id", "name", "version", "label").collect())
    assert got == [(1, "d", 1, "yes"), (1, "e", 1, "no"), (2, "d", 1, "no"), (3, "d", 0, "no"), (4, "d", 1, "unsure"), (9, "d", 1, "no")]


def test_leaks_of_artefacts_and_masked_rows(spark):
    v = spark.createDataFrame([("Asha Rao",), ("98765",), ("abc",)], "value string")
    a = spark.createDataFrame([(1, "for ASHA RAO, 98765x"), (2, "abc"), (3, None)], "id int, text string")
    assert sorted(map(tuple, P.artefact_leaks(a, v).collect())) == [(1, "98765"), (1, "Asha Rao")]
    assert len(P.artefact_leaks(a, v, first=1).collect()) == 1
    codes = spark.createDataFrame([("asha rao", "NAME_001")], "norm string, code string")
    got = P.masked_rows(spark.createDataFrame([(2, "x"), (1, "Asha  Rao"), (3, None)], "k int, n string"), ["k", "n"], codes, [F.col("k")], 2)
    assert sorted(map(tuple, got.collect())) == [("1", "NAME_001"), ("2", "x")]


def test_kinds_of_a_listing(spark):
    rows = [(1, "a.pdf", "application/vnd.google-apps.folder"), (2, "a.pdf", None), (3, "b", "image/png"), (4, "c.csv", "application/octet-stream"), (5, None, None)]
    got = {r.id: r.kind for r in FS.catalog_of(spark.createDataFrame(rows, "id int, name string, mime string")).collect()}
    assert got == {1: "folder", 2: "pdf", 3: "image", 4: "sheet", 5: "other"}


def csv_rows(text):
    """Records as the reader defines them: a quote opens a cell only at its beginning."""
    rows, cell, row, inside, at, i = [], "", [], False, True, 0
    while i < len(text):
        ch = text[i]
        if inside:
            if ch == '"' and text[i + 1:i + 2] == '"':
                cell, i = cell + '""', i + 1
            elif ch == '"':
                inside, cell = False, cell + ch
            else:
                cell += ch
        elif ch == '"' and at:
            inside, cell = True, cell + ch
        elif ch == ",":
            row.append(cell)
            cell = ""
        elif ch == "\n":
            rows.append([*row, cell])
            row, cell = [], ""
        else:
            cell += ch
        at = not inside and ch in ",\n"
        i += 1
    if cell or row:
        rows.append([*row, cell])
    return [[c[1:-1].replace('""', '"') if len(c) >= 2 and c[0] == '"' and c[-1] == '"' else c for c in r] for r in rows]


@pytest.mark.parametrize("bytes_", ["128m", "64b"])
def test_grids_however_they_are_split(spark, tmp_path, bytes_):
    rng = random.Random(9)
    texts = {}
    for f in range(6):
        cells = ['"', '""', "a", "b c", '"x"', '"y\nz"', '"q""r"', '5" pipe', '"two\n\nlines, here"', "", "é"]
        cells = [c for c in cells if c not in ('"', '""')] if f else ['"x"', "a", '5" pipe', "5\" x\"", '"m\nn"']
        texts[f] = "\n".join(",".join(rng.choices(cells, k=rng.randint(1, 4))) for _ in range(60)) + "\n"
        (tmp_path / f"f{f}.csv").write_text(texts[f])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = FS.read_grid(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for f, text in texts.items():
        own = sorted((r.row_no, r.cells) for r in got if r.file.endswith(f"f{f}.csv"))
        assert [c for _, c in own] == csv_rows(text) and [n for n, _ in own] == list(range(len(own)))


def test_a_stray_quote_gathers_no_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"1\n2"\n' + '"stray,1\n' + "".join(f"r{i},2\n" for i in range(50)) + 'end",3\nlast,"a\nb"\n')
    got = sorted((r.row_no, r.cells) for r in FS.read_grid(spark, str(tmp_path), longest=20).collect())
    assert len(got) == 1 + 52 + 1 and got[0] == (0, ["x", "1\n2"]) and got[1] == (1, ['"stray', "1"]) and got[5] == (5, ["r3", "2"])
    assert got[-2] == (52, ['end"', "3"]) and got[-1] == (53, ["last", "a\nb"])
    plan = FS.read_grid(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


@pytest.mark.parametrize("axis", [10_000, 3])
def test_grids_of_any_width(spark, monkeypatch, axis):
    from gridloom.operators import joins as J
    monkeypatch.setattr(J, "SHORT_AXIS", axis)
    df = spark.createDataFrame([(i % 4, i % 11, i) for i in range(30)], "a int, b int, v int")
    got = {(r.a, r.b): r.n for r in J.complete_grid(df, "a", "b", F.count("*"), "n").collect()}
    assert len(got) == 44 and sum(got.values()) == 30 and got[0, 0] == sum(1 for i in range(30) if i % 4 == 0 and i % 11 == 0)


def test_threads_with_equal_dates_have_one_result(spark):
    from gridloom.operators import aggregate as A
    rows = [("t", "2026-01-01", s, p, d) for s, p, d in (("b", "zoe", "in"), ("a", "amy", "out"), ("c", "zoe", "out"))] + [("t", None, "0", "zzz", "in")]
    df = spark.createDataFrame([(*r, False, False, False) for r in rows], "thread_id string, date string, subject string, person string, direction string, is_unread boolean, is_bulk boolean, is_notice boolean")
    for n in (1, 3):
        r = A.threads(df.repartition(n, "subject")).first()
        assert (r.subject, r.last_from, r.last_direction, r.messages) == ("a", "zoe", "out", 4)
