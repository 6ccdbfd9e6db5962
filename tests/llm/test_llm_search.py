"""Ranked lexical search and spelling variants against plain Python, on planted, awkward and empty tables."""
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import lexical, variants

DOCS = "doc_id long, text string, doc string, r string, q int, n long, term string, score double, word string, root int"
ITEMS = "item_id long, text string, q int, item string, terms long, floor int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, "t", 3.0, "w", 4) for r in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", 2, 3) for r in rows], ITEMS)


def listed(out):
    return sorted(map(repr, map(tuple, out.collect())))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "é", "7", "zz", "Q")] + ["ÉTÉ", "中文", "x_y"]
    rows = [(i if i % 19 else None, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(20)]
    rows += [(1000 + i, t + " tail") for i, (_, t) in enumerate(items[:6])] + [(2000 + i, items[0][1]) for i in range(40)]
    return rows, items


@pytest.mark.parametrize("first,broadcast", [(1, 0), (40, 8 << 20)])
def test_search_ranks_like_all_documents(spark, monkeypatch, first, broadcast):
    monkeypatch.setattr(lexical, "ASK_BYTES", broadcast)
    rows, items = corpus(3)
    rows += [(3000, None), (3001, ""), (3002, " \t-- "), (3003, "a " * 5000 + "zz7 b"), (3004, "solo"), rows[5], rows[5]]
    items += [(50, None), (51, "..."), (52, "nowhere"), (52, "nowhere a"), (None, "b C"), items[0], (53, " ".join(f"w{i} a" for i in range(3000)))]
    out = lexical.search(docs_of(spark, rows), items_of(spark, items), k=10, first=first)
    assert listed(out) == sorted(map(repr, brute.lexical(rows, items)))


def test_search_of_empty_tables(spark):
    rows, items = corpus(4, 5)
    assert lexical.search(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert lexical.search(docs_of(spark, rows), items_of(spark, [])).count() == 0


def test_bounds_are_never_below_scores_and_leave_few_documents():
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(rng.randint(20, 400))) for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"r": list(range(600)), "text": texts})
    got = [row for b in lexical._scan_rows(np.zeros(lexical.SIEVE >> 6, np.uint64))([batch]) for row in b.to_pylist()]
    rows = list(enumerate(texts))
    ask = texts[7].split()[:60]
    item = pa.RecordBatch.from_pydict({"q": [0], "text": [" ".join(ask)]})
    terms = pa.Table.from_batches(lexical._item_rows([item])).to_pylist()
    n_docs, length = 600, sum(len(t.split()) for t in texts)
    want = {}
    for i, t in rows:
        words = t.split()
        m = 25 + 75 * len(words) * n_docs // length
        want[i] = sum(x["k"] * 100 * (10 ** 9 * c // (1000 * c + 8 * m)) for x in terms if (c := words.count(x["term"].decode())))
    seen, spare = 0, []
    cells = {"q": np.array([0]), "terms": np.array([len(terms)]), "h": np.array([x["h"] for x in terms]), "kw": np.array([x["k"] * 100 for x in terms])}
    for row in got:
        _, bound = lexical.upper_bounds({**row, **{k: v.astype(np.int64).tobytes() for k, v in cells.items()}}, n_docs, length)
        for r, b in zip(row["r"], bound[0].tolist()):
            assert b >= want[r]
            spare.append(b - want[r])
            seen += 1
    assert seen == 600 and np.mean(spare) < 0.06 * np.mean(list(want.values()))


WORDS = ["spelling", "speling", "spellling", "variant", "variantt", "varient", "aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab", "étéété", "eteete", "étéétéé", "çççççç", "grouping", "groupings", "croupings", "straße", "strasse", "strase"]


def spelled(seed):
    rng = random.Random(seed)
    rows = [(i if i % 9 else None, " ".join(w.upper() if rng.random() < .1 else w for w in rng.choices(WORDS, weights=[1 / (j % 7 + 1) ** 2 for j in range(len(WORDS))], k=rng.randint(0, 90))) + "_1") for i in range(60)]
    letters = "abcé"
    rows += [(100 + i, " ".join("".join(rng.choices(letters, k=rng.randint(6, 7))) for _ in range(400))) for i in range(20)]
    long = "ab" * 3000
    rows += [(200, f"{long} {long}x {long[:500]}q{long[500:]} " * 5), (201, None), (202, ""), (204, "Verlongs " * 200 + "verlong " * 36 + "verlon " * 7), (203, "12 -- ab"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("small,levels,every", [(16, 8, 199), (1, 2, 7), (2, 0, 0)])
def test_variants_are_those_of_all_edits(spark, small, levels, every):
    rows = spelled(small)
    got = variants.variants(variants.word_counts(docs_of(spark, rows), every=every), small=small, levels=levels)
    want = brute.variants(rows, every=every or 1 << 40)
    assert listed(got.select("word", "form", "root", "n", "n_near", "form_n")) == sorted(map(repr, want)) and any(w[2] != w[1] and w[1] for w in want)


def test_variants_of_long_chains_take_few_levels(spark):
    words = [("a" * n, 5 * n) for n in range(6, 400)] + [("b" * 200 + x, 5) for x in "cdefgh"]
    out = {r.word: r for r in variants.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(out["a" * n].n_near == 2 for n in range(7, 399)) and out["a" * 6].n_near == 1 and out["b" * 200 + "c"].n_near == 5


def test_variants_of_an_empty_table(spark):
    assert variants.variants(variants.word_counts(docs_of(spark, []))).count() == 0
    assert variants.variants(variants.word_counts(docs_of(spark, [(1, "shortw " * 4)]))).count() == 0
