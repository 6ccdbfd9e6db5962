"""Words and runs whose patterns defeat linear hashes: Thue-Morse sequences and their complements."""
import itertools
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gridloom.llm import arrays, decontaminate, lm, packing, substring
from gridloom.llm.queries import WORD_BPE, vocabulary


def twins(n, a="a", b="b"):
    """A Thue-Morse sequence and its complement."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def words_of(text):
    data, offsets = arrays.raw(pa.array([text]))
    return arrays.spaced(data, offsets)


@pytest.mark.parametrize("n", [64, 512, 1024, 4096])
def test_no_collisions_of_patterned_words_and_runs(n):
    one, two = ("".join(x) for x in twins(n))
    for which in range(3):
        h = words_of(f"{one} {two} {one}").hashes(which)
        assert h[0] == h[2] != h[1]
        v = words_of(" ".join(itertools.chain(*twins(n), twins(n)[0]))).hashes(which)
        r = arrays.run_hashes(v, np.array([0, n, 2 * n, 1]), np.array([n, 2 * n, 3 * n, n]), which)
        assert r[0] == r[2] and len(set(r.tolist())) == 3


def test_hashes_depend_on_every_byte_and_the_length():
    rng = random.Random(1)
    words = {"a" * n for n in range(1, 200)} | {"".join(rng.choices("abÿ", k=rng.randint(1, 90))) for _ in range(3000)}
    words |= {w[:i] + "c" + w[i + 1:] for w in list(words)[:200] for i in range(len(w))}
    words = sorted(words)
    for which in range(3):
        h = words_of(" ".join(words)).hashes(which)
        assert len(set(h.tolist())) == len(words)
        assert (words_of("xx " + " ".join(words)).hashes(which)[1:] == h).all()


def test_kinds_of_words_are_told_apart_by_bytes(monkeypatch):
    words = ["aa", "b", "aa", "c" * 90 + "x", "c" * 90 + "y", "b", "c" * 90 + "x", "d", "e" * 9, "f" * 9, "e" * 9]
    real = arrays.Words.hashes
    for crude in (False, True):
        if crude:
            monkeypatch.setattr(arrays.Words, "hashes", lambda w, which=0: np.where(w.ends - w.starts > 8, np.uint64(7), real(w, which)))
        codes, first = arrays.distinct_words(words_of(" ".join(words)))
        assert [words[first[c]] for c in codes] == words and len(first) == 7


def test_substring_keeps_patterned_twins(spark):
    for n in (1024, 4096):
        a, b = ("".join(x) for x in twins(n))
        rest = " ".join(f"w{i}" for i in range(34))
        rows = [(0, f"{a} {rest}"), (1, f"{b} {rest}"), (2, " ".join(twins(n, "x", "y")[0])), (3, " ".join(twins(n, "x", "y")[1]))]
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=35).collect()
        assert sorted((r.doc, r.n_removed) for r in got) == sorted((r[0], r[2]) for r in brute.substring(rows, 35))
    runs = [(i, " ".join(x)) for i, x in enumerate(twins(2048, "p", "q"))]
    got = substring.remove_repeats(spark.createDataFrame(runs, "doc_id long, text string"), words=2048).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_language_model_does_not_know_the_twin(spark):
    a, b = ("".join(x) for x in twins(1024))
    docs = spark.createDataFrame([(0, f"{a} {a} same words here", True), (1, f"{b} {a}", False)], "doc_id long, text string, learn boolean")
    model, counts = lm.fit(docs, docs["learn"])
    got = {r.doc_id: r.n_known for r in lm.score(docs, model, counts, keep=["doc_id"]).collect()}
    assert got == {0: 6, 1: 2}


def test_packing_gives_the_library_ids_of_twins(spark):
    a, b = ("".join(x) for x in twins(1024))
    rows = [(0, f"{a} {b} {a}", "s"), (1, b, "s")]
    path = vocabulary(WORD_BPE)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), path, window=4096, end=2).collect()
    tok = Tokenizer.from_file(path)
    for doc, text, _ in rows:
        ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc == doc), key=lambda r: r.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*tok.encode(text, add_special_tokens=False).ids, 2]


def test_decontamination_does_not_meet_the_twin(spark):
    one, two = (" ".join(x) for x in twins(2048, "p", "q"))
    a, b = ("".join(x) for x in twins(1024))
    rows, items = [(0, f"{a} r s t u v"), (1, f"{b} r s t u v"), (2, one), (3, two)], [(0, f"{a} r s t u v"), (1, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc, r.item) for r in decontaminate.contaminated(docs, bench, shingle=5).collect()}
    assert (0, 0) in got and (1, 0) not in got and (2, 1) in got
    got = {(r.doc, r.item) for r in decontaminate.contaminated(docs, bench, shingle=2048).collect()}
    assert got == {(0, 0), (2, 1)}
