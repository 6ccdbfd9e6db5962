"""The operators against plain-Python references, and on awkward tables: nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with the operators' own."""
import collections
import itertools
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, langid, lm, packing, simhash, substring, tokens, toxicity, vafile
from gridloom.llm.queries import PIECE_BPE, WORD_BPE, vocabulary
from gridloom.llm.tables import crc_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, _text string, h long, sig long, score double, kept string, runs int, component long, start int"
LONG = " ".join(f"w{i % 997} of the ÉTÉ" for i in range(12_000))


def awkward(spark, more=()):
    texts = ["the cat sat on the mat today", "", None, " \t\n ", LONG, "the cat sat on the mat today", "…", "12 34", "été ÉTÉ it's <|endoftext|> x_y", "a", "the the the"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None) for i, t in enumerate(texts)]
    rows += [(3, " \t\n ", "en", "s"), (0, texts[0], None, None), (None, "the cat sat on the mat today", "de", "z"), (None, None, None, None), (7, "other text of seven", "de", "s"), *more]
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4.0, "k", 5, 6, 7) for r in rows], SCHEMA), [r[:3] for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def mixture(seed, n=120):
    """Documents of few words, runs, shared passages and copies."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choices([f"x{i}" for i in range(50)], k=rng.randint(10, 80))) for _ in range(10)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randint(0, 4)):
            k = rng.random()
            if k < .4:
                w = rng.choice(passages).split()
                t += w[rng.randint(0, 5):rng.randint(6, 90)]
            elif k < .6:
                t += [rng.choice("abc")] * rng.randint(1, 90)
            elif k < .7:
                t += ["p", "q"] * rng.randint(1, 40)
            else:
                t += rng.choices(["a", "b", "Cc", "dd."], k=rng.randint(0, 50))
        rows.append((i if i % 17 else None, " ".join(t) if i % 13 else None))
    return rows + rows[:5]


@pytest.mark.parametrize("words,seed", [(35, 8), (5, 2), (1, 1)])
def test_substring_removes_exactly_the_repeated_windows(spark, words, seed):
    rows = mixture(words)
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), words=words, seed=seed).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(repr((r.doc, r.n_words, r.n_removed, r.sha)) for r in got) == sorted(map(repr, brute.substring(rows, words)))
    assert all(a.stop < b.start for r in got for a, b in zip(r.spans, r.spans[1:])) and all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_on_awkward_rows(spark, docs):
    df, rows = docs
    got = substring.remove_repeats(df, words=3, seed=2, carry=True).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(repr((r.doc, r.n_words, r.n_removed, r.sha)) for r in got) == sorted(map(repr, brute.substring([r[:2] for r in rows], 3)))
    assert all(r.row.component == 6 and r.row.kept == "k" for r in got)
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_simhash_matches_all_pairs(spark, docs):
    df, rows = docs
    rng = random.Random(4)
    base = [" ".join(rng.choices([f"v{i}" for i in range(300)], k=60)) for _ in range(6)]
    more = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(60)] = "zz"
        more.append((1000 + i, " ".join(w), None, None))
    df, rows = awkward(spark, more)
    got = [(r.doc, f"{r.fp & (2**64 - 1):016x}", r.component) for r in simhash.near_duplicates(df, radius=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.simhash([r[:2] for r in rows])))
    assert len({c for _, _, c in got}) < len(rows)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("segments,radius", [(3, 4), (2, 5), (5, 4), (1, 1)])
def test_simhash_links_connect_what_all_pairs_connect(spark, segments, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # so that blocks of a hot entry meet
    rng = random.Random(segments)
    fps = set()
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(40):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(20), rng.randint(1, radius + 1)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    hubs = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, segments)).collect()}
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f
    for f in fps:
        for g in fps:
            if (f ^ g).bit_count() <= radius:
                up[top(f)] = top(g)
    want = collections.defaultdict(set)
    got = collections.defaultdict(set)
    for f, s in zip(fps, signed):
        want[top(f)].add(s)
        got[hubs.get(s, s)].add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_decontamination_matches_all_windows(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 70)))) for i in range(80)]
    rows = []
    for i in range(200):
        w = items[rng.randrange(80)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(w))
            w[p:p + rng.randint(0, 1)] = rng.choice([["zz"], []]) or ["yy"]
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(0, 50)) + w + rng.choices(vocab, k=rng.randint(0, 50))), None, None))
    rows += [(2000, items[3][1].upper().replace(" ", ",  "), None, None)]
    df, plain = awkward(spark, rows)
    bench = spark.createDataFrame([(*x, "c") for x in [*items, (990, None), (991, " .. "), (992, "the cat sat on the mat today")]], "item_id long, text string, doc string")
    got = sorted(repr((r.doc, r.item, round(r.similarity, 9))) for r in decontaminate.contaminated(df, bench).collect())
    want = brute.decontaminate([r[:2] for r in plain], [*items, (992, "the cat sat on the mat today")])
    assert got == sorted(map(repr, want)) and len(want) > 50
    assert decontaminate.contaminated(empty(spark), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "the\ncat", "\n\n \n", "<s> </s>", "ﬁ x", "▁x", "▁", "x▁ ▁", "漢字𝔘 a", "a" * 3000, "<0x0A> <unk>", "  　 x", "\x00 a",
       "<|endoftext|> a", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "It's we'll A1b2 ÀÉ", "a\x1cb  c", "é İΣς ÿÞß×÷", "x_y.z-w (q)", "ªº½µ"]


def test_token_counts_are_the_librarys(spark, docs):
    df, rows = docs
    path = vocabulary(PIECE_BPE)
    model = tokens.load(path)
    got = tokens.token_counts(df, path).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, len((t or "").encode()), len(model.encode(t or "")))) for i, t, _ in rows)
    counter = tokens.Counter(model)
    assert counter.split and len(counter.proven) > 10_000
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(ODD, k=3)) for _ in range(500)]
    assert counter.counts([t.encode() for t in texts]) == [len(model.encode(t)) for t in texts]
    word = tokens.load(vocabulary(WORD_BPE))
    assert [r.n_tokens for r in tokens.token_counts(df, vocabulary(WORD_BPE)).collect()] == [len(word.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert tokens.token_counts(empty(spark), path).count() == 0


def test_encoder_ids_are_the_librarys():
    coder = tokens.Encoder(vocabulary(WORD_BPE))
    assert coder.by_word and coder.by_unit
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices([*ODD, " ", "ab", "É"], k=4)) for _ in range(800)]
    raw = [t.encode() for t in texts]
    ids, count = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [coder.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_whole_full_and_in_proportion(spark, docs):
    df, rows = docs
    path, window = vocabulary(WORD_BPE), 64
    got = packing.pack(df, path, window=window).collect()
    tok = tokens.load(path)
    want = collections.Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, _ in rows)
    by_seq, sizes, totals = collections.defaultdict(list), collections.Counter(), collections.Counter()
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    ids_of = collections.defaultdict(list)
    for i, ids in want:
        ids_of[i].append(ids)
    for r in got:
        assert any(r.doc_tokens == len(x) and list(x[r.start:r.start + r.length]) == np.frombuffer(r.ids, "<u4").tolist() for x in ids_of[r.doc])
        by_seq[r.sequence_id].append((r.offset, r.length))
        sizes[r.sequence_id, r.source] += r.length
        totals[r.source] += r.length
    for s, parts in by_seq.items():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) == window or s == max(by_seq)
    served, whole = collections.Counter(), sum(totals.values())
    for s in range(max(by_seq)):
        for q in totals:
            served[q] += sizes[s, q]
            assert abs(served[q] - (s + 1) * window * totals[q] / whole) < 1.5
    assert packing.pack(empty(spark), path).count() == 0


def test_mixture_follows_targets_and_survives_exhaustion():
    mix = packing.Mixture([1000, 50, 300], [1, 1, 2])
    order, before = [], [0, 0, 0]
    for m in range(1, 1351):
        now = mix.served(m)
        assert sum(now) == m and all(b >= a for a, b in zip(before, now))
        order.append(next(q for q in range(3) if now[q] > before[q]))
        before = list(now)
    assert before == [1000, 50, 300]
    assert abs(order[:200].count(2) - 100) <= 1 and abs(order[:200].count(0) - 50) <= 1  # all three in proportion
    assert order[-400:] == [0] * 400  # the others are used up
    big = packing.Mixture([10**13, 3 * 10**12, 17], [10**13, 3 * 10**12, 17])
    got = big.served(4096 * 10**9)
    assert sum(got) == 4096 * 10**9 and all(abs(g - 4096e9 * t / big.all) < 2 for g, t in zip(got, big.totals))
    assert big.window_at(0, got[0] - 1, 4096) == 10**9 - 1


def test_few_queues_share_the_rest(spark):
    rows = [(i, f"w{i} x y", None, f"src{i % 9}") for i in range(60)]
    df, plain = awkward(spark, rows)
    got = packing.pack(df, vocabulary(WORD_BPE), window=32, queues=2, targets={"src1": 3}).collect()
    per = collections.Counter()
    for r in got:
        per[r.sequence_id] += r.length
    assert all(n == 32 for s, n in per.items() if s != max(per)) and {r.doc for r in got} == {r[0] for r in plain}


def test_every_source_has_its_share(spark, monkeypatch):
    monkeypatch.setattr(packing, "TREE_ROWS", 8)  # so that the tree has several blocks
    rng = random.Random(4)
    rows = [(i, " ".join(["word"] * rng.randint(1, 60)), None, f"src{i // 3 % 40}") for i in range(240)]  # a source's rows stand together
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for targets in (None, {"src39": 500, "src38": 1000}):
        got = packing.pack(df, vocabulary(WORD_BPE), window=200, queues=5, targets=targets).collect()
        totals, sizes, by_seq, of = collections.Counter(), collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            totals[r.source] += r.length
            sizes[r.sequence_id, r.source] += r.length
            by_seq[r.sequence_id].append((r.offset, r.length))
            of[r.doc].append((r.start, r.length, r.doc_tokens))
        for s, parts in by_seq.items():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) == 200 or s == max(by_seq)
        for parts in of.values():
            assert [a for a, _, _ in sorted(parts)] == [sum(n for _, n, _ in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n, _ in parts) == parts[0][2]
        assert len(of) == 240 and sum(totals.values()) == sum(len(r[1].split()) + 1 for r in rows)
        if targets:
            two = [sum(sizes[s, q] for s in range(2)) for q in ("src39", "src38")]
            assert abs(two[1] - 2 * two[0]) <= 3  # named sources past the largest keep their proportion
            continue
        served, whole = collections.Counter(), sum(totals.values())
        for s in range(max(by_seq)):
            for q in totals:
                served[q] += sizes[s, q]
                assert abs(served[q] - (s + 1) * 200 * totals[q] / whole) < 3
    with pytest.raises(ValueError):
        packing.pack(df, vocabulary(WORD_BPE), targets={"nowhere": 1})


def test_tree_places_and_counts_agree():
    totals = [9, 1, 4, 30, 2]
    ways, whole = packing._ways(totals), sum(totals)
    places = [packing._place_above(w, np.arange(t)).tolist() for w, t in zip(ways, totals)]
    assert sorted(sum(places, [])) == list(range(whole))
    for m in range(whole + 1):
        own = [sum(x < m for x in p) for p in places]
        assert [packing._served_below(w, m) for w in ways] == [(sum(own[:k]), own[k]) for k in range(5)]
        assert all(abs(n - m * t / whole) < 2 for n, t in zip(own, totals))


def test_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(0)
    trans, first = np.exp(rng.normal(size=(3, 3))), np.array([0, 0, 5, 155, 219, 220, 500])
    emit = np.exp(rng.normal(size=(500, 3)))
    got = langid._marginals(emit, trans, first)
    for a, b in zip(first, first[1:]):
        alpha, beta, x = [], [], np.ones(3)
        for t in range(a, b):
            x = (x @ trans) * emit[t]
            x /= x.sum()
            alpha.append(x)
        y = np.ones(3)
        for t in range(b - 1, a - 1, -1):
            beta.append(y)
            y = trans @ (emit[t] * y)
            y /= y.sum()
        if b > a:
            want = np.array(alpha) * np.array(beta[::-1])
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def test_transition_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    k, first = 3, np.array([0, 4, 4, 5, 9])
    scores, labels = rng.normal(size=(9, k)), rng.integers(0, k, 9)

    def loss(trans):
        total = 0.0
        for a, b in zip(first, first[1:]):
            if b > a:  # a word before the first may have any label
                paths = [(p, sum(scores[t, p[t - a + 1]] + trans[p[t - a], p[t - a + 1]] for t in range(a, b))) for p in itertools.product(range(k), repeat=b - a + 1)]
                seen = [x for p, x in paths if p[1:] == tuple(labels[a:b])]
                total += np.logaddexp.reduce([x for _, x in paths]) - np.logaddexp.reduce(seen)
        return total
    trans = rng.normal(size=(k, k))
    field = langid.Field(list("abc"), None, None, None, None, None, trans)
    got = langid.transition_gradient(field, scores, labels, first)
    for i, j in itertools.product(range(k), repeat=2):
        step = np.zeros((k, k))
        step[i, j] = 1e-5
        assert abs(got[i, j] - (loss(trans + step) - loss(trans - step)) / 2e-5) < 1e-6


def test_spans_of_the_sample_are_bounded(spark):
    long = "x" * 5000
    rows = [(i, " ".join([long if j % 50 == 0 else f"w{j}" for j in range(3000)]), "aa") for i in range(6)] + [(9, "a b", "bb"), (10, "", "bb"), (11, long, "bb")]
    got = langid.sample_spans(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sample=8, words=100)
    assert all(len(w) <= langid.SAMPLE_WORD_BYTES for _, spans in got for s in spans for w in s.split())
    assert {lang for lang, _ in got} == {"aa", "bb"} and all(sum(len(s.split()) for s in spans) <= 100 for _, spans in got)


def test_language_labels_switched_words(spark, docs):
    rng = random.Random(5)
    words = {"aa": ["kalo", "kalimo", "takal", "lokal", "mokali"], "bb": ["xerüs", "wexer", "xerwes", "rüxes", "sexür"]}
    train = [(100 + i, " ".join(rng.choices(words[g], k=40)), g, None) for i in range(80) for g in ("aa", "bb")]
    mixed = " ".join(rng.choices(words["aa"], k=30) + rng.choices(words["bb"], k=12))
    df, rows = awkward(spark, [*train, (900, mixed, None, None)])
    field = langid.fit(df, F.col("doc_id") >= 100)
    got = {(r.doc_id, r.runs is not None): r for r in langid.label(df, field, keep=["doc_id"]).collect()}
    out = langid.label(df, field, keep=["doc_id", "lang"]).collect()
    assert len(out) == len(rows) and all(r.lang_pred == r.lang for r in out if r.doc_id is not None and 100 <= r.doc_id < 900)
    row = got[900, True]
    assert row.lang_pred == "aa" and 0.6 < row.score < 0.8 and [(x.lang, x.stop - x.start) for x in row.runs] == [("aa", 30), ("bb", 12)]
    none = {r.doc_id: r for r in out}
    assert all(none[i].lang_pred == "und" and none[i].score == 0 for i in (1, 2, 6)) and none[4].lang_pred in ("aa", "bb")
    bare = langid.fit(empty(spark), F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.label(df, bare).collect()} == {("und", 0.0)}
    assert langid.label(empty(spark), field).count() == 0


def test_top_k_matches_brute_force(spark):
    rng = random.Random(6)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    vecs += [(300 + i, vecs[7][1]) for i in range(60)]  # one vector many times
    vecs += [(400, None), (401, []), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (404, [1.0, None] + [0.0] * 6)]
    vecs += [(450, [0.1, 0.2]), (451, [0.3, -0.1]), (452, [1e30, 0.0]), (5, vecs[5][1]), (350, [9.0] * 8)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("g", F.lit(2)).repartition(3)
    got = vafile.top_k(df, F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top(vecs)
    assert vafile.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def brute_top(vecs, kind=np.float32):
    rows = [(i, [math.floor(256 * float(kind(x))) for x in v]) for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want, top = [], (1 << 63) - 1
    for a, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-max(-top - 1, min(top, sum(x * y for x, y in zip(v, w)))), i) for b, (i, w) in enumerate(rows) if b != a and len(w) == len(v))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    return sorted(want)


def test_top_k_of_large_components_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(vafile, "ASK_BYTES", 0)  # queries joined by shard
    rng = random.Random(16)
    vecs = [(i, [rng.gauss(0, 1) * 10.0 ** rng.randint(0, 9) for _ in range(4)]) for i in range(120)]
    vecs += [(50, [2.0**40, -1.0, 0.5, 0.0]), (50, [2.0**40, -1.0, 0.5, 0.0]), (7, vecs[7][1]), (130, [1e300, 0.0, 0.0, -1e300]), (150, [-1e300, 1e-300, 3.0, 1e200])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, vafile.top_k(df, F.col("id") % 50 == 0).collect())) == brute_top(vecs, float)


@pytest.mark.parametrize("far", [1.0, 1e3, 1e9])
def test_an_outlier_leaves_few_candidates(far):
    rng = np.random.default_rng(5)
    m = np.floor(256 * rng.normal(size=(4000, 64)) / 8)
    m[3], m[9, 5], m[11, 6] = far * 256, -far * 256, far * 256
    grid = {64: vafile.Grid(m.min(0), m.max(0), vafile.inner_borders(m))}
    row = {"dim": 64, "qg": np.arange(100).tobytes(), "g": np.arange(4000).tobytes(), "qv": m[100:200].tobytes(), "v": grid[64].encode(m).tobytes()}
    _, _, lower, upper = vafile._bounds(row, grid)
    exact = m[100:200] @ m.T
    assert (lower <= exact).all() and (exact <= upper).all()
    floor = -np.partition(-lower, 5, axis=1)[:, 5]
    assert (upper >= floor[:, None]).mean() < 0.05


def test_chat_reads_back_exactly(spark):
    rng = random.Random(7)
    said = ["</s>", "[INST]", "<\\/s>", "[\\\\INST] [/INST]", "<<</s>", "[", "<", "\\", "", None, "a</s", "s>", "[/INST", "é𝔘<s><\\s>", "$1 \\$2", "x\ny"]
    rows = [(c, i, rng.choice(["user", "assistant", None, "</s>", "[/INST]"]), rng.choice(said)) for c in range(40) for i in range(6)]
    rows += [(None, 0, "user", "x"), (50, None, "assistant", "n"), (50, None, "assistant", "n"), (51, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, example int")
    out = chat.examples(df)
    back = {r.conv: r for r in chat.read_back(out).collect()}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    assert back.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [t[1:] for t in turns]
        assert back[c].loss == "".join(t[2] for t in turns if t[1] == "assistant")
    per = collections.Counter(r.conv for r in out.collect())
    assert all(per[c] == sum(t[1] == "assistant" for t in turns) + (turns[-1][1] != "assistant") for c, turns in convs.items())
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


def test_toxicity_learns_terms_and_pairs(spark, docs):
    rng = random.Random(8)
    filler = [f"{a}{b}" for a in ("lo", "mi", "ta", "ver") for b in ("na", "ri", "so", "ku", "te")]
    rows, labels = [], []
    for i in range(400):
        bad, group = i % 8 == 0, i % 4 == 1
        w = rng.choices(filler, k=rng.randint(5, 60)) + (["vexolot" + rng.choice(["a", "en", "ish"])] if bad else []) + (["people"] if group else [])
        rng.shuffle(w)
        rows.append((1000 + i, " ".join(w), None, None))
        labels.append((1000 + i, int(bad), None))
    df, plain = awkward(spark, rows)
    lab = spark.createDataFrame([*labels, (0, None, 1), (None, 1, 1), (5000, 1, 1), (1, 0, 1)], "doc_id long, toxic int, text int")
    machine = toxicity.fit(df, lab, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in toxicity.score(df, machine, keep=["doc_id"]).collect()}
    assert all((got[d] >= 0.3) == bool(y) for d, y, _ in labels if d % 4 == 2 or y)
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len({r[0] for r in plain})
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, lab.limit(0), F.lit(True))).collect()} == {0.0}
    assert toxicity.score(empty(spark), machine).count() == 0


def test_factors_hold_what_weights_alone_cannot():
    rng = np.random.default_rng(3)
    samples = []
    for i in range(1500):  # toxic only where both of two terms stand together
        a, b = rng.random(2) < 0.5
        terms = np.array(sorted({*rng.integers(100, 140, 6).tolist(), *([1] if a else []), *([2] if b else [])}))
        samples.append((terms, int(a and b)))
    m = toxicity.train(samples, rounds=30)
    both, one, two = (m.margins(np.zeros(len(x), np.int64), np.array(x), 1)[0] for x in ([1, 2], [1], [2]))
    assert both > 0 > max(one, two) and both - one - two + m.bias > 0.5


def test_lm_counts_base_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 12)  # so that most words are joined
    rng = random.Random(9)
    rows = [(100 + i, " ".join(rng.choices([f"W{j}" for j in range(1200)], weights=[1 / (j + 1) for j in range(1200)], k=rng.randint(0, 80))), None, None) for i in range(60)]
    df, plain = awkward(spark, rows)
    plain = [r for r in plain if r[0] is not None and r[0] not in (0, 3, 7)]
    df = df.filter("doc_id IS NOT NULL AND doc_id NOT IN (0, 3, 7)")
    model, counts = lm.fit(df, crc_fold(F.col("doc_id"), 7) != 2)
    got = {r.doc_id: r for r in lm.score(df, model, counts, keep=["doc_id"]).collect()}
    want = brute.unigram([r[:2] for r in plain], lambda d: zlib.crc32(str(d).encode()) % 7 != 2)
    for d, (n, known, train, base) in want.items():
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, train) and got[d].base_score == pytest.approx(base, rel=1e-9)
        assert got[d].score <= 0
    # all words that can follow a context, and the unseen place of every tail class, have probability 1 together
    every = [r.asDict() for r in counts.collect()]
    h = np.array([r["h"] for r in every]).view(np.uint64)
    tail, n = np.array([r["tail"] for r in every]), np.array([r["n"] for r in every])
    symbols = model.symbols(h, tail)
    key = [np.full(len(h), k) for k in (7, 3, lm._BEFORE, 3 * lm._PAIR + 7)]
    head = symbols < lm.HEAD
    logs = lm._log_p(model.classes, model.class_bias, lm._class_rows(key, slice(None)), np.where(head, symbols // lm.CLASS, lm.HEAD // lm.CLASS + symbols - lm.HEAD))
    own = np.flatnonzero(head)
    group = symbols[own] // lm.CLASS
    logs[own] += lm._log_p(model.members, model.member_bias[group], lm._member_rows(key, own, group), symbols[own] % lm.CLASS)
    logs[~head] += np.log10(n[~head] + 1) - model.tail_log[tail[~head]]
    unseen = lm._log_p(model.classes, model.class_bias, lm._class_rows([k[:lm.TAIL] for k in key], slice(None)), lm.HEAD // lm.CLASS + np.arange(lm.TAIL)) - model.tail_log
    assert (10 ** logs).sum() + (10 ** unseen).sum() == pytest.approx(1, abs=1e-3)
    bare, none = lm.fit(empty(spark), F.lit(True))
    assert {r.base_score for r in lm.score(df, bare, none).collect()} == {0.0} and lm.score(empty(spark), model, counts).count() == 0


def test_lm_learns_context(spark):
    rows = [(i, " ".join(["ping pong"] * 40) if i % 2 else " ".join(["tick tack"] * 40)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = lm.fit(df, F.col("doc_id") < 150)
    got = lm.score(df.filter("doc_id >= 150"), model, counts).collect()
    assert all(r.score > 0.8 * r.base_score for r in got)  # both are negative
    assert all(r.score > r.base_score for r in got)


def test_decontamination_of_one_repeated_word_stays_small():
    import tracemalloc

    import pyarrow as pa

    from gridloom.llm import arrays
    items = decontaminate.Items([0], ["w " * 1000], 5, decontaminate.RADIUS, decontaminate.BLOCKS)
    data, offsets = arrays.raw(pa.array(["w " * 40_000, "w " * 999]))
    words = arrays.Words(data, offsets, arrays.ALNUM[data])
    tracemalloc.start()
    hits = decontaminate._block_hits(items, words, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, i, s) for t, i, _, s, _ in hits] == [(0, 0, 0), (1, 0, 0)] and peak < 100 << 20
