"""Plain-Python references for the operators, for small inputs."""
from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def substring(docs: list[tuple], words: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    split = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i:i + words]) for _, w in split for i in range(len(w) - words + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if seen[tuple(w[i:i + words])] > 1:
                gone.update(range(i, i + words))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words_of(t: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0D]+", t or "")


def simhash(docs: list[tuple], shingle: int = 4, radius: int = 4) -> list[tuple]:
    """(doc_id, fingerprint, component_id) per row."""
    fps = []
    for _, t in docs:
        w = words_of(ascii_lower(t or ""))
        grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    low: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return [(d, f"{fps[i]:016x}", low.get(top(i))) for i, (d, _) in enumerate(docs)]


def decontaminate(docs: list[tuple], items: list[tuple], shingle: int = 5, least: float = 0.8) -> list[tuple]:
    """(doc_id, item_id, similarity) per document and item, over all windows."""
    def split(t):
        return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())

    def grams(w):
        k = min(shingle, len(w))
        return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for d, t in docs:
        w = split(t)
        for i, x in items:
            v = split(x)
            if not v or not w:
                continue
            best = 0.0
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s:s + len(v)]), grams(v)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= least:
                out.append((d, i, round(best, 9)))
    return out


def unigram(docs: list[tuple], learn) -> dict:
    """doc_id -> (n_tokens, n_known, train_tokens, base_score)."""
    split = {d: [*words_of(ascii_lower(t or "")), None] for d, t in docs}  # None is the end token
    c = Counter(w for d, ws in split.items() if learn(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return {d: (len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in split.items()}


def cosine_links(rows: list[tuple], least: float = 0.93) -> list[tuple]:
    """(vec_id, n_links, component_id) per (vec_id, vector, label) row."""
    ok = [label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    norm = [math.sqrt(sum(x * x for x in v)) if good else 0 for good, (_, v, _) in zip(ok, rows)]
    links = [[j for j, (_, w, m) in enumerate(rows) if i != j and ok[i] and ok[j] and label == m and len(v) == len(w)
              and sum(x * y for x, y in zip(v, w)) / (norm[i] * norm[j]) >= least] for i, (_, v, label) in enumerate(rows)]
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        out.append((k, len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def lexical(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """(item_id, rank, doc_id, score) for (doc_id, text) and (item_id, text) rows."""
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", ascii_lower(t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        ask, got = Counter(terms(text)), []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in ask.items() if c[t])
            if score > 0:
                got.append((d, score))
        got.sort(key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        out += [(item, i + 1, d, s) for i, (d, s) in enumerate(got[:k])]
    return out


def variants(docs: list[tuple], least: int = 6, occurrences: int = 5, every: int = 199, factor: int = 5) -> list[tuple]:
    """(word, form, root, n, n_near, form_n) over (doc_id, text) rows."""
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= occurrences}
    letters = {c for w in count for c in w}
    near = {}
    for w in count:
        edits = {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + w[i + 1:] for i in range(len(w))}
        near[w] = (edits - {w}) & count.keys()
    best = {w: min(near[w], key=lambda x: (-count[x], x)) for w in count if near[w]}
    form = {w: f for w, f in best.items() if count[f] >= factor * count[w]}
    out = []
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None))
    return out
