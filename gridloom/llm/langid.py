"""Language identification by a linear-chain conditional random field over words.

A word's emission scores are sums of weights of its prefixes, suffixes and byte trigrams (hashed) and of the languages in
whose lexicon it stands; learned transitions tie neighbouring words. The field is trained by stochastic gradient steps on
its likelihood, over code-switched sequences put together from spans of a bounded, documented sample of labelled
documents. A text's words are labelled by their forward-backward marginals; its language is the one with the most mass.

A text of any length is computed whole: its chain is cut into segments of SEGMENT words, whose transfer matrices are
multiplied first, so that the exact messages at the segment edges are known before the inside of all segments is computed
at once. Nothing is shuffled in prediction; the model is a few arrays of fixed size.

Defined cases: a null text or one without a letter is `und` with score 0; words without a letter give no evidence and no
mass; without any labelled text every prediction is `und`; repeated rows are labelled alike; columns that are
kept must not be named like the results, others are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import LETTER, LOWER, Words, blocks, mixed, raw, spaced
from gridloom.llm.tables import ready

ROWS = 1 << 14  # hashed rows of every feature family
SEGMENT = 64
SAMPLE_DOCS = 2400  # labelled documents the field is fitted on, an equal number of every language
SAMPLE_WORDS = 400  # words of the spans drawn from one document of the sample
SAMPLE_WORD_BYTES = 200  # longer words are left out of the spans
LEXICON = 1500  # commonest sample words of every language
UND = "und"


def _features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed rows of the affixes (words x 6), of the byte trigrams (one per byte), and the word hashes."""
    data = LOWER[w.data].astype(np.uint64)
    n, size = len(data), w.ends - w.starts
    affix = np.zeros((len(size), 6), np.uint16)
    for k in (1, 2, 3):
        front, back = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for i in range(k):
            has = i < size
            front = front * np.uint64(257) + np.where(has, data[np.minimum(w.starts + i, n - 1)] + np.uint64(1), 0).astype(np.uint64)
            back = back * np.uint64(257) + np.where(has, data[np.maximum(w.ends - 1 - i, 0)] + np.uint64(1), 0).astype(np.uint64)
        affix[:, k - 1] = (mixed(front * np.uint64(6) + np.uint64(k)) % np.uint64(ROWS)).astype(np.uint16)
        affix[:, k + 2] = (mixed(back * np.uint64(6) + np.uint64(k + 3)) % np.uint64(ROWS)).astype(np.uint16)
    gram = data.copy()  # the two bytes before (0 at the front of a word) and this one
    place = np.arange(n) - np.repeat(np.append(0, w.starts), np.diff(np.concatenate([[0], w.starts, [n]])))
    gram[1:] += np.where(place[1:] >= 1, data[:-1] + np.uint64(1), 0).astype(np.uint64) << np.uint64(9)
    gram[2:] += np.where(place[2:] >= 2, data[:-2] + np.uint64(1), 0).astype(np.uint64) << np.uint64(18)
    return affix, (mixed(gram) % np.uint64(ROWS)).astype(np.uint16), _word_hashes(w)


def _word_hashes(w: Words) -> np.ndarray:
    low = Words.__new__(Words)
    low.data, low.offsets, low.starts, low.ends, low.first = LOWER[w.data], w.offsets, w.starts, w.ends, w.first
    return low.hashes()


@dataclass
class Field:
    """A trained field: languages, weights by feature family, transitions."""

    langs: list[str]
    affix: np.ndarray  # 6 x ROWS x languages
    gram: np.ndarray  # ROWS x languages
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # word x languages, 1 where the word is in that lexicon
    lex: np.ndarray  # languages x languages
    trans: np.ndarray  # languages x languages

    def lexical(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros((len(hashes), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == hashes)[:, None]

    def emissions(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and which words hold a letter; words without one score 0."""
        affix, gram, hashes = _features(w)
        out = self.lexical(hashes) @ self.lex
        for k in range(affix.shape[1]):
            out += self.affix[k][affix[:, k]]
        sums = np.zeros((len(gram) + 1, len(self.langs)), np.float64)
        np.cumsum(self.gram[gram], axis=0, out=sums[1:])
        out += sums[w.ends] - sums[w.starts]
        letters = np.append(0, np.cumsum(LETTER[w.data]))
        has = letters[w.ends] > letters[w.starts]
        return out * has[:, None], has

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Posterior of every word's label. `first`: number of words before each text."""
        return _marginals(np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores, np.exp(self.trans - self.trans.max()), first)


def _marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    n_lang = trans.shape[0]
    count = np.diff(first)
    parts = -(-count // SEGMENT)
    total = int(parts.sum())
    if not total:
        return np.zeros((0, n_lang), emit.dtype)
    text = np.repeat(np.arange(len(count)), parts)
    rank = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[text] + rank * SEGMENT
    size = np.minimum(SEGMENT, first[text + 1] - begin)
    seg = np.repeat(np.arange(total), size)
    inside = np.arange(len(emit)) - np.repeat(begin, size)
    grid = np.ones((SEGMENT, total, n_lang), np.float64)
    grid[inside, seg] = emit
    # transfer matrix of every segment; a place beyond the end of a text leaves it as it is
    product = np.broadcast_to(np.eye(n_lang), (total, n_lang, n_lang)).copy()
    for t in range(SEGMENT):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        step = (product[live] @ trans) * grid[t, live][:, None, :]
        product[live] = step / step.max(axis=(1, 2), keepdims=True)
    # messages at the edges, segment by segment of all texts together
    into, outof = np.ones((total, n_lang)), np.ones((total, n_lang))
    head = np.cumsum(parts) - parts
    order = np.argsort(-parts, kind="stable")
    many = parts[order]
    for r in range(1, int(parts.max())):
        at = head[order[:np.searchsorted(-many, -r, "left")]] + r  # texts with more than r segments
        got = np.einsum("ij,ijk->ik", into[at - 1], product[at - 1])
        into[at] = got / got.max(1, keepdims=True)
    for r in range(int(parts.max()) - 2, -1, -1):
        at = head[order[:np.searchsorted(-many, -(r + 1), "left")]] + r
        got = np.einsum("ijk,ik->ij", product[at + 1], outof[at + 1])
        outof[at] = got / got.max(1, keepdims=True)
    alpha = np.empty_like(grid)
    now = into
    for t in range(SEGMENT):
        step = (now @ trans) * grid[t]
        now = np.where((size > t)[:, None], step / step.max(1, keepdims=True), now)
        alpha[t] = now
    now = outof
    for t in range(SEGMENT - 1, -1, -1):
        alpha[t] *= now
        step = (now * grid[t]) @ trans.T
        now = np.where((size > t)[:, None], step / step.max(1, keepdims=True), now)
    got = alpha[inside, seg]
    return got / got.sum(1, keepdims=True)


def transition_gradient(field: Field, scores: np.ndarray, labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Gradient of the sequences' negative log likelihood in the transitions: expected minus seen ones, from the pair
    marginals alpha * transition * emission * beta of one forward-backward pass."""
    k, count = len(field.langs), np.diff(first)
    full = np.flatnonzero(count)
    begin, count = first[:-1][full], count[full]
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    trans, emit = np.exp(field.trans - field.trans.max()), np.exp(scores - scores.max(1, keepdims=True))
    alpha, beta = np.empty((len(scores), k)), np.empty((len(scores), k))
    now = np.ones((len(begin), k))
    for t in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -t, "left"))  # sequences of more than t words
        step = (now[:live] @ trans) * emit[begin[:live] + t]
        now[:live] = alpha[begin[:live] + t] = step / step.sum(1, keepdims=True)
    now = np.ones((len(begin), k))
    for t in range(int(count.max(initial=0)) - 1, -1, -1):
        live = int(np.searchsorted(-count, -t, "left"))
        beta[begin[:live] + t] = now[:live]
        step = (now[:live] * emit[begin[:live] + t]) @ trans.T
        now[:live] = step / step.sum(1, keepdims=True)
    follow = np.setdiff1d(np.arange(1, len(scores)), first)
    pair = alpha[follow - 1][:, :, None] * trans[None] * (emit[follow] * beta[follow])[:, None, :]
    out = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(0)
    np.subtract.at(out, (labels[follow - 1], labels[follow]), 1)
    post = alpha[begin] * beta[begin]  # the word before the first may have any label
    wrong = (post / post.sum(1, keepdims=True)).sum(0) - np.bincount(labels[begin], minlength=k)
    return out + trans / trans.sum(0, keepdims=True) * wrong


def _sequences(texts: list[tuple[list[bytes], int]], rng: np.random.Generator) -> tuple[Words, np.ndarray, np.ndarray]:
    """Code-switched training sequences: one to three spans of documents in a row; words, labels and sequence starts."""
    spans = [(span.split(), lang) for some, lang in texts for span in some]
    order = rng.permutation(len(spans))
    words, labels, first = [], [], [0]
    at = 0
    while at < len(order):
        for i in order[at:at + int(rng.integers(1, 4))]:
            words += spans[i][0]
            labels += [spans[i][1]] * len(spans[i][0])
            at += 1
        first.append(len(words))
    data, offsets = raw(pa.array([b" ".join(words)], pa.binary()))
    return spaced(data, offsets), np.array(labels, np.int64), np.array(first, np.int64)


def train(langs: list[str], texts: list[tuple[list[bytes], int]], rounds: int = 4, rate: float = 0.25, seed: int = 7) -> Field:
    """Fit a field to (spans of a text, number of the language) pairs: adaptive gradient steps on the likelihood of sequences."""
    k = len(langs)
    rng = np.random.default_rng(seed)
    lexicon: dict[int, np.ndarray] = {}
    for lang in range(k):
        own = pa.RecordBatch.from_arrays([pa.array([b" ".join(t) for t, g in texts if g == lang], pa.binary())], names=["text"])
        got, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_word_hashes(spaced(data, offsets)) for _, data, offsets in blocks(own, "text")]]), return_counts=True)
        for h in got[np.lexsort((got, -n))][:LEXICON].tolist():
            lexicon.setdefault(h, np.zeros(k, np.float32))[lang] = 1
    hashes = np.array(sorted(lexicon), np.uint64)
    field = Field(langs, np.zeros((6, ROWS, k), np.float32), np.zeros((ROWS, k), np.float32), hashes,
                  np.array([lexicon[h] for h in hashes.tolist()], np.float32).reshape(len(hashes), k), np.zeros((k, k), np.float32), np.zeros((k, k), np.float32))
    if k < 2 or not texts:
        return field
    w, labels, first = _sequences(texts, rng)
    if not len(w.starts):
        return field
    parts = []
    for lo in range(0, len(w.starts), 1 << 14):  # a slice of the words at a time, to keep the driver small
        hi = min(lo + (1 << 14), len(w.starts))
        a, b = w.starts[lo] if lo else 0, w.starts[hi] if hi < len(w.starts) else len(w.data)
        part = Words.__new__(Words)
        part.data, part.starts, part.ends = w.data[a:b], w.starts[lo:hi] - a, w.ends[lo:hi] - a
        part.offsets = part.first = np.array([0, hi - lo])
        parts.append(_features(part))
    affix, gram, words = (np.concatenate(x) for x in zip(*parts))
    member = field.lexical(words)
    tables = {"affix": field.affix, "gram": field.gram, "lex": field.lex, "trans": field.trans}
    past = {name: np.full(x.shape, 1e-3, np.float32) for name, x in tables.items()}

    def step(name: str, at, grad: np.ndarray) -> None:
        past[name][at] += grad * grad
        tables[name][at] -= rate * grad / np.sqrt(past[name][at])

    batch = 64
    for _ in range(rounds):
        for lo in rng.permutation(np.arange(0, len(first) - 1, batch)):
            hi = min(lo + batch, len(first) - 1)
            a, b = first[lo], first[hi]
            byte = slice(w.starts[a], w.ends[b - 1])
            part = Words.__new__(Words)
            part.starts, part.ends = w.starts[a:b] - byte.start, w.ends[a:b] - byte.start
            scores = member[a:b] @ field.lex
            for f in range(6):
                scores += field.affix[f][affix[a:b, f]]
            sums = np.zeros((byte.stop - byte.start + 1, k))
            np.cumsum(field.gram[gram[byte]], axis=0, out=sums[1:])
            scores = scores + sums[part.ends] - sums[part.starts]
            inner = first[lo:hi + 1] - a
            post = field.marginals(scores, inner)
            wrong = post
            wrong[np.arange(b - a), labels[a:b]] -= 1
            wrong = (wrong / batch).astype(np.float32)
            for f in range(6):
                rows, inv = np.unique(affix[a:b, f], return_inverse=True)
                grad = np.zeros((len(rows), k), np.float32)
                np.add.at(grad, inv, wrong)
                step("affix", (f, rows), grad)
            rows, inv = np.unique(gram[byte], return_inverse=True)
            cover = np.zeros((byte.stop - byte.start, k), np.float32)
            cover[np.repeat(part.starts, part.ends - part.starts) + np.arange((part.ends - part.starts).sum()) - np.repeat(np.cumsum(part.ends - part.starts) - (part.ends - part.starts), part.ends - part.starts)] = np.repeat(wrong, part.ends - part.starts, axis=0)
            grad = np.zeros((len(rows), k), np.float32)
            np.add.at(grad, inv, cover)
            step("gram", rows, grad)
            step("lex", slice(None), member[a:b].T @ wrong)
            step("trans", slice(None), (transition_gradient(field, scores, labels[a:b], inner) / batch).astype(np.float32))
    return field


def _span_rows(words: int):
    """Spans of 8 to 40 words of every text, about `words` of them, from places drawn by the text's hash."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                line, at, out = data.tobytes(), offsets.tolist(), []
                for h, a, b in zip(part.column("h").to_pylist(), at, at[1:]):
                    rng, all_, left, spans = np.random.default_rng(h & (1 << 63) - 1), line[a:b].split(), words, []
                    for lo in rng.integers(0, max(1, len(all_) - 24), max(1, min(len(all_), words) // 24)).tolist():
                        some = [w for w in all_[lo:lo + int(rng.integers(8, 41))] if len(w) <= SAMPLE_WORD_BYTES][:left]
                        left -= len(some)
                        if some:
                            spans.append(b" ".join(some))
                    out.append(spans)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), pa.array(out, pa.list_(pa.binary()))], names=["lang", "h", "spans"])
    return rows


def sample_spans(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS,
                 words: int = SAMPLE_WORDS) -> list[tuple[str, list[bytes]]]:
    """(language, spans) of the sample that `fit` describes; spans are cut where the texts are read, so at most
    sample * words * (SAMPLE_WORD_BYTES + 1) bytes reach the driver."""
    ready(docs.sparkSession)
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"))
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(sample).collect()}
    if not count:
        return []
    each = max(1, sample // len(count))
    # only hashes in the lowest part of the range can be among a language's smallest: so few rows are ranked, of any language
    share = F.element_at(F.create_map(*[F.lit(x) for k in sorted(count) for x in (k, min(1.0, 2.0 * each / count[k] + 50.0 / count[k]))]), F.col("lang"))
    low = known.filter((F.col("h").cast("double") / 2.0**64 + 0.5) <= share).select("lang", "h")
    picked = low.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rn") <= each).select("lang", "h").distinct()
    spans = known.join(F.broadcast(picked), ["lang", "h"]).mapInArrow(_span_rows(words), "lang string, h long, spans array<binary>")
    rows = spans.dropDuplicates(["lang", "h"]).collect()  # `sample` rows at most
    return [(r["lang"], [bytes(s) for s in r["spans"]]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS,
        words: int = SAMPLE_WORDS) -> Field:
    """Fit a field to a sample of the rows where `learn` holds and language and text are given: an equal number of every
    language, those with the smallest hash of id and text, about `sample` in all, and of each about `words` words in spans
    from all over its text. Of more than `sample` languages the commonest are learned. The hash sees the whole table; only
    the spans reach the driver."""
    got = sample_spans(docs, learn, key, text, lang, sample, words)
    langs = sorted({x for x, _ in got})
    number = {x: i for i, x in enumerate(langs)}
    return train(langs, [(spans, number[x]) for x, spans in got])


def _label_rows(field: Field, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, text):
                lang, score, runs, at = _label_block(field, spaced(data, offsets))
                names = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(at), runs)], names=[*names, "lang_pred", "score", "runs"])
    return rows


def _label_block(field: Field, w: Words) -> tuple[list[str], list[float], pa.StructArray, np.ndarray]:
    k, texts = len(field.langs), w.texts
    kinds = [pa.field("start", pa.int32()), pa.field("stop", pa.int32()), pa.field("lang", pa.string())]
    empty = pa.StructArray.from_arrays([pa.array([], f.type) for f in kinds], fields=kinds)
    if not k or not len(w.starts):
        return [UND] * texts, [0.0] * texts, empty, np.zeros(texts + 1, np.int32)
    scores, has = field.emissions(w)
    post = field.marginals(scores, w.first)
    sums = np.zeros((len(post) + 1, k))
    np.cumsum(post * has[:, None], axis=0, out=sums[1:])
    mass = sums[w.first[1:]] - sums[w.first[:-1]]
    letters = np.append(0, np.cumsum(LETTER[w.data]))[w.offsets]
    some = np.diff(letters) > 0
    ascii_letter = np.append(0, np.cumsum(LETTER[w.data] & (w.data < 128)))[w.offsets]
    for i in np.flatnonzero(some & (np.diff(ascii_letter) == 0)):  # no ASCII letter: ask for each character
        some[i] = any(c.isalpha() for c in w.data[w.offsets[i]:w.offsets[i + 1]].tobytes().decode(errors="replace"))
    best = mass.argmax(1)
    share = np.clip(mass[np.arange(texts), best] / np.maximum(mass.sum(1), 1e-9), 0.0, 1.0)
    word_label, text_of = post.argmax(1), w.text_of()
    new = np.ones(len(post), bool)
    new[1:] = (word_label[1:] != word_label[:-1]) | (text_of[1:] != text_of[:-1])
    head = np.flatnonzero(new)
    start = head - w.first[text_of[head]]
    stop = start + np.diff(np.append(head, len(post)))
    names = pa.array(field.langs, pa.string())
    runs = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(stop, pa.int32()), names.take(pa.array(word_label[head]))], fields=kinds)
    at = np.searchsorted(text_of[head], np.arange(texts + 1)).astype(np.int32)
    lang = [field.langs[b] if s else UND for b, s in zip(best.tolist(), some.tolist())]
    return lang, np.where(some, share, 0.0).tolist(), runs, at


def label(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row with `lang_pred`, `score` (the language's share of the words' mass) and `runs`, the
    stretches of words of one language. Only the text is read for the prediction."""
    ready(docs.sparkSession)
    keep = keep or []
    base = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(text).alias("_text")]))
    run = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType())])
    out = T.StructType([*[f for f in base.schema.fields if f.name != "_text"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("runs", T.ArrayType(run))])
    return base.mapInArrow(_label_rows(field, text if text in keep else "_text"), out)
