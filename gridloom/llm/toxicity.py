"""Toxicity by a factorization machine over hashed terms.

Terms are the lower-case words of a text (runs of letters) and their fronts of 4 to 6 bytes, each counted once per text and
hashed to ROWS rows. The score is a logistic function of a bias, a weight per term and, for every pair of terms, the inner
product of their factors, so that two terms can weigh more (or less) together than apart. The machine is trained by
stochastic gradient steps on a bounded, documented sample of labelled documents; terms that fewer than LEAST_DOCS of them
hold, or whose counts there go with the label no more than chance would have it (G-test below LEAST_G), take no part. Scoring reads each text once, whole, without a shuffle; the model has a fixed size.

Defined cases: a null or empty text has the bias alone; a document with several labels counts as toxic if one says so; null
labels and labels of unknown documents teach nothing; without any label every score is 0; repeated rows score alike; a text
of any length is scored whole; columns that are kept must not be named like the results, others are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import LETTER, LOWER, Words, blocks, byte_hashes, list_array
from gridloom.llm.tables import ready

ROWS = 1 << 18
FACTORS = 6
FRONTS = (4, 5, 6)
SAMPLE_DOCS = 12_000
LEAST_DOCS = 3
LEAST_G = 6.6  # one term in a hundred reaches it by chance


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, row) of every term occurrence of a block."""
    low = LOWER[data]
    w = Words(low, offsets, LETTER[low])
    text = w.text_of()
    texts, rows = [text], [w.hashes() % np.uint64(ROWS)]
    for size in FRONTS:
        long = np.flatnonzero(w.ends - w.starts > size)
        texts.append(text[long])
        rows.append(byte_hashes(low, w.starts[long], w.starts[long] + size, 1) % np.uint64(ROWS))
    return np.concatenate(texts), np.concatenate(rows).astype(np.int64)


def _unique(text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text * ROWS + rows)
    return both // ROWS, both % ROWS


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            text, rows = _unique(*_terms(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("h"), part.column("toxic"), list_array(rows.astype(np.int32), np.bincount(text, minlength=part.num_rows), pa.int32())], names=["h", "toxic", "terms"])


@dataclass
class Machine:
    """Trained weights: bias, one weight and one factor vector per row; `known` marks rows that were learned."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    known: np.ndarray

    def margins(self, text: np.ndarray, rows: np.ndarray, texts: int) -> np.ndarray:
        """Raw scores of `texts` texts from their unique terms, sorted by text."""
        out = np.full(texts, self.bias)
        if len(rows):
            head = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            own = self.factor[rows].astype(np.float64)
            s, q = np.add.reduceat(own, head, axis=0), np.add.reduceat(own * own, head, axis=0)
            out[text[head]] += np.add.reduceat(self.weight[rows].astype(np.float64), head) + 0.5 * (s * s - q).sum(1)
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.known.any():
            return np.zeros(len(offsets) - 1)
        text, rows = _terms(data, offsets)
        own = self.known[rows]
        return 1 / (1 + np.exp(-np.clip(self.margins(*_unique(text[own], rows[own]), len(offsets) - 1), -60, 60)))


def _telling(held: np.ndarray, toxic: np.ndarray, docs: int, positive: int) -> np.ndarray:
    """Rows held by enough texts, whose texts are toxic more or less often than others (G-test of the two-by-two table)."""
    cells = [(toxic, held * positive / docs), (held - toxic, held * (docs - positive) / docs),
             (positive - toxic, (docs - held) * positive / docs), (docs - held - positive + toxic, (docs - held) * (docs - positive) / docs)]
    g = sum(2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)) for seen, due in cells)
    return (held >= LEAST_DOCS) & (g >= LEAST_G)


def train(samples: list[tuple[np.ndarray, int]], rounds: int = 12, rate: float = 0.05, shrink: float = 2e-4, seed: int = 5) -> Machine:
    """Stochastic gradient steps on the logistic loss, in batches of 32 texts; weights shrink a little with every use."""
    rng = np.random.default_rng(seed)
    none = [np.zeros(0, np.int32)]
    held = np.bincount(np.concatenate([t for t, _ in samples] + none), minlength=ROWS)
    toxic = np.bincount(np.concatenate([t for t, l in samples if l] + none), minlength=ROWS)
    known = _telling(held, toxic, max(1, len(samples)), sum(l for _, l in samples))
    m = Machine(0.0, np.zeros(ROWS, np.float32), np.zeros((ROWS, FACTORS), np.float32), known)
    if not known.any():
        return m
    m.factor[known] = rng.normal(0, 0.01, (int(known.sum()), FACTORS))
    y = np.array([l for _, l in samples], np.float64)
    m.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    terms = [t[known[t]].astype(np.int64) for t, _ in samples]
    for turn in range(rounds):
        order, pace = rng.permutation(len(y)), rate / (1 + 0.15 * turn)
        for lo in range(0, len(y), 32):
            some = order[lo:lo + 32]
            rows = np.concatenate([terms[i] for i in some])
            text = np.repeat(np.arange(len(some)), [len(terms[i]) for i in some])
            p = 1 / (1 + np.exp(-np.clip(m.margins(text, rows, len(some)), -30, 30)))
            wrong = (p - y[some]).astype(np.float32)
            m.bias -= pace * float(wrong.mean())
            if not len(rows):
                continue
            own = m.factor[rows]
            total = np.zeros((len(some), FACTORS), np.float32)
            np.add.at(total, text, own)
            uniq, inv = np.unique(rows, return_inverse=True)
            m.weight[uniq] -= pace * (np.bincount(inv, wrong[text]) + shrink * m.weight[uniq]).astype(np.float32)
            grad = wrong[text][:, None] * (total[text] - own)
            step = np.zeros((len(uniq), FACTORS), np.float32)
            np.add.at(step, inv, grad)
            m.factor[uniq] -= pace * np.clip(step * 0.1 + shrink * m.factor[uniq], -1, 1)
    return m


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Machine:
    """Train on the labelled documents where `learn` (over the label table's columns) holds: the `sample` of them with the
    smallest hash of their id. Executors turn them into terms; only those reach the driver."""
    ready(docs.sparkSession)
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` rows, so it may be broadcast
    base = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(picked), "_id")
    own = base.select(F.xxhash64("_id", "text").alias("h"), "toxic", "text").mapInArrow(_term_rows, "h long, toxic int, terms array<int>").dropDuplicates(["h"])
    rows = own.orderBy("h").limit(2 * sample).toArrow().sort_by("h")  # an id on several rows with different texts counts for each, within twice the bound
    toxic = rows["toxic"].to_pylist()
    terms = (x for chunk in rows["terms"].chunks for x in chunk)
    return train([(x.values.to_numpy(), int(t > 0)) for x, t in zip(terms, toxic)])


def _score_rows(machine: Machine):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "_text"):
                names = [c for c in part.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(machine.scores(data, offsets), pa.float64())], names=[*names, "score"])
    return rows


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row with its `score` from 0 to 1."""
    ready(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in keep or []], F.col(text).alias("_text"))
    out = T.StructType([*[f for f in base.schema.fields if f.name != "_text"], T.StructField("score", T.DoubleType())])
    return base.mapInArrow(_score_rows(machine), out)
