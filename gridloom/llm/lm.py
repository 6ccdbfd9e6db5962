"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). Both factors are softmaxes over sums of weight rows, and
the rows are found by hashing features of the context, besides the log frequencies as a fixed bias: the word before, the
words two and three before (skips), and the pair of words before (n-gram). The HEAD commonest words are members of 32-word
classes. All other words fall into one of TAIL classes by their last two bytes; within such a class a word has its add-one
share of the class's exact training counts, with one place for unseen words. So the model is normalised over an open
vocabulary.

Training is distributed: in every round all tasks start from the same weights, take gradient steps over their share of the
training texts (each text is used in one round), and their changes are averaged, block by block, by tasks that add them up
as a stream. Only the weights, of fixed size, pass the driver. Counts of all training words are exact, over all texts, and
stay distributed: the COMMON commonest are sent to the tasks, the rest is joined by word.

Defined cases: a null or empty text is its end token; repeated rows are counted and scored each; rows whose `learn` is null
are not learned from; without training text every known word and the base score 0 (the one unseen place has probability 1),
and the model stays uniform; a text of any length is scored whole by the task that reads it, in blocks; other columns are
not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import LOWER, blocks, list_array, mixed, spaced
from gridloom.llm.tables import ready, stored

CLASS = 32  # words of a head class
HEAD = 16 * CLASS  # words with weights of their own, the end token among them
TAIL = 32  # classes of all other words
ROWS = 1 << 13  # hashed weight rows of each factor
COMMON = 1 << 17  # words whose exact counts are sent to the tasks
ROUNDS = 3
BATCH = 2048
RATE, CAUTION = 0.5, 4.0  # step size; uses of a row in a batch below which its step is smaller
BUFFER = 3_000_000  # words counted at once in a task
BLOCK_ROWS = 256  # weight rows of one exchanged block
END = np.uint64(0x5851F42D4C957F2D)  # stands for the hash of the end token
_BEFORE = HEAD + TAIL  # the symbol before a text
_CLASSES = HEAD // CLASS + TAIL


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of every token of a block, end tokens included, and the number of tokens before each text."""
    w = spaced(LOWER[data], offsets)
    texts = w.texts
    first = w.first + np.arange(texts + 1)
    hashes, tails = np.full(int(first[-1]), END), np.zeros(int(first[-1]), np.int64)
    at = np.arange(len(w.starts)) + w.text_of()
    hashes[at] = w.hashes()
    last = w.data[w.ends - 1].astype(np.uint64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.uint64)
    tails[at] = (mixed(last * np.uint64(257) + before + np.uint64(1)) % np.uint64(TAIL)).astype(np.int64)
    return hashes, tails, first


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def counted() -> pa.RecordBatch:
        hashes, tails = (np.concatenate(x) for x in zip(*held))
        got, at, n = np.unique(hashes, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(tails[at].astype(np.int32)), pa.array(n)], names=["h", "tail", "n"])
    for batch in batches:
        for _, data, offsets in blocks(batch, "text"):
            hashes, tails, _ = _tokens(data, offsets)
            held.append((hashes, tails))
            size += len(hashes)
            if size >= BUFFER:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


@dataclass
class Model:
    """Head words (sorted hashes and their numbers), counts, and the two weight tables."""

    head: np.ndarray
    number: np.ndarray
    common: np.ndarray  # sorted hashes
    count: np.ndarray
    tokens: int
    types: int
    tail_log: np.ndarray  # log10 of the tail classes' token, type and unseen places
    class_bias: np.ndarray  # log frequency of every class
    member_bias: np.ndarray  # and of every member of every head class
    classes: np.ndarray  # ROWS x classes
    members: np.ndarray  # ROWS x CLASS

    def symbols(self, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Head word number, or HEAD + tail class."""
        at = np.minimum(np.searchsorted(self.head, hashes), max(0, len(self.head) - 1))
        return np.where(self.head[at] == hashes, self.number[at], HEAD + tails) if len(self.head) else HEAD + tails

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Training count of common words, -1 for others."""
        if not len(self.common):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.common, hashes), len(self.common) - 1)
        return np.where(self.common[at] == hashes, self.count[at], -1)


def _row(kind: int, key: np.ndarray) -> np.ndarray:
    """Weight row of a feature's key."""
    return (mixed(np.uint64(kind << 40) + key.astype(np.uint64)) % np.uint64(ROWS)).astype(np.uint16)


_PAIR = 1 << 10  # above every symbol
_KEYS = [np.arange(_PAIR), np.arange(_PAIR), np.arange(_PAIR), np.arange(_PAIR * (_BEFORE + 1))]
_CLASS_ROW = [_row(k, keys) for k, keys in enumerate(_KEYS)]  # hashed once: row of every key of every feature
_MEMBER_ROW = [_row(k + 8, keys) for k, keys in enumerate(_KEYS)]
_SHIFT = _row(16, np.arange(HEAD // CLASS))  # a class moves its members' rows by so much


def _features(symbols: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of the context features of every token: word before, two before, three before, pair before."""
    place = np.arange(len(symbols)) - np.repeat(first[:-1], np.diff(first))
    back = []
    for k in (1, 2, 3):
        s = np.full(len(symbols), _BEFORE)
        s[k:] = np.where(place[k:] >= k, symbols[:-k] if k < len(symbols) else symbols[:0], _BEFORE)
        back.append(s)
    return [*back, back[1] * _PAIR + back[0]]


def _class_rows(features: list[np.ndarray], some: slice) -> list[np.ndarray]:
    return [table[key[some]] for table, key in zip(_CLASS_ROW, features)]


def _member_rows(features: list[np.ndarray], some: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    shift = _SHIFT[group]
    return [(table[key[some]] + shift) & np.uint16(ROWS - 1) for k, (table, key) in enumerate(zip(_MEMBER_ROW, features)) if k != 2]


def _softmax(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the scores (less their maximum) and their sums."""
    scores = bias + table[rows[0]]
    for r in rows[1:]:
        scores += table[r]
    scores -= scores.max(1, keepdims=True)
    np.exp(scores, out=scores)
    return scores, scores.sum(1)


def _log_p(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    e, total = _softmax(table, bias, rows)
    return np.log10(np.maximum(e[np.arange(len(target)), target], 1e-30)).astype(np.float64) - np.log10(total)


def _descend(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> None:
    """One gradient step: each weight row moves by its mean gradient, less where it was used rarely."""
    wrong, total = _softmax(table, bias, rows)
    wrong /= total[:, None]
    wrong[np.arange(len(target)), target] -= 1
    for r in rows:
        order = np.argsort(r, kind="stable")
        near = r[order]
        head = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
        used = np.diff(np.append(head, len(r)))
        table[near[head]] -= np.add.reduceat(wrong[order], head, axis=0) * (RATE / len(rows) / (used + CAUTION))[:, None].astype(np.float32)


def _train_block(model: Model, data: np.ndarray, offsets: np.ndarray) -> int:
    hashes, tails, first = _tokens(data, offsets)
    symbols = model.symbols(hashes, tails)
    features = _features(symbols, first)
    is_head = symbols < HEAD
    target = np.where(is_head, symbols // CLASS, HEAD // CLASS + symbols - HEAD)
    for lo in range(0, len(symbols), BATCH):
        some = slice(lo, min(lo + BATCH, len(symbols)))
        _descend(model.classes, model.class_bias, _class_rows(features, some), target[some])
        own = lo + np.flatnonzero(is_head[some])
        if len(own):
            group = symbols[own] // CLASS
            _descend(model.members, model.member_bias[group], _member_rows(features, own, group), symbols[own] % CLASS)
    return len(symbols)


def _gradient_rows(model: Model):
    """A task's gradient steps; returns its changes by block of weight rows, times the tokens it used."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = np.hstack([model.classes, model.members])
        model.classes, model.members = model.classes.copy(), model.members.copy()
        used = sum(_train_block(model, data, offsets) for batch in batches for _, data, offsets in blocks(batch, "text"))
        if used:
            change = (np.hstack([model.classes, model.members]) - start) * np.float32(used)
            yield _block_batch({b: change[b * BLOCK_ROWS:(b + 1) * BLOCK_ROWS] for b in range(ROWS // BLOCK_ROWS)}, used)
    return rows


def _block_batch(parts: dict[int, np.ndarray], used) -> pa.RecordBatch:
    n = [used[b] if isinstance(used, dict) else used for b in parts]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(n, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in parts.values()], pa.binary())], names=["block", "used", "change"])


def _added_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the changes of each block, as a stream."""
    sums: dict[int, np.ndarray] = {}
    used: dict[int, int] = {}
    for batch in batches:
        for row in batch.to_pylist():
            x = np.frombuffer(row["change"], np.float32).astype(np.float64)
            sums[row["block"]] = sums[row["block"]] + x if row["block"] in sums else x
            used[row["block"]] = used.get(row["block"], 0) + row["used"]
    if sums:
        yield _block_batch(sums, used)


_BLOCKS = "block int, used long, change binary"


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table (h, tail, n) of all training counts. `learn` is a condition on the columns of `docs`."""
    ready(docs.sparkSession)
    own = docs.filter(learn).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    counts = stored(own.select("text").mapInArrow(_count_rows, "h long, tail int, n long").groupBy("h", "tail").agg(F.sum("n").alias("n")), "word-counts")
    sums = {r["tail"]: (r["n"], r["v"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    common = counts.orderBy(F.col("n").desc(), "h").limit(COMMON).select("h", "tail", "n").toArrow()  # of fixed size
    h, tail, n = common["h"].to_numpy().view(np.uint64), common["tail"].to_numpy(), common["n"].to_numpy()
    end = np.flatnonzero(h == END)
    head = np.concatenate([end, np.setdiff1d(np.arange(min(HEAD, len(h))), end, assume_unique=True)])[:HEAD].astype(np.int64)
    places = np.ones(TAIL)
    for t, (tokens, types) in sums.items():
        places[t] += tokens + types
    np.subtract.at(places, tail[head], n[head] + 1)
    by_hash, by_head = np.argsort(h), head[np.argsort(h[head])]
    number = np.zeros(len(h), np.int64)
    number[head] = np.arange(len(head))
    seen = np.zeros(HEAD)
    seen[:len(head)] = n[head]
    seen = seen.reshape(-1, CLASS)
    class_bias = np.log(np.append(np.where(seen.sum(1) > 0, seen.sum(1) + 1, 1e-26), np.maximum(places, 1))).astype(np.float32)
    member_bias = np.log(np.where(seen > 0, seen + 1, 1e-26)).astype(np.float32)  # places without a word get no mass
    model = Model(h[by_head], number[by_head], h[by_hash], n[by_hash], sum(x for x, _ in sums.values()), sum(v for _, v in sums.values()), np.log10(places),
                  class_bias, member_bias, np.zeros((ROWS, _CLASSES), np.float32), np.zeros((ROWS, CLASS), np.float32))
    share = F.pmod(F.xxhash64("doc"), F.lit(rounds))
    for r in range(rounds):
        changes = own.filter(share == r).select("text").mapInArrow(_gradient_rows(model), _BLOCKS)
        added = changes.repartition(ROWS // BLOCK_ROWS, "block").mapInArrow(_added_rows, _BLOCKS).collect()  # the weights' size
        for row in added:
            change = np.frombuffer(row["change"], np.float32).reshape(BLOCK_ROWS, -1) / np.float32(row["used"])
            at = slice(row["block"] * BLOCK_ROWS, (row["block"] + 1) * BLOCK_ROWS)
            model.classes[at] += change[:, :_CLASSES]
            model.members[at] += change[:, _CLASSES:]
    return model, counts


def _score_block(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Per text: tokens, known ones, base and model sums without the counts of words that are not common; those words."""
    hashes, tails, first = _tokens(data, offsets)
    symbols = model.symbols(hashes, tails)
    features = _features(symbols, first)
    is_head = symbols < HEAD
    target = np.where(is_head, symbols // CLASS, HEAD // CLASS + symbols - HEAD)
    logs = np.zeros(len(symbols))
    for lo in range(0, len(symbols), BATCH):
        some = slice(lo, min(lo + BATCH, len(symbols)))
        logs[some] = _log_p(model.classes, model.class_bias, _class_rows(features, some), target[some])
        own = lo + np.flatnonzero(is_head[some])
        if len(own):
            group = symbols[own] // CLASS
            logs[own] += _log_p(model.members, model.member_bias[group], _member_rows(features, own, group), symbols[own] % CLASS)
    count = model.known(hashes)
    own = np.log10(np.maximum(count, 0) + 1.0)  # 0 for words that are joined later
    logs += np.where(is_head, 0.0, own - model.tail_log[tails])
    base = own - np.log10(model.tokens + model.types + 1.0)
    open_ = count < 0

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, first[:-1]) if len(x) else x
    rest = per_text(open_.astype(np.int64))
    return np.diff(first), per_text((count > 0).astype(np.int64)), per_text(base), per_text(logs), list_array(hashes[open_].view(np.int64), rest, pa.int64())


def _score_rows(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "_text"):
                names = [c for c in part.schema.names if c != "_text"]
                n, known, base, logs, rest = _score_block(model, data, offsets)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(n), pa.array(known), pa.array(base), pa.array(logs), rest],
                                                 names=[*names, "n_tokens", "n_known", "base_score", "score", "_rest"])
    return rows


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row with `n_tokens`, `n_known`, `train_tokens`, `base_score` (add-one unigram) and `score`,
    the model's log10 probability of the text."""
    ready(docs.sparkSession)
    base = docs.select(*[F.col(f"`{c}`") for c in keep or []], F.col(text).alias("_text"))
    out = T.StructType([*[f for f in base.schema.fields if f.name != "_text"], *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")],
                        *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")], T.StructField("_rest", T.ArrayType(T.LongType()))])
    done = stored(base.mapInArrow(_score_rows(model), out).withColumn("_row", F.monotonically_increasing_id()), "scores")
    words = done.select("_row", F.explode("_rest").alias("h"))
    rare = words.join(counts.select("h", "n"), "h").groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("_log"), F.count("*").alias("_n"))
    more = F.coalesce(F.col("_log"), F.lit(0.0))
    return done.drop("_rest").join(rare, "_row", "left").select(
        *[f"`{c}`" for c in keep or []], "n_tokens", (F.col("n_known") + F.coalesce(F.col("_n"), F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
