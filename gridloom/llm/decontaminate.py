"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are lower-case runs of letters and digits. For an item of m words every window of m words of a document that holds at
least one of the item sizes' 5-word shingles gets a 64-bit SimHash over its shingles, each as often as it occurs (a window
without a shared shingle has similarity zero, so this skips nothing). Fingerprints are cut into blocks; every item lies in
the table of each block under all values of a Hamming ball, so that a window meets every item of its size within `radius`
bits. What it meets is checked by complete distance, then by weighted shingle similarity: the sum of the smaller
multiplicities over the sum of the larger ones.

A document shorter than an item is one window. Items are taken in groups of bounded size, each sent to every task; more
items mean more passes over the documents, never a larger broadcast.

Defined cases: items and documents without words match nothing; an item of fewer than 5 words is one shingle; of equal
windows the first counts; repeated rows are each reported; a null text has no words;
a text of any length is scanned whole, its windows in slices of WINDOWS, also where it repeats one word; an empty table on
either side gives an empty result; other columns are not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.llm.arrays import ALNUM, Words, blocks, mixed, raw, run_hashes
from gridloom.llm.simhash import balls
from gridloom.llm.tables import ready

RADIUS = 19  # a similarity of 0.8 is 9.7 bits apart on average, with a deviation of 2.9
BLOCKS = 5
ITEMS, ITEM_BYTES = 2048, 4 << 20  # of one group
WINDOWS = 1 << 15  # windows that are fingerprinted at once


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(max(0, len(words) - size + 1))
    return run_hashes(words, at, at + size, 0)


def _fingerprints(grams: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of grams[start:start+count]; the bits of the positions in use are summed once."""
    span = np.zeros(len(grams) + 1, np.int32)
    np.add.at(span, starts, 1)
    np.add.at(span, starts + counts, -1)
    used = np.flatnonzero(np.cumsum(span[:-1]) > 0)
    sums = np.zeros((len(used) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(mixed(grams[used]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=sums[1:])
    at = np.searchsorted(used, starts)
    votes = sums[at + counts] - sums[at]
    return np.packbits(votes * 2 > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """One group of items with its shingles and its multi-index."""

    def __init__(self, ids: list, texts: list[str], shingle: int, radius: int, parts: int):
        data, offsets = raw(pa.array(texts, pa.string()))
        w = Words(data, offsets, ALNUM[data])
        hashes = w.hashes()
        self.ids, self.shingle, self.radius = ids, shingle, radius
        self.sizes = np.diff(w.first)
        self.grams = [_grams(hashes[a:b], min(shingle, b - a)) if b > a else np.zeros(0, np.uint64) for a, b in zip(w.first, w.first[1:])]
        self.lengths = np.unique(self.sizes[self.sizes > 0])
        self.prints = np.array([_fingerprints(g, np.array([0]), np.array([len(g)]))[0] if len(g) else 0 for g in self.grams], np.uint64)
        self.vocabulary = {int(m): np.unique(np.concatenate([self.grams[i] for i in np.flatnonzero(self.sizes == m)])) for m in self.lengths}
        long = [self.vocabulary[int(m)] for m in self.lengths if m >= shingle]
        self.any = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.any >> np.uint64(44)).astype(np.int64)] = True
        self.cuts = [(64 * b // parts, 64 * (b + 1) // parts) for b in range(parts)]
        keys, owners = [], []
        some = np.flatnonzero(self.sizes > 0)
        for b, (lo, hi) in enumerate(self.cuts):
            ball = np.array(balls(hi - lo, radius // parts), np.uint64)
            keys.append((self._key(some, b)[:, None] ^ ball[None, :]).ravel())
            owners.append(np.repeat(some, len(ball)))
        self.keys, self.owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owners = self.keys[order], self.owners[order]

    def _key(self, items: np.ndarray, block: int) -> np.ndarray:
        return self._block_key(self.prints[items], self.sizes[items], block)

    def _block_key(self, prints: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
        """Block value below the block's number and the window's size, so only items of that size are met."""
        lo, hi = self.cuts[block]
        value = (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        return value | (np.uint64(block) << np.uint64(24)) | (sizes.astype(np.uint64) << np.uint64(28))

    def near(self, prints: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        found = []
        for b in range(len(self.cuts)):
            key = self._block_key(prints, sizes, b)
            lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
            count = hi - lo
            window = np.repeat(np.arange(len(prints)), count)
            item = self.owners[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[close] * len(self.ids) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger multiplicities of two lists of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if both else 0.0


def _hit_rows(ids: list, texts: list[str], shingle: int, least: float, radius: int, parts: int, id_type: pa.DataType):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, shingle, radius, parts)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = Words(data, offsets, ALNUM[data])
                hits = _block_hits(items, w, least)
                if hits:
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc").take(pa.array([h[0] for h in hits])), pa.array([items.ids[h[1]] for h in hits], id_type),
                        pa.array([h[2] for h in hits]), pa.array([h[3] for h in hits], pa.int32()), pa.array([h[4] for h in hits], pa.int32())],
                        names=["doc", "item", "similarity", "start", "n_words"])
    return rows


def _starts(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Starts of the windows of n shingles that hold one of the shingles `at`: the union of runs, each place once."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, np.maximum(at - n + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _best_of(items: Items, grams: np.ndarray, text_of: np.ndarray, first: np.ndarray, start: np.ndarray, count: np.ndarray, m: int, k: int, least: float, best: dict) -> None:
    """Compare a slice of windows of one size with the items of that size; windows of the same shingles are compared once."""
    lo, hi = int(start.min()), int((start + count).max())
    own = grams[lo:hi]
    window, item = items.near(_fingerprints(own, start - lo, count), np.full(len(start), m))
    if not len(window):
        return
    same = run_hashes(own, start[window] - lo, start[window] - lo + count[window], 1).tolist()
    known: dict[tuple[int, int], float] = {}
    for i, j, h in zip(window.tolist(), item.tolist(), same):
        s, n = int(start[i]), int(count[i])
        got = known.get((h, j))
        if got is None:
            got = known[h, j] = similarity(grams[s:s + n], items.grams[j])
        key = (int(text_of[s]), j)
        if got >= least and (key not in best or got > best[key][0]):
            best[key] = (got, s - int(first[key[0]]), n + k - 1)


def _block_hits(items: Items, w: Words, least: float) -> list[tuple]:
    """(text, item, similarity, first word, words) of the best window per text and item."""
    words = w.hashes()
    if not len(words) or not len(items.lengths):
        return []
    text_of, lengths = w.text_of(), np.diff(w.first)
    long = _grams(words, items.shingle)
    maybe = np.flatnonzero(items.filter[(long >> np.uint64(44)).astype(np.int64)])
    maybe = maybe[np.isin(long[maybe], items.any)]
    best: dict[tuple[int, int], tuple] = {}
    for k in range(1, items.shingle + 1):  # shingles are shorter than usual only for items of fewer words
        sizes = [int(m) for m in items.lengths if (m >= k if k == items.shingle else m == k)]
        if not sizes:
            continue
        grams = long if k == items.shingle else _grams(words, k)
        near = maybe if k == items.shingle else np.arange(len(grams))
        near = near[text_of[near] == text_of[near + k - 1]]
        for m in sizes:
            at = near[np.isin(grams[near], items.vocabulary[m])]
            if not len(at):
                continue
            n = m - k + 1
            text = text_of[at]
            short = lengths[text] < m
            whole = np.unique(text[short])
            begin = _starts(at[~short], n, len(words))
            begin = begin[begin + m <= w.first[text_of[begin] + 1]]
            for start, count in ((begin, np.full(len(begin), n)), (w.first[whole], lengths[whole] - k + 1)):
                for lo in range(0, len(start), WINDOWS):
                    _best_of(items, grams, text_of, w.first, start[lo:lo + WINDOWS].astype(np.int64), count[lo:lo + WINDOWS].astype(np.int64), m, k, least, best)
    return [(t, j, *b) for (t, j), b in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 shingle: int = 5, least: float = 0.8, radius: int = RADIUS, parts: int = BLOCKS) -> DataFrame:
    """One row per document and item that it holds: `doc`, `item`, `similarity`, and the best window as `start` (in words)
    and `n_words`. Documents that hold no item have no row."""
    spark = docs.sparkSession
    ready(spark)
    base = docs.select(F.col(key).alias("doc"), F.lower(F.col(text)).alias("text")).filter(F.col("text").isNotNull())
    bench = items.select(F.col(item_key).alias("item"), F.lower(F.col(item_text)).alias("text")).filter(F.length("text") > 0)
    out = T.StructType([base.schema["doc"], bench.schema["item"], T.StructField("similarity", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType())])
    group = F.xxhash64("item", "text")
    size = bench.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    groups = max(-(-size["n"] // ITEMS), -(-(size["b"] or 0) // ITEM_BYTES), 1)
    id_type = to_arrow_type(out["item"].dataType)
    found = []
    for g in range(groups):  # each group is bounded; the items of one group only are on the driver at a time
        some = bench.filter(F.pmod(group, F.lit(groups)) == g).orderBy(group).collect()
        if some:
            found.append(base.mapInArrow(_hit_rows([r["item"] for r in some], [r["text"] for r in some], shingle, least, radius, parts, id_type), out))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)

