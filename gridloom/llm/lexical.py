"""Ranked lexical search with bit-sliced Bloom signatures.

Every document is a column of bits: each of its terms sets HASHES places among about BITS times as many places as it has
keys, and so do (term, step) pairs for every step of tf that the term reaches. Documents of like size share a block, and a
block stores its bits by place: a slice is the bitmap of its documents at one place. The slices of a term, combined by AND,
hold at least the documents that have the term; its steps hold at least those that have it so often. With a document's
length and its largest tf this bounds the term's part of the score, and the weighted sum over an item's terms bounds the
score from above. The `first` best bounds per item are scored exactly; the kth score found is a floor, and a second scan
takes every document whose bound reaches it. All these are scored exactly from their texts, so no document is left out that
is not proven to rank lower.

One scan of the texts makes the signatures and counts documents per term. It counts the terms that pass a fixed bitmap of
1 MB over the items' terms, and decides on the terms' bytes. Items meet the signatures in blocks: broadcast up to ASK_BYTES,
joined by shard beyond. Texts to be scored are picked by a bitmap of the same size and then joined by row id. A text of over 2^20 / BITS keys has a full
signature and is scored exactly for most items.

Score: sum over an item's terms, repeats included, of w * ((10^9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L,
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))); N documents with terms, L their terms, n one document's terms.

Defined cases: null and termless texts are no documents and termless items have no rows; every row is a document (and every
item row an item) of its own; ties go to the smaller id, null first; empty tables give no rows; other columns are not read.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import ALNUM, LOWER, Words, blocks, list_array, mixed
from gridloom.llm.tables import ready, stored
from gridloom.operators.scale import top_per_key

HASHES, BITS, WIDEST = 6, 16, 1 << 20
STEPS = (1, 2, 3, 5, 9, 17, 33, 65, 129)  # least tf of each step
DOCS, AREA = 512, 1 << 23  # documents and bits of a block
ENTRIES = 1 << 14  # (item, term) pairs of a block of items
SIEVE = 1 << 23  # bits of a bitmap sent to every task
ASK_BYTES = 8 << 20  # of items that are broadcast; more are joined by shard
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def term_runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, ALNUM[data])


def _places(h: np.ndarray, step: int, width: int) -> np.ndarray:
    """Places of the keys (term, step) among `width` (one column per hash)."""
    one = mixed(h + np.uint64(0x9E3779B97F4A7C15 * step & (1 << 64) - 1))
    two = mixed(one) | np.uint64(1)
    x = one[:, None] + two[:, None] * np.arange(HASHES, dtype=np.uint64)
    return ((x >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def _in(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - 23)
    return (sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def sieve_of(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap of SIEVE bits that holds the 64-bit hashes of a column: at most 131,072 words come to the driver."""
    at = F.shiftrightunsigned(column, 64 - 23)
    rows = df.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).select("word", F.expr("shiftleft(1L, bit)").alias("bits"))
    out = np.zeros(SIEVE >> 6, np.uint64)
    got = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _tallied(low: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the distinct (text, term) pairs in order of text: text, hash, tf and the place of one such word."""
    w = term_runs(low, offsets)
    h, text = w.hashes(), w.text_of()
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return w, text[at], h[at], np.diff(np.append(at, len(h))), order[at]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in blocks(batch, "text"):
            low = LOWER[data]
            w, text, h, tf, at = _tallied(low, offsets)
            line = low.tobytes()
            terms = [line[a:b] for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("q").take(pa.array(text)), pa.array(terms, pa.binary()), pa.array(h.view(np.int64)), pa.array(tf.astype(np.int64))], names=["q", "term", "h", "k"])


_BLOCK = "r array<long>, n array<long>, top array<long>, width int, slices binary, term binary, df long"
_ARROW = pa.schema([*[(c, pa.list_(pa.int64())) for c in ("r", "n", "top")], ("width", pa.int32()), ("slices", pa.binary()), ("term", pa.binary()), ("df", pa.int64())])


def _signature(rows: np.ndarray, n: np.ndarray, top: np.ndarray, distinct: np.ndarray, keys: np.ndarray, h: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one batch. By document: row id, terms, largest tf, distinct terms, keys; h and tf hold the
    distinct terms of one document after the other."""
    terms = np.cumsum(np.append(0, distinct))
    order = np.argsort(keys, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        width = lambda i: int(min(WIDEST, max(64, -(-BITS * int(keys[order[i]]) // 64) * 64)))
        while hi < len(order) and hi - lo < DOCS and width(hi) * (-(-(hi + 1 - lo) // 8) * 8) <= AREA and width(hi) <= 2 * width(lo):
            hi += 1
        some, size = order[lo:hi], width(hi - 1)
        at = np.concatenate([np.arange(terms[i], terms[i + 1]) for i in some])
        doc = np.repeat(np.arange(len(some)), (terms[1:] - terms[:-1])[some])
        bits = np.zeros((size, -(-len(some) // 8) * 8), bool)
        for step, least in enumerate(STEPS):
            has = tf[at] >= least
            if not has.any():
                break
            bits[_places(h[at][has], step, size), doc[has][:, None]] = True
        one = lambda x, kind: list_array(x, np.array([len(x)]), kind)
        yield pa.RecordBatch.from_arrays([
            one(rows[some], pa.int64()), one(n[some], pa.int64()), one(top[some], pa.int64()), pa.array([size], pa.int32()),
            pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], names=_ARROW.names)
        lo = hi


def _scan_rows(sieve: np.ndarray):
    """Signature blocks of the documents, and how many of them hold each term that passes the sieve."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, own, n, top, terms, keys, hashes, counts = Counter(), [], [], [], [], [], [], []
            for part, data, offsets in blocks(batch, "text"):
                low = LOWER[data]
                w, text, h, tf, at = _tallied(low, offsets)
                if not len(h):
                    continue
                line = low.tobytes()
                asked = at[_in(sieve, h)]
                seen.update([line[a:b] for a, b in zip(w.starts[asked].tolist(), w.ends[asked].tolist())])
                full = np.flatnonzero(np.diff(w.first))
                first = np.searchsorted(text, full)
                own.append(part.column("r").to_numpy()[full])
                n.append(np.diff(w.first)[full])
                top.append(np.maximum.reduceat(tf, first))
                terms.append(np.diff(np.append(first, len(text))))
                keys.append(np.add.reduceat(np.searchsorted(STEPS, tf, "right"), first))
                hashes.append(h)
                counts.append(tf)
            if own:
                yield from _signature(*[np.concatenate(x) for x in (own, n, top, terms, keys, hashes, counts)])
            if seen:
                none = [pa.nulls(len(seen), _ARROW.field(i).type) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*none, pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=_ARROW.names)
    return rows


def _ask_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as blocks: ids, numbers of terms, hashes and weights as bytes, and floors."""
    def packed(some: list[dict]) -> pa.RecordBatch:
        cells = [np.array([x["q"] for x in some], np.int64), np.array([len(x["terms"]) for x in some], np.int64), np.array([t["h"] for x in some for t in x["terms"]], np.int64),
                 np.array([t["kw"] for x in some for t in x["terms"]], np.int64), np.array([x["floor"] for x in some], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["q", "terms", "h", "kw", "floor"])

    held: list[dict] = []
    for batch in batches:
        for x in batch.to_pylist():
            if held and sum(len(y["terms"]) for y in held) + len(x["terms"]) > ENTRIES:
                yield packed(held)
                held = []
            held.append(x)
    if held:
        yield packed(held)


def upper_bounds(row: dict, docs: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the items of a block and the upper bounds of their scores (items x documents of the signature block)."""
    q, terms, h, kw = (np.frombuffer(row[c], np.int64) for c in ("q", "terms", "h", "kw"))
    n, top, size = np.array(row["n"], np.int64), np.array(row["top"], np.int64), row["width"]
    slices = np.frombuffer(row["slices"], np.uint8).reshape(size, -1)
    m = 25 + 75 * n * docs // length
    steps = int(np.searchsorted(STEPS, top.max(), "right"))
    most = [np.minimum(top, STEPS[s + 1] - 1 if s + 1 < len(STEPS) else top) for s in range(steps)]
    part = np.stack([np.zeros(len(n), np.int64)] + [1_000_000_000 * t // (1000 * t + 8 * m) for t in most])
    distinct, which = np.unique(h.view(np.uint64), return_inverse=True)
    out = np.zeros((len(q), len(n)), np.int64)
    owner = np.repeat(np.arange(len(q)), terms)
    order = np.argsort(which, kind="stable")
    which, owner, kw = which[order], owner[order], kw[order]
    for lo in range(0, len(distinct), 2048):
        some = distinct[lo:lo + 2048]
        level = np.zeros((len(some), len(n)), np.int8)
        alive = np.arange(len(some))
        for step in range(steps):
            has = np.unpackbits(np.bitwise_and.reduce(slices[_places(some[alive], step, size)], axis=1), axis=1, count=len(n)).astype(bool)
            if step:
                has &= level[alive] == step
            level[alive] += has
            alive = alive[has.any(1)]
            if not len(alive):
                break
        worth = part[level, np.arange(len(n))]
        a, b = np.searchsorted(which, [lo, lo + len(some)])
        by = a + np.argsort(owner[a:b], kind="stable")
        for at in range(0, len(by), 4096):
            e = by[at:at + 4096]
            first = np.flatnonzero(np.diff(owner[e], prepend=-1))
            out[owner[e][first]] += np.add.reduceat(worth[which[e] - lo] * kw[e][:, None], first, axis=0)
    return q, out


def _bound_rows(docs: int, length: int, first: int | None):
    """(q, r, bound) of documents whose bound reaches the item's floor. With `first`, only those that are among the best of
    their task so far."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                q, bound = upper_bounds(row, docs, length)
                keep = bound >= np.maximum(np.frombuffer(row["floor"], np.int64), 1)[:, None]
                if first:
                    had = best.get(row["q"], np.zeros((len(q), 0), np.int64))
                    all_ = np.concatenate([had, bound], axis=1)
                    if all_.shape[1] > first:
                        all_ = -np.partition(-all_, first - 1, axis=1)[:, :first]
                        keep &= bound >= all_.min(1)[:, None]
                    best[row["q"]] = all_
                x, y = np.nonzero(keep)
                if first and len(x):  # of many equal bounds a block sends the first ones
                    order = np.lexsort((y, -bound[x, y], x))
                    x, y = x[order], y[order]
                    place = np.arange(len(x)) - np.searchsorted(x, x)
                    x, y = x[place < first], y[place < first]
                yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(np.array(row["r"], np.int64)[y]), pa.array(bound[x, y])], names=["q", "r", "bound"])
    return rows


def _pick_rows(sieve: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(sieve, batch.column("r").to_numpy().view(np.uint64))))
    return rows


def _score_rows(docs: int, length: int):
    """Exact scores of the items asked for each text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for i in range(batch.num_rows):
                terms = _TERM.findall(LOWER[np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)].tobytes())
                tf, m = Counter(terms), 25 + 75 * len(terms) * docs // length
                for ask in batch.column("asks")[i].as_py():
                    score = sum(t["kw"] * (1_000_000_000 * c // (1000 * c + 8 * m)) for t in ask["terms"] if (c := tf.get(t["term"], 0)))
                    if score > 0:
                        got.append((i, ask["q"], score))
            at = pa.array([g[0] for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("r").take(at), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())], names=["doc", "r", "q", "score"])
    return rows


def search(docs: DataFrame, items: DataFrame, k: int = 10, first: int = 40, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`item`, `rank` (from 1), `doc` and `score` of the k best documents of every item, exact."""
    spark = docs.sparkSession
    ready(spark)
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("r"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    asked = stored(items.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item"), F.col(item_text).alias("text")), "items")
    terms = stored(asked.select("q", "text").mapInArrow(_item_rows, "q long, term binary, h long, k long"), "item-terms")
    files = stored(base.select("r", "text").mapInArrow(_scan_rows(sieve_of(terms, "h")), _BLOCK), "signatures")
    blocks_, counted = files.filter("width is not null").drop("term", "df"), files.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    total = blocks_.agg(F.sum(F.size("r")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)).alias("terms")).first()
    n_docs, length = total["docs"] or 0, total["terms"] or 1
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.coalesce("df", F.lit(0)) + 1).cast("double"))).cast("long")
    weighted = terms.join(counted, "term", "left").withColumn("kw", F.col("k") * weight).filter("kw > 0")
    weighted = stored(weighted.groupBy("q").agg(F.collect_list(F.struct("term", "h", "kw")).alias("terms")), "weights")

    def bounds(floors: DataFrame, first: int | None) -> DataFrame:
        ask = floors.select("q", F.transform("terms", lambda t: F.struct(t["h"].alias("h"), t["kw"].alias("kw"))).alias("terms"), "floor")
        ask = stored(ask.mapInArrow(_ask_rows, "q binary, terms binary, h binary, kw binary, floor binary"), "asks")
        size = ask.agg(F.sum(F.octet_length("h") + F.octet_length("kw") + F.octet_length("q"))).first()[0] or 0
        if size <= ASK_BYTES:
            met = blocks_.crossJoin(F.broadcast(ask))  # the items fit every task: signatures stay where they are
        else:
            shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
            ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
            met = blocks_.withColumn("shard", F.pmod(F.xxhash64("r"), F.lit(shards))).hint("merge").join(ask, "shard").drop("shard")
        return met.mapInArrow(_bound_rows(n_docs, length, first), "q long, r long, bound long")

    schema = T.StructType([base.schema["doc"], *T.StructType.fromDDL("r long, q long, score long").fields])

    def exact(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select("q", "r").distinct(), "pairs")
        asks = pairs.join(weighted.withColumn("terms", F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["kw"].alias("kw")))), "q")
        asks = asks.groupBy("r", F.floor(F.col("q") / 64).alias("_part")).agg(F.collect_list(F.struct("q", "terms")).alias("asks")).drop("_part")
        texts = base.mapInArrow(_pick_rows(sieve_of(pairs, "r")), base.schema)
        return stored(texts.join(asks, "r").select("doc", "r", "text", "asks").mapInArrow(_score_rows(n_docs, length), schema), "scores")

    best = top_per_key(bounds(weighted.withColumn("floor", F.lit(1).cast("long")), first), ["q"], [F.col("bound").desc(), F.col("r")], first, "_n")
    scored = exact(best)
    sure = top_per_key(scored, ["q"], [F.col("score").desc()], k, "_n").groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).otherwise(1).alias("floor"))
    reach = bounds(weighted.join(sure, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(1)).cast("long")), None)
    rest = exact(reach.join(scored.select("q", "r"), ["q", "r"], "left_anti"))
    ranked = top_per_key(scored.unionByName(rest), ["q"], [F.col("score").desc(), F.col("doc")], k, "rank")
    return asked.select("q", "item").join(ranked, "q").select("item", "rank", "doc", "score")
