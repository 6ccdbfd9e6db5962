"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens, its documents one after another. Queues earn credit in proportion to their targets; a
token is served when its queue's credit for it is due, so after any number of tokens each queue has been served its share
to within about one token, and what it lacks (its deficit) is carried into the next window. Token i of a queue with target g
is due at (2i+1)/(2g); ties go to the earlier queue. An empty queue drops out and the others share on in their proportions.
Because a window's share of every queue follows from that rule alone, any task can compute the edges of the windows its
documents fall into: no window waits for the one before, and nothing is sorted. Each window holds one run of every queue, in
queue order; all windows but the last are full.

The `queues` largest sources and all sources with a target are served by the due order itself. All other sources stand in a
binary tree that is one more queue of it: what a node is served goes to its two sides in proportion to their tokens, rounded
to the nearest, so every source has its share of every window to within a token per level of the tree, whatever their number.
A source's place in that queue, and what is served before it, follow from the sums on its way up the tree, which its rows
carry. Trees are made per block of sources by tasks; only the sums of blocks reach the driver.

Where a document stands in its queue comes from sums per (partition, source): partitions carry the deficit on as windows
do. Token ids are made once and written to the shared folder; pieces are cut from there. Their
offsets, a row per partition and source, are broadcast up to SENT_ROWS rows; more of them are joined, which moves the ids once.

Defined cases: a null or empty text is the end token alone; a null source is a queue of its own; a target that names
no source of the table is refused; repeated rows are packed each; a text of any length is encoded by the task that reads it and cut into as many pieces as it needs; an empty
table gives no piece; other columns are not read, whatever their names.
"""
from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import blocks
from gridloom.llm.tables import ready, stored
from gridloom.llm.tokens import encoder

_SCALE = 1 << 80
ENCODE_BYTES = 1 << 20  # of text whose distinct pre-tokens are looked up together
TREE_ROWS = 1 << 13  # sources of one block of the tree, about
SENT_ROWS = 200_000  # rows of the offsets table that are sent to every task; a larger one is joined by key


class Mixture:
    """Which tokens of every queue the first m served tokens are."""

    def __init__(self, totals: list[int], targets: list[int]):
        if len(totals) != len(targets) or any(t <= 0 for t in targets):
            raise ValueError("every queue needs a positive target")
        self.totals, self.targets, self.all = totals, targets, sum(totals)
        self._known: dict[int, list[int]] = {}

    def _due(self, queue: int, i: int) -> tuple[int, int]:
        return (2 * i + 1) * _SCALE // self.targets[queue], queue

    def _level(self, m: int) -> float:
        """Credit per target unit at which about m tokens are served."""
        level, weight, left = 0.0, sum(self.targets), m
        for end, total, target in sorted((t / g, t, g) for t, g in zip(self.totals, self.targets)):
            if (end - level) * weight >= left:
                break
            left -= (end - level) * weight
            level, weight = end, weight - target
        return level + left / weight if weight > 0 else level

    def served(self, m: int) -> list[int]:
        m = min(m, self.all)
        got = self._known.get(m)
        if got is None:
            level = self._level(m)
            got = [min(t, max(0, int(level * g + 0.5))) for t, g in zip(self.totals, self.targets)]
            self._settle(got, m)
            if len(self._known) > 20_000:
                self._known.clear()
            self._known[m] = got
        return got

    def _settle(self, got: list[int], m: int) -> None:
        """Move the estimate to the exact first m tokens of the due order."""
        after = [self._due(q, n) for q, n in enumerate(got) if n < self.totals[q]]
        before = [tuple(-x for x in self._due(q, n - 1)) for q, n in enumerate(got) if n]
        heapq.heapify(after)
        heapq.heapify(before)

        def live(heap: list, sign: int) -> int | None:
            while heap:
                q = sign * heap[0][1]
                n = got[q] if sign > 0 else got[q] - 1
                if 0 <= n < self.totals[q] and heap[0] == tuple(sign * x for x in self._due(q, n)):
                    return q
                heapq.heappop(heap)
            return None

        def move(q: int, step: int) -> None:
            got[q] += step
            if got[q] < self.totals[q]:
                heapq.heappush(after, self._due(q, got[q]))
            if got[q]:
                heapq.heappush(before, tuple(-x for x in self._due(q, got[q] - 1)))
        count = sum(got)
        while True:
            up, down = live(after, 1), live(before, -1)
            if count < m:
                move(up, 1)
                count += 1
            elif count > m:
                move(down, -1)
                count -= 1
            elif up is None or down is None or after[0] > tuple(-x for x in before[0]):
                return
            else:
                move(up, 1)
                move(down, -1)

    def window_at(self, queue: int, place: int, window: int) -> int:
        """The window that holds token `place` of a queue."""
        lo, hi = 0, -(-self.all // window)
        guess = int(place / max(1, self.totals[queue]) * hi)
        for reach in (2, 64):  # the guess is close where targets follow the totals
            a, b = max(0, guess - reach), min(hi, guess + reach)
            if self.served(a * window)[queue] <= place < self.served(b * window)[queue]:
                lo, hi = a, b
                break
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if self.served(mid * window)[queue] <= place:
                lo = mid
            else:
                hi = mid
        return lo


def _ways(totals: list[int]) -> list[list[int]]:
    """For every leaf of the binary tree over `totals` its way up: per level the sum of the node above and of its left side,
    the latter negative where the way comes from the right."""
    nodes, at, ways = list(totals), list(range(len(totals))), [[] for _ in totals]
    while len(nodes) > 1:
        sums = [sum(nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        for leaf, j in enumerate(at):
            if j ^ 1 < len(nodes):  # the last of an odd number has no other side
                ways[leaf] += [sums[j >> 1], -nodes[j - 1] if j & 1 else nodes[j]]
            at[leaf] = j >> 1
        nodes = sums
    return ways


def _place_above(way: list[int], i: np.ndarray) -> np.ndarray:
    """Places in the whole tree's queue of the tokens `i` of a leaf."""
    for total, left in zip(way[::2], way[1::2]):
        own = left if left > 0 else total + left
        j = i.astype(object) if 2 * total * own >= 1 << 62 else i
        i = (-(-(total * (2 * j + 1)) // (2 * own)) - 1 if left > 0 else total * (2 * j + 1) // (2 * own)).astype(np.int64)
    return i


def _served_below(way: list[int], m: int) -> tuple[int, int]:
    """Of the first m tokens of the whole tree: those of the leaves before this one, and its own."""
    before = 0
    for total, left in zip(way[-2::-2], way[::-2]):
        side = (2 * m * abs(left) + total) // (2 * total)
        before, m = (before, side) if left > 0 else (before + side, m - side)
    return before, m


def _encode_rows(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pid = encoder(path), TaskContext.get().partitionId()
        served: dict = {}
        for batch in batches:
            for part, data, offsets in blocks(batch, "text", ENCODE_BYTES):
                ids, count = coder.encode(data, offsets)
                n = count + 1
                upto = np.cumsum(n)
                line = np.full(int(upto[-1]), end, coder.kind)
                line[np.arange(len(ids)) + np.repeat(np.arange(len(n)), count)] = ids
                at = np.append(0, upto * coder.kind.itemsize).astype(np.int32)
                begin = []
                for source, size in zip(part.column("source").to_pylist(), n.tolist()):
                    begin.append(served.get(source, 0))
                    served[source] = begin[-1] + size
                yield pa.RecordBatch.from_arrays([
                    part.column("doc"), part.column("source"), pa.array(np.full(len(n), pid, np.int32)), pa.array(begin, pa.int64()), pa.array(n),
                    pa.array(np.full(len(n), coder.kind.itemsize, np.int32)), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(line)])],
                    names=["doc", "source", "pid", "begin", "n", "step", "ids"])
    return rows


def _shared_edges(mix: Mixture, queue: int, way: list[int], lo: int, hi: int, window: int):
    """Windows that tokens lo to hi of a leaf of the shared queue fall into, the leaf's edges there and what stands before it."""
    above = _place_above(way, np.arange(lo, hi))
    i, at, windows, edges, before = 0, 0, [], [], []
    while i < len(above):
        if above[i] >= mix.served((at + 1) * window)[queue]:  # mostly the next window, but a small source skips many
            at = mix.window_at(queue, int(above[i]), window)
        got, nxt = mix.served(at * window), mix.served((at + 1) * window)
        (b0, e0), (b1, e1) = _served_below(way, got[queue]), _served_below(way, nxt[queue])
        windows.append(at)
        edges.append(e0)
        before.append(sum(nxt[:queue]) - sum(got[:queue]) + b1 - b0)
        i, at = int(np.searchsorted(above, nxt[queue])), at + 1
    return [*edges, e1], before, windows


def _piece_rows(totals: list[int], targets: list[int], window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(totals, targets)
        for batch in batches:
            for part, data, offsets in blocks(batch, "ids"):
                queue, pid, place, n, step = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("queue", "pid", "place", "n", "step"))
                pieces = []
                groups = defaultdict(list)
                for row, group in enumerate(zip(queue.tolist(), pid.tolist(), part.column("source").to_pylist())):
                    groups[group].append(row)
                for (q, _, _), some in groups.items():
                    own = np.array(some)
                    begin, end = int(place[own].min()), int((place[own] + n[own]).max())
                    way = part.column("way")[int(own[0])].as_py()
                    if way is not None:
                        edges, before, windows = _shared_edges(mix, q, way, begin, end, window)
                    else:
                        first = mix.window_at(q, begin, window)
                        at, edges, before = first, [], []
                        while True:
                            got = mix.served(at * window)
                            edges.append(got[q])
                            if got[q] >= end:
                                break
                            nxt = mix.served((at + 1) * window)
                            before.append(sum(nxt[:q]) - sum(got[:q]))
                            at += 1
                        windows = list(range(first, at))
                    pieces.append(_cut(own, place[own], n[own], np.array(edges), np.array(before), np.array(windows)))
                doc, start, length, seq, off = (np.concatenate(x) for x in zip(*pieces))
                order = np.lexsort((start, doc))
                doc, start, length, seq, off = (x[order] for x in (doc, start, length, seq, off))
                wide = data.view("<u2" if step[0] == 2 else "<u4").astype("<u4")
                lo = offsets[doc] // step[0] + start
                at = np.zeros(len(doc) + 1, np.int32)
                np.cumsum(length * 4, out=at[1:])
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(_gathered(wide, lo, length))])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(doc)), part.column("source").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(seq), pa.array(off), ids],
                    names=["doc", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return rows


def _gathered(values: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """values[lo:lo+length] of all pieces, one after another."""
    out = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
    return np.ascontiguousarray(values[out])


def _cut(own: np.ndarray, place: np.ndarray, n: np.ndarray, edges: np.ndarray, before: np.ndarray, windows: np.ndarray):
    """Pieces of documents at the edges of windows: (row, start, length, window, offset)."""
    lo = np.searchsorted(edges, place, "right") - 1
    hi = np.searchsorted(edges, place + n, "left")
    count = hi - lo
    row = np.repeat(np.arange(len(own)), count)
    w = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(edges[w], place[row])
    stop = np.minimum(edges[w + 1], (place + n)[row])
    full = stop > begin
    row, w, begin, stop = row[full], w[full], begin[full], stop[full]
    return own[row], begin - place[row], stop - begin, windows[w], before[w] + begin - edges[w]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", source: str = "source", window: int = 4096, end: int = 2,
         queues: int = 256, targets: Mapping[str | None, int] | None = None) -> DataFrame:
    """Pieces of all documents: `doc`, `source`, `start` (ids of the document before the piece), `length`, `doc_tokens`,
    `sequence_id`, `offset` in the sequence and `ids` (little-endian 32-bit). `targets` gives the proportion of sources in
    every window, as positive integers; by default each source's share of all tokens. A source without a target keeps its
    share of the whole. `queues` sources besides those with a target are served by the due order, the others through the tree. Only the last sequence is shorter than `window` and so the only one with padding."""
    spark = docs.sparkSession
    ready(spark)
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    doc = base.schema["doc"]
    ids = stored(base.mapInArrow(_encode_rows(path, end), T.StructType([
        doc, T.StructField("source", T.StringType()), T.StructField("pid", T.IntegerType()), T.StructField("begin", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("step", T.IntegerType()), T.StructField("ids", T.BinaryType())])), "token-ids")
    sizes = ids.groupBy("pid", "source").agg(F.sum("n").alias("n"))
    by_source = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    named = by_source.filter(_is_in(targets)).collect() if targets else []  # at most a row per target
    if targets and (missing := {*targets} - {r["source"] for r in named}) and ids.limit(1).count():
        raise ValueError(f"targets for sources that are not there: {sorted(map(str, missing))}")
    largest = named + by_source.filter(~_is_in(targets)).orderBy(F.col("n").desc(), F.col("source").asc_nulls_last()).limit(queues).collect()  # at most `queues` rows
    rest = (by_source.agg(F.sum("n")).first()[0] or 0) - sum(r["n"] for r in largest)
    totals = [r["n"] for r in largest] + ([rest] if rest else [])
    out = T.StructType([doc, T.StructField("source", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")], T.StructField("ids", T.BinaryType())])
    if not totals:
        return spark.createDataFrame([], out)
    weights = list(totals)
    if targets:
        asked, known = sum(targets.values()), sum(r["n"] for r in named)
        weights = [targets[r["source"]] * known for r in named] + [r["n"] * asked for r in largest[len(named):]] + ([rest * asked] if rest else [])
    number = spark.createDataFrame([(r["source"], i) for i, r in enumerate(largest)], "_q string, queue int")
    placed = sizes.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("_q")), "left").select("pid", "source", "n", F.coalesce("queue", F.lit(len(largest))).alias("queue"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = placed.select(F.col("pid").alias("_p"), F.col("source").alias("_s"), "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_o"))
    if rest:
        ways = _tree(by_source.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("_q")), "left_anti"))
        offsets = offsets.join(ways, F.col("_s").eqNullSafe(F.col("_w")), "left").drop("_w")
    else:
        offsets = offsets.withColumn("way", F.lit(None).cast("array<long>"))
    offsets = stored(offsets, "queue-offsets")
    sent = F.broadcast(offsets) if offsets.count() <= SENT_ROWS else offsets.hint("merge")
    at = ids.join(sent, (F.col("pid") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).select("doc", "source", "pid", "queue", "way", (F.col("_o") + F.col("begin")).alias("place"), "n", "step", "ids")
    return at.mapInArrow(_piece_rows(totals, weights, window), out)


def _is_in(targets: Mapping[str | None, int] | None) -> Column:
    names = [t for t in targets or {} if t is not None]
    return F.coalesce(F.col("source").isin(names), F.lit(None in (targets or {})))


def _tree_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ways of a block's sources, larger ones first, and the sum of the block."""
    pdf = pdf.sort_values(["n", "_w"], ascending=[False, True], ignore_index=True)
    return pd.DataFrame({"_w": pdf["_w"], "_b": pdf["_b"], "_n": pdf["n"].sum(), "way": _ways(pdf["n"].tolist())})


def _tree(sources: DataFrame) -> DataFrame:
    """The way (`_w` source, `way`) of every source up one tree over all of `sources`(source, n)."""
    count = -(-sources.count() // TREE_ROWS)
    own = sources.select(F.col("source").alias("_w"), "n", F.pmod(F.xxhash64("source"), F.lit(count)).alias("_b"))
    inner = stored(own.groupBy("_b").applyInPandas(_tree_rows, "_w string, _b long, _n long, way array<long>"), "source-tree")
    sums = inner.select("_b", "_n").distinct().orderBy("_b").collect()  # a row per block of sources
    outer = sources.sparkSession.createDataFrame(list(zip([r["_b"] for r in sums], _ways([r["_n"] for r in sums]))), "_k long, above array<long>")
    return inner.join(F.broadcast(outer), F.col("_b") == F.col("_k")).select("_w", F.concat("way", "above").alias("way"))
