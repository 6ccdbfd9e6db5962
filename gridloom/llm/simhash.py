"""SimHash near-duplicates with multi-index hashing.

A fingerprint is cut into segments. Two fingerprints at most `radius` bits apart have a segment at most
radius // segments bits apart, so every segment value probes its small Hamming ball in the table of that segment, and the
complete distance of what it meets is verified. Nothing within the radius is missed.

Equal fingerprints become one node first, so exact copies cost one row however many there are. Large table entries are
dealt into blocks of about BLOCK members; two blocks are compared as arrays and only the edges of a spanning forest leave
the task, never all pairs. Components come from alternating large-star and small-star rounds over those edges.

Defined cases: no words (null, empty, white space) gives fingerprint zero, which links like any other; fewer words than a
shingle form one shingle; repeated rows share their node; a component without any non-null id has a null id; a text
of any length is fingerprinted whole by the task that reads it; an empty table gives an empty result; other columns are not
read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import LOWER, blocks
from gridloom.llm.tables import ready, stored

BITS = 64
SEED = 42
BLOCK = 256  # members of one table entry that are compared at once


def fingerprints_of(texts: list[bytes], shingle: int) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not sizes.sum():
        return out
    flat = [w for words in split for w in words]
    line = b" ".join(flat)
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    stops = np.cumsum(length + 1) - 1
    starts = stops - length
    last = np.cumsum(sizes)
    grams = np.where(sizes > 0, np.maximum(sizes - shingle + 1, 1), 0)
    full = np.flatnonzero(grams)
    inside = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = np.repeat(last - sizes, grams) + inside
    end = np.minimum(begin + shingle, np.repeat(last, grams)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[begin].tolist(), stops[end].tolist())), np.uint64, len(begin))
    votes = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), (np.cumsum(grams) - grams)[full], axis=0, dtype=np.int32)
    out[full] = np.packbits(votes * 2 > grams[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                low = LOWER[data].tobytes()
                at = offsets.tolist()
                got = fingerprints_of([low[a:b] for a, b in zip(at, at[1:])], shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(got.view(np.int64))], names=["doc", "fp"])
    return rows


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """`doc` and its 64-bit fingerprint `fp` (as a signed long)."""
    ready(docs.sparkSession)
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return base.mapInArrow(_fingerprint_rows(shingle), T.StructType([base.schema["doc"], T.StructField("fp", T.LongType())]))


def balls(width: int, radius: int) -> list[int]:
    """All masks of at most `radius` of `width` bits."""
    masks, last = {0}, {0}
    for _ in range(radius):
        last = {m | (1 << b) for m in last for b in range(width)}
        masks |= last
    return sorted(masks)


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a bipartite link matrix connects: each connected set as a star around one of its members."""
    todo, seen, edges = near.any(1), np.zeros(near.shape[1], bool), []
    while todo.any():
        root = int(np.argmax(todo))
        ring = np.array([root])
        todo[root] = False
        while len(ring):
            met = np.flatnonzero(near[ring].any(0) & ~seen)
            seen[met] = True
            edges += [(int(left[root]), int(x)) for x in right[met]]
            ring = np.flatnonzero(near[:, met].any(1) & todo) if len(met) else met
            todo[ring] = False
            edges += [(int(left[root]), int(x)) for x in left[ring]]
    return edges


def _verify_rows(radius: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for a, b in zip(batch.column("members"), batch.column("others")):
                left, right = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
                near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= radius
                edges += [(u, v) for u, v in forest(near, left, right) if u != v]
            if edges:
                pairs = np.array(edges, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])
    return rows


def _long(x: int):
    """A 64-bit pattern as a signed long literal."""
    return F.lit(x - (1 << BITS) if x >> (BITS - 1) else x).cast("long")


def links(nodes: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Edges (u, v) over distinct fingerprints `fp` whose components are those of all pairs within `radius` bits."""
    widths = [BITS // segments + (s < BITS % segments) for s in range(segments)]
    values, shift = [], 0
    for s, width in enumerate(widths):
        values.append(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("fp", shift).bitwiseAND(_long((1 << width) - 1)).alias("val")))
        shift += width
    entries = nodes.select("fp", F.explode(F.array(*values)).alias("_e")).select("fp", "_e.seg", "_e.val")
    large = entries.groupBy("seg", "val").count().filter(F.col("count") > BLOCK)
    dealt = entries.join(large, ["seg", "val"], "left").withColumn(
        "blk", F.when(F.col("count").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / BLOCK))).cast("int"))
    lists = dealt.groupBy("seg", "val", "blk").agg(F.collect_list("fp").alias("members"))
    reach = radius // segments
    ball = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for s, width in enumerate(widths):
        ball = ball.when(F.col("seg") == s, F.array(*[_long(m) for m in balls(width, reach)]))
    probes = lists.withColumn("_mask", F.explode(ball)).withColumn("val", F.col("val").bitwiseXOR(F.col("_mask")))
    probes = probes.filter(F.col("val") >= F.col("val").bitwiseXOR(F.col("_mask")))  # each pair of entries once
    other = lists.select("seg", "val", F.col("blk").alias("_blk"), F.col("members").alias("others"))
    met = probes.join(other, ["seg", "val"]).filter((F.col("_mask") != 0) | (F.col("_blk") >= F.col("blk")))
    single = (F.size("members") == 1) & (F.size("others") == 1)
    u, v = F.element_at("members", 1), F.element_at("others", 1)
    met = met.filter(~single | ((F.bit_count(u.bitwiseXOR(v)) <= radius) & (u != v)))
    return met.select("members", "others").mapInArrow(_verify_rows(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, by alternating stars. Each round is written to the shared folder and
    ends with a hub per set; a hub's edges are split by the skew join."""
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.*").filter("u <> v").distinct(), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, segments: int = 3) -> DataFrame:
    """One row per row of `docs`: `doc`, `fp` and `component`, the smallest id that links of `radius` or fewer bits reach."""
    if not 0 < segments <= BITS:
        raise ValueError("segments must be 1 to 64")
    own = stored(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc").alias("rep"))
    hubs = components(links(nodes.select("fp"), radius, segments))
    placed = nodes.join(hubs, nodes["fp"] == hubs["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    ids = placed.filter(F.col("rep").isNotNull()).groupBy("root").agg(F.min("rep").alias("component"))
    return own.join(placed.join(ids, "root", "left").select("fp", "component"), "fp").select("doc", "fp", "component")
