"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

A unit vector is padded to a power of two, turned by a seeded random rotation (sign flips and Walsh-Hadamard steps) and kept
as the signs of what comes out: x, scaled to length 1. With f = <x, o> stored beside the code of a vector o, <x, q> / f is an
unbiased estimate of <o, q> for every turned unit vector q, off by at most g * sqrt(1 - <o, q>^2) * |u|, where
g = sqrt(1 - f^2) / f is the second stored factor and u the cosine between two directions that the rotation makes random.
A pair of cosine t or more therefore has an estimate of at least t - g * sqrt(1 - t^2) for certain (|u| <= 1), or of
t - g * sqrt(1 - t^2) * `deviations` / sqrt(d - 1) with the confidence of so many deviations. Only pairs that reach this are
recomputed from the exact vectors, in doubles.

Pairs are looked for among vectors of one label and length. Groups of over `bucket` vectors are cut into buckets by bits of
further rotations: b bits leave about `bucket` vectors to each, and as many independent bands of b bits are used as a pair
of cosine t needs to meet in one of them with probability `recall`. Groups up to `bucket` take no bits, so every pair meets.
Buckets are dealt into blocks of BLOCK vectors; a task holds two blocks and emits link counts per vector and the edges of a
spanning forest, never pairs. A pair that meets in several bands counts in the first. Equal vectors of a label are one entry
with its number of copies, however many there are.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows without a label, link with
nothing and are their own component; vectors of different lengths do not link; repeated rows are vectors of their own and
link; a component's id is its smallest non-null id; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.simhash import components, forest
from gridloom.llm.tables import ready, stored

BUCKET = 4096
BLOCK = 1024
PIECE = 1 << 22  # bytes of gathered vectors at a time
SLACK = 1e-4  # rounding of estimates, which are made in single precision
_signs: dict[tuple[int, int], np.ndarray] = {}


def _padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


def rotated(m: np.ndarray, seed: int) -> np.ndarray:
    """The rows of `m`, padded to a power of two and turned by rotation number `seed`."""
    size = _padded(m.shape[1])
    if (size, seed) not in _signs:
        _signs[size, seed] = np.random.default_rng((1913, size, seed)).choice(np.array([-1.0, 1.0], np.float32), (3, size))
    out = np.zeros((len(m), size), np.float32)
    out[:, :m.shape[1]] = m
    for flips in _signs[size, seed]:
        out *= flips
        half = 1
        while half < size:
            pair = out.reshape(len(m), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(m), size)
            half *= 2
        out /= np.float32(math.sqrt(size))
    return out


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary codes (bytes per row) and f of unit vectors."""
    turned = rotated(unit, 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1, dtype=np.float64) / math.sqrt(turned.shape[1])


def estimates(turned: np.ndarray, codes: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Estimated inner products of turned unit vectors (rows) with coded ones (columns)."""
    size = turned.shape[1]
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    return (turned @ signs.T) / (np.float32(math.sqrt(size)) * f.astype(np.float32))


def bands(bits: int, least: float, recall: float) -> int:
    """Bands of `bits` bits in which a pair of cosine `least` meets at least once with probability `recall`."""
    if not bits:
        return 1
    agree = (1 - math.acos(least) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-agree)))


def band_keys(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """`count` keys of `bits` bits for each row, from rotations 1, 2, ..."""
    if not bits:
        return np.zeros((len(unit), 1), np.int64)
    size = _padded(unit.shape[1])
    signs = np.concatenate([rotated(unit, 1 + r) > 0 for r in range(-(-bits * count // size))], axis=1)[:, :bits * count]
    return signs.reshape(len(unit), count, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _encode_rows(least: float, recall: float, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits = batch.column("dim").to_numpy(), batch.column("bits").to_numpy()
            for dim, b in sorted(set(zip(dims.tolist(), bits.tolist()))):
                part = batch.filter(pa.array((dims == dim) & (bits == b)))
                m = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                unit = _unit(m.astype(np.float64))
                code, f = codes_of(unit)
                keys = band_keys(unit, b, bands(b, least, recall))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ("e", "label", "dim", "copies")], pa.array([x.tobytes() for x in m.astype(kind)], pa.binary()),
                    pa.array([x.tobytes() for x in code], pa.binary()), pa.array(f),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))],
                    names=["e", "label", "dim", "copies", "vec", "code", "f", "keys"])
    return rows


class _Block:
    """The members of one block as arrays."""

    def __init__(self, members: pa.StructArray, dim: int, kind: str):
        def fixed(name: str, dtype, width: int) -> np.ndarray:
            return np.frombuffer(b"".join(members.field(name).to_pylist()), dtype).reshape(-1, width)
        self.e, self.copies = (members.field(c).to_numpy(zero_copy_only=False) for c in ("e", "copies"))
        self.f = members.field("f").to_numpy(zero_copy_only=False)
        self.vec = fixed("vec", kind, dim).astype(np.float64)
        self.code = fixed("code", np.uint8, _padded(dim) // 8)
        self.keys = members.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(self.e), -1)
        scale = np.abs(self.vec).max(1)
        self.vec = np.where(((scale < 1e-100) | (scale > 1e100))[:, None], self.vec / scale[:, None], self.vec)  # squares stay in range
        self.norm = np.sqrt((self.vec * self.vec).sum(1))


def near_pairs(a: _Block, b: _Block, least: float, deviations: float | None, same: bool) -> tuple[np.ndarray, int]:
    """Which pairs of two blocks have a cosine of `least` or more, and how many were recomputed exactly."""
    dim = a.vec.shape[1]
    tight = 1.0 if deviations is None else min(1.0, deviations / math.sqrt(max(1, dim - 1)))
    turned = rotated(a.vec / a.norm[:, None], 0)
    floor = (least - np.sqrt(np.maximum(0, 1 - b.f ** 2)) / b.f * math.sqrt(1 - least * least) * tight - SLACK).astype(np.float32)
    near, exact = np.zeros((len(a.e), len(b.e)), bool), 0
    step = max(1, PIECE // (dim * 8))
    for at in range(0, len(a.e), 128):
        open_ = estimates(turned[at:at + 128], b.code, b.f) >= floor
        if same:
            open_ &= np.arange(at, at + len(open_))[:, None] < np.arange(len(b.e))
        i, j = np.nonzero(open_)
        exact += len(i)
        if len(i) * 16 > open_.size:
            cosine = (a.vec[at:at + 128] @ b.vec.T) / (a.norm[at:at + 128, None] * b.norm)
            near[at:at + 128] = open_ & (cosine >= least)
            continue
        for lo in range(0, len(i), step):
            x, y = i[lo:lo + step] + at, j[lo:lo + step]
            near[x, y] = (a.vec[x] * b.vec[y]).sum(1) / (a.norm[x] * b.norm[y]) >= least
    return near, exact


def _compare_rows(least: float, deviations: float | None, kind: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, band, same = (batch.column(c)[r].as_py() for c in ("dim", "band", "same"))
                a = _Block(batch.column("members")[r].values, dim, kind)
                b = a if same else _Block(batch.column("others")[r].values, dim, kind)
                near, exact = near_pairs(a, b, least, deviations, same)
                if band:  # pairs that met in an earlier band were counted there
                    i, j = np.nonzero(near)
                    for lo in range(0, len(i), 1 << 16):
                        x, y = i[lo:lo + (1 << 16)], j[lo:lo + (1 << 16)]
                        near[x, y] = ~(a.keys[x, :band] == b.keys[y, :band]).any(1)
                left, right = near @ b.copies, near.T @ a.copies
                edges = np.array(forest(near, a.e, b.e), np.int64).reshape(-1, 2)
                u = np.concatenate([a.e[left > 0], b.e[right > 0], edges[:, 0]])
                n = np.concatenate([left[left > 0], right[right > 0], np.zeros(len(edges), np.int64)])
                v = np.concatenate([np.full(len(u) - len(edges), -1, np.int64), edges[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n), pa.array(np.full(len(u), exact))], names=["u", "v", "n", "exact"])
    return rows


def usable(vector: Column) -> Column:
    """The vector without negative zeros; null when it is null, empty, zero or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.transform(vector, lambda x: F.when(x == 0, F.abs(x)).otherwise(x)))


def near_vectors(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 recall: float = 0.999, deviations: float | None = None, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors`: `vec_id`, `n_links` (other vectors of its label with a cosine of `least` or more) and
    `component_id`. `deviations`: see above; None is the certain bound."""
    if not 0 < least < 1 or not 0 < recall < 1:
        raise ValueError("least and recall must be between 0 and 1")
    spark = vectors.sparkSession
    ready(spark)
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind, plain = ("<f4", F.col(vector)) if single else ("<f8", F.col(vector).cast("array<double>"))
    own = stored(vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.when(F.col(label).isNotNull(), usable(plain)).alias("v")).withColumn("h", F.xxhash64("label", "v")), "vectors")
    entries = own.filter(F.col("v").isNotNull()).groupBy("h", "label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    entries = stored(entries.withColumn("dim", F.size("v")).withColumn("e", F.monotonically_increasing_id()), "entries")
    sizes = entries.groupBy("label", "dim").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / F.lit(bucket)) - F.lit(1e-9))).cast("int").alias("bits"))
    schema = T.StructType([T.StructField("e", T.LongType()), entries.schema["label"], *T.StructType.fromDDL("dim int, copies long, vec binary, code binary, f double, keys array<long>").fields])
    coded = entries.join(sizes, ["label", "dim"]).select("e", "label", "dim", "copies", "v", "bits").mapInArrow(_encode_rows(least, recall, kind), schema)
    coded = stored(coded, "codes")
    place = ["label", "dim", "band", "val"]
    dealt = coded.select("*", F.posexplode("keys").alias("band", "val"))
    full = dealt.select(*place).groupBy(*place).count().withColumn("blocks", F.ceil(F.col("count") / F.lit(block))).filter("blocks > 1").drop("count")
    dealt = dealt.join(full, place, "left").withColumn("blk", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("e"), F.col("blocks"))))
    lists = dealt.groupBy(*place, "blk").agg(F.collect_list(F.struct("e", "copies", "vec", "code", "f", "keys")).alias("members"))
    lists = stored(lists, "blocks")
    others = lists.select(*place, F.col("blk").alias("other"), F.col("members").alias("others"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blk").cast("long"))).alias("blk"))
    met = lists.withColumn("blk", F.col("blk").cast("long")).join(others, [*place, "blk"])  # a pair of blocks each, spread by its first block
    met = met.select("dim", "band", (F.col("blk") == F.col("other")).alias("same"), "members", "others")
    found = stored(met.mapInArrow(_compare_rows(least, deviations, kind), "u long, v long, n long, exact long"), "links")
    counts = found.filter("v < 0").groupBy(F.col("u").alias("e")).agg(F.sum("n").alias("n"))
    hubs = components(found.filter("v >= 0").select("u", "v")).select(F.col("node").alias("e"), "root")
    placed = entries.select("e", "h", "label", "v", "copies", "rep").join(counts, "e", "left").join(hubs, "e", "left").withColumn("root", F.coalesce("root", "e"))
    placed = stored(placed, "placed")
    least_id = placed.groupBy("root").agg(F.min("rep").alias("component"))
    placed = placed.join(least_id, "root").select("h", F.col("v").alias("_v"), F.col("label").alias("_label"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    out = own.join(placed, (own["h"] == placed["h"]) & (own["v"] == placed["_v"]) & (own["label"] == placed["_label"]), "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
