"""Exact top-k search by inner product with vector-approximation files.

Components are whole numbers, floor(scale * x), kept as doubles, which hold them exactly. The approximation file has one byte
per component: the number of its cell. The borders of a dimension's inner cells are evenly spaced ones and quantiles of a sample;
one more cell on either end takes what lies far off, so that a broken value widens its own cell and no other. A cell's
ends are the borders, for the outermost ones the smallest and largest value of all rows. Scanning the file gives a lower and
an upper bound of each inner product (a cell's ends, taken by the sign of the query's component). The first scan keeps the
best lower bounds per query, whose last is a floor that the kth result cannot fall below; the second scan keeps the vectors
whose upper bound reaches it. Exact vectors are then read best bound first: a first wave settles a higher floor, and only
vectors whose bound still reaches it are read after that, so the kth result is certain whatever the borders.

Queries meet the file in blocks: they are broadcast up to ASK_BYTES, and packed on both sides and joined by shard beyond.
Equal vectors are one entry with their k + 1 first rows, however many there are, and equal query vectors are searched once.

Defined cases: vectors that are null, empty or hold a component that is null or not finite (scaled, too) take no part, nor do
null ids; every row is a vector of its own, also where ids repeat; vectors meet only vectors of their length; scores beyond 64
bits are cut to that; ties go to the smaller id; an empty table gives no row; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.tables import ready, stored
from gridloom.operators.scale import top_per_key

CELLS = 64
SAMPLE = 1 << 22  # components of the sample that the borders are taken from
FAR, QUANTILES = 3, 30  # interquartile ranges from the quartiles to the far ends; borders that are quantiles
ASK_BYTES = 8 << 20
SAFE = 1 << 26  # products of smaller numbers are summed in 64 bits
QUERY_BLOCK, DATA_BLOCK = 256, 2048
FIRST_WAVE = 4  # times k + 1 exact vectors per query


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as doubles; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    # floor() of a double is a long, so larger values, whole numbers all of them, go past it
    floor = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: floor(x.cast("double") * scale)))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, part in _by_dim(batch):
            m = _matrix(part.column("v"), dim)
            lo, hi = m.min(0), m.max(0)
            if dim in ends:
                lo, hi = np.minimum(lo, ends[dim][0]), np.maximum(hi, ends[dim][1])
            ends[dim] = lo, hi
    for dim, (lo, hi) in ends.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(lo), pa.array(hi)], names=["dim", "pos", "lo", "hi"])


def inner_borders(sample: np.ndarray) -> np.ndarray:
    """CELLS - 1 borders of every column (a row each): evenly spaced ones from one far end to the other, and quantiles."""
    q1, q3 = np.quantile(sample, [0.25, 0.75], axis=0, method="lower")
    with np.errstate(all="ignore"):
        low, high = np.maximum(np.floor(q1 - FAR * (q3 - q1)), -1e307), np.minimum(np.ceil(q3 + FAR * (q3 - q1)) + 1, 1e307)
    even = np.ceil(low + (high - low) * np.linspace(0, 1, CELLS - 1 - QUANTILES)[:, None])
    inner = np.quantile(np.clip(sample, low, high), np.linspace(0, 1, QUANTILES + 2)[1:-1], axis=0, method="lower")
    return np.sort(np.concatenate([even, np.ceil(inner)]), axis=0).T


def _border_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    dim = int(pdf["dim"].iloc[0])
    got = inner_borders(np.concatenate(pdf["v"].to_list()).reshape(-1, dim))
    return pd.DataFrame({"dim": np.int32(dim), "pos": np.arange(dim, dtype=np.int32), "borders": [x.tolist() for x in got]})


class Grid:
    """The cells of the dimensions of vectors of one length."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, borders: np.ndarray):
        self.borders = borders  # a value belongs to the cell numbered by how many borders it reaches
        self.low = np.concatenate([lo[:, None], borders], axis=1)
        self.high = np.concatenate([borders - 1, hi[:, None]], axis=1)  # values are whole numbers
        large = np.abs(self.high) >= 2.0**53
        self.high[large] = np.nextafter(self.high[large], np.inf)  # where 1 is too little to count
        self.low, self.high = np.maximum(self.low, lo[:, None]), np.minimum(self.high, hi[:, None])

    def encode(self, m: np.ndarray) -> np.ndarray:
        out = np.empty(m.shape, np.uint8)
        for pos in range(m.shape[1]):
            out[:, pos] = np.searchsorted(self.borders[pos], m[:, pos], "right")
        return out

    def ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.arange(codes.shape[1])
        return self.low[pos, codes], self.high[pos, codes]


def _grid(cells: list) -> Grid:
    """The cells of one length; evenly spaced where the sample held none of its vectors."""
    lo, hi = (np.array([r[c] for r in cells], np.float64) for c in ("lo", "hi"))
    even = np.ceil(lo[:, None] + (hi / CELLS - lo / CELLS)[:, None] * np.arange(1, CELLS))
    return Grid(lo, hi, np.array([e if r["borders"] is None else r["borders"] for r, e in zip(cells, even)], np.float64))


def _packed(size: int, encode):
    """Rows of equal dimension as blocks of at most `size`: ids, vectors as bytes and, for queries, their floors."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_dim(batch):
                for at in range(0, part.num_rows, size):
                    some = part.slice(at, size)
                    floors = some.column("floor").to_numpy(zero_copy_only=False).astype(np.float64) if "floor" in some.schema.names else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), pa.array([some.column("g").to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                        pa.array([encode(_matrix(some.column("v"), dim), dim).tobytes()], pa.binary()), pa.array([floors.tobytes()], pa.binary())], names=["dim", "g", "v", "floor"])
    return rows


def _bounds(row: dict, grid: dict[int, Grid]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the queries and vectors of a pair of blocks, with the lower and upper bounds (queries x vectors) within 64 bits."""
    dim = row["dim"]
    q = np.frombuffer(row["qv"], np.float64).reshape(-1, dim)
    low, high = grid[dim].ends(np.frombuffer(row["v"], np.uint8).reshape(-1, dim))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(all="ignore"):  # sums beyond all numbers bound nothing
        slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)  # rounding of large sums
        slack = np.where(slack < 0.25, 0, slack)
        lower, upper = up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack
    lower, upper = np.where(np.isnan(lower), -np.inf, lower), np.where(np.isnan(upper), np.inf, upper)
    return np.frombuffer(row["qg"], np.int64), np.frombuffer(row["g"], np.int64), np.clip(lower, -2.0**63, 2.0**63), np.clip(upper, -2.0**63, 2.0**63)


def _floor_rows(grid, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qg, _, lower, _ = _bounds(row, grid)
                best = -np.partition(-lower, k - 1, axis=1)[:, :k] if lower.shape[1] > k else lower
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qg, best.shape[1])), pa.array(best.ravel())], names=["q", "bound"])
    return rows


def _candidate_rows(grid):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qg, g, _, upper = _bounds(row, grid)
                i, j = np.nonzero(upper >= np.frombuffer(row["floor"], np.float64)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(qg[i]), pa.array(g[j]), pa.array(upper[i, j])], names=["q", "g", "bound"])
    return rows


def _exact_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inner products of pairs of vectors, exact: in 64 bits where they fit for certain, as whole numbers of any size else."""
    for batch in batches:
        score = np.zeros(batch.num_rows, np.int64)
        sizes = batch.column("_a").value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == dim)
            a, b = (_matrix(batch.column(c).take(pa.array(some)), dim) for c in ("_a", "_b"))
            small = (np.abs(a).max(1) * np.abs(b).max(1) * dim < 2.0**62) & (np.abs(a).max(1) < SAFE) & (np.abs(b).max(1) < SAFE)
            score[some[small]] = (a[small].astype(np.int64) * b[small].astype(np.int64)).sum(1)
            for i in np.flatnonzero(~small).tolist():
                exact = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist()))
                score[some[i]] = max(-(1 << 63), min((1 << 63) - 1, exact))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("g"), pa.array(score)], names=["q", "g", "score"])


def _exact(pairs: DataFrame, asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Inner products of candidate pairs from the exact vectors."""
    both = pairs.select("q", "g").join(entries.select("g", F.col("v").alias("_b")), "g").join(asked.select(F.col("g").alias("q"), F.col("v").alias("_a")), "q")
    return both.select("q", "g", "_a", "_b").mapInArrow(_exact_rows, "q long, g long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id` and `score` of the k best other vectors of every query, exact."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole_numbers(F.col(vector), scale).alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = stored(rows.withColumn("r", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("v")), "vectors")
    some = top_per_key(rows, ["h", "v"], [F.col("id"), F.col("r")], k + 1)
    entries = some.groupBy("h", "v").agg(F.collect_list(F.struct("id", "r")).alias("rows"))  # k + 1 rows at most
    entries = stored(entries.select(F.monotonically_increasing_id().alias("g"), F.size("v").alias("dim"), "h", "v", "rows"), "entries")
    ends = entries.select("dim", "v").mapInArrow(_range_rows, "dim int, pos int, lo double, hi double").groupBy("dim", "pos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    share = F.greatest(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("dim")) / F.col("_c")  # of the entries of one length, by their hash: about SAMPLE components
    sample = entries.join(entries.groupBy("dim").agg(F.count("*").alias("_c")), "dim").filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    borders = sample.select("dim", "v").groupBy("dim").applyInPandas(_border_rows, "dim int, pos int, borders array<double>")
    cells = ends.join(borders, ["dim", "pos"], "left").orderBy("dim", "pos").collect()  # a row per dimension
    grid = {d: _grid([r for r in cells if r["dim"] == d]) for d in {r["dim"] for r in cells}}
    queries = stored(rows.filter(is_query).join(entries.select("h", F.col("v").alias("_v"), "g"), "h").filter(F.col("v") == F.col("_v")).select("id", "r", "g"), "queries")
    asked = stored(entries.join(queries.select("g").distinct(), "g").select("g", "dim", "v"), "query-vectors")
    files = entries.select("g", "dim", "v").mapInArrow(_packed(DATA_BLOCK, lambda m, d: grid[d].encode(m)), "dim int, g binary, v binary, floor binary").drop("floor")
    files = stored(files, "approximations")

    def scan(asked: DataFrame, made, schema: str) -> DataFrame:
        blocks = stored(asked.mapInArrow(_packed(QUERY_BLOCK, lambda m, d: m), "dim int, g binary, v binary, floor binary"), "query-blocks")
        size = blocks.agg(F.sum(F.octet_length("v"))).first()[0] or 0
        blocks = blocks.select("dim", F.col("g").alias("qg"), F.col("v").alias("qv"), "floor")
        if size <= ASK_BYTES:
            return files.join(F.broadcast(blocks), "dim").mapInArrow(made, schema)
        shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        return files.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards))).hint("merge").join(blocks, ["dim", "shard"]).mapInArrow(made, schema)

    best = top_per_key(scan(asked, _floor_rows(grid, k + 1), "q long, bound double"), ["q"], [F.col("bound").desc()], k + 1)
    floors = best.groupBy("q").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).select(F.col("q").alias("g"), F.when(F.col("n") > k, F.col("bound")).otherwise(float("-inf")).alias("floor"))
    found = stored(scan(asked.join(floors, "g"), _candidate_rows(grid), "q long, g long, bound double"), "candidates")
    first = stored(_exact(top_per_key(found, ["q"], [F.col("bound").desc(), F.col("g")], FIRST_WAVE * (k + 1), "_n"), asked, entries), "first-wave")
    sure = top_per_key(first, ["q"], [F.col("score").desc(), F.col("g")], k + 1, "_m").groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    rest = found.join(sure.filter(F.col("n") > k).select("q", "least"), "q").filter(F.col("bound") >= F.col("least"))
    rest = rest.join(first.select("q", "g"), ["q", "g"], "left_anti")
    scored = first.unionByName(_exact(rest, asked, entries))
    listed = scored.join(entries.select("g", "rows"), "g").select("q", "score", F.explode("rows").alias("e")).select("q", "score", F.col("e.id").alias("vec_id"), "e.r")
    listed = top_per_key(listed, ["q"], [F.col("score").desc(), F.col("vec_id"), F.col("r")], k + 1, "_n").drop("_n")
    others = queries.select(F.col("id").alias("query_id"), F.col("r").alias("_own"), F.col("g").alias("q")).join(listed, "q").filter(F.col("r") != F.col("_own"))
    return top_per_key(others, ["query_id", "_own"], [F.col("score").desc(), F.col("vec_id"), F.col("r")], k, "rank").select("query_id", "rank", "vec_id", "score")
