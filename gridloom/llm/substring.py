"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the word 8-grams that start in a window, the one with the smallest hash (leftmost of
equals). Equal windows of `words` words choose the same anchor at the same place, so every repeat of that length meets
its copies under one anchor. Documents are joined on anchors that occur twice or more. There each match is extended both
ways, over the run of windows that chose the anchor: all windows of runs that are equal repeat. A run that has no equal is
compared window by window with the other lone runs of its anchor and one of each kind of equal runs. Overlapping windows
merge into maximal repeats.

Nothing is paired inside a group: classes are found by counting (map-side combined), so a passage that a third of all
documents share costs one row per occurrence and map task. Decisions rest on two independent 64-bit hashes.

Defined cases: a null or empty text has no words and keeps none; rows that repeat with the same id and text are copies of
each other, so all their windows repeat; a null id is a value like any other; a text of any length is cut into words by the
task that reads it, with about 100 bytes a word; an empty table gives an empty result; other columns are not read, whatever
their names (`carry` keeps them in a struct).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import blocks, run_hashes, spaced
from gridloom.llm.tables import ready, stored

SEED_WORDS = 8


def _smallest_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i:i+width] for every i, by doubling."""
    best, have = keys, 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    return best


def _seed_rows(words: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = spaced(data, offsets)
                n = len(w.starts)
                if n < words:
                    continue
                ids = w.text_of()
                start = np.flatnonzero(w.first[ids + 1] - np.arange(n) >= words)  # windows inside one text
                if not len(start):
                    continue
                one, two = w.hashes(0), w.hashes(1)
                places = np.arange(n - seed + 1)
                grams = run_hashes(one, places, places + seed, 0)
                keys = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
                anchor = (_smallest_in_window(keys, words - seed + 1)[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
                head = np.flatnonzero(new)
                count = np.diff(np.append(head, len(start)))
                first = start[head]
                text = ids[first]
                # the run's hash holds where its anchor stands, so equal runs are equal window by window
                run = run_hashes(two, first, first + count + words - 1, 1) ^ ((anchor[head] - first).astype(np.uint64) << np.uint64(1))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(text)), part.column("sig").take(pa.array(text)),
                    pa.array(grams[anchor[head]].view(np.int64)), pa.array(run.view(np.int64)),
                    pa.array((first - w.first[text]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["doc", "sig", "anchor", "run", "start", "n"])
    return rows


def _window_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                w = spaced(data, offsets)
                if not len(w.starts):
                    continue
                runs = part.column("runs")
                sizes = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = runs.flatten()
                first = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                count = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                text = np.repeat(np.repeat(np.arange(len(sizes)), sizes), count)
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                place = np.repeat(first, count) + inside
                lone = np.repeat(flat.field("lone").to_numpy(zero_copy_only=False).astype(bool), count)
                at = w.first[text] + place
                one, two = w.hashes(0), w.hashes(1)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc").take(pa.array(text)), part.column("sig").take(pa.array(text)),
                    pa.array(run_hashes(one, at, at + words, 0).view(np.int64)),
                    pa.array(run_hashes(two, at, at + words, 1).view(np.int64)), pa.array(place.astype(np.int32)), pa.array(lone)],
                    names=["doc", "sig", "w1", "w2", "start", "lone"])
    return rows


def _merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, sorted; touching ones stay apart only where a word lies between them."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return starts[head], reach[np.append(head[1:], len(starts)) - 1]


def _ranges(column: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Offsets of the lists of a column into its flat values."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [0, *np.cumsum(sizes).tolist()], column.flatten()


def _apply_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                line, edge = data.tobytes(), offsets.tolist()
                run_at, run = _ranges(part.column("runs"))
                single_at, single = _ranges(part.column("singles"))
                run_start, run_n = (run.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("start", "n"))
                single = single.to_numpy(zero_copy_only=False).astype(np.int64)
                kept, n_words, n_removed, spans, sizes = [], [], [], [], []
                for i in range(part.num_rows):
                    pieces = line[edge[i]:edge[i + 1]].split()
                    total, own, alone = len(pieces), slice(run_at[i], run_at[i + 1]), single[single_at[i]:single_at[i + 1]]
                    starts = np.concatenate([run_start[own], alone])
                    if len(starts):
                        starts, stops = _merged(starts, np.concatenate([run_start[own] + run_n[own] - 1, alone]) + words)
                        edges = np.concatenate([[0], np.column_stack([starts, stops]).ravel(), [total]]).tolist()
                        pieces = [p for a, b in zip(edges[::2], edges[1::2]) for p in pieces[a:b]]
                        spans.append(np.column_stack([starts, stops]))
                    sizes.append(len(starts))
                    kept.append(b" ".join(pieces))
                    n_words.append(total)
                    n_removed.append(total - len(pieces))
                both = np.concatenate([np.zeros((0, 2), np.int64), *spans]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["start", "stop"])
                at = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum(sizes, out=at[1:])
                names = [c for c in part.schema.names if c not in ("text", "runs", "singles")]
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in names], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(at), flat)],
                    names=[*names, "n_words", "n_removed", "kept", "spans"])
    return rows


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 35, seed: int = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two tables keyed by (doc, sig = hash of the text): `runs` of windows that all repeat, and `singles`, the starts of
    those repeated windows that were found one by one."""
    if not 0 < seed <= words:
        raise ValueError("the seed must be 1 to `words` words long")
    ready(docs.sparkSession)
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("sig"), F.col(text).alias("text"))
    doc = base.schema["doc"].dataType
    keys = [T.StructField("doc", doc), T.StructField("sig", T.LongType())]
    seeds = base.filter(F.col("text").isNotNull()).mapInArrow(_seed_rows(words, seed), T.StructType([
        *keys, T.StructField("anchor", T.LongType()), T.StructField("run", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    classes = (seeds.groupBy("anchor").agg(F.count("*").alias("_c"), F.min("run").alias("_lo"), F.max("run").alias("_hi"))
               .filter("_c > 1").select("anchor", (F.col("_lo") == F.col("_hi")).alias("equal")))
    # classes are written before they are joined: a join of two plain tables can be split where one key is hot
    hits = stored(seeds.join(stored(classes, "anchor-classes"), "anchor"), "anchor-hits")
    # where the runs of an anchor differ, equal runs are told apart from lone ones; of equal runs one stands for all
    mixed = hits.filter(~F.col("equal")).withColumn("place", F.struct("doc", "sig", "start"))
    kinds = mixed.groupBy("anchor", "run").agg(F.count("*").alias("c"), F.min("place").alias("stand_in"))
    marked = mixed.join(stored(kinds, "run-kinds"), ["anchor", "run"])
    sure = hits.filter("equal").select("doc", "sig", "start", "n").unionByName(marked.filter("c > 1").select("doc", "sig", "start", "n"))
    runs = sure.groupBy("doc", "sig").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    asked = marked.filter((F.col("c") == 1) | F.col("place").eqNullSafe(F.col("stand_in")))
    asked = asked.groupBy("doc", "sig").agg(F.collect_set(F.struct("start", "n", (F.col("c") == 1).alias("lone"))).alias("runs"))
    texts = base.join(_renamed(asked), _same("doc", "_d") & (F.col("sig") == F.col("_s"))).select("doc", "sig", "text", "runs")
    windows = texts.mapInArrow(_window_rows(words), T.StructType([
        *keys, T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("lone", T.BooleanType())]))
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("_c")).filter("_c > 1").select("w1", "w2")
    singles = windows.filter("lone").join(stored(twice, "windows-twice"), ["w1", "w2"]).groupBy("doc", "sig").agg(F.collect_set("start").alias("singles"))
    return runs, singles


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("doc", "_d").withColumnRenamed("sig", "_s")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 35, seed: int = SEED_WORDS,
                   carry: bool = False) -> DataFrame:
    """One row per row of `docs`: `doc`, `n_words`, `n_removed`, `kept` (the words left, joined by one space) and `spans`,
    the maximal repeats as half-open word ranges. With `carry`, `row` holds the whole input row as a struct."""
    runs, singles = repeated_windows(docs, key, text, words, seed)
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    base = docs.select(F.col(key).alias("doc"), F.xxhash64(F.col(text)).alias("sig"), F.col(text).alias("text"), *own)
    joined = base.join(_renamed(runs), _same("doc", "_d") & (F.col("sig") == F.col("_s")), "left").drop("_d", "_s")
    joined = joined.join(_renamed(singles), _same("doc", "_d") & (F.col("sig") == F.col("_s")), "left").select(*base.columns, "runs", "singles")
    kept = [f for f in base.schema.fields if f.name != "text"]
    out = joined.mapInArrow(_apply_rows(words), T.StructType([
        *kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))]))
    return out.drop("sig")
