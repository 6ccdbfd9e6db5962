"""Spelling variants by a relational trie frontier: words one edit apart, found by walking a trie as a table.

The trie's edges are rows (parent, code point, child), spread over all tasks. A state is (word and position, node, edits): a
word that has read so many of its letters, the trie node it has reached and the edits spent. Words that share their first
letters share the state, so (word, position) is itself the node of those letters, and a state without an edit stands on that
very node. Spending the edit there gives the frontier: a replaced letter pairs two children of a node, an inserted or
deleted one pairs a child with its parent. From then on both sides must read the same letters: each level joins the frontier
with the edge table on both sides. Every node keeps 64 bits of hashed rests (what its words have left to read); a state whose
sides have no rest in common leaves. A state with at most `small` words on one side is finished at once: the rests of those
words are looked up among the other side's places. Two word ends that meet are neighbours; each is checked on the strings.

After LEVELS levels `small` grows fourfold a level, so the number of levels follows the logarithm of the words even where
long words share nearly all of their letters.

Defined cases: a null text has no word, a null id is an empty string in the hash; repeated rows count; a word far longer than
others is one more word (its trie nodes are rows); ties go to the word first in code-point order; an empty table gives an
empty result; other columns are not read.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.arrays import BYTE_VALUES, LOWER, Words, blocks, raw, run_hashes
from gridloom.llm.tables import ready, stored

LEVELS = 8
SMALL = 16
HELD = 1 << 25  # bytes of text whose words a task counts before it sends them on
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Maximal runs of letters up to U+00FF (C3 leads exactly U+00C0 to U+00FF in UTF-8), and their code points."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    w = Words(data, offsets, inside)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return w, w.ends - w.starts - (leads[w.ends] - leads[w.starts])


def _count_rows(least: int, every: int):
    """Words of the texts with their number; of one run in `every` (by the crc32 of id and run) a code point is left out."""
    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Counter(), 0
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                start = [zlib.crc32(f"{'' if d is None else d}:".encode()) for d in part.column("doc").to_pylist()]
                low = LOWER[data]
                w, size = runs(low, offsets)
                long, text = np.flatnonzero(size >= least), w.text_of()
                line = low.tobytes()
                for at in range(0, len(long), 1 << 16):
                    some = long[at:at + (1 << 16)]
                    words = [line[a:b] for a, b in zip(w.starts[some].tolist(), w.ends[some].tolist())]
                    if every:
                        for k, (x, t) in enumerate(zip(words, text[some].tolist())):
                            h = zlib.crc32(x, start[t])
                            if h % every == 0:
                                plain = x.decode()
                                cut = h % len(plain)
                                words[k] = (plain[:cut] + plain[cut + 1:]).encode() if len(plain) > least else None
                    seen.update(words)
                held += len(data)
                if held > HELD:
                    seen.pop(None, None)
                    yield batch_of(seen)
                    seen, held = Counter(), 0
        seen.pop(None, None)
        if seen:
            yield batch_of(seen)
    return rows


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, occurrences: int = 5, every: int = 199) -> DataFrame:
    """`word`, `n` of the words of at least so many code points and occurrences."""
    ready(docs.sparkSession)
    base = docs.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    return base.mapInArrow(_count_rows(letters, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, position) rows: the trie node of the letters read, its parent and last letter, and the hash of the rest."""
    for batch in batches:
        for part, data, offsets in blocks(batch, "word", 1 << 17):
            plain = bytes(data).decode()  # letters up to U+00FF: a byte each below
            size = np.array([len(x) for x in part.column("word").to_pylist()], np.int64)
            values = BYTE_VALUES[np.frombuffer(plain.encode("latin-1"), np.uint8)]
            letter = np.frombuffer(plain.encode("latin-1"), np.uint8)
            first = np.cumsum(size) - size
            count = size + 1
            begin, end = np.repeat(first, count), np.repeat(first + size, count)
            at = begin + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node, rest = run_hashes(values, begin, at), run_hashes(values, at, end)
            root = at == begin
            yield pa.RecordBatch.from_arrays([
                pa.array(run_hashes(values, begin, end).view(np.int64)), pa.array(node.view(np.int64)), pa.array(rest.view(np.int64)),
                pa.array(np.roll(node, 1).view(np.int64), mask=root), pa.array(letter[np.maximum(at - 1, 0)].astype(np.int32), mask=root), pa.array(at == end)],
                names=["w", "node", "rest", "parent", "c", "end"])


def _id_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, _, _ in blocks(batch, "word"):
            flat, at = raw(pa.array([x.encode("latin-1") for x in part.column("word").to_pylist()], pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(run_hashes(BYTE_VALUES[flat], at[:-1], at[1:]).view(np.int64))], names=["word", "n", "w"])


def _ends(df: DataFrame, left: Column, right: Column) -> DataFrame:
    return df.select(F.least(left, right).alias("x"), F.greatest(left, right).alias("y"))


def neighbours(words: DataFrame, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """Pairs of the distinct `word`s one inserted, deleted or replaced code point apart: (x, y, n_x, n_y), each once."""
    ready(words.sparkSession)
    named = stored(words.select("word", "n").mapInArrow(_id_rows, "word string, n long, w long"), "words")
    places = stored(named.select("word").mapInArrow(_place_rows, "w long, node long, rest long, parent long, c int, end boolean"), "places")
    bit = F.expr("shiftleft(1L, cast(pmod(rest, 64) as int))")
    nodes = places.groupBy("node", "parent", "c").agg(F.count("*").alias("n"), F.bit_or(bit).alias("mask"), F.max("end").alias("end"))
    nodes = stored(nodes, "nodes")
    above = nodes.filter("n > 1").select(F.col("node").alias("parent"), F.col("n").alias("p_n"), F.col("mask").alias("p_mask"), F.col("end").alias("p_end"))
    edges = stored(nodes.join(above, "parent"), "edges")  # below one word alone nothing branches

    def side(name: str, on: str) -> DataFrame:
        return edges.select(F.col("parent").alias(on), F.col("c").alias(f"{name}_c"), F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("mask").alias(f"{name}_mask"), F.col("end").alias(f"{name}_end"))

    meet = F.col("a_mask").bitwiseAND(F.col("b_mask")) != 0
    kept = ["a", "a_n", "b", "b_n", (F.col("a_end") & F.col("b_end")).alias("met")]
    replaced = side("a", "_p").join(side("b", "_p"), "_p").filter((F.col("a_c") < F.col("b_c")) & meet).select(*kept)
    inserted = edges.select(F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), F.col("end").alias("a_end"),
                            F.col("parent").alias("b"), F.col("p_n").alias("b_n"), F.col("p_mask").alias("b_mask"), F.col("p_end").alias("b_end")).filter(meet).select(*kept)
    frontier = stored(replaced.unionByName(inserted), "frontier")
    few, closing, met = F.least("a_n", "b_n"), [], []
    level = 0
    while True:
        most = small * 4 ** max(0, level - levels)
        closing.append(frontier.filter(few <= most))
        wide = frontier.filter(few > most)
        met.append(_ends(wide.filter("met"), F.col("a"), F.col("b")))
        if wide.isEmpty():
            break
        step = wide.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(side("a", "_a"), "_a").join(side("b", "_b"), "_b").filter((F.col("a_c") == F.col("b_c")) & meet)
        frontier = stored(step.select(*kept), "frontier")
        level += 1
    some = reduce(DataFrame.unionByName, closing)
    swap = F.col("a_n") > F.col("b_n")
    some = some.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"))
    rests = some.join(places.select("node", F.col("w").alias("one"), "rest"), "node").select(F.col("other").alias("node"), "rest", "one")
    closed = rests.join(places.select("node", "rest", F.col("w").alias("two")), ["node", "rest"])
    pairs = reduce(DataFrame.unionByName, [_ends(closed, F.col("one"), F.col("two")), *met]).distinct()
    for name in ("x", "y"):
        pairs = pairs.withColumnRenamed(name, "w").join(named.select("w", F.col("word").alias(name), F.col("n").alias(f"n_{name}")), "w").drop("w")
    return pairs.filter(F.levenshtein("x", "y", 1) == 1)


def variants(words: DataFrame, factor: int = 5, small: int = SMALL, levels: int = LEVELS) -> DataFrame:
    """`word`, `n`, `n_near`, `form` (the commonest near word, if at least `factor` times as common), `form_n` and `root`
    (the last word that forms lead to) of every row of `words` (word, n)."""
    words = stored(words.select("word", "n"), "counted")
    pairs = stored(neighbours(words, small, levels), "pairs")
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("n_y").alias("near_n")).unionByName(
        pairs.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("n_x").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_b"))
    far = -F.col("_b.less") >= F.col("n") * factor
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("_b.near")).alias("form"), F.when(far, -F.col("_b.less")).alias("form_n"))
    out = stored(out, "forms")
    now = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # counts grow by the factor with every form, so these chains are short; each round doubles its steps
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return out.join(now.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
