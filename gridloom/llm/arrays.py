"""Texts of an Arrow column as numpy arrays: words, their hashes and hashes of word runs, without a Python loop per word.

A word's hash mixes its length and its bytes, eight at a time, into a 64-bit state that is scrambled after every step; words
of over LONG bytes take XXH64. The hash of a run of values is a tree: runs of 1, 2, 4, ... values are scrambled pairwise, and
a run is made of those that its length in binary names. Both are far from linear, so no pattern of repeated letters or words
makes two runs collide, as it does with sums of powers modulo 2^64. `which` picks one of three seeds; callers that need more
than 64 bits compare two such hashes, and `same_words` decides on the bytes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 19  # texts are worked on in blocks of this size; a longer text is a block of its own
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)  # ASCII letters and every byte of a longer UTF-8 character
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
ALNUM = LETTER.copy()
ALNUM[48:58] = True

BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
LONG = 64
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_ONE, _TWO = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a lane


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a hash (murmur finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    return mixed(a * _ONE + (b << np.uint64(29) | b >> np.uint64(35)) * _TWO)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs get equal hashes wherever they stand."""
    left = np.asarray(ends - starts, np.int64)
    out = mixed(left.astype(np.uint64) + np.uint64(_SEEDS[which]))
    at, tree, size = np.array(starts, np.int64), values, 1  # tree[i]: the run of `size` values from i on
    while True:
        some = np.flatnonzero(left & size)
        if len(some) == len(left):
            out = _paired(out, tree[at])
            at += size
        elif len(some):
            out[some] = _paired(out[some], tree[at[some]])
            at[some] += size
        if not (left >= 2 * size).any():
            return out
        tree = _paired(tree[:-size], tree[size:])
        size *= 2


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    return np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair."""
    size, lane = ends - starts, lanes(data)
    out = mixed(size.astype(np.uint64) + np.uint64(_SEEDS[which]))
    out = mixed(out ^ (lane[starts] & _KEEP[np.minimum(size, 8)]) * _ONE)
    for at in range(8, LONG, 8):
        some = np.flatnonzero(size > at)
        if not len(some):
            return out
        out[some] = mixed(out[some] ^ (lane[starts[some] + at] & _KEEP[np.minimum(size[some] - at, 8)]) * _ONE)
    long = np.flatnonzero(size > LONG)
    if len(long):
        line = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh64_intdigest(line[a:b], _SEEDS[which]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return out


class Words:
    """Words of the texts of one block. `data` are the bytes, `starts`/`ends` the places of the words in them and
    `first` the number of words before each text (one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = ~inside[:-1]
        after[:-1] = ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def text_of(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        return byte_hashes(self.data, self.starts, self.ends, which)


def same_words(w: Words, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether words left[i] and right[i] are the same bytes."""
    size, lane = w.ends - w.starts, lanes(w.data)
    a, b, n = w.starts[left], w.starts[right], size[left]
    out = n == size[right]
    for at in range(0, LONG, 8):
        some = np.flatnonzero(out & (n > at))
        if not len(some):
            return out
        out[some] = ((lane[a[some] + at] ^ lane[b[some] + at]) & _KEEP[np.minimum(n[some] - at, 8)]) == 0
    line = memoryview(np.ascontiguousarray(w.data))
    for i in np.flatnonzero(out & (n > LONG) & (a != b)).tolist():
        out[i] = line[a[i] + LONG:a[i] + n[i]] == line[b[i] + LONG:b[i] + n[i]]
    return out


def distinct_words(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its kind, and the first word of every kind; kinds are told apart by their bytes. Words of up
    to eight bytes and the same length that share a hash are equal, since each step of the hash can be undone; longer ones are
    compared."""
    codes, kinds = pd.factorize(w.hashes())
    first = np.zeros(len(kinds), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    size, like = w.ends - w.starts, first[codes]
    other = size != size[like]
    long = np.flatnonzero(size > 8)
    other[long] |= ~same_words(w, long, like[long])
    other = np.flatnonzero(other)
    if len(other):  # words that share a hash with another one
        line, seen = w.data.tobytes(), {}
        codes = codes.astype(np.int64)
        for i in other.tolist():
            codes[i] = seen.setdefault(line[w.starts[i]:w.ends[i]], len(first) + len(seen))
        more = np.full(len(seen), len(codes), np.int64)
        np.minimum.at(more, codes[other] - len(first), other)
        first = np.append(first, more)
    return codes, first


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `most` bytes of text (or one text), with the bytes and offsets of the column."""
    if not batch.num_rows:
        return
    data, offsets = raw(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def spaced(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words as runs of bytes other than ASCII white space."""
    return Words(data, offsets, ~SPACE[data])


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of the given lengths over one flat array."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
