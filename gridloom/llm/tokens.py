"""Token counts by the whole-token shortcut, and token ids, for public tokenizer files.

The shortcut rests on a proof made once per model. A sentencepiece model whose pieces never hold a space mark after
another character cannot merge across the front of a run of spaces, so a text is the sum of its pre-tokens (a run of
spaces and what follows up to the next space). Each vocabulary string that has the form of a pre-token is encoded alone;
those that give exactly one token are proven, and later counted by lookup. The other pre-tokens are merged by the library
itself, once per distinct string and worker. A model without the property is counted text by text.

Defined cases: a null or empty text has 0 tokens; text is taken whole however long; repeated rows are counted alike; other columns
are not read, whatever their names.
"""
from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import LOWER, SPACE, Words, blocks, distinct_words, spaced
from gridloom.llm.tables import ready

MEMO = 300_000  # distinct pre-tokens that a worker remembers; then it starts anew
MARK = "▁"  # sentencepiece's sign for a space
_PRE = re.compile(rb" +[^ ]*")


def load(path: str):
    """The library's tokenizer of a file: sentencepiece for .model, tokenizers for .json."""
    if path.endswith(".model"):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def separable(model) -> bool:
    """True if no merge of the model can cross the front of a run of spaces, and spaces are kept as they are."""
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    plain = [model.encode(x, out_type=str) for x in ("a  b", "a b ", " a")]
    kept = all("".join(p).replace(MARK, " ") == f" {x}" for p, x in zip(plain, ("a  b", "a b ", " a")))
    return kept and not any(MARK in p.lstrip(MARK) for p in pieces)


def whole_tokens(model) -> dict[bytes, int]:
    """Pre-tokens (without their first space) that are proven to encode alone as one token."""
    names = [(i, model.id_to_piece(i)) for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    words = [(i, p[1:]) for i, p in names if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return {w.encode(): 1 for (i, w), got in zip(words, model.encode([w for _, w in words], num_threads=1)) if got == [i]}


def pre_tokens(text: bytes) -> list[bytes]:
    """Pre-tokens of a non-empty text, each without its first space (the first one's is the model's own)."""
    text = text.replace(MARK.encode(), b" ")
    if b"  " not in text and not text.startswith(b" ") and not text.endswith(b" "):
        return text.split(b" ")
    return [m[1:] for m in _PRE.findall(b" " + text)]


class Counter:
    """Counts the tokens of texts with one sentencepiece model."""

    def __init__(self, model):
        self.model, self.split = model, separable(model)
        self.proven = whole_tokens(model) if self.split else {}
        self.memo = dict(self.proven)
        self.one = len(model.encode("a"))

    def _merge(self, keys: list[bytes]) -> None:
        """Let the library merge the pre-tokens that are not proven."""
        blank = [k for k in keys if not k.strip(b" ")]
        words = [k for k in keys if k.strip(b" ")]
        for k, ids in zip(words, self.model.encode([w.decode() for w in words], num_threads=1)):
            self.memo[k] = len(ids)
        for k in blank:  # spaces at the end of a text: what they add to a text of one letter
            self.memo[k] = len(self.model.encode("a " + k.decode())) - self.one

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.split:
            return [len(x) for x in self.model.encode([t.decode() for t in texts], num_threads=1)]
        if len(self.memo) > MEMO:
            self.memo = dict(self.proven)
        keys = [pre_tokens(t) if t else [] for t in texts]
        new = [k for k in set().union(*keys) if k not in self.memo]
        if new:
            self._merge(new)
        get = self.memo.__getitem__
        return [sum(map(get, k)) for k in keys]


@lru_cache(1)
def counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """The counting function of a file; kept by a worker over its tasks, with what it remembers."""
    model = load(path)
    return Counter(model).counts if path.endswith(".model") else (
        lambda texts: [len(e.ids) for e in model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)])


def _count_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part, data, offsets in blocks(batch, "text"):
                line, at = data.tobytes(), offsets.tolist()
                got = count([line[a:b] for a, b in zip(at, at[1:])])
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(offsets)), pa.array(got, pa.int64())], names=["doc", "n_bytes", "n_tokens"])
    return rows


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc`, `n_bytes` (UTF-8) and `n_tokens` per row, as the file's library counts them without added tokens. No shuffle."""
    ready(docs.sparkSession)
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return base.mapInArrow(_count_rows(path), T.StructType([base.schema["doc"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]))


# classes of bytes: letters that lower-case one by one and never combine, ASCII marks other than the apostrophe, all others
_LETTER, _MARK, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _CLASS[39] = _OTHER
_CLASS[65:91] = _CLASS[97:123] = _LETTER


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the second byte of the Latin-1 letters, and of those that are capitals."""
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
    return second, second[data[second] < 0x9F]


class Encoder:
    """Token ids of the texts of a block, for a tokenizers file that drops white space. Distinct pre-tokens are encoded by
    the library, many in one call, once per worker; the ids of all others are gathered.

    What this rests on is tested when the file is loaded. If words between spaces encode on their own, ids go by word. If the
    model marks the ends of its pre-tokens and lower-cases, a word of letters and marks falls into runs of either, each a
    pre-token, and the ids of many of them in one text part at the end marks. Words with other characters (digits,
    apostrophes, further letters) or with a special token's string are encoded whole, kept apart by a special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = load(path)
        added = self.tok.get_added_tokens_decoder()
        at = [i for i, t in added.items() if t.special and not (t.single_word or t.normalized)]
        self.mark_id = at[0] if at else None
        self.mark = added[self.mark_id].content if at else ""
        self.special = [t.content.lower().encode() for t in added.values()]
        size = self.tok.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends = np.zeros(size, bool)
        if suffix:
            self.ends[[i for t, i in self.tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}
        self.by_word = self._same(["a b\tab\n c", " ab"], ["a", "b", "ab", "c", "ab"])
        self.lean = Tokenizer(self.tok.model)  # for what is split and lower-cased already
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        units = ["(", "été", "!.", "straße", "%%%", "of", ",", "[", "a", "x", "_", "y", "ÿ", "þ"]
        self.by_unit = self.by_word and bool(suffix) and self._same(["(Été!.", "STRAßE%%%", "of,", "[A", "x_Y", "ÿ", "Þ"], units)
        self.by_unit = self.by_unit and [i for x in units for i in self._ids([x])[0]] == self.lean.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _same(self, texts: list[str], parts: list[str]) -> bool:
        return sum(self._ids(texts), []) == sum(self._ids(parts), [])

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _cut(self, ids: np.ndarray, starts: list[int], stops: list[int]) -> list[bytes]:
        line, step = ids.astype(self.kind).tobytes(), self.kind.itemsize
        return [line[a * step:b * step] for a, b in zip(starts, stops)]

    def _learn_units(self, units: list[bytes]) -> None:
        """Ids of pre-tokens: many in one text, parted after each token that ends a pre-token."""
        for lo in range(0, len(units), 1024):
            some = units[lo:lo + 1024]
            ids = np.array(self.lean.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                self.memo.update(zip(some, self._cut(ids, [0, *stops[:-1]], stops)))
            else:
                self._learn_words(some)

    def _learn_words(self, words: list[bytes]) -> None:
        """Ids of whole words: many in one text, kept apart by a special token that none of them holds."""
        odd = [w for w in words if not self.mark or self._holds_special(w)]
        even = [w for w in words if self.mark and not self._holds_special(w)]
        self.memo.update((w, self._bytes(x)) for w, x in zip(odd, self._ids([w.decode() for w in odd])))
        for lo in range(0, len(even), 4096):
            some = even[lo:lo + 4096]
            ids = np.array(self._ids([self.mark.join(w.decode() for w in some)])[0])
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            self.memo.update(zip(some, self._cut(ids, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)])))

    def _holds_special(self, text: bytes) -> bool:
        low = text.lower()
        return any(x in low for x in self.special)

    def _units(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, Words, np.ndarray]:
        """Lower-cased bytes, the pre-tokens (or whole words) in them, and which are whole words."""
        kind = _CLASS[data]
        second, capital = _latin(data)
        kind[second] = kind[second - 1] = _LETTER
        others = np.append(0, np.cumsum(kind == _OTHER))
        whole = others[w.ends] > others[w.starts]
        line = data.tobytes()
        named = np.zeros(len(whole), bool)
        if self._holds_special(line):
            named = np.array([self._holds_special(line[a:b]) for a, b in zip(w.starts.tolist(), w.ends.tolist())])
            whole |= named
        low = LOWER[data]
        for i in np.flatnonzero(named):  # a special token's string must be spelled as it is
            low[w.starts[i]:w.ends[i]] = data[w.starts[i]:w.ends[i]]
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, w.starts[whole], 1)
        np.add.at(edge, w.ends[whole], -1)
        kind[np.cumsum(edge[:-1]) > 0] = _OTHER
        low[capital[kind[capital] == _LETTER]] += 32
        kind[SPACE[data]] = 0
        begin = np.zeros(len(data) + 1, bool)
        begin[1:-1] = kind[1:] != kind[:-1]
        begin[w.starts] = True
        begin[w.ends] = True
        cuts = np.flatnonzero(begin)
        inside = np.append(kind > 0, False)[cuts]
        units = Words.__new__(Words)
        units.data, units.offsets = low, w.offsets
        units.starts, units.ends = cuts[inside], np.append(cuts[1:], len(data))[inside]
        units.first = np.searchsorted(units.starts, w.offsets)
        return low, units, kind[units.starts] == _OTHER

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after another, and the number of ids of each text."""
        if not self.by_word:
            line, at = data.tobytes(), offsets.tolist()
            ids = self._ids([line[a:b].decode() for a, b in zip(at, at[1:])])
            return np.array(sum(ids, []), self.kind), np.array([len(x) for x in ids], np.int64)
        if len(self.memo) > MEMO:
            self.memo = {}
        w = spaced(data, offsets)
        whole = np.ones(len(w.starts), bool)
        if not len(w.starts):
            return np.zeros(0, self.kind), np.zeros(w.texts, np.int64)
        if self.by_unit:
            data, w, whole = self._units(data, w)
        codes, first = distinct_words(w)
        line, memo = data.tobytes(), self.memo
        names = [line[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]
        new = [(x, k) for x, k in zip(names, whole[first].tolist()) if x not in memo]
        self._learn_units([x for x, k in new if not k])
        self._learn_words([x for x, k in new if k])
        got = [memo[x] for x in names]
        size = np.fromiter(map(len, got), np.int64, len(got)) // self.kind.itemsize
        flat, at = np.frombuffer(b"".join(got), self.kind), np.cumsum(size) - size
        n = size[codes]
        upto = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(at[codes] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[w.first])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The encoder of a file; kept by a worker over its tasks, with what it remembers."""
    return Encoder(path)
