"""Places of known values in texts, found in one scan whatever the size of the vault.

Every value becomes a form: its words with single spaces, a plain number, or what it looks like inside a web link (words
joined by space, _, + or -, percent signs decoded). Three bitmaps of SIEVE bits, over the first words of the forms, over what
they begin with (two words, three words and so on) and over the forms, go to every task; their size does not grow with the
vault. A task splits the texts of a batch into words with numpy, follows the words that pass the first bitmap from word to word
as long as the second one lets them, so that a common first word costs little, and sends on the forms that pass the third. What
is left is joined with the forms themselves, so a bitmap's false hits cost a row each and no result. No word is sent anywhere
else.

Numbers: as whole numbers, decimals also with more zeros (73.7354 as 73.73540). Which values are looked for at all is the
policy `matched_in_text`. Null texts hold nothing; a very long text is worked on by the task that reads it.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridloom.session import cut, dealt

SIEVE = 1 << 23
HEAD = 32  # letters of a word in a run that are hashed
STEP = 1 << 14  # words whose letters are summed at a time
LEAD = 8  # words that a form is followed by before it is put together
SLICE = 1 << 18  # bytes of text split at a time
_ZERO = np.zeros(SIEVE >> 6, np.uint64)
# What a web link is, and what may join the words of a value in it.
URL = re.compile(r"https?://[^\s\"'<>)\]\\]+")
JOINED = re.compile(r"\s+|_|\+|-")
NUMBER = re.compile(r"\d+(?:\.\d+)?", re.A)
SIGNED = re.compile(r"[+-]?\d+(?:\.\d+)?", re.A)
_tables: list[np.ndarray] = []


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is part of a word (letters, marks, digits, joiners), its lower case, and what all code points
    share that `str.lower` makes equal anywhere in a text (a sigma at the end of a word too)."""
    if not _tables:
        size = 0x110000
        kinds = [unicodedata.category(chr(i)) for i in range(size)]
        word = np.fromiter((k[0] in "LM" or k in ("Nd", "Nl", "Pc") for k in kinds), bool, size)
        word[[0x200C, 0x200D]] = word[0x24B6:0x24EA] = True
        low = np.arange(size, dtype=np.uint32)
        for i in np.flatnonzero(np.fromiter((k in ("Lu", "Lt") for k in kinds), bool, size)).tolist():
            small = chr(i).lower()
            low[i] = ord(small) if len(small) == 1 else i
        fold = np.arange(size, dtype=np.uint32)
        for i in range(size):
            small = chr(i).lower()
            if len(small) == 1:
                fold[i] = ord(small)
        fold[0x3C2] = 0x3C3
        _tables.extend([word, low, fold])
    return tuple(_tables)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_LETTERS, _PLACES = _mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)), _mixed(np.arange(1 << 10, dtype=np.uint64) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class Split:
    """The words of some texts as places in their code points; `first` is the number of words before each text."""

    def __init__(self, texts: Sequence[str]):
        word, low, _ = _classes()
        size = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.append(0, np.cumsum(size))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points, self.low = points, low[points]
        inside = word[points]
        edge = np.zeros(len(points) + 1, bool)
        edge[self.offsets] = True
        begin = inside & (edge[:-1] | ~np.append(False, inside[:-1]) if len(inside) else inside)
        end = inside & (edge[1:] | ~np.append(inside[1:], False) if len(inside) else inside)
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def _hashed(self, letters: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the length and the first HEAD letters of words."""
        h = _mixed(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        some = np.arange(len(size))
        for i in range(HEAD):
            some = some[size[some] > i]
            if not len(some):
                break
            h[some] = _mixed(h[some] ^ (letters(starts[some] + i).astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        return h

    def heads(self) -> np.ndarray:
        """Bitmap places of all words, by their letters in lower case: each letter counts by its place in its word, and the letters
        of a word are summed, some words at a time."""
        out = np.zeros(len(self.starts), np.int64)
        for i in range(0, len(out), STEP):
            starts, ends = self.starts[i:i + STEP], self.ends[i:i + STEP]
            lo, hi = starts[0], ends[-1]
            place = np.arange(lo, hi) - np.repeat(starts, np.diff(starts, append=hi))
            letters = np.append(_LETTERS[self.low[lo:hi] & np.uint32(len(_LETTERS) - 1)] * _PLACES[place & (len(_PLACES) - 1)], np.uint64(0))
            h = np.add.reduceat(letters, np.stack([starts, ends], 1).ravel() - lo)[::2]
            out[i:i + STEP] = _bits(_mixed(h ^ (ends - starts).astype(np.uint64)))
        return out

    def runs(self, words: np.ndarray, last: np.ndarray, sieve: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """From each of `words` on, one more word at a time up to LEAD, none past the word `last`: the number of words, which of
        `words` are left, and the bitmap places of what they begin with. Words that do not pass `sieve` are dropped. Forms that are equal have
        equal places, but for the one letter whose lower case are two: words with it always pass."""
        fold = _classes()[2]
        odd = np.flatnonzero((self.points == 0x130) | (self.points == 0x307))
        h, open_, left = np.zeros(len(words), np.uint64), np.zeros(len(words), bool), np.arange(len(words))
        for more in range(LEAD):
            left = left[words[left] + more <= last[left]]
            if not len(left):
                return
            w = words[left] + more
            starts, ends = self.starts[w], self.ends[w]
            h[left] = _mixed(h[left] ^ self._hashed(lambda at: fold[self.points[at]], starts, ends - starts) * np.uint64(0xE7037ED1A0B428DB))
            if len(odd):
                open_[left] |= np.searchsorted(odd, starts) < np.searchsorted(odd, ends)
            if more:
                bits = _bits(h[left])
                if sieve is not None:
                    passed = _has(sieve, bits) | open_[left]
                    left, bits = left[passed], bits[passed]
                yield more + 1, left, bits


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 23)).astype(np.int64)


def _form_bit(kind: str, form: str) -> int:
    return zlib.crc32(f"{kind}{form}".encode("utf-8", "surrogatepass")) >> 9


def _has(sieve: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (sieve[bits >> 6] >> (bits & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _one(sieve: np.ndarray, bit: int) -> bool:
    return bool(int(sieve[bit >> 6]) >> (bit & 63) & 1)


def _spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).lower()


def decoded(url: str) -> tuple[str, list[int]]:
    """A link with its percent signs decoded, and where in the link each character starts (one more than characters)."""
    out, at = [], []
    for m in re.finditer(r"(?:%[0-9A-Fa-f]{2})+|[^%]|%", url):
        piece = m.group()
        if len(piece) < 3:
            out.append(piece)
            at.append(m.start())
            continue
        place = m.start()
        for ch in unquote(piece):  # bytes that are not UTF-8 become one mark each
            out.append(ch)
            at.append(place)
            place += 3 * (1 if ch == "�" else len(ch.encode()))
    return "".join(out), [*at, len(url)]


def _link_words(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"[^\W_]+", text)]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about SLICE bytes of text, so that what a worker holds beside the batch does not grow with it."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def needle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms of values: kind, form, words, what must stand right before and after, code, and their places in the bitmaps."""
    for batch in (part for whole in batches for part in slices(whole, "value")):
        rows, kept = [], [v.strip() for v in batch.column("value").to_pylist()]
        s = Split(kept)
        begun, some = [[] for _ in kept], np.flatnonzero(np.diff(s.first))
        for _, left, bits in s.runs(s.first[some], s.first[some + 1] - 1):
            for i, bit in zip(some[left].tolist(), bits.tolist()):
                begun[i].append(bit)
        firsts, shifts, starts, ends = s.first.tolist(), s.offsets.tolist(), s.starts.tolist(), s.ends.tolist()
        for i, (v, code) in enumerate(zip(kept, batch.column("code").to_pylist())):
            if SIGNED.fullmatch(v):
                rows.append(("n", v, 1, "", "", code, v.lstrip("+-").split(".")[0], []))
                continue
            lo, hi, shift = firsts[i], firsts[i + 1], shifts[i]
            if hi > lo:
                a, b = starts[lo] - shift, ends[hi - 1] - shift
                rows.append(("w", _spaced(v[a:b]), hi - lo, v[:a], v[b:], code, v[a:ends[lo] - shift], begun[i]))
            spans = _link_words(v)
            if spans and ((token := v[slice(*spans[0])]).isascii() or len(Split([token]).starts)):
                rows.append(("u", JOINED.sub(" ", v[spans[0][0]:spans[-1][1]]).lower(), len(spans), "", "", code, token, []))
        if rows:
            first = Split([r[6] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 2 else pa.string()) for i in range(6)] + [pa.array(first.heads()[first.first[:-1]]), pa.array([_form_bit(r[0], r[1]) for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.list_(pa.int64()))],
                                             names=["kind", "form", "size", "pre", "suf", "code", "head", "bit", "begun"])


def _boundary(before: str, after: str, more: bool) -> bool:
    """A value is not part of an address or a longer name: no @ or dot right before, no @ or `.word` right after."""
    if before.endswith("+"):
        return True
    return not (before.endswith(("@", ".")) or after.startswith(("@", ".@")) or (after == "." and more))


def _numbers(text: str, start: int) -> list[tuple[int, int, str]]:
    """(start, end, form) of the number that starts at a place: with and without its sign and its last zeros."""
    m = NUMBER.match(text, start)
    end = m.end()
    word = _classes()[0]
    wordly = lambda i: 0 <= i < len(text) and bool(word[ord(text[i])])
    if wordly(end) or (text[end:end + 1] == "." and text[end + 1:end + 2].isdigit()):
        return []
    begins = [start] if not wordly(start - 1) and text[start - 1:start] != "." else []
    if start and text[start - 1] in "+-" and not wordly(start - 2) and text[start - 2:start - 1] != ".":
        begins.append(start - 1)
    forms = []
    for s in begins:
        form = text[s:end]
        forms.append((s, end, form))
        while "." in form and form.endswith("0") and form[-2] != ".":
            form = form[:-1]
            forms.append((s, end, form))
    return forms


def _place_rows(heads: np.ndarray, forms: np.ndarray, begun: np.ndarray, sizes: Sequence[int], link_sizes: Sequence[int]):
    """Places where a form may stand."""
    def tried(s: Split, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and number of words of the runs that may be a form; 0 words: a number may start there."""
        texts = np.searchsorted(s.first, words, "right") - 1
        first = s.points[s.starts[words]]
        got = [(0, np.flatnonzero((first >= 48) & (first <= 57))), (1, np.arange(len(words) if 1 in sizes else 0))]
        for size, left, _ in s.runs(words, np.minimum(s.first[texts + 1], words + max(sizes, default=1)) - 1, begun):
            got += [(n, left[words[left] + n <= s.first[texts[left] + 1]]) for n in sizes if n == size or n > size == LEAD]
        at = np.concatenate([x for _, x in got])
        size = np.repeat([n for n, _ in got], [len(x) for _, x in got])
        order = np.argsort(at, kind="stable")
        return texts[at[order]], words[at[order]], size[order]

    def of_text(text: str, s: Split, i: int, runs: list[tuple[int, int]]) -> Iterator[tuple]:
        lo, hi, shift = int(s.first[i]), int(s.first[i + 1]), int(s.offsets[i])
        for w, size in runs:
            start = int(s.starts[w]) - shift
            if not size:
                for a, b, form in _numbers(text, start):
                    if _one(forms, _form_bit("n", form)):
                        yield a, b, "n", form, "", "", False
                continue
            last = w + size - 1
            end = int(s.ends[last]) - shift
            form = _spaced(text[start:end])
            if _one(forms, _form_bit("w", form)):
                before = text[(int(s.ends[w - 1]) - shift) if w > lo else 0:start]
                after = text[end:(int(s.starts[last + 1]) - shift) if last + 1 < hi else len(text)]
                if _boundary(before, after, last + 1 < hi):
                    yield start, end, "w", form, before, after, w > lo

    def of_links(text: str) -> Iterator[tuple]:
        for m in URL.finditer(text):
            plain, at = decoded(m.group())
            spans = _link_words(plain)
            tokens = Split([plain[a:b] for a, b in spans])
            some = np.flatnonzero(np.diff(tokens.first))  # a token such as a raised digit has no word
            for w in some[_has(heads, tokens.heads()[tokens.first[some]])].tolist():
                for size in link_sizes:
                    if w + size > len(spans):
                        break
                    a, b = spans[w][0], spans[w + size - 1][1]
                    form = JOINED.sub(" ", plain[a:b]).lower()
                    if _one(forms, _form_bit("u", form)):
                        yield m.start() + at[a], m.start() + at[b], "u", form, "", "", False

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "_t")):
            texts = [t or "" for t in batch.column("_t").to_pylist()]
            s = Split(texts)
            text_of, words, size = tried(s, np.flatnonzero(_has(heads, s.heads())))
            got: list[tuple] = []
            edges = np.searchsorted(text_of, np.arange(len(texts) + 1))
            for i in np.unique(text_of).tolist():
                some = slice(edges[i], edges[i + 1])
                got += [(i, *x) for x in of_text(texts[i], s, i, list(zip(words[some].tolist(), size[some].tolist())))]
            for i, text in enumerate(texts):
                if "://" in text:
                    got += [(i, *x) for x in of_links(text)]
            if got:
                cols = list(zip(*got))
                yield pa.RecordBatch.from_arrays([
                    batch.column("_k").take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), *[pa.array(c) for c in cols[3:]]],
                    names=["_k", "start", "end", "kind", "form", "before", "after", "inner"])
    return rows


def _sieve(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap over the places in a column: at most 131,072 words come to the driver."""
    out = _ZERO.copy()
    words = df.groupBy(F.shiftright(column, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("bits")).toArrow()
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def matched_in_text(c: Column, never: Sequence[str] = ()) -> Column:
    """Whether a known value is looked for in prose: not years, not numbers of fewer than four digits (or four decimals),
    not the words of `never`."""
    v = F.regexp_replace(F.trim(c), r"\s*%$", "")
    digits = F.length(F.regexp_replace(v, r"[^\d]", ""))
    decimals = F.length(F.regexp_extract(v, r"\.(\d+)$", 1))
    number = v.rlike(r"^[+-]?\d+(\.\d+)?$")
    out = (F.trim(c) != "") & ~F.trim(c).rlike(r"^(19|20)\d\d$") & (~number | (digits >= 4) | (decimals >= 4))
    return out & ~F.lower(F.trim(c)).isin([w.strip().lower() for w in never]) if never else out


def known_places(docs: DataFrame, key: str, text: str, vault: DataFrame, least: int = 1, never: Sequence[str] = ()) -> DataFrame:
    """Every known value in every text: (key, start, end, code), character places; overlaps are not resolved. The places lie by
    key, so that gathering or counting them per text needs no further shuffle."""
    values = vault.filter((F.length("value") >= least) & matched_in_text(F.col("value"), never)).select("value", "code")
    needles = cut(dealt(values).mapInArrow(needle_rows, "kind string, form string, size int, pre string, suf string, code string, head long, bit long, begun array<long>"))
    sizes = {k: sorted(r["size"] for r in needles.filter(F.col("kind").isin(*kinds)).select("size").distinct().collect()) for k, kinds in (("w", ("w",)), ("u", ("u",)))}  # a few numbers
    base = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))  # a filter here would have a text that is worked out made twice
    schema = T.StructType([base.schema["_k"], *T.StructType.fromDDL("start int, end int, kind string, form string, before string, after string, inner boolean").fields])
    begun = _sieve(needles.select(F.explode("begun").alias("begun")), "begun")
    found = base.mapInArrow(_place_rows(_sieve(needles, "head"), _sieve(needles, "bit"), begun, sizes["w"], sizes["u"]), schema)
    hit = found.join(needles.select("kind", "form", "pre", "suf", "code").distinct(), ["kind", "form"])
    glued = (F.col("pre") != "") & (F.length("before") == F.length("pre")) & F.col("inner")
    hit = hit.filter(F.col("before").endswith(F.col("pre")) & F.col("after").startswith(F.col("suf")) & ~glued)
    return hit.select(F.col("_k").alias(key), (F.col("start") - F.length("pre")).alias("start"), (F.col("end") + F.length("suf")).alias("end"), "code").repartition(F.col(key)).distinct()
