"""String similarity as Arrow pandas UDFs, and exact candidate keys that let similar strings meet in an equi-join."""
from __future__ import annotations

import difflib
import math
import zlib
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_pair(a: str, b: str) -> float:
    """Jaro with the common-prefix bonus (0.1 per letter, up to four letters, applied above 0.7)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = bytearray(len(b))
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = 1
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, used in zip(b, taken) if used]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    head = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        head += 1
    return jaro + head * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_pair(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio (difflib)."""
    out, matcher = [], difflib.SequenceMatcher()
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        matcher.set_seqs(x, y)
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


PREFIX = 4  # letters of a common prefix that raise jaro_winkler
RANKED = 4096  # letters or pairs of letters whose frequency is known; all others count as rarer


def _jaro_floor(floor: float, same: int) -> float:
    """Least jaro of a pair with so many equal first letters that reaches `floor` with the prefix bonus."""
    return (floor - 0.1 * same) / (1 - 0.1 * same)


def least_shared(kind: str, floor: float, la: int, lb: int, same: int = PREFIX) -> int:
    """Fewest characters (as a multiset) two strings of these lengths share when their similarity reaches `floor`."""
    if kind == "ratio":
        return max(1, math.ceil(floor * (la + lb) / 2 - 1e-9))
    return max(1, math.ceil((3 * _jaro_floor(floor, same) - 1) * la * lb / (la + lb) - 1e-9))  # m/la + m/lb + 1 >= 3 * jaro


def least_grams(floor: float, la: int, lb: int) -> int:
    """Fewest pairs of neighbouring letters that two strings share when their ratio reaches `floor`: the matched letters lie
    in blocks, and between two blocks a letter is left over on one side."""
    need = least_shared("ratio", floor, la, lb)
    return need - min(need, la + lb - 2 * need + 1)


@lru_cache(maxsize=4096)
def partner_lengths(kind: str, floor: float, la: int, same: int = PREFIX) -> tuple[tuple[int, int], ...]:
    """(partner length, least shared characters) for every length a similar partner can have."""
    out = []
    for lb in range(1, 4 * la + 8):
        need = least_shared(kind, floor, la, lb, same)
        if need <= min(la, lb):
            out.append((lb, need))
    return tuple(out)


def _numbered(parts: list[str], rank: dict[str, int]) -> list[str]:
    """Parts made distinct by their repeat, rarest first; the order is the same for all strings."""
    seen: dict[str, int] = {}
    marks = []
    for x in parts:
        seen[x] = seen.get(x, 0) + 1
        marks.append((rank.get(x, -1), x, -seen[x]))
    return [f"{x}{-k}" for _, x, k in sorted(marks)]


def _combined(head: str, tokens: list[str], least: int, at_once: int) -> list[str]:
    """Keys of a set that shares `least` tokens with its partners: they have `at_once` among their first ones in common."""
    k = max(0, min(at_once, least))
    return ["|".join((head, *c)) for c in combinations(tokens[:len(tokens) - least + k], k)]


@lru_cache(maxsize=4096)
def _at_once(n: int, least: int) -> int:
    """How many tokens of `least` shared ones a key names, for sets of up to `n`: up to four, while one set has few keys."""
    k = 1
    while k < min(4, least) and math.comb(max(n - least, 0) + k + 1, k + 1) <= 24:
        k += 1
    return max(k, min(2, least))


def keys_of(text: str, kind: str, floor: float, chars: dict[str, int], grams: dict[str, int]) -> list[str]:
    """Keys shared by every pair that can reach `floor`: both lengths, and tokens among the rarest of each side.

    For `ratio` the tokens are pairs of neighbouring letters, or letters where too few pairs must be shared. For
    `jaro_winkler` they are letters, beside the equal first letters: a pair that has few of these needs a higher jaro."""
    la, out = len(text), []
    letters = _numbered(list(text), chars)
    if kind == "ratio":
        pairs = _numbered([text[i:i + 2] for i in range(la - 1)], grams)
        for lb, need in partner_lengths(kind, floor, la):
            size, least = f"{min(la, lb)}.{max(la, lb)}", least_grams(floor, la, lb)
            if least >= 2:
                out += _combined(f"g{size}", pairs, least, _at_once(max(la, lb) - 1, least))
            else:
                out += _combined(f"c{size}", letters, need, _at_once(max(la, lb), need))
        return out
    for same in range(min(PREFIX, la) + 1):
        rest = _numbered(list(text[same:]), chars)
        lengths = partner_lengths(kind, floor, la, same)
        if same >= 3:  # the first letters tell most pairs apart already
            out += _combined(f"{same}{text[:same]}", rest, min((need for _, need in lengths), default=la) - same, PREFIX - same)
        else:
            for lb, need in lengths:
                out += _combined(f"{same}{text[:same]}|{min(la, lb)}.{max(la, lb)}", rest, need - same, _at_once(max(la, lb) - same, need - same))
    return out


def _bits(tokens: list[str]) -> tuple[int, int]:
    """128 bits of a set of tokens, as two signed longs."""
    x = 0
    for t in tokens:
        x |= 1 << (zlib.crc32(t.encode("utf-8", "surrogatepass")) & 127)
    low, high = x & (1 << 64) - 1, x >> 64
    return tuple(v - (1 << 64) if v >> 63 else v for v in (low, high))


KEYED = "struct<keys: array<string>, c0: bigint, c1: bigint, g0: bigint, g1: bigint>"


def candidate_keys(kind: str, floor: float, chars: dict[str, int], grams: dict[str, int]):
    """Column function (string, bare): the candidate keys of a string, null for a `bare` one, and the bits of its letters and
    of its pairs of letters."""
    @F.pandas_udf(KEYED)
    def keys(s: pd.Series, bare: pd.Series) -> pd.DataFrame:
        rows = []
        for v, without in zip(s, bare):
            if not v:
                rows.append(([], 0, 0, 0, 0))
            else:
                rows.append((None if without else list(dict.fromkeys(keys_of(v, kind, floor, chars, grams))), *_bits(_numbered(list(v), {})), *_bits(_numbered([v[i:i + 2] for i in range(len(v) - 1)], {}))))
        return pd.DataFrame(rows, columns=["keys", "c0", "c1", "g0", "g1"])
    return keys


def may_reach(kind: str, floor: float, l: Column, r: Column, a: Column, b: Column) -> Column:
    """Whether lengths, equal first letters and bits leave room for `floor`: every bit that differs stands for a token that
    only one side has. Never false for a pair that reaches it."""
    la, lb = F.length(l).cast("double"), F.length(r).cast("double")

    def differ(x: str) -> Column:
        return sum((F.bit_count(a[f"{x}{i}"].bitwiseXOR(b[f"{x}{i}"])) for i in (0, 1)), F.lit(0))
    if kind == "ratio":
        need = F.greatest(F.lit(1), F.ceil((la + lb) * (floor / 2) - 1e-9))
        least = need - F.least(need, la + lb - 2 * need + 1)
        return (need <= F.least(la, lb)) & (differ("c") <= la + lb - 2 * need) & (differ("g") <= la + lb - 2 - 2 * least)
    jaro = F.lit(_jaro_floor(floor, 0))
    for same in range(1, PREFIX + 1):
        jaro = F.when((F.substring(l, 1, same) == F.substring(r, 1, same)) & (la >= same) & (lb >= same), _jaro_floor(floor, same)).otherwise(jaro)
    need = F.greatest(F.lit(1), F.ceil((3 * jaro - 1) * la * lb / (la + lb) - 1e-9))
    return (need <= F.least(la, lb)) & (differ("c") <= la + lb - 2 * need)
