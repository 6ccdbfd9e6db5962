"""Text column functions, all JVM-side except full case folding and accent folding."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def norm(c: Column) -> Column:
    """Trim, collapse white space, lower-case. The one normal form used by every join on text."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.pandas_udf(StringType())
def casefold(s: pd.Series) -> pd.Series:
    """Full Unicode case folding after the white-space rule (sharp s, Greek sigma)."""
    return s.map(lambda v: None if v is None else " ".join(v.split()).casefold())


@F.pandas_udf(StringType())
def accent_fold(s: pd.Series) -> pd.Series:
    """Letters without their accents (NFKD, combining marks removed)."""
    return s.map(lambda v: None if v is None else
                 "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch)))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column, empty: str = "x") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit(empty)).otherwise(s)


def safe_name(c: Column) -> Column:
    """A table or column name that SQL accepts: slug, with a prefix before a leading digit."""
    s = slug(c, "table")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("t_"), s)).otherwise(s)


def words(c: Column) -> Column:
    """Lower-case alphanumeric tokens, camel case split, empty pieces removed."""
    parts = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(parts, lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Lower-case runs of letters and digits in any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def header_key(headers: Column) -> Column:
    """Signature of a set of column names: sorted lower-case names, hashed."""
    return F.sha2(F.array_join(F.array_sort(F.transform(headers, lambda h: F.lower(F.trim(h)))), "|"), 256)


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over all words (Jaccard) of two word arrays."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)).cast("double"), F.lit(0.0))


def sample_text(c: Column, n: int) -> Column:
    """A long text in n characters: the first half, then three pieces from 30%, 55% and 80% of its length."""
    piece = n // 6
    size = F.length(c)
    cuts = [F.substring(c, F.floor(size * F.lit(p)).cast("int") + 1, F.lit(piece)) for p in (0.30, 0.55, 0.80)]
    return F.when(size <= n, c).otherwise(F.concat_ws(" ... ", F.substring(c, 1, n // 2), *cuts))


def edges_text(c: Column, n: int) -> Column:
    """Start, middle and end of a long text, n characters in all."""
    part = n // 3
    size = F.length(c)
    mid = F.greatest(F.floor(size / 2).cast("int") - part // 2 + 1, F.lit(1))
    return F.when(size <= n, c).otherwise(F.concat_ws(" ... ", F.substring(c, 1, part), F.substring(c, mid, F.lit(part)),
                                                      F.substring(c, size - part + 1, F.lit(part))))
