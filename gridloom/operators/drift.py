"""Drift between two versions of a set of tables: which known table is which present one, and what changed in each.

Tables are told by their columns: names first (slugged, a suffix counts), then values. A column's values are sketched by
one-permutation MinHash: every value's hash falls into one of BINS bins and each bin keeps its smallest hash, so one scan with
map-side combine gives at most BINS rows per column, however many values there are. The share of bins that two sketches have
in common estimates the Jaccard similarity of their value sets. Known and present tables are then assigned one to one so that
the sum of their scores is largest. Scores, assignments and sketches are per table and column, and sit on the driver.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions.text import blank_to_null
from gridloom.operators.quality import contract

BINS = 128
FINDINGS = "table string, what string, name string, detail string, severity int"


def slug_of(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def same_name(a: str, b: str) -> bool:
    """Slugs that are equal or end in one another after an underscore."""
    return a == b or a.endswith("_" + b) or b.endswith("_" + a)


def sketches(df: DataFrame, bins: int = BINS) -> dict[str, dict[int, int]]:
    """Smallest value hash by bin of every column; empty cells do not count."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), blank_to_null(F.lower(F.trim(F.col(f"`{c}`").cast("string")))).alias("v")) for i, c in enumerate(df.columns)])
    hashed = df.select(F.inline(cells)).filter("v is not null").select("c", F.xxhash64("v").alias("h"))
    rows = hashed.groupBy("c", F.pmod("h", F.lit(bins)).alias("bin")).agg(F.min("h").alias("h")).collect()  # bins times columns at most
    out: dict[str, dict[int, int]] = {c: {} for c in df.columns}
    for r in rows:
        out[df.columns[r["c"]]][r["bin"]] = r["h"]
    return out


def alike(a: Mapping[int, int], b: Mapping[int, int]) -> float:
    """Estimated Jaccard similarity of the value sets behind two sketches."""
    either = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in either) / len(either) if either else 0.0


def teach(tables: Mapping[str, DataFrame], kinds: Mapping[str, Mapping[str, str]] | None = None, values: Mapping[str, Mapping[str, Sequence]] | None = None,
          used: Mapping[str, Sequence[str]] | None = None) -> dict[str, dict]:
    """What is kept of a set of tables: by table its columns with their kinds, known values, used columns and sketches."""
    return {n: {"columns": {c: (kinds or {}).get(n, {}).get(c, "text") for c in df.columns}, "values": dict((values or {}).get(n, {})),
                "used": list((used or {}).get(n, ())), "sketch": sketches(df)} for n, df in tables.items()}


def pair_columns(known: Mapping[str, Mapping[int, int]], present: Mapping[str, Mapping[int, int]], least: float = 0.5) -> dict[str, str | None]:
    """Known column -> present one: equal names, then names that end in one another, then the likeliest values of `least` or
    more; each present column goes to one known column."""
    out: dict[str, str | None] = dict.fromkeys(known)
    free = list(present)

    def take(k: str, p: str) -> None:
        out[k] = p
        free.remove(p)
    for test in (lambda a, b: a == b, same_name):
        for k in known:
            if out[k] is None:
                p = next((p for p in free if test(slug_of(k), slug_of(p))), None)
                if p is not None:
                    take(k, p)
    near = sorted(((alike(known[k], present[p]), k, p) for k in known if out[k] is None for p in free), key=lambda x: (-x[0], x[1], x[2]))
    for score, k, p in near:
        if score >= least and out[k] is None and p in free:
            take(k, p)
    return out


def assigned(score: Sequence[Sequence[float]]) -> list[int | None]:
    """For every row the column it is given, so that the sum of scores is largest (shortest augmenting paths over reduced
    costs); rows beyond the number of columns get none."""
    n, m = len(score), len(score[0]) if score else 0
    if n > m:
        turned = assigned([[score[i][j] for i in range(n)] for j in range(m)])
        return [next((j for j, i in enumerate(turned) if i == row), None) for row in range(n)]
    row_price, col_price, owner = [0.0] * n, [0.0] * m, [None] * m
    for start in range(n):
        best, came, done, at, j = [float("inf")] * m, [None] * m, [False] * m, start, None
        while True:
            for c in range(m):
                cost = -score[at][c] - row_price[at] - col_price[c]
                if not done[c] and cost < best[c]:
                    best[c], came[c] = cost, j
            step, j = min((best[c], c) for c in range(m) if not done[c])
            row_price[start] += step
            for c in range(m):
                if done[c]:
                    col_price[c] -= step
                    row_price[owner[c]] += step
                else:
                    best[c] -= step
            done[j] = True
            if owner[j] is None:
                break
            at = owner[j]
        while j is not None:
            owner[j] = owner[came[j]] if came[j] is not None else start
            j = came[j]
    return [owner.index(i) for i in range(n)]


def match_tables(family: Mapping[str, Mapping], present: Mapping[str, Mapping[str, Mapping[int, int]]], least: float = 0.5) -> dict[str, tuple[str | None, float]]:
    """Known table -> (present table, score): paired columns over all columns of both, a table's own name weighing a little;
    none below `least`. `present` holds sketches by table and column."""
    known, there = sorted(family), sorted(present)
    if not there:
        return {k: (None, 0.0) for k in known}

    def score(k: str, p: str) -> float:
        pairs = pair_columns(family[k]["sketch"], present[p], least)
        hits = sum(x is not None for x in pairs.values())
        return hits / max(1, len(pairs) + len(present[p]) - hits)
    table = [[score(k, p) for p in there] for k in known]
    chosen = assigned([[x + (0.01 if k == p else 0) for p, x in zip(there, row)] for k, row in zip(known, table)])
    return {k: (there[j], table[i][j]) if j is not None and table[i][j] >= least else (None, 0.0) for i, (k, j) in enumerate(zip(known, chosen))}


def contracts(spark: SparkSession, tables: Mapping[str, DataFrame], family: Mapping[str, Mapping], least: float = 0.5) -> DataFrame:
    """Findings over all tables against what was taught: (table, what, name, detail, severity); 0 ok, 1 drift, 2 changed.
    Known tables that no present one matches are missing, matched ones of another name renamed, unmatched present ones new;
    columns, parse rates and values of the matched ones are compared by `contract`."""
    present = {n: sketches(df) for n, df in tables.items()}
    match = match_tables(family, present, least)
    notes, parts = [], []
    for k, (p, score) in match.items():
        if p is None:
            notes.append((k, "missing table", k, "", 2))
            continue
        if p != k:
            notes.append((k, "renamed table", p, f"{score:.2f}", 1))
        pairs = {c: x for c, x in pair_columns(family[k]["sketch"], present[p], least).items() if x is not None}
        parts.append(contract(tables[p], family[k], family[k]["used"], pairs).select(F.lit(k).alias("table"), "what", "name", "detail", "severity"))
    taken = {p for p, _ in match.values()}
    notes += [(p, "new table", p, "", 1) for p in sorted(tables) if p not in taken]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(notes, FINDINGS))
