"""Greedy packing of lines into pages, in order: sequential inside a text, yet spread over tasks for long ones.

A page that starts at line i ends before the first line that no longer fits, next(i), which depends on i alone. With sums of
the lines' lengths next(i) is a search among the lines that begin within one page size, so lines are dealt into stretches of
STRETCH characters with the lines just behind them, and every stretch is searched on its own. The page starts are then the
lines reached from line 0 by next; pointer doubling finds them in as many self joins as the number of pages has binary digits:
the reached set is joined with next^1, next^2, next^4, ... Texts of up to `long` characters are filled where they stand, in one
pass over their row; the two ways give the same pages.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.operators.scale import running
from gridloom.session import cut

STRETCH = 1 << 20
LONG = 1 << 22


def _next_rows(size: int, whole: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """next(i) of the lines that belong to a stretch. With `whole`, the line that goes over still belongs to the page."""
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos, at, end = (pdf[c].to_numpy() for c in ("pos", "at", "end"))
        first = np.searchsorted(end, at + size, "right")  # the first line that goes over
        there = first < len(pos)
        over = pos[np.minimum(first, len(pos) - 1)]
        nxt = over + 1 if whole else np.maximum(over, pos + 1)
        keep = there & pdf["own"].to_numpy()
        return pd.DataFrame({"row": pdf["row"][keep], "pos": pos[keep], "next": nxt[keep]})
    return rows


def starts(lines: DataFrame, size: int, whole: bool = False, stretch: int = STRETCH) -> DataFrame:
    """(row, pos) of the lines that open a page. lines(row, pos, at, end): `pos` counts from 0 within a row, `at` is what lies
    before the line in its text, `end` what lies before its end; a page may hold `size` from its start to a line's end."""
    stretch = max(stretch, size + 2)
    home, back = F.floor(F.col("at") / stretch), F.floor((F.col("at") - size - 1) / stretch)
    homes = F.array_distinct(F.array(home, F.greatest(back, F.lit(0))))
    dealt = lines.withColumn("_s", F.explode(homes)).withColumn("own", F.col("_s") == home)
    jump = dealt.groupBy("row", "_s").applyInPandas(_next_rows(size, whole), "row long, pos long, next long")
    last = lines.groupBy("row").agg(F.max("pos").alias("_last"))
    jump = cut(jump.join(last, "row").filter("next <= _last").select("row", "pos", "next"))
    reached = cut(last.select("row", F.lit(0).cast("long").alias("pos")))
    while True:
        more = reached.join(jump, ["row", "pos"]).select("row", F.col("next").alias("pos"))
        far = jump.join(jump.select("row", F.col("pos").alias("next"), F.col("next").alias("_n")), ["row", "next"]).select("row", "pos", F.col("_n").alias("next"))
        reached = cut(reached.unionByName(more).distinct())
        jump = cut(far)
        if jump.isEmpty():
            return reached


def filled(lines: DataFrame, size: int, whole: bool = False, gap: int = 0, stretch: int = STRETCH) -> DataFrame:
    """lines(row, pos, line) as pages (row, page, text), pages from 0. `gap` counts for every line beside its own length."""
    sized = running(lines.withColumn("_len", F.length("line").cast("long")), ["row"], "pos", sums={"_sum": F.col("_len") + gap})
    placed = cut(sized.select("row", "pos", "line", (F.col("_sum") - F.col("_len") - gap).alias("at"), (F.col("_sum") - gap).alias("end")))
    opening = starts(placed.select("row", "pos", "at", "end"), size, whole, stretch).withColumn("_new", F.lit(1).cast("long"))
    marked = running(placed.join(opening, ["row", "pos"], "left").select("row", "pos", "line", F.coalesce("_new", F.lit(0)).alias("_new")), ["row"], "pos", sums={"_page": F.col("_new")})
    return marked.groupBy("row", (F.col("_page") - 1).alias("page")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "").alias("text"))  # a page of lines
