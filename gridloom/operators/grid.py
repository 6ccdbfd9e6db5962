"""Raw grids (file, sheet, row_no, cells) to typed tables: headers, stacked blocks, column names, footers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.scale import neighbours, running

SHEET = ["file", "sheet"]
# Rows that a task sorts at a time; words that open a footer row.
ROWS_PER_TASK = 200_000
FOOTER = r"(?i)^\s*(total|grand total|sub ?total|source|note|notes|remarks?|prepared by|compiled by|\*)(\b|$|\s)"


def filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def first_filled(cells: Column) -> Column:
    return F.trim(F.get(F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), F.lit(0)))


def is_label(c: Column) -> Column:
    """Header-like text: up to 48 characters and not a plain number, or a day of month, a year or a year-month."""
    t = F.trim(c)
    plain = t.rlike(r"^[\d.,%\-/ ]+$")
    return (F.length(t) <= 48) & (~plain | t.rlike(r"^(\d{1,2}|\d{4}|\d{4}-\d{2}|\d{1,2}/\d{4})$"))


def _features(grid: DataFrame) -> DataFrame:
    """Row features and the sheet's width. What is one row a sheet is the hashed side of its join, so that rows are not sorted for it."""
    g = grid.withColumns({"n": filled(F.col("cells")),
                          "labels": F.size(F.filter("cells", lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & is_label(c))),
                          "head": first_filled(F.col("cells"))})
    width = grid.groupBy(*SHEET).agg(F.max(F.size("cells")).alias("width"))
    g = g.join(width.hint("shuffle_hash"), SHEET).withColumn("need", F.greatest(F.lit(2.0), F.col("width") * 0.5))
    return g.withColumn("label_like", (F.col("n") >= F.col("need")) & (F.col("labels") >= 0.7 * F.col("n")))


def tasks_for(grid: DataFrame) -> int:
    """How many tasks sort the rows of a grid, so that what one holds does not grow with the grid: one count decides."""
    return max(grid.sparkSession.sparkContext.defaultParallelism, grid.count() // ROWS_PER_TASK + 1)


def find_headers(grid: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds row features and `is_header`. The first header may start a sheet or follow anything that is not a full data
    row; a further header starts only after a row with three or fewer filled cells. The next row must be half filled."""
    look = neighbours(_features(grid), SHEET, "row_no", {
        "n_next": (F.col("n"), 1), "n_prev": (F.col("n"), -1), "prev_label": (F.col("label_like"), -1)}, parts=parts or tasks_for(grid))
    cand = F.col("label_like") & (F.coalesce("n_next", F.lit(0)) >= F.col("need"))
    opens = F.col("n_prev").isNull() | (F.col("n_prev") < F.col("need")) | F.coalesce("prev_label", F.lit(False))
    look = look.withColumns({"_cand": cand, "_open": cand & opens})
    first = look.filter("_open").groupBy(*SHEET).agg(F.min("row_no").alias("_first"))
    out = look.join(first.hint("shuffle_hash"), SHEET, "left")
    header = F.col("_cand") & ((F.col("row_no") == F.col("_first")) | ((F.col("row_no") > F.col("_first")) & (F.col("n_prev") <= 3)))
    return out.withColumn("is_header", F.coalesce(header, F.lit(False))).drop("_cand", "_open", "_first", "n_next", "prev_label")


def header_row_by_share(grid: DataFrame) -> DataFrame:
    """The simpler rule: first row with at least two cells and 60% of the widest row, 80% of them text; else row 0."""
    g = grid.withColumns({"n": filled(F.col("cells")), "texts": F.size(F.filter(
        "cells", lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.trim(c).rlike(r"^[\d.,/ :-]+$")))})
    widest = g.groupBy(*SHEET).agg(F.max("n").alias("w"))
    ok = (F.col("n") >= F.greatest(F.lit(2.0), 0.6 * F.col("w"))) & (F.col("texts") >= 0.8 * F.col("n"))
    return g.join(widest, SHEET).groupBy(*SHEET).agg(F.coalesce(F.min(F.when(ok, F.col("row_no"))), F.lit(0)).alias("header_row"))


def split_blocks(grid: DataFrame) -> DataFrame:
    """Rows with their block: block number, title and column names (worked out once, on the header row). Title and blank rows that
    lead into the next block are taken off the end of a block; rows before the first header belong to none."""
    parts = tasks_for(grid)
    h = find_headers(grid, parts)
    look = neighbours(h, SHEET, "row_no", {
        "p1": (F.struct("n", "head", "label_like", "cells"), -1), "p2": (F.struct("n", "head", "label_like", "cells"), -2),
        "x1": (F.struct("is_header", "n"), 1), "x2": (F.struct("is_header", "n"), 2), "before_header": (F.col("is_header"), -1)}, parts=parts)

    def title_of(p: Column) -> Column:
        return F.when((p["n"] <= 3) & ~p["label_like"] & ~p["head"].rlike(r"^[\d.,%\-/ ]+$"), p["head"])
    title = F.when(F.col("p1.n") > 0, title_of(F.col("p1"))).when(F.col("p2.n") > 0, title_of(F.col("p2")))
    lead_in = (F.col("n") <= 2) & ~F.col("is_header") & (
        F.coalesce(F.col("x1.is_header"), F.lit(False)) | (F.coalesce(F.col("x2.is_header"), F.lit(False)) & (F.col("x1.n") <= 2)))
    first_row = F.coalesce("before_header", F.lit(False)) & (F.col("n") > 0)
    names = column_names(F.col("cells"), F.struct(F.col("p1.cells").alias("cells"), F.col("p1.n").alias("n")), F.col("width"))
    marked = look.withColumn("lead_in", lead_in & ~first_row)
    out = running(marked, SHEET, "row_no", sums={"block": F.col("is_header").cast("long")},
                  carries={"_h": F.when(F.col("is_header"), F.struct(title.alias("title"), names.alias("names")))}, parts=parts)
    return out.filter("block > 0").select(*SHEET, "row_no", "cells", "n", "head", "is_header", "lead_in", "block",
                                          F.col("_h.title").alias("title"), F.col("_h.names").alias("names"))


def column_names(header: Column, above: Column, width: Column) -> Column:
    """Names of a header row: a blank cell takes the group label above when that row is under half filled, otherwise
    `col_N`; white space is collapsed; repeats are numbered ` (2)`, ` (3)`."""
    group_row = F.coalesce(above["n"], F.lit(0)) < 0.5 * width

    def one(c: Column, i: Column) -> Column:
        up = F.trim(F.coalesce(F.get(above["cells"], i), F.lit("")))
        text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
        auto = F.concat(F.lit("col_"), (i + 1).cast("string"))
        return F.when((text != "") & ~F.lower(text).startswith("unnamed:"), text).when((text == "") & group_row & (up != ""), up).otherwise(auto)
    base = F.transform(header, one)

    def numbered(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(base, F.lit(1), i + 1), lambda x: x == c))
        return F.when(before > 1, F.concat(c, F.lit(" ("), before.cast("string"), F.lit(")"))).otherwise(c)
    return F.transform(base, numbered)


def drop_footers(blocks: DataFrame) -> DataFrame:
    """Body rows without blank rows, footers and thin trailing rows."""
    key = [*SHEET, "block"]
    size = F.size("names")
    footer = F.col("head").rlike(FOOTER) & ((F.col("n") <= F.greatest(F.lit(2.0), 0.5 * size)) | F.lower("head").isin("total", "grand total"))
    body = blocks.filter(~F.col("is_header") & ~F.col("lead_in") & (F.col("n") > 0) & ~footer)
    last = body.filter(F.col("n") >= F.greatest(F.lit(2.0), 0.3 * size)).groupBy(*key).agg(F.max("row_no").alias("_last"))
    return body.join(last, key).filter(F.col("row_no") <= F.col("_last")).drop("_last")


def tidy_cells(grid: DataFrame) -> DataFrame:
    """Raw grid to long tidy cells (file, sheet, block, title, table_id, row_no, pos, column, value). Blocks with the same
    column names share a `table_id`; empty columns of a block are dropped. Blank text is NULL."""
    body = drop_footers(split_blocks(grid))
    wide = body.withColumn("table_id", F.substring(F.sha2(F.array_join("names", "|"), 256), 1, 12))
    cells = wide.select(*SHEET, "block", "title", "table_id", "row_no", "names", "cells", F.posexplode("names").alias("pos", "column"))
    cells = cells.withColumn("value", F.nullif(F.trim(F.get("cells", F.col("pos"))), F.lit(""))).drop("names", "cells")
    used = cells.filter("value is not null").select(*SHEET, "block", "pos").distinct()
    return cells.join(used, [*SHEET, "block", "pos"], "left_semi")


def stack_table(cells: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    """One table of the tidy cells as a wide DataFrame with a leading `block` column (the title above each block)."""
    part = cells.filter(F.col("table_id") == table_id)
    label = F.coalesce("title", F.concat(F.lit("block "), F.col("block").cast("string")))
    return part.groupBy(*SHEET, label.alias("block"), "row_no").pivot("column", columns).agg(F.first("value"))


def find_tables(lines: DataFrame, key: str, separators: tuple[str, ...] = (",", "\t", "|", ";")) -> DataFrame:
    """Table blocks inside texts (key, line_no, line): runs of lines with the same count of three or more separators, at
    least two rows below a credible header (70% label-like cells, none repeated). One row per block."""
    counts = [F.struct(F.regexp_count("line", F.lit("\\" + s)).alias("n"), F.lit(s).alias("sep")) for s in separators]
    best = F.array_max(F.array(*counts))
    m = lines.withColumn("_b", best).withColumns({"_n": F.when(F.col("_b.n") >= 3, F.col("_b.n")).otherwise(0), "_sep": F.col("_b.sep")})
    look = neighbours(m, [key], "line_no", {"_pn": (F.struct("_n", "_sep"), -1)})
    start = (F.col("_n") > 0) & (F.col("_pn").isNull() | (F.col("_pn._n") != F.col("_n")) | (F.col("_pn._sep") != F.col("_sep")))
    seg = running(look, [key], "line_no", sums={"_seg": (start | (F.col("_n") == 0)).cast("long")}).filter("_n > 0")
    blocks = seg.groupBy(key, "_seg", "_sep").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.min_by("line", "line_no").alias("header"))
    heads = F.transform(F.split("header", F.concat(F.lit("\\"), F.col("_sep"))), lambda c: F.trim(c))
    good = F.filter(heads, lambda c: (c != "") & is_label(c))
    return (blocks.withColumn("columns", heads)
            .filter((F.col("last") - F.col("first") >= 2) & (F.size(good) >= 0.7 * F.size(heads)) & (F.size(F.array_distinct(good)) == F.size(good)))
            .select(key, "first", "last", F.col("_sep").alias("separator"), "columns"))
