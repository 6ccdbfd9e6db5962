"""Folder scans and file sinks: raw grids, catalogues, folder paths, incremental re-reads, logs."""
from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.operators.scale import running
from gridloom.session import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their physical place: file, line_no (0-based, blank lines counted), line. Files stay splittable:
    lines are numbered inside each split and shifted by the line counts of the splits before it. Bytes that are not
    UTF-8 are replaced."""
    raw = (spark.read.text(path, recursiveFileLookup=True)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
                   F.monotonically_increasing_id().alias("_mid"), F.make_valid_utf8("value").alias("line")))
    splits = raw.groupBy("file", "_start").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offs = splits.select("file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (raw.join(offs, ["file", "_start"])
            .select("file", (F.col("_off") + F.col("_mid") - F.col("_first")).alias("line_no"), "line"))


def split_csv(line: Column, sep: str = ",") -> Column:
    """Cells of one record; quotes removed, doubled quotes undone."""
    q = F.lit(f'{sep}("(?:[^"]++|"")*+"|[^{sep}]*)')
    cells = F.regexp_extract_all(F.concat(F.lit(sep), line), q, F.lit(1))
    return F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2),
                                               F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def _closed_after(line: Column, sep: str) -> Column:
    """Whether no quote is open at the end of a line that begins outside one. A quote opens only where a cell begins; inside a
    cell it is a character like others."""
    cell = f'(?:"[^"]*+(?:""[^"]*+)*+"[^{sep}]*+|[^{sep}"][^{sep}]*+)?+'
    return ~line.rlike(f'^(?:{cell}{sep})*+"[^"]*+(?:""[^"]*+)*+$')


def quote_states(line: Column, sep: str = ",") -> tuple[Column, Column]:
    """Whether a quote is open after a line that begins outside one, and after one that begins inside one."""
    rest = F.regexp_replace(line, f'^[^"]*+(?:""[^"]*+)*+"[^{sep}]*+{sep}?', "")
    return ~_closed_after(line, sep), line.rlike('^[^"]*+(?:""[^"]*+)*+$') | ~_closed_after(rest, sep)


_MARKED = "file string, _start long, at long, line string, b0 boolean, b1 boolean, a0 boolean, a1 boolean, r0 long, r1 long"


def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split with their place in it and, for both states that the split may begin in: whether a quote is open before
    and after the line, and how many records ended before it."""
    split, seen, state, ended = None, 0, (False, True), (0, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        files, begins = batch.column("file").to_pandas(), batch.column("_start").to_numpy()
        out, inside = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("o", "i"))
        new = np.append(True, (files.to_numpy()[1:] != files.to_numpy()[:-1]) | (begins[1:] != begins[:-1]))
        edges = [*np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            name = (files.iloc[lo], int(begins[lo]))
            if name != split:
                split, seen, state, ended = name, 0, (False, True), (0, 0)
            turns = np.cumsum(out[lo:hi] & ~inside[lo:hi]) & 1  # lines that turn the state, whichever it is
            sure = np.where(out[lo:hi] == inside[lo:hi], np.arange(hi - lo), -1)  # lines that leave one state, whichever was before
            last = np.maximum.accumulate(sure)
            cols = []
            for k in (0, 1):
                base = np.where(last >= 0, out[lo:hi][np.maximum(last, 0)] ^ turns[np.maximum(last, 0)].astype(bool), state[k])
                after = base ^ turns.astype(bool)
                done = np.cumsum(~after)
                cols.append((np.append(state[k], after[:-1]), after, ended[k] + done - ~after, ended[k] + int(done[-1])))
            yield pa.RecordBatch.from_arrays([
                batch.column("file").slice(lo, hi - lo), batch.column("_start").slice(lo, hi - lo), pa.array(seen + np.arange(hi - lo)), batch.column("line").slice(lo, hi - lo),
                pa.array(cols[0][0].astype(bool)), pa.array(cols[1][0].astype(bool)), pa.array(cols[0][1]), pa.array(cols[1][1]), pa.array(cols[0][2]), pa.array(cols[1][2])],
                names=["file", "_start", "at", "line", "b0", "b1", "a0", "a1", "r0", "r1"])
            seen, state, ended = seen + hi - lo, (bool(cols[0][1][-1]), bool(cols[1][1][-1])), (cols[0][3], cols[1][3])


def read_grid(spark: SparkSession, path: str | Sequence[str], sep: str = ",", longest: int = 10_000) -> DataFrame:
    """Raw grid of CSV or TSV files: (file, sheet, row_no, cells), no header, all text, blank rows kept. A record whose quotes
    are still open runs on into the next line.

    Files stay splittable: every split is read for both states that it may begin in, and the states, lines and records of the
    splits before it are put together from one row per split. Records of one line go on as they are read; only the lines of
    longer ones are brought together. A quote that opens a cell and is not closed within `longest` lines gathers no record: its
    lines stand alone."""
    part = "\\t" if sep == "\t" else re.escape(sep)
    text = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.make_valid_utf8("value").alias("line"))
    out, inside = quote_states(F.col("line"), part)
    marked = text.select("*", out.alias("o"), inside.alias("i")).mapInArrow(_mark_rows, _MARKED)
    ends = marked.groupBy("file", "_start").agg(F.max_by(F.struct("a0", "a1", (F.col("at") + 1).alias("n"), (F.col("r0") + (~F.col("a0")).cast("long")).alias("e0"), (F.col("r1") + (~F.col("a1")).cast("long")).alias("e1")), "at").alias("s"))
    splits = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_start", "s"))).alias("splits"))  # the splits of one file
    none = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("recs"), F.array().cast("array<struct<_start: bigint, open: boolean, lines: bigint, recs: bigint>>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["_start"].alias("_start"), acc["open"].alias("open"), acc["lines"].alias("lines"), acc["recs"].alias("recs"))
        return F.struct(F.when(acc["open"], x["s"]["a1"]).otherwise(x["s"]["a0"]).alias("open"), (acc["lines"] + x["s"]["n"]).alias("lines"),
                        (acc["recs"] + F.when(acc["open"], x["s"]["e1"]).otherwise(x["s"]["e0"])).alias("recs"), F.concat(acc["all"], F.array(here)).alias("all"))
    begin = splits.select("file", F.inline(F.aggregate("splits", none, step)["all"])).withColumnsRenamed({"lines": "_lines", "recs": "_recs", "open": "_open"})

    def pick(x: str) -> Column:
        return F.when(F.col("_open"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    placed = marked.join(begin, ["file", "_start"]).select("file", (F.col("_lines") + F.col("at")).alias("line_no"), "line", pick("b").alias("_before"), pick("a").alias("_after"), (F.col("_recs") + pick("r")).alias("_rec"))
    whole, parts = placed.filter("not _before and not _after"), placed.filter("_before or _after")
    sizes = parts.groupBy("file", "_rec").agg(F.count("*").alias("_n"), F.min("line_no").alias("_first"))
    stray = sizes.filter(F.col("_n") >= longest)
    shifts = stray.groupBy("file").agg(F.collect_list(F.struct("_rec", (F.col("_n") - 1).alias("more"))).alias("_strays"))  # one entry per `longest` lines at most

    def numbered_rows(df: DataFrame) -> DataFrame:
        """Lines that stand alone push the numbers of the records behind them."""
        before = F.aggregate(F.filter(F.coalesce("_strays", F.array().cast("array<struct<_rec: bigint, more: bigint>>")), lambda x: x["_rec"] < F.col("_rec")), F.lit(0).cast("long"), lambda s, x: s + x["more"])
        return df.join(shifts, "file", "left").select("file", F.lit("csv").alias("sheet"), (F.col("row_no") + before).alias("row_no"), split_csv(F.col("line"), sep).alias("cells"))
    long = parts.join(stray, ["file", "_rec"], "left_anti").groupBy("file", "_rec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("line"))
    alone = parts.join(stray, ["file", "_rec"]).select("file", "_rec", "line", (F.col("_rec") + F.col("line_no") - F.col("_first")).alias("row_no"))
    every = whole.select("file", "_rec", "line", F.col("_rec").alias("row_no")).unionByName(long.select("file", "_rec", "line", F.col("_rec").alias("row_no"))).unionByName(alone)
    return numbered_rows(every)


# Kind by mime part, then by extension.
MIME_KINDS = (("folder", "folder"), ("spreadsheet", "sheet"), ("text/csv", "sheet"), ("pdf", "pdf"), ("presentation", "slides"),
              ("document", "doc"), ("wordprocessing", "doc"), ("image/", "image"), ("video/", "video"), ("form", "form"))
EXTENSION_KINDS = {"sheet": ("csv", "tsv", "xls", "xlsx", "ods"), "pdf": ("pdf",), "slides": ("ppt", "pptx", "odp"),
                   "doc": ("doc", "docx", "odt", "txt", "md", "rtf"), "image": ("jpg", "jpeg", "png", "gif", "webp", "heic"),
                   "video": ("mp4", "mov", "avi", "mkv", "webm")}


def kind_of_mime(mime: Column) -> Column:
    out = F.when(F.lit(False), "")
    for part, kind in MIME_KINDS:
        out = out.when(F.lower(mime).contains(part), kind)
    return out.otherwise("other")


def kind_of_name(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), "")
    for kind, exts in EXTENSION_KINDS.items():
        out = out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, kind, size, modified. File contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), kind_of_name(F.col("path")).alias("kind"),
                    F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def catalog_of(entries: DataFrame) -> DataFrame:
    """A listing (id, name, mime, size, modified) with the kind of every entry: by its mime type, where that tells one, else by
    the ending of its name."""
    by_mime = kind_of_mime(F.coalesce("mime", F.lit("")))
    return entries.withColumn("kind", F.when(by_mime != "other", by_mime).otherwise(kind_of_name(F.col("name"))))


def resolve_paths(files: DataFrame, depth: int = 12) -> DataFrame:
    """Folder path from parent links. files(id, parent_id, name, shared). The name list doubles each round (a row takes
    over its ancestor's list), so `depth` levels need log2(depth) joins; a parent that is not listed ends in a default root."""
    known = files.select(F.col("id").alias("_pid"), F.col("name").alias("_pname"), F.lit(True).alias("_known"))
    first = files.join(known, files["parent_id"] == known["_pid"], "left")
    root = F.when(F.col("shared"), "Shared with me").otherwise("My Drive")
    cur = cut(first.select("id", F.when(F.col("_known"), F.col("parent_id")).alias("_up"), F.when(F.col("_known"), F.array("_pname"))
                           .when(F.col("parent_id").isNotNull(), F.array(root)).otherwise(F.array().cast("array<string>")).alias("_names")))
    reach = 1
    while reach < depth:
        above = cur.select(F.col("id").alias("_aid"), F.col("_up").alias("_aup"), F.col("_names").alias("_anames"))
        cur = cut(cur.join(above, cur["_up"] == above["_aid"], "left").select(
            "id", F.col("_aup").alias("_up"), F.when(F.col("_aid").isNotNull(), F.concat("_anames", "_names")).otherwise(F.col("_names")).alias("_names")))
        if not cur.filter("_up is not null").limit(1).count():
            break
        reach *= 2
    last = F.slice("_names", F.greatest(F.size("_names") - depth, F.lit(1)), F.lit(depth + 1))
    return files.join(cur.select("id", F.array_join(last, "/").alias("path")), "id")


def stale(src: DataFrame, derived: DataFrame, key: str = "id") -> DataFrame:
    """Source rows whose stored `modified` is missing or different."""
    d = derived.groupBy(key).agg(F.max("modified").alias("_had"))
    return src.join(d, key, "left").filter(~F.col("modified").eqNullSafe(F.col("_had"))).drop("_had")


def refresh_derived(src: DataFrame, derived: DataFrame, rebuilt: DataFrame, key: str = "id") -> DataFrame:
    """Derived rows after a re-read: children of changed sources replaced, children of vanished sources dropped."""
    kept = derived.join(src.select(key).distinct(), key, "left_semi").join(rebuilt.select(key).distinct(), key, "left_anti")
    return kept.unionByName(rebuilt)


def guard_formulas(df: DataFrame) -> DataFrame:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return df.withColumns({f.name: F.when(F.col(f.name).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(f.name))).otherwise(F.col(f.name))
                           for f in df.schema if f.dataType.simpleString() == "string"})


def write_csv_safe(df: DataFrame, path: str) -> None:
    guard_formulas(df).write.mode("errorifexists").csv(path, header=True, escape='"')


def append_log(df: DataFrame, path: str, at: str = "t") -> None:
    """Append rows as JSON lines below one folder per day."""
    df.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str, schema: str, today: str, days: int = 7) -> DataFrame:
    """The last `days` day folders (today included); older folders are pruned before any file is listed as input."""
    since = (dt.date.fromisoformat(today) - dt.timedelta(days=days - 1)).isoformat()
    return spark.read.schema(schema + ", day string").json(path).filter((F.col("day") >= since) & (F.col("day") <= today))


def expired_days(spark: SparkSession, path: str, schema: str, today: str, days: int = 7) -> DataFrame:
    """Day folders past the retention, for the partition-drop job."""
    since = (dt.date.fromisoformat(today) - dt.timedelta(days=days - 1)).isoformat()
    return spark.read.schema(schema + ", day string").json(path).select("day").distinct().filter(F.col("day") < since)


def size_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (parquet counts come from file footers)."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def logged_write(df: DataFrame, path: str, what: str) -> DataFrame:
    """Write a table and return its sync-log row (what, rows, seconds), counted by the write job itself."""
    import time

    from pyspark.sql import Observation
    seen, t0 = Observation(f"load {what}"), time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    n = seen.get["rows"]
    return df.sparkSession.range(1).select(F.lit(what).alias("what"), F.lit(n).cast("long").alias("rows"), F.lit(time.time() - t0).alias("seconds"))


def walk_json_strings(col: Column, fn, keys: Sequence[str] = ("content", "text", "input", "output")) -> Column:
    """Apply a text function to every content string of a JSON document, at any depth; structural values and base64
    data URLs stay as they are. A per-row helper inside an Arrow batch."""
    def visit(node, inside):
        if isinstance(node, dict):
            return {k: visit(v, k in keys) for k, v in node.items()}
        if isinstance(node, list):
            return [visit(v, inside) for v in node]
        if isinstance(node, str) and inside and not (node.startswith("data:") and ";base64," in node[:100]):
            return fn(node)
        return node

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else json.dumps(visit(json.loads(v), False), ensure_ascii=False))
    return run(col)
