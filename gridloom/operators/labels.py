"""Versioned definitions, incremental labelling, score decisions, and evaluation of labels and runs."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.similarity import sequence_ratio
from gridloom.operators.match import similar_pairs
from gridloom.session import cut

UNSURE = "unsure"


def define(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append to the definitions (name, version, ask, answers, kind): the same ask, answers and kind keep their
    version, any change adds one; `unsure` is always an answer."""
    n = new.withColumn("answers", F.array_distinct(F.concat("answers", F.array(F.lit(UNSURE)))))
    now = existing.groupBy("name").agg(F.max("version").alias("v"), F.max_by(F.struct("ask", "answers", "kind"), "version").alias("d"))
    j = n.join(now, "name", "left")
    same = (F.col("d.ask") == F.col("ask")) & (F.array_sort("d.answers") == F.array_sort("answers")) & (F.col("d.kind") == F.col("kind"))
    return j.filter(F.col("v").isNull() | ~same).select("name", (F.coalesce("v", F.lit(0)) + 1).alias("version"), "ask", "answers", "kind")


def label(records: DataFrame, key: str, text: str, labels: DataFrame, name: str, version: int, answers: Sequence[str],
          scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """New labels (record_id, name, version, label, source_hash) for rows without a label of this version or whose text
    changed since. The scorer sees Arrow batches and returns answers; a failure (None) is not stored, an answer outside
    the set becomes `unsure`."""
    h = F.sha2(F.col(text), 256)
    had = labels.filter((F.col("name") == name) & (F.col("version") == version)).select(F.col("record_id").alias(key), F.col("source_hash").alias("_h")).distinct()
    todo = records.select(key, text, h.alias("_h")).join(had, [key, "_h"], "left_anti")
    kind = dict(records.dtypes)[key]
    allowed = set(answers) | {UNSURE}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = scorer(pdf[text])
            keep = got.notna()
            yield pd.DataFrame({"record_id": pdf[key][keep], "label": got[keep].map(lambda a: a if a in allowed else UNSURE), "source_hash": pdf["_h"][keep]})
    made = todo.mapInPandas(run, f"record_id {kind}, label string, source_hash string")
    return made.select("record_id", F.lit(name).alias("name"), F.lit(version).alias("version"), "label", "source_hash")


def merge_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after a run: a new label replaces the old one of the same record and definition version."""
    return old.join(new.select("record_id", "name", "version"), ["record_id", "name", "version"], "left_anti").unionByName(new)


def relabel(records: DataFrame, key: str, text: str, labels: DataFrame, name: str, version: int, answers: Sequence[str],
            scorer: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """All labels after a run: one per record, definition and version. A record whose text changed loses its old label, also
    when the scorer fails on the new text; labels of records that are gone and of other definitions stay."""
    new = cut(label(records, key, text, labels, name, version, answers, scorer))
    now = records.select(F.col(key).alias("record_id"), F.sha2(F.col(text), 256).alias("_now"))
    own = (F.col("name") == name) & (F.col("version") == version)
    kept = labels.join(now, "record_id", "left").filter(~own | F.col("_now").isNull() | F.col("source_hash").eqNullSafe(F.col("_now"))).drop("_now")
    return merge_labels(kept, new)


def decide_yes_no(p: Column) -> Column:
    return F.when(p > 0.65, "yes").when(p < 0.35, "no").when(p.isNotNull(), UNSURE)


def decide_choice(scores: Column) -> Column:
    """Answer of an array<struct<answer,score>>: 0.5 or more, or 0.4 with a lead of 0.15; else unsure."""
    best = F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("m"), s["answer"].alias("answer"))))
    top, second = -F.get(best, F.lit(0))["m"], F.coalesce(-F.get(best, F.lit(1))["m"], F.lit(0.0))
    return F.when((top >= 0.5) | ((top >= 0.4) & (top - second >= 0.15)), F.get(best, F.lit(0))["answer"]).otherwise(UNSURE)


def label_eval(results: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Per group: right, right on hard items, missed yes, false yes, unsure, failed, median seconds, cost.
    results(truth, answer, hard, seconds, cost). The median is exact and distributed."""
    from gridloom.operators.scale import attach, quantiles
    t, a = F.col("truth"), F.col("answer")
    got = results.groupBy(*group).agg(
        F.count("*").alias("items"), F.count_if(t == a).alias("right"), F.count_if((t == a) & F.col("hard")).alias("hard_right"),
        F.count_if((t == "yes") & (a == "no")).alias("missed_yes"), F.count_if((t == "no") & (a == "yes")).alias("false_yes"),
        F.count_if(a == UNSURE).alias("unsure"), F.count_if(a.isNull()).alias("failed"), F.sum("cost").alias("cost"))
    return attach(got, quantiles(results, list(group), "seconds", {"median_seconds": 0.5}), list(group))


def map_parts(docs: DataFrame, key: str, text: str, fn: Callable[[pd.Series], pd.Series], combine: Callable[[Column], Column], size: int = 7000,
              most: int | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply a text function to 7000-character parts of the whole text (of its first `most` characters, if given), then combine
    per document in part order. An empty text is one empty part. Parts already in cache(hash, result) are not run again; returns (results, new cache rows)."""
    own = F.col(text) if most is None else F.substring(F.col(text), 1, most)
    pieces = F.when(own == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(own, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))  # one pass, whatever the length
    parts = docs.select(key, F.posexplode(pieces).alias("part", "piece")).withColumn("hash", F.sha2("piece", 256))
    todo = parts.select("hash", "piece").distinct() if cache is None else parts.select("hash", "piece").distinct().join(cache.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"hash": pdf["hash"], "result": fn(pdf["piece"]).astype(str)})
    new = todo.mapInPandas(run, "hash string, result string")
    known = new if cache is None else cache.select("hash", "result").unionByName(new)
    ordered = parts.join(known, "hash").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "result"))).alias("p"))  # length / size parts
    return ordered.select(key, combine(F.transform("p", lambda s: s["result"])).alias("result")), new


def row_match_eval(truth: DataFrame, got: DataFrame, doc: str, cols: Sequence[str], floors: Sequence[float] = (0.8, 0.65)) -> DataFrame:
    """Extracted rows against true rows per document: mean of the best similarity per true row, and the share of true cells
    found exactly. The best match is exact, found from the highest bound down: a similarity join brings all pairs of a
    document that can reach the first floor, judged by lengths and character counts; a true row with a match there is
    settled, since nothing below can be better. The rows still open go to the next floor, and only those without a match at
    the last one are compared with every row of their document."""
    def line(df: DataFrame, name: str) -> DataFrame:
        low = [F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in cols]
        return df.select(doc, F.concat_ws(" ", *low).alias(name))
    every = line(truth, "l")
    open_, have, best = cut(every.distinct()), cut(line(got, "r").distinct()), None
    for floor in floors:
        found = cut(similar_pairs(open_, have, "ratio", floor, by=[doc]).groupBy(doc, "l").agg(F.max("score").alias("s")))
        best = found if best is None else best.unionByName(found)
        open_ = cut(open_.join(found, [doc, "l"], "left_anti"))
    left = open_.join(have, doc).withColumn("s", sequence_ratio("l", "r")).groupBy(doc, "l").agg(F.max("s").alias("s"))
    best = left if best is None else best.unionByName(left)
    rows = every.join(best, [doc, "l"], "left").groupBy(doc).agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("similarity"))
    cells = F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in cols])
    tc = truth.select(doc, F.explode(cells).alias("c")).filter("c is not null")
    gc = got.select(doc, F.explode(cells).alias("c")).filter("c is not null").distinct()
    hit = tc.join(gc.withColumn("_hit", F.lit(1)), [doc, "c"], "left").groupBy(doc).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("cell_hits"))
    return rows.join(hit, doc)


def run_summary(results: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per run: turns, errors, median seconds, and per kind how many were covered and correct.
    results(run, kind, covered, correct, error, seconds)."""
    from gridloom.operators.scale import attach, quantiles
    per = [x for k in kinds for x in (F.count_if((F.col("kind") == k) & F.col("covered")).alias(f"{k}_covered"), F.count_if((F.col("kind") == k) & F.col("correct")).alias(f"{k}_correct"))]
    base = results.groupBy("run").agg(F.count("*").alias("turns"), F.count_if(F.col("error")).alias("errors"), *per)
    return attach(base, quantiles(results, ["run"], "seconds", {"median_seconds": 0.5}), ["run"])
