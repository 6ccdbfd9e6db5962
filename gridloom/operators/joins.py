"""Exact joins with contracts. Sides are reduced before they meet; Spark picks broadcast or sort-merge by size."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.text import norm


def join_delta(a: DataFrame, b: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Two rounds on one id, with the change per column."""
    x = a.select(key, *[F.col(c).alias(f"{c}_before") for c in cols])
    y = b.select(key, *[F.col(c).alias(f"{c}_after") for c in cols])
    return x.join(y, key).withColumns({f"{c}_change": F.col(f"{c}_after") - F.col(f"{c}_before") for c in cols})


def missing_from(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def having_any(a: DataFrame, b: DataFrame, key: str, cond: Column) -> DataFrame:
    """Rows of `a` with at least one row in `b` that meets the condition."""
    return a.join(b.filter(cond).select(key).distinct(), key, "left_semi")


def with_label(df: DataFrame, key: str, labels: DataFrame, definitions: DataFrame, name: str, value: str,
               negate: bool = False) -> DataFrame:
    """Rows whose label equals a value at the newest version of its definition.
    labels(record_id, name, version, label), definitions(name, version)."""
    now = definitions.filter(F.col("name") == name).groupBy("name").agg(F.max("version").alias("version"))
    hit = labels.join(now, ["name", "version"]).filter(F.col("label") == value).select(F.col("record_id").alias(key)).distinct()
    return df.join(hit, key, "left_anti" if negate else "left_semi")


def threads_with_label(mail: DataFrame, thread: str, record: str, labels: DataFrame, definitions: DataFrame, name: str, value: str) -> DataFrame:
    """Threads in which any mail carries the label."""
    return with_label(mail.select(thread, record), record, labels, definitions, name, value).select(thread).distinct()


def lookup(df: DataFrame, other: DataFrame, on: tuple[str, str], cols: Sequence[str], prefix: str,
           first_name: bool = False) -> DataFrame:
    """Left lookup on folded text keys; the right side is reduced to one row per key. With `first_name`, a one-word key
    that has no exact match takes the only full name that begins with it."""
    left = df.withColumn("_k", norm(F.col(on[0]).cast("string")))
    r = other.withColumn("_k", norm(F.col(on[1]).cast("string"))).filter("_k <> ''")
    one = r.groupBy("_k").agg(F.min(F.struct(*[F.col(c) for c in cols])).alias("_v"))
    out = left.join(one, "_k", "left")
    got = F.col("_v")
    if first_name:
        firsts = one.withColumn("_f", F.split("_k", " ")[0]).groupBy("_f").agg(F.count("*").alias("_n"), F.min("_v").alias("_fv"))
        firsts = firsts.filter("_n = 1").select(F.col("_f"), "_fv")
        out = out.join(firsts, (out["_k"] == firsts["_f"]) & ~F.contains(out["_k"], F.lit(" ")), "left")
        got = F.coalesce(F.col("_v"), F.col("_fv"))
    return out.select(*df.columns, *[got[c].alias(f"{prefix}{c}") for c in cols])


def check_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join contract as one row: NULL keys on either side, left rows without a match, duplicate right keys, and for
    one-to-one duplicate left keys. `ok` is true when nothing is broken; a left join that is ok keeps its row count."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    lk = left.groupBy(*keys).agg(F.count("*").alias("l"))
    rk = right.groupBy(*keys).agg(F.count("*").alias("r"))
    both = lk.join(rk, list(keys), "full")
    got = both.agg(F.sum(F.when(null, F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0))).otherwise(0)).alias("null_keys"),
                   F.sum(F.when(F.col("l").isNotNull() & F.col("r").isNull(), F.col("l")).otherwise(0)).alias("unmatched"),
                   F.count_if(F.col("r") > 1).alias("right_duplicates"), F.count_if(F.col("l") > 1).alias("left_duplicates"))
    broken = (F.col("null_keys") + F.col("unmatched") + F.col("right_duplicates") +
              (F.col("left_duplicates") if how == "one_to_one" else F.lit(0)))
    return got.withColumn("ok", broken == 0)


def safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "many_to_one") -> DataFrame:
    """Left join that fails the job when the contract is broken. The check is one validated row joined in."""
    if how not in ("many_to_one", "one_to_one"):
        raise ValueError(f"unknown cardinality {how!r}")
    good = check_join(left, right, keys, how).select(
        F.assert_true(F.col("ok"), F.concat(F.lit("join contract broken: "), F.to_json(F.struct("*")))).alias("_ok"))
    return left.join(right, list(keys), "left").crossJoin(F.broadcast(good)).filter(F.col("_ok").isNull()).drop("_ok")  # one row


def join_facts(base: DataFrame, key: str, facts: Mapping[str, tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """Facts are aggregated to the key before they are joined, so they never multiply each other; missing is 0."""
    out, names = base, []
    for df, aggs in facts.values():
        part = df.groupBy(key).agg(*aggs)
        names += [c for c in part.columns if c != key]
        out = out.join(part, key, "left")
    return out.fillna(0, subset=names)


SHORT_AXIS = 10_000


def complete_grid(df: DataFrame, k1: str, k2: str, value: Column, name: str) -> DataFrame:
    """Every pair of the two key sets, absent pairs as 0. The second key is the short axis of the grid: up to SHORT_AXIS values
    are attached, as one array, to every first key; more of them as blocks of about that size, each a row of its own."""
    cells = df.groupBy(k1, k2).agg(value.alias(name))
    second = df.select(k2).distinct()
    blocks = -(-second.count() // SHORT_AXIS)
    part = F.pmod(F.xxhash64(k2), F.lit(max(1, blocks)))
    lists = second.groupBy(part.alias("_part")).agg(F.collect_list(k2).alias("_all"))  # about SHORT_AXIS values
    lists = F.broadcast(lists) if blocks <= 1 else lists
    grid = df.select(k1).distinct().crossJoin(lists).select(k1, F.explode("_all").alias(k2))
    return grid.join(cells, [k1, k2], "left").fillna(0, subset=[name])


def row_check(df: DataFrame, key: str, other: DataFrame, measure: Column, name: str, cond: Column, message: str) -> DataFrame:
    """Rows failing a condition that uses a figure from another table, aggregated to the key first."""
    part = other.groupBy(key).agg(measure.alias(name))
    got = df.join(part, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return got.filter(cond).withColumn("message", F.lit(message))


def overlap_join(a: DataFrame, b: DataFrame, key: str, step: int = 256) -> DataFrame:
    """Pairs of spans of one document that overlap (a.start < b.end and b.start < a.end). Both sides are cut into
    fixed-width cells and meet on (document, cell), so one long document spreads over many keys; a pair is reported
    in the first cell the two share."""
    def cells(df):
        return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step))))
    x = cells(a.select(key, "start", "end", *[c for c in a.columns if c not in (key, "start", "end")]))
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key], F.col("start"), F.col("end"))
    y = cells(y).drop("start", "end")
    hit = x.join(y, [key, "_cell"]).filter((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    return hit.filter(F.col("_cell") == F.floor(F.greatest("start", "b_start") / step)).drop("_cell")


def free_slots(busy: DataFrame, person: str, day_from: str, weekdays: int, open_hour: int, close_hour: int, minutes: int,
               count: int, not_before: str) -> DataFrame:
    """Half-hour starts in working hours of the next weekdays that overlap no busy interval. One per day first, then the
    rest in time order, `count` per person. busy(person, start, end). The calendar is a generated table of a fixed size."""
    spark = busy.sparkSession
    days = spark.range(0, weekdays * 2 + 7).select(F.date_add(F.lit(day_from).cast("date"), F.col("id").cast("int")).alias("day"))
    days = days.filter(F.weekday("day") < 5).orderBy("day").limit(weekdays)
    first = F.make_timestamp_ntz(F.year("day"), F.month("day"), F.day("day"), F.lit(open_hour), F.lit(0), F.lit(0))
    last = first + F.make_dt_interval(F.lit(0), F.lit(close_hour - open_hour), F.lit(-minutes), F.lit(0))
    slots = days.select("day", F.explode(F.sequence(first, last, F.expr("interval 30 minutes"))).alias("slot"))
    slots = slots.filter(F.col("slot") >= F.lit(not_before).cast("timestamp_ntz"))
    people = busy.select(person).distinct()
    wanted = people.crossJoin(F.broadcast(slots))  # bounded: weekdays x half hours
    length = F.expr(f"interval {minutes} minutes")
    # a busy interval blocks every half-hour start whose slot it overlaps: expand it to those starts, then anti join
    low = F.col("start") - length
    blocked = (busy.join(F.broadcast(slots.select("slot")), (F.col("slot") > low) & (F.col("slot") < F.col("end")))
               .select(person, "slot").distinct())
    from pyspark.sql import Window
    open_ = wanted.join(blocked, [person, "slot"], "left_anti")
    nth = F.row_number().over(Window.partitionBy(person, "day").orderBy("slot"))
    ranked = open_.withColumn("_nth", F.when(nth == 1, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy(person).orderBy("_nth", "slot"))  # at most weekdays x half hours
    return ranked.withColumn("place", place).filter(F.col("place") <= count).drop("_nth", "day")


def meetings(df: DataFrame, start: str, end: str, day: str = "start") -> DataFrame:
    return df.filter((F.col(day) >= F.lit(start).cast("timestamp_ntz")) & (F.col(day) < F.lit(end).cast("timestamp_ntz")))


def bare_subject(c: Column) -> Column:
    """Subject without reply and forward marks."""
    return norm(F.regexp_replace(c, r"(?i)^(\s*(re|fwd?|fw)\s*:\s*)+", ""))


def reply_target(drafts: DataFrame, mail: DataFrame) -> DataFrame:
    """Newest message from the same person with the same bare subject. drafts(draft_id, to_addr, subject),
    mail(id, from_addr, subject, date). Mail is reduced to one row per person and subject before the join."""
    newest = mail.groupBy(F.lower("from_addr").alias("_p"), bare_subject(F.col("subject")).alias("_s")).agg(F.max_by("id", F.struct("date", "id")).alias("reply_to"))
    d = drafts.withColumns({"_p": F.lower("to_addr"), "_s": bare_subject(F.col("subject"))})
    return d.join(newest, ["_p", "_s"], "left").drop("_p", "_s")


def members(df: DataFrame, col: str, other: DataFrame, other_col: str, negate: bool = False) -> DataFrame:
    """Rows whose folded value is, or is not, in another table's column. NULLs in the list change nothing."""
    keys = other.select(F.lower(F.trim(F.col(other_col).cast("string"))).alias("_k")).filter("_k is not null").distinct()
    return (df.withColumn("_k", F.lower(F.trim(F.col(col).cast("string")))).join(keys, "_k", "left_anti" if negate else "left_semi").drop("_k"))
