"""Aggregations. Every one is a hash aggregate with a map-side partial, so a hot group costs one row per map task."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.numbers import percent, ratio
from gridloom.operators.scale import attach, numbered, quantiles, top_per_key

OTHERS = "Others"


def count_by(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.groupBy(*fields).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *fields)


def threads(mail: DataFrame, thread: str = "thread_id") -> DataFrame:
    """One row per thread. Columns used: date, subject, person, direction, is_unread, is_bulk, is_notice.
    `people` is a distinct set (bounded by the people in one thread)."""
    inbound = F.when(F.col("direction") == "in", F.col("person"))

    def at(*more: str) -> Column:
        """The date, then what the result shows, so that mails of one moment have an order."""
        return F.when(F.col("date").isNotNull(), F.struct("date", *more))
    return mail.groupBy(thread).agg(
        F.min_by("subject", at("subject")).alias("subject"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("messages"), F.array_join(F.array_sort(F.collect_set(inbound)), ", ").alias("people"),
        F.max_by("person", at("person", "direction")).alias("last_from"), F.max_by("direction", at("person", "direction")).alias("last_direction"),
        F.count_if(F.col("is_unread")).alias("unread"), F.bool_and("is_bulk").alias("is_bulk"),
        F.bool_and("is_notice").alias("is_notice"))


def pivot_change(df: DataFrame, entity: str, period: str, value: str, first, second) -> DataFrame:
    """Average per entity in two periods side by side, with the change."""
    def side(p):
        return F.avg(F.when(F.col(period) == p, F.col(value)))
    got = df.filter(F.col(period).isin(first, second)).groupBy(entity).agg(side(first).alias("before"), side(second).alias("after"))
    return got.withColumn("change", F.col("after") - F.col("before"))


def key_order(c: Column) -> list[Column]:
    """Numeric keys by number, before text keys by text."""
    n = c.cast("string").try_cast("double")
    return [n.isNull(), n, c.cast("string")]


def matrix(df: DataFrame, k1: str, k2: str, measure: Column, rows: int = 25, cols: int = 20) -> DataFrame:
    """Two-key matrix in long form, the first rows x columns by numeric-aware key order (a display cap).
    Key ranks come from the distinct keys, cut to the cap by a partial limit."""
    cells = df.groupBy(k1, k2).agg(measure.alias("value"))
    r = top_per_key(cells.select(k1).distinct(), [], key_order(F.col(k1)), rows, "row_rank")
    c = top_per_key(cells.select(k2).distinct(), [], key_order(F.col(k2)), cols, "col_rank")
    return cells.join(F.broadcast(r), k1).join(F.broadcast(c), k2)  # both sides capped above


def repeat_share(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Share of the total that comes from entities seen more than once, and how many there are."""
    per = df.groupBy(entity).agg(F.count("*").alias("n"), F.sum(value).alias("v"))
    return per.agg(F.count_if(F.col("n") > 1).alias("repeat_entities"),
                   percent(F.sum(F.when(F.col("n") > 1, F.col("v")).otherwise(0.0)), F.sum("v")).alias("repeat_share"))


def compare(df: DataFrame, col: str, value: str, targets: Sequence[str]) -> DataFrame:
    """Target groups against the rest: own average, the rest pooled by rows, the unweighted mean of the other groups,
    rank among all groups, rows and blanks. Works on one row per group after a single aggregate."""
    per = df.groupBy(col).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.count("*").alias("rows"),
                              F.count_if(F.col(value).isNull()).alias("blanks")).withColumn("figure", ratio(F.col("s"), F.col("n")))
    is_target = F.coalesce(F.col(col).isin(list(targets)), F.lit(False))  # rows without a group belong to the rest
    totals = per.agg(F.sum(F.when(~is_target, F.col("s"))).alias("rs"), F.sum(F.when(~is_target, F.col("n"))).alias("rn"),
                     F.avg(F.when(~is_target, F.col("figure"))).alias("mean_of_others"))
    hits = per.filter(is_target)
    bar = hits.select(F.col(col).alias("_target"), F.col("figure").alias("_bar"))
    ahead = (per.select("figure").join(F.broadcast(bar), F.col("figure") > F.col("_bar"))  # as many rows as targets
             .groupBy("_target").agg(F.count("*").alias("_ahead")))
    ranked_hits = hits.join(ahead, F.col(col) == F.col("_target"), "left").withColumn("rank", F.coalesce("_ahead", F.lit(0)) + 1)
    return (ranked_hits.crossJoin(F.broadcast(totals))  # one row
            .select(col, "figure", ratio(F.col("rs"), F.col("rn")).alias("rest_pooled"), "mean_of_others", "rank", "rows", "blanks"))


def profile_vs_all(df: DataFrame, cond: Column, measures: Mapping[str, str]) -> DataFrame:
    """Each average for one group against the whole table, as a percent difference; the row count as a share."""
    aggs = [x for n, c in measures.items() for x in (F.avg(F.when(cond, F.col(c))).alias(f"g_{n}"), F.avg(c).alias(f"a_{n}"))]
    one = df.agg(F.count_if(cond).cast("double").alias("g_rows"), F.count("*").cast("double").alias("a_rows"), *aggs)
    lines = [F.struct(F.lit("share of rows").alias("figure"), F.col("g_rows").alias("group_value"), F.col("a_rows").alias("all_value"),
                      percent(F.col("g_rows"), F.col("a_rows")).alias("percent"))]
    lines += [F.struct(F.lit(n).alias("figure"), F.col(f"g_{n}").alias("group_value"), F.col(f"a_{n}").alias("all_value"),
                       percent(F.col(f"g_{n}") - F.col(f"a_{n}"), F.col(f"a_{n}")).alias("percent")) for n in measures]
    return one.select(F.inline(F.array(*lines)))


def spread(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Exact quartiles, mean, maximum, the top two values and the mean without them, per key."""
    keys = list(keys)
    q = quantiles(df, keys, x, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    top = top_per_key(df.filter(F.col(x).isNotNull()).select(*keys, x), keys, [F.desc(x)], 2)
    two = top.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.col(x))).alias("top1"),
                                 F.max(F.when(F.col("rn") == 2, F.col(x))).alias("top2"), F.sum(x).alias("_two"))
    base = df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.max(x).alias("maximum"), F.sum(x).alias("_s"), F.count(x).alias("_n"))
    joined = attach(attach(base, q, keys), two, keys)
    return joined.select(*keys, "q1", "median", "q3", "mean", "maximum", "top1", "top2",
                         ratio(F.col("_s") - F.col("_two"), F.col("_n") - 2).alias("mean_without_top2"))


def known_rate(df: DataFrame, num: str, den: str, keys: Sequence[str]) -> DataFrame:
    """Rate from rows where both sides are known and the denominator is positive; excluded rows are counted."""
    ok = F.col(num).isNotNull() & (F.col(den) > 0)
    got = df.groupBy(*keys).agg(F.sum(F.when(ok, F.col(num))).alias("num"), F.sum(F.when(ok, F.col(den))).alias("den"),
                                F.count_if(~F.coalesce(ok, F.lit(False))).alias("excluded"))
    return got.withColumn("rate", percent(F.col("num"), F.col("den")))


def chosen_votes(votes: DataFrame, org: str | None = None, choice: str | None = None) -> DataFrame:
    """Votes of one organisation and of one outcome, where given; works on streams too."""
    out = votes if org is None else votes.filter(F.trim("org") == org)
    return out if choice is None else out.filter(F.col("outcome") == choice)


def tally(votes: DataFrame, org: str | None = None, choice: str | None = None) -> DataFrame:
    """Votes per outcome; a vote without one counts as `none`."""
    return chosen_votes(votes, org, choice).groupBy(F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count("*").alias("n"))


def candidate_stats(votes: DataFrame, org: str | None = None, choice: str | None = None) -> DataFrame:
    """Average seconds and tokens per candidate from the nested candidate array; candidates without a time do not count."""
    c = chosen_votes(votes, org, choice).select(F.explode("cands").alias("c")).filter("c.seconds is not null")
    return c.groupBy(F.col("c.alias").alias("alias")).agg(
        F.count("*").alias("shown"), F.avg("c.seconds").alias("avg_seconds"), F.avg("c.tokens_out").alias("avg_tokens"))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Counts of `a` by the given values of `b`, with the row total."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(v) for v in values], F.count("*").alias("total"))


def before_after(df: DataFrame, group: str, day: str, num: str, den: str, event_start: str, event_end: str, days: int) -> DataFrame:
    """Known rate per group in equal windows before and after an excluded event, and the drop."""
    d, a, b = F.to_date(F.col(day)), F.lit(event_start).cast("date"), F.lit(event_end).cast("date")
    bucket = (F.when((d >= F.date_sub(a, days)) & (d < a), F.lit("before"))
              .when((d > b) & (d <= F.date_add(b, days)), F.lit("after")))
    ok = F.col(num).isNotNull() & (F.col(den) > 0)
    rows = df.withColumn("_w", bucket).filter(F.col("_w").isNotNull() & ok)

    def rate(w):
        hit = F.col("_w") == w
        return percent(F.sum(F.when(hit, F.col(num))), F.sum(F.when(hit, F.col(den))))
    got = rows.groupBy(group).agg(rate("before").alias("before"), rate("after").alias("after"))
    return got.withColumn("drop", F.col("before") - F.col("after"))


def cohorts(df: DataFrame, entity: str, day: str, num: str, den: str) -> DataFrame:
    """Entry quarter = first scheduled quarter of the entity. Per entry and elapsed quarter: planned and known sessions
    and the rate from the known ones, `Unknown` where none is known."""
    q = F.year(day) * 4 + F.quarter(day) - 1
    rows = df.withColumn("_q", q)
    entry = rows.groupBy(entity).agg(F.min("_q").alias("_e"))
    ok = F.col(num).isNotNull() & (F.col(den) > 0)
    got = attach(rows, entry, [entity]).groupBy("_e", (F.col("_q") - F.col("_e")).alias("elapsed")).agg(
        F.count("*").alias("planned"), F.count_if(F.coalesce(ok, F.lit(False))).alias("observed"),
        percent(F.sum(F.when(ok, F.col(num))), F.sum(F.when(ok, F.col(den)))).alias("rate"))
    label = F.concat(F.floor(F.col("_e") / 4).cast("string"), F.lit("-Q"), (F.col("_e") % 4 + 1).cast("string"))
    return got.select(label.alias("entry"), "elapsed", "planned", "observed", "rate")


def top_with_others(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest keys and one row with the rest. `df` holds one row per key; the limit is partial per task."""
    best = top_per_key(df, [], [F.desc_nulls_last(value), F.col(key)], k).select(key, F.lit(True).alias("_top"))  # k rows
    marked = attach(df, best, [key])
    return marked.groupBy(F.when(F.col("_top"), F.col(key)).otherwise(OTHERS).alias(key)).agg(F.sum(value).alias(value))


def merge_points(df: DataFrame, lat: str, lon: str, category: str, size: str) -> DataFrame:
    """One row per map point: rows, the category (or `mixed`), the distinct categories, summed size."""
    return df.groupBy(lat, lon).agg(
        F.count("*").alias("rows"),
        F.when(F.min(category) == F.max(category), F.min(category)).otherwise("mixed").alias("category"),
        F.array_join(F.array_sort(F.collect_set(category)), ", ").alias("categories"), F.sum(size).alias("size"))


def centres(df: DataFrame, label: str, lat: str, lon: str) -> DataFrame:
    """Mean position and row count per label, over rows with valid coordinates."""
    ok = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return df.filter(ok).groupBy(label).agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.count("*").alias("rows"))


def extremes(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Highest and lowest entity as insight rows (one aggregate)."""
    one = df.agg(F.max_by(F.struct(entity, value), F.struct(F.col(value), F.col(entity))).alias("hi"),
                 F.min_by(F.struct(entity, value), F.struct(F.col(value), F.col(entity))).alias("lo"))
    return one.select(F.inline(F.array(
        F.struct(F.lit("highest").alias("insight"), F.col(f"hi.{entity}").alias("entity"), F.col(f"hi.{value}").alias("value")),
        F.struct(F.lit("lowest").alias("insight"), F.col(f"lo.{entity}").alias("entity"), F.col(f"lo.{value}").alias("value")))))


def change_between(df: DataFrame, entity: str, period: str, value: str, first, second, unit: str) -> DataFrame:
    """Change per entity between two times, as insight rows; percent measures are reported in percentage points."""
    got = df.filter(F.col(period).isin(first, second)).groupBy(entity).agg(
        F.max(F.when(F.col(period) == first, F.col(value))).alias("a"), F.max(F.when(F.col(period) == second, F.col(value))).alias("b"))
    return got.filter("a is not null and b is not null").select(
        F.lit("change").alias("insight"), F.col(entity).alias("entity"), (F.col("b") - F.col("a")).alias("value"),
        F.lit("percentage points" if unit == "percent" else unit).alias("unit"))


def difference_of(df: DataFrame, entity: str, period: str, value: str, at, first, second, unit: str) -> DataFrame:
    """Absolute difference of two entities at one time, as an insight row; none when one of them has no value then."""
    got = df.filter(F.col(period) == at).agg(F.max(F.when(F.col(entity) == first, F.col(value))).alias("a"), F.max(F.when(F.col(entity) == second, F.col(value))).alias("b"))
    return got.filter("a is not null and b is not null").select(
        F.lit("difference").alias("insight"), F.lit(f"{first} and {second}").alias("entity"), F.abs(F.col("b") - F.col("a")).alias("value"),
        F.lit("percentage points" if unit == "percent" else unit).alias("unit"))


def trend(df: DataFrame, bucket: Column, measures: Mapping[str, Column]) -> DataFrame:
    """Measures per `bucket` of a date (month, quarter, ...), and on every row how many rows had no readable date."""
    got = df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), *[e.alias(n) for n, e in measures.items()])
    left = got.agg(F.coalesce(F.sum(F.when(F.col("bucket").isNull(), F.col("n"))), F.lit(0)).alias("undated"))
    return got.filter("bucket is not null").crossJoin(F.broadcast(left))  # one row


def cap(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows in order, each with how many are `shown` and how many there are in `total`."""
    size = df.agg(F.count("*").alias("total")).withColumn("shown", F.least("total", F.lit(most).cast("long")))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(size))  # one row


def group_problems(df: DataFrame, key: str = "norm_value") -> DataFrame:
    """Problems with the same rule, column and value become one group: count, first and last row, first value. The
    cells themselves stay in the problems table, keyed by the same columns, so no group is gathered into one row."""
    return df.groupBy("rule", "column", key).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"),
                                                  F.max("row_no").alias("last_row"), F.min_by("value", "row_no").alias("first_value"))


def label_summary(labels: DataFrame, label: str, name: str, k: int = 5) -> DataFrame:
    """Count per label, k example names for each label but the majority one."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by(label, F.struct("n", label)).alias("_major"))
    picks = top_per_key(labels.select(label, name), [label], [F.col(name)], k)
    ex = picks.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", name))), lambda s: s[name]), ", ").alias("ex"))
    return (counts.join(ex, label, "left").crossJoin(F.broadcast(top))  # one row
            .select(label, "n", F.when(F.col(label) != F.col("_major"), F.col("ex")).otherwise("").alias("examples")))


def latest(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Newest version per key (max_by combines map-side; no window)."""
    return df.groupBy(*keys).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in cols])


def ranked(df: DataFrame, metric: str, key: str, name: str = "position") -> DataFrame:
    """Rank (ties share a place) of every row by a metric, without a single-task window."""
    n = numbered(df, [], [F.desc_nulls_last(metric), F.col(key)], "_rn")
    first = n.groupBy(metric).agg(F.min("_rn").alias(name))
    return n.join(first.withColumnRenamed(metric, "_m"), F.col(metric).eqNullSafe(F.col("_m"))).drop("_m", "_rn")


def score_rows(df: DataFrame, base: Column, flags: Mapping[str, float], name: str = "score") -> DataFrame:
    """A number plus weighted yes/no terms (SQL conditions)."""
    total = base
    for cond, weight in flags.items():
        total = total + F.when(F.expr(cond), F.lit(float(weight))).otherwise(0.0)
    return df.withColumn(name, total)


def runs(df: DataFrame, keys: Sequence[str], n: str) -> DataFrame:
    """Consecutive numbers as (first, last) runs. Within a run the number less its row number stays the same, so one
    distributed numbering and one aggregate find them; rows without a number are in no run."""
    keys = list(keys)
    placed = numbered(df.filter(F.col(n).isNotNull()).select(*keys, n).distinct(), keys, [F.col(n)], "_rn")
    return placed.groupBy(*keys, (F.col(n) - F.col("_rn")).alias("_run")).agg(F.min(n).alias("first"), F.max(n).alias("last")).drop("_run")


def take_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Best-first items whose running size stays within the budget, for any number of items per key: positions come
    from a distributed sort, running sizes from the two-level prefix sum."""
    from gridloom.operators.scale import running
    placed = numbered(df, keys, order, "_rn")
    return running(placed, keys, "_rn", sums={"used": F.col(size)}).filter(F.col("used") <= budget).drop("_rn")


def asked_again(turns: DataFrame, conv: str, turn: str, text: str, floor: float = 0.6) -> DataFrame:
    """Questions whose words overlap by `floor` or more with any of the three questions before."""
    from gridloom.functions.text import plain_words, word_overlap
    from gridloom.operators.scale import neighbours
    w = turns.withColumn("_w", F.array_distinct(plain_words(F.col(text))))
    got = neighbours(w, [conv], turn, {f"_p{i}": (F.col("_w"), -i) for i in (1, 2, 3)})
    score = F.greatest(*[F.coalesce(word_overlap(F.col("_w"), F.col(f"_p{i}")), F.lit(0.0)) for i in (1, 2, 3)])
    return got.select(conv, turn, score.alias("overlap"), (score >= floor).alias("again"))


def scope_change(turns: DataFrame, conv: str, turn: str, tables: str) -> DataFrame:
    """True when the tables used now share nothing with those of the turn before."""
    from gridloom.operators.scale import neighbours
    got = neighbours(turns, [conv], turn, {"_prev": (F.col(tables), -1)})
    return got.withColumn("changed", F.col("_prev").isNotNull() & ~F.arrays_overlap(F.col(tables), F.col("_prev"))).drop("_prev")


def event_strip(parts: Mapping[str, tuple[DataFrame, Column, Column, Column]]) -> DataFrame:
    """Fact streams mapped to (date, lane, outcome, detail) and concatenated; streams are never joined."""
    out = None
    for lane, (df, day, outcome, detail) in parts.items():
        one = df.select(day.alias("date"), F.lit(lane).alias("lane"), outcome.alias("outcome"), detail.alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, pos: str) -> DataFrame:
    """Merged lists without repeats, first place kept."""
    return df.groupBy(*keys, value).agg(F.min(pos).alias(pos))


def band_key(c: Column) -> Column:
    """Sort key of a band label: its number, `under` just below and `over` just above it; other labels after."""
    n = F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0)
    low = c.rlike(r"(?i)\b(under|below|less|fewer|up to)\b")
    high = c.rlike(r"(?i)\b(over|above|more|plus)\b|\+")
    return F.when(n != "", n.cast("double") - F.when(low, 0.5).otherwise(0.0) + F.when(high, 0.5).otherwise(0.0)).otherwise(F.lit(float("inf")))
