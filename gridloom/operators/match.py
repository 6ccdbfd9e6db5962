"""Similarity joins and value matching. Candidates come from an equi-join on exact prefix-filter keys, so no pair that
can reach the floor is lost and no side is crossed with the other."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.similarity import RANKED, candidate_keys, jaro_winkler, may_reach, sequence_ratio
from gridloom.functions.text import norm
from gridloom.session import cut, dealt

TOGETHER = 64  # right strings of one `by` that all left ones are compared with
_SCORES = {"jaro_winkler": jaro_winkler, "ratio": sequence_ratio}


def _ranks(strings: DataFrame, size: int) -> dict[str, int]:
    """Letters or pairs of letters (`size`) by how many strings hold them, rarest first; the RANKED most frequent ones."""
    parts = F.transform(F.sequence(F.lit(1), F.length("s") - (size - 1)), lambda i: F.substring("s", i, F.lit(size)))
    held = strings.filter(F.length("s") >= size).select(F.explode(F.array_distinct(parts)).alias("x")).groupBy("x").count()
    top = held.orderBy(F.desc("count"), "x").limit(RANKED).collect()  # at most RANKED rows
    return {r["x"]: i for i, r in enumerate(reversed(top))}


def candidate_pairs(left: DataFrame, right: DataFrame, kind: str, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs (by..., l, r) of distinct strings among which are all that reach `floor`. Strings meet on sets of their rarest
    tokens, as the strings at hand count them; what met is sifted by bits before it is sent on. Keys that many strings share
    are split by the skew join; the rows that hold them are many times those of the input, so the join is never a broadcast.
    Where `by` has at most TOGETHER right strings, all left ones meet them without keys."""
    by = list(by)
    a, b = cut(left.toDF(*by, "l").filter("l <> ''").distinct()), cut(right.toDF(*by, "r").filter("r <> ''").distinct())
    few = F.lit(False)
    if by:
        sizes = cut(b.groupBy(*by).agg((F.count("*") <= TOGETHER).alias("_few")))
        a, b = a.hint("merge").join(sizes, by), b.hint("merge").join(sizes, by)  # a left string whose `by` has no right one meets none
        few = F.col("_few")
    many = cut(a.select(F.when(~few, F.col("l")).alias("s")).union(b.select(F.when(~few, F.col("r")))).filter("s is not null"))
    keys = candidate_keys(kind, floor, _ranks(many, 1), _ranks(many, 2) if kind == "ratio" else {})
    a, b = (cut(dealt(x).withColumn(c, keys(s, few)).drop("_few")) for x, c, s in ((a, "_a", "l"), (b, "_b", "r")))
    bits = [*by, "l", F.col("_a").dropFields("keys").alias("_a")], [*by, "r", F.col("_b").dropFields("keys").alias("_b")]
    fit = may_reach(kind, floor, F.col("l"), F.col("r"), F.col("_a"), F.col("_b"))
    met = (a.select(*bits[0], F.explode("_a.keys").alias("_k")).hint("merge")
           .join(b.select(*bits[1], F.explode("_b.keys").alias("_k")), [*by, "_k"])).filter(fit).select(*by, "l", "r").distinct()
    if not by:
        return met
    beside = a.filter("_a.keys is null").select(*bits[0]).hint("merge").join(b.filter("_b.keys is null").select(*bits[1]), by)
    return met.unionByName(beside.filter(fit).select(*by, "l", "r"))


def similar_pairs(left: DataFrame, right: DataFrame, kind: str, floor: float, by: Sequence[str] = ()) -> DataFrame:
    """All (by..., l, r, score) with score >= floor for distinct strings in the last columns of `left` and `right`; `by`
    columns come first on both sides and must be equal."""
    pairs = candidate_pairs(left, right, kind, floor, by)
    return pairs.withColumn("score", F.round(_SCORES[kind]("l", "r"), 12)).filter(F.col("score") >= floor)


def fuzzy_best(left: DataFrame, right: DataFrame, floor: float = 0.9) -> DataFrame:
    """Best Jaro-Winkler partner per distinct left value on trimmed lower-case text, ties to the smaller right value."""
    a = left.toDF("left_value").distinct().withColumn("l", F.lower(F.trim("left_value")))
    b = right.toDF("right_value").distinct().withColumn("r", F.lower(F.trim("right_value")))
    pairs = similar_pairs(a.select("l"), b.select("r"), "jaro_winkler", floor)
    hits = a.join(pairs, "l").join(b, "r")
    best = hits.groupBy("left_value").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("right_value"))).alias("b"))
    return best.select("left_value", F.col("b.right_value").alias("right_value"), (-F.col("b.s")).alias("score"))


def reconcile(master: DataFrame, key: str, entries: DataFrame, entry: str, floor: float = 0.9) -> DataFrame:
    """Entries per master row through their best match; master rows without any are kept with zero. Entries are
    counted per spelling first, so a spelling with many rows joins as one row."""
    spelled = entries.groupBy(entry).agg(F.count("*").alias("_n"))
    best = fuzzy_best(spelled.select(entry), master.select(key), floor)
    counts = (spelled.join(best, spelled[entry] == best["left_value"]).groupBy("right_value").agg(F.sum("_n").alias("entries")))
    return (master.select(key).distinct().join(counts, F.col(key) == F.col("right_value"), "left")
            .select(key, F.coalesce("entries", F.lit(0)).alias("entries")))


def discover_bridges(values: DataFrame, max_left: int | None = None) -> DataFrame:
    """Pairs of text columns in different tables that name the same things with different spellings.
    `values(table, column, value)`: distinct values of candidate columns. A bridge has a fuzzy share of 0.85 or more,
    an exact share of 0.8 or less, at least three values gained and, when given, at most `max_left` values on the smaller
    side."""
    v = values.withColumn("col_id", F.concat_ws(".", "table", "column")).withColumn("n", F.lower(F.trim("value"))).select("col_id", "table", "n").distinct()
    size = v.groupBy("col_id", "table").agg(F.count("*").alias("size"))
    left = v if max_left is None else v.join(size.filter(F.col("size") <= max_left).select("col_id"), "col_id", "left_semi")
    same = left.select("n").distinct()
    pairs = similar_pairs(same, v.select("n").distinct(), "jaro_winkler", 0.9)
    a, b = left.select(F.col("col_id").alias("l_col"), F.col("table").alias("l_t"), F.col("n").alias("l")), \
        v.select(F.col("col_id").alias("r_col"), F.col("table").alias("r_t"), F.col("n").alias("r"))
    hit = (a.join(pairs, "l").join(b, "r").filter("l_t <> r_t")
           .groupBy("l_col", "r_col", "l").agg(F.max((F.col("l") == F.col("r")).cast("int")).alias("exact")))
    per = hit.groupBy("l_col", "r_col").agg(F.count("*").alias("fuzzy"), F.sum("exact").alias("exact"))
    s1, s2 = size.select(F.col("col_id").alias("l_col"), F.col("size").alias("l_size")), size.select(F.col("col_id").alias("r_col"), F.col("size").alias("r_size"))
    return (per.join(s1, "l_col").join(s2, "r_col").filter("r_size >= l_size")
            .withColumns({"fuzzy_share": F.col("fuzzy") / F.col("l_size"), "exact_share": F.col("exact") / F.col("l_size")})
            .filter("fuzzy_share >= 0.85 and exact_share <= 0.8 and fuzzy - exact >= 3")
            .select(F.col("l_col").alias("column"), F.col("r_col").alias("master"), "fuzzy", "exact", "fuzzy_share", "exact_share"))


def place_key(c: Column, aliases: dict[str, str]) -> Column:
    """Accent-folded, lower-case, without a closing `district`, letters and digits only, aliases applied."""
    from gridloom.functions.text import accent_fold
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(accent_fold(c))), r"\bdistrict\s*$", ""), "[^a-z0-9]", "")
    for old, new in aliases.items():
        bare = F.when(bare == old, new).otherwise(bare)
    return bare


# Older and variant spellings of places.
PLACE_ALIASES = {"ahmadnagar": "ahmednagar", "ahmadabad": "ahmedabad", "hugli": "hooghly", "bombay": "mumbai", "calcutta": "kolkata"}


def match_place(names: DataFrame, name: str, ref: DataFrame, place: str, state: tuple[str, str] | None = None) -> DataFrame:
    """Unique normalised match, else the best similarity of 0.86 or more that leads the runner-up by 0.04; ambiguous
    names match nothing. `state` = (column in names, column in ref) narrows both steps."""
    on = ["_s"] if state else []
    n = names.withColumn("_k", place_key(F.col(name), PLACE_ALIASES))
    r = ref.withColumn("_rk", place_key(F.col(place), PLACE_ALIASES))
    if state:
        n, r = n.withColumn("_s", place_key(F.col(state[0]), {})), r.withColumn("_s", place_key(F.col(state[1]), {}))
    want = cut(n.filter("_k <> ''").select("_k", *on).distinct())
    r = r.select(F.col("_rk"), F.col(place).alias("_place"), *on)
    exact = want.join(r, (want["_k"] == r["_rk"]) & (want["_s"] == r["_s"]) if state else want["_k"] == r["_rk"]).select(
        want["_k"], *[want[x] for x in on], "_place").groupBy("_k", *on).agg(F.count("*").alias("_n"), F.min("_place").alias("_place"))
    open_ = want.join(exact, ["_k", *on], "left_anti")
    # scores down to 0.82 are needed to know the runner-up of a 0.86 match
    pairs = similar_pairs(open_.select("_k"), r.select("_rk"), "ratio", 0.82)
    cand = open_.join(pairs, open_["_k"] == pairs["l"]).drop("l")
    cand = cand.join(r, (cand["r"] == r["_rk"]) & (cand["_s"] == r["_s"]) if state else cand["r"] == r["_rk"]).select(
        cand["_k"], *[cand[x] for x in on], "score", "_place")
    near = _clear_winner(cand, ["_k", *on], "score", "_place", 0.86, 0.04)
    got = exact.filter("_n = 1").select("_k", *on, "_place", F.lit(1.0).alias("score")).unionByName(near)
    return n.join(got, ["_k", *on], "left").drop("_k", *on).withColumnRenamed("_place", "matched")


def _clear_winner(cand: DataFrame, keys: Sequence[str], score: str, value: str, floor: float, lead: float) -> DataFrame:
    """Best value per key when it reaches the floor and leads the second best. Both come from aggregates: the best
    struct, then the best score among the others."""
    best = cand.groupBy(*keys).agg(F.max(F.struct(score, value)).alias("_b"))
    rest = (cand.join(best, list(keys)).filter(~((F.col(score) == F.col("_b")[score]) & (F.col(value) == F.col("_b")[value])))
            .groupBy(*keys).agg(F.max(score).alias("_second")))
    return (best.join(rest, list(keys), "left")
            .filter((F.col("_b")[score] >= floor) & (F.col("_second").isNull() | (F.col("_b")[score] - F.col("_second") >= lead)))
            .select(*keys, F.col("_b")[value].alias(value), F.col("_b")[score].alias(score)))


def closest_value(values: DataFrame, col: str, options: DataFrame, option: str) -> DataFrame:
    """Closest allowed value per distinct value: equal after folding, else the only close one at 0.75 or the one that
    leads the second by more than 0.08. Values with no clear winner give NULL."""
    v = values.select(F.col(col).alias("value")).filter("value is not null").distinct().withColumn("_n", norm(F.col("value")))
    o = options.select(F.col(option).alias("_o")).filter("_o is not null").groupBy(norm(F.col("_o")).alias("_on")).agg(F.max("_o").alias("_o"))
    same = v.join(o, v["_n"] == o["_on"]).select("value", F.col("_o").alias("closest"), F.lit(1.0).alias("score"), F.lit("same apart from case or spaces").alias("why"))
    open_ = cut(v.join(o, v["_n"] == o["_on"], "left_anti"))
    pairs = similar_pairs(open_.select("_n"), o.select("_on"), "ratio", 0.75)
    near = _clear_winner(pairs, ["l"], "score", "r", 0.75, 0.08 + 1e-12)
    near = near.join(o, near["r"] == o["_on"]).select("l", "_o", "score")
    tail = (open_.join(near, open_["_n"] == near["l"], "left")
            .select("value", F.col("_o").alias("closest"), "score", F.when(F.col("_o").isNotNull(), "close spelling").alias("why")))
    return same.unionByName(tail)


def contained(needles: DataFrame, hays: DataFrame, size: int = 3) -> DataFrame:
    """(l, r) for every non-empty string of `needles` that is part of one of `hays`, letter by letter. A needle meets the hays
    on the one of its pieces of `size` letters that the fewest hays hold (on itself, when it is shorter)."""
    def pieces(c: Column, n: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    l, r = cut(needles.toDF("l").filter("l <> ''").distinct()), cut(hays.toDF("r").filter("r <> ''").distinct())
    width = F.least(F.length("l"), F.lit(size))
    sizes = [x["n"] for x in l.select(width.alias("n")).distinct().collect()]  # `size` numbers at most
    grams = None
    for n in sizes:
        one = r.filter(F.length("r") >= n).select("r", F.explode(pieces(F.col("r"), F.lit(n))).alias("g"))
        grams = one if grams is None else grams.unionByName(one)
    if grams is None:
        return l.select("l", F.lit("").alias("r")).limit(0)
    held = grams.groupBy("g").agg(F.count("*").alias("c"))
    asked = l.select("l", F.explode(pieces(F.col("l"), width)).alias("g")).join(held, "g", "left")
    key = asked.groupBy("l").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("k")).filter("k.c > 0").select("l", "k.g")
    return grams.join(key, "g").filter(F.col("r").contains(F.col("l"))).select("l", "r")


def match_value(values: DataFrame, col: str, options: DataFrame, option: str) -> DataFrame:
    """The known value meant by what was written (value, matched, how): equal but for case and outer spaces, else the only
    known value that holds it or lies in it, else the closest at 0.8, else the one whose first word is closest at 0.75 - first
    for the whole text, then for its first word. Ties go to the smaller known value; NULL when nothing fits."""
    first = lambda c: F.split(c, r"\s+")[0]
    o = cut(options.select(F.lower(F.trim(option)).alias("k"), F.col(option).alias("_o")).filter("k <> ''").groupBy("k").agg(F.min("_o").alias("_o")))
    v = cut(values.select(F.col(col).alias("value")).filter("value is not null").distinct().withColumn("low", F.lower(F.trim("value"))))
    low = v.filter("low <> ''").select("low").distinct()
    done = low.join(o, F.col("low") == F.col("k")).select("low", "_o", F.lit("same").alias("how"))
    open_ = cut(low.join(done, "low", "left_anti"))
    inside = contained(open_, o.select("k")).select(F.col("l").alias("low"), F.col("r").alias("k"))
    around = contained(o.select("k"), open_).select(F.col("r").alias("low"), F.col("l").alias("k"))
    one = inside.unionByName(around).distinct().groupBy("low").agg(F.count("*").alias("c"), F.min("k").alias("k")).filter("c = 1").join(o, "k")
    one = cut(one.select("low", "_o", F.lit("contained").alias("how")))
    open_ = cut(open_.join(one, "low", "left_anti"))
    found = [done, one]
    heads = o.select(first(F.col("k")).alias("h"), "_o").groupBy("h").agg(F.max("_o").alias("_o"))
    tries = (("close", F.col("low"), o.select(F.col("k").alias("h"), "_o"), 0.8), ("close first word", F.col("low"), heads, 0.75),
             ("word close", first(F.col("low")), o.select(F.col("k").alias("h"), "_o"), 0.8), ("word close to first word", first(F.col("low")), heads, 0.75))
    for how, asked, known, floor in tries:
        a = open_.select("low", asked.alias("a"))
        best = similar_pairs(a.select("a"), known.select("h"), "ratio", floor).groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r").alias("h"))).alias("b"))
        got = cut(a.join(best, F.col("a") == F.col("l")).join(known, F.col("b.h") == F.col("h")).select("low", "_o", F.lit(how).alias("how")))
        found.append(got)
        open_ = cut(open_.join(got, "low", "left_anti"))
    return v.join(reduce(DataFrame.unionByName, found), "low", "left").select("value", F.col("_o").alias("matched"), "how")


def variant_groups(df: DataFrame, col: str, max_values: int | None = None, first: int | None = None) -> DataFrame:
    """Groups of near-equal spellings in a column: same letters and digits, or keys of five or more characters with a ratio of
    0.88. Linked values share the smallest label (propagated until nothing changes); members are listed by frequency.
    `max_values` leaves out columns of more distinct values, `first` keeps the largest groups."""
    v = df.filter(F.trim(col) != "").groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    if max_values is not None:
        sized = v.limit(max_values + 1).agg(F.count("*").alias("_d"))
        v = v.crossJoin(F.broadcast(sized)).filter(F.col("_d") <= max_values).drop("_d")  # one row
    v = cut(v.withColumn("k", F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")))
    keys = v.select("k").distinct()
    near = similar_pairs(keys.filter(F.length("k") >= 5), keys.filter(F.length("k") >= 5), "ratio", 0.88).select("l", "r").filter("l <> r")
    label = components(keys.select("k"), near)
    grouped = v.join(label, "k").groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("value")))).alias("g"), F.sum("n").alias("rows"))
    out = grouped.filter(F.size("g") > 1).select(F.array_join(F.transform("g", lambda s: s["value"]), " | ").alias("members"), "rows")
    out = out.orderBy(F.desc("rows"), "members")
    return out if first is None else out.limit(first)


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest connected node per node over undirected edges (l, r given in both directions or one). Labels travel
    along edges and then jump to the label's own label, so rounds grow with the logarithm of the path length."""
    e = cut(edges.select("l", "r").union(edges.select(F.col("r").alias("l"), F.col("l").alias("r"))).distinct())
    cur = nodes.toDF("k").distinct().withColumn("label", F.col("k"))
    for _ in range(rounds):
        seen = e.join(cur, e["r"] == cur["k"]).groupBy("l").agg(F.min("label").alias("_m"))
        moved = cur.join(seen, cur["k"] == seen["l"], "left").select("k", F.col("label").alias("_old"), F.least("label", "_m").alias("label"))
        jump = moved.select(F.col("k").alias("label"), F.col("label").alias("_root"))
        nxt = cut(moved.join(jump, "label", "left").select("k", "_old", F.least("label", "_root").alias("label")))
        changed = nxt.filter("label <> _old").limit(1).count()
        cur = nxt.drop("_old")
        if not changed:
            return cur
    raise RuntimeError("labels still moving; raise `rounds`")
