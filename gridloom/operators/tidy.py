"""Column-level tidying. Decisions (which columns become numbers, dates, text) come from one aggregate row whose size is
the number of columns; the rows themselves never reach the driver."""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import dates as D
from gridloom.functions.numbers import loader_number, looks_like_id, money_number
from gridloom.functions.text import blank_to_null, norm, safe_name, slug
from gridloom.operators.profile import MONTH_COLUMN, value_counts
from gridloom.operators.scale import numbered

GPS = r"^\s*(-?\d{1,2}\.\d{3,})\s*,\s*(-?\d{1,3}\.\d{3,})\s*$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"
PHONE = r"^(\+?91[-\s]?)?[6-9]\d{4}[-\s]?\d{5}$"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.simpleString() == "string"]


def _one_row(df: DataFrame, aggs: dict[str, Column]) -> dict:
    return df.agg(*[e.alias(n) for n, e in aggs.items()]).first().asDict() if aggs else {}


# How a row of totals begins, and how columns without a heading are named.
TOTAL_ROW, NO_HEADING = r"(?i)^(grand\s+)?(sub-?)?totals?\b", r"column_\d+"


def layout_rows(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Adds `layout`: repeated_header, total, subheading or NULL. The typical fill is the exact median of the row fills
    (a column of at most #columns + 1 values, so its counts are tiny)."""
    cols = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    vals = F.filter(F.array(*cols), lambda v: v != "")
    heads = F.array(*[F.lit(c.strip().lower()) for c in columns if not re.fullmatch(NO_HEADING, c.strip().lower())]).cast("array<string>")
    d = df.withColumns({"_n": F.size(vals), "_same": F.size(F.filter(vals, lambda v: F.array_contains(heads, norm(v)))),
                        "_first": F.get(vals, F.lit(0)), "_pos": F.array_position(F.transform(F.array(*cols), lambda v: v != ""), True)})
    typical = d.groupBy(*key, "_n").agg(F.count("*").alias("_c"))
    typical = typical.groupBy(*key).agg(F.expr("percentile(_n, 0.5, _c)").alias("_typ"))
    d = d.join(typical, list(key)) if key else d.crossJoin(F.broadcast(typical))  # one row
    kind = (F.when((F.col("_n") >= 2) & (F.col("_same") >= 0.6 * F.col("_n")), "repeated_header")
            .when(F.col("_first").rlike(TOTAL_ROW), "total")
            .when((F.col("_n") == 1) & (F.col("_typ") >= 3) & money_number(F.col("_first")).isNull() & (F.col("_pos") <= 2)
                  & (F.length("_first") <= 60), "subheading"))
    return d.withColumn("layout", kind).drop("_n", "_same", "_first", "_pos", "_typ")


def keep_rows(df: DataFrame, columns: Sequence[str], kinds: Sequence[str] = ("repeated_header",), key: Sequence[str] = ()) -> DataFrame:
    return layout_rows(df, columns, key).filter(F.col("layout").isNull() | ~F.col("layout").isin(list(kinds))).drop("layout")


def unique_names(names: DataFrame, scope: str, name: str, pos: str) -> DataFrame:
    """Safe names as data (scope, name, pos): slugged, repeats within a scope numbered `_2`, `_3` in place order.
    The repeat number comes from the distributed numbering, so a scope of any size is fine."""
    s = names.withColumn("safe", safe_name(F.col(name)))
    out = numbered(s, [scope, "safe"], [F.col(pos)], "_i")
    return out.withColumn("safe", F.when(F.col("_i") > 1, F.concat(F.col("safe"), F.lit("_"), F.col("_i").cast("string"))).otherwise(F.col("safe"))).drop("_i")


def safe_columns(df: DataFrame) -> DataFrame:
    """Rename every column to a safe unique name."""
    import re
    used: dict[str, int] = {}
    names = []
    for c in df.columns:
        s = re.sub("[^a-z0-9]+", "_", c.strip().lower()).strip("_") or "table"
        s = f"t_{s}" if s[0].isdigit() else s
        used[s] = used.get(s, 0) + 1
        names.append(s if used[s] == 1 else f"{s}_{used[s]}")
    return df.toDF(*names)


def coerce_numbers(df: DataFrame, threshold: float = 0.95, wide: bool = False) -> tuple[DataFrame, list[str]]:
    """Text columns whose values parse as numbers become doubles, unless half of the cells look like identifiers."""
    parse = money_number if wide else loader_number
    cols = text_columns(df)
    aggs = {}
    for c in cols:
        v = blank_to_null(F.col(c))
        aggs[f"p_{c}"] = F.avg(F.when(v.isNotNull(), parse(v).isNotNull().cast("int")))
        aggs[f"i_{c}"] = F.avg(F.when(v.isNotNull(), looks_like_id(v).cast("int")))
        aggs[f"d_{c}"] = F.avg(F.when(v.isNotNull(), v.rlike(r"\d").cast("int")))
    got = _one_row(df, aggs)
    hit = [c for c in cols if (got[f"p_{c}"] or 0) >= threshold and (got[f"d_{c}"] or 0) >= 0.9 and (got[f"i_{c}"] or 0) < 0.5]
    return df.withColumns({c: parse(blank_to_null(F.col(c))) for c in hit}), hit


def keep_ids(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Double columns of whole numbers become integers; long (1e9 or more in half the rows) and 90% unique ones text.
    Distinct values are counted only for the columns that are long."""
    cols = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    aggs = {}
    for c in cols:
        x = F.col(c)
        aggs[f"w_{c}"] = F.bool_and(F.when(x.isNotNull(), x == F.floor(x)))
        aggs[f"l_{c}"] = F.avg(F.when(x.isNotNull(), (F.abs(x) >= 1e9).cast("int")))
        aggs[f"n_{c}"] = F.count(x)
    got = _one_row(df, aggs)
    whole = [c for c in cols if got[f"w_{c}"]]
    long_ = [c for c in whole if (got[f"l_{c}"] or 0) >= 0.5]
    text = []
    for c in long_:
        distinct = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1)).count()
        if distinct >= 0.9 * got[f"n_{c}"]:
            text.append(c)
    out = df.withColumns({c: F.col(c).cast("bigint").cast("string") if c in text else F.col(c).cast("bigint") for c in whole})
    return out, [c for c in whole if c not in text], text


def split_gps(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """`lat, lon` text in 90% of the cells adds two double columns."""
    cols = text_columns(df)
    got = _one_row(df, {c: F.avg(F.when(blank_to_null(F.col(c)).isNotNull(), F.col(c).rlike(GPS).cast("int"))) for c in cols})
    hit = [c for c in cols if (got[c] or 0) >= 0.9]

    def piece(c, i):
        return F.regexp_extract(c, GPS, i).try_cast("double")
    return df.withColumns({n: e for c in hit for n, e in ((f"{c} lat", piece(c, 1)), (f"{c} long", piece(c, 2)))}), hit


def coerce_dates(df: DataFrame, day_first: bool | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Date-shaped text columns (90%, three or more values) become dates, or timestamps when any row has a time. Day-first
    is tried before month-first; a reading is accepted when 95% parse. Shapes and parses are measured over all rows."""
    cols = text_columns(df)
    orders = (True, False) if day_first is None else (day_first,)
    v, n = F.col("value"), F.col("n")
    shaped = F.coalesce(v.rlike(D.DATE_SHAPE), F.lit(False))
    tests = value_counts(df, cols).filter("value is not null").withColumn("_s", shaped)
    tests = tests.withColumns({f"_p{int(o)}": F.when(F.col("_s"), D.parse_stamp(v, o)) for o in orders})  # each distinct value once
    stats = tests.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("_s"), n).otherwise(0)).alias("shaped"),
        *[F.sum(F.when(F.col(f"_p{int(o)}").isNotNull(), n).otherwise(0)).alias(f"ok{int(o)}") for o in orders],
        *[F.bool_or((F.hour(f"_p{int(o)}") > 0) | (F.minute(f"_p{int(o)}") > 0)).alias(f"timed{int(o)}") for o in orders])
    done, exprs = {}, {}
    for r in stats.collect():  # one row per column
        if r["rows"] < 3 or r["shaped"] < 0.9 * r["rows"]:
            continue
        for o in orders:
            if r[f"ok{int(o)}"] >= 0.95 * r["rows"]:
                p = D.parse_stamp(F.col(r["column"]), o)
                exprs[r["column"]] = p.cast("timestamp_ntz") if r[f"timed{int(o)}"] else F.to_date(p)
                done[r["column"]] = "day first" if o else "month first"
                break
    return df.withColumns(exprs) if exprs else df, done


def best_format(df: DataFrame, col: str) -> DataFrame:
    """How many values each date format parses; the first with the most hits is the column's format."""
    aggs = [F.count(D.parse_one(F.col(col), f)).alias(f"f{i}") for i, f in enumerate(D.DATE_FORMATS)]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(f).alias("format"), F.col(f"f{i}").alias("hits")) for i, f in enumerate(D.DATE_FORMATS)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def variant_map(df: DataFrame, cols: Sequence[str], most: int = 60, least: int = 5) -> DataFrame:
    """(column, value, canonical): spellings that differ by case or spaces take the most frequent one, ties to the one
    with more lower-case letters. Only columns with `least` rows and at most `most` values, so the map is bounded."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]
    vc = df.select(F.inline(F.array(*pairs))).filter("trim(value) <> ''").groupBy("column", "value").agg(F.count("*").alias("n"))
    ok = vc.groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("rows")).filter((F.col("d") <= most) & (F.col("rows") >= least))
    v = vc.join(ok, "column", "left_semi").withColumns({"k": norm(F.col("value")), "lowers": F.length(F.regexp_replace("value", "[^a-z]", ""))})
    best = v.groupBy("column", "k").agg(F.trim(F.max_by("value", F.struct("n", "lowers", "value"))).alias("canonical"))
    return v.join(best, ["column", "k"]).filter("value <> canonical").select("column", "value", "canonical")


def canonicalise(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Apply the variant map. It holds at most 60 values per column, so it becomes a literal map in the projection."""
    cols = list(cols or text_columns(df))
    maps: dict[str, list] = {}
    for r in variant_map(df, cols).collect():  # at most 60 rows per column
        maps.setdefault(r["column"], []).extend([F.lit(r["value"]), F.lit(r["canonical"])])
    out = {c: F.coalesce(F.get(F.array(F.create_map(*m)), F.lit(0))[F.col(c)], F.col(c)) for c, m in maps.items()}
    return (df.withColumns(out) if out else df), sorted(maps)


def clean_column(c: Column, spec: Mapping) -> Column:
    """Cleaning expression: blank to NULL, value map on folded text, lower or title case, number or date."""
    out = blank_to_null(c)
    for old, new in (spec.get("map") or {}).items():
        out = F.when(F.lower(out) == old.strip().lower(), F.lit(new or None)).otherwise(out)
    if spec.get("case") == "lower":
        out = F.lower(out)
    elif spec.get("case") == "title":
        out = F.initcap(F.lower(out))
    if spec.get("kind") == "number":
        return money_number(out)
    if spec.get("kind") == "date":
        return D.parse_date(out, spec.get("formats") or D.DATE_FORMATS)
    return out


def clean_view(df: DataFrame, spec: Mapping[str, Mapping]) -> DataFrame:
    return df.withColumns({c: clean_column(F.col(c), s) for c, s in spec.items()})


def apply_mapping(df: DataFrame, derive: Mapping[str, str] | None = None, unify: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """New columns from SQL expressions; the first present of several column names under one name."""
    for name, expr in (derive or {}).items():
        df = df.withColumn(name, F.expr(expr))
    made = {}
    for name, options in (unify or {}).items():
        have = [F.col(c) for c in options if c in df.columns]
        if have:
            made[name] = F.coalesce(*have)
    return df.withColumns(made) if made else df


def month_columns(columns: Sequence[str]) -> list[str]:
    import re
    return [c for c in columns if re.match(MONTH_COLUMN, c.strip())]


def month_start(c: Column) -> Column:
    """First day of a month named like `Jun-25`, `June 2025`, `2025-06` or `06/2025`."""
    t = F.regexp_replace(F.trim(c), r"[\s'\-/]+", "-")
    named = F.concat(F.initcap(F.substring(t, 1, 3)), F.lit("-"), F.regexp_extract(t, r"(\d{2,4})$", 1))
    return F.to_date(F.coalesce(
        F.when(t.rlike(r"^[A-Za-z]+-?\d{4}$"), F.try_to_timestamp(named, F.lit("MMM-yyyy"))),
        F.when(t.rlike(r"^[A-Za-z]+-?\d{2}$"), D.century(F.try_to_timestamp(named, F.lit("MMM-yy")), "MMM-yy")),
        F.when(t.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M"))),
        F.when(t.rlike(r"^\d{1,2}-\d{4}$"), F.try_to_timestamp(t, F.lit("M-yyyy")))))


def unpivot_months(df: DataFrame, least: int = 4) -> DataFrame:
    """Wide month columns (four or more) to one row per month."""
    wide = month_columns(df.columns)
    if len(wide) < least:
        return df
    ids = [c for c in df.columns if c not in wide]
    return df.unpivot(ids, wide, "month_name", "value").withColumn("month", month_start(F.col("month_name")))


def melt_years(df: DataFrame) -> DataFrame:
    """`<metric>_<year>` columns (two or more years) to `year` plus one column per metric."""
    import re
    hits = {c: re.match(r"^(.+)_((?:19|20)\d{2})$", c) for c in df.columns}
    wide = {c: (m.group(1), int(m.group(2))) for c, m in hits.items() if m}
    years = sorted({y for _, y in wide.values()})
    if len(years) < 2:
        return df
    ids, metrics = [c for c in df.columns if c not in wide], sorted({m for m, _ in wide.values()})
    rows = [F.struct(F.lit(y).alias("year"), *[(F.col(f"{m}_{y}") if f"{m}_{y}" in wide else F.lit(None)).cast("double").alias(m) for m in metrics]) for y in years]
    return df.select(*ids, F.inline(F.array(*rows)))


def stack_aligned(parts: Sequence[tuple[DataFrame, Mapping[str, str], str]], tag: str = "source") -> DataFrame:
    """Tables whose headers differ but mean the same, renamed and stacked with a tag."""
    out = None
    for df, renames, name in parts:
        one = df.withColumnsRenamed(dict(renames)).withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def column_kinds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kind per text column (date, email, phone, number, category, longtext, text, empty) with blank, distinct and bad
    counts, number range, decimals and styled count. Every distinct value is tested once and weighted by its rows."""
    vc = value_counts(df, cols)
    v, n = F.col("value"), F.col("n")
    num = money_number(v)

    def rows(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))
    phone = F.regexp_replace(v, r"[\s-]", "").rlike(PHONE) | v.rlike(PHONE)
    maybe = F.col("_maybe")  # one test keeps values without any date shape away from the eight parsers
    vc = vc.withColumn("_maybe", F.coalesce(v.rlike(r"^(\d{1,4}[-/ ][A-Za-z0-9]{1,3}[-/ ]\d{2,4}|[A-Za-z]{3} \d{4})$"), F.lit(False)))
    hits = [rows(F.when(maybe, D.parse_one(v, f)).isNotNull()).alias(f"_d{i}") for i, f in enumerate(D.DATE_FORMATS)]
    s = vc.groupBy("column").agg(
        rows(v.isNull()).alias("blank"), F.count("value").alias("distinct"), rows(v.isNotNull()).alias("_n"), *hits,
        rows(v.rlike(EMAIL)).alias("_email"), rows(phone).alias("_phone"), rows(num.isNotNull()).alias("_num"),
        F.min(num).alias("low"), F.max(num).alias("high"), F.max(F.length(F.regexp_extract(v, r"^-?\d+\.(\d+)$", 1))).alias("decimals"),
        rows(v.rlike(r"(?i)rs|inr|₹|,")).alias("styled"), (F.sum(F.length(v) * n) / rows(v.isNotNull())).alias("_len"))
    dh = F.greatest(*[F.col(f"_d{i}") for i in range(len(D.DATE_FORMATS))])
    fmt = F.coalesce(*[F.when(F.col(f"_d{i}") == dh, F.lit(f)) for i, f in enumerate(D.DATE_FORMATS)])
    total = F.col("_n")
    kind = (F.when(total == 0, "empty").when(dh >= 0.6 * total, "date").when(F.col("_email") >= 0.6 * total, "email")
            .when(F.col("_phone") >= 0.6 * total, "phone").when(F.col("_num") >= 0.8 * total, "number")
            .when(F.col("distinct") <= F.greatest(F.lit(12.0), 0.2 * total), "category").when(F.col("_len") > 40, "longtext").otherwise("text"))
    s = s.withColumn("kind", kind)
    is_num = F.col("kind") == "number"
    bad = (F.when(F.col("kind") == "date", total - dh).when(F.col("kind") == "email", total - F.col("_email"))
           .when(F.col("kind") == "phone", total - F.col("_phone")).when(is_num, total - F.col("_num")))
    return s.select("column", "kind", "blank", "distinct", bad.alias("bad"), F.when(F.col("kind") == "date", fmt).alias("format"),
                    *[F.when(is_num, F.col(c)).alias(c) for c in ("low", "high", "decimals", "styled")])


def match_family(headers: DataFrame, registry: DataFrame) -> DataFrame:
    """Header sets against known families. headers(tab, header), registry(family, header); names are slugged and a header
    also matches a known one it ends with (`_suffix`). Score = hits over all names; best family per tab, kept at 0.8
    (`accepted`) and usable at 0.5."""
    h = headers.select("tab", slug(F.col("header")).alias("h")).filter(~F.lower("header").startswith("check:")).distinct()
    r = registry.select("family", slug(F.col("header")).alias("r")).distinct()
    # every underscore-suffix of a header is a key, on both sides, so the suffix rule is an equi-join

    def suffixes(c: Column) -> Column:
        w = F.split(c, "_")
        return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), "_"))
    a = h.join(r.withColumn("r_key", F.explode(suffixes(F.col("r")))), F.col("h") == F.col("r_key")).select("tab", "h", "family", "r")
    b = h.withColumn("h_key", F.explode(suffixes(F.col("h")))).join(r, F.col("h_key") == F.col("r")).select("tab", "h", "family", "r")
    both = a.union(b).distinct()
    # one-to-one: each known header goes to its smallest partner, each partner counts once
    hits = both.groupBy("tab", "family", "r").agg(F.min("h").alias("h")).groupBy("tab", "family").agg(F.count_distinct("h").alias("hits"))
    hn, rn = h.groupBy("tab").agg(F.count("*").alias("hn")), r.groupBy("family").agg(F.count("*").alias("rn"))
    scored = hits.join(hn, "tab").join(rn, "family").withColumn("score", F.col("hits") / (F.col("hn") + F.col("rn") - F.col("hits")))
    best = scored.groupBy("tab").agg(F.max(F.struct("score", "family")).alias("b"))
    return best.select("tab", F.col("b.family").alias("family"), F.round("b.score", 4).alias("score"),
                       (F.col("b.score") >= 0.8).alias("accepted"), (F.col("b.score") >= 0.5).alias("tab_ok"))
