"""Declarative answers over one table: a Form lists measures, groupings and filters; a Spec picks from it."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.scale import numbered
from gridloom.functions.dates import edge, part
from gridloom.plans.periods import bounds, extract_period

BLANK = "(blank)"
TOTAL = "(total)"


class SpecError(ValueError):
    """The spec names something the form does not have."""


@dataclass
class Spec:
    measures: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    filters: dict = field(default_factory=dict)
    preset: list[str] = field(default_factory=list)
    date: dict = field(default_factory=dict)
    sort: dict = field(default_factory=dict)
    limit: int | None = None


@dataclass
class Form:
    """`kinds` maps a column to choice, contains, number or date. Taught measures and groupings are SQL expressions."""
    kinds: dict[str, str]
    measures: dict[str, str] = field(default_factory=dict)
    groups: dict[str, str] = field(default_factory=dict)
    presets: dict[str, dict] = field(default_factory=dict)
    known: dict[str, list[str]] = field(default_factory=dict)
    hidden: frozenset[str] = frozenset()
    labels: dict[str, str] = field(default_factory=dict)
    row_number: str | None = None  # the column that holds the source row; listings then open with it

    def measure(self, mid: str) -> Column:
        if mid in self.measures:
            return F.expr(self.measures[mid])
        if mid == "rows":
            return F.count(F.lit(1))
        agg, _, c = mid.partition(":")
        if agg in ("sum", "avg") and self.kinds.get(c) == "number" and c not in self.hidden:
            return F.sum(c) if agg == "sum" else F.avg(c)
        raise SpecError(f"no measure {mid!r}")

    def group(self, gid: str) -> Column:
        if gid in self.groups:
            return F.expr(self.groups[gid])
        c, _, what = gid.partition(":")
        if c in self.kinds and c not in self.hidden:
            if what and self.kinds[c] == "date":
                return part(F.col(c), what)
            if not what:
                return F.col(c)
        raise SpecError(f"cannot group by {gid!r}")


def _folded(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string")))


def _values(v) -> list[str]:
    return [v] if isinstance(v, str) else list(v)


def _one_filter(form: Form, c: str, v) -> list[Column]:
    kind = form.kinds.get(c)
    if kind is None:
        raise SpecError(f"cannot filter on {c!r}")
    if not isinstance(v, dict):
        if not _values(v):
            return []
        if kind == "contains":
            return [reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(x.lower()) for x in _values(v)])]
        return [_folded(c).isin([x.strip().lower() for x in _values(v)])]
    out = []
    if "contains" in v:
        out.append(F.lower(F.col(c)).contains(str(v["contains"]).lower()))
    if "not" in v:
        out.append(~_folded(c).isin([x.strip().lower() for x in _values(v["not"])]) | F.col(c).isNull())
    if "blank" in v:
        out.append(F.col(c).isNull() if v["blank"] else F.col(c).isNotNull())
    lo, hi = v.get("min", v.get("from")), v.get("max", v.get("to"))
    if kind == "date":
        lo, hi = (edge(F.lit(x), e) if x not in (None, "") else None for x, e in ((lo, False), (hi, True)))
        if lo is not None:
            out.append(F.col(c) >= lo)
        if hi is not None:
            out.append(F.col(c) < F.date_add(hi, 1))
    else:
        if lo not in (None, ""):
            out.append(F.col(c) >= float(lo))
        if hi not in (None, ""):
            out.append(F.col(c) <= float(hi))
    return out


def with_presets(form: Form, spec: Spec) -> Spec:
    """Named filter bundles; an explicit filter on the same column wins."""
    merged = dict(spec.filters)
    for name in spec.preset:
        if name not in form.presets:
            raise SpecError(f"no preset {name!r}")
        merged = {**form.presets[name], **merged}
    return replace(spec, filters=merged, preset=[])


def normalise_spec(form: Form, spec: Spec) -> Spec:
    """A date range written as a filter moves to the date slot. Excluding two or more known values so that exactly one
    known value is left becomes that value, which also leaves out blanks and unseen values."""
    filters, date = dict(spec.filters), dict(spec.date)
    for c, v in list(filters.items()):
        if not isinstance(v, dict):
            continue
        if form.kinds.get(c) == "date" and ("period" in v or "text" in v) and not date:
            date = {"column": c, **v}
            del filters[c]
        elif set(v) == {"not"} and c in form.known:
            out = {x.strip().lower() for x in _values(v["not"])}
            seen = {x.strip().lower() for x in form.known[c]}
            left = [x for x in form.known[c] if x.strip().lower() not in out]
            if len(_values(v["not"])) >= 2 and len(left) == 1 and out & seen == seen - {left[0].strip().lower()}:
                filters[c] = left
    return replace(spec, filters=filters, date=date)


def form_where(form: Form, spec: Spec, as_of: str | None = None) -> list[Column]:
    conds = [x for c, v in spec.filters.items() for x in _one_filter(form, c, v)]
    d = dict(spec.date)
    if not d:
        return conds
    c = d.get("column") or next((k for k, v in form.kinds.items() if v == "date"), None)
    if form.kinds.get(c) != "date":
        raise SpecError(f"no date column {c!r}")
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    if d.get("period"):
        lo, hi = bounds(d["period"], today)
    elif d.get("text"):
        said = extract_period(F.lit(d["text"]), today)  # literals only, so Catalyst folds it to two days
        day = F.col(c)
        return [*conds, said["from"].isNull() | (day >= said["from"]), said["to"].isNull() | (day < F.date_add(said["to"], 1))]
    else:
        lo = edge(F.lit(d["from"]), False) if d.get("from") else None
        hi = edge(F.lit(d["to"]), True) if d.get("to") else None
    if lo is not None:
        conds.append(F.col(c) >= lo)
    if hi is not None:
        conds.append(F.col(c) < F.date_add(hi, 1))
    return conds


def _name(x: str) -> str:
    return x.replace(":", "_")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    """The first `limit` rows if the caller asks for that; otherwise all."""
    return df if limit is None else df.limit(max(1, int(limit)))


def _order(spec: Spec, cols: list[str], groups: list[str]) -> list[Column]:
    """Named measure or group; else time groupings upwards; else the first measure downwards. NULLs last."""
    by, down = spec.sort.get("by"), spec.sort.get("dir", "desc") == "desc"
    if by in spec.measures or by in spec.group_by:
        key = F.col(_name(by))
        return [key.desc_nulls_last() if down else key.asc_nulls_last(), *[F.col(g) for g in groups if g != _name(by)]]
    if any(g.partition(":")[2] for g in spec.group_by):
        return [F.col(g).asc_nulls_last() for g in groups]
    return [F.col(cols[0]).desc_nulls_last(), *[F.col(g) for g in groups]]


def run_form(df: DataFrame, form: Form, spec: Spec, as_of: str | None = None, total: bool = True) -> DataFrame:
    """Rows per group, with a total row over the same filter (`is_total`) recomputed from the rows, in one pass with
    grouping sets. Sorting and the limit apply to the group rows only."""
    spec = normalise_spec(form, with_presets(form, spec))
    for cond in form_where(form, spec, as_of):
        df = df.filter(cond)
    if not spec.measures:
        return list_rows(df, form, spec)
    measures = [form.measure(m).alias(_name(m)) for m in spec.measures]
    names = [_name(m) for m in spec.measures]
    if not spec.group_by:
        return df.agg(*measures)
    groups = [_name(g) for g in spec.group_by]
    keyed = df.withColumns({f"_g{i}": form.group(g).cast("string") for i, g in enumerate(spec.group_by)})
    keys = [f"_g{i}" for i in range(len(groups))]
    sets = [keys, []] if total else [keys]
    got = keyed.groupingSets(sets, *keys).agg(*measures, F.grouping_id().alias("_gid"))
    top = F.lit(2 ** len(keys) - 1)
    shown = [F.when(F.col("_gid") == top, F.lit(TOTAL)).otherwise(F.coalesce(k, F.lit(BLANK))).alias(g)
             for k, g in zip(keys, groups)]
    got = got.select(*shown, *names, (F.col("_gid") == top).alias("is_total"))
    rows = limited(got.filter(~F.col("is_total")).orderBy(*_order(spec, names, groups)), spec.limit)
    return rows.unionByName(got.filter("is_total")) if total else rows


SHEET_ROW = "Sheet row"


def list_rows(df: DataFrame, form: Form, spec: Spec) -> DataFrame:
    """Matching rows under their form columns, shown by their labels, ordered and limited when asked; the source row comes
    first when the form has one."""
    shown = [c for c in form.kinds if c not in form.hidden]
    number = [] if form.row_number is None else [F.col(form.row_number).alias(SHEET_ROW)]
    out = df.select(*number, *shown)
    by = spec.sort.get("by")
    if by in form.kinds:
        down = spec.sort.get("dir", "desc") == "desc"
        rest = [F.col(f"`{c}`") for c in out.columns if c != by]
        out = out.orderBy(F.col(by).desc_nulls_last() if down else F.col(by).asc_nulls_last(), *rest)
    return limited(out, spec.limit).withColumnsRenamed({c: form.labels[c] for c in shown if c in form.labels})


def count_matches(df: DataFrame, form: Form, spec: Spec, as_of: str | None = None) -> DataFrame:
    spec = normalise_spec(form, with_presets(form, spec))
    for cond in form_where(form, spec, as_of):
        df = df.filter(cond)
    return df.agg(F.count(F.lit(1)).alias("matching"))


def filter_values(df: DataFrame, columns: list[str], categories: list[str] = (), choices: int = 60, most: int | None = None) -> DataFrame:
    """Values that a form offers per text column: (column, value, n, place), commonest first. A column is a choice when it has
    up to `choices` values or is a taught category; `most` values of each, when given."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    per = df.select(F.inline(F.array(*pairs))).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    few = per.groupBy("column").agg(F.count("*").alias("_d")).filter((F.col("_d") <= choices) | F.col("column").isin(list(categories)))
    ranked = numbered(per.join(few.select("column"), "column", "left_semi"), ["column"], [F.desc("n"), F.col("value")], "place")
    return ranked if most is None else ranked.filter(F.col("place") <= most)


def form_domain(df: DataFrame, texts: list[str], numbers: list[str], dates: list[str]) -> DataFrame:
    """What a form can offer per column: value counts (text columns: `choice` up to 60 values, else `contains`),
    min and max for numbers and dates, and whether a whole-number column with 2-40 values is also a grouping.
    One expand-aggregate for the text columns, one aggregate for the rest."""
    spark = df.sparkSession
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(k).alias("type"))
             for k, cs in (("text", texts), ("number", numbers)) for c in cs]
    long = df.select(F.inline(F.array(*pairs))).filter("value is not null")
    per = long.groupBy("column", "type", "value").agg(F.count("*").alias("n"))
    stats = per.groupBy("column", "type").agg(
        F.count("*").alias("distinct"),
        F.count_if((F.col("type") == "number") & (F.col("value").try_cast("double") != F.floor(F.col("value").try_cast("double")))).alias("fractions"),
        F.when(F.first("type") == "number", F.min(F.col("value").try_cast("double")).cast("string")).alias("low"),
        F.when(F.first("type") == "number", F.max(F.col("value").try_cast("double")).cast("string")).alias("high"))
    out = stats.select(
        "column", F.when(F.col("type") == "number", "number").when(F.col("distinct") <= 60, "choice").otherwise("contains").alias("filter"),
        "distinct", "low", "high",
        ((F.col("type") == "text") | (F.col("distinct").between(2, 40) & (F.col("fractions") == 0))).alias("groupable"))
    if dates:
        rows = [F.struct(F.lit(c).alias("column"), F.lit("date").alias("filter"), F.col(f"_n_{c}").alias("distinct"),
                         F.col(f"_a_{c}").alias("low"), F.col(f"_b_{c}").alias("high"), F.lit(True).alias("groupable")) for c in dates]
        aggs = [x for c in dates for x in (F.count_distinct(c).alias(f"_n_{c}"),
                                           F.date_format(F.min(c), "yyyy-MM-dd").alias(f"_a_{c}"),
                                           F.date_format(F.max(c), "yyyy-MM-dd").alias(f"_b_{c}"))]
        out = out.unionByName(df.agg(*aggs).select(F.inline(F.array(*rows))))
    return out
