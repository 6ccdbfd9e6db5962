"""Ordered step plans: filter, derive, group, sort and limit composed with DataFrame.transform."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.numbers import percent


class PlanError(ValueError):
    """A step that would give a wrong or meaningless figure."""


def condition(col: str, cmp: str, value) -> Column:
    """Comparison with NULL-aware equality and case-insensitive containment."""
    c = F.col(col)
    if cmp == "eq":
        return c.isNull() if value is None else c == value
    if cmp == "ne":
        return c.isNotNull() if value is None else c != value
    if cmp in ("lt", "le", "gt", "ge"):
        return {"lt": c < value, "le": c <= value, "gt": c > value, "ge": c >= value}[cmp]
    if cmp == "in":
        return c.isin(list(value))
    if cmp == "between":
        return c.between(*value)
    if cmp == "contains":
        return F.lower(c.cast("string")).contains(str(value).lower())
    raise PlanError(f"unknown comparison {cmp!r}")


def apply_filter(df: DataFrame, col: str, cmp: str, value) -> DataFrame:
    return df.filter(condition(col, cmp, value))


def derive(df: DataFrame, kind: str, a: str, b: str, name: str, percents: Sequence[str] = ()) -> DataFrame:
    """Percent, ratio or difference of two columns."""
    if a == b:
        raise PlanError("the two columns are the same")
    if name in df.columns:
        raise PlanError(f"column {name!r} exists")
    if kind == "percent" and (a in percents or b in percents):
        raise PlanError("a percent of a percent has no meaning")
    x, y = F.col(a), F.col(b)
    made = {"percent": percent(x, y), "ratio": x / F.nullif(y.cast("double"), F.lit(0.0)), "difference": x - y}
    if kind not in made:
        raise PlanError(f"unknown derivation {kind!r}")
    return df.withColumn(name, made[kind])


_AGGS = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def group(df: DataFrame, by: Sequence[str], aggs: Sequence[tuple[str, str, str]], unique: Sequence[str] = ()) -> DataFrame:
    """(kind, column, name) aggregates; kind `weighted_percent` takes "a/b". Grouping by a unique key is refused."""
    if by and set(unique) <= set(by) and unique:
        raise PlanError(f"rows are already unique by {list(unique)}")
    made = []
    for kind, col, name in aggs:
        if kind == "weighted_percent":
            a, b = col.split("/")
            made.append(percent(F.sum(a), F.sum(b)).alias(name))
        else:
            made.append((F.count(F.lit(1)) if col == "*" else _AGGS[kind](col)).alias(name))
    return df.groupBy(*by).agg(*made)


def run_plan(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """Steps in order; Catalyst pushes filters and prunes columns through the whole chain."""
    percents: list[str] = []
    for s in steps:
        op = s["op"]
        if op == "filter":
            df = df.transform(apply_filter, s["column"], s["cmp"], s.get("value"))
        elif op == "derive":
            df = df.transform(derive, s["kind"], s["a"], s["b"], s["name"], percents)
            if s["kind"] == "percent":
                percents.append(s["name"])
        elif op == "group":
            df = df.transform(group, s["by"], [tuple(a) for a in s["aggs"]], s.get("unique", ()))
        elif op == "sort":
            c = F.col(s["column"])
            then = [F.col(x) for x in s.get("then", ())]
            df = df.orderBy(c.desc_nulls_last() if s.get("dir") == "desc" else c.asc_nulls_last(), *then)
        elif op == "limit":
            df = df.limit(int(s["n"]))
        else:
            raise PlanError(f"unknown step {op!r}")
    return df
