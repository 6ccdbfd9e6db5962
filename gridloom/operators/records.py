"""Filters over the record store: field conditions, label conditions, empty records, chart shapes, units."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.joins import with_label


def record_filter(df: DataFrame, key: str, where: Sequence[Mapping], me: str = "", labels: DataFrame | None = None, definitions: DataFrame | None = None) -> DataFrame:
    """Structured conditions: {field, op, value}; op `~` contains (any case), `=`, `!=`, `<`, `<=`, `>`, `>=`; the value `me`
    is the own account; field `label.NAME` compares with the label at the newest definition version."""
    for w in where:
        f, op, v = w["field"], w["op"], w["value"]
        v = me if v == "me" else v
        if f.startswith("label."):
            df = with_label(df, key, labels, definitions, f[6:], v, negate=op == "!=")
            continue
        c = F.col(f)
        cond = {"~": lambda: F.lower(c).contains(str(v).lower()), "=": lambda: c == v, "!=": lambda: c != v, "<": lambda: c < v,
                "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v}[op]()
        df = df.filter(cond)
    return df


def drop_empty(files: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Files without zero-byte non-containers and without non-PDF files whose read text is blank.
    files(key, kind, size), pages(key, text): a file that was never read stays."""
    blank = pages.groupBy(key).agg(F.bool_or(F.trim("text") != "").alias("_some")).filter("not _some").select(key)
    sized = files.filter(F.col("kind").isin("folder", "sheet", "doc", "slides") | (F.coalesce("size", F.lit(1)) > 0))
    return sized.filter("kind = 'pdf'").unionByName(sized.filter("kind <> 'pdf'").join(blank, key, "left_anti"))


def unit_of(fmt: Column, name: Column) -> Column:
    """Unit of a measure from its format and label, so unlike units never share an axis."""
    n = F.lower(name)
    return (F.when(fmt.isin("currency", "rupees", "money") | n.rlike(r"\b(rs|inr|rupees?|amount|income|cost|budget|spend)\b|₹"), "currency")
            .when((fmt == "percent") | n.rlike(r"%|\b(percent|pct|rate|share)\b"), "percent")
            .when(n.rlike(r"\bmonths?\b"), "months").when(n.rlike(r"\b(score|marks|rating)\b"), "score")
            .when((fmt == "count") | n.rlike(r"\b(count|number of|no\.? of)\b"), "count").otherwise("number"))


def chart_shape(df: DataFrame) -> DataFrame:
    """Chart shape of an aggregated result as one row: kpi, map, line, matrix, bar or table, from column types, names and
    one aggregate of row and distinct counts."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    numeric = [c for c, x in types.items() if x in ("int", "bigint", "double", "float", "long")]
    text = [c for c in types if c not in numeric]
    times = [c for c, x in types.items() if x.startswith(("date", "timestamp")) or any(w in c.lower() for w in ("month", "year", "date", "quarter"))]
    one = df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"d_{c}") for c in text])
    lat, lon = any("lat" == c.lower() for c in numeric), any(c.lower() in ("lon", "lng", "long") for c in numeric)
    keys = [c for c in text if c not in times]
    shape = (F.when((F.col("rows") == 1) & F.lit(len(numeric) >= 1 and not text), "kpi")
             .when(F.lit(lat and lon), "map")
             .when(F.lit(bool(times) and len(numeric) > 0) & (F.col("rows") > 1), "line"))
    if len(text) == 2 and len(numeric) == 1:
        shape = shape.when((F.col("rows") > 1) & (F.col(f"d_{text[0]}") > 1) & (F.col(f"d_{text[1]}") > 1), "matrix")
    if len(keys) >= 1 and numeric:
        shape = shape.when((F.col("rows") > 1) & (F.col(f"d_{keys[0]}") == F.col("rows")), "bar")
    return one.select(shape.otherwise("table").alias("shape"), "rows")
