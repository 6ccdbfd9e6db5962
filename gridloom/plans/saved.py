"""Saved questions with typed parameters, and saved views."""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Param:
    kind: str  # choice, number, text or date
    default: object = None
    options: tuple[str, ...] = ()
    required: bool = False


def bind(params: dict[str, Param], given: dict) -> dict:
    """Typed values for every parameter: defaults filled, optional ones NULL, unknown names and bad values refused."""
    unknown = set(given) - set(params)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}; known: {sorted(params)}")
    out = {}
    for name, p in params.items():
        v = given.get(name, p.default)
        if v is None or v == "":
            if p.required:
                raise ValueError(f"{name} is required")
            out[name] = None
        elif p.kind == "number":
            out[name] = float(v)
        elif p.kind == "date":
            out[name] = v if isinstance(v, dt.date) else dt.date.fromisoformat(str(v))
        elif p.kind == "choice":
            hit = [o for o in p.options if o.lower() == str(v).strip().lower()]
            if not hit:
                raise ValueError(f"{name}: {v!r} is not one of {list(p.options)}")
            out[name] = hit[0]
        else:
            out[name] = str(v)
    return out


def run_saved(spark: SparkSession, sql: str, params: dict[str, Param], given: dict, **tables: DataFrame) -> DataFrame:
    """The question with named parameters bound by Spark; `{name}` stands for a DataFrame."""
    args = bind(params, given)
    return spark.sql(sql, args=args, **tables)


def save_view(name: str, df: DataFrame, about: str) -> DataFrame:
    """Register a read-only query under a name; returns its row for the views table."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.range(1).select(F.lit(name).alias("name"), F.lit(about).alias("about"))
