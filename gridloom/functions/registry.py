"""User extension points: transform blocks and detector choice."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridloom.operators.detect import detector

_BLOCKS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}
DETECTORS = ("regex", "regex+digits", "text")


def transform_block(name: str, schema: str):
    """Register a function pandas.DataFrame -> pandas.DataFrame with its output schema."""
    def add(fn: Callable[[pd.DataFrame], pd.DataFrame]):
        _BLOCKS[name] = (fn, schema)
        return fn
    return add


def run_block(df: DataFrame, name: str) -> DataFrame:
    """Run a block over Arrow batches. The block sees some rows at a time, never the whole table."""
    fn, schema = _BLOCKS[name]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def run_block_memo(df: DataFrame, name: str, memo: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a block on rows whose content hash is not in memo(hash, ...) yet; returns (all results, new memo rows). The
    block's schema must carry `hash` through."""
    hashed = df.withColumn("hash", F.sha2(F.to_json(F.struct(*df.columns)), 256)).dropDuplicates(["hash"])
    todo = hashed if memo is None else hashed.join(memo.select("hash"), "hash", "left_anti")
    new = run_block(todo, name)
    return (new if memo is None else memo.join(hashed.select("hash"), "hash", "left_semi").unionByName(new)), new


def try_block(name: str, sample: DataFrame) -> list[str]:
    """Columns of a block's output on a small made-up sample, as the test before real data."""
    return run_block(sample, name).limit(20).columns


def detector_by_name(name: str, **options):
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}; known: {DETECTORS}")
    return detector(name, **options)
