"""Folders whose files appear, change and go: changed files are tidied again and exactly the results that depend on them are
made anew, in the order of their dependencies.

State lies beside the results: one row per file with the generation of its last change, the tidy rows as a snapshot table
keyed by file, and a manifest that names every result's folder and the versions of the inputs it was made from. A result is
stale when one of its inputs has another version than the one it was made from, so a run that was broken off is caught up by
the next one. The driver sees one row per changed file (Spark lists those files anyway), per table and per result.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.session import cut
from gridloom.streaming.jobs import changed_files
from gridloom.streaming.snapshots import Manifests, Snapshots

FILES = "path string, modified timestamp, size bigint, table string, generation bigint"


@dataclass(frozen=True)
class Result:
    """A derived table: made from tables of the folder and from other results, by name."""
    name: str
    inputs: tuple[str, ...]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]


def in_order(results: Sequence[Result]) -> list[Result]:
    """Results after all that they are made from; refuses two of one name and circles."""
    by_name = {r.name: r for r in results}
    if len(by_name) < len(results):
        raise ValueError("two results of one name")
    order = TopologicalSorter({r.name: [i for i in r.inputs if i in by_name] for r in results}).static_order()  # raises CycleError
    return [by_name[n] for n in order]


def dependents(results: Sequence[Result], changed: set[str]) -> list[str]:
    """Names of the results that a change of these tables or results reaches, in order."""
    reached = set(changed)
    for r in in_order(results):
        if reached & set(r.inputs):
            reached.add(r.name)
    return [r.name for r in in_order(results) if r.name in reached - changed]


def file_key(path: Column) -> Column:
    """One spelling of a path (readers differ in the slashes after the scheme)."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


class Folder:
    """The tables and results of one folder. `tidy(spark, paths)` reads files into rows of `schema`, which has a `path`;
    `table_of` names the table of a file from its path."""

    def __init__(self, spark: SparkSession, folder: str, out: str, tidy: Callable[[SparkSession, list[str]], DataFrame], schema: str,
                 table_of: Callable[[Column], Column], results: Sequence[Result] = ()):
        self.spark, self.folder, self.tidy, self.schema, self.table_of = spark, folder, tidy, schema, table_of
        self.results, self.out = in_order(results), out.rstrip("/")
        self.files, self.rows = Snapshots(spark, f"{out}/files", ["path"]), Snapshots(spark, f"{out}/rows", ["path"])
        self.made = Manifests(spark, f"{out}/results")

    def listing(self) -> DataFrame:
        """Path, time and size of every file that is there; contents are not read."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        return found.select(file_key(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))

    def table(self, name: str) -> DataFrame:
        """The tidy rows of the files of one table."""
        held = self.files.read().filter((F.col("table") == name) & F.col("size").isNotNull()).select("path")
        return self.rows.read().join(held, "path", "left_semi")

    def result(self, name: str) -> DataFrame:
        made = self.made.manifest()["results"][name]
        return self.spark.read.parquet(f"{self.out}/{made['folder']}")

    def refresh(self, at_once: int = 1000) -> dict[str, list[str]]:
        """Bring rows and results up to date: {"files": changed paths, "results": names made anew, in order}. At most `at_once`
        files are tidied in one step, and each step is committed."""
        self.files.create(self.spark.createDataFrame([], FILES))
        self.rows.create(self.spark.createDataFrame([], self.schema))
        now = cut(self.listing())
        changes = changed_files(now, self.files.read().filter("size is not null"))
        todo = [(r["path"], r["change"]) for r in changes.orderBy("path").collect()]  # files that changed since the last run
        for at in range(0, len(todo), at_once):
            self._step(now, todo[at:at + at_once])
        return {"files": [p for p, _ in todo], "results": self._make()}

    def _step(self, now: DataFrame, some: list[tuple[str, str]]) -> None:
        paths = cut(self.spark.createDataFrame([(p,) for p, _ in some], "path string"))
        there = [p for p, change in some if change != "gone"]
        new = cut(self.tidy(self.spark, there).withColumn("path", file_key(F.col("path")))) if there else self.spark.createDataFrame([], self.schema)
        self.rows.change(paths, lambda old: old.join(paths, "path", "left_anti").unionByName(new))
        generation = self.rows.generations()[-1]
        marked = paths.join(now, "path", "left").select("path", "modified", "size", self.table_of(F.col("path")).alias("table"), F.lit(generation).cast("long").alias("generation"))
        self.files.change(paths, lambda old: old.join(paths, "path", "left_anti").unionByName(marked))  # a file that is gone keeps a row without a size
        self.rows.vacuum()
        self.files.vacuum()

    def _make(self) -> list[str]:
        state = self.made.manifest() or {"generation": -1, "results": {}}
        version = {r["table"]: r["v"] for r in self.files.read().groupBy("table").agg(F.max("generation").alias("v")).collect()}  # one row per table
        done = []
        for result in self.results:
            known = {r.name for r in self.results}
            wanted = {i: state["results"][i]["version"] if i in known else version.get(i, -1) for i in result.inputs}
            had = state["results"].get(result.name)
            if had is None or had["inputs"] != wanted:
                inputs = {i: self.result(i) if i in known else self.table(i) for i in result.inputs}
                folder = f"results/data/{result.name}-{uuid.uuid4().hex}"
                result.make(inputs).write.parquet(f"{self.out}/{folder}")
                entry = {"folder": folder, "inputs": wanted, "version": state["generation"] + 1}
                state = {"generation": state["generation"] + 1, "results": {**state["results"], result.name: entry}}
                self.made.commit(state)
                done.append(result.name)
        return done

    def watch(self, every: str = "2 seconds") -> StreamingQuery:
        """Refresh again and again, until the returned query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.trigger(processingTime=every).foreachBatch(lambda _, n: self.refresh() and None).start()
