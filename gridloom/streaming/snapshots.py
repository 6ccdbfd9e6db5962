"""A table that changes batch by batch without rewriting itself: buckets of rows, and manifests that name the live ones.

Rows lie in hash buckets of their key columns, one folder per generation and bucket. A generation's manifest (JSON) names the
live folder of every bucket; it becomes the current one by a single rename, so readers see the table before or after a
change and never between. A change reads and writes only the buckets that hold its keys. When buckets grow beyond four times
`rows_per_bucket` on average, the next change deals the table anew into more buckets. `vacuum` removes folders that no kept
manifest names. Manifests hold one entry per bucket, so the driver's part follows the number of buckets, not of rows.

A batch is named by its number. Running a finished batch again changes nothing, and a batch that failed before its rename
left only folders that nothing names.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1 << 20


class Manifests:
    """Numbered JSON files below `path`, each committed whole by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._at("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        """Numbers of the committed generations, oldest first."""
        fs, folder = self._fs, self._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, generation: int | None = None) -> dict | None:
        every = self.generations()
        if not every:
            return None
        stream = self._fs.open(self._at(f"manifests/{every[-1] if generation is None else generation}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """`manifest["generation"]` becomes the newest one; refused when another writer was first."""
        fs, name = self._fs, self._at(f"manifests/{manifest['generation']}.json")
        part = self._at(f"manifests/{manifest['generation']}.json.{uuid.uuid4().hex}")
        fs.mkdirs(self._at("manifests"))
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(name) or not fs.rename(part, name):
            fs.delete(part, False)
            raise RuntimeError(f"another writer committed {name}")


class Snapshots(Manifests):
    """The table below `path`, keyed by `keys`."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET):
        super().__init__(spark, path)
        self.keys, self.rows_per_bucket = list(keys), rows_per_bucket

    # -------------------------------------------------- reading
    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _schema(self, manifest: dict) -> T.StructType:
        return T.StructType.fromJson(manifest["schema"])

    def _folders(self, manifest: dict, folders: list[str]) -> DataFrame:
        schema = self._schema(manifest)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, generation: int | None = None) -> DataFrame:
        """All rows of a generation (the newest by default)."""
        manifest = self.manifest(generation)
        if manifest is None:
            raise ValueError(f"no table at {self.path}")
        return self._folders(manifest, [x["folder"] for x in manifest["live"].values()])

    def read_of(self, keys: DataFrame, generation: int | None = None) -> DataFrame:
        """The rows of the buckets that hold a key of `keys`."""
        manifest = self.manifest(generation)
        held = {str(r["_b"]) for r in keys.select(self.bucket(manifest["buckets"]).alias("_b")).distinct().collect()}  # at most one per bucket
        return self._folders(manifest, [x["folder"] for b, x in manifest["live"].items() if b in held])

    # -------------------------------------------------- changing
    def _write(self, df: DataFrame, generation: int | str, buckets: int) -> dict[str, dict]:
        """Write rows by bucket; the folder and number of rows of every bucket that has any."""
        folder = f"data/{generation}"
        df.withColumn("_bucket", self.bucket(buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, root = self._fs, self._at(folder)
        found = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("_bucket=")]
        if not found:
            return {}
        rows = self.spark.read.schema("_bucket int").parquet(f"{self.path}/{folder}").groupBy("_bucket").count().collect()  # one row per bucket
        return {str(r["_bucket"]): {"folder": f"{folder}/_bucket={r['_bucket']}", "rows": r["count"]} for r in rows}

    def create(self, df: DataFrame, batch: int = -1) -> bool:
        """Write the first generation, unless the table is there."""
        if self.generations():
            return False
        buckets = max(1, -(-df.count() // self.rows_per_bucket))
        live = self._write(df, 0, buckets)
        self.commit({"generation": 0, "batch": batch, "buckets": buckets, "schema": json.loads(df.schema.json()), "live": live})
        return True

    def change(self, touched: DataFrame, new_rows: Callable[[DataFrame], DataFrame], batch: int | None = None) -> list[int]:
        """Replace the rows of the buckets that hold a key of `touched` (its key columns): `new_rows` gets those rows and
        returns what takes their place. Returns the buckets that were rewritten; none when the batch was committed before.
        Without a batch number the change is one of its own."""
        now = self.manifest()
        if now is None:
            raise ValueError(f"no table at {self.path}")
        if batch is not None and batch <= now["batch"]:
            return []
        buckets, generation = now["buckets"], now["generation"] + 1
        some = sorted(r["_b"] for r in touched.select(self.bucket(buckets).alias("_b")).distinct().collect())  # at most one per bucket
        held = {str(b) for b in some}
        rows = self._folders(now, [x["folder"] for b, x in now["live"].items() if b in held])
        live = {b: x for b, x in now["live"].items() if b not in held}
        changed = self._write(new_rows(rows), generation, buckets) if some else {}
        if changed.keys() - held:
            raise ValueError("the new rows hold keys that were not announced as touched")
        live.update(changed)
        total = sum(x["rows"] for x in live.values())
        if total > 4 * buckets * self.rows_per_bucket:  # dealt anew, into a folder of its own
            buckets = -(-total // self.rows_per_bucket)
            live = self._write(self._folders(now, [x["folder"] for x in live.values()]), f"{generation}-dealt", buckets)
        self.commit({**now, "generation": generation, "batch": now["batch"] if batch is None else batch, "buckets": buckets, "live": live})
        return some

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the newest `keep`, and the folders that none of those names. Returns the folders."""
        every, fs = self.generations(), self._fs
        kept, gone = every[-keep:], []
        named = {x["folder"] for g in kept for x in self.manifest(g)["live"].values()}
        for g in every[:-keep]:
            fs.delete(self._at(f"manifests/{g}.json"), False)
        for generation in fs.listStatus(self._at("data")):
            name = generation.getPath().getName()
            if int(name.split("-")[0]) > every[-1]:
                continue  # a batch at work
            inside = [f"data/{name}/{s.getPath().getName()}" for s in fs.listStatus(generation.getPath()) if s.isDirectory()]
            dead = [f for f in inside if f not in named]
            for f in dead:
                fs.delete(self._at(f), True)
            if len(dead) == len(inside):
                fs.delete(generation.getPath(), True)
            gone += dead
        return gone
