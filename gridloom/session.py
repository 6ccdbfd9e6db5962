"""Session settings, the table loader and the shared scratch folder."""
from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", name: str = "gridloom", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter supplies master and partition counts."""
    b = (SparkSession.builder.master(master).appName(name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory).config("spark.ui.enabled", "false"))
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (UTC, AQE, skew joins), keep Arrow batches small and ship the package
    to the Python workers. Other sizing is left to the session."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    small_batches(spark)
    ship(spark)
    return spark


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts of 8 MB in place of Spark's 64 MB: a Python worker holds a batch several times over, as
    strings, code points and results, beside the executor's heap. A size that the session sets itself is left as it is."""
    if spark.conf.get(BATCH_BYTES, None) in (None, "64m", "67108864b", "67108864"):
        spark.conf.set(BATCH_BYTES, "8m")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that UDFs import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gridloom-code-"), "gridloom")  # on the driver; Spark copies it from there
    sc.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`. A local temporary folder is used only by a local session
    that names none; a cluster session without the setting is refused."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not shared:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(shared)
    return shared or sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder for a table written by one job."""
    return f"{checkpoint_root(spark).rstrip('/')}/gridloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row text work on a scanned input with fewer splits that hold rows than cores: Spark cuts
    files by bytes, but a row group is read by one task, so a file of one group is one task's work however many splits it
    has. One count of the rows of each split decides; an input dealt well enough is left as it is, so it is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    held = df.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()  # one row
    return dealt(df) if held["n"] and held["most"] * cores > 2 * held["n"] else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores, for costly work on an input whose splits may be empty but one, as those of a file
    with a single row group are."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


class Tables:
    """`t.orders` reads one table lazily, so a query only touches the files it names."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.dir, name)
        raise AttributeError(name)
