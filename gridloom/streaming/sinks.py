"""Idempotent batch sinks for foreachBatch: one folder per batch id, so a retried batch replaces its own output."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

START = -1
_STATE = "org.apache.spark.sql.execution.streaming.state"
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": f"{_STATE}.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
_PLAIN = {"spark.sql.streaming.stateStore.providerClass": f"{_STATE}.HDFSBackedStateStoreProvider"}  # Spark's default


def open_sink(spark: SparkSession, path: str, schema: str) -> None:
    """Create the table empty, so that the first batch can read it."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/batch={START}")


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def committed(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows of finished batches; inside batch n only those before n count, so a retry sees what the first try saw."""
    df = spark.read.parquet(path)
    return df if before is None else df.filter(F.col("batch") < before)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], out: str, mode: str = "append") -> None:
    """Run a stream over everything that is there now, batch by batch, and wait for its end. Progress and state are kept
    beside the sink, so a later run goes on with the next batch number and sees only what is new. State lies in RocksDB, on
    disk and uploaded by its changes, unless the session names another store."""
    for name, value in STATE_STORE.items():
        if stream.sparkSession.conf.get(name, None) in (None, _PLAIN.get(name)):
            stream.sparkSession.conf.set(name, value)
    q: StreamingQuery = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
                         .trigger(availableNow=True).foreachBatch(each).start())
    q.awaitTermination()


def newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Latest update per key of an update-mode sink."""
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
