"""Streaming forms of the operators: file arrival, live tallies, codes split across deltas, redaction in flight, do-once
actions, new-part logs, quotas, counters, skip-unchanged and invalidation."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridloom.functions.text import norm
from gridloom.operators import vault as V
from gridloom.operators.aggregate import chosen_votes
from gridloom.operators.detect import detect, exploded
from gridloom.operators.scale import numbered
from gridloom.session import cut, dealt
from gridloom.streaming.sinks import committed, newest, open_sink, run_available, write_batch
from gridloom.streaming.snapshots import ROWS_PER_BUCKET, Snapshots


# ------------------------------------------------------------------ ST1
def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of (path, modified, size) for files that arrive below a folder; contents are not read."""
    return (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
            .select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")))


def stream_folder(spark: SparkSession, folder: str, out: str, tidy: Callable[[SparkSession, list[str]], DataFrame], schema: str, per_trigger: int = 10_000) -> DataFrame:
    """Tidy files as they arrive: each batch reads its own files (at most `per_trigger` paths) and writes its table. A batch of
    small files costs a second or ten whatever it holds, so a folder that is full already is read in few of them."""
    open_sink(spark, out, schema)

    def each(batch: DataFrame, n: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # bounded by maxFilesPerTrigger
        if paths:
            write_batch(tidy(batch.sparkSession, paths), out, n)
    run_available(arriving_files(spark, folder, per_trigger), each, out)
    return committed(spark, out).drop("batch")


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differ, and files that are gone: (path, change)."""
    old = before.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"))
    j = now.join(old, "path", "full")
    change = (F.when(F.col("_s").isNull(), "new").when(F.col("size").isNull(), "gone")
              .when(~F.col("modified").eqNullSafe(F.col("_m")) | (F.col("size") != F.col("_s")), "changed"))
    return j.select("path", change.alias("change")).filter("change is not null")


# ------------------------------------------------------------------ ST2
def tally_stream(votes: DataFrame, at: str = "t", late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Votes and average seconds per window and outcome."""
    return (votes.withWatermark(at, late).groupBy(F.window(at, width), "outcome")
            .agg(F.count("*").alias("n"), F.avg("seconds").alias("avg_seconds")).select(F.col("window.start").alias("start"), "outcome", "n", "avg_seconds"))


def stream_tally(votes: DataFrame, out: str, late: str = "10 minutes", width: str = "1 minute", org: str | None = None, choice: str | None = None) -> DataFrame:
    """Live tally of all votes, or of those of one organisation and outcome."""
    open_sink(votes.sparkSession, out, "start timestamp, outcome string, n bigint, avg_seconds double")
    run_available(tally_stream(chosen_votes(votes, org, choice), late=late, width=width), lambda b, n: write_batch(b, out, n), out, "update")
    return newest(committed(votes.sparkSession, out), ["start", "outcome"])


def stream_candidates(votes: DataFrame, out: str, late: str = "10 minutes", width: str = "1 minute", org: str | None = None, choice: str | None = None) -> DataFrame:
    """Live latency and tokens per window and candidate, from votes with a nested candidate array."""
    open_sink(votes.sparkSession, out, "start timestamp, alias string, shown bigint, avg_seconds double, avg_tokens double")
    each = chosen_votes(votes, org, choice).withWatermark("t", late).select("t", F.explode("cands").alias("c")).filter("c.seconds is not null")
    agg = each.groupBy(F.window("t", width), F.col("c.alias").alias("alias")).agg(F.count("*").alias("shown"), F.avg("c.seconds").alias("avg_seconds"), F.avg("c.tokens_out").alias("avg_tokens"))
    run_available(agg.select(F.col("window.start").alias("start"), "alias", "shown", "avg_seconds", "avg_tokens"), lambda b, n: write_batch(b, out, n), out, "update")
    return newest(committed(votes.sparkSession, out), ["start", "alias"])


# ------------------------------------------------------------------ ST3
# The longest piece held back, and how an unfinished code at the end of a piece looks.
HELD = 32
BUCKETS = 4096  # groups that responses share
_OPEN_TAIL = re.compile(r"(?:(?<!\w)|(?<=\\[ntr]))[A-Z][A-Z_]{0,24}(?:\\?_?\d*)?\\?$")


def safe_cut(text: str, most: int = HELD) -> int:
    """Where a text may be cut: before a closing piece that may grow into a code, at most `most` characters from its end."""
    m = _OPEN_TAIL.search(text, max(0, len(text) - most - 2))
    return m.start() if m and len(text) - m.start() <= most else len(text)


def _hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Deltas of a bucket of responses, each in order; a piece that may be part of a code waits for the next delta."""
    held = dict(zip(*state.get)) if state.exists else {}
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    out = []
    for response, seq, delta, done in zip(rows["response"], rows["seq"], rows["delta"], rows["done"]):
        text = held.pop(response, "") + (delta or "")
        at = len(text) if done else safe_cut(text)
        out.append((response, int(seq), text[:at]))
        if at < len(text):
            held[response] = text[at:]
    if held:
        state.update((list(held), list(held.values())))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["response", "seq", "piece"])


def whole_pieces(deltas: DataFrame) -> DataFrame:
    """Deltas (response, seq, delta, done) re-cut so that no code is split between two pieces. Responses share BUCKETS groups
    by hash, so a batch costs one Python call per bucket, not per response; a bucket's state is the held pieces of its open
    responses alone."""
    placed = deltas.select(F.pmod(F.xxhash64("response"), F.lit(BUCKETS)).alias("_bucket"), "response", "seq", "delta", "done")
    return placed.groupBy("_bucket").applyInPandasWithState(
        _hold, "response string, seq long, piece string", "responses array<string>, tails array<string>", "append", GroupStateTimeout.NoTimeout)


def stream_restore(deltas: DataFrame, vault: DataFrame, out: str) -> DataFrame:
    """Codes in streamed replies restored, also when a code is split across deltas."""
    spark = deltas.sparkSession
    open_sink(spark, out, "response string, seq bigint, restored string")

    def each(batch: DataFrame, n: int) -> None:
        b = cut(batch.withColumn("_k", F.concat_ws("/", "response", "seq")))  # read twice, but its state is taken once
        write_batch(V.restore(b, "_k", "piece", vault).select("response", "seq", "restored"), out, n)
    run_available(whole_pieces(deltas), each, out)
    return committed(spark, out).drop("batch")


# ------------------------------------------------------------------ ST4
def stream_redact(messages: DataFrame, out: str, start: DataFrame, kind: str = "regex+digits") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages (id, text) coded in flight: values found in a batch join the vault in the same batch, and a message in which
    a known value is left goes to the dead-letter table instead. A batch is dealt to all cores first: its files may be few and
    not splittable, and every later step reads the texts as they lie. Returns (sent, refused, vault)."""
    spark = messages.sparkSession
    vault_path, sent, dead = f"{out}/vault", f"{out}/sent", f"{out}/refused"
    write_batch(start.select("norm", "value", "class", "prefix", "number", "code"), vault_path, -1)
    open_sink(spark, sent, "id bigint, redacted string")
    open_sink(spark, dead, "id bigint, codes bigint")

    def each(batch: DataFrame, n: int) -> None:
        b = cut(dealt(batch.select("id", "text")))
        old = cut(committed(spark, vault_path, before=n).drop("batch"))
        found = cut(exploded(detect(b, "text", kind, clean=True), ["id"], "text"))
        new = cut(V.build_vault(found.select("value", F.col("label").alias("class"), F.struct(F.col("id").alias("k"), "start").alias("pos")), old))
        write_batch(new, vault_path, n)
        now = old.unionByName(new)
        exact = found.withColumn("norm", norm(F.col("value"))).join(now.select("norm", "code"), "norm").select("id", "start", "end", "code")
        done = cut(V.redact(b, "id", "text", now, exact=exact))
        left = V.leaks(done, "id", "redacted", now).groupBy("id").agg(F.sum("n").alias("codes"))
        write_batch(left, dead, n)
        refused = spark.read.schema(left.schema).parquet(f"{dead}/batch={n}")  # the texts are looked through once
        write_batch(done.join(refused, "id", "left_anti").select("id", "redacted"), sent, n)
    run_available(messages, each, out)
    return tuple(committed(spark, p).drop("batch") for p in (sent, dead, vault_path))


# ------------------------------------------------------------------ ST5
def first_of(rows: DataFrame, keys: list[str], at: str | None = None, keep: str | None = None) -> DataFrame:
    """Rows whose key was not seen before. Keys are held in the state store, so a batch looks its own keys up and reads no
    earlier output. With `keep`, a key is forgotten that long after its time in column `at`."""
    return rows.dropDuplicates(keys) if keep is None else rows.withWatermark(at, keep).dropDuplicatesWithinWatermark(keys)


def stream_once(actions: DataFrame, out: str, run: Callable[[DataFrame], DataFrame], keep: str | None = None) -> DataFrame:
    """Each action key runs once: the state store knows the keys, and a key counts as done only when the batch that ran it is
    committed, after its output is written. Keys are kept for ever, or for `keep` after their time t."""
    spark = actions.sparkSession
    open_sink(spark, out, "key string, result string")
    run_available(first_of(actions, ["key"], "t", keep), lambda batch, n: write_batch(run(batch).select("key", "result"), out, n), out)
    return committed(spark, out).drop("batch")


# ------------------------------------------------------------------ ST6
def stream_new_parts(requests: DataFrame, out: str, keep: str | None = None) -> DataFrame:
    """Message parts (t, app, parts) that were not logged before for that app, by digest."""
    spark = requests.sparkSession
    open_sink(spark, out, "t timestamp, app string, digest string, part string")
    parts = requests.select("t", "app", F.explode("parts").alias("part")).withColumn("digest", F.sha2("part", 256))
    run_available(first_of(parts, ["app", "digest"], "t", keep), lambda batch, n: write_batch(batch.select("t", "app", "digest", "part"), out, n), out)
    return committed(spark, out).drop("batch")


# ------------------------------------------------------------------ ST7
def quota_counts(calls: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """Calls per key and day with an over-limit mark (approximate enforcement: counts, not single calls)."""
    g = calls.withWatermark("t", late).groupBy(F.window("t", "1 day"), "key").agg(F.count("*").alias("n"))
    return g.select(F.to_date("window.start").alias("day"), "key", "n", (F.col("n") > limit).alias("over_limit"))


def stream_quota(calls: DataFrame, out: str, limit: int, days: int | None = None) -> DataFrame:
    """Exact daily limit: calls (t, key, id) in time order are accepted until the limit of their day; the rest are refused.
    A batch numbers its calls with a distributed sort and adds what earlier batches accepted: a snapshot table of one count
    per key and day, of which it reads the buckets of its own keys. Counts older than `days` before the newest day of a
    rewritten bucket are dropped there, when given."""
    spark = calls.sparkSession
    open_sink(spark, out, "day date, key string, id bigint, accepted boolean")
    counts = Snapshots(spark, f"{out}/_counts", ["day", "key"])
    counts.create(spark.createDataFrame([], "day date, key string, had bigint"))

    def each(batch: DataFrame, n: int) -> None:
        now = cut(batch.withColumn("day", F.to_date("t")).select("day", "key", "t", "id"))
        own = now.select("day", "key").distinct()
        at = [g for g in counts.generations() if (counts.manifest(g)["batch"]) < n][-1]  # a retried batch sees what its first try saw
        had = counts.read_of(own, at).join(own, ["day", "key"], "left_semi")
        got = numbered(now, ["day", "key"], [F.col("t"), F.col("id")], "_rn").join(had, ["day", "key"], "left")
        done = got.select("day", "key", "id", (F.col("_rn") + F.coalesce("had", F.lit(0)) <= limit).alias("accepted"))
        write_batch(done, out, n)
        more = spark.read.parquet(f"{out}/batch={n}").filter("accepted").groupBy("day", "key").agg(F.count("*").alias("had"))

        def summed(old: DataFrame) -> DataFrame:
            both = old.unionByName(more).groupBy("day", "key").agg(F.sum("had").alias("had"))
            return both if days is None else both.filter(F.col("day") >= F.date_sub(F.lit(now.agg(F.max("day")).first()[0]), days))
        counts.change(own, summed, n)
        counts.vacuum()
    run_available(calls, each, out)
    return committed(spark, out).drop("batch")


# ------------------------------------------------------------------ ST8
def stream_stats(log: DataFrame, out: str) -> DataFrame:
    """Running counters of a request log (t, outcome, substitutions): requests, and substitutions, per outcome."""
    spark = log.sparkSession
    open_sink(spark, out, "outcome string, requests bigint, substitutions bigint")
    agg = log.groupBy("outcome").agg(F.count("*").alias("requests"), F.sum("substitutions").alias("substitutions"))
    run_available(agg, lambda b, n: write_batch(b, out, n), out, "update")
    return newest(committed(spark, out), ["outcome"])


def last_requests(log: DataFrame, at: str, tie: str, k: int = 40) -> DataFrame:
    return log.orderBy(F.desc(at), F.desc(tie)).limit(k)


# ------------------------------------------------------------------ ST9
def stream_skip_known(inputs: DataFrame, out: str, version: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Inputs (id, text) whose content was already processed under this vault version are not processed again."""
    spark = inputs.sparkSession
    open_sink(spark, out, "hash string, version int, result string")
    fresh = first_of(inputs.withColumn("hash", F.sha2("text", 256)).withColumn("version", F.lit(version)), ["hash", "version"])
    run_available(fresh, lambda batch, n: write_batch(work(batch).select("hash", "version", "result"), out, n), out)
    return committed(spark, out).drop("batch")


# ------------------------------------------------------------------ ST10
def stream_invalidate(changes: DataFrame, derived: DataFrame, out: str, rows_per_bucket: int = ROWS_PER_BUCKET, keep: int = 2) -> DataFrame:
    """Changed files (id) lose their derived rows (id, ...). Derived rows are a snapshot table keyed by id: `derived` fills it
    when it is not there yet, a batch rewrites only the buckets that hold a changed id, and folders that the newest `keep`
    generations do not name are removed."""
    table = Snapshots(changes.sparkSession, f"{out}/table", ["id"], rows_per_bucket)
    table.create(derived)

    def each(batch: DataFrame, n: int) -> None:
        gone = cut(batch.select("id").filter("id is not null").distinct())
        table.change(gone, lambda rows: rows.join(gone, "id", "left_anti"), n)
        table.vacuum(keep)
    run_available(changes, each, out)
    return table.read()


def derive_again(spark: SparkSession, out: str, rows: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[int]:
    """Freshly derived rows take the place of those of the same ids, between runs of the stream. Returns the buckets."""
    rows = cut(rows)
    return Snapshots(spark, f"{out}/table", ["id"], rows_per_bucket).change(rows, lambda old: old.join(rows.select("id").distinct(), "id", "left_anti").unionByName(rows))
