"""Streams over two and more runs on one folder: what they keep, what they read again, and snapshot tables."""
import datetime as dt
import os

import pytest
from graphlib import CycleError
from pyspark.sql import functions as F

from gridloom.operators import vault as V
from gridloom.session import scratch
from gridloom.sources import files as S
from gridloom.streaming import jobs as ST
from gridloom.streaming.refresh import Folder, Result, dependents, in_order
from gridloom.streaming.snapshots import Snapshots

T0 = dt.datetime(2026, 1, 1)


class Source:
    """A folder of Parquet files that grows; every stream over it starts anew on the same checkpoint."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.path = spark, schema, scratch(spark, "source")

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def local(path):
    return path.removeprefix("file:")


def test_invalidation_goes_on_over_many_runs(spark):
    src, out = Source(spark, "id long"), scratch(spark, "invalid")
    derived = spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("label"))
    left = set(range(1000))
    for gone in ([1, 2], [2, 500], [], [999, 7777], [3]):
        src.add(*[(g,) for g in gone] or [(None,)])
        left -= set(gone)
        assert {r.id for r in ST.stream_invalidate(src.stream(), derived, out, rows_per_bucket=100).collect()} == left
    table = Snapshots(spark, f"{out}/table", ["id"])
    assert table.manifest()["buckets"] == 10 and len(table.generations()) == 2
    rewritten = ST.derive_again(spark, out, spark.createDataFrame([(1, "new"), (5, "v5b")], "id long, label string"))
    assert len(rewritten) <= 2
    got = {r.id: r.label for r in table.read().collect()}
    assert got[1] == "new" and got[5] == "v5b" and len(got) == len(left) + 1
    src.add((5,))
    assert {r.id for r in ST.stream_invalidate(src.stream(), derived, out, rows_per_bucket=100).collect()} == left - {5} | {1}


def test_snapshots_read_and_write_only_touched_buckets(spark):
    t = Snapshots(spark, scratch(spark, "snap"), ["k"], rows_per_bucket=50)
    df = spark.range(400).select(F.col("id").alias("k"), F.lit(0).alias("x"))
    assert t.create(df) and not t.create(df) and t.manifest()["buckets"] == 8
    before = t.manifest()
    key = spark.createDataFrame([(7,)], "k long")
    seen = []

    def up(old):
        seen.append(old.count())
        return old.withColumn("x", F.when(F.col("k") == 7, 1).otherwise(F.col("x")))
    changed = t.change(key, up, 0)
    after = t.manifest()
    assert len(changed) == 1 and seen[0] < 100
    assert {b for b in after["live"] if after["live"][b] != before["live"][b]} == {str(changed[0])}
    assert t.change(key, lambda old: old.limit(0), 0) == [] and t.read().count() == 400  # batch 0 is done
    assert t.read(0).filter("x = 1").count() == 0 and t.read().filter("x = 1").count() == 1
    t.change(key, lambda old: old.limit(0), 1)  # a bucket without rows
    assert str(changed[0]) not in t.manifest()["live"] and t.read().count() == 400 - after["live"][str(changed[0])]["rows"]
    gone = t.vacuum(1)
    assert t.generations() == [2] and any(f.startswith("data/1/") for f in gone) and t.read().count() > 300
    more = spark.range(400, 4000).select(F.col("id").alias("k"), F.lit(2).alias("x"))
    t.change(more, lambda old: old.unionByName(more), 2)  # outgrows its buckets
    assert t.manifest()["buckets"] > 8 and t.read().count() == 3600 + 400 - after["live"][str(changed[0])]["rows"]
    assert t.read_of(spark.createDataFrame([(401,)], "k long")).count() < 400


def test_snapshots_refuse_a_second_writer_and_foreign_keys(spark):
    t = Snapshots(spark, scratch(spark, "snap"), ["k"], rows_per_bucket=10)
    t.create(spark.range(40).withColumnRenamed("id", "k"))
    with pytest.raises(RuntimeError):
        t.commit({**t.manifest(), "generation": 0})
    with pytest.raises(ValueError):
        t.change(spark.createDataFrame([(1,)], "k long"), lambda old: spark.range(40).withColumnRenamed("id", "k"))
    assert t.generations() == [0] and t.read().count() == 40


def test_an_empty_first_table_takes_rows(spark):
    t = Snapshots(spark, scratch(spark, "snap"), ["k"])
    t.create(spark.createDataFrame([], "k string, n long"))
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n long")
    t.change(rows, lambda old: old.unionByName(rows))
    assert sorted(map(repr, map(tuple, t.read().collect()))) == ["('a', 2)", "(None, 1)"]


def hide(out, path=None):
    """Make earlier output unreadable: a stream that reads it again would fail."""
    for batch in os.listdir(local(out)):
        if batch.startswith("batch=") and batch != "batch=-1":
            for f in os.listdir(f"{local(out)}/{batch}"):
                if f.startswith("part-"):
                    with open(f"{local(out)}/{batch}/{f}", "wb") as h:
                        h.write(b"not a table")
                    crc = f"{local(out)}/{batch}/.{f}.crc"
                    if os.path.exists(crc):
                        os.remove(crc)


def test_do_once_reads_no_earlier_output(spark):
    src, out = Source(spark, "key string, t timestamp"), scratch(spark, "once")
    ran = spark.sparkContext.accumulator(0)

    def act(df):
        ran.add(df.count())
        return df.select("key", F.lit("done").alias("result"))
    for i in range(6):
        src.add((f"a{i}", T0), (f"a{i - 1}", T0 + dt.timedelta(days=400 * i)), ("a0", T0))
        if i < 5:
            ST.stream_once(src.stream(), out, act)
            hide(out)
    ST.stream_once(src.stream(), out, act)
    last = spark.read.parquet(f"{out}/batch=5")
    assert [r.key for r in last.collect()] == ["a5"] and ran.value == 7  # a-1, a0 ... a5


def test_new_parts_and_known_inputs_read_no_earlier_output(spark):
    src, out = Source(spark, "t timestamp, app string, parts array<string>"), scratch(spark, "parts")
    for i in range(3):
        src.add((T0, "x", [f"p{i}", "same"]), (T0, "y", ["same"]))
        got = ST.stream_new_parts(src.stream(), out)
        if i < 2:
            hide(out)
    assert [(r.app, r.part) for r in spark.read.parquet(f"{out}/batch=2").collect()] == [("x", "p2")]
    src, out = Source(spark, "id long, text string"), scratch(spark, "known")
    for i, version in enumerate((1, 1, 2)):
        src.add((i, "one"), (10 + i, f"t{i}"))
        got = ST.stream_skip_known(src.stream(), out, version, lambda b: b.withColumn("result", F.length("text").cast("string")))
    assert got.filter("version = 1").count() == 3 and got.filter("version = 2").count() == 2


def test_forgetting_keys_after_a_time(spark):
    src, out = Source(spark, "key string, t timestamp"), scratch(spark, "ttl")
    for day in (0, 0, 9, 20, 40, 60):
        src.add(("k", T0 + dt.timedelta(days=day)))
        got = ST.stream_once(src.stream(), out, lambda b: b.withColumn("result", F.lit("")), keep="5 days")
    assert 2 <= got.count() <= 3


def test_quota_over_runs_counts_from_its_own_table(spark):
    src, out = Source(spark, "t timestamp, key string, id long"), scratch(spark, "quota")
    for i in range(4):
        src.add(*[(T0 + dt.timedelta(days=i // 2, minutes=i * 10 + j), "k", i * 10 + j) for j in range(3)], (T0, "other", 100 + i))
        ST.stream_quota(src.stream(), out, 4, days=30)
        last = {r.id: r.accepted for r in spark.read.parquet(f"{out}/batch={i}").collect()}
        assert last == {100 + i: True, **{i * 10 + j: i % 2 == 0 or j == 0 for j in range(3)}}
        hide(out)
    counts = {(r.day.day, r.key): r.had for r in Snapshots(spark, f"{out}/_counts", ["day", "key"]).read().collect()}
    assert counts == {(1, "k"): 4, (2, "k"): 4, (1, "other"): 4}


def test_every_other_stream_goes_on(spark):
    src, out = Source(spark, "response string, seq long, delta string, done boolean"), scratch(spark, "restore")
    vault = spark.createDataFrame([("asha rao", "Asha Rao", "person_name", "NAME", 1, "NAME_001")], "norm string, value string, class string, prefix string, number int, code string")
    src.add(("r", 0, "Dear NAM", False))
    ST.stream_restore(src.stream(), vault, out)
    src.add(("r", 1, "E_001, hello", True))
    got = sorted((r.seq, r.restored) for r in ST.stream_restore(src.stream(), vault, out).collect())
    assert "".join(x for _, x in got) == "Dear Asha Rao, hello"
    src, out = Source(spark, "id long, text string"), scratch(spark, "redact")
    for i in range(2):
        src.add((i, f"mail a{i}@x.org and a0@x.org"))
        sent, refused, known = ST.stream_redact(src.stream(), out, V.empty_vault(spark))
    assert sent.count() == 2 and known.count() == 2 and refused.count() == 0
    src, out = Source(spark, "t timestamp, outcome string, substitutions long"), scratch(spark, "stats")
    for i in range(2):
        src.add((T0, "ok", 2 + i))
        got = ST.stream_stats(src.stream(), out)
    assert [tuple(r) for r in got.collect()] == [("ok", 2, 5)]


def csv(folder, name, *lines):
    os.makedirs(f"{folder}/{os.path.dirname(name)}", exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines) + "\n")


def test_a_changed_file_updates_exactly_its_dependents(spark, tmp_path):
    def tidy(spark, paths):
        read.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        g = S.read_grid(spark, paths).filter("row_no > 0")
        return g.select(F.col("file").alias("path"), F.col("cells")[0].alias("name"), F.col("cells")[1].cast("long").alias("n"))
    read, root = [], str(tmp_path / "in")
    csv(root, "sales/a.csv", "name,n", "x,1", "y,2")
    csv(root, "sales/b.csv", "name,n", "x,10")
    csv(root, "staff/c.csv", "name,n", "z,5")
    results = [Result("report", ("totals", "staff"), lambda i: i["totals"].agg(F.sum("n").alias("n")).crossJoin(i["staff"].agg(F.count("*").alias("staff")))),  # one row each
               Result("totals", ("sales",), lambda i: i["sales"].groupBy("name").agg(F.sum("n").alias("n"))),
               Result("people", ("staff",), lambda i: i["staff"].select("name")),
               Result("planned", ("budget",), lambda i: i["budget"].select("name"))]
    f = Folder(spark, root, str(tmp_path / "out"), tidy, "path string, name string, n long", lambda p: F.regexp_extract(p, r"/(\w+)/[^/]+$", 1), results)
    first = f.refresh()
    assert len(first["files"]) == 3 and sorted(first["results"]) == ["people", "planned", "report", "totals"]
    assert first["results"].index("totals") < first["results"].index("report")
    assert {r.name: r.n for r in f.result("totals").collect()} == {"x": 11, "y": 2} and f.result("planned").count() == 0
    assert f.refresh() == {"files": [], "results": []}
    csv(root, "sales/b.csv", "name,n", "x,100", "w,7")
    second = f.refresh()
    assert read[-1] == ["b.csv"] and second["results"] == ["totals", "report"] and len(second["files"]) == 1
    assert tuple(f.result("report").first()) == (110, 1)
    os.remove(f"{root}/staff/c.csv")
    csv(root, "budget/d.csv", "name,n", "rent,1")
    third = f.refresh()
    assert read[-1] == ["d.csv"] and sorted(third["results"]) == ["people", "planned", "report"]
    assert f.result("people").count() == 0 and [r.name for r in f.result("planned").collect()] == ["rent"]
    again = Folder(spark, root, str(tmp_path / "out"), tidy, f.schema, f.table_of, results)
    assert again.refresh() == {"files": [], "results": []} and tuple(again.result("report").first()) == (110, 0)


def test_order_of_results():
    make = lambda i: None
    r = [Result("c", ("b", "x"), make), Result("b", ("a",), make), Result("a", ("t",), make), Result("d", ("x",), make)]
    assert [n for n in (x.name for x in in_order(r)) if n in "abc"] == ["a", "b", "c"]
    assert dependents(r, {"t"}) == [n for n in (x.name for x in in_order(r)) if n in "abc"] and dependents(r, {"x"}) in (["d", "c"], ["c", "d"])
    with pytest.raises(CycleError):
        in_order([Result("a", ("b",), make), Result("b", ("a",), make)])
    with pytest.raises(ValueError):
        in_order([Result("a", (), make), Result("a", (), make)])


def test_a_full_folder_is_read_in_few_batches(spark, tmp_path):
    for i in range(230):
        (tmp_path / f"{i}.csv").write_text("a,b\n" * (i % 3 + 1))
    sizes = []

    def tidy(session, paths):
        sizes.append(len(paths))
        return S.read_grid(session, paths).select("row_no")
    out = ST.stream_folder(spark, str(tmp_path), scratch(spark, "folder"), tidy, "row_no bigint")
    assert sizes == [230] and out.count() == sum(i % 3 + 1 for i in range(230))


def test_sent_texts_are_looked_through_once(spark, monkeypatch):
    seen, leaks = spark.sparkContext.accumulator(0), V.leaks

    @F.udf("long")
    def planted(n):
        seen.add(1)
        return n

    def some(docs, key, *rest):
        assert leaks(docs, key, *rest).count() == 0
        return docs.filter(F.col(key) % 2 == 0).select(key, F.lit("X_001").alias("code"), planted.asNondeterministic()(F.lit(1)).alias("n"))
    monkeypatch.setattr(V, "leaks", some)
    src = Source(spark, "id long, text string")
    src.add((1, "mail a@x.org"), (2, "a@x.org"), (7, "b@x.org"))
    src.add((3, "plain"), (4, None), (5, "A@x.org"))
    sent, refused, _ = ST.stream_redact(src.stream(), scratch(spark, "looked"), V.empty_vault(spark))
    assert sorted((r.id, r.redacted) for r in sent.collect()) == [(1, "mail EMAIL_001"), (3, "plain"), (5, "EMAIL_001"), (7, "EMAIL_002")]
    assert sorted(r.id for r in refused.collect()) == [2, 4] and seen.value == 2
