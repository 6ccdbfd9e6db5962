"""Streaming jobs over the tables, run to the end of what is there."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import vault as V
from gridloom.queries.registry import query
from gridloom.queries.tidying import _written_csv
from gridloom.session import cut, scratch
from gridloom.sources import files as S
from gridloom.streaming import jobs as ST


def _stream(df, order, files=4, per_trigger=1):
    """The rows as a stream of several files, a few per batch."""
    path = scratch(df.sparkSession, "stream-in")
    df.repartitionByRange(files, order).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


@query("st1_stream_folder", """select (o_orderkey // 500)::varchar file, count(*) + 4 * count(distinct o_orderkey // 50) as "rows" from orders group by 1""")
def _(t):
    def tidy(spark, paths):
        g = S.read_grid(spark, paths)
        return g.select(F.regexp_extract("file", r"file=(\d+)", 1).alias("file"), "row_no")
    out = ST.stream_folder(t.spark, _written_csv(t), scratch(t.spark, "st1"), tidy, "file string, row_no bigint")
    return out.groupBy("file").agg(F.count("*").alias("rows"))


@query("src11_folder_changes", """select 'new' as change, count(*) filter (where c_custkey % 3 = 0) n from customer union all select 'gone', count(*) filter (where c_custkey % 3 = 1) from customer union all select 'changed', count(*) filter (where c_custkey % 3 = 2 and c_custkey % 2 = 0) from customer""")
def _(t):
    k = F.col("c_custkey")
    base = t.customer.select(F.concat(F.lit("/f/"), k.cast("string")).alias("path"), F.lit(1).alias("modified"), F.lit(10).alias("size"), k.alias("k"))
    now = base.filter("k % 3 <> 1").withColumn("size", F.when(F.col("k") % 2 == 0, 11).otherwise(10))
    return ST.changed_files(now, base.filter("k % 3 <> 0")).groupBy("change").agg(F.count("*").alias("n"))


def _votes(t):
    return t.events.select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("outcome"), F.col("value").alias("seconds"))


@query("st2_stream_tally", """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type as outcome, count(*) n, round(avg(value), 6) avg_seconds from events group by all""")
def _(t):
    got = ST.stream_tally(_stream(_votes(t), "t"), scratch(t.spark, "st2"), late="60 days", width="1 hour")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "outcome", "n", F.round("avg_seconds", 6).alias("avg_seconds"))


@query("st2b_stream_candidates", """
with v as (select * from events where user_id % 3 = 1), c as (select date_trunc('hour', ts) h, 'a' as alias, value s, (props->>'$.k')::int k from v where event_id % 5 <> 0 union all select date_trunc('hour', ts), 'b', value * 2, (props->>'$.k')::int + 1 from v)
select strftime(h, '%Y-%m-%d %H:%M') as start, alias, count(*) shown, round(avg(s), 6) avg_seconds, round(avg(k), 6) avg_tokens, null::varchar as outcome from c group by all
union all select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M'), null, count(*), round(avg(value), 6), null, event_type from v where event_type = (select min(event_type) from events) group by date_trunc('hour', ts), event_type""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    v = t.events.select(F.col("ts").cast("timestamp").alias("t"), F.concat(F.lit("org"), (F.col("user_id") % 3).cast("string")).alias("org"), F.col("event_type").alias("outcome"), F.col("value").alias("seconds"), F.array(
        F.struct(F.lit("a").alias("alias"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("seconds"), k.alias("tokens_out")),
        F.struct(F.lit("b").alias("alias"), (F.col("value") * 2).alias("seconds"), (k + 1).alias("tokens_out"))).alias("cands"))
    first = t.events.agg(F.min("event_type")).first()[0]
    a = ST.stream_candidates(_stream(v, "t"), scratch(t.spark, "st2b"), late="60 days", width="1 hour", org="org1")
    b = ST.stream_tally(_stream(v, "t"), scratch(t.spark, "st2c"), late="60 days", width="1 hour", org="org1", choice=first)
    at = F.date_format("start", "yyyy-MM-dd HH:mm").alias("start")
    one = a.select(at, "alias", "shown", F.round("avg_seconds", 6).alias("avg_seconds"), F.round("avg_tokens", 6).alias("avg_tokens"), F.lit(None).cast("string").alias("outcome"))
    return one.unionByName(b.select(at, F.lit(None).cast("string").alias("alias"), F.col("n").alias("shown"), F.round("avg_seconds", 6).alias("avg_seconds"), F.lit(None).cast("double").alias("avg_tokens"), "outcome"))


@query("st3_stream_restore", """select 'r' || c_custkey as response, 'Dear ' || c_name || ', and ' || c_name || ' again' as text from customer""")
def _(t):
    vault = cut(V.build_vault(V.cells(t.customer, "c_custkey", {"c_name": "person_name"}, "c")))
    c = t.customer.withColumn("norm", F.lower("c_name")).join(vault.select("norm", "code"), "norm")
    text = F.concat(F.lit("Dear "), F.col("code"), F.lit(", and "), F.col("code"), F.lit(" again"))
    pieces = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 7).cast("int")), lambda i: F.substring(text, i * 7 + 1, F.lit(7))), lambda p: p != "")
    d = c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("response"), F.posexplode(pieces).alias("seq", "delta"), F.size(pieces).alias("n"))
    d = d.select("response", F.col("seq").cast("long").alias("seq"), "delta", (F.col("seq") + 1 == F.col("n")).alias("done"))
    path = scratch(t.spark, "deltas")
    d.filter("seq < 3").repartition(4, "response").write.parquet(path)  # two waves: replies arrive in several batches
    d.filter("seq >= 3").repartition(4, "response").write.mode("append").parquet(path)
    deltas = t.spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 4).parquet(path)
    out = ST.stream_restore(deltas, vault, scratch(t.spark, "st3"))
    return out.groupBy("response").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restored"))), lambda s: s["restored"]), "").alias("text"))


@query("st4_stream_redact", r"""select count(*) as sent, 0 as refused, (select count(distinct lower(v)) from (select unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) v from documents)) as emails from documents""")
def _(t):
    m = _stream(t.documents.select(F.col("doc_id").alias("id"), "text"), "id", files=2)
    sent, refused, vault = ST.stream_redact(m, scratch(t.spark, "st4"), V.empty_vault(t.spark))
    one = sent.agg(F.count("*").alias("sent"))
    return one.crossJoin(refused.agg(F.count("*").cast("int").alias("refused"))).crossJoin(vault.filter("prefix = 'EMAIL'").agg(F.count("*").alias("emails")))  # one row each


@query("st5_stream_once", """select user_id || '/' || event_type as key, 'done' as result from events group by all""")
def _(t):
    a = t.events.select(F.col("ts").cast("timestamp").alias("t"), F.concat_ws("/", "user_id", "event_type").alias("key"))
    return ST.stream_once(_stream(a, "t"), scratch(t.spark, "st5"), lambda b: b.withColumn("result", F.lit("done")))


@query("st6_stream_new_parts", """select app, count(*) n from (select distinct user_id % 5 as app, part from (select user_id, unnest([event_type, props]) part from events)) group by 1""")
def _(t):
    r = t.events.select(F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 5).cast("string").alias("app"), F.array("event_type", "props").alias("parts"))
    got = ST.stream_new_parts(_stream(r, "t"), scratch(t.spark, "st6"))
    return got.groupBy(F.col("app").cast("long").alias("app")).agg(F.count("*").alias("n"))


@query("st7_stream_quota", """
with r as (select strftime(ts, '%Y-%m-%d') as day, user_id % 20 as key, event_id, row_number() over (partition by ts::date, user_id % 20 order by ts, event_id) rn from events)
select day, key, count(*) as calls, count(*) filter (where rn <= 5) as accepted from r group by 1, 2""")
def _(t):
    c = t.events.select(F.col("ts").cast("timestamp").alias("t"), (F.col("user_id") % 20).cast("string").alias("key"), F.col("event_id").alias("id"))
    got = ST.stream_quota(_stream(c, "t", files=3), scratch(t.spark, "st7"), 5)
    return got.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("key").cast("long").alias("key")).agg(F.count("*").alias("calls"), F.count_if("accepted").alias("accepted"))


@query("st8_stream_stats", """select event_type as outcome, count(*) requests, sum((props->>'$.k')::int)::bigint substitutions from events group by 1
union all select 'last ' || event_type, count(*), null from (select event_type from events order by ts desc, event_id desc limit 40) group by 1""")
def _(t):
    log = t.events.select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("substitutions"))
    live = ST.stream_stats(_stream(log, "t"), scratch(t.spark, "st8"))
    last = ST.last_requests(t.events, "ts", "event_id").groupBy(F.concat(F.lit("last "), "event_type").alias("outcome")).agg(F.count("*").alias("requests"))
    return live.unionByName(last.withColumn("substitutions", F.lit(None).cast("long")))


@query("st9_skip_known", """select count(distinct text) as processed, sum(distinct_len)::bigint as chars from (select distinct text, length(text) distinct_len from conversations)""")
def _(t):
    i = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    got = ST.stream_skip_known(_stream(i, "id"), scratch(t.spark, "st9"), 1, lambda b: b.withColumn("result", F.length("text").cast("string")))
    return got.agg(F.count("*").alias("processed"), F.sum(F.col("result").cast("long")).alias("chars"))


@query("st10_invalidate", """select doc_id as id, lang as label from documents where doc_id not in (select doc_id from labels where toxic = 1) and doc_id % 4 <> 0""")
def _(t):
    ch = t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id")).unionByName(t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id")))
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    out, path = scratch(t.spark, "st10"), scratch(t.spark, "stream-in")
    for part in ("id % 3 = 0", "id % 3 <> 0"):  # the second run goes on where the first one ended
        ch.filter(part).repartitionByRange(2, "id").write.mode("append").parquet(path)
        got = ST.stream_invalidate(t.spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(path), d, out, rows_per_bucket=250)
    return got
