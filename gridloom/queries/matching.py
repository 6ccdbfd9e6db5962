"""Exact joins, similarity joins and value matching."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import joins as J
from gridloom.operators import match as M
from gridloom.queries.registry import query

# Spellings are derived from the tables: an upper-case copy, a doubled letter, a missing last letter.


def _misspelt(c, k):
    """Deterministic spelling variant of a name, by a row number."""
    m = k % 3
    double = F.concat(F.substring(c, 1, 3), F.substring(c, 3, 100))
    drop = F.expr(f"substring({c}, 1, length({c}) - 1)")
    return F.when(m == 0, F.concat(F.upper(F.col(c)), F.lit(" "))).when(m == 1, double).otherwise(drop)


_MISSPELT_SQL = "case p_partkey % 3 when 0 then upper(p_name) || ' ' when 1 then substr(p_name, 1, 3) || substr(p_name, 3) else substr(p_name, 1, length(p_name) - 1) end"


@query("jn1_join_delta", """
with x as (select c_custkey, round(sum(o_totalprice) filter (where year(o_orderdate) = 1996), 2) a, round(sum(o_totalprice) filter (where year(o_orderdate) = 1997), 2) b
 from orders join customer on o_custkey = c_custkey group by 1)
select c_custkey, a spend_before, b spend_after, round(b - a, 2) spend_change from x where a is not null and b is not null""")
def _(t):
    def year(y):
        return t.orders.filter(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return J.join_delta(year(1996), year(1997), "c_custkey", ["spend"]).withColumn("spend_change", F.round("spend_change", 2))


@query("jn2_anti_join", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def _(t):
    o = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing_from(t.customer, o, "c_custkey").select("c_custkey", "c_name")


@query("jn3_semi_join", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 48 and l_returnflag = 'R')")
def _(t):
    l = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return J.having_any(t.orders, l, "o_orderkey", (F.col("l_quantity") >= 48) & (F.col("l_returnflag") == "R")).select("o_orderkey")


def _labels(t):
    """Two versions of one definition: version 1 from toxic, version 2 from quality."""
    v1 = t.labels.select(F.col("doc_id").alias("record_id"), F.lit("good").alias("name"), F.lit(1).alias("version"), F.when(F.col("toxic") == 1, "yes").otherwise("no").alias("label"))
    v2 = t.labels.select(F.col("doc_id").alias("record_id"), F.lit("good").alias("name"), F.lit(2).alias("version"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))
    labels = v1.unionByName(v2)
    return labels, labels.select("name", "version").distinct()


@query("jn4_label_join", """
select doc_id, 'file' kind from documents where doc_id in (select doc_id from labels where quality = 0)
union all select distinct hash_source, 'thread' from (select substr(source, 4)::bigint hash_source, doc_id from documents) where doc_id in (select doc_id from labels where quality = 0)""")
def _(t):
    labels, defs = _labels(t)
    files = J.with_label(t.documents.select("doc_id"), "doc_id", labels, defs, "good", "no").withColumn("kind", F.lit("file"))
    mail = t.documents.select("doc_id", F.substring("source", 4, 20).cast("long").alias("thread"))
    th = J.threads_with_label(mail, "thread", "doc_id", labels, defs, "good", "no").select(F.col("thread").alias("doc_id"), F.lit("thread").alias("kind"))
    return files.unionByName(th)


@query("jn5_lookup", """
select s_suppkey, n_name as nation_n_name, n_regionkey as nation_n_regionkey from supplier left join nation on s_nationkey = n_nationkey""")
def _(t):
    left = t.supplier.withColumn("key", F.concat(F.lit("  "), F.col("s_nationkey").cast("string"), F.lit(" ")))
    return J.lookup(left, t.nation, ("key", "n_nationkey"), ["n_name", "n_regionkey"], "nation_").select("s_suppkey", "nation_n_name", "nation_n_regionkey")


@query("jn6_lookup_first_name", """
with n as (select distinct p_name, split_part(p_name, ' ', 1) f from part), u as (select f, min(p_name) nm, count(*) c from n group by 1)
select p_partkey, case when p_partkey % 2 = 0 then lower(p_name) else (select nm from u where u.f = split_part(p_name, ' ', 1) and c = 1) end as as_p_name from part""")
def _(t):
    key = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.split("p_name", " ")[0])
    left = t.part.select("p_partkey", key.alias("k"))
    return J.lookup(left, t.part.select("p_name"), ("k", "p_name"), ["p_name"], "as_", first_name=True).select("p_partkey", "as_p_name")


@query("jn7_fuzzy_best", f"""
with l as (select distinct {_MISSPELT_SQL} v from part), r as (select distinct p_name from part),
x as (select v, p_name, round(jaro_winkler_similarity(lower(trim(v)), lower(trim(p_name))), 12) s from l, r)
select v left_value, p_name right_value, round(s, 6) score from x where s >= 0.9 qualify row_number() over (partition by v order by s desc, p_name) = 1""")
def _(t):
    return M.fuzzy_best(t.part.select(_misspelt("p_name", F.col("p_partkey"))), t.part.select("p_name")).withColumn("score", F.round("score", 6))


_GARBLED_SQL = "case when p_partkey % 2 = 0 then substr(p_name, 1, 3) || substr(p_name, 3) else substr(p_name, 1, length(p_name) - 1) end"


@query("jn8_discover_bridges", f"""
with l as (select distinct lower(trim({_GARBLED_SQL})) v from part), r as (select distinct lower(trim(p_name)) v from part),
x as (select l.v, max(jaro_winkler_similarity(l.v, r.v)) s, max(case when l.v = r.v then 1 else 0 end) e from l, r group by 1),
y as (select r.v, max(jaro_winkler_similarity(l.v, r.v)) s, max(case when l.v = r.v then 1 else 0 end) e from l, r group by 1),
z as (select 'entries.item' as "column", 'part.p_name' as master, (select count(*) from l) ls, (select count(*) from r) rs, count(*) filter (where s >= 0.9) fuzzy, sum(e)::bigint exact from x
 union all select 'part.p_name', 'entries.item', (select count(*) from r), (select count(*) from l), count(*) filter (where s >= 0.9), sum(e)::bigint from y)
select "column", master, fuzzy, exact, round(fuzzy / ls, 6) fuzzy_share, round(exact / ls, 6) exact_share from z
where rs >= ls and fuzzy / ls >= 0.85 and exact / ls <= 0.8 and fuzzy - exact >= 3""")
def _(t):
    def col(df, table, name, c):
        return df.select(F.lit(table).alias("table"), F.lit(name).alias("column"), c.alias("value"))
    vals = col(t.part, "part", "p_name", F.col("p_name")).unionByName(col(t.part, "entries", "item", _misspelt("p_name", F.col("p_partkey") % 2 + 1)))
    vals = vals.unionByName(col(t.customer, "customer", "c_mktsegment", F.col("c_mktsegment"))).distinct()
    return M.discover_bridges(vals).withColumns({c: F.round(c, 6) for c in ("fuzzy_share", "exact_share")})


@query("jn9_reconcile", f"""
with e as (select {_MISSPELT_SQL} v from part), d as (select distinct v from e), m as (select distinct p_name from part),
b as (select v, p_name from (select v, p_name, round(jaro_winkler_similarity(lower(trim(v)), lower(trim(p_name))), 12) s from d, m) where s >= 0.9
 qualify row_number() over (partition by v order by s desc, p_name) = 1)
select m.p_name, count(e.v) entries from m left join b on b.p_name = m.p_name left join e on e.v = b.v group by 1""")
def _(t):
    return M.reconcile(t.part, "p_name", t.part.select(_misspelt("p_name", F.col("p_partkey")).alias("v")), "v")


@query("jn10_safe_join", "select l_orderkey, l_linenumber, o_custkey from lineitem left join orders on l_orderkey = o_orderkey")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return J.safe_join(t.lineitem.select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("jn11_join_facts", """
select c_custkey, coalesce(o.n, 0) orders, round(coalesce(o.s, 0), 2) spend, coalesce(e.n, 0) clicks from customer
left join (select o_custkey k, count(*) n, sum(o_totalprice) s from orders group by 1) o on o.k = c_custkey
left join (select user_id k, count(*) n from events group by 1) e on e.k = c_custkey""")
def _(t):
    o, e = t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.events.withColumnRenamed("user_id", "c_custkey")
    got = J.join_facts(t.customer.select("c_custkey"), "c_custkey", {
        "orders": (o, [F.count("*").alias("orders"), F.sum("o_totalprice").alias("spend")]), "events": (e, [F.count("*").alias("clicks")])})
    return got.withColumn("spend", F.round("spend", 2))


@query("jn12_complete_grid", """
select u.user_id, d.event_type, count(e.event_id) n from (select distinct user_id from events) u cross join (select distinct event_type from events) d
left join events e on e.user_id = u.user_id and e.event_type = d.event_type group by all""")
def _(t):
    return J.complete_grid(t.events, "user_id", "event_type", F.count("*"), "n")


@query("jn13_match_place", """
with r as (select n_name from nation), q as (select n_nationkey, case n_nationkey % 3 when 0 then n_name || ' District' when 1 then upper(n_name) else lower(n_name) end nm from nation)
select c_custkey, n.n_name as matched from customer join nation n on c_nationkey = n_nationkey""")
def _(t):
    k = F.col("c_nationkey") % 3
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = t.customer.join(n, "c_nationkey").select("c_custkey", F.when(k == 0, F.concat("n_name", F.lit(" District"))).when(k == 1, F.upper("n_name")).otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("nm"))
    return M.match_place(names, "nm", t.nation, "n_name").select("c_custkey", "matched")


@query("jn14_closest_value")
def _(t):
    v = t.part.select(_misspelt("p_name", F.col("p_partkey")).alias("v"))
    return M.closest_value(v, "v", t.part, "p_name").withColumn("score", F.round("score", 6))


_PARTLY_SQL = """case p_partkey % 4 when 0 then '  ' || upper(p_name) when 1 then 'the ' || p_name || ', please' when 2 then substr(p_name, 3, length(p_name) - 3) else p_name end"""


@query("jn14b_contained_value", f"""
with v as (select distinct {_PARTLY_SQL} v from part), o as (select lower(trim(p_name)) k, min(p_name) o from part group by 1),
m as (select v, min(o) o, count(*) c, bool_or(lower(trim(v)) = k) same from v, o where contains(lower(trim(v)), k) or contains(k, lower(trim(v))) group by 1),
s as (select v, o.o from v join o on lower(trim(v)) = k)
select v.v as value, coalesce(s.o, case when m.c = 1 then m.o end) as matched, case when s.o is not null then 'same' when m.c = 1 then 'contained' end as how from v left join s using (v) left join m using (v) where s.o is not null or m.c = 1""")
def _(t):
    k = F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(k == 1, F.concat(F.lit("the "), F.col("p_name"), F.lit(", please"))).when(
        k == 2, F.substring(F.col("p_name"), F.lit(3), F.length("p_name") - 3)).otherwise(F.col("p_name"))
    return M.match_value(t.part.select(v.alias("v")), "v", t.part, "p_name").filter(F.col("how").isin("same", "contained"))


@query("jn15_row_check", """
select o_orderkey, n as line_count, 'more than six lines' message from orders join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey where n > 6""")
def _(t):
    l = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    got = J.row_check(t.orders, "o_orderkey", l, F.count("*"), "line_count", F.col("line_count") > 6, "more than six lines")
    return got.select("o_orderkey", "line_count", "message")


@query("jn16_overlap_join", """
with a as (select user_id, event_id, event_id * 3 as s, event_id * 3 + 40 e from events where event_type = 'click'),
b as (select user_id, event_id, event_id * 3 as s, event_id * 3 + 300 e from events where event_type = 'error')
select a.user_id, a.event_id, b.event_id b_event_id from a join b on a.user_id = b.user_id and a.s < b.e and b.s < a.e""")
def _(t):
    def spans(kind, size):
        s = (F.col("event_id") * 3)
        return t.events.filter(F.col("event_type") == kind).select("user_id", "event_id", s.alias("start"), (s + size).alias("end"))
    return J.overlap_join(spans("click", 40), spans("error", 300), "user_id").select("user_id", "event_id", "b_event_id")


_SLOT_SQL = """
with days as (select d::date as day from generate_series(timestamp '2024-01-08', timestamp '2024-01-30', interval 1 day) g(d) where isodow(d) < 6 order by d limit 5),
slots as (select day, s from days, generate_series(day + interval 10 hour, day + interval 18 hour - interval 45 minute, interval 30 minute) x(s) where s >= timestamp '2024-01-08 11:00:00'),
p as (select distinct user_id from events), w as (select user_id, day, s from p, slots),
busy as (select user_id, ts a, ts + to_minutes((value / 2)::int) b from events),
f as (select * from w where not exists (select 1 from busy where busy.user_id = w.user_id and w.s < busy.b and busy.a < w.s + interval 45 minute)),
n as (select *, case when row_number() over (partition by user_id, day order by s) = 1 then 0 else 1 end k from f)
select user_id, strftime(s, '%Y-%m-%d %H:%M') as slot, row_number() over (partition by user_id order by k, s) place from n qualify place <= 4"""


@query("jn17_free_slots", _SLOT_SQL)
def _(t):
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.rint(F.col("value") / 2).cast("int"), F.lit(0))
    busy = t.events.select("user_id", F.col("ts").alias("start"), end.alias("end"))
    got = J.free_slots(busy, "user_id", "2024-01-08", 5, 10, 18, 45, 4, "2024-01-08 11:00:00")
    return got.select("user_id", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "place")


@query("jn18_meetings", """select event_id, user_id from events where ts >= timestamp '2024-01-10 09:00:00' and ts < timestamp '2024-01-12 17:30:00'""")
def _(t):
    return J.meetings(t.events, "2024-01-10 09:00:00", "2024-01-12 17:30:00", "ts").select("event_id", "user_id")


@query("jn19_reply_target", """
with m as (select event_id id, 'user' || user_id || '@x.org' from_addr, event_type subj, ts from events)
select o_orderkey, (select max_by(id, (ts, id)) from m where m.from_addr = 'user' || (o_custkey % 200) || '@x.org' and m.subj = case when o_orderkey % 2 = 0 then 'click' else 'purchase' end) reply_to from orders""")
def _(t):
    mail = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("from_addr"),
                           F.concat(F.lit("Re: "), F.col("event_type")).alias("subject"), F.col("ts").alias("date"))
    drafts = t.orders.select("o_orderkey", F.concat(F.lit("user"), (F.col("o_custkey") % 200).cast("string"), F.lit("@X.org")).alias("to_addr"),
                             F.when(F.col("o_orderkey") % 2 == 0, "RE: Fwd: click").otherwise("purchase").alias("subject"))
    return J.reply_target(drafts, mail).select("o_orderkey", "reply_to")


@query("jn20_members", """
select c_custkey, true as wrote from customer where c_custkey in (select user_id from events)
union all select c_custkey, false from customer where c_custkey not in (select user_id from events)""")
def _(t):
    e = t.events.select(F.when(F.col("event_type") != "never", F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("who"))
    a = J.members(t.customer, "c_custkey", e, "who").select("c_custkey", F.lit(True).alias("wrote"))
    return a.unionByName(J.members(t.customer, "c_custkey", e, "who", negate=True).select("c_custkey", F.lit(False).alias("wrote")))


@query("tid13_variant_groups", """
with v as (select case c_custkey % 4 when 0 then lower(c_mktsegment) when 1 then c_mktsegment when 2 then substr(c_mktsegment, 1, 2) || '-' || substr(c_mktsegment, 3) else c_mktsegment || '.' end v from customer),
c as (select v, count(*) n, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') k from v group by 1), d as (select count(*) d from c)
select string_agg(v, ' | ' order by n desc, v) members, sum(n)::bigint as "rows" from c, d where d between 2 and 60 group by k having count(*) > 1""")
def _(t):
    m, c = F.col("c_custkey") % 4, F.col("c_mktsegment")
    v = (F.when(m == 0, F.lower(c)).when(m == 1, c).when(m == 2, F.concat(F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 100)))
         .otherwise(F.concat(c, F.lit("."))))
    return M.variant_groups(t.customer.select(v.alias("v")), "v")
