"""Filters, specs, periods, aggregates, windows, order and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import dates
from gridloom.functions.text import words
from gridloom.operators import aggregate as A
from gridloom.operators.scale import numbered, top_per_key
from gridloom.plans import form as fm
from gridloom.plans import periods as pr
from gridloom.plans import steps as st
from gridloom.queries.registry import query

AS_OF = "1998-08-15"


def _orders(t):
    return t.orders.withColumn("o_orderdate", F.to_date("o_orderdate"))


ORDER_FORM = fm.Form(kinds={"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "choice", "o_totalprice": "number",
                            "o_orderdate": "date", "o_orderpriority": "choice", "c_mktsegment": "choice", "c_name": "contains"},
                     presets={"urgent open": {"o_orderpriority": ["1-urgent"], "o_orderstatus": ["O"]}},
                     known={"o_orderstatus": ["F", "O", "P"]}, hidden=frozenset({"o_custkey"}))


def _order_view(t):
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name")
    return _orders(t).join(cust, "o_custkey", "left")


# ------------------------------------------------------------------ filters
@query("flt1_plan_filter", """
select o_orderkey, o_orderstatus, o_totalprice from orders
where o_orderstatus = 'O' and o_totalprice between 50000 and 150000 and o_orderpriority <> '5-LOW'
  and o_orderpriority in ('1-URGENT','2-HIGH','4-NOT SPECIFIED') and contains(lower(o_orderpriority), 'h')""")
def _(t):
    return st.run_plan(t.orders, [
        {"op": "filter", "column": "o_orderstatus", "cmp": "eq", "value": "O"},
        {"op": "filter", "column": "o_totalprice", "cmp": "between", "value": (50000, 150000)},
        {"op": "filter", "column": "o_orderpriority", "cmp": "ne", "value": "5-LOW"},
        {"op": "filter", "column": "o_orderpriority", "cmp": "in", "value": ("1-URGENT", "2-HIGH", "4-NOT SPECIFIED")},
        {"op": "filter", "column": "o_orderpriority", "cmp": "contains", "value": "H"},
    ]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt2_derive", """
select l_orderkey, l_linenumber, round(100.0 * l_tax / nullif(l_discount, 0), 8) tax_pct,
  round(l_extendedprice / nullif(l_quantity, 0), 8) unit_price, round(l_extendedprice - l_quantity, 2) gap from lineitem""")
def _(t):
    d = t.lineitem.transform(st.derive, "percent", "l_tax", "l_discount", "tax_pct")
    d = d.transform(st.derive, "ratio", "l_extendedprice", "l_quantity", "unit_price")
    d = d.transform(st.derive, "difference", "l_extendedprice", "l_quantity", "gap")
    return d.select("l_orderkey", "l_linenumber", F.round("tax_pct", 8).alias("tax_pct"),
                    F.round("unit_price", 8).alias("unit_price"), F.round("gap", 2).alias("gap"))


@query("flt3_form_filter", """
select o.o_orderstatus, count(*) as "rows" from orders o left join customer c on o.o_custkey = c.c_custkey
where lower(trim(c.c_mktsegment)) in ('building','machinery') and (lower(trim(o_orderstatus)) not in ('p') or o_orderstatus is null)
  and o_totalprice >= 1000 and o_totalprice <= 400000 and o_orderdate >= date '1996-03-01' and o_orderdate < date '1998-07-01'
  and (c.c_name ilike '%1%' or c.c_name ilike '%7%') group by 1""")
def _(t):
    spec = fm.Spec(measures=["rows"], group_by=["o_orderstatus"], filters={
        "c_mktsegment": [" Building", "MACHINERY "], "o_orderstatus": {"not": "p"}, "o_totalprice": {"min": 1000, "max": 400000},
        "o_orderdate": {"from": "1996-03", "to": "Jun 1998"}, "c_name": ["1", "7"]})
    return fm.run_form(_order_view(t), ORDER_FORM, spec, total=False).drop("is_total")


@query("flt4_preset", """
select o_orderpriority, o_orderstatus, count(*) as "rows" from orders
where lower(trim(o_orderpriority)) in ('1-urgent') and lower(trim(o_orderstatus)) in ('f') group by all""")
def _(t):
    spec = fm.Spec(measures=["rows"], group_by=["o_orderpriority", "o_orderstatus"], preset=["urgent open"], filters={"o_orderstatus": ["F"]})
    return fm.run_form(_orders(t), ORDER_FORM, spec, total=False).drop("is_total")


@query("flt5_exclusion_to_inclusion", """
select count(*) as "rows", round(sum(o_totalprice), 2) as sum_o_totalprice from orders where lower(trim(o_orderstatus)) = 'p'""")
def _(t):
    spec = fm.Spec(measures=["rows", "sum:o_totalprice"], filters={"o_orderstatus": {"not": ["F", "O"]}})
    return fm.run_form(_orders(t), ORDER_FORM, spec).withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("flt8_listing", """
select * from (select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders
where lower(trim(o_orderpriority)) in ('2-high') order by o_totalprice desc nulls last, o_orderkey limit 50),
(select count(*) as matching from orders where lower(trim(o_orderpriority)) in ('2-high'))""")
def _(t):
    form = fm.Form(kinds={k: v for k, v in ORDER_FORM.kinds.items() if k not in ("c_mktsegment", "c_name")}, hidden=ORDER_FORM.hidden)
    spec = fm.Spec(filters={"o_orderpriority": ["2-HIGH"]}, sort={"by": "o_totalprice"}, limit=50)
    rows = fm.run_form(_orders(t), form, spec).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.crossJoin(F.broadcast(fm.count_matches(_orders(t), form, spec)))  # one row


@query("flt8b_labelled_listing", """
select o_orderkey + 2 as "Sheet row", o_orderkey, o_orderstatus as "Order status", o_totalprice as "Total price", strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority as "Priority" from orders
where lower(trim(o_orderpriority)) in ('2-high') order by o_totalprice nulls last, o_orderkey limit 40""")
def _(t):
    form = fm.Form(kinds={k: v for k, v in ORDER_FORM.kinds.items() if k not in ("c_mktsegment", "c_name")}, hidden=ORDER_FORM.hidden, row_number="_row",
                   labels={"o_orderstatus": "Order status", "o_totalprice": "Total price", "o_orderpriority": "Priority"})
    spec = fm.Spec(filters={"o_orderpriority": ["2-HIGH"]}, sort={"by": "o_totalprice", "dir": "asc"}, limit=40)
    rows = fm.run_form(_orders(t).withColumn("_row", F.col("o_orderkey") + 2), form, spec)
    return rows.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("flt9_saved_question", """
select o_orderpriority, count(*) n, round(avg(o_totalprice), 4) avg_price from orders
where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01' and o_totalprice >= 1000 group by 1""")
def _(t):
    from gridloom.plans.saved import Param, run_saved
    sql = """select o_orderpriority, count(*) n, round(avg(o_totalprice), 4) avg_price from {orders}
             where (:status is null or o_orderstatus = :status) and o_orderdate >= :since
               and (:least is null or o_totalprice >= :least) group by 1"""
    params = {"status": Param("choice", options=("F", "O", "P")), "since": Param("date"), "least": Param("number", default=1000)}
    return run_saved(t.spark, sql, params, {"status": "F", "since": "1997-01-01"}, orders=t.orders)


@query("flt10_threshold_multiple", """
select c_custkey, c_acctbal, round(debt, 2) as debt from (select o_custkey, sum(o_totalprice) debt from orders group by 1) o
join customer c on c.c_custkey = o.o_custkey where c_acctbal > 0 and debt > 300 * c_acctbal""")
def _(t):
    debt = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("debt"))
    return (t.customer.join(debt, "c_custkey").filter((F.col("c_acctbal") > 0) & (F.col("debt") > 300 * F.col("c_acctbal")))
            .select("c_custkey", "c_acctbal", F.round("debt", 2).alias("debt")))


@query("flt11_saved_view", """select 'open_orders' as view_name, 'orders not yet filled' as about, o_orderpriority, count(*) n
from orders where o_orderstatus = 'O' group by all""")
def _(t):
    from gridloom.plans.saved import save_view
    meta = save_view("open_orders", t.orders.filter("o_orderstatus = 'O'"), "orders not yet filled")
    got = t.spark.sql("select o_orderpriority, count(*) n from open_orders group by 1")
    return got.crossJoin(F.broadcast(meta.select(F.col("name").alias("view_name"), "about")))  # one row


# ------------------------------------------------------------------ periods
@query("per1_named_periods", f"""
with p as (select * from (values ('this_month', date '1998-08-01', date '{AS_OF}'), ('last_month', date '1998-07-01', date '1998-07-31'),
 ('this_quarter', date '1998-07-01', date '{AS_OF}'), ('last_quarter', date '1998-04-01', date '1998-06-30'),
 ('this_year', date '1998-01-01', date '{AS_OF}'), ('last_year', date '1997-01-01', date '1997-12-31'),
 ('this_financial_year', date '1998-04-01', date '{AS_OF}'), ('last_financial_year', date '1997-04-01', date '1998-03-31'),
 ('last_7_days', date '1998-08-09', date '{AS_OF}'), ('last_30_days', date '1998-07-17', date '{AS_OF}'),
 ('last_90_days', date '1998-05-18', date '{AS_OF}')) v(period, a, b))
select period, count(*) n, round(sum(o_totalprice), 2) total from orders join p on o_orderdate::date between a and b group by 1""")
def _(t):
    got = pr.in_periods(t.orders.select("o_orderdate", "o_totalprice"), "o_orderdate", pr.period_table(t.spark, AS_OF))
    return got.groupBy("period").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("per2_day_ranges", """
with d as (select distinct o_orderdate::date as_of from orders where o_orderdate::date between date '1998-08-10' and date '1998-08-16'),
r as (select date '1998-08-12' as t), p as (
 select 'today' phrase, t as a, t + 1 as b from r union all select 'yesterday', t - 1, t from r union all select 'tomorrow', t + 1, t + 2 from r
 union all select 'this week', date '1998-08-10', date '1998-08-17' from r union all select 'last week', date '1998-08-03', date '1998-08-10' from r
 union all select 'next week', date '1998-08-17', date '1998-08-24' from r union all select 'this month', date '1998-08-01', date '1998-09-01' from r
 union all select 'last month', date '1998-07-01', date '1998-08-01' from r union all select 'next month', date '1998-09-01', date '1998-10-01' from r
 union all select 'monday', date '1998-08-10', date '1998-08-11' from r union all select 'last wednesday', date '1998-08-05', date '1998-08-06' from r
 union all select 'next wednesday', date '1998-08-19', date '1998-08-20' from r union all select 'this sunday', date '1998-08-16', date '1998-08-17' from r
 union all select 'last 7 days', date '1998-08-06', date '1998-08-13' from r union all select 'last 2 weeks', date '1998-07-30', date '1998-08-13' from r
 union all select 'last 3 months', date '1998-05-15', date '1998-08-13' from r)
select phrase, count(*) n from orders join p on o_orderdate >= a and o_orderdate < b group by 1""")
def _(t):
    r = pr.day_ranges(t.spark, "1998-08-12").filter(F.col("phrase").isin(
        "today", "yesterday", "tomorrow", "this week", "last week", "next week", "this month", "last month", "next month", "monday",
        "last wednesday", "next wednesday", "this sunday", "last 7 days", "last 2 weeks", "last 3 months"))
    j = t.orders.join(F.broadcast(r), (F.to_date("o_orderdate") >= r.start) & (F.to_date("o_orderdate") < r.end))  # 16 rows
    return j.groupBy("phrase").agg(F.count("*").alias("n"))


@query("per3_period_phrases", """
select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') p_from,
 strftime(date_trunc('month', o_orderdate) + interval 3 month - interval 1 day, '%Y-%m-%d') p_to,
 strftime(date_trunc('month', o_orderdate) + interval 1 month, '%Y-%m-%d') after_from, strftime(o_orderdate, '%Y-%m-%d') day_from from orders""")
def _(t):
    d = F.col("o_orderdate")
    three = F.concat(F.lit("sales "), F.date_format(d, "MMMM yyyy"), F.lit(" to "), F.date_format(F.add_months(F.to_date(d), 2), "MMM yyyy"))
    after = F.concat(F.lit("what came in after "), F.date_format(d, "MMM yyyy"))
    pair = F.concat(F.lit("from "), F.date_format(d, "d/M/yyyy"), F.lit(" to "), F.date_format(d, "d/M/yyyy"))
    as_of = F.lit("2002-01-01").cast("date")
    got = t.orders.select("o_orderkey", pr.extract_period(three, as_of).alias("a"), pr.extract_period(after, as_of).alias("b"),
                          pr.extract_period(pair, as_of).alias("c"))
    f = "yyyy-MM-dd"
    return got.select("o_orderkey", F.date_format("a.from", f).alias("p_from"), F.date_format("a.to", f).alias("p_to"),
                      F.date_format("b.from", f).alias("after_from"), F.date_format("c.from", f).alias("day_from"))


@query("per4_period_edges", """
select o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') lo,
 strftime(date_trunc('month', o_orderdate) + interval 1 month - interval 1 day, '%Y-%m-%d') hi from orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(dates.edge(F.date_format(d, "yyyy-MM"), False), "yyyy-MM-dd").alias("lo"),
                           F.date_format(dates.edge(F.date_format(d, "MMM yyyy"), True), "yyyy-MM-dd").alias("hi"))


@query("per5_date_parts", """
select strftime(o_orderdate, '%Y-%m') as month, year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter,
 year(o_orderdate)::varchar as year, count(*) n from orders group by all""")
def _(t):
    keys = [dates.part(F.col("o_orderdate"), p).alias(p) for p in ("month", "quarter", "year")]
    return t.orders.groupBy(*keys).agg(F.count("*").alias("n"))


@query("per6_listing_dates", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') d1, strftime(o_orderdate, '%Y-%m-%d') d2,
 strftime(case when make_date(1998, month(o_orderdate), 1) + (day(o_orderdate)::int - 1) <= date '1998-08-15' and not (month(o_orderdate) = 2 and day(o_orderdate) = 29)
   then make_date(1998, month(o_orderdate), day(o_orderdate)) when month(o_orderdate) = 2 and day(o_orderdate) = 29 then null
   else make_date(1997, month(o_orderdate), day(o_orderdate)) end, '%Y-%m-%d') d3 from orders""")
def _(t):
    d, today = F.col("o_orderdate"), F.lit(AS_OF).cast("date")
    f = "yyyy-MM-dd"
    return t.orders.select("o_orderkey", F.date_format(dates.listing_date(F.date_format(d, "d MMM yyyy"), today), f).alias("d1"),
                           F.date_format(dates.listing_date(F.date_format(d, "MMM d, yyyy"), today), f).alias("d2"),
                           F.date_format(dates.listing_date(F.date_format(d, "MMM d"), today), f).alias("d3"))


@query("per7_record_dates", """
select l_returnflag, count(*) n from lineitem where l_shipdate >= timestamp '1997-05-01' and l_shipdate < timestamp '1998-02-01' group by 1""")
def _(t):
    return pr.between_days(t.lineitem, "l_shipdate", "1997-05-01", "1998-02-01").groupBy("l_returnflag").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ aggregates
@query("agg1_group", """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(avg(l_extendedprice), 4) avg_price, min(l_discount) lo,
 max(l_discount) hi, count(*) n from lineitem group by all order by 1, 2""")
def _(t):
    got = st.group(t.lineitem, ["l_returnflag", "l_linestatus"], [("sum", "l_quantity", "sum_qty"), ("mean", "l_extendedprice", "avg_price"),
                   ("min", "l_discount", "lo"), ("max", "l_discount", "hi"), ("count", "*", "n")])
    return got.withColumns({"sum_qty": F.round("sum_qty", 2), "avg_price": F.round("avg_price", 4)}).orderBy("l_returnflag", "l_linestatus")


@query("agg2_weighted_percent", """
select l_suppkey, round(100.0 * sum(l_tax) / nullif(sum(l_discount), 0), 4) pct from lineitem group by 1""")
def _(t):
    return st.group(t.lineitem, ["l_suppkey"], [("weighted_percent", "l_tax/l_discount", "pct")]).withColumn("pct", F.round("pct", 4))


_FORM_SQL = """
with f as (select coalesce(c_mktsegment, '(blank)') c_mktsegment, year(o_orderdate) || '-Q' || quarter(o_orderdate) q, o_totalprice
 from orders left join customer on o_custkey = c_custkey
 where lower(trim(c_mktsegment)) in ('building', 'machinery', 'household') and o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01')
select c_mktsegment, q as o_orderdate_quarter, count(*) as "rows", round(sum(o_totalprice), 2) sum_o_totalprice,
 round(avg(o_totalprice), 4) avg_o_totalprice, false as is_total from f group by 1, 2
union all select '(total)', '(total)', count(*), round(sum(o_totalprice), 2), round(avg(o_totalprice), 4), true from f"""


@query("agg3_form_spec", _FORM_SQL)
def _(t):
    spec = fm.Spec(measures=["rows", "sum:o_totalprice", "avg:o_totalprice"], group_by=["c_mktsegment", "o_orderdate:quarter"],
                   filters={"c_mktsegment": ["BUILDING", "MACHINERY", "HOUSEHOLD"]}, date={"column": "o_orderdate", "period": "last_year"})
    got = fm.run_form(_order_view(t), ORDER_FORM, spec, as_of=AS_OF)
    return got.withColumns({"sum_o_totalprice": F.round("sum_o_totalprice", 2), "avg_o_totalprice": F.round("avg_o_totalprice", 4)})


@query("agg4_count_by", "select event_type, user_id, count(*) n from events group by all")
def _(t):
    return A.count_by(t.events, ["event_type", "user_id"])


@query("agg5_threads", """
select conv_id, min_by(left(text, 40), turn) subject, min(turn) first_turn, max(turn) last_turn, count(*) messages,
 coalesce(string_agg(distinct case when role <> 'assistant' then role end, ', ' order by case when role <> 'assistant' then role end), '') people,
 max_by(role, turn) last_from, count(*) filter (where length(text) > 400) unread, bool_and(role = 'system') is_bulk
 from conversations group by 1""")
def _(t):
    mail = t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("date"), F.substring("text", 1, 40).alias("subject"),
                                  F.col("role").alias("person"), F.when(F.col("role") == "assistant", "out").otherwise("in").alias("direction"),
                                  (F.length("text") > 400).alias("is_unread"), (F.col("role") == "system").alias("is_bulk"),
                                  F.lit(False).alias("is_notice"))
    return A.threads(mail).select(F.col("thread_id").alias("conv_id"), "subject", F.col("first_date").alias("first_turn"),
                                  F.col("last_date").alias("last_turn"), "messages", "people", "last_from", "unread", "is_bulk")


@query("agg6_pivot_change", """
select o_custkey, round(avg(case when year(o_orderdate) = 1996 then o_totalprice end), 4) as before,
 round(avg(case when year(o_orderdate) = 1998 then o_totalprice end), 4) as after,
 round(avg(case when year(o_orderdate) = 1998 then o_totalprice end) - avg(case when year(o_orderdate) = 1996 then o_totalprice end), 4) change
 from orders where year(o_orderdate) in (1996, 1998) group by 1""")
def _(t):
    got = A.pivot_change(t.orders.withColumn("y", F.year("o_orderdate")), "o_custkey", "y", "o_totalprice", 1996, 1998)
    return got.select("o_custkey", *[F.round(c, 4).alias(c) for c in ("before", "after", "change")])


@query("agg7_matrix", """
with c as (select p_size k1, p_brand k2, count(*) v from part group by all),
r as (select k1, row_number() over (order by k1) row_rank from (select distinct k1 from c) qualify row_rank <= 25),
k as (select k2, row_number() over (order by k2) col_rank from (select distinct k2 from c) qualify col_rank <= 20)
select k1 as p_size, k2 as p_brand, v as value, row_rank, col_rank from c join r using (k1) join k using (k2)""")
def _(t):
    return A.matrix(t.part, "p_size", "p_brand", F.count("*"))


@query("agg8_repeat_share", """
select count(*) filter (where n > 1) repeat_entities, round(100.0 * sum(case when n > 1 then v else 0 end) / sum(v), 6) repeat_share
 from (select o_custkey, count(*) n, sum(o_totalprice) v from orders group by 1)""")
def _(t):
    return A.repeat_share(t.orders, "o_custkey", "o_totalprice").withColumn("repeat_share", F.round("repeat_share", 6))


@query("agg9_compare_rest", """
with g as (select n_name, sum(c_acctbal) s, count(c_acctbal) n, count(*) as "rows", count(*) - count(c_acctbal) blanks from customer join nation on c_nationkey = n_nationkey group by 1),
h as (select *, s / n figure, rank() over (order by s / n desc) as "rank" from g), tg as (select * from h where n_name in ('FRANCE', 'INDIA', 'NATION_3', 'NATION_7')),
o as (select sum(s) / sum(n) rp, avg(s / n) mo from h where n_name not in ('FRANCE', 'INDIA', 'NATION_3', 'NATION_7'))
select n_name, round(figure, 6) figure, round(rp, 6) rest_pooled, round(mo, 6) mean_of_others, "rank", "rows", blanks from tg, o""")
def _(t):
    nat = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    got = A.compare(t.customer.join(nat, "c_nationkey"), "n_name", "c_acctbal", ["FRANCE", "INDIA", "NATION_3", "NATION_7"])
    return got.withColumns({c: F.round(c, 6) for c in ("figure", "rest_pooled", "mean_of_others")})


@query("agg10_profile_vs_all", """
with x as (select count(*) filter (where o_orderpriority = '1-URGENT')::double g, count(*)::double a,
 avg(o_totalprice) filter (where o_orderpriority = '1-URGENT') gp, avg(o_totalprice) ap from orders)
select 'share of rows' figure, g group_value, a all_value, round(100.0 * g / a, 6) as percent from x
union all select 'price', round(gp, 4), round(ap, 4), round(100.0 * (gp - ap) / ap, 6) from x""")
def _(t):
    got = A.profile_vs_all(t.orders, F.col("o_orderpriority") == "1-URGENT", {"price": "o_totalprice"})
    return got.select("figure", F.round("group_value", 4).alias("group_value"), F.round("all_value", 4).alias("all_value"), F.round("percent", 6).alias("percent"))


@query("agg11_spread", """
with o as (select o_orderpriority k, o_totalprice x, row_number() over (partition by o_orderpriority order by o_totalprice desc) rn from orders)
select k as o_orderpriority, round(quantile_cont(x, 0.25), 4) q1, round(quantile_cont(x, 0.5), 4) median, round(quantile_cont(x, 0.75), 4) q3,
 round(avg(x), 4) mean, max(x) maximum, max(x) filter (where rn = 1) top1, max(x) filter (where rn = 2) top2,
 round((sum(x) - sum(x) filter (where rn <= 2)) / (count(x) - 2), 4) mean_without_top2 from o group by 1""")
def _(t):
    got = A.spread(t.orders, ["o_orderpriority"], "o_totalprice")
    return got.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3", "mean", "mean_without_top2")})


@query("agg12_blank_inputs", """
select o_orderpriority, round(sum(case when o_orderstatus <> 'P' then o_totalprice end), 2) total,
 count(*) - count(case when o_orderstatus <> 'P' then 1 end) blank_inputs from orders group by 1""")
def _(t):
    known = t.orders.withColumn("known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return known.groupBy("o_orderpriority").agg(F.round(F.sum("known"), 2).alias("total"), F.count_if(F.col("known").isNull()).alias("blank_inputs"))


@query("agg13_known_rate", """
with x as (select l_shipdate, l_suppkey, case when l_returnflag <> 'R' then l_tax end num, l_discount den from lineitem)
select l_suppkey, round(sum(num) filter (where num is not null and den > 0), 4) num, round(sum(den) filter (where num is not null and den > 0), 4) den,
 count(*) - count(*) filter (where num is not null and den > 0) excluded,
 round(100.0 * sum(num) filter (where num is not null and den > 0) / nullif(sum(den) filter (where num is not null and den > 0), 0), 6) rate from x group by 1""")
def _(t):
    d = t.lineitem.select("l_suppkey", F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("n"), F.col("l_discount").alias("d"))
    got = A.known_rate(d, "n", "d", ["l_suppkey"])
    return got.select("l_suppkey", F.round("num", 4).alias("num"), F.round("den", 4).alias("den"), "excluded", F.round("rate", 6).alias("rate"))


def _votes(t):
    """Votes shaped from events: type as outcome, two candidates with their seconds and tokens."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("ts", F.col("event_type").alias("outcome"), F.array(
        F.struct(F.lit("a").alias("alias"), F.col("value").alias("seconds"), k.alias("tokens_out")),
        F.struct(F.lit("b").alias("alias"), (F.col("value") * 2).alias("seconds"), (k + 1).alias("tokens_out"))).alias("cands"))


@query("agg14_tally", """
select 'outcome' what, event_type as name, count(*) n, null::double avg_seconds, null::double avg_tokens from events group by all
union all select 'candidate', 'a', count(*), round(avg(value), 6), round(avg((props->>'$.k')::int), 6) from events
union all select 'candidate', 'b', count(*), round(avg(value * 2), 6), round(avg((props->>'$.k')::int + 1), 6) from events""")
def _(t):
    v = _votes(t)
    a = A.tally(v).select(F.lit("outcome").alias("what"), F.col("outcome").alias("name"), "n", F.lit(None).cast("double").alias("avg_seconds"),
                          F.lit(None).cast("double").alias("avg_tokens"))
    b = A.candidate_stats(v).select(F.lit("candidate").alias("what"), F.col("alias").alias("name"), F.col("shown").alias("n"),
                                    F.round("avg_seconds", 6).alias("avg_seconds"), F.round("avg_tokens", 6).alias("avg_tokens"))
    return a.unionByName(b)


@query("agg15_crosstab", """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as "F", count(*) filter (where o_orderstatus = 'O') as "O",
 count(*) filter (where o_orderstatus = 'P') as "P", count(*) total from orders group by 1""")
def _(t):
    return A.crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("agg16_before_after", """
with x as (select l_suppkey, case when l_returnflag <> 'R' then l_tax end num, l_discount den,
 case when l_shipdate::date >= date '1997-06-01' - 90 and l_shipdate::date < date '1997-06-01' then 'b'
      when l_shipdate::date > date '1997-06-15' and l_shipdate::date <= date '1997-06-15' + 90 then 'a' end w from lineitem),
y as (select l_suppkey, 100.0 * sum(num) filter (where w = 'b') / nullif(sum(den) filter (where w = 'b'), 0) b,
 100.0 * sum(num) filter (where w = 'a') / nullif(sum(den) filter (where w = 'a'), 0) a from x where w is not null and num is not null and den > 0 group by 1)
select l_suppkey, round(b, 6) as before, round(a, 6) as after, round(b - a, 6) as "drop" from y""")
def _(t):
    d = t.lineitem.select("l_suppkey", "l_shipdate", F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("n"), "l_discount")
    got = A.before_after(d, "l_suppkey", "l_shipdate", "n", "l_discount", "1997-06-01", "1997-06-15", 90)
    return got.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("before", "after", "drop")])


@query("agg17_cohorts", """
with x as (select o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 q, case when o_orderstatus <> 'P' then o_totalprice end num from orders),
e as (select o_custkey, min(q) e from x group by 1)
select (e // 4)::varchar || '-Q' || (e % 4 + 1)::varchar as entry, q - e as elapsed, count(*) planned, count(num) observed,
 coalesce(round(100.0 * sum(num) / nullif(sum(case when num is not null then 1000.0 end), 0), 4)::varchar <> '', false) has_rate,
 round(100.0 * sum(num) / nullif(sum(case when num is not null then 1000.0 end), 0), 2) rate from x join e using (o_custkey) group by e, q - e""")
def _(t):
    d = t.orders.select("o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("n"), F.lit(1000.0).alias("d"))
    got = A.cohorts(d, "o_custkey", "o_orderdate", "n", "d")
    return got.select("entry", "elapsed", "planned", "observed", F.col("rate").isNotNull().alias("has_rate"), F.round("rate", 2).alias("rate"))


@query("agg18_under_delivered", """
select o_custkey, count(*) received, max(c_acctbal) / 500 expected from orders join customer on o_custkey = c_custkey
group by 1 having count(*) < 0.5 * max(c_acctbal) / 500""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    got = t.orders.groupBy("o_custkey").agg(F.count("*").alias("received")).join(c, "o_custkey").withColumn("expected", F.col("c_acctbal") / 500)
    return got.filter(F.col("received") < 0.5 * F.col("expected")).select("o_custkey", "received", "expected")


@query("agg19_top_with_others", """
with g as (select p_brand, count(*) n from part group by 1), r as (select *, row_number() over (order by n desc, p_brand) rn from g)
select case when rn <= 7 then p_brand else 'Others' end p_brand, sum(n)::bigint n from r group by 1""")
def _(t):
    return A.top_with_others(t.part.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", "n", 7)




@query("agg20_merge_points", """
select (c_nationkey * 3.0 - 30) lat, (c_nationkey * 7.0 - 80) lon, count(*) as "rows",
 case when min(c_mktsegment) = max(c_mktsegment) then min(c_mktsegment) else 'mixed' end category,
 string_agg(distinct c_mktsegment, ', ' order by c_mktsegment) categories, round(sum(c_acctbal), 2) size from customer group by c_nationkey""")
def _(t):
    pts = t.customer.withColumns({"lat": F.col("c_nationkey") * 3.0 - 30, "lon": F.col("c_nationkey") * 7.0 - 80})
    return A.merge_points(pts, "lat", "lon", "c_mktsegment", "c_acctbal").withColumn("size", F.round("size", 2))


@query("agg21_centres", """
select c_mktsegment, round(avg(lat), 6) lat, round(avg(lon), 6) lon, count(*) as "rows"
from (select c_mktsegment, c_nationkey * 5.0 - 30 lat, c_nationkey * 9.0 - 80 lon from customer) where lat between -90 and 90 and lon between -180 and 180 group by 1""")
def _(t):
    pts = t.customer.withColumns({"lat": F.col("c_nationkey") * 5.0 - 30, "lon": F.col("c_nationkey") * 9.0 - 80})
    return A.centres(pts, "c_mktsegment", "lat", "lon").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("agg14b_tally_chosen", """
with v as (select *, 'org' || (user_id % 3) as org from events), f as (select * from v where org = 'org1' and event_type = (select min(event_type) from events))
select 'outcome' what, event_type as name, count(*) n, null::double avg_seconds, null::double avg_tokens from v where org = 'org2' group by all
union all select 'candidate', 'a', count(*), round(avg(value), 6), round(avg((props->>'$.k')::int), 6) from f where event_id % 5 <> 0
union all select 'candidate', 'b', count(*), round(avg(value * 2), 6), round(avg((props->>'$.k')::int + 1), 6) from f""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    v = t.events.select("ts", F.concat(F.lit(" org"), (F.col("user_id") % 3).cast("string")).alias("org"), F.col("event_type").alias("outcome"), F.array(
        F.struct(F.lit("a").alias("alias"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("seconds"), k.alias("tokens_out")),
        F.struct(F.lit("b").alias("alias"), (F.col("value") * 2).alias("seconds"), (k + 1).alias("tokens_out"))).alias("cands"))
    first = t.events.agg(F.min("event_type")).first()[0]
    a = A.tally(v, org="org2").select(F.lit("outcome").alias("what"), F.col("outcome").alias("name"), "n", F.lit(None).cast("double").alias("avg_seconds"), F.lit(None).cast("double").alias("avg_tokens"))
    b = A.candidate_stats(v, org="org1", choice=first).select(F.lit("candidate").alias("what"), F.col("alias").alias("name"), F.col("shown").alias("n"),
                                                             F.round("avg_seconds", 6).alias("avg_seconds"), F.round("avg_tokens", 6).alias("avg_tokens"))
    return a.unionByName(b)


@query("agg22b_difference", """
with g as (select c_mktsegment e, year(o_orderdate) y, count(*)::double v from orders join customer on o_custkey = c_custkey group by all)
select 'difference' insight, 'BUILDING and MACHINERY' entity, abs(a.v - b.v) as value, 'count' unit from g a, g b where a.y = 1997 and b.y = 1997 and a.e = 'BUILDING' and b.e = 'MACHINERY'
union all select 'difference', 'BUILDING and FURNITURE', abs(a.v - b.v), 'percentage points' from g a, g b where a.y = 1996 and b.y = 1996 and a.e = 'BUILDING' and b.e = 'FURNITURE'""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("e"))
    g = t.orders.join(c, "o_custkey").groupBy("e", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("v"))
    some = A.difference_of(g, "e", "y", "v", 1997, "BUILDING", "MACHINERY", "count").unionByName(A.difference_of(g, "e", "y", "v", 1996, "BUILDING", "FURNITURE", "percent"))
    return some.unionByName(A.difference_of(g, "e", "y", "v", 1997, "BUILDING", "NOWHERE", "count"))


@query("agg22_insights", """
with g as (select c_mktsegment e, year(o_orderdate) y, count(*)::double v from orders join customer on o_custkey = c_custkey group by all),
w as (select e, sum(v) v from g group by 1)
select 'highest' insight, max_by(e, v) entity, max(v) as value, 'count' unit from w union all select 'lowest', min_by(e, v), min(v), 'count' from w
union all select 'change', a.e, b.v - a.v, 'count' from g a join g b on a.e = b.e and a.y = 1996 and b.y = 1998""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("e"))
    g = t.orders.join(c, "o_custkey").groupBy("e", F.year("o_orderdate").alias("y")).agg(F.count("*").cast("double").alias("v"))
    top = A.extremes(g.groupBy("e").agg(F.sum("v").alias("v")), "e", "v").withColumn("unit", F.lit("count"))
    return top.unionByName(A.change_between(g, "e", "y", "v", 1996, 1998, "count"))


@query("agg23_problem_groups", """
select 'in_list' as rule, 'p_type' as "column", lower(trim(p_type)) norm_value, count(*) n, min(p_partkey) first_row, max(p_partkey) last_row,
 min_by(p_type, p_partkey) first_value from part where p_type not in ('ECONOMY', 'SMALL') group by 3""")
def _(t):
    bad = t.part.filter(~F.col("p_type").isin("ECONOMY", "SMALL")).select(
        F.lit("in_list").alias("rule"), F.lit("p_type").alias("column"), F.lower(F.trim("p_type")).alias("norm_value"),
        F.col("p_partkey").alias("row_no"), F.col("p_type").alias("value"))
    return A.group_problems(bad)


@query("agg24_label_summary", """
with l as (select case when quality = 1 then 'good' else 'poor' end lab, 'doc ' || lpad(doc_id::varchar, 9, '0') nm from labels),
c as (select lab, count(*) n from l group by 1), m as (select max_by(lab, n) major from c),
e as (select lab, string_agg(nm, ', ' order by nm) ex from (select *, row_number() over (partition by lab order by nm) rn from l) where rn <= 5 group by 1)
select lab, n, case when lab <> major then ex else '' end examples from c join e using (lab), m""")
def _(t):
    l = t.labels.select(F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lab"),
                        F.concat(F.lit("doc "), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("nm"))
    return A.label_summary(l, "lab", "nm")


@query("agg25_form_domain", """
select 'p_brand' as "column", case when count(distinct p_brand) <= 60 then 'choice' else 'contains' end as filter, count(distinct p_brand) as "distinct", null low, null high, true groupable from part
union all select 'p_name', case when count(distinct p_name) <= 60 then 'choice' else 'contains' end, count(distinct p_name), null, null, true from part
union all select 'p_size', 'number', count(distinct p_size), min(p_size)::double::varchar, max(p_size)::double::varchar, count(distinct p_size) between 2 and 40 from part
union all select 'p_retailprice', 'number', count(distinct p_retailprice), min(p_retailprice)::double::varchar, max(p_retailprice)::double::varchar, count(distinct p_retailprice) between 2 and 40 and count(*) filter (where p_retailprice <> floor(p_retailprice)) = 0 from part""")
def _(t):
    return fm.form_domain(t.part, ["p_brand", "p_name"], ["p_size", "p_retailprice"], [])


@query("agg25b_filter_values", """
with v as (select 'p_brand' as "column", p_brand as value from part union all select 'p_type', p_type from part union all select 'p_name', p_name from part union all select 'p_size', p_size::varchar from part),
c as (select "column", value, count(*) n from v group by all), k as (select "column" from c group by 1 having count(*) <= 30 or "column" = 'p_name')
select "column", value, n, row_number() over (partition by "column" order by n desc, value) as place from c where "column" in (select "column" from k)""")
def _(t):
    return fm.filter_values(t.part, ["p_brand", "p_type", "p_name", "p_size"], ["p_name"], choices=30)


@query("agg26_top_groups", """select l_suppkey, round(avg(l_extendedprice), 4) avg_price from lineitem group by 1 order by avg(l_extendedprice) desc, 1 limit 10""")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("a")).orderBy(F.desc("a"), "l_suppkey").limit(10)
    return g.select("l_suppkey", F.round("a", 4).alias("avg_price"))


@query("agg27_score_rows", """
select o_orderkey, round(o_totalprice / 1000 + case when o_orderpriority = '1-URGENT' then 50 else 0 end + case when o_orderstatus = 'O' then 25 else 0 end, 4) score
from orders order by o_totalprice / 1000 + case when o_orderpriority = '1-URGENT' then 50 else 0 end + case when o_orderstatus = 'O' then 25 else 0 end desc, o_orderkey limit 100""")
def _(t):
    got = A.score_rows(t.orders, F.col("o_totalprice") / 1000, {"o_orderpriority = '1-URGENT'": 50, "o_orderstatus = 'O'": 25})
    return got.orderBy(F.desc("score"), "o_orderkey").limit(100).select("o_orderkey", F.round("score", 4).alias("score"))


@query("agg28_trend", """
select strftime(case when o_orderpriority <> '3-MEDIUM' then o_orderdate end, '%Y-%m') bucket, count(*) n, round(sum(o_totalprice), 2) total
from orders where o_orderstatus = 'F' group by 1""")
def _(t):
    text = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("not a date")
    d = t.orders.filter("o_orderstatus = 'F'").withColumn("bucket", dates.part(dates.parse_one(text, "dd/MM/yyyy"), "month"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("agg28b_trend_undated", """
with d as (select case when o_orderpriority <> '3-MEDIUM' then strftime(o_orderdate, '%Y-%m') end b, o_totalprice p from orders where o_orderstatus = 'F')
select b as bucket, count(*) n, round(sum(p), 2) total, (select count(*) from d where b is null) undated from d where b is not null group by 1""")
def _(t):
    text = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("not a date")
    return A.trend(t.orders.filter("o_orderstatus = 'F'"), dates.part(dates.parse_one(text, "dd/MM/yyyy"), "month"), {"total": F.round(F.sum("o_totalprice"), 2)})


@query("agg29_compare_groups", """select c_mktsegment, count(*) n, round(avg(c_acctbal), 4) avg_bal from customer where c_mktsegment in ('BUILDING', 'MACHINERY') group by 1""")
def _(t):
    return t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("avg_bal"))


@query("agg30_latest", """select user_id, max(event_id) event_id, max_by(event_type, event_id) event_type, max_by(value, event_id) as value from events group by 1""")
def _(t):
    return A.latest(t.events, ["user_id"], "event_id", ["event_type", "value"])


# ------------------------------------------------------------------ windows
@query("win1_best_row", """select user_id, event_type, event_id, value from events
qualify row_number() over (partition by user_id, event_type order by value desc, event_id) = 1""")
def _(t):
    return top_per_key(t.events, ["user_id", "event_type"], [F.desc("value"), F.col("event_id")], 1).select("user_id", "event_type", "event_id", "value")


@query("win2_rank_of", """select o_custkey, n, rank() over (order by n desc) as position from (select o_custkey, count(*) n from orders group by 1)""")
def _(t):
    return A.ranked(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "n", "o_custkey")


@query("win4_runs", """
with v as (select distinct l_suppkey k, (l_orderkey * 7 + l_linenumber) n from lineitem), g as (select k, n, n - row_number() over (partition by k order by n) i from v)
select k as l_suppkey, min(n) as first, max(n) as last from g group by k, i""")
def _(t):
    d = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("n"))
    return A.runs(d, ["l_suppkey"], "n")


@query("win8_budget", """
with r as (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) used from documents)
select source, doc_id, n_chars, used::bigint used from r where used <= 300000""")
def _(t):
    return A.take_budget(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], "n_chars", 300000)


@query("win10_asked_again", r"""
with u as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) w from conversations),
p as (select a.conv_id, a.turn, max(case when b.w is null then 0.0 else len(list_intersect(a.w, b.w))::double / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) end) o
 from u a left join u b on a.conv_id = b.conv_id and b.turn between a.turn - 3 and a.turn - 1 group by all)
select conv_id, turn, round(coalesce(o, 0.0), 6) overlap, coalesce(o, 0.0) >= 0.6 as again from p""")
def _(t):
    return A.asked_again(t.conversations, "conv_id", "turn", "text").withColumn("overlap", F.round("overlap", 6))


@query("win11_scope_change", """
with u as (select conv_id, turn, case when length(text) % 3 = 0 then ['a', 'b'] when length(text) % 3 = 1 then ['b', 'c'] else ['d'] end tb from conversations),
p as (select *, lag(tb) over (partition by conv_id order by turn) pv from u)
select conv_id, turn, pv is not null and not list_has_any(tb, pv) as changed from p""")
def _(t):
    m = F.length("text") % 3
    used = F.when(m == 0, F.array(F.lit("a"), F.lit("b"))).when(m == 1, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("d")))
    return A.scope_change(t.conversations.select("conv_id", "turn", used.alias("tables")), "conv_id", "turn", "tables").select("conv_id", "turn", "changed")


# ------------------------------------------------------------------ order and limits
@query("ord1_plan_sort_limit", """select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 25""")
def _(t):
    return st.run_plan(t.orders, [{"op": "filter", "column": "o_orderstatus", "cmp": "eq", "value": "F"},
                                  {"op": "sort", "column": "o_totalprice", "dir": "desc", "then": ["o_orderkey"]}, {"op": "limit", "n": 25}]
                       ).select("o_orderkey", "o_totalprice")


@query("ord2_default_order", """select o_orderpriority, round(sum(o_totalprice), 2) sum_o_totalprice from orders group by 1 order by sum(o_totalprice) desc limit 3""")
def _(t):
    got = fm.run_form(_orders(t), ORDER_FORM, fm.Spec(measures=["sum:o_totalprice"], group_by=["o_orderpriority"], limit=3), total=False)
    return got.select("o_orderpriority", F.round("sum_o_totalprice", 2).alias("sum_o_totalprice"))


@query("ord3_band_order", """
with b as (select case when p_size < 10 then 'Under 10' when p_size < 20 then '10 to 20' when p_size < 30 then '20 to 30' when p_size <= 40 then '30 to 40' else 'Over 40' end band from part)
select band, count(*) n, row_number() over (order by case band when 'Under 10' then 1 when '10 to 20' then 2 when '20 to 30' then 3 when '30 to 40' then 4 else 5 end) place from b group by 1""")
def _(t):
    s = F.col("p_size")
    band = F.when(s < 10, "Under 10").when(s < 20, "10 to 20").when(s < 30, "20 to 30").when(s <= 40, "30 to 40").otherwise("Over 40")
    g = t.part.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return numbered(g, [], [A.band_key(F.col("band"))], "place")


@query("ord5_display_cap", """select * from (select p_brand, count(*) n from part group by 1 order by n desc, p_brand limit 20), (select count(distinct p_brand) total from part)""")
def _(t):
    g = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    return A.cap(g, [F.desc("n"), F.col("p_brand")], 20).drop("shown")


@query("ord5b_shown_and_total", """select * from (select o_custkey, count(*) n from orders group by 1 order by n desc, o_custkey limit 60), (select count(distinct o_custkey) total, least(60, count(distinct o_custkey)) shown from orders)
union all select * from (select n_nationkey::bigint, 1 from nation where n_nationkey < 5 order by 1 limit 60), (select 5, 5)""")
def _(t):
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    few = t.nation.filter("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("o_custkey"), F.lit(1).cast("long").alias("n"))
    return A.cap(g, [F.desc("n"), F.col("o_custkey")], 60).unionByName(A.cap(few, [F.col("o_custkey")], 60))


# ------------------------------------------------------------------ set operations
@query("set2_event_strip", """
select strftime(o_orderdate, '%Y-%m-%d') as date, 'orders' lane, o_orderstatus outcome, o_orderkey::varchar detail from orders
union all select strftime(l_shipdate, '%Y-%m-%d'), 'shipments', l_linestatus, l_orderkey::varchar || '/' || l_linenumber::varchar from lineitem""")
def _(t):
    return A.event_strip({
        "orders": (t.orders, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")),
        "shipments": (t.lineitem, F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linestatus"),
                      F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")))})


@query("set4_ordered_distinct", """select conv_id, role, min(turn) turn from conversations group by all""")
def _(t):
    return A.ordered_distinct(t.conversations, ["conv_id"], "role", "turn")


@query("set5_word_overlap", r"""
with w as (select c.c_name, list_distinct(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda x: x <> '')) a,
 list_distinct(list_filter(regexp_split_to_array(lower(c_mktsegment || ' customer'), '[^a-z0-9]+'), lambda x: x <> '')) b from customer c)
select c_name, round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) overlap from w""")
def _(t):
    from gridloom.functions.text import word_overlap
    a, b = words(F.lower("c_name")), words(F.lower(F.concat("c_mktsegment", F.lit(" customer"))))
    return t.customer.select("c_name", F.round(word_overlap(a, b), 6).alias("overlap"))
