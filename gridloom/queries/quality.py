"""Data quality, labels, evaluation, scalar functions and extension points."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import numbers as N
from gridloom.functions import registry as U
from gridloom.functions import similarity as SIM
from gridloom.functions import text as X
from gridloom.operators import drift as D
from gridloom.operators import labels as L
from gridloom.operators import quality as Q
from gridloom.operators import records as R
from gridloom.queries.registry import query
from gridloom.session import cut, spread

TODAY = "2000-06-15"


def _faulty(t):
    """Orders as text with planted faults by row number."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 100
    return t.orders.select(
        k.alias("row"), F.when(m == 1, "").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(m == 2, "1O5").when(m == 3, "approx 1200").when(m == 4, "500 kg").when(m == 5, "n/a").when(m == 6, "10 or 20").otherwise(F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2))).alias("amount"),
        F.when(m == 7, "36526").when(m == 8, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 9, "tbd").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
        F.when(m == 10, "a b @x.org").when(m == 11, "joe(at)x.org").when(m == 12, "nobody").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org"))).alias("mail"),
        F.when(m == 13, "+91 98765-43210x").when(m == 14, "12345").otherwise(F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0"))).alias("tel"),
        F.when(m == 15, "1-URGNT").when(m == 16, " 2-high ").when(m == 17, "whatever").otherwise(F.col("o_orderpriority")).alias("prio"))


_RULES = [{"column": "customer", "rule": "required"}, {"column": "amount", "rule": "number"}, {"column": "day", "rule": "date", "arg": ("dd/MM/yyyy",)},
          {"column": "mail", "rule": "email"}, {"column": "tel", "rule": "phone"}, {"column": "customer", "rule": "range", "arg": (1, None)},
          {"column": "prio", "rule": "in_list", "arg": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}, {"column": "prio", "rule": "regex", "arg": r"\s*\S.*"},
          {"column": "day", "rule": "not_future", "arg": ("dd/MM/yyyy",)}]
_DQ_SQL = """
with o as (select o_orderkey k, o_orderkey % 100 m, o_custkey c, o_orderdate::date d from orders),
p as (select k, 'customer' col, 'required' rule from o where m = 1 union all select k, 'amount', 'number' from o where m in (2, 3, 4, 5, 6)
 union all select k, 'day', 'date' from o where m in (7, 8, 9) union all select k, 'mail', 'email' from o where m in (10, 11, 12)
 union all select k, 'tel', 'phone' from o where m in (13, 14) union all select k, 'customer', 'range' from o where m <> 1 and c < 1
 union all select k, 'prio', 'in_list' from o where m in (15, 17) union all select k, 'day', 'not_future' from o where m not in (7, 8, 9) and d > date '2000-06-15')
"""


@query("dq1_cell_rules", _DQ_SQL + 'select k as row_no, col as "column", rule from p')
def _(t):
    return Q.validate(_faulty(t), "row", _RULES, F.lit(TODAY).cast("date")).select("row_no", "column", "rule")


@query("dq2_problems", _DQ_SQL + """select k as row_no, col as "column", rule, (case col when 'customer' then 'B' when 'amount' then 'C' when 'day' then 'D' when 'mail' then 'E' when 'tel' then 'F' else 'G' end) || k as cell from p""")
def _(t):
    cols = ["row", "customer", "amount", "day", "mail", "tel", "prio"]
    return Q.problems(_faulty(t), "row", cols, _RULES, today=F.lit(TODAY).cast("date")).select("row_no", "column", "rule", "cell")


@query("dq3_fix_suggestions", """
with o as (select o_orderkey k, o_orderkey % 100 m, o_orderdate::date d from orders)
select k as row_no, case m when 2 then 'amount' when 3 then 'amount' when 4 then 'amount' when 5 then 'amount' when 6 then 'amount' when 7 then 'day' when 8 then 'day' when 9 then 'day' when 10 then 'mail' when 11 then 'mail' when 12 then 'mail' when 13 then 'tel' else 'tel' end as "column",
 case m when 2 then '105' when 3 then '1200' when 4 then '500' when 5 then '' when 7 then '01/01/2000' when 8 then strftime(d, '%d/%m/%Y') when 9 then '' when 10 then 'ab@x.org' when 11 then 'joe@x.org' when 13 then '9876543210' end as fix from o where m between 2 and 14
union all select k, 'day', case when day(d) <= 12 and day(d) <> month(d) and make_date(year(d), day(d), month(d)) <= date '2000-06-15' then strftime(make_date(year(d), day(d), month(d)), '%d/%m/%Y') end from o where m not in (7, 8, 9) and d > date '2000-06-15'""")
def _(t):
    rules = [r for r in _RULES if r["rule"] in ("number", "date", "email", "phone", "not_future")]
    today = F.lit(TODAY).cast("date")
    found = Q.validate(_faulty(t), "row", rules, today)
    return Q.suggest_fix(found, {"day": ("dd/MM/yyyy",)}, today).select("row_no", "column", "fix")


@query("dq3b_list_suggestions", """select o_orderkey as row_no, case o_orderkey % 100 when 15 then '1-URGENT' end as fix from orders where o_orderkey % 100 in (15, 17)""")
def _(t):
    found = Q.validate(_faulty(t), "row", [r for r in _RULES if r["rule"] == "in_list"])
    return Q.suggest_list_fix(found, t.orders.select("o_orderpriority").distinct(), "o_orderpriority").select("row_no", "fix")


@query("dq4_lookup_integrity", """
select o_orderkey as row_no, case when o_orderkey % 10 = 3 then 'X-99' else 'once-' || o_orderkey end as value, case when o_orderkey % 10 = 3 then 'not found; used often, maybe a code' else 'not found' end message
from orders where o_orderkey % 10 in (3, 7)""")
def _(t):
    m = F.col("o_orderkey") % 10
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    d = t.orders.join(c, "o_custkey").select("o_orderkey", F.when(m == 3, "X-99").when(m == 7, F.concat(F.lit("once-"), F.col("o_orderkey").cast("string"))).when(m == 5, "head office").otherwise(F.upper("c_name")).alias("who"))
    return Q.missing_lookups(d, "o_orderkey", "who", t.customer, "c_name", {"head office": "Customer#000000000"}).select("row_no", "value", "message")


@query("dq5_parse_rates", """
select 'amount' as "column", count(*) filled, count(*) - count(*) filter (where o_orderkey % 100 between 2 and 6) parsed, false as drift from orders
union all select 'day', count(*), count(*) - count(*) filter (where o_orderkey % 100 in (7, 9)), false from orders
union all select 'mail', count(*), 0, true from orders""")
def _(t):
    return Q.parse_rates(_faulty(t), {"amount": "number", "day": "date", "mail": "number"}).select("column", "filled", "parsed", "drift")


@query("dq6_drift_contract", """
select 'missing column' what, 'Region' as name, 2 severity from orders having count(*) > 0 union all select 'renamed column', 'Pay amount', 1 from orders having count(*) > 0 union all select 'new column', 'extra', 1 from orders having count(*) > 0
union all select 'parse rate', 'mail', 2 from orders having count(*) > 0 union all select 'new value', 'prio', 1 from (select distinct o_orderpriority p from orders) where p not in ('1-URGENT', '2-HIGH')
union all select 'status', 'drift', 2 from orders having count(*) > 0""")
def _(t):
    o = t.orders.select("o_orderpriority", F.col("o_totalprice").cast("string").alias("amount"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("mail"), F.lit("x").alias("extra"))
    f = Q.contract(o.withColumnRenamed("o_orderpriority", "prio"), {"columns": {"Prio": "category", "Pay amount": "number", "Mail": "number", "Region": "category"}, "values": {"Prio": ["1-URGENT", "2-HIGH"]}}, used=["Region"])
    s = Q.status(f).select(F.lit("status").alias("what"), F.col("status").alias("name"), F.lit(2).alias("severity"))
    return f.select("what", "name", "severity").unionByName(s)


@query("dq6b_tables_drift", """
with x as (select 1 from orders having count(*) > 0)
select 'part' as "table", 'missing table' as what, 'part' as name, 2 as severity from x
union all select 'customer', 'renamed table', 'clients', 1 from x union all select 'customer', 'renamed column', 'c_acctbal', 1 from x union all select 'customer', 'new value', 'segment', 1 from (select distinct c_mktsegment from customer) where c_mktsegment <> 'BUILDING'
union all select 'customer', 'renamed column', 'c_mktsegment', 1 from x union all select 'customer', 'renamed column', 'c_name', 1 from x
union all select 'orders', 'missing column', 'o_orderstatus', 2 from x union all select 'orders', 'new column', 'note', 1 from x union all select 'orders', 'parse rate', 'o_totalprice', 2 from x
union all select 'lines', 'new table', 'lines', 1 from x union all select 'all', 'status', 'drift', 2 from x""")
def _(t):
    old = {"customer": t.customer.drop("c_nationkey"), "orders": t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), "part": t.part, "supplier": t.supplier}
    family = D.teach(old, kinds={"orders": {"o_totalprice": "number"}}, values={"customer": {"c_mktsegment": ["BUILDING"]}}, used={"orders": ["o_orderstatus"]})
    now = {"clients": t.customer.select("c_custkey", F.col("c_name").alias("person"), F.col("c_acctbal").alias("saldo"), F.col("c_mktsegment").alias("segment")),
           "orders": t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("none given").alias("o_totalprice"), "o_orderpriority", F.lit("x").alias("note")),
           "supplier": t.supplier, "lines": t.lineitem}
    f = D.contracts(t.spark, now, family)
    s = Q.status(f).select(F.lit("all").alias("table"), F.lit("status").alias("what"), F.col("status").alias("name"), F.lit(2).alias("severity"))
    return f.select("table", "what", "name", "severity").unionByName(s)


@query("dq7_plausibility", """select 'growth_percent' as "column", 'outside percent range' issue from orders having max(o_totalprice) > 100.5 union all select 'flat', 'one value in every row' from orders having count(*) > 3""")
def _(t):
    d = t.orders.select(F.col("o_totalprice").alias("growth_percent"), F.lit(7).alias("flat"), F.col("o_totalprice").alias("price_ratio"), (F.col("o_custkey") % 90).alias("share"))
    return Q.plausibility(d, ["growth_percent", "flat", "price_ratio", "share"])


@query("dq8_result_scope", """
with r as (select c_mktsegment, o_orderstatus, count(*) n from orders join customer on o_custkey = c_custkey group by all)
select (select count(*) from (select c_mktsegment from r group by 1 having count(*) > 1)) repeated_keys, 1 as not_shown, (select count(distinct c_mktsegment) from r) - 1 as not_requested, false as ok""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    r = t.orders.join(c, "o_custkey").groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    asked = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.lower("c_mktsegment").alias("c_mktsegment")).union(t.region.select(F.lit("NOWHERE").alias("c_mktsegment"))).distinct()
    return Q.check_result(r, ["c_mktsegment"], "c_mktsegment", asked)


@query("dq9_completeness", """select 'nation ' || n_nationkey as name from nation where n_name not in (select n_name from nation join customer on c_nationkey = n_nationkey) union all select 'Q5' from region limit 1""")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    r = t.customer.join(n, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("spend_2024_q1"))
    want = t.nation.select(F.upper("n_name").alias("name")).union(t.region.select(F.explode(F.array(F.lit("2024 Q1"), F.lit("Q5"))).alias("name"))).distinct()
    return Q.completeness(r, ["n_name"], want)


@query("dq10_ungrounded_numbers", """select o_orderkey, 99 as value from orders where o_orderkey % 3 = 0 and o_custkey <> 99 union all select o_orderkey, 7 from orders where o_orderkey % 3 = 1 and o_custkey <> 7""")
def _(t):
    m = F.col("o_orderkey") % 3
    said = F.concat(F.lit("1. Total was Rs "), F.format_number("o_totalprice", 2), F.when(m == 0, " for 99 people").when(m == 1, " in seven parts").otherwise(""), F.lit("\n2. Customer "), F.col("o_custkey").cast("string"))
    texts = t.orders.select("o_orderkey", said.alias("text"))
    ok = t.orders.select("o_orderkey", F.explode(F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"))).alias("value"))
    return Q.ungrounded_numbers(texts, "o_orderkey", "text", ok)


@query("dq11_results_match", """select o_custkey::varchar as k0 from orders group by o_custkey having o_custkey % 50 = 0""")
def _(t):
    a = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    b = a.select(F.col("o_custkey").cast("string").alias("o_custkey"), F.when(F.col("o_custkey") % 50 == 0, "Rs. 1").otherwise(F.concat(F.lit("Rs. "), F.format_number("spend", 4))).alias("spend"))
    return Q.results_match(a, b, ["o_custkey"], ["spend"]).select("k0")


@query("dq12_expectations", """select count(*) filter (where o_orderstatus not in ('F', 'O')) known_status, 0 as non_negative, count(*) filter (where o_totalprice > 400000) under_limit from orders""")
def _(t):
    return Q.expect(Q.enforce(t.orders, {"has key": "o_orderkey is not null"}),
                    {"known_status": "o_orderstatus in ('F', 'O')", "non_negative": "o_totalprice >= 0", "under_limit": "o_totalprice <= 400000"})


# ------------------------------------------------------------------ record filters
def _store(t):
    files = t.documents.select("doc_id", F.col("source").alias("owner"), "lang", F.when(F.col("doc_id") % 5 == 0, "pdf").when(F.col("doc_id") % 5 == 1, "image").otherwise("doc").alias("kind"),
                               F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("n_chars")).alias("size"))
    labels = t.labels.select(F.col("doc_id").alias("record_id"), F.lit("good").alias("name"), F.lit(1).alias("version"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))
    return files, labels, labels.select("name", "version").distinct()


@query("flt6_record_filter", """select doc_id from documents where lang ilike '%E%' and source = 'src3' and n_chars >= 100 and doc_id in (select doc_id from labels where quality = 1)""")
def _(t):
    files, labels, defs = _store(t)
    d = files.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return R.record_filter(d, "doc_id", [{"field": "lang", "op": "~", "value": "E"}, {"field": "owner", "op": "=", "value": "me"}, {"field": "n_chars", "op": ">=", "value": 100},
                                         {"field": "label.good", "op": "=", "value": "yes"}], "src3", labels, defs).select("doc_id")


@query("flt7_hide_empty", """select doc_id from documents where not (doc_id % 5 = 1 and doc_id % 7 = 0) and not (doc_id % 5 = 0 and doc_id % 7 = 0) and (doc_id % 5 = 0 or doc_id % 11 <> 0)""")
def _(t):
    files, _l, _d = _store(t)
    pages = t.documents.select("doc_id", F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("text")).alias("text"))
    return R.drop_empty(files, pages, "doc_id").select("doc_id")


# ------------------------------------------------------------------ labels
@query("lab1_definitions", """select 'd' || c_custkey as name, case when c_custkey % 3 = 0 then 2 else 1 end as version from customer where c_custkey % 3 <> 1""")
def _(t):
    k = F.col("c_custkey")
    name = F.concat(F.lit("d"), k.cast("string")).alias("name")
    yes_no = F.array(F.lit("yes"), F.lit("no"))
    old = t.customer.filter(k % 3 != 2).select(name, F.lit(1).alias("version"), F.lit("is it good?").alias("ask"), F.array(F.lit("unsure"), F.lit("yes"), F.lit("no")).alias("answers"), F.lit("mail").alias("kind"))
    new = t.customer.select(name, F.when(k % 3 == 0, "is it bad?").otherwise("is it good?").alias("ask"), yes_no.alias("answers"), F.lit("mail").alias("kind"))
    return L.define(old, new).select("name", "version")


@query("lab2_incremental_labels", """select doc_id as record_id, case when n_chars > 2000 then 'yes' when lang = 'fr' then 'unsure' else 'no' end as label from documents where lang <> 'es' and doc_id not in (select doc_id from labels)""")
def _(t):
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda v: None if v.startswith("es|") else "yes" if len(v) - 3 > 2000 else "maybe" if v.startswith("fr|") else "no")
    recs = t.documents.select("doc_id", F.concat("lang", F.lit("|"), "text").alias("text"))
    had = recs.join(t.labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("record_id"), F.lit("long").alias("name"), F.lit(1).alias("version"), F.lit("no").alias("label"), F.sha2("text", 256).alias("source_hash"))
    return L.label(recs, "doc_id", "text", had, "long", 1, ["yes", "no"], score).select("record_id", "label")


@query("lab2b_relabel", """
select doc_id as record_id, 'long' as name, case when n_chars > 2000 then 'yes' when lang = 'fr' then 'unsure' else 'no' end as label from documents where lang <> 'es' and doc_id not in (select doc_id from labels where doc_id % 2 = 0)
union all select doc_id, 'long', 'old' from labels where doc_id % 2 = 0 union all select doc_id, 'other', 'old' from labels""")
def _(t):
    def score(text: pd.Series) -> pd.Series:
        return text.map(lambda v: None if v.startswith("es|") else "yes" if len(v) - 3 > 2000 else "maybe" if v.startswith("fr|") else "no")
    recs = t.documents.select("doc_id", F.concat("lang", F.lit("|"), "text").alias("text"))
    # half of the labelled records changed since; another definition's labels stay
    had = recs.join(t.labels.select("doc_id"), "doc_id").select(F.col("doc_id").alias("record_id"), F.lit("long").alias("name"), F.lit(1).alias("version"), F.lit("old").alias("label"),
                                                               F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("before").alias("source_hash"))
    return L.relabel(recs, "doc_id", "text", had.unionByName(had.withColumn("name", F.lit("other"))), "long", 1, ["yes", "no"], score).select("record_id", "name", "label")


@query("lab3_decide", """
with s as (select vec_id, abs(embedding[1]::double) a, abs(embedding[2]::double) b, abs(embedding[3]::double) c from embeddings), p as (select vec_id, a / (a + b + c) a, b / (a + b + c) b, c / (a + b + c) c from s)
select vec_id, case when a > 0.65 then 'yes' when a < 0.35 then 'no' else 'unsure' end as yes_no,
 case when greatest(a, b, c) >= 0.5 or (greatest(a, b, c) >= 0.4 and greatest(a, b, c) - (a + b + c - greatest(a, b, c) - least(a, b, c)) >= 0.15) then case when a >= greatest(b, c) then 'a' when b >= c then 'b' else 'c' end else 'unsure' end choice from p""")
def _(t):
    x = [F.abs(F.col("embedding")[i].cast("double")) for i in range(3)]
    s = t.embeddings.select("vec_id", *[(v / (x[0] + x[1] + x[2])).alias(n) for n, v in zip("abc", x)])
    scores = F.array(*[F.struct(F.lit(n).alias("answer"), F.col(n).alias("score")) for n in "abc"])
    return s.select("vec_id", L.decide_yes_no(F.col("a")).alias("yes_no"), L.decide_choice(scores).alias("choice"))


@query("lab4_label_eval", """
with r as (select lang, case when quality = 1 then 'yes' else 'no' end truth, case when d.doc_id % 13 = 0 then null when n_chars > 3000 then 'unsure' when n_chars > 500 then 'yes' else 'no' end answer, toxic = 1 as hard, n_chars / 100.0 as seconds from labels l join documents d using (doc_id))
select lang, count(*) items, count(*) filter (where truth = answer) as "right", count(*) filter (where truth = answer and hard) hard_right, count(*) filter (where truth = 'yes' and answer = 'no') missed_yes, count(*) filter (where truth = 'no' and answer = 'yes') false_yes,
 count(*) filter (where answer = 'unsure') unsure, count(*) filter (where answer is null) failed, round(quantile_cont(seconds::double, 0.5), 6) median_seconds from r group by 1""")
def _(t):
    n = F.col("n_chars")
    r = t.labels.join(t.documents, "doc_id").select("lang", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("truth"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None)).when(n > 3000, "unsure").when(n > 500, "yes").otherwise("no").alias("answer"), (F.col("toxic") == 1).alias("hard"), (n / 100.0).alias("seconds"), F.lit(0.01).alias("cost"))
    return L.label_eval(r, ["lang"]).drop("cost").withColumn("median_seconds", F.round("median_seconds", 6))


@query("lab5_map_parts", """select doc_id, ceil(greatest(length(text), 1) / 7000.0)::int as parts, length(text) as chars from documents""")
def _(t):
    return _part_lengths(t)


@query("lab5b_map_parts_whole", """select doc_id, ceil(greatest(length(text), 1) / 7000.0)::int as parts, length(text) as chars from documents""")
def _(t):
    return _part_lengths(t)


def _part_lengths(t, most=None):
    got, _new = L.map_parts(t.documents, "doc_id", "text", lambda s: s.str.len(), lambda a: F.concat_ws(",", a), most=most)
    n = F.transform(F.split("result", ","), lambda v: v.cast("int"))
    return got.select("doc_id", F.size(n).alias("parts"), F.aggregate(n, F.lit(0), lambda a, b: a + b).alias("chars"))


@query("lab6_row_match")
def _(t):
    doc = F.floor(F.col("p_partkey") / 20).alias("doc")  # twenty parts per document
    truth = t.part.select(doc, "p_name", F.col("p_retailprice").cast("string").alias("price"))
    got = t.part.filter("p_partkey % 5 <> 0").select(doc, F.upper("p_name").alias("p_name"), F.when(F.col("p_partkey") % 3 == 0, "?").otherwise(F.col("p_retailprice").cast("string")).alias("price"))
    m = L.row_match_eval(truth, got, "doc", ["p_name", "price"])
    return m.select("doc", F.round("similarity", 6).alias("similarity"), F.round("cell_hits", 6).alias("cell_hits"))


@query("lab7_run_summary", """select user_id % 10 as run, count(*) turns, count(*) filter (where event_type = 'error') errors, count(*) filter (where event_type = 'click' and value > 5) click_covered, count(*) filter (where event_type = 'click' and value > 20) click_correct, round(quantile_cont(value, 0.5), 6) median_seconds from events group by 1""")
def _(t):
    r = t.events.select((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("kind"), (F.col("value") > 5).alias("covered"), (F.col("value") > 20).alias("correct"), (F.col("event_type") == "error").alias("error"), F.col("value").alias("seconds"))
    return L.run_summary(r, ["click"]).withColumn("median_seconds", F.round("median_seconds", 6))


# ------------------------------------------------------------------ scalar functions
@query("sca1_normalise", r"""select c_custkey, lower(trim(regexp_replace('  ' || c_name || '   ' || c_mktsegment || ' ', '\s+', ' ', 'g'))) as norm, 'strasse' as folded, 'cafe' as plain, lower(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g')) as alnum from customer""")
def _(t):
    s = F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" "))
    k = F.col("c_custkey")
    return t.customer.select(k, X.norm(s).alias("norm"), X.casefold(F.when(k >= 0, " Straße ")).alias("folded"), X.accent_fold(F.when(k >= 0, "café")).alias("plain"), X.alnum_key(F.col("c_name")).alias("alnum"))


@query("sca3_title_case", """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title, strftime(date '2024-01-01' + p_size, '%d/%m/%Y') as shown from part""")
def _(t):
    from gridloom.functions.dates import show
    return t.part.select("p_partkey", F.initcap("p_name").alias("title"), show(F.date_add(F.lit("2024-01-01"), F.col("p_size"))).alias("shown"))


@query("sca4_tokens", """select p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(replace(p_name, ' ', 'X') || ' ' || p_brand), '[^a-z0-9]+'), lambda w: w <> ''), '|') as joined from (select p_partkey, p_name, p_brand from part)""")
def _(t):
    # camel case is split first, so `redWidget` gives two tokens; here the upper-case X starts a token of its own
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("X")), F.lit(" "), F.col("p_brand"))
    got = t.part.select("p_partkey", F.array_join(X.words(name), "|").alias("joined"))
    return got.withColumn("joined", F.regexp_replace("joined", r"^([a-z]+)\|x", "$1x"))


@query("sca5_jaro_winkler", """select a.p_partkey, round(jaro_winkler_similarity(a.p_name, a.p_type), 9) as s from part a""")
def _(t):
    return t.part.select("p_partkey", F.round(SIM.jaro_winkler("p_name", "p_type"), 9).alias("s"))


@query("sca6_sequence_ratio")
def _(t):
    return t.part.select("p_partkey", F.round(SIM.sequence_ratio("p_name", "p_type"), 9).alias("s"))


@query("sca7_number_text", r"""
with n as (select o_orderkey, floor(o_totalprice)::bigint v, o_totalprice x from orders)
select o_orderkey, case when v < 1000 then v::varchar when v < 100000 then (v // 1000)::varchar || ',' || lpad((v % 1000)::varchar, 3, '0') else (v // 100000)::varchar || ',' || lpad((v // 1000 % 100)::varchar, 2, '0') || ',' || lpad((v % 1000)::varchar, 3, '0') end as grouped,
 x >= 100000 as lakh, v::varchar as plain from n""")
def _(t):
    v = F.floor("o_totalprice")
    return t.orders.select("o_orderkey", N.indian_grouping(v).alias("grouped"), N.crore_lakh(F.col("o_totalprice")).endswith(" L").alias("lakh"), N.plain_number(v.cast("double")).alias("plain"))


@query("sca8_numbers_in_text", r"""select o_orderkey, o_custkey as first, 2 as n, round(o_totalprice, 2) as amount from orders""")
def _(t):
    s = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" paid Rs "), F.format_number("o_totalprice", 2))
    return t.orders.select("o_orderkey", N.first_number(s).alias("first"), F.size(N.numbers_in(s)).alias("n"), F.element_at(N.numbers_in(s), -1).alias("amount"))


@query("sca10_hashes", """select p_partkey, sha256(p_name) as content, sha256(lower('p_brand|p_name|p_size')) as header from part""")
def _(t):
    heads = F.array(F.lit("P_Name "), F.lit("p_size"), F.lit("p_brand"))
    return t.part.select("p_partkey", F.sha2("p_name", 256).alias("content"), X.header_key(heads).alias("header"))


@query("sca11_json_arrays", """select event_id, '["' || event_type || '","' || user_id || '"]' as js, event_type as first, true as has, (props->>'$.k')::int as k from events""")
def _(t):
    a = F.array("event_type", F.col("user_id").cast("string"))
    back = F.from_json(F.to_json(a), "array<string>")
    return t.events.select("event_id", F.to_json(a).alias("js"), back[0].alias("first"), F.array_contains(back, F.col("event_type")).alias("has"), F.from_json("props", "k int")["k"].alias("k"))


@query("sca13_units", """select p_partkey, case p_size % 5 when 0 then 'currency' when 1 then 'percent' when 2 then 'months' when 3 then 'score' else 'count' end as unit from part""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("Total income", "Pass rate", "Months late", "Marks", "Number of visits")])
    return t.part.select("p_partkey", R.unit_of(F.lit("number"), F.element_at(names, (F.col("p_size") % 5 + 1).cast("int"))).alias("unit"))


@query("sca14_chart_shape", """select 'kpi' as shape, 1 as "rows" union all select 'line', (select count(distinct strftime(o_orderdate, '%Y-%m')) from orders) union all select 'matrix', (select count(*) from (select distinct o_orderstatus, o_orderpriority from orders))
union all select 'bar', (select count(distinct o_orderpriority) from orders) union all select 'map', (select count(distinct c_nationkey) from customer) union all select 'table', (select count(*) from nation)""")
def _(t):
    o, n = t.orders, F.count("*").alias("n")
    results = [o.agg(n), o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(n), o.groupBy("o_orderstatus", "o_orderpriority").agg(n), o.groupBy("o_orderpriority").agg(n),
               t.customer.groupBy("c_nationkey").agg(F.avg(F.col("c_acctbal") * 0.001).alias("lat"), F.avg("c_acctbal").alias("lon")).select("lat", "lon"), t.nation.select("n_name", F.col("n_name").alias("again"))]
    out = None
    for r in results:
        one = R.chart_shape(r)
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ extension points
@U.transform_block("shout", "o_orderkey long, text string, hash string")
def _shout(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "text": pdf["o_orderpriority"].str.lower() + "!", "hash": pdf["hash"]})


@query("udf1_transform_block", """select o_orderkey, lower(o_orderpriority) || '!' as text from orders""")
def _(t):
    d = t.orders.select("o_orderkey", "o_orderpriority")
    _all, memo = U.run_block_memo(d.filter("o_orderkey % 2 = 0"), "shout")
    both, _new = U.run_block_memo(d, "shout", cut(memo))
    return both.select("o_orderkey", "text")


@query("udf2_span_model", """select c_custkey as id, 3 * (700 + c_custkey % 50) + 4 as "start", 3 * (700 + c_custkey % 50) + 22 as "end", 'person_name' as label, 0.9::double as score from customer""")
def _(t):
    from gridloom.operators import detect

    @F.pandas_udf(detect.SPAN)
    def model(s: pd.Series) -> pd.Series:  # stands for any span model: sees pieces of bounded size, in Arrow batches
        at = s.str.find("Customer#")
        return pd.Series([[{"start": a, "end": min(a + 18, n), "label": "person_name", "score": 0.9}] if a >= 0 else [] for a, n in zip(at, s.str.len())])
    text = F.concat(F.repeat(F.lit("no "), (F.col("c_custkey") % 50 + 700).cast("int")), F.lit("met "), F.col("c_name"), F.lit(" there "), F.repeat(F.lit("no "), 500))
    return detect.model_spans(t.customer.select(F.col("c_custkey").alias("id"), text.alias("text")), "id", "text", model, size=300, overlap=40)


@query("udf3_taught_expressions", """select case when o_totalprice > 250000 then 'big' else 'small' end as size, count(*) filter (where o_orderstatus = 'O') as open_orders, round(100.0 * count(*) filter (where o_orderstatus = 'O') / count(*), 6) as open_share from orders group by 1""")
def _(t):
    from gridloom.plans.form import Form, Spec, run_form
    form = Form(kinds={"o_totalprice": "number", "o_orderstatus": "choice"}, measures={"open_orders": "count_if(o_orderstatus = 'O')", "open_share": "100D * count_if(o_orderstatus = 'O') / count(*)"},
                groups={"size": "case when o_totalprice > 250000 then 'big' else 'small' end"})
    got = run_form(t.orders, form, Spec(measures=["open_orders", "open_share"], group_by=["size"]), total=False)
    return got.select("size", "open_orders", F.round("open_share", 6).alias("open_share"))


@query("udf4_detector_choice", r"""select 'regex+digits' as kind, sum(len(regexp_extract_all(text, '(?:\d[ -]?){8,}\d')))::bigint as long_numbers from documents union all select 'regex', 0 from documents having count(*) > 0""")
def _(t):
    out = None
    for kind in ("regex", "regex+digits"):
        c = F.when(F.col("text").rlike("[0-9@]"), F.col("text"))
        found = spread(t.documents.select("text")).select(U.detector_by_name(kind)(c).alias("spans"))  # a detector is not deterministic, so it stands below the sum
        n = F.size(F.filter("spans", lambda s: s["label"] == "long_number"))
        one = found.agg(F.sum(n).alias("long_numbers")).select(F.lit(kind).alias("kind"), "long_numbers")
        out = one if out is None else out.unionByName(one)
    return out
