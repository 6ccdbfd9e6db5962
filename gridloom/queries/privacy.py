"""Private values: detection, policy, vault, coding, restoring, leak checks, look-alike data."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.checks import valid_point, verhoeff_ok
from gridloom.functions.text import norm
from gridloom.operators import detect as D
from gridloom.operators import grid as G
from gridloom.operators import mock as K
from gridloom.operators import policy as P
from gridloom.operators import vault as V
from gridloom.queries.registry import query
from gridloom.session import cut, spread

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query("prv1_detect", rf"""
with e as (select doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) v, 'email' as label from documents
 union all select doc_id, unnest(regexp_extract_all(text, '\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}})\b')), 'dob' from documents
 union all select doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{{3}}\d{{7}}\b')), 'voter_id' from documents
 union all select doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{{2}}[ -]?\d{{1,2}}[ -]?[A-Z]{{1,3}}[ -]?\d{{4}}\b')), 'vehicle_number' from documents)
select doc_id, label, v as value, count(*) n from e group by all""")
def _(t):
    d = D.detect(spread(t.documents.select("doc_id", "text")), "text", "regex", classes=("email", "dob", "voter_id", "vehicle_number"))
    return D.exploded(d, ["doc_id"], "text").groupBy("doc_id", "label", "value").agg(F.count("*").alias("n"))


@query("prv1b_detect_all_classes")
def _(t):
    d = D.detect(spread(t.documents.select("doc_id", "text")), "text", "regex+digits")
    return D.exploded(d, ["doc_id"], "text")


@query("prv2_verhoeff", """
with dm as (select ['0123456789','1234067895','2340178956','3401289567','4012395678','5987604321','6598710432','7659821043','8765932104','9876543210'] d,
 ['0123456789','1576283094','5803796142','8916043527','9453126870','4286573901','2793806415','7046913258'] p),
x as (select o_orderkey, reverse((o_orderkey * 7919 + 200000000000)::bigint::varchar) s from orders),
f as (select o_orderkey, list_reduce(list_transform(range(length(s)::bigint), lambda i: substr(p[(i % 8) + 1], substr(s, (i + 1)::bigint, 1)::int + 1, 1)::bigint), lambda a, b: substr(d[a + 1], b + 1, 1)::bigint, 0::bigint) c from x, dm)
select o_orderkey, c = 0 as ok, true as point_ok from f""")
def _(t):
    n = (F.col("o_orderkey") * 7919 + F.lit(200000000000)).cast("string")
    return t.orders.select("o_orderkey", verhoeff_ok(n).alias("ok"), valid_point(F.col("o_orderkey") % 90, F.col("o_orderkey") % 180).alias("point_ok"))


@query("prv3_long_numbers", r"""
select doc_id, v as value, count(*) n from (select doc_id, unnest(regexp_extract_all(text, '(?:\d[ -]?){8,}\d')) v from documents) group by all""")
def _(t):
    d = D.exploded(D.detect(spread(t.documents.select("doc_id", "text")), "text", "regex+digits", classes=()), ["doc_id"], "text")
    return d.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def _notes(t):
    """Customer notes in prose: the name, a birth date or a visit date, a phone, the name again in lower case."""
    k = F.col("c_custkey")
    phone = F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0"))
    day = F.date_format(F.date_add(F.lit("1980-01-01"), (k % 9000).cast("int")), "dd/MM/yyyy")
    name = F.concat(F.lit("Asha "), F.initcap("c_mktsegment"), F.translate((k % 1000).cast("string"), "0123456789", "abcdefghij"))
    born = F.when(k % 2 == 0, F.concat(F.lit("born on "), day)).otherwise(F.concat(F.lit("we went there on "), day))
    text = F.concat(F.lit("Beneficiary: "), name, F.lit("; "), born, F.lit(". Call M. Rao at "), phone, F.lit(" please, said "), F.lower(name), F.lit("."))
    return spread(t.customer).select(k.alias("id"), text.alias("text"), name.alias("name"), phone.alias("phone"), F.when(k % 2 == 0, day).alias("dob"))


_NOTES_SQL = """
with n as (select c_custkey id, 'Asha ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || translate((c_custkey % 1000)::varchar, '0123456789', 'abcdefghij') nm,
 '98' || lpad(c_custkey::varchar, 8, '0') ph, strftime(date '1980-01-01' + (c_custkey % 9000)::int, '%d/%m/%Y') d from customer)
"""


@query("prv4_dob_rule", _NOTES_SQL + "select id, d as value from n where id % 2 = 0")
def _(t):
    d = D.detect(_notes(t), "text", "text")
    return D.exploded(d, ["id"], "text").filter("label = 'dob'").select("id", "value")


@query("prv5_structure_rules", _NOTES_SQL + "select id, v as value, count(*) n from (select id, unnest([nm, 'M. Rao']) v from n) group by all")
def _(t):
    d = D.detect(_notes(t), "text", "text", headings={"Beneficiary": "person_name"})
    return D.exploded(d, ["id"], "text").filter("label = 'person_name' and score <> 0.9").groupBy("id", "value").agg(F.count("*").alias("n"))


@query("prv6_propagation", _NOTES_SQL + "select id, v as value from (select id, unnest([nm, lower(nm), 'M. Rao']) v from n)")
def _(t):
    d = D.detect(_notes(t), "text", "text", headings={"Beneficiary": "person_name"})
    return D.exploded(d, ["id"], "text").filter("label = 'person_name' and score = 0.9").select("id", "value")


@query("prv7_resolve_overlaps", _NOTES_SQL + "select id, count(*) spans, sum(length(v))::bigint as chars from (select id, unnest(case when id % 2 = 0 then [nm, lower(nm), 'M. Rao', ph, d] else [nm, lower(nm), 'M. Rao', ph] end) v from n) group by 1")
def _(t):
    d = D.detect(_notes(t), "text", "text", headings={"Beneficiary": "person_name"}, clean=True)
    return D.exploded(d, ["id"], "text").groupBy("id").agg(F.count("*").alias("spans"), F.sum(F.length("value")).alias("chars"))


@query("prv8_scan_lines")
def _(t):
    return D.scan_lines(spread(t.documents.select("doc_id", "text")), "doc_id", "text")


def _people(t):
    """Customers as an applicant sheet with private columns."""
    k = F.col("c_custkey")
    return _notes(t).join(t.customer.select(k.alias("id"), F.col("c_acctbal").cast("string").alias("amount"), F.col("c_mktsegment").alias("segment")), "id").select(
        F.concat(F.lit("CH-"), F.col("id").cast("string")).alias("record"), F.col("name").alias("applicant_name"), "phone",
        F.concat(F.lit("p"), F.col("id").cast("string"), F.lit("@mail.org")).alias("email"),
        F.date_format(F.date_add(F.lit("1980-01-01"), (F.col("id") % 9000).cast("int")), "dd/MM/yyyy").alias("dob"),
        F.concat(F.lit("00"), F.lpad((F.col("id") * 7919).cast("string"), 12, "0")).alias("col_17"),
        F.element_at(F.array(*[F.lit(x) for x in ("SC", "ST", "OBC", "General")]), (F.col("id") % 4 + 1).cast("int")).alias("category"),
        (F.col("id") % 60 + 18).cast("string").alias("age"), "amount", "segment", F.col("text").alias("remarks"), F.lit("").alias("unused"), "id")


@query("prv9_classify_columns", """
select * from (values ('record', 'record_id_non_pii', 'code-like-id'), ('phone', 'phone', 'validator'), ('email', 'email', 'validator'), ('dob', 'dob', 'validator'),
 ('col_17', 'bank_account', 'long-unique-number'), ('category', 'caste_category', 'sensitive-vocabulary'), ('age', 'age', 'numeric'), ('amount', 'none', 'numeric'),
 ('segment', 'none', 'categorical'), ('remarks', 'free_text_with_pii', 'free-text'), ('unused', 'none', 'empty')) v("column", class, rule) where (select count(*) from customer) > 0""")
def _(t):
    cols = ["record", "phone", "email", "dob", "col_17", "category", "age", "amount", "segment", "remarks", "unused"]
    return P.classify_columns(_people(t), cols).select("column", "class", "rule")


@query("prv10_mask_suggestions", """
select * from (values ('record', false), ('applicant_name', true), ('phone', true), ('dob', true), ('category', true), ('age', false), ('amount', false), ('remarks', true)) v("column", mask) where (select count(*) from customer) > 0""")
def _(t):
    return P.suggest_masks(_people(t), ["record", "applicant_name", "phone", "dob", "category", "age", "amount", "remarks"]).select("column", "mask")


@query("prv10b_heading_class", """
with h as (select c_custkey, (['Farmer Name', 'Village', 'Phone No', 'Species name', 'District Block', 'Marks', 'Species recorder name', 'lat'])[c_custkey % 8 + 1] h from customer)
select c_custkey, h as heading, case h when 'Village' then 'contextual' when 'Species name' then 'contextual' when 'District Block' then 'contextual' else 'personal' end as class from h""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("Farmer Name", "Village", "Phone No", "Species name", "District Block", "Marks", "Species recorder name", "lat")])
    d = t.customer.select("c_custkey", F.element_at(names, (F.col("c_custkey") % 8 + 1).cast("int")).alias("heading"))
    return d.withColumn("class", P.heading_class(F.col("heading")))


def _name_vault(t):
    """Customer names as person names, suppliers as places, part brands left out."""
    a = V.cells(t.customer, "c_custkey", {"c_name": "person_name"}, "customer")
    return V.build_vault(a.unionByName(V.cells(t.supplier, "s_suppkey", {"s_name": "village"}, "supplier")))


_VAULT_SQL = """
with v as (select lower(c_name) norm, c_name as value, 'NAME' prefix, row_number() over (order by c_custkey) n from customer
 union all select lower(s_name), s_name, 'PLACE', row_number() over (order by s_suppkey) from supplier), w as (select *, prefix || '_' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') code from v)
"""


@query("prv11_build_vault", _VAULT_SQL + "select norm, value, prefix, code from w")
def _(t):
    return _name_vault(t).select("norm", "value", "prefix", "code")


@query("prv11b_extend_vault", """
with o as (select c_custkey % 2 = 0 as old, c_custkey, lower(c_name) norm, row_number() over (partition by c_custkey % 2 = 0 order by c_custkey) n from customer), k as (select count(*) k from o where old)
select norm, 'NAME_' || lpad((case when old then n else k + n end)::varchar, greatest(3, length((case when old then n else k + n end)::varchar))::int, '0') code from o, k""")
def _(t):
    old = cut(V.build_vault(V.cells(t.customer.filter("c_custkey % 2 = 0"), "c_custkey", {"c_name": "person_name"}, "a")))
    both = V.cells(t.customer, "c_custkey", {"c_name": "person_name"}, "b").withColumn("value", F.upper("value"))
    return old.unionByName(V.build_vault(both, old)).select("norm", "code")


def _mentions(t):
    """One text per order that names its customer, with punctuation around, and one near miss inside an address."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    o = t.orders.join(c, "o_custkey")
    text = F.concat(F.lit("Order for ("), F.upper("c_name"), F.lit("), status "), F.col("o_orderstatus"), F.lit("; write to "), F.col("c_name"), F.lit("@mail.org. Thanks, "), F.col("c_name"), F.lit("."))
    return o.select("o_orderkey", "o_custkey", "c_name", text.alias("text"))


_CODE_SQL = "'NAME_' || lpad((o_custkey + 1)::varchar, greatest(3, length((o_custkey + 1)::varchar))::int, '0')"


@query("prv12_redact", f"""select o_orderkey, 'Order for (' || {_CODE_SQL} || '), status ' || o_orderstatus || '; write to ' || c_name || '@mail.org. Thanks, ' || {_CODE_SQL} || '.' as redacted, 2 as changes
from orders join customer on o_custkey = c_custkey""")
def _(t):
    return V.redact(_mentions(t), "o_orderkey", "text", cut(_name_vault(t))).select("o_orderkey", "redacted", "changes")


@query("prv12b_shelter_documents", rf"""
select doc_id, len(regexp_extract_all(text, '{_EMAIL}')) + len(regexp_extract_all(regexp_replace(text, '{_EMAIL}', '', 'g'), '(?:\d[ -]?){{8,}}\d')) > 0 as changed from documents""")
def _(t):
    done, _vault = V.shelter(spread(t.documents.select("doc_id", "text")), "doc_id", "text")
    return done.select("doc_id", (F.col("changes") > 0).alias("changed"))


@query("prv13_pseudonymise", """
select 'NAME_' || lpad((c_custkey + 1)::varchar, greatest(3, length((c_custkey + 1)::varchar))::int, '0') as name, strftime(date '1980-01-01' + (c_custkey % 9000)::int, '%Y') as born, round((c_custkey % 80) + 0.123456::double, 2) as lat, c_custkey as age,
 'seen ' || 'NAME_' || lpad((c_custkey + 1)::varchar, greatest(3, length((c_custkey + 1)::varchar))::int, '0') || ' today' as note from customer""")
def _(t):
    k = F.col("c_custkey")
    d = t.customer.select(k.alias("id"), F.col("c_name").alias("name"), F.date_format(F.date_add(F.lit("1980-01-01"), (k % 9000).cast("int")), "dd/MM/yyyy").alias("born"),
                          (k % 80 + F.lit(0.123456)).cast("string").alias("lat"), k.alias("age"), F.concat(F.lit("seen "), F.lower("c_name"), F.lit(" today")).alias("note"))
    vault = cut(V.build_vault(V.cells(d, "id", {"name": "person_name"}, "people")))
    got = V.pseudonymise(d, "id", {"name": "person_name", "born": "dob", "lat": "gps", "age": "age", "note": "free_text_with_pii"}, vault)
    return got.select("name", "born", "lat", "age", "note")


@query("prv13b_mixed_columns", """
with c as (select c_custkey k, case when c_custkey % 3 = 0 then 'c' || c_custkey || '@mail.org' when c_custkey % 3 = 1 then '98' || lpad(c_custkey::varchar, 8, '0') else 'Ms ' || translate(c_custkey::varchar, '0123456789', 'abcdefghij') end as v from customer),
n as (select *, case k % 3 when 0 then 'EMAIL' when 1 then 'PHONE' else 'NAME' end p, row_number() over (partition by k % 3 order by k) n from c)
select k as id, p || '_' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as contact, k % 2 as plain from n""")
def _(t):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.org"))).when(k % 3 == 1, F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0"))).otherwise(
        F.concat(F.lit("Ms "), F.translate(k.cast("string"), "0123456789", "abcdefghij")))
    d = t.customer.select(k.alias("id"), v.alias("contact"), (k % 2).alias("plain"))
    classes = {"contact": ["person_name", "email", "phone"], "plain": "none"}
    return V.pseudonymise(d, "id", classes, cut(V.build_vault(V.cells(d, "id", V.direct_columns(classes), "people"))))


@query("prv14_sweep_kept", """select c_custkey, '98' || lpad(c_custkey::varchar, 8, '0') as value from customer where c_custkey % 3 = 0""")
def _(t):
    k = F.col("c_custkey")
    d = t.customer.select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("call 98"), F.lpad(k.cast("string"), 8, "0"))).otherwise(F.col("c_mktsegment")).alias("note"), F.col("c_mktsegment").alias("seg"))
    return D.sweep(d, ["c_custkey"], ["note", "seg"]).filter("label = 'phone'").select("c_custkey", "value")


@query("prv15_restore", "select o_orderkey, 'Order for (' || c_name || '), status ' || o_orderstatus || '; write to ' || c_name || '@mail.org. Thanks, ' || c_name || '. See NAME_999999999' as restored from orders join customer on o_custkey = c_custkey")
def _(t):
    vault = cut(_name_vault(t))
    out = V.redact(_mentions(t), "o_orderkey", "text", vault)
    sent = out.select("o_orderkey", F.concat(F.regexp_replace("redacted", r"(NAME)_(\d+)\)", r"$1\\_$2)"), F.lit(" See NAME_999999999")).alias("text"))
    return V.restore(sent, "o_orderkey", "text", vault).select("o_orderkey", "restored")


@query("prv16_partial_names", """
with v as (select distinct p_partkey, split_part(p_name, ' ', 2) w, p_name from part), c as (select w, count(distinct p_name) options from v group by 1)
select p_partkey as q, upper(w[1]) || w[2:] as word, options from v join c using (w) where length(w) >= 3""")
def _(t):
    vault = cut(V.build_vault(V.cells(t.part, "p_partkey", {"p_name": "person_name"}, "part")))
    q = t.part.select(F.col("p_partkey").alias("q"), F.concat(F.lit("how is "), F.initcap(F.split("p_name", " ")[1]), F.lit(" doing?")).alias("text"))
    return V.resolve_partials(q, vault).select("q", "word", "options")


@query("prv17_redact_near")
def _(t):
    vault = cut(V.build_vault(V.cells(t.part, "p_partkey", {"p_name": "village"}, "part")))
    typed = F.concat(F.lit("visit to "), F.substring("p_name", 1, 4), F.substring("p_name", 4, 60), F.lit(" tomorrow"))
    return V.redact_near(t.part.select("p_partkey", typed.alias("text")), "p_partkey", "text", vault).select("p_partkey", "text", "redacted", "changes")


@query("prv18_matched_in_text", r"""select o_orderkey, not (o_orderkey between 1900 and 2099) and length(o_orderkey::varchar) >= 4 as whole, true as price from orders where o_totalprice >= 100""")
def _(t):
    o = t.orders.filter("o_totalprice >= 100")
    return o.select("o_orderkey", P.matched_in_text(F.col("o_orderkey").cast("string")).alias("whole"), P.matched_in_text(F.col("o_totalprice").cast("string")).alias("price"))


_LINKS_SQL = """
with n as (select lower(p_name) norm, 'PLACE_' || lpad(row_number() over (order by min(p_partkey))::varchar, 3, '0') code from part group by 1),
m as (select p_retailprice price, row_number() over (order by min(p_partkey)) r from part group by 1), c as (select price, 'NUMBER_' || lpad(r::varchar, greatest(3, length(r::varchar))::int, '0') code from m),
x as (select p_partkey, case when p_name = 'hot gear' then replace(p_name, ' ', '_') else n.code end as a, case when p_name = 'hot gear' then upper(replace(p_name, ' ', '%20')) else n.code end as b, c.code as d,
 case when p_name = 'hot gear' then 0 else 2 end + 1 as k from part join n on norm = lower(p_name) join c on c.price = p_retailprice)
"""


@query("prv18b_links_and_numbers", _LINKS_SQL + """select p_partkey, 'see https://x.org/wiki/' || a || '?q=' || b || ' for ' || d || ', in 1998 3 of 12' as redacted, k as changes from x""")
def _(t):
    d = spread(t.part.select("p_partkey", "p_name", F.col("p_retailprice").cast("string").alias("price")))
    vault = cut(V.build_vault(V.cells(d, "p_partkey", {"p_name": "village", "price": "long_number"}, "part")))
    short = t.spark.createDataFrame([("1998", "1998", "long_number", "NUMBER", 900001, "NUMBER_900001"), ("12", "12", "long_number", "NUMBER", 900002, "NUMBER_900002")], vault.schema)
    text = F.concat(F.lit("see https://x.org/wiki/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("?q="), F.upper(F.replace("p_name", F.lit(" "), F.lit("%20"))), F.lit(" for "), F.col("price"), F.lit("0, in 1998 3 of 12"))
    return V.redact(d.select("p_partkey", text.alias("text")), "p_partkey", "text", vault.unionByName(short), never=["hot gear"]).select("p_partkey", "redacted", "changes")


@query("prv19_leak_check", f"""select o_orderkey, {_CODE_SQL} code, 1 as n from orders join customer on o_custkey = c_custkey where o_orderkey % 4 = 0""")
def _(t):
    vault = cut(_name_vault(t))
    done = V.redact(_mentions(t), "o_orderkey", "text", vault)
    sent = done.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("redacted"), F.lit("\\n"), F.lower("c_name"))).otherwise(F.col("redacted")).alias("text"))
    return V.leaks(sent, "o_orderkey", "text", vault)


@query("prv20_consistent", rf"""
with e as (select distinct lower(unnest(regexp_extract_all(text, '{_EMAIL}'))) v from documents) select count(*) as codes, 0 as left_over from e""")
def _(t):
    docs = spread(t.documents.select("doc_id", "text"))
    done, vault = V.shelter(docs, "doc_id", "text", kind="regex+digits")
    left = V.leaks(done, "doc_id", "redacted", vault).agg(F.count("*").cast("int").alias("left_over"))
    return vault.filter("prefix = 'EMAIL'").agg(F.count("*").alias("codes")).crossJoin(F.broadcast(left))  # one row


@query("prv21_code_index", _VAULT_SQL + "select code, case when prefix = 'NAME' then 'customer.csv' else 'supplier.csv' end file, case when prefix = 'NAME' then 'c_name' else 'village' end as \"column\", case when prefix = 'NAME' then 'personal' else 'contextual' end as class from w")
def _(t):
    c = t.customer.select("c_name", F.lower("c_name").alias("column_7"))
    return V.code_index({"customer.csv": (c, ["c_name", "column_7"]), "supplier.csv": (t.supplier.withColumnRenamed("s_name", "village"), ["village"])}, cut(_name_vault(t)))


@query("prv22_reveals", _VAULT_SQL + """,
r as (select 'ws' || (o_custkey % 50) workspace, o_orderkey, case when o_orderkey % 2 = 0 then 'PLACE_' || lpad((o_custkey % 50 + 1)::varchar, 3, '0') else 'NAME_' || lpad((o_custkey % 50 + 1)::varchar, 3, '0') end code from orders),
p as (select r.*, w.prefix from r left join w using (code)), g as (select *, case when prefix = 'PLACE' then row_number() over (partition by workspace, prefix order by o_orderkey) end nth from p)
select workspace, o_orderkey, case when prefix is null then 'unknown code' when prefix = 'NAME' then 'personal' when nth <= 3 then 'granted' else 'over limit' end decision from g""")
def _(t):
    lineage = cut(V.code_index({"c": (t.customer.select("c_name"), ["c_name"]), "s": (t.supplier.withColumnRenamed("s_name", "village"), ["village"])}, cut(_name_vault(t))))
    p = F.lpad((F.col("o_custkey") % 50 + 1).cast("string"), 3, "0")
    req = t.orders.select(F.concat(F.lit("ws"), (F.col("o_custkey") % 50).cast("string")).alias("workspace"), "o_orderkey",
                          (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey").cast("int"))).alias("at"),
                          F.concat(F.when(F.col("o_orderkey") % 2 == 0, "PLACE_").otherwise("NAME_"), p).alias("code"), F.lit(False).alias("whole_column"))
    return V.reveal_requests(req, lineage).select("workspace", "o_orderkey", "decision")


@query("prv23_mask_copy", """select c_custkey, 'NAME_' || lpad((c_custkey + 1)::varchar, greatest(3, length((c_custkey + 1)::varchar))::int, '0') as name, 'HIDDEN' as segment, 'met ' || 'NAME_' || lpad((c_custkey + 1)::varchar, greatest(3, length((c_custkey + 1)::varchar))::int, '0') as note, 3 as changed, 1 as hidden from customer""")
def _(t):
    d = t.customer.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("met "), F.col("c_name")).alias("note"))
    return V.mask_copy(d, "c_custkey", {"name": "code", "segment": "hide"}, ["note"], cut(_name_vault(t)))


def _sheet(t):
    o = t.orders
    return o.select(F.col("o_orderkey").cast("string").alias("row"), F.concat(F.lit("R-"), F.lpad("o_orderkey", 8, "0")).alias("receipt"), F.col("o_orderpriority").alias("priority"),
                    F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2)).alias("amount"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
                    F.concat(F.lit("98"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("tel"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("who"))


@query("prv24_mock", """
select count(*) as "rows", 0 as real_receipts_kept, 0 as outside_range, true as same_prefix, (select count(distinct o_custkey) from orders) as people, (select count(distinct o_orderpriority) from orders) as priorities from orders""")
def _(t):
    d = _sheet(t)
    cols = ["receipt", "priority", "amount", "day", "tel", "who"]
    info = K.kinds_of(d, cols)
    fakes = cut(K.fake_map(K.text_values(d, {c: i["kind"] for c, i in info.items()}), 7))
    m = K.mock(d, "row", info, fakes)
    lo, hi = info["amount"]["low"], info["amount"]["high"]
    from gridloom.functions.numbers import money_number
    both = m.join(d.select("row", F.col("receipt").alias("real"), F.col("who").alias("real_who")), "row")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("receipt") == F.col("real")).alias("real_receipts_kept"), F.count_if(~money_number(F.col("amount")).between(lo, hi)).alias("outside_range"),
                    F.bool_and(F.substring("receipt", 1, 2) == F.substring("real", 1, 2)).alias("same_prefix"), F.count_distinct("who").alias("people"), F.count_distinct("priority").alias("priorities"))


@query("prv25_scrub", """select o_orderkey, 'Order for (person ' || o_custkey || '), status ' || o_orderstatus || '; write to ' || c_name || '@mail.org. Thanks, person ' || o_custkey || '.' as redacted from orders join customer on o_custkey = c_custkey""")
def _(t):
    values = t.customer.select(norm(F.col("c_name")).alias("norm"), F.col("c_name").alias("value"), F.concat(F.lit("person "), F.col("c_custkey").cast("string")).alias("fake"))
    return V.redact(_mentions(t), "o_orderkey", "text", values, code="fake").select("o_orderkey", "redacted")


@query("prv26_span_quality", """
with n as (select count(*) n, count(*) filter (where c_custkey % 2 = 0) h from customer)
select 'phone' as label, n as gold, n as found, 1.0::double recall, 1.0::double as "precision" from n union all select 'dob', h, h, 1.0, 1.0 from n
union all select 'person_name', 2 * n, 3 * n, 1.0, round(2 / 3.0::double, 6) from n union all select '(all)', 3 * n + h, 4 * n + h, 1.0, round((3 * n + h)::double / (4 * n + h), 6) from n""")
def _(t):
    d = _notes(t)
    low = F.lower("name")
    gold = d.select("id", F.inline(F.array_compact(F.array(
        F.struct((F.position(F.col("name"), F.col("text")) - 1).alias("start"), (F.position(F.col("name"), F.col("text")) - 1 + F.length("name")).alias("end"), F.lit("person_name").alias("label")),
        F.struct((F.position(low, F.col("text")) - 1).alias("start"), (F.position(low, F.col("text")) - 1 + F.length("name")).alias("end"), F.lit("person_name").alias("label")),
        F.struct((F.position(F.col("phone"), F.col("text")) - 1).alias("start"), (F.position(F.col("phone"), F.col("text")) - 1 + F.length("phone")).alias("end"), F.lit("phone").alias("label")),
        F.when(F.col("dob").isNotNull(), F.struct((F.position(F.col("dob"), F.col("text")) - 1).alias("start"), (F.position(F.col("dob"), F.col("text")) - 1 + F.length("dob")).alias("end"), F.lit("dob").alias("label")))))))
    found = D.exploded(D.detect(d, "text", "text", headings={"Beneficiary": "person_name"}, clean=True), ["id"], "text")
    return D.span_eval(gold, found, "id").withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query("prv26b_column_quality", """select 't' || c_nationkey as "table", count(*) private, count(*) filter (where c_custkey % 5 > 0) found, count(*) filter (where c_custkey % 5 = 0) missed, count(*) filter (where c_custkey % 7 = 0) false_flags from customer group by 1""")
def _(t):
    tab = F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table")
    k = F.col("c_custkey")
    gold = t.customer.select(tab, F.concat(F.lit("a"), k.cast("string")).alias("column"), F.lit("phone").alias("class"))
    hit = t.customer.select(tab, F.concat(F.lit("a"), k.cast("string")).alias("column"), F.when(k % 5 > 0, "email").otherwise("none").alias("class"))
    extra = t.customer.select(tab, F.concat(F.lit("b"), k.cast("string")).alias("column"), F.when(k % 7 == 0, "email").otherwise("none").alias("class"))
    return D.column_eval(gold, hit.unionByName(extra))


@query("prv27_tables_in_text", """select c_custkey as k, 2 as first, 4 as last, 'Name, Phone, Place, Marks' as columns from customer""")
def _(t):
    n = F.col("c_name")
    body = F.array(F.lit("Dear all, here it is"), F.lit(""), F.lit("Name, Phone, Place, Marks"), F.concat(n, F.lit(", 98, x, 5")), F.concat(n, F.lit(", 97, y, 6")), F.lit("Thanks"))
    lines = t.customer.select(F.col("c_custkey").alias("k"), F.posexplode(body).alias("line_no", "line"))
    return G.find_tables(lines, "k").select("k", "first", "last", F.array_join("columns", ", ").alias("columns"))


@query("prv28_decisions", """select 't' || c_custkey as "table", case when c_custkey % 2 = 0 then 'mask' end choice from customer""")
def _(t):
    def arr(*xs):
        return F.array(*[F.lit(x) for x in xs])
    heads = F.when(F.col("c_custkey") % 2 == 0, arr("Phone ", "name", "AGE")).otherwise(arr("Item", "Qty"))
    tabs = t.customer.select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table"), heads.alias("headers"))
    made = t.region.select(arr("Age", "Name", "Phone").alias("headers"), F.lit("mask").alias("choice"))
    return P.apply_decisions(tabs, made).select("table", "choice")


@query("prv29_safe_columns", """select 'amount' as "column", true as safe from orders having count(*) > 3 union all select 'mark', true from orders having count(*) > 3 union all select 'phone', false from orders having count(*) > 3 union all select 'name', false from orders having count(*) > 3""")
def _(t):
    k = F.col("o_orderkey")
    cells = t.orders.select(k.alias("row_no"), F.inline(F.array(
        F.struct(F.lit("amount").alias("column"), F.when(k == 0, "Amount in Rs").otherwise(F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2))).alias("value")),
        F.struct(F.lit("mark").alias("column"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("phone").alias("column"), F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0")).alias("value")),
        F.struct(F.lit("name").alias("column"), F.col("o_orderpriority").alias("value")))))
    return P.safe_columns(cells)


@query("prv30_extract", """
with n as (select conv_id * 1000 + turn as id, case when role = 'system' then 'table' else 'text' end kind, text, sum(length(text)) over (order by conv_id * 1000 + turn) used from conversations)
select id, kind, used <= 150000 as whole, case when used <= 150000 then length(text) when kind = 'text' then least(length(text), 8000) end as text_chars, 0 as leaks from n""")
def _(t):
    d = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "system", "table").otherwise("text").alias("kind"), "text")
    vault = cut(_name_vault(t))
    got = V.build_extract(d, "id", "text", vault)
    chars = F.when(F.col("whole") | (F.col("kind") == "text"), F.length("sent"))
    return got.select("id", "kind", "whole", chars.alias("text_chars"), F.col("leaks").cast("int").alias("leaks"))
