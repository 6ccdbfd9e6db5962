"""Sources, grid tidying, column tidying and profiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import dates as D
from gridloom.functions.text import safe_name
from gridloom.operators import grid as G
from gridloom.operators import profile as P
from gridloom.operators import tidy as T
from gridloom.queries.registry import query
from gridloom.session import cut, scratch
from gridloom.sources import files as S
from gridloom.sources import records as R

# ------------------------------------------------------------------ grids shaped from the orders table
# Orders are laid out as sheets of ten stacked blocks of 50 orders: title, header, rows, total, blank row.
_STRIDE = 54


def _order_cells(t):
    """(file, row_no, cells) of the messy grid, and the same rows as plain columns for the header and total rows."""
    o = t.orders.withColumns({"_b": F.floor(F.col("o_orderkey") / 50).cast("long")})
    base = (F.col("_b") % 10) * _STRIDE
    blank = F.lit("")
    data = o.select(F.col("_b"), (base + 2 + F.col("o_orderkey") % 50).alias("row_no"), F.array(
        F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.lit("Rs. "), F.col("o_totalprice").cast("string")),
        F.date_format("o_orderdate", "dd/MM/yyyy"), F.concat(F.col("o_orderpriority"), F.lit(', "as told"'))).alias("cells"))
    b = o.groupBy("_b").agg(F.count("*").alias("n")).withColumn("base", (F.col("_b") % 10) * _STRIDE)
    rows = [F.struct(F.col("base").alias("row_no"), F.array(F.concat(F.lit("Camp "), F.col("_b").cast("string")), blank, blank, blank, blank).alias("cells")),
            F.struct((F.col("base") + 1).alias("row_no"), F.array(*[F.lit(x) for x in ("Order No", "Status", "Amount", "Date", "Status")]).alias("cells")),
            F.struct((F.col("base") + 52).alias("row_no"), F.array(F.lit("Total"), blank, F.col("n").cast("string"), blank, blank).alias("cells")),
            F.struct((F.col("base") + 53).alias("row_no"), F.array(blank, blank, blank, blank, blank).alias("cells"))]
    frame = b.select("_b", F.inline(F.array(*rows)))
    g = data.unionByName(frame)
    return g.select(F.floor(F.col("_b") / 10).cast("string").alias("file"), F.lit("csv").alias("sheet"), "row_no", "cells")


_GRID_SQL = """
with o as (select *, o_orderkey // 50 b from orders), b as (select b, count(*) n from o group by 1),
g as (select b, (b % 10) * 54 + 2 + o_orderkey % 50 row_no, [o_orderkey::varchar, o_orderstatus, 'Rs. ' || o_totalprice::varchar, strftime(o_orderdate, '%d/%m/%Y'), o_orderpriority || ', "as told"'] cells from o
 union all select b, (b % 10) * 54, ['Camp ' || b::varchar, '', '', '', ''] from b
 union all select b, (b % 10) * 54 + 1, ['Order No', 'Status', 'Amount', 'Date', 'Status'] from b
 union all select b, (b % 10) * 54 + 52, ['Total', '', n::varchar, '', ''] from b
 union all select b, (b % 10) * 54 + 53, ['', '', '', '', ''] from b)
"""


def _written_csv(t):
    """The grid written as CSV files in the shared folder, one folder per sheet, rows in place order."""
    path = scratch(t.spark, "grid")
    quoted = F.transform("cells", lambda c: F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    lines = _order_cells(t).select("file", "row_no", F.array_join(quoted, ",").alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "row_no").select("file", "value").write.partitionBy("file").text(path)
    return path


@query("src1_read_grid", _GRID_SQL + "select (b // 10)::varchar file, row_no - (min(row_no) over (partition by b // 10)) as row_no, array_to_string(cells, '|') as line from g")
def _(t):
    g = S.read_grid(t.spark, _written_csv(t))
    return g.select(F.regexp_extract("file", r"file=(\d+)", 1).alias("file"), "row_no", F.array_join("cells", "|").alias("line"))


@query("src2_catalog", """select 'sheet' kind, count(distinct o_orderkey // 500) files, true sized from orders""")
def _(t):
    path = scratch(t.spark, "catalog")
    d = t.orders.select(F.floor(F.col("o_orderkey") / 500).alias("file"), "o_orderkey", "o_orderstatus")
    d.repartition("file").write.partitionBy("file").csv(path)
    c = S.catalog(t.spark, path).filter("name like 'part-%'")
    return c.groupBy("kind").agg(F.count("*").alias("files"), F.bool_and(F.col("size") > 0).alias("sized"))


@query("src2b_catalog_by_mime", """
select doc_id as id, case doc_id % 7 when 0 then 'sheet' when 1 then 'pdf' when 2 then 'image' when 3 then 'folder' when 4 then 'slides' when 5 then 'doc' else 'other' end as kind from documents""")
def _(t):
    k = (F.col("doc_id") % 7).cast("int")
    mime = F.get(F.array(*[F.lit(m) for m in ("application/vnd.google-apps.spreadsheet", None, "image/PNG", "application/vnd.google-apps.folder", "application/octet-stream", "", "application/octet-stream")]), k)
    name = F.concat(F.lit("f"), F.get(F.array(*[F.lit(m) for m in (".bin", ".PDF", ".x", "", ".pptx", ".md", ".zip")]), k))
    return S.catalog_of(t.documents.select(F.col("doc_id").alias("id"), name.alias("name"), mime.alias("mime"), F.col("n_chars").alias("size"), F.lit(1).alias("modified"))).select("id", "kind")


@query("src3_folder_paths", """
select 'c' || c_custkey id, 'My Drive/' || r_name || '/' || n_name as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union all select 'n' || n_nationkey, 'My Drive/' || r_name from nation join region on n_regionkey = r_regionkey
union all select 'r' || r_regionkey, 'My Drive' from region union all select 's' || s_suppkey, 'Shared with me' from supplier
union all select 'p' || p_partkey, '' from part""")
def _(t):
    def part(df, id_, parent, name, shared=False):
        return df.select(id_.alias("id"), parent.alias("parent_id"), name.alias("name"), F.lit(shared).alias("shared"))

    def k(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))
    files = part(t.customer, k("c", "c_custkey"), k("n", "c_nationkey"), F.col("c_name"))
    files = files.unionByName(part(t.nation, k("n", "n_nationkey"), k("r", "n_regionkey"), F.col("n_name")))
    files = files.unionByName(part(t.region, k("r", "r_regionkey"), F.lit("root"), F.col("r_name")))
    files = files.unionByName(part(t.supplier, k("s", "s_suppkey"), F.lit("elsewhere"), F.col("s_name"), True))
    files = files.unionByName(part(t.part, k("p", "p_partkey"), F.lit(None).cast("string"), F.col("p_name")))
    return S.resolve_paths(files).select("id", "path")


def _chat_lines(t):
    """Conversations rendered as chat exports: every turn a message line, texts with line breaks continued on the next
    lines, a system line after every fifth turn. Place = turn * 1000 + line."""
    stamp = F.concat(F.date_format(F.date_add(F.lit("2024-03-01"), (F.col("turn") % 28).cast("int")), "dd/MM/yyyy"), F.lit(", 10:15 - "))
    text = F.split("text", "\n")
    msg = t.conversations.select(F.col("conv_id").cast("string").alias("file"), "turn", "role", F.posexplode(text).alias("i", "piece"))
    lines = msg.select("file", (F.col("turn") * 1000 + F.col("i")).alias("line_no"),
                       F.when(F.col("i") == 0, F.concat(stamp, F.initcap("role"), F.lit(": "), F.col("piece"))).otherwise(F.col("piece")).alias("line"))
    system = t.conversations.filter("turn % 5 = 4").select(F.col("conv_id").cast("string").alias("file"), (F.col("turn") * 1000 + 999).alias("line_no"),
                                                           F.concat(stamp, F.lit("Messages are encrypted")).alias("line"))
    return lines.unionByName(system)


@query("src4_chat", r"""
with m as (select conv_id, turn, role, string_split(text, chr(10)) p from conversations), n as (select conv_id, count(*) n from m group by 1),
x as (select conv_id, turn, role, trim(p[1], ' ') || coalesce(nullif((select string_agg(chr(10) || trim(u, ' '), '' order by i) from (select unnest(p[2:]) u, generate_subscripts(p[2:], 1) i) where trim(u, ' ') <> ''), ''), '') message from m)
select conv_id::varchar file, turn, strftime(date '2024-03-01' + (turn % 28)::int, '%Y-%m-%d') as date, upper(role[1]) || lower(role[2:]) sender, message from x join n using (conv_id) where n >= 5""")
def _(t):
    got = R.parse_chat(_chat_lines(t))
    return got.select("file", F.floor(F.col("line_no") / 1000).alias("turn"), F.date_format("date", "yyyy-MM-dd").alias("date"), "sender", "message")


@query("src5_mail", """
select 'e' || event_id id, 'u' || user_id thread_id, case when event_type = 'purchase' then 'out' else 'in' end direction, case when event_type = 'error' then 'noreply@shop.org' else 'user' || user_id || '@x.org' end from_addr,
 case when event_type = 'error' then '' else 'User ' || user_id end from_name, event_type in ('error', 'click') and event_type <> 'signup' is_bulk, event_type = 'signup' is_notice, event_type = 'view' is_unread from events""")
def _(t):
    e = F.col("event_type")
    sender = F.when(e == "error", F.lit("NoReply@shop.org")).otherwise(F.concat(F.lit('"User '), F.col("user_id").cast("string"), F.lit('" <User'), F.col("user_id").cast("string"), F.lit("@X.org>")))
    heads = F.array_compact(F.array(F.struct(F.lit("FROM").alias("name"), sender.alias("value")), F.struct(F.lit("Subject").alias("name"), F.when(e == "signup", "Invitation: tea").otherwise(e).alias("value")),
                                    F.when(e == "click", F.struct(F.lit("List-Unsubscribe").alias("name"), F.lit("<x>").alias("value")))))
    labels = F.when(e == "purchase", F.array(F.lit("SENT"))).when(e == "view", F.array(F.lit("UNREAD"))).otherwise(F.array(F.lit("INBOX")))
    js = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("threadId"),
                            F.lit("1704067200000").alias("internalDate"), F.lit("").alias("snippet"), labels.alias("labelIds"),
                            F.struct(F.lit("text/plain").alias("mimeType"), heads.alias("headers"), F.struct(F.col("props").alias("data")).alias("body")).alias("payload")))
    return R.flatten_mail(t.events.select(js.alias("json"))).select("id", "thread_id", "direction", "from_addr", "from_name", "is_bulk", "is_notice", "is_unread")


@query("src6_calendar", """
with e as (select event_id, user_id, event_type, strftime(ts + interval 5 hour + interval 30 minute, '%Y-%m-%d %H:%M') s from events where event_type <> 'error')
select 'event' part, 'e' || event_id id, case when event_type = 'view' then '2024-02-03 00:00' else s end as start, event_type = 'view' all_day,
 case when event_type = 'click' then 'accepted' when event_type = 'purchase' then 'organizer' else '' end my_response, 'guest' || user_id || '@x.org' guests from e
union all select 'guest', 'e' || event_id, null, false, 'declined', 'guest' || user_id || '@x.org' from e""")
def _(t):
    e = F.col("event_type")
    me = F.when(e == "click", F.struct(F.lit("me@x.org").alias("email"), F.lit(True).alias("self"), F.lit("accepted").alias("responseStatus")))
    guest = F.struct(F.concat(F.lit("guest"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("email"), F.lit(False).alias("self"), F.lit("declined").alias("responseStatus"))
    at = F.when(e == "view", F.struct(F.lit("2024-02-03").alias("date"), F.lit(None).cast("string").alias("dateTime"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("date"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime")))
    js = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.when(e == "error", "cancelled").otherwise("confirmed").alias("status"),
                            e.alias("summary"), at.alias("start"), at.alias("end"), F.struct(F.lit("o@x.org").alias("email"), (e == "purchase").alias("self")).alias("organizer"),
                            F.array_compact(F.array(me, guest)).alias("attendees")))
    ev, gu = R.flatten_events(t.events.select(js.alias("json")))
    a = ev.select(F.lit("event").alias("part"), "id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "all_day", "my_response", F.array_join("guests", ", ").alias("guests"))
    return a.unionByName(gu.select(F.lit("guest").alias("part"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("start"), F.lit(False).alias("all_day"),
                                   F.col("response").alias("my_response"), F.col("email").alias("guests")))


@query("src7_pages")
def _(t):
    p = R.to_pages(t.documents, "doc_id", "text", 3000)
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars"))


@query("src8_year_tables", """
select (n_regionkey)::varchar file, 'Table ' || n_regionkey || ': balances' as "table", n_name as label, y as "year", round(sum(c_acctbal) filter (where true) + (y::int - 2000) , 2) as value
from customer join nation on c_nationkey = n_nationkey, (values ('2001'), ('2002'), ('2003')) v(y) group by n_regionkey, n_name, y""")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    per = t.customer.join(n, "c_nationkey").groupBy("n_regionkey", "n_name", "c_nationkey").agg(F.sum("c_acctbal").alias("v"))
    nums = [F.format_number(F.col("v") + k, 2) for k in (1, 2, 3)]
    rows = per.select(F.col("n_regionkey").cast("string").alias("file"), (F.col("c_nationkey") + 10).cast("long").alias("line_no"), F.concat_ws("   ", F.col("n_name"), *nums).alias("line"))
    frame = per.select("n_regionkey").distinct().select(F.col("n_regionkey").cast("string").alias("file"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("Table "), F.col("n_regionkey").cast("string"), F.lit(": balances")).alias("line")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.lit("Nation   2001   2002   2003").alias("line")),
        F.struct(F.lit(900).cast("long").alias("line_no"), F.lit("Source: accounts 2001 2002").alias("line")),
        F.struct(F.lit(901).cast("long").alias("line_no"), F.lit("stray   1   2   3").alias("line")))))
    lines = rows.unionByName(frame).withColumn("page", F.lit(1))
    return R.year_tables(lines).select("file", "table", "label", "year", F.round("value", 2).alias("value"))


@query("src9_fold_regions", """
select c_mktsegment category, year(o_orderdate) as "year", 'orders' metric, count(*)::double as value from orders join customer on o_custkey = c_custkey group by all
union all select c_mktsegment, year(o_orderdate), 'north spend', round(sum(o_totalprice), 2) from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' group by all
union all select c_mktsegment, year(o_orderdate), 'south spend', round(sum(o_totalprice), 2) from orders join customer on o_custkey = c_custkey where o_orderstatus = 'O' group by all""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"))
    o = t.orders.join(c, "o_custkey").withColumn("year", F.year("o_orderdate"))

    def part(region, metric, df, v):
        return df.groupBy("category", "year").agg(v.cast("double").alias("value")).select(F.lit(region).alias("region"), "category", "year", F.lit(metric).alias("metric"), "value")
    spend = F.round(F.sum("o_totalprice"), 2)
    cells = part("a", "orders", o, F.count("*")).unionByName(part("b", "spend", o.filter("o_orderstatus = 'F'"), spend)).unionByName(part("c", "spend", o.filter("o_orderstatus = 'O'"), spend))
    return R.fold_regions(cells, {"a": "all", "b": "north", "c": "south"})


@query("src10_stale", """
select 'stale' what, c_custkey id from customer where c_custkey % 7 = 0 or c_custkey % 5 = 0
union all select 'kept', c_custkey from customer where not (c_custkey % 7 = 0 or c_custkey % 5 = 0)
union all select 'rebuilt', c_custkey from customer where c_custkey % 7 = 0 or c_custkey % 5 = 0""")
def _(t):
    src = t.customer.select(F.col("c_custkey").alias("id"), F.lit(2).alias("modified"))
    had = t.customer.filter("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(2).alias("modified"))
    gone = t.orders.select((F.col("o_custkey") + 10 ** 9).alias("id"), F.lit(2).alias("modified")).distinct()
    derived = had.unionByName(gone)
    todo = S.stale(src, derived)
    new = S.refresh_derived(src, derived.withColumn("state", F.lit("kept")), todo.withColumn("state", F.lit("rebuilt")))
    return todo.select(F.lit("stale").alias("what"), "id").unionByName(new.select(F.col("state").alias("what"), "id"))


@query("src12_csv_safe", """select p_partkey, case when p_partkey % 3 = 0 then '''=' || p_name when p_partkey % 3 = 1 then '''-' || p_name else p_name end as name from part""")
def _(t):
    c = F.col("p_partkey") % 3
    d = t.part.select("p_partkey", F.when(c == 0, F.concat(F.lit("="), "p_name")).when(c == 1, F.concat(F.lit("-"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    path = scratch(t.spark, "safe")
    S.write_csv_safe(d, path)
    return t.spark.read.schema("p_partkey long, name string").csv(path, header=True, escape='"')


@query("src13_log_retention", """select strftime(ts, '%Y-%m-%d') as day, count(*) n, true as kept from events where ts >= timestamp '2024-01-14' and ts < timestamp '2024-01-21' group by 1
union all select distinct strftime(ts, '%Y-%m-%d'), 0, false from events where ts < timestamp '2024-01-14'""")
def _(t):
    path = scratch(t.spark, "log")
    half = F.col("event_id") % 2
    for part in (0, 1):
        S.append_log(t.events.filter(half == part).select("ts", "event_id", "event_type"), path, "ts")
    schema = "ts timestamp_ntz, event_id long, event_type string"
    live = S.read_log(t.spark, path, schema, "2024-01-20").groupBy("day").agg(F.count("*").alias("n")).withColumn("kept", F.lit(True))
    old = S.expired_days(t.spark, path, schema, "2024-01-20").select("day", F.lit(0).cast("long").alias("n"), F.lit(False).alias("kept"))
    return live.unionByName(old)


@query("src14_sync_log", """select 'customer' as "table", count(*) as "rows", count(*) as loaded from customer union all select 'orders', count(*), count(*) from orders""")
def _(t):
    out = None
    for name in ("customer", "orders"):
        df = getattr(t, name)
        one = S.logged_write(df, scratch(t.spark, name), name).select(F.col("what").alias("table"), F.col("rows").alias("loaded"))
        one = S.size_report({name: df}).join(one, "table").select("table", "rows", "loaded")
        out = one if out is None else out.unionByName(one)
    return out


@query("src15_json_walk", r"""select event_id, '{"role": "user", "content": [{"type": "text", "text": "' || upper(event_type) || '"}, {"image": "data:image/png;base64,ab"}], "k": ' || (props->>'$.k') || '}' as out from events""")
def _(t):
    js = F.concat(F.lit('{"role": "user", "content": [{"type": "text", "text": "'), F.col("event_type"), F.lit('"}, {"image": "data:image/png;base64,ab"}], "k": '),
                  F.get_json_object("props", "$.k"), F.lit("}"))
    return t.events.select("event_id", S.walk_json_strings(js, str.upper).alias("out"))


# ------------------------------------------------------------------ grid to table
@query("tid1_headers", _GRID_SQL + "select (b // 10)::varchar file, row_no from g where cells[1] = 'Order No'")
def _(t):
    return G.find_headers(_order_cells(t)).filter("is_header").select("file", "row_no")


@query("tid1b_header_by_share", "select (o_orderkey // 500)::varchar file, min((o_orderkey // 50 % 10) * 54) + 1 as header_row from orders group by 1")
def _(t):
    return G.header_row_by_share(_order_cells(t)).select("file", "header_row")


@query("tid2_blocks", _GRID_SQL + """select (b // 10)::varchar file, row_no, 'Camp ' || b title, dense_rank() over (partition by b // 10 order by b) as block from g where cells[1] <> '' and cells[1] not like 'Camp%' and cells[1] <> 'Order No'""")
def _(t):
    b = G.split_blocks(_order_cells(t)).filter("not is_header and not lead_in and n > 0")
    return b.select("file", "row_no", "title", "block")


@query("tid3_two_row_headers", """
with r as (select distinct o_custkey k from orders) select k::varchar file, i as pos, (['Name', 'Sports', 'Sports (2)', 'col_4', 'Score', 'Score (2)'])[i + 1] as name from r, range(6) x(i)""")
def _(t):
    h = t.orders.select(F.col("o_custkey").cast("string").alias("file")).distinct().select(
        "file", F.array(*[F.lit(x) for x in ("Name", "", "Sports", "", " Score ", "Score")]).alias("header"),
        F.struct(F.array(*[F.lit(x) for x in ("", "Sports", "", "", "", "")]).alias("cells"), F.lit(1).alias("n")).alias("above"))
    return h.select("file", F.posexplode(G.column_names(F.col("header"), F.col("above"), F.lit(6))).alias("pos", "name"))


@query("tid4_footers", _GRID_SQL + "select (b // 10)::varchar file, row_no from g where regexp_full_match(cells[1], '[0-9]+')")
def _(t):
    return G.drop_footers(G.split_blocks(_order_cells(t))).select("file", "row_no")


@query("tid_grid_to_table", """select (o_orderkey // 500)::varchar file, 'Camp ' || (o_orderkey // 50) block, o_orderkey::varchar as "Order No", o_orderstatus as "Status", 'Rs. ' || o_totalprice::varchar as "Amount", strftime(o_orderdate, '%d/%m/%Y') as "Date", o_orderpriority || ', "as told"' as "Status (2)" from orders""")
def _(t):
    cells = cut(G.tidy_cells(_order_cells(t)))  # the tidy table is stored once
    cols = ["Order No", "Status", "Amount", "Date", "Status (2)"]
    tid = cells.select("table_id").first()["table_id"]  # every block has the same header
    return G.stack_table(cells, tid, cols).select("file", "block", *cols)


def _listing(t):
    """Parts as a sheet with layout rows: a subheading and a repeated header per brand, a total per brand."""
    p = t.part.select(F.col("p_partkey").cast("string").alias("No"), F.col("p_name").alias("Item"), F.col("p_type").alias("Type"), F.col("p_size").cast("string").alias("Size"))
    b = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    e = F.lit("")
    rows = [F.struct(F.col("p_brand").alias("No"), e.alias("Item"), e.alias("Type"), e.alias("Size")),
            F.struct(F.lit("NO").alias("No"), F.lit("item").alias("Item"), F.lit("Type ").alias("Type"), F.lit("Size").alias("Size")),
            F.struct(F.lit("Grand total").alias("No"), e.alias("Item"), e.alias("Type"), F.col("n").cast("string").alias("Size"))]
    return p.unionByName(b.select(F.inline(F.array(*rows))))


@query("tid5_layout_rows", """
with b as (select p_brand, count(*) n from part group by 1)
select 'kept' layout, count(*) n from part union all select 'subheading', count(*) from b union all select 'repeated_header', count(*) from b union all select 'total', count(*) from b
union all select 'rows kept', (select count(*) from part) + 2 * (select count(*) from b)""")
def _(t):
    d = T.layout_rows(_listing(t), ["No", "Item", "Type", "Size"])
    a = d.groupBy(F.coalesce("layout", F.lit("kept")).alias("layout")).agg(F.count("*").alias("n"))
    kept = T.keep_rows(_listing(t), ["No", "Item", "Type", "Size"]).agg(F.count("*").alias("n")).select(F.lit("rows kept").alias("layout"), "n")
    return a.unionByName(kept)


@query("tid6_safe_names", r"""
with s as (select c_nationkey sc, c_custkey pos, regexp_replace(regexp_replace(lower(trim((c_custkey % 3) || ' ' || c_mktsegment || '!')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') s from customer),
r as (select sc, pos, 't_' || s as s, row_number() over (partition by sc, s order by pos) i from s) select sc as scope, pos, case when i > 1 then s || '_' || i else s end safe from r""")
def _(t):
    n = t.customer.select(F.col("c_nationkey").alias("scope"), F.col("c_custkey").alias("pos"),
                          F.concat((F.col("c_custkey") % 3).cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit("!")).alias("name"))
    return T.unique_names(n, "scope", "name", "pos").select("scope", "pos", "safe")


def _texty(t):
    """Orders as text cells, the way a sheet holds them."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.cast("string").alias("id"), F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2)).alias("amount"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("share"), F.concat(F.lit("98"), F.lpad(k.cast("string"), 10, "0")).alias("account"),
        F.when(k % 50 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("mostly"), F.col("o_orderpriority").alias("prio"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("day"), F.date_format("o_orderdate", "MMM d, yyyy").alias("us_day"),
        F.concat((F.col("o_custkey") % 80).cast("string"), F.lit(".1234, "), (F.col("o_custkey") % 170).cast("string"), F.lit(".5678")).alias("place"))


@query("tid7_coerce_numbers", """select o_orderkey::varchar as id, o_totalprice as amount, (o_custkey % 100)::double as share, case when o_orderkey % 50 = 0 then null else o_custkey::double end mostly, 'amount,id,mostly,share' as numeric_columns from orders""")
def _(t):
    d, hit = T.coerce_numbers(_texty(t))
    return d.select(F.col("id").cast("bigint").cast("string").alias("id"), "amount", "share", "mostly", F.lit(",".join(sorted(hit))).alias("numeric_columns"))


@query("tid8_keep_ids", """select o_custkey as small, (5000000000 + o_orderkey)::varchar as long_id, o_totalprice as price, 'small' as whole, 'long_id' as as_text from orders""")
def _(t):
    d = t.orders.select(F.col("o_custkey").cast("double").alias("small"), (F.lit(5e9) + F.col("o_orderkey")).alias("long_id"), F.col("o_totalprice").alias("price"))
    got, whole, text = T.keep_ids(d)
    return got.select("small", "long_id", "price", F.lit(",".join(whole)).alias("whole"), F.lit(",".join(text)).alias("as_text"))


@query("tid9_split_gps", """select o_orderkey::varchar as id, ((o_custkey % 80) + 0.1234)::double as lat, ((o_custkey % 170) + 0.5678)::double as long from orders""")
def _(t):
    got, _hit = T.split_gps(_texty(t).select("id", "place"))
    return got.select("id", F.round("place lat", 4).alias("lat"), F.round("place long", 4).alias("long"))


@query("tid10_coerce_dates", """select o_orderkey::varchar as id, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y-%m-%d') us_day, 'day:day first,us_day:day first' as typed from orders""")
def _(t):
    got, done = T.coerce_dates(_texty(t).select("id", "day", "us_day", "prio"))
    return got.select("id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("us_day", "yyyy-MM-dd").alias("us_day"),
                      F.lit(",".join(f"{k}:{v}" for k, v in sorted(done.items()))).alias("typed"))


_MIXED = "case o_orderkey % 4 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%Y-%m-%d') when 2 then strftime(o_orderdate, '%d %b %Y') else 'soon' end"


def _mixed_dates():
    m, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    return (F.when(m == 0, F.date_format(d, "dd/MM/yyyy")).when(m == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(m == 2, F.date_format(d, "dd MMM yyyy")).otherwise("soon"))


@query("tid11_parse_dates", """
select o_orderkey, case when o_orderkey % 4 < 3 then strftime(o_orderdate, '%Y-%m-%d') end as day,
 (select count(*) from orders where o_orderkey % 4 = 0) as dmy_hits from orders""")
def _(t):
    d = t.orders.select("o_orderkey", _mixed_dates().alias("v"))
    best = T.best_format(d, "v").filter("format = 'dd/MM/yyyy'").select(F.col("hits").alias("dmy_hits"))
    return d.select("o_orderkey", F.date_format(D.parse_date(F.col("v")), "yyyy-MM-dd").alias("day")).crossJoin(F.broadcast(best))  # one row


@query("tid12_canonicalise", "select c_custkey, c_mktsegment seg from customer")
def _(t):
    m = F.col("c_custkey") % 10
    v = F.when(m == 0, F.lower("c_mktsegment")).when(m == 1, F.concat(F.col("c_mktsegment"), F.lit("  "))).otherwise(F.col("c_mktsegment"))
    got, _cols = T.canonicalise(t.customer.select("c_custkey", v.alias("seg")), ["seg"])
    return got


@query("tid14_clean_view", """select o_orderkey, case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then 'Filled' else 'O' end status, upper(substr(o_orderpriority, 1, 3)) || lower(substr(o_orderpriority, 4)) prio, o_totalprice as amount, strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def _(t):
    d = t.orders.select("o_orderkey", F.concat(F.lit(" "), F.col("o_orderstatus")).alias("status"), F.upper("o_orderpriority").alias("prio"),
                        F.concat(F.lit("INR "), F.format_number("o_totalprice", 2)).alias("amount"), F.date_format("o_orderdate", "dd-MM-yyyy").alias("day"))
    got = T.clean_view(d, {"status": {"map": {"p": "", "f": "Filled"}}, "prio": {}, "amount": {"kind": "number"}, "day": {"kind": "date", "formats": ["dd/MM/yyyy", "dd-MM-yyyy"]}})
    title = T.clean_column(F.regexp_replace(F.lower("prio"), "-", " "), {"case": "title"})
    got = got.withColumn("prio", F.concat(F.substring(title, 1, 1), F.lit("-"), F.substring(title, 3, 1), F.lower(F.substring(title, 4, 50))))
    return got.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("tid15_mapping", """select c_custkey as id, c_name as name, round(c_acctbal / 12, 4) monthly from customer union all select s_suppkey, s_name, round(s_acctbal / 12, 4) from supplier""")
def _(t):
    out = None
    for d in (t.customer, t.supplier):
        one = T.apply_mapping(d, unify={"id": ["c_custkey", "s_suppkey"], "name": ["c_name", "s_name"], "bal": ["c_acctbal", "s_acctbal"]})
        one = T.apply_mapping(one, derive={"monthly": "round(bal / 12, 4)"}).select("id", "name", "monthly")
        out = one if out is None else out.unionByName(one)
    return out


@query("tid16_unpivot_months", """
select o_custkey, strftime(m, '%Y-%m-%d') as "month", count(o) as value from (select distinct o_custkey from orders) c cross join (select unnest([date '1997-01-01', date '1997-02-01', date '1997-03-01', date '1997-04-01']) m)
left join (select o_custkey ck, date_trunc('month', o_orderdate)::date om, 1 o from orders) x on ck = o_custkey and om = m group by all""")
def _(t):
    d = t.orders.withColumn("m", F.date_format("o_orderdate", "yyyy-MM"))
    names = {"1997-01": "Jan-97", "1997-02": "Feb 1997", "1997-03": "1997-03", "1997-04": "04/1997"}
    wide = d.groupBy("o_custkey").agg(*[F.count_if(F.col("m") == k).alias(v) for k, v in names.items()])
    return T.unpivot_months(wide).select("o_custkey", F.date_format("month", "yyyy-MM-dd").alias("month"), "value")


@query("tid17_melt_years", """
select o_custkey, y::int as "year", count(o_orderkey)::double as orders, round(coalesce(sum(o_totalprice), 0), 2) as spend from (select distinct o_custkey from orders) c cross join (select unnest([1996, 1997]) y)
left join (select o_custkey ck, year(o_orderdate) oy, o_orderkey, o_totalprice from orders) x on ck = o_custkey and oy = y group by all""")
def _(t):
    y = F.year("o_orderdate")
    wide = t.orders.groupBy("o_custkey").agg(*[x for v in (1996, 1997) for x in (
        F.count_if(y == v).alias(f"orders_{v}"), F.round(F.coalesce(F.sum(F.when(y == v, F.col("o_totalprice"))), F.lit(0.0)), 2).alias(f"spend_{v}"))])
    return T.melt_years(wide)


@query("tid18_stack_aligned", """select c_custkey as id, c_name as name, c_acctbal as balance, 'buyers' as source from customer union all select s_suppkey, s_name, s_acctbal, 'sellers' from supplier""")
def _(t):
    return T.stack_aligned([(t.customer, {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"}, "buyers"),
                            (t.supplier, {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}, "sellers")]).select("id", "name", "balance", "source")


@query("tid19_column_kinds", """
with n as (select count(*) n, count(distinct o_totalprice) dp, count(distinct o_orderkey) dk, count(distinct o_orderdate) dd, min(o_totalprice) lo, max(o_totalprice) hi, count(distinct o_custkey) dc,
  count(distinct case when o_orderkey % 10 > 0 then o_orderkey end) de, count(*) filter (where o_orderkey % 10 = 0) b, count(*) filter (where o_orderkey % 20 = 0) j from orders)
select 'amount' as "column", 'number' kind, 0 as blank, dp as "distinct", 0 as bad, null as format, lo as low, hi as high, n as styled from n
union all select 'day', 'date', 0, dd + 1, j, 'dd/MM/yyyy', null, null, null from (select n.* exclude (dd), (select count(distinct o_orderdate) from orders where o_orderkey % 20 <> 0) dd from n)
union all select 'mail', 'email', b, de, 0, null, null, null, null from n
union all select 'prio', 'category', 0, (select count(distinct o_orderpriority) from orders), null, null, null, null, null from n
union all select 'note', 'longtext', 0, dk, null, null, null, null, null from n
union all select 'tel', 'phone', 0, dk, 0, null, null, null, null from n""")
def _(t):
    k = F.col("o_orderkey")
    d = t.orders.select(F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2)).alias("amount"),
                        F.when(k % 20 == 0, "TBD").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
                        F.when(k % 10 > 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org"))).otherwise("").alias("mail"), F.col("o_orderpriority").alias("prio"),
                        F.concat(F.lit("a long remark that goes on about the order number "), k.cast("string")).alias("note"),
                        F.concat(F.lit("98"), F.lpad(k.cast("string"), 8, "0")).alias("tel"))
    return T.column_kinds(d, d.columns).drop("decimals")


@query("tid20_match_family", """select 'tab ' || c_custkey as tab, case when c_custkey % 3 = 2 then 'family b' else 'family a' end family,
 round(case c_custkey % 3 when 0 then 1.0 when 1 then 3.0 / 4 else 1.0 end, 4) score, c_custkey % 3 <> 1 as accepted, true as tab_ok from customer""")
def _(t):
    m = F.col("c_custkey") % 3
    heads = (F.when(m == 0, F.array(*[F.lit(x) for x in ("Volunteer Name", "School", "Date of visit", "Marks")]))
             .when(m == 1, F.array(*[F.lit(x) for x in ("Title Row Volunteer Name", "school!", "Date of Visit")]))
             .otherwise(F.array(*[F.lit(x) for x in ("Item", "Qty", "Check: qty")])))
    h = t.customer.select(F.concat(F.lit("tab "), F.col("c_custkey").cast("string")).alias("tab"), F.explode(heads).alias("header"))
    fam = t.region.limit(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(x).alias("header")) for f, x in (
        ("family a", "volunteer_name"), ("family a", "school"), ("family a", "date_of_visit"), ("family a", "marks"), ("family b", "item"), ("family b", "qty"))])))
    return T.match_family(h, fam)


# ------------------------------------------------------------------ profiles
_PART = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _union(template, cols):
    return " union all ".join(template.replace("{c}", c) for c in cols)


@query("prf1_profile", "select * from (" + _union("""select '{c}' as "column", count(*) - count({c}) as blank, count(distinct {c}) as "distinct", min(try_cast({c}::varchar as double)) low, max(try_cast({c}::varchar as double)) high, count(*) as "rows",
 case when count(distinct {c}) <= 30 then string_agg(distinct {c}::varchar, ', ' order by {c}::varchar) end as "values" from part""", _PART) + ")")
def _(t):
    return P.profile(t.part, _PART).drop("type")


@query("prf2_categories", "select * from (" + _union("""select '{c}' as "column", string_agg(distinct {c}::varchar, ', ' order by {c}::varchar) as "values" from part having count(distinct {c}) <= 50""", _PART) + ")")
def _(t):
    return P.categories(t.part, _PART)


@query("prf3_sheet_profile", "select * from (" + _union("""select '{c}' as "column", (select count(*) - count({c}) from part) blank, (select count(distinct {c}) from part) as "distinct",
 (select string_agg(v, ' | ' order by n desc, v) from (select {c}::varchar v, count(*) n from part group by 1 order by n desc, v limit 3)) examples""", ["p_name", "p_brand", "p_type"]) + ")")
def _(t):
    return P.sheet_profile(t.part, ["p_name", "p_brand", "p_type"])


@query("prf3b_profile_spellings", """
with d as (select c_custkey, case c_custkey % 4 when 0 then lower(c_mktsegment) when 2 then c_mktsegment || '.' else c_mktsegment end seg from customer),
c as (select seg, count(*) n, regexp_replace(lower(seg), '[^a-z0-9]', '', 'g') k from d group by 1), g as (select k, string_agg(seg, ' | ' order by n desc, seg) m, sum(n) r from c group by 1 having count(*) > 1)
select 'seg' as "column", 0 as blank, (select count(*) from c) as "distinct", (select string_agg(m, '; ' order by r desc, m) from g) as spellings union all select 'c_custkey', 0, count(*), null from customer""")
def _(t):
    m = F.col("c_custkey") % 4
    d = t.customer.select("c_custkey", F.when(m == 0, F.lower("c_mktsegment")).when(m == 2, F.concat("c_mktsegment", F.lit("."))).otherwise(F.col("c_mktsegment")).alias("seg"))
    return P.sheet_profile_with_spellings(d, ["c_custkey", "seg"], ["seg"]).select("column", "blank", "distinct", "spellings")


@query("prf4_describe", "with s as (select * from part order by p_partkey limit 500) select * from (" + _union("""select '{c}' as "column", (select count({c}) from s) filled, (select count(distinct {c}) from s) as "distinct",
 (select string_agg(v, ', ' order by v) from (select distinct {c}::varchar v from s order by v limit 5)) samples""", ["p_name", "p_brand", "p_size"]) + ")")
def _(t):
    return P.describe_table(t.part, [F.col("p_partkey")], ["p_name", "p_brand", "p_size"])


@query("prf5_value_lists", "select * from (" + _union("""select '{c}' as "column", string_agg(distinct {c}::varchar, ', ' order by {c}::varchar) as "values" from orders having count(distinct {c}) <= 10 and max(length({c}::varchar)) <= 24 and count({c}) >= 3 * count(distinct {c})""", ["o_orderstatus", "o_orderpriority", "o_custkey"]) + ")")
def _(t):
    return P.value_lists(t.orders, ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("prf6_manifest", "select * from (" + _union("""select 'n' || c_nationkey as "table", '{c}' as "column", count(*) as "rows", case when '{c}' <> 'c_name' then round(sum(try_cast({c}::varchar as double)), 2) end as total from customer group by c_nationkey""", ["c_custkey", "c_name", "c_acctbal"]) + ")")
def _(t):
    cells = t.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("table"), F.inline(F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in ("c_custkey", "c_name", "c_acctbal")])))
    return P.manifest(cells).withColumn("total", F.round("total", 2))


@query("prf7_schema_brief", """select 'c_acctbal' as "column", min(c_acctbal)::varchar || ' to ' || max(c_acctbal)::varchar as brief, 0 as blank from customer
union all select 'c_mktsegment', (select string_agg(v, ', ' order by v) from (select distinct case when c_mktsegment = 'BUILDING' then 'SEG_001' else c_mktsegment end v from customer)), 0""")
def _(t):
    codes = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.lower("c_mktsegment").alias("norm"), F.lit("SEG_001").alias("code")).distinct()
    return P.schema_brief(t.customer, ["c_acctbal", "c_mktsegment"], codes)


@query("prf7b_masked_rows", """select p_partkey::varchar as p_partkey, 'V' || row_number() over (order by p_partkey) as p_name, p_type from part order by part.p_partkey limit 5""")
def _(t):
    first = t.part.orderBy("p_partkey").limit(5)
    codes = first.select(F.lower("p_name").alias("norm"), F.col("p_partkey").alias("k")).groupBy("norm").agg(F.min("k").alias("k")).select("norm", F.concat(F.lit("V"), (F.col("k") + 1).cast("string")).alias("code"))
    return P.masked_rows(t.part, ["p_partkey", "p_name", "p_type"], codes, [F.col("p_partkey")], 5)


@query("prf8_join_candidates", "select * from (" + _union("""select '{c}' as "column", count(distinct {c}) as "distinct", round(avg(length({c}::varchar)), 6) avg_length from customer having count(distinct {c}) >= 15 and avg(length({c}::varchar)) between 6 and 80""", ["c_name", "c_mktsegment", "c_nationkey"]) + ")")
def _(t):
    return P.join_candidates(t.customer, ["c_name", "c_mktsegment", "c_nationkey"]).withColumn("avg_length", F.round("avg_length", 6))


@query("prf9_table_flags", """select 't' || c_custkey as "table", c_custkey % 3 = 0 as wide_months, c_custkey % 3 = 1 as ledger, c_custkey % 3 = 2 as chat from customer""")
def _(t):
    m = F.col("c_custkey") % 3

    def arr(*xs):
        return F.array(*[F.lit(x) for x in xs])
    cols = F.when(m == 0, arr("Name", "Jun-25", "Jul-25", "Aug-25", "2025-09")).when(m == 1, arr("Date", "Qty", "Balance")).otherwise(arr("date", "sender", "message"))
    return P.table_flags(t.customer.select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table"), F.explode(cols).alias("column")))


@query("prf10_protected_values", """select distinct p_name as value from part where (select count(distinct p_name) from part) > 50 union select distinct c_name from customer where false""")
def _(t):
    return P.protected_values(t.part, ["p_name", "p_brand", "p_retailprice", "p_type"])


@query("prf10b_artefact_leaks", """
with v as (select distinct c_name as value from customer), a as (select o_orderkey as id, 'made for ' || upper(c_name) || ' and ' || c_name || '9' as text from orders join customer on o_custkey = c_custkey where o_orderkey % 20 = 0),
h as (select id, value, row_number() over (partition by id order by value) rn from a join v on contains(lower(text), lower(value))) select id, value from h where rn <= 5""")
def _(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    a = t.orders.filter("o_orderkey % 20 = 0").join(c, "o_custkey").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("made for "), F.upper("c_name"), F.lit(" and "), F.col("c_name"), F.lit("9")).alias("text"))
    return P.artefact_leaks(a, P.protected_values(t.customer, ["c_name", "c_mktsegment"]))


@query("prf11_check_key", """select count(*) as "rows", count(*) - count(l_orderkey) null_keys, (select count(*) from (select l_orderkey from lineitem group by 1 having count(*) > 1)) repeated_keys, 0 as blank_l_returnflag from lineitem""")
def _(t):
    return P.check_key(t.lineitem, "l_orderkey", ["l_returnflag"])


@query("prf12_summary", "select * from (" + _union("""select '{c}' as "column", count({c}) as "count", round(avg({c}), 6) mean, min({c})::double as "min", max({c})::double as "max", round(quantile_cont({c}, 0.25), 6) q1, round(quantile_cont({c}, 0.5), 6) median, round(quantile_cont({c}, 0.75), 6) q3 from lineitem""", ["l_quantity", "l_extendedprice", "l_discount"]) + ")")
def _(t):
    got = P.summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "q1", "median", "q3")})
