"""Search, ranking, vectors and sampling of long texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions import vectors as V
from gridloom.operators import search as S
from gridloom.operators.scale import numbered, top_per_key
from gridloom.queries.registry import query
from gridloom.session import spread

_STOP_SQL = "['" + "','".join(S.STOP) + "']"
_Q_SQL = rf"""
with q0 as (select item_id q, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) query from benchmark),
q1 as (select q, query, list_distinct(list_transform(list_filter(string_split(query, ' '), lambda x: not list_contains({_STOP_SQL}, x)),
  lambda x: case when length(x) > 4 and x like '%s' and x not like '%ss' then x[:-2] else x end)) ws from q0),
p as (select doc_id, generate_subscripts(l, 1) page, unnest(l) text from (select doc_id, string_split(text, chr(10)) l from documents)),
h as (select q, doc_id, ws, query, lower(source || ' ' || lang || ' ' || d.text) t from q1, documents d where len(list_filter(ws, lambda w: not contains(lower(source || ' ' || lang || ' ' || d.text), w))) = 0),
"""


def _queries(t):
    plain = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return t.benchmark.select(F.col("item_id").alias("q"), plain.alias("query"))


def _pages(t):
    """Every line of a document as a page."""
    return spread(t.documents).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def _files(t):
    return t.documents.select("doc_id", F.concat_ws(" ", "source", "lang").alias("name"))


_PHRASE_SQL = r"""('\b' || array_to_string(string_split(case when split_part(query, ' ', -1) like '%s' and length(split_part(query, ' ', -1)) > 3 then query[:-2] else query end, ' '), '[\s\-]+') || 's?')"""


@query("txt1_search", _Q_SQL + """
n as (select q, doc_id, sum(len(regexp_extract_all(lower(p.text), """ + _PHRASE_SQL + """)))::bigint phrase_hits from h join p using (doc_id) group by 1, 2)
select q, doc_id, phrase_hits from n""")
def _(t):
    return S.search(_files(t), _pages(t), _queries(t), "doc_id", score=False).select("q", "doc_id", "phrase_hits")


@query("txt3_rarity_score", _Q_SQL + r"""
w as (select distinct unnest(ws) w from q1), a as (select doc_id, lower(source || ' ' || lang || ' ' || text) t from documents),
tf as (select w, doc_id, (length(t) - length(replace(t, w, ''))) // length(w) tf from w, a where contains(t, w)),
idf as (select w, round(ln(1 + (select count(*) from documents) / (1 + count(*))), 3) idf from tf group by 1)
select q, doc_id, round(sum(idf * ln(1 + tf)), 6) score from (select q, doc_id, unnest(ws) w from h) join tf using (w, doc_id) join idf using (w) group by 1, 2""")
def _(t):
    return S.search(_files(t), _pages(t), _queries(t), "doc_id").select("q", "doc_id", F.round("score", 6).alias("score"))


@query("txt2_phrase_regex", r"""
with b as (select item_id q, lower(regexp_extract(text, '[A-Za-z]+ [a-z]+ [a-z]+')) ph from benchmark), d as (select distinct ph from b where ph <> '')
select ph, count(*) n, sum(len(regexp_extract_all(lower(text), '\b' || replace(case when ph like '%s' and length(split_part(ph, ' ', 3)) > 3 then ph[:-2] else ph end, ' ', '[\s\-]+') || 's?')))::bigint hits
from d, documents where regexp_matches(lower(text), '\b' || replace(case when ph like '%s' and length(split_part(ph, ' ', 3)) > 3 then ph[:-2] else ph end, ' ', '[\s\-]+') || 's?') group by 1""")
def _(t):
    ph = F.lower(F.regexp_extract("text", "[A-Za-z]+ [a-z]+ [a-z]+", 0))
    d = t.benchmark.select(ph.alias("ph")).filter("ph <> ''").distinct()
    q = d.select(F.col("ph").alias("q"), F.concat(F.lit('"'), F.col("ph"), F.lit('"')).alias("query"))
    pages = t.documents.select("doc_id", F.lit(1).alias("page"), "text")
    none = t.documents.select("doc_id", F.lit("").alias("name"))
    got = S.search(none, pages, q, "doc_id", score=False)
    return got.groupBy(F.col("q").alias("ph")).agg(F.count("*").alias("n"), F.sum("phrase_hits").alias("hits"))


@query("ord4_search_order", _Q_SQL + """
n as (select q, doc_id, sum(len(regexp_extract_all(lower(p.text), """ + _PHRASE_SQL + """))) ph from h join p using (doc_id) group by 1, 2),
w as (select distinct unnest(ws) w from q1), a as (select doc_id, lower(source || ' ' || lang || ' ' || text) t from documents),
tf as (select w, doc_id, (length(t) - length(replace(t, w, ''))) // length(w) tf from w, a where contains(t, w)),
idf as (select w, round(ln(1 + (select count(*) from documents) / (1 + count(*))), 3) idf from tf group by 1),
s as (select q, doc_id, round(sum(idf * ln(1 + tf)), 9) score from (select q, doc_id, unnest(ws) w from h) join tf using (w, doc_id) join idf using (w) group by 1, 2)
select q, doc_id, row_number() over (partition by q order by ph desc, score desc, doc_id desc) place from n join s using (q, doc_id) qualify place <= 50""")
def _(t):
    got = S.search(_files(t), _pages(t), _queries(t), "doc_id").withColumn("score", F.round("score", 9))
    return top_per_key(got, ["q"], S.search_order("doc_id"), 50, "place").select("q", "doc_id", "place")


_BM_SQL = r"""
with c as (select doc_id, generate_subscripts(l, 1) - 1 part, unnest(l) chunk from (select doc_id, string_split(text, chr(10)) l from documents)), cc as (select * from c where trim(chunk, ' ') <> ''),
po as (select doc_id, part, length(chunk) len, w, count(*) f from (select doc_id, part, chunk, unnest(regexp_extract_all(lower(chunk), '[a-z0-9_]+')) w from cc) group by all),
st as (select count(*) n, avg(length(chunk)) al from cc), df as (select w, count(*) df from po group by 1),
qw as (select q, w, count(*) qf from (select item_id q, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) w from benchmark) group by all),
s as (select q, doc_id, part, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))), 9) score from qw join df using (w) join po using (w), st group by 1, 2, 3)
select q, doc_id, part, round(score, 6) score, row_number() over (partition by q order by score desc, doc_id, part) place from s qualify place <= 20"""


@query("txt4_bm25", _BM_SQL)
def _(t):
    c = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("part", "chunk")).filter(F.trim("chunk") != "")
    got = S.bm25(c, ["doc_id", "part"], "chunk", t.benchmark.select(F.col("item_id").alias("q"), F.col("text").alias("query")))
    return got.withColumn("score", F.round("score", 6))


@query("txt4b_line_chunks")
def _(t):
    c = S.line_chunks(t.documents, "doc_id", "text", 1500)
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


@query("win7_pack", """select doc_id, md5(text) as digest, true as filled from documents""")
def _(t):
    c = S.line_chunks(t.documents, "doc_id", "text", 1500)
    last = c.groupBy("doc_id").agg(F.max("part").alias("last"), F.array_sort(F.collect_list(F.struct("part", "chunk"))).alias("p"))
    full = F.forall("p", lambda e: (e["part"] == F.col("last")) | (F.length(e["chunk"]) > 1500))
    return last.select("doc_id", F.md5(F.array_join(F.transform("p", lambda e: e["chunk"]), "")).alias("digest"), full.alias("filled"))


@query("txt5_overlap_chunks", r"""
with d as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents), s as (select doc_id, t, unnest(range(0, greatest(length(t) - 200, 1)::bigint, 1000)) a from d where t <> '')
select doc_id, a // 1000 as part, md5(substr(t, a + 1, 1200)) digest from s""")
def _(t):
    return S.overlap_chunks(t.documents, "doc_id", "text").select("doc_id", "part", F.md5("chunk").alias("digest"))


def _vectors(t):
    """Embeddings as files of four chunks; the first chunk of a file doubles as its card; one query per label: half way
    between the label's first and last vector."""
    chunks = t.embeddings.select(F.floor(F.col("vec_id") / 4).alias("file"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("vec"))
    cards = chunks.filter("chunk % 4 = 0").select("file", "vec")
    ends = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    mid = F.zip_with("a", "b", lambda x, y: x.cast("double") + y.cast("double"))
    return ends.select(F.col("label").alias("q"), mid.alias("vec")), chunks, cards


_VEC_SQL = """
with e as (select label q, min_by(embedding, vec_id)::double[] a, max_by(embedding, vec_id)::double[] b from embeddings group by 1),
m as (select q, list_transform(list_zip(a, b), lambda z: z[1] + z[2]) vec from e),
c as (select vec_id // 4 file, vec_id chunk, embedding::double[] v from embeddings),
s as (select q, file, chunk, list_cosine_similarity(v, vec) s from c, m)
"""


@query("txt6_semantic_files", _VEC_SQL + """,
b as (select q, file, max(s) s from s group by 1, 2), f as (select b.q, b.file, b.s + 0.25 * coalesce(k.s, 0) score from b left join s k on k.q = b.q and k.chunk = b.file * 4),
r as (select *, row_number() over (partition by q order by round(score, 12) desc, file) place, max(score) over (partition by q) a from f qualify place <= 30)
select q, file, round(score, 6) score, place from r where a >= 0.55 and score >= greatest(0.5, a - 0.15)""")
def _(t):
    q, chunks, cards = _vectors(t)
    return S.semantic_files(q, chunks, cards).select("q", "file", F.round("score", 6).alias("score"), "place")


@query("txt7_semantic_passages", _VEC_SQL + """,
r as (select *, row_number() over (partition by q order by round(s, 12) desc, chunk) place, max(s) over (partition by q) a from s qualify place <= 8),
k as (select *, row_number() over (partition by q order by round(s, 12) desc, file) place, max(s) over (partition by q) a from s where chunk % 4 = 0 qualify place <= 5)
select 'chunk' what, q, chunk id, round(s, 6) score, place from r where a >= 0.55 and s >= greatest(0.5, a - 0.15)
union all select 'card', q, file, round(s, 6), place from k where a >= 0.55 and s >= greatest(0.5, a - 0.15)""")
def _(t):
    q, chunks, cards = _vectors(t)
    a = S.semantic_chunks(q, chunks).select(F.lit("chunk").alias("what"), "q", F.col("chunk").alias("id"), F.round("score", 6).alias("score"), "place")
    return a.unionByName(S.semantic_cards(q, cards).select(F.lit("card").alias("what"), "q", F.col("file").alias("id"), F.round("score", 6).alias("score"), "place"))


@query("sca12_cosine", """select vec_id, round(list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]), 6) sim, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) len, 1.0 as unit_len from embeddings""")
def _(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.round(V.cosine(e, F.reverse(e)), 6).alias("sim"), F.round(V.length(e), 6).alias("len"), F.round(V.length(V.unit(e)), 9).alias("unit_len"))


@query("txt8_rank_fusion", """
with l as (select lang q, doc_id id, row_number() over (partition by lang order by length(text) - length(replace(text, 'a', '')) desc, doc_id) - 1 r, contains(text, 'the') as apart from documents),
s as (select lang q, doc_id id, row_number() over (partition by lang order by n_chars desc, doc_id) - 1 r from documents)
select q, id, round(sum(v), 9) score from (select q, id, 1.0 / (61 + r + case when apart then 40 else 0 end) v from l union all select q, id, 1.0 / (61 + r) from s) group by 1, 2""")
def _(t):
    d = t.documents
    n_a = F.length("text") - F.length(F.replace(F.col("text"), F.lit("a")))
    lit = numbered(d.select(F.col("lang").alias("q"), F.col("doc_id").alias("id"), n_a.alias("n"), F.contains("text", F.lit("the")).alias("apart")), ["q"], [F.desc("n"), F.col("id")], "rank")
    sem = numbered(d.select(F.col("lang").alias("q"), F.col("doc_id").alias("id"), "n_chars"), ["q"], [F.desc("n_chars"), F.col("id")], "rank")
    got = S.fuse(lit.withColumn("rank", F.col("rank") - 1), sem.withColumn("rank", F.col("rank") - 1))
    return got.withColumn("score", F.round("score", 9))


@query("txt9_find_files")
def _(t):
    files = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("path"), F.lit("").alias("contents"),
                          F.when(F.col("p_size") % 2 == 0, "sheet").otherwise("doc").alias("kind"), F.date_add(F.lit("2024-01-01"), F.col("p_size")).alias("modified"))
    p = t.part.select(F.col("p_partkey").alias("s_suppkey"), "p_name", "p_brand")
    named = t.supplier.join(p, "s_suppkey")
    text = F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit(" "), F.col("p_brand"))
    q = named.select(F.col("s_suppkey").alias("q"), text.alias("query"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2024-01-10").cast("date")).alias("lo"),
                     F.lit(None).cast("date").alias("hi"), F.when(F.col("s_suppkey") % 3 == 0, "sheet").alias("want"))
    return S.find_files(files, q)


@query("txt10_rarity", r"""
with v as (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) w from documents),
t as (select distinct unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) word from benchmark)
select word, count(distinct doc_id) files from t left join v on v.w = word or (length(word) >= 5 and starts_with(v.w, word)) group by 1""")
def _(t):
    terms = t.benchmark.select(F.explode(X.words(F.col("text"))).alias("word"))
    return S.rarity(t.documents, "doc_id", F.col("text"), terms)


@query("txt11_snippets")
def _(t):
    hits = S.search(_files(t), _pages(t), _queries(t), "doc_id", score=False).select("q", "doc_id")
    return S.snippets(hits, _pages(t), _queries(t), "doc_id")


@query("txt12_passages")
def _(t):
    found = S.search(_files(t), _pages(t), _queries(t), "doc_id").withColumn("score", F.round("score", 9))
    hits = top_per_key(found, ["q"], S.search_order("doc_id"), 5, "place").select("q", "doc_id", "place")
    return S.passages(hits, _pages(t), _queries(t), "doc_id")


@query("txt13_sample_text", """select doc_id, md5(case when length(text) <= 600 then text else substr(text, 1, 300) || ' ... ' || substr(text, floor(length(text) * 0.30)::int + 1, 100) || ' ... ' || substr(text, floor(length(text) * 0.55)::int + 1, 100) || ' ... ' || substr(text, floor(length(text) * 0.80)::int + 1, 100) end) a,
 md5(case when length(text) <= 600 then text else substr(text, 1, 200) || ' ... ' || substr(text, greatest(floor(length(text) / 2)::int - 100 + 1, 1), 200) || ' ... ' || substr(text, length(text) - 199, 200) end) b from documents""")
def _(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.md5(X.sample_text(c, 600)).alias("a"), F.md5(X.edges_text(c, 600)).alias("b"))


@query("txt14_likely_tables", r"""
with qw as (select distinct p_partkey q, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: length(x) >= 3)) w from part),
qs as (select distinct q, case when length(w) > 3 then regexp_replace(w, 's$', '') else w end w from qw),
tw as (select distinct p_name || '/' || p_type tb, unnest(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' tables'), '[^a-z0-9]+'), lambda x: length(x) >= 3)) w from part),
ts as (select distinct tb, case when length(w) > 3 then regexp_replace(w, 's$', '') else w end w from tw),
n as (select q, tb, count(*) overlap from qs join ts using (w) group by 1, 2)
select q, tb as "table", overlap from n qualify overlap = max(overlap) over (partition by q)""")
def _(t):
    qs = t.part.select(F.col("p_partkey").alias("q"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    cat = t.part.select(F.concat_ws("/", "p_name", "p_type").alias("table"), F.concat_ws(" ", "p_name", "p_type", F.lit("tables")).alias("text"))
    return S.likely_tables(qs, cat)


@query("txt15_select_files")
def _(t):
    q = F.col("source")
    s = t.documents.select(q.alias("q"), F.col("doc_id").alias("file"), F.col("n_chars").alias("bytes"),
                           (F.col("n_chars") + F.when(F.contains("text", F.lit("@")), 1e9).otherwise(0.0)).alias("score"))
    return S.select_files(s, 6, 30_000)


@query("txt16_retrieval_eval", """
with r as (select o_custkey q, o_orderkey item, o_totalprice / 1e5 lexical, (o_orderkey % 97) / 97.0::double as vec from orders), h as (select *, lexical + 0.8 * vec hybrid from r),
w as (select o_custkey q, min(o_orderkey) item, case when o_custkey % 2 = 0 then 'named' else 'described' end kind from orders group by o_custkey),
m as (select h.*, kind from h join w using (q, item)), a as (select m.q, m.kind, count(*) filter (where h.lexical > m.lexical) l, count(*) filter (where h.vec > m.vec) v, count(*) filter (where h.hybrid > m.hybrid) y from h join m on h.q = m.q group by 1, 2),
z as (select 'lexical' as mode, kind, l as r from a union all select 'vector', kind, v from a union all select 'hybrid', kind, y from a)
select mode, kind, count(*) n, count(*) filter (where r = 0) hit1, count(*) filter (where r < 3) hit3, round(avg(r), 6) mean_rank from z group by 1, 2""")
def _(t):
    r = t.orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), (F.col("o_totalprice") / 1e5).alias("lexical"), ((F.col("o_orderkey") % 97) / F.lit(97.0)).alias("vector"))
    w = t.orders.groupBy(F.col("o_custkey").alias("q")).agg(F.min("o_orderkey").alias("item")).withColumn("kind", F.when(F.col("q") % 2 == 0, "named").otherwise("described"))
    return S.retrieval_eval(r, w).withColumn("mean_rank", F.round("mean_rank", 6))
