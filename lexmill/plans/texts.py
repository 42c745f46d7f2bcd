"""Text functions, extraction, search, privacy and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.cases import array_fingerprint, final_ruling
from lexmill.functions.compat import normal_name, title_case
from lexmill.operators import privacy, redaction, search, vectors
from lexmill.plans.catalogue import Tables, query


@query(r"""select n_nationkey, trim(regexp_replace(upper(strip_accents(n_name)), '\s+', ' ', 'g')) as name, md5(n_name) as digest, sha256(n_name) as digest256 from nation""")
def f01_normal_names(t: Tables):
    n = F.col("n_name")
    return t.nation.select("n_nationkey", normal_name(n).alias("name"), F.md5(n.cast("binary")).alias("digest"), F.sha2(n, 256).alias("digest256"))


@query("""select p_partkey, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') as title from part""")
def f03_title(t: Tables):
    return t.part.select("p_partkey", title_case(F.col("p_name")).alias("title"))


@query("""with r as (select o_orderkey, case o_orderstatus when 'F' then 'CONCEDE PARCIALMENTE' when 'O' then 'niega ' else '' end as a, case left(o_orderpriority, 1) when '1' then 'REVOCA' when '2' then 'Confirma' when '3' then 'MODIFICA' when '4' then 'x' else '' end as b from orders)
  select a, b, case when a = '' then 'SIN FALLO' when b = '' or b = 'Confirma' then case when a[1] = 'C' then 'DESFAVORABLE' else 'FAVORABLE' end
    when b = 'REVOCA' then case when a[1] = 'C' then 'FAVORABLE' else 'DESFAVORABLE' end when b = 'MODIFICA' then 'MODIFICADO' else 'OTRO' end as result, count(*) as n from r group by all""")
def f12_final_ruling(t: Tables):
    a = F.when(F.col("o_orderstatus") == "F", "CONCEDE PARCIALMENTE").when(F.col("o_orderstatus") == "O", "niega ").otherwise("")
    p = F.left("o_orderpriority", F.lit(1))
    b = F.when(p == "1", "REVOCA").when(p == "2", "Confirma").when(p == "3", "MODIFICA").when(p == "4", "x").otherwise("")
    return t.orders.select(a.alias("a"), b.alias("b")).groupBy("a", "b", final_ruling(F.col("a"), F.col("b")).alias("result")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, md5(string_agg(l_partkey::varchar, '|' order by l_partkey::varchar)) as fingerprint from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def f30_fingerprint(t: Tables):
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("p"))  # a few lines an order
    return d.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", array_fingerprint(F.col("p")).alias("fingerprint"))


@query("""select event_id, json_extract(props, '$.k')::bigint as k from events""")
def f50_json(t: Tables):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_COSINE = """with p as (select a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a join embeddings b on {same} and a.vec_id < b.vec_id) select * from p where similarity >= {least}"""


@query(_COSINE.format(same="a.label = b.label", least=0.3))
def f49_cosine(t: Tables):
    return vectors.cosine_pairs(t.embeddings, "vec_id", "embedding", 0.3, "label")


@query(_COSINE.format(same="true", least=0.35))
def f49_cosine_threshold(t: Tables):
    return vectors.cosine_pairs(t.embeddings, "vec_id", "embedding", 0.35)


@query(r"""select page_id, regexp_extract(url, '://([^/]+)', 1) as host, len(regexp_extract_all(html, '<a ')) as links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def x26_page_fields(t: Tables):
    links = F.size(F.regexp_extract_all("html", F.lit("(<a )"), F.lit(1))).cast("bigint")
    return t.pages.select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), links.alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(r"""with d as (select doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as mails, list_distinct(regexp_extract_all(text, 'https?://[^ \n]+')) as urls from documents)
  select doc_id, len(mails) as mails, len(urls) as urls from d where len(mails) + len(urls) > 0""")
def x25_identifiers(t: Tables):
    found = lambda p: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)))).cast("bigint")
    d = t.documents.select("doc_id", found(privacy.PATTERNS["EMAIL"]).alias("mails"), found(r"https?://[^ \n]+").alias("urls"))
    return d.where("mails + urls > 0")


@query("""with c as (select item_id, unnest([('one', position('the' in lower(text))), ('two', position('of' in lower(text))), ('three', position('and' in lower(text)))]) as x from benchmark)
  select item_id, x[1] as first, x[2]::int as at from (select *, row_number() over (partition by item_id order by x[2], x[1]) as k from c where x[2] > 0) where k = 1""")
def x19_earliest(t: Tables):
    marks = {"one": "the", "two": "of", "three": "and"}
    hits = F.array(*(F.struct(F.instr(F.lower("text"), F.lit(w)).alias("at"), F.lit(n).alias("first")) for n, w in marks.items()))
    best = F.array_min(F.filter(hits, lambda h: h["at"] > 0))
    return t.benchmark.select("item_id", best["first"].alias("first"), best["at"].alias("at")).where("at is not null")


@query(r"""with t as (select doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') as w from documents),
  c as (select doc_id, len(w) as size, len(list_filter(w, lambda x: x = 'the')) as f0, len(list_filter(w, lambda x: x = 'thing')) as f1 from t),
  a as (select count(*) as docs, avg(size) as mean, count(*) filter (f0 > 0) as n0, count(*) filter (f1 > 0) as n1 from c)
  select doc_id, -((case when f0 > 0 then greatest(ln((docs - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * size / mean)) else 0 end)
    + (case when f1 > 0 then greatest(ln((docs - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * size / mean)) else 0 end)) as score from c, a where f0 > 0 or f1 > 0""")
def n01_search(t: Tables):
    return search.bm25(t.documents, "doc_id", "text", ["the", "thing"], every=False)


@query(r"""with w as (select doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) as term from documents)
  select term, count(*) as tf, count(distinct doc_id) as df from w group by 1""")
def n04_index(t: Tables):
    return search.term_totals(t.documents, "text")


@query()
def r01_spans(t: Tables):
    # all kinds, vetoes and overlaps settled, on whole texts
    return redaction.detected(t.documents, "doc_id", "source", "text")


@query("""select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as email from documents where len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) > 0""")
def r09_gate(t: Tables):
    return t.documents.select("doc_id", privacy.gate(F.col("text"))["email"].alias("email")).where("email > 0")
