"""Filters, joins, ranking, sets, duplicates, matching and mutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.compat import digits, floor_days, like_ci
from lexmill.functions.cases import severity, traffic_light
from lexmill.operators import dedup, relational
from lexmill.plans.catalogue import Tables, query

NOW = "1998-06-01 12:00:00"


@query("""select o_orderkey, o_orderstatus, o_totalprice from orders where (o_orderpriority ilike '%urgent%' or o_orderpriority ilike '%high%') and o_orderstatus = 'F'
  order by o_orderkey desc limit 20 offset 20""")
def p03_paged_list(t: Tables):
    d = t.orders.where((like_ci(F.col("o_orderpriority"), "urgent") | like_ci(F.col("o_orderpriority"), "high")) & (F.col("o_orderstatus") == "F"))
    return relational.page(d.select("o_orderkey", "o_orderstatus", "o_totalprice"), [F.desc("o_orderkey")], 2, 20)


@query("""select c_custkey, c_name, c_mktsegment from customer where c_custkey::varchar like '%77%' or c_name ilike '%77%' or c_mktsegment ilike '%77%'""")
def p06_any_column(t: Tables):
    return relational.any_column_contains(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "77")


@query("""select c_custkey as "ID", coalesce(c_name, '') as "NAME", coalesce(nullif(c_mktsegment, 'BUILDING'), '') as "SEGMENT" from customer""")
def p08_dictionary(t: Tables):
    names = {"c_name": "NAME", "segment": "SEGMENT"}
    d = t.customer.withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return d.select(F.col("c_custkey").alias("ID"), *(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in names.items()))


@query("""select 'segment' as field, list_sort(list(distinct c_mktsegment)) as options from customer union all
  select 'nation', list_sort(list(distinct c_nationkey::varchar)) from customer""")
def p17_filter_options(t: Tables):
    d = t.customer.select(F.collect_set("c_mktsegment").alias("segment"), F.collect_set(F.col("c_nationkey").cast("string")).alias("nation"))
    d = d.select(F.array_sort("segment").alias("segment"), F.array_sort("nation").alias("nation"))
    return d.unpivot([], ["segment", "nation"], "field", "options")


@query("""select doc_id, list_filter([case when quality is null then 'quality' end, case when toxic is null then 'toxic' end, case when n_chars < 50 then 'text' end], lambda x: x is not null) as missing
  from documents left join labels using (doc_id)""")
def p18_missing_fields(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    names = F.array(*(F.when(c, n) for c, n in ((F.col("quality").isNull(), "quality"), (F.col("toxic").isNull(), "toxic"), (F.col("n_chars") < 50, "text"))))
    return d.select("doc_id", F.filter(names, lambda x: x.isNotNull()).alias("missing"))


@query("""select doc_id, replace(left(text, 80), chr(10), ' ') || case when length(text) > 80 then '...' else '' end as preview from documents""")
def p19_preview(t: Tables):
    cut = F.regexp_replace(F.left("text", F.lit(80)), "\n", " ")
    return t.documents.select("doc_id", F.concat(cut, F.when(F.length("text") > 80, "...").otherwise("")).alias("preview"))


@query("""select o_orderpriority, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1""")
def j01_inner(t: Tables):
    d = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return d.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""select o_orderkey, l_partkey, l_quantity from orders left join lineitem on l_orderkey = o_orderkey and l_linenumber = o_orderkey % 7 + 1""")
def j02_left_composite(t: Tables):
    o = t.orders.select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("line"))
    x = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"), "l_partkey", "l_quantity")
    return o.join(x, ["o_orderkey", "line"], "left").drop("line")


@query("""select o_orderkey, o_orderstatus from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 48)""")
def j05_semi(t: Tables):
    big = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_orderstatus").join(big, "o_orderkey", "left_semi")


@query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and year(o_orderdate) = 1996)""")
def j07_anti(t: Tables):
    seen = t.orders.where(F.year("o_orderdate") == 1996).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("""select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as closed from customer""")
def j10_correlated(t: Tables):
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").na.fill(0)


@query("""select s_suppkey, coalesce(case when n_nationkey < 20 then n_name end, '') as city from supplier left join nation on n_nationkey = s_nationkey""")
def j13_lookup(t: Tables):
    known = t.nation.where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("city"))


@query(r"""select c_custkey, s_suppkey from customer join supplier on left(regexp_replace(c_name, '\D', '', 'g'), 8) = left(regexp_replace(s_name, '\D', '', 'g'), 8)""")
def j14_prefix_key(t: Tables):
    key = lambda c: F.left(digits(F.col(c)), F.lit(8))
    return t.customer.select("c_custkey", key("c_name").alias("k")).join(t.supplier.select("s_suppkey", key("s_name").alias("k")), "k").drop("k")


@query(r"""select c_custkey, s_suppkey from customer join supplier on left(regexp_replace(c_name, '\D', '', 'g'), 5) = left(regexp_replace(s_name, '\D', '', 'g'), 5)
  and right(regexp_replace(c_name, '\D', '', 'g'), 3) = right(regexp_replace(s_name, '\D', '', 'g'), 3)""")
def j15_prefix_suffix(t: Tables):
    keys = lambda c: (F.left(digits(F.col(c)), F.lit(5)).alias("a"), F.right(digits(F.col(c)), F.lit(3)).alias("b"))
    return t.customer.select("c_custkey", *keys("c_name")).join(t.supplier.select("s_suppkey", *keys("s_name")), ["a", "b"]).drop("a", "b")


@query(r"""select a.s_suppkey as own, b.c_custkey as other from supplier a join customer b on right(regexp_replace(s_name, '\D', '', 'g'), 3) = right(regexp_replace(c_name, '\D', '', 'g'), 3) and s_suppkey <> c_custkey""")
def j16_suffix_other(t: Tables):
    a = t.supplier.select(F.col("s_suppkey").alias("own"), F.right(digits(F.col("s_name")), F.lit(3)).alias("k"))
    b = t.customer.select(F.col("c_custkey").alias("other"), F.right(digits(F.col("c_name")), F.lit(3)).alias("k"))
    return a.join(b, "k").where("own <> other").drop("k")


_PART_WORDS = "list_sort(list_distinct(string_split(lower(p_name || ' ' || p_brand || ' ' || p_type), ' ')))"


@query(f"""with c as (select min(p_partkey) as id, count(*) as n, {_PART_WORDS} as w from part group by w), t as (select id, n, unnest(w) as w from c),
  p as (select a.id as a, b.id as b, count(*) as shared, any_value(a.n) as n_a, any_value(b.n) as n_b from t a join t b on a.w = b.w and a.id < b.id group by 1, 2) select * from p where shared >= 2""")
def j19_token_overlap(t: Tables):
    return relational.token_classes(t.part, "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " "), 2)


@query(f"""with s as (select p_partkey as id, {_PART_WORDS} as w from part), p as (select a.id as a, b.id as b, len(list_intersect(a.w, b.w)) as shared from s a join s b on a.id < b.id) select * from p where shared >= 3""")
def j19_token_overlap_all(t: Tables):
    # every pair of parts, copies too
    return relational.token_overlap_by_set(t.part, "p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), " "), 3)


@query("""select p_partkey, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['red', 'small', 'steel', 'part'])) as shared from part""")
def u03_intersection(t: Tables):
    wanted = F.array(*map(F.lit, ("red", "small", "steel", "part")))
    return t.part.select("p_partkey", F.size(F.array_intersect(F.split(F.lower("p_name"), " "), wanted)).cast("bigint").alias("shared"))


_WHOLE = "select lang, source, sha256(text) as hash, count(*) as n, min(doc_id) as canonical from documents group by 1, 2, 3 having count(*) > 1"


@query(_WHOLE)
def d01_identity_groups(t: Tables):
    return dedup.identity_groups(t.documents, F.struct("lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("hash")), "doc_id")


@query(_WHOLE.replace("lang, source, sha256", "lang, sha256").replace("1, 2, 3", "1, 2"))
def d01_identity_whole(t: Tables):
    # of a language, whatever the source
    return dedup.identity_groups(t.documents, F.struct("lang", F.sha2(F.col("text").cast("binary"), 256).alias("hash")), "doc_id")


@query("""select md5(text) as hash, count(*) as n, count(distinct source) as owners, case when count(distinct source) = 1 then count(*) - 1 else 0 end as removable,
  case when count(distinct source) > 1 then count(*) - count(distinct source) else 0 end as reviewable from documents group by 1 having count(*) > 1""")
def d05_hash_duplicates(t: Tables):
    return dedup.hash_duplicates(t.documents, "text", "source")


_SIMILAR = """with r as (select doc_id, source, text, list_distinct(list_transform(range(1, length(text) - 1), lambda i: hash(substr(lower(text), i, 3)))) as g from documents where length(text) > 200),
  p as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.g, b.g)) / greatest(len(a.g), len(b.g)) as overlap from r a join r b on a.doc_id < b.doc_id{same} and a.text <> b.text and least(len(a.g), len(b.g)) > 0.9 * greatest(len(a.g), len(b.g)))
  select * from p where overlap > 0.9"""


@query(_SIMILAR.format(same=" and a.source is not distinct from b.source"))
def d06_similar_in_block(t: Tables):
    return dedup.similar_texts(t.documents, "doc_id", "text", block="source")


@query(_SIMILAR.format(same=""))
def d06_similar_texts(t: Tables):
    return dedup.similar_texts(t.documents, "doc_id", "text")


@query()
def d18_greedy_clusters(t: Tables):
    return dedup.greedy_clusters(t.embeddings, "vec_id", "embedding", None, 0.3)


@query("""with m as (select o_custkey as old, min(o_custkey) over (partition by c_mktsegment, c_nationkey) as new from (select distinct o_custkey from orders) join customer on c_custkey = o_custkey)
  select o_orderkey, new as o_custkey, new <> old as moved from orders join m on old = o_custkey""")
def m04_remap(t: Tables):
    # cases of one identity are merged into the one of smallest id; rows that point to the others move
    owner = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().join(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    canonical = owner.groupBy("c_mktsegment", "c_nationkey").agg(F.min("c_custkey").alias("new"))
    to = owner.join(canonical, ["c_mktsegment", "c_nationkey"]).select(F.col("c_custkey").alias("o_custkey"), "new")
    d = t.orders.select("o_orderkey", "o_custkey").join(to, "o_custkey")
    return d.select("o_orderkey", F.col("new").alias("o_custkey"), (F.col("new") != F.col("o_custkey")).alias("moved"))


@query("""select doc_id from (select doc_id, row_number() over (partition by source, md5(text) order by doc_id) as k from documents) where k > 1""")
def m11_purge(t: Tables):
    d = t.documents.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("hash"))
    first = d.groupBy("source", "hash").agg(F.min("doc_id").alias("doc_id"))
    return dedup.purge(d, first, ["source", "hash"], "doc_id").select("doc_id")


@query("""select doc_id, 'quality' as field, quality as old, case when n_chars < 300 then 0 else quality end as new from labels join documents using (doc_id) where quality <> case when n_chars < 300 then 0 else quality end""")
def m01_audited_update(t: Tables):
    # the plan of an update is its audit rows: what changes, from what, to what
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("new", F.when(F.col("n_chars") < 300, 0).otherwise(F.col("quality")))
    return d.where("quality <> new").select("doc_id", F.lit("quality").alias("field"), F.col("quality").alias("old"), F.col("new").cast("int").alias("new"))


@query(f"""with e as (
  select o_orderkey, 'ruling' as kind, o_orderdate + interval 48 hour as due from orders where o_orderstatus = 'O' and o_orderpriority like '1%' union all
  select o_orderkey, 'incident', o_orderdate from orders where o_orderstatus = 'O' and o_orderpriority like '2%' union all
  select o_orderkey, 'appeal', null from orders where o_orderstatus = 'O' and o_totalprice > 300000),
  d as (select *, floor((epoch_us(due) - epoch_us(timestamp '{NOW}')) / 86400000000)::bigint as days from e)
  select o_orderkey, kind, days, case when kind = 'appeal' then 'INFO' when days < 0 then 'VENCIDO' when days < 3 then 'URGENTE' else 'EN_PLAZO' end as severity from d""")
def e05_calendar(t: Tables):
    now, at, p = F.lit(NOW).cast("timestamp"), F.col("o_orderdate").cast("timestamp"), F.col("o_orderpriority")
    event = lambda kind, due: F.struct(F.lit(kind).alias("kind"), due.alias("due"))
    rules = F.array(
        F.when(p.startswith("1"), event("ruling", at + F.expr("interval 48 hours"))),
        F.when(p.startswith("2"), event("incident", at)),
        F.when(F.col("o_totalprice") > 300000, event("appeal", F.lit(None).cast("timestamp"))),
    )
    d = t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("e"))
    days = floor_days(F.col("e.due"), now)
    return d.select("o_orderkey", "e.kind", days.alias("days"), F.when(F.col("e.kind") == "appeal", "INFO").otherwise(severity(days)).alias("severity"))


@query(f"""with d as (select o_orderkey, o_orderstatus as s, floor((epoch_us(o_orderdate + interval 30 day) - epoch_us(timestamp '{NOW}')) / 86400000000) as n from orders)
  select case when s = 'F' then 'CUMPLIDO' when s = 'P' then 'IMPUGNADO' when n < 0 then 'VENCIDO' when n <= 3 then 'URGENTE' when n <= 7 then 'POR_VENCER' else 'EN_PLAZO' end as light, count(*) as n from d group by 1""")
def a34_traffic_light(t: Tables):
    state = F.when(F.col("o_orderstatus") == "F", "CUMPLIDO").when(F.col("o_orderstatus") == "P", "IMPUGNADO").otherwise("PENDIENTE")
    light = traffic_light(state, F.col("o_orderdate").cast("timestamp") + F.expr("interval 30 days"), F.lit(NOW).cast("timestamp"))
    return t.orders.groupBy(light.alias("light")).agg(F.count("*").alias("n"))


@query("""select o_orderkey as id, 'empty' as kind from orders where o_orderstatus = 'O' and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'N')
  union all select o_orderkey, 'large' from orders where o_totalprice > 400000 union all select c_custkey, 'negative' from customer where c_acctbal < 0""")
def u07_alerts(t: Tables):
    kept = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    kind = lambda d, key, name: d.select(F.col(key).alias("id"), F.lit(name).alias("kind"))
    empty = kind(t.orders.where("o_orderstatus = 'O'").join(kept, "o_orderkey", "left_anti"), "o_orderkey", "empty")
    large = kind(t.orders.where("o_totalprice > 400000"), "o_orderkey", "large")
    return empty.unionByName(large).unionByName(kind(t.customer.where("c_acctbal < 0"), "c_custkey", "negative"))
