"""Aggregation queries: KPIs, rates, trends, percentiles, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.compat import filled_trim, like_ci, normal_name, share, title_case, top_k
from lexmill.plans.catalogue import Tables, query

NOW = "2024-01-15 12:00:00"


@query("""select trim(o_orderpriority) as court, count(*) as total, count(*) filter (o_orderstatus = 'F') as favourable,
  100.0 * count(*) filter (o_orderstatus = 'F') / count(*) as rate from orders where o_orderstatus <> 'P' group by 1 order by total desc, court limit 20""")
def a01_favorability(t: Tables):
    d = t.orders.where("o_orderstatus <> 'P'").groupBy(F.left(F.btrim("o_orderpriority"), F.lit(80)).alias("court"))
    d = d.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("favourable"))
    return top_k(d.withColumn("rate", share(F.col("favourable"), F.col("total"))), "total", 20, "court")


@query("""select o_orderstatus as result, o_orderpriority as appellant, count(*) as n from orders where o_totalprice > 100000
  group by grouping sets ((o_orderstatus), (o_orderpriority), ())""")
def a02_appeals(t: Tables):
    text = "select o_orderstatus as result, o_orderpriority as appellant, count(*) as n from {d} group by grouping sets ((o_orderstatus), (o_orderpriority), ())"
    return t.spark.sql(text, d=t.orders.where("o_totalprice > 100000"))


@query("""select c_mktsegment as lawyer, count(*) as total, count(*) filter (o_orderstatus = 'O') as active, count(*) filter (o_orderstatus <> 'O') as ruled,
  count(*) filter (o_orderstatus = 'F') as favourable, 100.0 * count(*) filter (o_orderstatus = 'F') / greatest(count(*) filter (o_orderstatus <> 'O'), 1) as rate
  from orders join customer on o_custkey = c_custkey group by 1""")
def a03_performers(t: Tables):
    d = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    s = F.col("o_orderstatus")
    d = d.groupBy(F.col("c_mktsegment").alias("lawyer")).agg(
        F.count("*").alias("total"), F.count_if(s == "O").alias("active"), F.count_if(s != "O").alias("ruled"), F.count_if(s == "F").alias("favourable")
    )
    return d.withColumn("rate", 100.0 * F.col("favourable") / F.greatest(F.col("ruled"), F.lit(1)))


@query("""select strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1""")
def a04_monthly_trend(t: Tables):
    # dates as the D/M/YYYY strings that cases hold; the parts are not validated
    part = F.split(F.date_format("o_orderdate", "dd/MM/yyyy"), "/")
    return t.orders.where(F.size(part) == 3).groupBy(F.concat_ws("-", part[2], part[1]).alias("month")).agg(F.count("*").alias("n"))


@query("""select w as word, count(*) as n from (select upper(trim(unnest(string_split(p_name, ' ')))) as w from part) where length(w) > 2
  group by 1 order by n desc, word limit 15""")
def a05_multivalue(t: Tables):
    d = t.part.select(F.explode(F.split("p_name", " ")).alias("w")).select(F.upper(F.btrim("w")).alias("word")).where(F.length("word") > 2)
    return top_k(d.groupBy("word").agg(F.count("*").alias("n")), "n", 15, "word")


@query("""with c as (select o_orderpriority as court, upper(o_orderstatus) as outcome, count(*) as n from orders group by 1, 2),
  r as (select *, sum(n) over (partition by court) as total, row_number() over (partition by court order by n desc, outcome) as k from c)
  select court, case when total < 3 then 'INSUFICIENTE' else outcome end as outcome, n, (1.0 * n / total)::double as confidence from r where k = 1""")
def a06_outcome_mode(t: Tables):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("court"), F.upper("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"))
    best = c.groupBy("court").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "outcome")).alias("b"))
    outcome = F.when(F.col("total") < 3, "INSUFICIENTE").otherwise(F.col("b.outcome"))
    return best.select("court", outcome.alias("outcome"), (-F.col("b.m")).alias("n"), (-F.col("b.m") / F.col("total")).alias("confidence"))


@query("""select count(*) as total, count(*) filter (upper(o_orderstatus) = 'O') as active, count(*) filter (upper(o_orderstatus) = 'F') as closed,
  count(*) filter (upper(o_orderstatus) = 'P') as pending, count(*) filter (o_orderpriority ilike '%urgent%') as urgent,
  count(*) filter (o_orderpriority ilike '%low%') as low, count(*) filter (o_orderpriority ilike '%high%' or o_orderpriority ilike '%urgent%') as high,
  count(*) filter (o_totalprice >= 200000) as large, count(*) filter (year(o_orderdate) = 1996) as filed_1996,
  count(*) - count(*) filter (upper(o_orderstatus) = 'O') - count(*) filter (upper(o_orderstatus) = 'F') as without_state from orders""")
def a07_fused_kpi(t: Tables):
    s, p = F.upper("o_orderstatus"), F.col("o_orderpriority")
    d = t.orders.agg(
        F.count("*").alias("total"),
        F.count_if(s == "O").alias("active"),
        F.count_if(s == "F").alias("closed"),
        F.count_if(s == "P").alias("pending"),
        F.count_if(like_ci(p, "urgent")).alias("urgent"),
        F.count_if(like_ci(p, "low")).alias("low"),
        F.count_if(like_ci(p, "high") | like_ci(p, "urgent")).alias("high"),
        F.count_if(F.col("o_totalprice") >= 200000).alias("large"),
        F.count_if(F.year("o_orderdate") == 1996).alias("filed_1996"),
    )
    return d.withColumn("without_state", F.col("total") - F.col("active") - F.col("closed"))


@query("""select 100.0 * count(*) filter (text <> '') / count(*) as text_pct, 100.0 * count(*) filter (lang <> '') / count(*) as lang_pct,
  100.0 * count(quality) / count(*) as quality_pct, 100.0 * count(toxic) / count(*) as toxic_pct from documents left join labels using (doc_id)""")
def a08_completeness(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    filled = {"text": F.col("text") != "", "lang": F.col("lang") != "", "quality": F.col("quality").isNotNull(), "toxic": F.col("toxic").isNotNull()}
    n = d.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in filled.items()))
    return n.select(*(share(F.col(k), F.col("n")).alias(f"{k}_pct") for k in filled))


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P"
  from orders group by 1""")
def a09_distribution(t: Tables):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""with q as (select count(*) as n, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as bad from labels),
  d as (select count(*) as docs, count(*) filter (trim(text, e' \\t\\n') <> '') as filled from documents)
  select 100.0 * filled / docs as doc_score, 100.0 * (good + 0.3 * bad) / n as confidence, 0.3 * (100.0 * filled / docs) + 0.7 * (100.0 * (good + 0.3 * bad) / n) as reliability from q, d""")
def a10_quality_blend(t: Tables):
    q = t.labels.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    d = t.documents.agg(F.count("*").alias("docs"), F.count_if(F.btrim("text", F.lit(" \t\n")) != "").alias("filled"))
    both = d.join(F.broadcast(q)).select(share(F.col("filled"), F.col("docs")).alias("doc_score"), share(F.col("good") + 0.3 * F.col("bad"), F.col("n")).alias("confidence"))
    return both.withColumn("reliability", 0.3 * F.col("doc_score") + 0.7 * F.col("confidence"))


@query("""select regexp_replace(upper(n_name), '[0-9]+', '', 'g') as city, count(*) as n from supplier join nation on s_nationkey = n_nationkey
  group by 1 order by n desc, city limit 10""")
def a11_normalised_top(t: Tables):
    d = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return top_k(d.groupBy(F.regexp_replace(normal_name(F.col("n_name")), "[0-9]+", "").alias("city")).agg(F.count("*").alias("n")), "n", 10, "city")


@query("""with c as (select count(*) as total, count(*) filter (p_type ilike '%e%') as a, count(*) filter (p_type ilike '%o%') as b from part)
  select total, a, b, total - a - b as pending from c""")
def a12_overlapping(t: Tables):
    # texts that match both rules count twice, so pending may be negative: that is the operator's definition
    d = t.part.agg(F.count("*").alias("total"), F.count_if(like_ci(F.col("p_type"), "e")).alias("a"), F.count_if(like_ci(F.col("p_type"), "o")).alias("b"))
    return d.withColumn("pending", F.col("total") - F.col("a") - F.col("b"))


@query("""select c_mktsegment[1] || lower(c_mktsegment[2:]) as office, count(*) as n from customer group by 1""")
def a14_by_office(t: Tables):
    return t.customer.groupBy(F.left(title_case(F.btrim("c_mktsegment")), F.lit(40)).alias("office")).agg(F.count("*").alias("n"))


@query("""select avg(d) as avg_days, min(d) as min_days, max(d) as max_days, count(*) as n from (
  select date_diff('day', o_orderdate::date, l_shipdate::date) as d from orders join lineitem on o_orderkey = l_orderkey) where d between 0 and 365""")
def a16_response_days(t: Tables):
    d = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    d = d.select(F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("d")).where("d between 0 and 365")
    return d.agg(F.avg("d").alias("avg_days"), F.min("d").alias("min_days"), F.max("d").alias("max_days"), F.count("*").alias("n"))


@query("""select event_type as model, count(*) as calls, count(distinct user_id) as cases, (sum(value::decimal(18,6)))::double as cost
  from events where ts >= '2024-01-05' and ts < '2024-01-20' group by 1""")
def a17_period_metrics(t: Tables):
    d = t.events.where("ts >= '2024-01-05' and ts < '2024-01-20'")
    cost = F.sum(F.col("value").cast("decimal(18,6)")).cast("double")
    return d.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("cases"), cost.alias("cost"))


@query("""select event_type, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95, max(value) as longest from events where value > 0 group by 1""")
def a18_percentiles(t: Tables):
    return t.events.where("value > 0").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("longest"))


@query("""select count(*) as calls, count(*) filter (event_type = 'error') as errors, count(*) filter (regexp_matches(props, '(429|rate|limit)')) as limited,
  100.0 * count(*) filter (event_type = 'error') / count(*) as pct from events""")
def a19_errors(t: Tables):
    d = t.events.agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("props").rlike("(429|rate|limit)")).alias("limited"))
    return d.withColumn("pct", share(F.col("errors"), F.col("calls")))


@query("""select field, count(*) filter (v <> '') as filled, 100.0 * count(*) filter (v <> '') / count(*) as pct from (
  select unnest(['c_name', 'c_mktsegment', 'large_balance']) as field, unnest([c_name, c_mktsegment, case when c_acctbal > 5000 then 'x' end]) as v from customer) group by 1""")
def a20_coverage(t: Tables):
    d = t.customer.withColumn("large_balance", F.when(F.col("c_acctbal") > 5000, "x"))
    long = d.unpivot(["c_custkey"], ["c_name", "c_mktsegment", "large_balance"], "field", "v")
    out = long.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("v") != "").alias("filled"))
    return out.select("field", "filled", share(F.col("filled"), F.col("n")).alias("pct"))


@query("""select 1000.0 * sum(value::decimal(18,6))::double / count(distinct user_id) as cost_1000, 1000.0 * count(*) / count(distinct user_id) as calls_1000 from events""")
def a21_projection(t: Tables):
    n = F.count_distinct("user_id")
    return t.events.agg((1000.0 * F.sum(F.col("value").cast("decimal(18,6)")).cast("double") / n).alias("cost_1000"), (1000.0 * F.count("*") / n).alias("calls_1000"))


@query(f"""select count(*) as calls, count(*) filter (ts >= date_trunc('day', timestamp '{NOW}')) as today, count(*) filter (ts >= date_trunc('month', timestamp '{NOW}')) as month,
  (select event_type from events where ts < '{NOW}' group by 1 order by count(*) desc, event_type limit 1) as top_type from events where ts < '{NOW}'""")
def a22_usage(t: Tables):
    d, now = t.events.where(F.col("ts") < NOW), F.lit(NOW).cast("timestamp")
    by = d.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.date_trunc("day", now)).alias("d"), F.count_if(F.col("ts") >= F.date_trunc("month", now)).alias("m"))
    top = F.min(F.struct(-F.col("n"), "event_type"))["event_type"]
    return by.agg(F.sum("n").alias("calls"), F.sum("d").alias("today"), F.sum("m").alias("month"), top.alias("top_type"))


@query("""select event_type, user_id % 3 as severity, count(*) as n from events group by rollup (event_type, user_id % 3)""")
def a24_rollup(t: Tables):
    return t.events.withColumn("severity", F.col("user_id") % 3).rollup("event_type", "severity").agg(F.count("*").alias("n"))


@query("""select event_type, count(*) as n, count(distinct user_id) as users from events group by 1""")
def a25_distinct_counts(t: Tables):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""select coalesce(quality::varchar, 'NULL') as status, count(*) as n from documents left join labels using (doc_id) group by 1""")
def a26_histogram(t: Tables):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("NULL")).alias("status")).agg(F.count("*").alias("n"))


@query("""select event_type || ':' || left(props, 30) as pattern, count(*) as n, arg_min(event_id, event_id) as sample from events group by 1 having count(*) >= 3""")
def a32_patterns(t: Tables):
    d = t.events.groupBy(F.concat_ws(":", "event_type", F.left("props", F.lit(30))).alias("pattern"))
    return d.agg(F.count("*").alias("n"), F.min("event_id").alias("sample")).where("n >= 3")


@query("""with o as (select count(*) as cases, count(*) filter (o_orderstatus = 'P') as suspicious, count(*) filter (o_totalprice < 1000) as missing from orders),
  e as (select count(*) as empty from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)),
  d as (select coalesce(sum(n - 1), 0) as dup from (select count(*) as n from lineitem group by l_orderkey, l_partkey having count(*) > 1))
  select cases, (2 * dup + suspicious + missing + empty)::bigint as issues,
    greatest(0.0, least(100.0, 100.0 - 100.0 * (2 * dup + suspicious + missing + empty)::double / (20 * cases))) as score from o, e, d""")
def a36_purity(t: Tables):
    o = t.orders.agg(F.count("*").alias("cases"), F.count_if(F.col("o_orderstatus") == "P").alias("suspicious"), F.count_if(F.col("o_totalprice") < 1000).alias("missing"))
    e = t.orders.select(F.col("o_orderkey").alias("l_orderkey")).join(t.lineitem.select("l_orderkey"), "l_orderkey", "left_anti").agg(F.count("*").alias("empty"))
    d = t.lineitem.groupBy("l_orderkey", "l_partkey").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("dup"))
    x = o.join(F.broadcast(e)).join(F.broadcast(d))  # one row each
    x = x.withColumn("issues", 2 * F.col("dup") + F.col("suspicious") + F.col("missing") + F.col("empty"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - 100.0 * F.col("issues") / (20 * F.col("cases"))))
    return x.select("cases", "issues", score.alias("score"))


@query("""select coalesce(a.t, b.t) as metric, coalesce(x, 0) as before, coalesce(y, 0) as after, case when coalesce(y, 0) > coalesce(x, 0) then 'up' when coalesce(y, 0) < coalesce(x, 0) then 'down' else 'same' end as trend
  from (select event_type as t, count(*) as x from events where ts < '2024-01-15' group by 1) a full join (select event_type as t, count(*) as y from events where ts >= '2024-01-15' group by 1) b on a.t = b.t""")
def a37_compare(t: Tables):
    half = lambda c, n: t.events.where(c).groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias(n))
    d = half("ts < '2024-01-15'", "before").join(half("ts >= '2024-01-15'", "after"), "metric", "full").na.fill(0)
    return d.withColumn("trend", F.when(F.col("after") > F.col("before"), "up").when(F.col("after") < F.col("before"), "down").otherwise("same"))


@query("""with a as (select doc_id, unnest(['quality', 'toxic']) as field, unnest([case when n_chars > 200 then 1 else 0 end, case when n_chars % 7 = 0 then 1 end]) as regex from documents),
  b as (select doc_id, unnest(['quality', 'toxic']) as field, unnest([quality, nullif(toxic, 0)]) as stored from labels)
  select field, case when regex = stored then 'match' when regex is not null and stored is not null then 'mismatch' when stored is not null then 'db_only' when regex is not null then 'regex_only' else 'none' end as status, count(*) as n
  from a join b using (doc_id, field) group by 1, 2""")
def a41_field_matrix(t: Tables):
    a = t.documents.select("doc_id", F.when(F.col("n_chars") > 200, 1).otherwise(0).alias("quality"), F.when(F.col("n_chars") % 7 == 0, 1).alias("toxic"))
    b = t.labels.select("doc_id", F.col("quality").cast("int"), F.nullif(F.col("toxic"), F.lit(0)).cast("int").alias("toxic"))
    long = lambda d, v: d.unpivot(["doc_id"], ["quality", "toxic"], "field", v)
    x, y = F.col("regex"), F.col("stored")
    status = F.when(x == y, "match").when(x.isNotNull() & y.isNotNull(), "mismatch").when(y.isNotNull(), "db_only").when(x.isNotNull(), "regex_only").otherwise("none")
    return long(a, "regex").join(long(b, "stored"), ["doc_id", "field"]).groupBy("field", status.alias("status")).agg(F.count("*").alias("n"))


@query("""select doc_id, ((length(trim(text, e' \\t\\n')) > 0)::int + (lang <> '')::int + (quality is not null)::int + (toxic is not null)::int) * 100 // 4 as completeness
  from documents left join labels using (doc_id)""")
def p09_completeness(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    parts = [filled_trim(F.regexp_replace("text", r"[\t\n]", " ")), filled_trim(F.col("lang")), F.col("quality").isNotNull(), F.col("toxic").isNotNull()]
    total = sum((p.cast("int") for p in parts), F.lit(0))
    return d.select("doc_id", (F.floor(total * 100 / 4)).cast("int").alias("completeness"))


@query("""select case when n_chars < 100 then 'short' when lang not in ('en', 'es') then 'other_language' when source in ('src0', 'src1') then 'source' else 'valid' end as reason, count(*) as n
  from documents group by 1""")
def p15_exclusions(t: Tables):
    from lexmill.operators.relational import exclusion_reason

    rules = [("short", F.col("n_chars") < 100), ("other_language", ~F.col("lang").isin("en", "es")), ("source", F.col("source").isin("src0", "src1"))]
    return t.documents.groupBy(exclusion_reason(rules).alias("reason")).agg(F.count("*").alias("n"))
