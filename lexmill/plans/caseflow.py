"""Extraction, alerts, follow-up, changes of tables, search and privacy on cases, documents and mails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import classes, extract
from lexmill.functions.cases import severity
from lexmill.functions.compat import digits, filled_sql, floor_days, normal_name, parse_dmy
from lexmill.operators import matching, relational
from lexmill.plans.casework import DATE, DIGITS, DOC_CLASS, NAME
from lexmill.plans.casejoins import LONG, YEAR_SEQ
from lexmill.plans.world import World, case_query
from lexmill.streaming import flows

NOW = "2024-02-01 09:30:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


SHORT_SQL = r"""case when nullif(regexp_extract(x, '{p}', {y}), '') is not null then regexp_extract(x, '{p}', {y}) || '-' || repeat('0', greatest(5 - length(regexp_extract(x, '{p}', {n})), 0)::int) || regexp_extract(x, '{p}', {n}) end"""
T_SQL = SHORT_SQL.format(p=extract.SHORT_T, y=2, n=1)
LABEL_SQL, ANY_SQL = (SHORT_SQL.format(p=p, y=1, n=2) for p in (extract.SHORT_LABEL, extract.SHORT_ANY))


@case_query(rf"""with s as (select id, coalesce(text, '') as x from docs union all select -id - 1, coalesce(subject, '') from mails),
  l as (select id, x, coalesce(nullif(regexp_extract(x, '{extract.ID_WHOLE}', 1), ''), nullif(regexp_extract(x, '{extract.ID_PARTS}', 1), '')) as long_id from s), d as (select *, regexp_replace(long_id, '\D', '', 'g') as d from l)
  select id, long_id, coalesce(case when regexp_matches(d, '20\d\d\d{{5}}\d\d$') then regexp_extract(d, '(20\d\d)(\d{{5}})\d\d$', 1) || '-' || regexp_extract(d, '(20\d\d)(\d{{5}})\d\d$', 2) end, {T_SQL}, {LABEL_SQL}, {ANY_SQL}) as short from d""")
def x04_court_ids(t: World):
    d = t.docs.select("id", "text").unionByName(t.mails.select((-F.col("id") - 1).alias("id"), F.col("subject").alias("text")))
    return d.select("id", extract.court_ids(F.col("text")).alias("r")).select("id", "r.*")


@case_query(rf"""with f as (select case_id, id, {DOC_CLASS} as class, nullif(regexp_extract(coalesce(text, ''), '{extract.ID_WHOLE}', 1), '') as a, nullif(regexp_extract(coalesce(text, ''), '{extract.ID_PARTS}', 1), '') as b from docs),
  r as (select case_id, coalesce(a, b) as long_id, case when a is not null then 90 else 85 end as confidence, row_number() over (partition by case_id order by case class when 'PDF_AUTO_ADMISORIO' then 1 when 'PDF_SENTENCIA' then 2 else 3 end, (a is null)::int, id) as k from f where a is not null or b is not null)
  select case_id, long_id, confidence from r where k = 1""")
def x02_case_id_from_documents(t: World):
    whole, parts = (F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), p, 1), F.lit("")) for p in (extract.ID_WHOLE, extract.ID_PARTS))
    rank = F.when(F.col("class") == "PDF_AUTO_ADMISORIO", 1).when(F.col("class") == "PDF_SENTENCIA", 2).otherwise(3)
    d = t.docs.select("case_id", "id", classes.document_class(F.col("filename")).alias("class"), whole.alias("a"), parts.alias("b")).where("a is not null or b is not null")
    best = F.min_by(F.struct(F.coalesce("a", "b").alias("long_id"), F.when(F.col("a").isNotNull(), 90).otherwise(85).alias("confidence")), F.struct(rank, F.col("a").isNull(), "id"))
    return d.groupBy("case_id").agg(best.alias("b")).select("case_id", "b.*")


@case_query(rf"""with n as (select id, regexp_extract(coalesce(text, ''), '{extract.FILING_WORD}', 1) as n from docs) select id, n as filing from n where length(n) >= 7 and n not in ('3634740', '6076337000', '6076336100', '6076336000') and not starts_with(n, '68') and length(replace(n, n[1], '')) > 0""")
def x05_filings(t: World):
    return t.docs.select("id", extract.filing_number(F.col("text")).alias("filing")).where("filing is not null")


@case_query(f"""with k as (select case_id, {DOC_CLASS} as class from docs) select case_id, case when count(*) filter (class in ('PDF_IMPUGNACION', 'DOCX_IMPUGNACION')) > 0 then 'SI' else 'NO' end as appeal,
  case when count(*) filter (class in ('PDF_INCIDENTE', 'DOCX_DESACATO')) > 0 then 'SI' else 'NO' end as incident, case when count(*) filter (class in ('PDF_IMPUGNACION', 'PDF_INCIDENTE')) > 0 then 90 when count(*) filter (class in ('DOCX_IMPUGNACION', 'DOCX_DESACATO')) > 0 then 85 else 60 end as confidence from k group by 1""")
def x09_appeal_by_documents(t: World):
    k = t.docs.select("case_id", classes.document_class(F.col("filename")).alias("class"))
    any_of = lambda *c: F.max(F.col("class").isin(*c).cast("int")) > 0
    yes = lambda c: F.when(c, "SI").otherwise("NO")
    sure = F.when(any_of("PDF_IMPUGNACION", "PDF_INCIDENTE"), 90).when(any_of("DOCX_IMPUGNACION", "DOCX_DESACATO"), 85).otherwise(60)
    return k.groupBy("case_id").agg(yes(any_of("PDF_IMPUGNACION", "DOCX_IMPUGNACION")).alias("appeal"), yes(any_of("PDF_INCIDENTE", "DOCX_DESACATO")).alias("incident"), sure.alias("confidence"))


_HITS = ", ".join(f"case when regexp_matches(y, '{p}') then struct_pack(place := length(regexp_extract(y, '(?s)^(.*?)(?:' || '{p}' || ')', 1)), verb := '{v}') end" for v, p in extract.VERBS.items())


@case_query(rf"""with s as (select id, coalesce(text, '') as x from docs), d as (select id, regexp_extract(x, '(?i)((?:RESUELVE|PRIMERO)[\s\S]*)', 1) as y from s),
  h as (select id, unnest([{_HITS}]) as h from d where y <> '') select id, verb from (select id, h.verb as verb, row_number() over (partition by id order by h.place, h.verb) as k from h where h is not null) where k = 1""")
def x19_decision(t: World):
    return t.docs.select("id", extract.decision(F.col("text")).alias("verb")).where("verb is not null")


_ZONES = ", ".join(f"case when regexp_matches(x, '{p}') then {{s: length(regexp_extract(x, '(?s)^(.*?)(?:' || '{p}' || ')', 1)) + 1, z: '{z}'}} end" for z, p in extract.ZONES.items())


@case_query(rf"""with s as (select id, coalesce(text, '') as x from docs), h as (select id, length(x) as n, unnest([{_ZONES}]) as h from s)
  select id, h.z as zone, h.s::int as start, (coalesce(lead(h.s) over (partition by id order by h.s), n + 1) - 1)::int as "end" from h where h is not null""")
def x17_zones(t: World):
    d = t.docs.select("id", F.explode(extract.zones(F.col("text"))).alias("z"))
    return d.select("id", "z.zone", "z.start", "z.end")


_P, _M = "nullif(trim(coalesce(court, '')), '')", "nullif(trim(coalesce(case when id % 3 = 0 then upper(court) when id % 3 = 1 then city end, '')), '')"


@case_query(f"""with v as (select id, {_P} as p, {_M} as m, case when id % 2 = 0 then 'court' else 'claimant' end as field, (60 + id % 40)::int as c from cases)
  select id, case when p is null then m when m is null then p when contains(upper(p), upper(m)) or contains(upper(m), upper(p)) or field = 'court' then p else m end as value,
    case when p is null and m is null then 0 when m is null then c when p is null then 70 when contains(upper(p), upper(m)) or contains(upper(m), upper(p)) then least(100, greatest(c, 70) + 15) when field = 'court' then c else 70 end as confidence,
    case when p is null and m is null then 'none' when m is null then 'pattern' when p is null then 'model' when contains(upper(p), upper(m)) or contains(upper(m), upper(p)) then 'both' when field = 'court' then 'pattern' else 'model' end as source from v""")
def x15_merged_fields(t: World):
    model = F.when(F.col("id") % 3 == 0, F.upper("court")).when(F.col("id") % 3 == 1, F.col("city"))
    field = F.when(F.col("id") % 2 == 0, "court").otherwise("claimant")
    d = t.cases.select("id", extract.merged_value(field, F.col("court"), model, (60 + F.col("id") % 40).cast("int")).alias("m"))
    return d.select("id", "m.*")


@case_query()
def x27_belongs(t: World):
    c = t.cases.select(F.col("id").alias("case_id"), "folder", "court_id", "claimant")
    verdict = extract.belongs(F.col("filename"), F.col("text"), F.col("folder"), F.col("court_id"), F.col("claimant"))
    return t.docs.join(c, "case_id").select("id", "verified", verdict.alias("verdict"))


@case_query()
def m23_transitions(t: World):
    return x27_belongs(t).where("verified = 'SOSPECHOSO'").groupBy(F.col("verified").alias("old"), F.col("verdict").alias("new")).agg(F.count("*").alias("n"))


@case_query("""select case_id, count(*) as n, min(id) as first from (select *, count(*) over (partition by file_hash, case_id) as k from docs where verified = 'NO_PERTENECE') where k > 0 group by 1""")
def x28_verdict_counts(t: World):
    return t.docs.where("verified = 'NO_PERTENECE'").groupBy("case_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))


# --- alerts and follow-up ------------------------------------------------------------------------------------------------


def alerts(cases, docs, mails):
    """(case_id, mail_id, kind, severity, title): late answers and incidents, mails without a case, active cases without documents, odd values."""
    active = cases.where("state = 'ACTIVO'")
    granted = active.where(F.col("ruling1").isin("CONCEDE", "CONCEDE PARCIALMENTE"))
    row = lambda d, kind, sev, title, mail=F.lit(None).cast("bigint"), case=F.col("id"): d.select(case.alias("case_id"), mail.alias("mail_id"), F.lit(kind).alias("kind"), F.lit(sev).alias("severity"), F.lit(title).alias("title"))
    found = [
        row(granted.where(filled_sql(F.col("ruling1_date")) & ~filled_sql(F.col("answered"))), "DEADLINE", "CRITICAL", "granted, not answered"),
        row(granted.where((F.col("incident") == "SI") & ~filled_sql(F.col("incident_decision"))), "DEADLINE", "CRITICAL", "incident open"),
        row(mails.where(F.col("case_id").isNull() & (F.upper("status") != "IGNORADO")), "UNMATCHED_EMAIL", "WARNING", "mail without case", F.col("id"), F.lit(None).cast("bigint")),
        row(active.where(filled_sql(F.col("folder"))).join(docs.select(F.col("case_id").alias("id")), "id", "left_anti"), "MISSING_DOC", "WARNING", "no documents"),
        row(cases.where(F.col("filing") == classes.BAD_FILING), "ANOMALY", "CRITICAL", "listed filing"),
        row(active.where(filled_sql(F.col("ruling2"))), "ANOMALY", "INFO", "active after second ruling"),
    ]
    out = found[0]
    for d in found[1:]:
        out = out.unionByName(d)
    return out


ALERTS = """a as (select id as case_id, null::bigint as mail_id, 'DEADLINE' as kind, 'CRITICAL' as severity, 'granted, not answered' as title from cases where state = 'ACTIVO' and ruling1 in ('CONCEDE', 'CONCEDE PARCIALMENTE') and coalesce(ruling1_date, '') <> '' and coalesce(answered, '') = ''
  union all select id, null, 'DEADLINE', 'CRITICAL', 'incident open' from cases where state = 'ACTIVO' and ruling1 in ('CONCEDE', 'CONCEDE PARCIALMENTE') and incident = 'SI' and coalesce(incident_decision, '') = ''
  union all select null, id, 'UNMATCHED_EMAIL', 'WARNING', 'mail without case' from mails where case_id is null and upper(status) <> 'IGNORADO'
  union all select id, null, 'MISSING_DOC', 'WARNING', 'no documents' from cases where state = 'ACTIVO' and coalesce(folder, '') <> '' and id not in (select case_id from docs)
  union all select id, null, 'ANOMALY', 'CRITICAL', 'listed filing' from cases where filing = '3634740'
  union all select id, null, 'ANOMALY', 'INFO', 'active after second ruling' from cases where state = 'ACTIVO' and coalesce(ruling2, '') <> '')"""


@case_query(f"with {ALERTS} select * from a")
def e01_alerts(t: World):
    return alerts(t.cases, t.docs, t.mails)


@case_query("select id from mails where case_id is null and status <> 'ignorado'")
def e02_unmatched_as_compared(t: World):
    # the comparison is with the lower-case word, so mails that are IGNORADO still count
    return t.mails.where("case_id is null and status <> 'ignorado'").select("id")


@case_query(f"with {ALERTS}, e as (select * from a where coalesce(case_id, mail_id) % 3 = 0) select a.* from a where not exists (select 1 from e where e.case_id is not distinct from a.case_id and e.mail_id is not distinct from a.mail_id and e.kind = a.kind and e.title = a.title)")
def st08_new_alerts(t: World):
    found = alerts(t.cases, t.docs, t.mails)
    open_ = found.where(F.coalesce("case_id", "mail_id") % 3 == 0).withColumn("status", F.lit("open"))
    return flows.new_alerts(found, open_, ["case_id", "mail_id", "kind", "title"])


@case_query(f"with {ALERTS} select kind, severity, case when kind = 'ANOMALY' then 'seen' when severity = 'WARNING' then 'dismissed' else 'open' end as status, count(*) as n from a group by all")
def m22_alert_states(t: World):
    state = F.when(F.col("kind") == "ANOMALY", "seen").when(F.col("severity") == "WARNING", "dismissed").otherwise("open")
    return alerts(t.cases, t.docs, t.mails).groupBy("kind", "severity", state.alias("status")).agg(F.count("*").alias("n"))


EVENTS = f"""e as (select id, 'ruling' as kind, {DATE.format('ruling1_date')}::timestamp + interval 48 hour as due, 1 as sign from cases where state = 'ACTIVO' and ruling1 in ('CONCEDE', 'CONCEDE PARCIALMENTE') and coalesce(answered, '') = '' and {DATE.format('ruling1_date')} is not null
  union all select id, 'incident', {DATE.format('incident_date')}::timestamp, 1 from cases where state = 'ACTIVO' and incident = 'SI' and coalesce(incident_decision, '') = '' and {DATE.format('incident_date')} is not null
  union all select id, 'appeal', null, 1 from cases where state = 'ACTIVO' and appeal = 'SI' and coalesce(ruling2, '') = ''),
  d as (select id, kind, floor((epoch_us(due) - epoch_us(timestamp '{NOW}')) / 86400000000)::bigint as days from e),
  s as (select *, case when kind = 'appeal' then 'INFO' when kind = 'incident' then 'URGENTE' when days < 0 then 'VENCIDO' when days < 3 then 'URGENTE' else 'EN_PLAZO' end as severity from d)"""


def calendar(cases):
    """(id, kind, days, severity) of what active cases have pending: answers 48 hours after a ruling, open incidents, appeals."""
    at = lambda c: parse_dmy(F.col(c)).cast("timestamp")
    event = lambda kind, due: F.struct(F.lit(kind).alias("kind"), due.alias("due"))
    rules = F.array(
        F.when(F.col("ruling1").isin("CONCEDE", "CONCEDE PARCIALMENTE") & ~filled_sql(F.col("answered")) & at("ruling1_date").isNotNull(), event("ruling", at("ruling1_date") + F.expr("interval 48 hours"))),
        F.when((F.col("incident") == "SI") & ~filled_sql(F.col("incident_decision")) & at("incident_date").isNotNull(), event("incident", at("incident_date"))),
        F.when((F.col("appeal") == "SI") & ~filled_sql(F.col("ruling2")), event("appeal", F.lit(None).cast("timestamp"))),
    )
    d = cases.where("state = 'ACTIVO'").select("id", F.explode(F.array_compact(rules)).alias("e"))
    days = floor_days(F.col("e.due"), _now())
    how = F.when(F.col("e.kind") == "appeal", "INFO").when(F.col("e.kind") == "incident", "URGENTE").otherwise(severity(days))
    return d.select("id", "e.kind", days.alias("days"), how.alias("severity"))


@case_query(f"with {EVENTS} select id, kind, days, severity from s")
def e05_case_calendar(t: World):
    return calendar(t.cases)


@case_query(f"with {EVENTS} select count(*) as total, count(*) filter (severity = 'VENCIDO') as late, count(*) filter (severity = 'URGENTE') as urgent, count(*) filter (severity = 'EN_PLAZO') as in_time, count(*) filter (severity = 'INFO') as info from s")
def a33_calendar_summary(t: World):
    s = F.col("severity")
    return calendar(t.cases).agg(F.count("*").alias("total"), F.count_if(s == "VENCIDO").alias("late"), F.count_if(s == "URGENTE").alias("urgent"), F.count_if(s == "EN_PLAZO").alias("in_time"), F.count_if(s == "INFO").alias("info"))


@case_query(f"with {EVENTS} select id, kind, days, severity from s where id in (select key * 8 + 2 from requests)")
def e06_deadlines_of_case(t: World):
    asked = t.requests.select((F.col("key") * 8 + 2).alias("id"))
    return calendar(t.cases.join(asked, "id", "left_semi"))


@case_query("""select (select count(*) from cases where coalesce(court_id, '') = '') as without_id, (select count(*) from docs where verified = 'SOSPECHOSO') as suspicious, (select count(*) from docs where verified = 'NO_PERTENECE') as foreign_docs,
  (select count(*) from mails where case_id is null) as unmatched, (select count(*) from (select file_hash from docs group by 1 having count(*) > 1)) as duplicate_groups, (select count(*) from cases where id not in (select case_id from docs)) as empty_cases""")
def e07_health_panel(t: World):
    c = t.cases.agg(F.count_if(~filled_sql(F.col("court_id"))).alias("without_id"))
    d = t.docs.agg(F.count_if(F.col("verified") == "SOSPECHOSO").alias("suspicious"), F.count_if(F.col("verified") == "NO_PERTENECE").alias("foreign_docs"))
    m = t.mails.agg(F.count_if(F.col("case_id").isNull()).alias("unmatched"))
    g = t.docs.groupBy("file_hash").count().where("count > 1").agg(F.count("*").alias("duplicate_groups"))
    e = t.cases.select("id").join(t.docs.select(F.col("case_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("empty_cases"))
    return c.crossJoin(d).crossJoin(m).crossJoin(g).crossJoin(e)  # five tables of one row


@case_query("""with r as (select id, received as moment, 'mail' as kind, coalesce(subject, '') as label from mails order by received desc, id desc limit 20), u as (select id, used as moment, 'usage' as kind, provider || '/' || model as label from usage order by used desc, id desc limit 20)
  select * from (select * from r union all select * from u) order by moment desc, kind, id limit 20""")
def e10_recent_activity(t: World):
    m = t.mails.select("id", F.col("received").alias("moment"), F.lit("mail").alias("kind"), F.coalesce("subject", F.lit("")).alias("label"))
    u = t.usage.select("id", F.col("used").alias("moment"), F.lit("usage").alias("kind"), F.concat_ws("/", "provider", "model").alias("label"))
    return m.unionByName(u).orderBy(F.desc("moment"), "kind", "id").limit(20)


@case_query("""with e as (select id from cases where id % 4 = 1) select id as case_id, case when ruling2 ilike '%confirma%' then '2da (CONFIRMADO)' else '1ra' end as instance, case when ruling2 ilike '%confirma%' then ruling2 else ruling1 end as ruling,
  case when ruling2 ilike '%confirma%' then coalesce(nullif(ruling2_date, ''), ruling1_date, '') else coalesce(nullif(ruling1_date, ''), ruling2_date, '') end as date, case when upper(appeal) = 'SI' then 'IMPUGNADO' else 'PENDIENTE' end as state from cases
  where ruling1 ilike '%concede%' and ruling1 not ilike '%niega%' and id not in (select id from e)""")
def m17_compliance(t: World):
    known = t.cases.where("id % 4 = 1").select("id")
    lost = t.cases.where(F.col("ruling1").ilike("%concede%") & ~F.col("ruling1").ilike("%niega%")).join(known, "id", "left_anti")
    sure = F.coalesce(F.col("ruling2").ilike("%confirma%"), F.lit(False))
    day = lambda *c: F.coalesce(F.nullif(c[0], F.lit("")), F.col(c[1]), F.lit(""))
    state = F.when(F.upper("appeal") == "SI", "IMPUGNADO").otherwise("PENDIENTE")
    return lost.select(
        F.col("id").alias("case_id"), F.when(sure, "2da (CONFIRMADO)").otherwise("1ra").alias("instance"), F.when(sure, F.col("ruling2")).otherwise(F.col("ruling1")).alias("ruling"),
        F.when(sure, day("ruling2_date", "ruling1_date")).otherwise(day("ruling1_date", "ruling2_date")).alias("date"), state.alias("state"),
    )


# --- changes: old tables to new ones -------------------------------------------------------------------------------------


@case_query("""with old as (select case_id, message_id as token, id from mails where case_id is not null and id % 2 = 0), new as (select case_id, message_id as token, min(id) as id from mails where case_id is not null group by 1, 2)
  select case_id, token, id from old union all select case_id, token, id from new where not exists (select 1 from old where old.case_id = new.case_id and old.token = new.token)""")
def m02_insert_only(t: World):
    m = t.mails.where("case_id is not null").select("case_id", F.col("message_id").alias("token"), "id")
    old = m.where("id % 2 = 0")
    new = m.groupBy("case_id", "token").agg(F.min("id").alias("id"))
    return old.unionByName(new.join(old, ["case_id", "token"], "left_anti"))


@case_query("""with new as (select id, case_id, 'new' as origin from docs where verified = 'REVISAR') select id, case_id, 'old' as origin from docs where case_id not in (select case_id from new) union all select * from new""")
def m03_replace_by_case(t: World):
    new = t.docs.where("verified = 'REVISAR'").select("id", "case_id", F.lit("new").alias("origin"))
    old = t.docs.select("id", "case_id", F.lit("old").alias("origin")).join(new.select("case_id"), "case_id", "left_anti")
    return old.select("id", "case_id", "origin").unionByName(new)


@case_query(f"""with n as (select case_id, count(*) as docs from docs group by 1), k as (select c.id, {NAME} as name, {DIGITS} as d, coalesce(n.docs, 0) as docs from cases c left join n on n.case_id = c.id),
  m as (select id as old, first_value(id) over (partition by name, d order by docs desc, id) as new from k where length(d) between 17 and 25) select d.id, coalesce(m.new, d.case_id) as case_id, coalesce(m.new <> d.case_id, false) as moved from docs d left join m on m.old = d.case_id""")
def m05_merge_identity_groups(t: World):
    n = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("docs"))
    k = t.cases.select("id", normal_name(F.coalesce("claimant", F.lit(""))).alias("name"), digits(F.coalesce("court_id", F.lit(""))).alias("d")).where("length(d) between 17 and 25").join(n, "id", "left").na.fill(0, ["docs"])
    canonical = k.groupBy("name", "d").agg(F.max_by("id", F.struct("docs", -F.col("id"))).alias("new"))
    to = k.join(canonical, ["name", "d"]).where("id <> new").select(F.col("id").alias("case_id"), "new")
    d = t.docs.select("id", "case_id").join(to, "case_id", "left")
    return d.select("id", F.coalesce("new", "case_id").alias("case_id"), F.col("new").isNotNull().alias("moved"))


@case_query("""select person, min(id) as id, arg_min(city, id) filter (coalesce(city, '') <> '') as city, arg_min(rights, id) filter (coalesce(rights, '') <> '') as rights, arg_min(ruling2, id) filter (coalesce(ruling2, '') <> '') as ruling2 from cases group by 1""")
def m06_fill_empty(t: World):
    # the merged case keeps its own value, else takes that of the next case that has one
    value = lambda c: F.min_by(c, F.when(filled_sql(F.col(c)), F.col("id"))).alias(c)
    return t.cases.groupBy("person").agg(F.min("id").alias("id"), *(value(c) for c in ("city", "rights", "ruling2")))


@case_query("""select id, coalesce(nullif(case when id % 3 = 0 then '' else file_hash end, ''), md5(coalesce(text, ''))) as file_hash from docs""")
def m12_backfill_hash(t: World):
    known = F.when(F.col("id") % 3 != 0, F.col("file_hash"))
    return t.docs.select("id", F.coalesce(known, F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("file_hash"))


@case_query(rf"""with f as (select case_id, x, count(*) as n from (select case_id, unnest(regexp_extract_all(coalesce(text, ''), '68\d{{17,21}}')) as x from docs) y group by 1, 2),
  b as (select *, row_number() over (partition by case_id order by n desc, x) as k from f) select id, coalesce(nullif(court_id, ''), case when n >= 2 then x end) as court_id, coalesce(nullif(court_id, ''), '') = '' and coalesce(n, 0) >= 2 as filled from cases left join b on case_id = id and k = 1""")
def m13_backfill_id(t: World):
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(extract.ID_WHOLE), F.lit(1))
    f = t.docs.select(F.col("case_id").alias("id"), F.explode(found).alias("x")).groupBy("id", "x").agg(F.count("*").alias("n"))
    b = f.groupBy("id").agg(F.min_by(F.struct("x", "n"), F.struct(-F.col("n"), "x")).alias("b"))
    own, sure = F.nullif("court_id", F.lit("")), F.coalesce(F.col("b.n") >= 2, F.lit(False))
    return t.cases.select("id", "court_id").join(b, "id", "left").select("id", F.coalesce(own, F.when(sure, F.col("b.x"))).alias("court_id"), (own.isNull() & sure).alias("filled"))


@case_query(f"""with k as (select id, {LONG} as d, {YEAR_SEQ.format('folder')} as ys, status from cases), o as (select * from k where status is distinct from 'DUPLICATE_MERGED'), m as (select * from k where status = 'DUPLICATE_MERGED'),
  a as (select m.id, min(o.id) as x from m join o on left(m.d, 20) = left(o.d, 20) group by 1), b as (select m.id, min(o.id) as x from m join o on m.ys = o.ys and (m.d is null or o.d is null or substr(m.d, 6, 7) = substr(o.d, 6, 7)) group by 1)
  select d.id, coalesce(a.x, b.x, d.case_id) as case_id from docs d left join a on a.id = d.case_id left join b on b.id = d.case_id""")
def m15_reconcile(t: World):
    from lexmill.plans.casejoins import d16_canonical_of_merged

    to = d16_canonical_of_merged(t).where("canonical is not null").select(F.col("id").alias("case_id"), "canonical")
    return t.docs.select("id", "case_id").join(to, "case_id", "left").select("id", F.coalesce("canonical", "case_id").alias("case_id"))


@case_query(rf"""with k as (select *, id % 6 = 0 as failed, id % 9 as saved from cases) select id, case when failed and saved < 5 then 'REVISION' when length({DIGITS}) < 18 and not (regexp_matches(coalesce(folder, ''), '^20\d\d-\d+') and trim(coalesce(claimant, '')) <> '') then 'REVISION' else 'COMPLETO' end as status from k""")
def m18_status(t: World):
    i = F.col("id")
    return t.cases.select("id", extract.status_after(i % 6 == 0, i % 9, F.col("court_id"), F.col("folder"), F.col("claimant")).alias("status"))


@case_query("""with m as (select case_id, arg_max(subject, id) filter (subject is not null) as s from mails where case_id is not null group by 1) select id, coalesce(nullif(notes, ''), s) as notes, coalesce(notes, '') = '' and s is not null as changed from cases left join m on case_id = id""")
def m19_update_if_empty(t: World):
    m = t.mails.where("case_id is not null and subject is not null").groupBy(F.col("case_id").alias("id")).agg(F.max_by("subject", "id").alias("s"))
    own = F.nullif("notes", F.lit(""))
    return t.cases.select("id", "notes").join(m, "id", "left").select("id", F.coalesce(own, "s").alias("notes"), (own.isNull() & F.col("s").isNotNull()).alias("changed"))


@case_query("""with g as (select id from cases where status = 'DUPLICATE_MERGED') select 'docs' as kind, id, case_id from docs where case_id not in (select id from g) union all select 'mails', m.id, case when g.id is null then m.case_id end from mails m left join g on g.id = m.case_id""")
def m20_cascade_delete(t: World):
    gone = t.cases.where("status = 'DUPLICATE_MERGED'").select(F.col("id").alias("case_id"))
    docs = t.docs.join(gone, "case_id", "left_anti").select(F.lit("docs").alias("kind"), "id", "case_id")
    mails = t.mails.select("id", "case_id").join(gone.withColumn("gone", F.lit(True)), "case_id", "left")
    return docs.unionByName(mails.select(F.lit("mails").alias("kind"), "id", F.when(F.col("gone").isNull(), F.col("case_id")).alias("case_id")))


@case_query("""with disk as (select id, folder, filename from (select d.id, c.folder, d.filename from docs d join cases c on c.id = d.case_id) where id % 10 <> 3), db as (select d.id, case when d.id % 7 = 0 then 'moved ' || c.folder else c.folder end as folder, d.filename from docs d join cases c on c.id = d.case_id where d.id % 10 <> 5)
  select coalesce(disk.id, db.id) as id, case when db.id is null then 'new' when disk.id is null then 'ghost' when disk.folder is distinct from db.folder then 'path' else 'same' end as step from disk full join db on disk.id = db.id""")
def m21_folder_sync(t: World):
    d = t.docs.select("id", "case_id", "filename").join(t.cases.select(F.col("id").alias("case_id"), "folder"), "case_id")
    disk = d.where("id % 10 <> 3").select("id", F.col("folder").alias("a"), F.lit(True).alias("on_disk"))
    db = d.where("id % 10 <> 5").select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("moved "), "folder")).otherwise(F.col("folder")).alias("b"), F.lit(True).alias("in_db"))
    step = F.when(F.col("in_db").isNull(), "new").when(F.col("on_disk").isNull(), "ghost").when(~F.col("a").eqNullSafe(F.col("b")), "path").otherwise("same")
    return disk.join(db, "id", "full").select("id", step.alias("step"))


@case_query(rf"""with k as (select id, folder, {DIGITS} as d, trim(regexp_replace(upper(coalesce(claimant, '')), '\s+', ' ', 'g')) as name from cases),
  s as (select *, case when regexp_matches(d, '20\d\d\d{{5}}\d\d$') then substr(d, length(d) - 10, 4) || '-' || substr(d, length(d) - 6, 5) end as official from k), n as (select id, folder, official || ' ' || name as target from s where official is not null and name <> ''),
  c as (select target, count(*) as n from n group by 1) select id, n.target, c.n > 1 as collides from n join c using (target) where n.folder is distinct from n.target""")
def m25_rename_folders(t: World):
    name = F.btrim(F.regexp_replace(F.upper(F.coalesce("claimant", F.lit(""))), r"\s+", " "))
    from lexmill.functions.cases import short_id

    n = t.cases.select("id", "folder", short_id(F.coalesce("court_id", F.lit(""))).alias("official"), name.alias("name")).where("official is not null and name <> ''")
    n = n.select("id", "folder", F.concat_ws(" ", "official", "name").alias("target"))
    taken = n.groupBy("target").agg(F.count("*").alias("n"))
    return n.join(taken, "target").where(~F.col("folder").eqNullSafe(F.col("target"))).select("id", "target", (F.col("n") > 1).alias("collides"))


@case_query(f"""select id from cases where created < timestamp '{NOW}' - interval 60 day and coalesce(status, '') <> 'DUPLICATE_MERGED' and id not in (select case_id from docs)""")
def st15_archive_old_empty(t: World):
    # also M26
    old = t.cases.where((F.col("created") < _now() - F.expr("interval 60 days")) & ~F.col("status").eqNullSafe("DUPLICATE_MERGED"))
    return old.select("id").join(t.docs.select(F.col("case_id").alias("id")), "id", "left_anti")


@case_query(f"""select coalesce(status, 'NULL') as status, count(*) as n from mails where received >= timestamp '{NOW}' - interval 30 day and received < timestamp '{NOW}' group by 1""")
def st14_last_month(t: World):
    d = t.mails.where((F.col("received") >= _now() - F.expr("interval 30 days")) & (F.col("received") < _now()))
    return d.groupBy(F.coalesce("status", F.lit("NULL")).alias("status")).agg(F.count("*").alias("n"))


# --- search and privacy --------------------------------------------------------------------------------------------------


@case_query("""select case_id, id, left(text, 40) as head from docs where text ilike '%tutelar%'""")
def n02_case_knowledge(t: World):
    # also N3: LIKE where no index is at hand
    return t.docs.where(F.col("text").ilike("%tutelar%")).select("case_id", "id", F.left("text", F.lit(40)).alias("head"))


@case_query(r"""with v as (select case_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\b3\d{9}\b'))) as value from docs), n as (select case_id, value, row_number() over (partition by case_id order by value) as k from v group by 1, 2)
  select d.id, n.value, '[TEL_' || k || ']' as token, (length(d.text) - length(replace(d.text, n.value, ''))) / length(n.value) as times from docs d join n using (case_id) where contains(d.text, n.value)""")
def r02_known_values(t: World):
    # the values that a case is known to hold, wherever its documents show them
    from pyspark.sql import Window

    v = t.docs.select("case_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(3\d{9})\b"), F.lit(1)))).alias("value")).distinct()
    n = v.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("value")))
    d = t.docs.select("id", "case_id", "text").join(n, "case_id").where(F.contains("text", "value"))
    times = (F.length("text") - F.length(F.replace("text", F.col("value"), F.lit("")))) / F.length("value")
    return d.select("id", "value", F.concat(F.lit("[TEL_"), F.col("k").cast("string"), F.lit("]")).alias("token"), times.cast("double").alias("times"))


@case_query("""select case_id, count(*) as spans, count(distinct token) as tokens, sum(n)::bigint as chars from (select case_id, token, length(token) as n from (select case_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]{7,}')) as token from docs)) group by 1""")
def r12_privacy_stats(t: World):
    d = t.docs.select("case_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([0-9]{7,})"), F.lit(1))).alias("token"))
    return d.groupBy("case_id").agg(F.count("*").alias("spans"), F.count_distinct("token").alias("tokens"), F.sum(F.length("token")).alias("chars"))


@case_query("""select 'id ' || id || ': ' || coalesce(folder, '') || ' | ' || coalesce(state, '') || ' | ' || coalesce(ruling1, '') as line, id from cases where state = 'ACTIVO'""")
def x32_context_lines(t: World):
    e = lambda c: F.coalesce(c, F.lit(""))
    return t.cases.where("state = 'ACTIVO'").select("id", F.concat(F.lit("id "), F.col("id").cast("string"), F.lit(": "), e("folder"), F.lit(" | "), e("state"), F.lit(" | "), e("ruling1")).alias("line"))


@case_query("""with m as (select d.id, d.case_id, d.mail_id, case when d.verified = 'NO_PERTENECE' and e.case_id <> d.case_id then e.case_id end as target from docs d left join mails e on e.id = d.mail_id),
  p as (select mail_id, case_id, max(target) as target from m where target is not null group by 1, 2) select m.id, coalesce(p.target, m.case_id) as case_id, p.target is not null as moved from m left join p on p.mail_id = m.mail_id and p.case_id = m.case_id""")
def m10_move_package(t: World):
    # a document that does not belong moves to the case of the mail that it came with, and takes along what else that mail brought to its case
    to = t.mails.select(F.col("id").alias("mail_id"), F.col("case_id").alias("to"))
    m = t.docs.select("id", "case_id", "mail_id", "verified")
    wrong = m.where("verified = 'NO_PERTENECE'").join(to, "mail_id").where("to <> case_id").groupBy("mail_id", "case_id").agg(F.max("to").alias("target"))
    return m.join(wrong, ["mail_id", "case_id"], "left").select("id", F.coalesce("target", "case_id").alias("case_id"), F.col("target").isNotNull().alias("moved"))
