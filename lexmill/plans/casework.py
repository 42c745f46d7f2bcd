"""Functions, filters and aggregates on cases, documents, mails and usage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import classes
from lexmill.functions.cases import case_identity, final_ruling, short_id, spaced_id, valid_filing, written_date
from lexmill.functions.compat import digits, filled_sql, filled_trim, parse_dmy, share, top_k
from lexmill.plans.world import World, case_query

#: SQL of str.title, and of a null made empty.
TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '\\p{{L}}+|\\P{{L}}+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
REAL = "coalesce(folder, '') not in ('', 'None') and status <> 'DUPLICATE_MERGED'"


def real_cases(t: World):
    """Cases with a folder that were not merged; a null status drops out."""
    return t.cases.where(filled_sql(F.col("folder")) & (F.col("folder") != "None") & (F.col("status") != "DUPLICATE_MERGED"))


def _has(c: str, *parts: str) -> str:
    return "(" + " or ".join(f"contains({c}, '{p}')" for p in parts) + ")"


def _rules(c: str, rules, default: str) -> str:
    return "case " + " ".join(f"when {_has(c, *parts)} then '{label}'" for parts, label in rules) + f" else {default} end"


@case_query(f"select id, folder, status from cases where {REAL}")
def p01_real_cases(t: World):
    return real_cases(t).select("id", "folder", "status")


@case_query("select id, status from cases where status <> 'DUPLICATE_MERGED' or status is null")
def p02_keep_null(t: World):
    return t.cases.where(~F.col("status").eqNullSafe("DUPLICATE_MERGED")).select("id", "status")


@case_query("select id, state, ruling1 from cases where state ilike 'activo' and ruling1 ilike 'concede'")
def p04_equal_ci(t: World):
    return t.cases.where(F.col("state").ilike("activo") & F.col("ruling1").ilike("concede")).select("id", "state", "ruling1")


@case_query("""select id, folder, claimant, city from cases where (folder ilike '%ruiz%' or claimant ilike '%ruiz%' or city ilike '%ruiz%') and city ilike '%gil%' and claimant ilike '%o%'""")
def p07_table_filters(t: World):
    shown = t.cases.select("id", "folder", "claimant", "city")
    anywhere = F.exists(F.array("folder", "claimant", "city"), lambda x: x.ilike("%ruiz%"))
    return shown.where(anywhere & F.col("city").ilike("%gil%") & F.col("claimant").ilike("%o%"))


@case_query(r"""select id, folder from cases where folder ilike '2024%' and regexp_matches(folder, '^2024-\d{5} ')""")
def p11_prefix(t: World):
    return t.cases.where(F.startswith("folder", F.lit("2024")) & F.regexp_like("folder", F.lit(r"^2024-\d{5} "))).select("id", "folder")


@case_query("select id, ruling1 from cases where ruling1 ilike '%concede%' and ruling1 not ilike '%niega%'")
def p13_not_like(t: World):
    return t.cases.where(F.col("ruling1").ilike("%concede%") & ~F.col("ruling1").ilike("%niega%")).select("id", "ruling1")


LAWYER = TITLE.format(r"trim(regexp_replace(trim(coalesce(lawyer, '')), '\s+(CPS|OPS|CONTRATO|CC\.?\s*\d+).*$', '', 'i'))")


@case_query(f"""with n as (select id, lawyer, {LAWYER} as n from cases),
  m as (select *, case lower(n) when 'juan deigo cruz lizcano' then 'Juan Diego Cruz Lizcano' else n end as f from n)
  select id, case when len(string_split(f, ' ')) > 5 then array_to_string(string_split(f, ' ')[1:4], ' ') else f end as name from m""")
def f04_lawyer(t: World):
    return t.cases.select("id", classes.lawyer_name(F.col("lawyer")).alias("name"))


CITY = rf"""trim(regexp_replace(trim(regexp_replace(regexp_replace({TITLE.format("trim(coalesce(city, ''))")}, ',?\s*Santander.*$', '', 'i'), ',?\s*Colombia.*$', '', 'i')), ',+$', ''))"""
CITY_SQL = f"(case lower({CITY}) when 'bogota d.c.' then 'Bogotá D.C.' when 'bogota' then 'Bogotá D.C.' when 'giron' then 'Girón' when 'gambita' then 'Gámbita' when 'floridablanca' then 'Floridablanca' else {CITY} end)"


@case_query(f"select id, {CITY_SQL} as city from cases")
def f05_city(t: World):
    return t.cases.select("id", classes.city_name(F.col("city")).alias("city"))


@case_query(f"select {CITY_SQL} as city, count(*) as n from cases where coalesce(city, '') <> '' group by 1 order by n desc, city limit 10")
def f06_group_normalized(t: World):
    d = t.cases.where(filled_sql(F.col("city"))).groupBy(classes.city_name(F.col("city")).alias("city")).agg(F.count("*").alias("n"))
    return top_k(d, "n", 10, "city")


NAME = r"trim(regexp_replace(strip_accents(upper(coalesce(claimant, ''))), '\s+', ' ', 'g'))"
DIGITS = r"regexp_replace(coalesce(court_id, ''), '\D', '', 'g')"


@case_query(f"""select case when length({DIGITS}) between 17 and 25 then {DIGITS} end as long_id, {NAME} as name,
  case when contains(strip_accents(upper(coalesce(subject, ''))), 'PERSONER') then 'PERSONERIA' else 'DIRECTO' end as represented, count(*) as n, min(id) as first from cases group by 1, 2, 3 having count(*) > 1""")
def f09_identity(t: World):
    who = case_identity(F.coalesce("court_id", F.lit("")), F.coalesce("claimant", F.lit("")), F.coalesce("subject", F.lit("")))
    d = t.cases.groupBy(who.alias("k")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    return d.select("k.long_id", "k.name", "k.represented", "n", "first")


@case_query(rf"""select id, case when regexp_matches({DIGITS}, '(20\d\d)(\d{{5}})\d\d$') then regexp_extract({DIGITS}, '(20\d\d)(\d{{5}})\d\d$', 1) || '-' || regexp_extract({DIGITS}, '(20\d\d)(\d{{5}})\d\d$', 2) end as short,
  regexp_replace(coalesce(court_id, ''), '^(\d\d)(\d{{3}})(\d\d)(\d\d)(\d{{3}})(\d{{4}})(\d{{5}})(\d\d)$', '\1-\2-\3-\4-\5-\6-\7-\8') as spaced from cases""")
def f10_short_and_spaced(t: World):
    c = F.coalesce("court_id", F.lit(""))
    return t.cases.select("id", short_id(c).alias("short"), spaced_id(c).alias("spaced"))


@case_query(r"""with x as (select id, regexp_extract(coalesce(folder, ''), '(20\d\d)-0*(\d{1,6})', 1) as y, regexp_extract(coalesce(folder, ''), '(20\d\d)-0*(\d{1,6})', 2) as n from cases)
  select id, case when n <> '' then y || '-' || repeat('0', greatest(5 - length(n), 0)::int) || n end as short from x""")
def f11_folder_id(t: World):
    return t.cases.select("id", classes.folder_id(F.col("folder")).alias("short"))


D, N = "upper(coalesce(incident_decision, ''))", "upper(coalesce(notes, ''))"


@case_query(f"""select id, case when {D} not in ('', 'PENDIENTE') then {_rules(D, classes.DECISIONS, "'EN TRÁMITE'")} else {_rules(N, classes.NOTES, "'PENDIENTE'")} end as class from cases""")
def f13_incident_class(t: World):
    return t.cases.select("id", classes.incident_class(F.col("incident_decision"), F.col("notes")).alias("class"))


def _rights_sql(n: int) -> str:
    return "case " + " ".join("when " + " and ".join(f"contains(d, '{p}')" for p in parts) + f" then '{label}'" for parts, label in classes.RIGHTS[:n]) + " else d end"


RIGHTS_ROWS = "r as (select id, ruling1, trim(upper(unnest(string_split(rights, ' - ')))) as d from cases where coalesce(rights, '') <> '' and {0})"


@case_query(f"with {RIGHTS_ROWS.format(REAL)} select {_rights_sql(8)} as right_, count(*) as n from r where length(d) > 2 group by 1 order by n desc, right_ limit 10")
def a13_by_right(t: World):
    d = real_cases(t).where(filled_sql(F.col("rights"))).select(F.explode(F.split("rights", " - ")).alias("d")).select(F.btrim(F.upper("d")).alias("d"))
    return top_k(d.where(F.length("d") > 2).groupBy(classes.right_name(F.col("d")).alias("right_")).agg(F.count("*").alias("n")), "n", 10, "right_")


@case_query(f"with {RIGHTS_ROWS.format(REAL)} select {_rights_sql(5)} as right_, count(*) as n from r where length(d) > 2 and ruling1 ilike '%concede%' group by 1 order by n desc, right_ limit 10")
def a13_lost_by_right(t: World):
    d = real_cases(t).where(filled_sql(F.col("rights")) & F.col("ruling1").ilike("%concede%")).select(F.explode(F.split("rights", " - ")).alias("d")).select(F.btrim(F.upper("d")).alias("d"))
    return top_k(d.where(F.length("d") > 2).groupBy(classes.right_name(F.col("d"), 5).alias("right_")).agg(F.count("*").alias("n")), "n", 10, "right_")


@case_query(f"""with d as (select upper(trim(rights)) as d, id from cases where coalesce(rights, '') <> '') select id, {_rights_sql(8)} as right_ from d""")
def f14_right(t: World):
    return t.cases.where(filled_sql(F.col("rights"))).select("id", classes.right_name(F.upper(F.btrim("rights"))).alias("right_"))


FOLDER_WORDS = " ".join(f"when contains(upper(coalesce(folder, '')), '{w}') then 'words: {w}'" for w in classes.FRAGMENTS)


@case_query(rf"""select id, case when coalesce(folder, '') = '' then 'empty' {FOLDER_WORDS} when length(folder) > 120 then 'long' when not regexp_matches(folder, '^\d{{4}}-\d{{3,}}') then 'no number' end as why,
  regexp_matches(coalesce(folder, ''), '^20\d{{3}}-') as typo, coalesce(try_cast(nullif(regexp_extract(coalesce(folder, ''), '^(\d{{4}})-(\d{{4,}})(?:\s|$)', 2), '') as bigint) >= 10000, false) as filing from cases""")
def f15_folder_names(t: World):
    c = F.col("folder")
    return t.cases.select("id", classes.suspicious_folder(c).alias("why"), classes.mistyped_folder(c).alias("typo"), classes.filing_folder(c).alias("filing"))


FN = "lower(filename)"
DOC_CLASS = f"""case when ends_with({FN}, '.docx') or (ends_with({FN}, '.doc') and not contains({FN}, '.doc '))
  then case when {_has(FN, *classes.ANSWER)} then {_rules(FN, classes.ANSWERS, "'DOCX_RESPUESTA'")} else {_rules(FN, classes.LETTERS, "'DOCX_OTRO'")} end
  when starts_with({FN}, 'email_') and ends_with({FN}, '.md') then 'EMAIL_MD' when starts_with({FN}, 'gmail') or starts_with({FN}, 'rv_') then 'PDF_GMAIL'
  else {_rules(FN, classes.FILES, f"case when starts_with({FN}, 'email') then 'EMAIL_DB' when regexp_matches({FN}, '[.](png|jpg|jpeg|bmp|gif)$') then 'SCREENSHOT' else 'PDF_OTRO' end")} end"""


@case_query(f"select id, {DOC_CLASS} as class from docs")
def f17_document_class(t: World):
    return t.docs.select("id", classes.document_class(F.col("filename")).alias("class"))


MENDED = "coalesce(subject, '')"
for _wrong, _right in classes.TYPOS.items():
    MENDED = f"replace({MENDED}, '{_wrong}', '{_right}')"
MAIL_CLASS = _rules("upper(s)", classes.MAILS, "'OTRO'")


@case_query(f"""with m as (select *, {MENDED} as s from mails) select id, s as subject, {MAIL_CLASS} as class,
  {_has("lower(coalesce(sender, ''))", *classes.IGNORED_SENDERS)} or {_has("lower(coalesce(subject, ''))", *classes.IGNORED_SUBJECTS)} as ignored from m""")
def f18_mail_class(t: World):
    m = t.mails.withColumn("mended", classes.mend_typos(F.col("subject")))
    return m.select("id", F.col("mended").alias("subject"), classes.mail_class(F.col("mended")).alias("class"), classes.ignorable_mail(F.col("subject"), F.col("sender")).alias("ignored"))


@case_query(r"""with d as (select id, regexp_replace(coalesce(filing, ''), '\D', '', 'g') as d from cases)
  select id, length(d) >= 7 and d not in ('3634740', '6076337000', '6076336100', '6076336000') and not starts_with(d, '68') and length(replace(d, d[1], '')) > 0 as ok from d""")
def f20_valid_filing(t: World):
    return t.cases.select("id", valid_filing(F.coalesce("filing", F.lit(""))).alias("ok"))


DATE = "coalesce(try_strptime({0}, '%d/%m/%Y'), try_strptime({0}, '%Y-%m-%d'))::date"


@case_query(f"select id, {DATE.format('admitted')} as admitted, {DATE.format('ruling2_date')} as ruled, {DATE.format('answered')} as answered from cases")
def f21_dates(t: World):
    return t.cases.select("id", parse_dmy(F.col("admitted")).alias("admitted"), parse_dmy(F.col("ruling2_date")).alias("ruled"), parse_dmy(F.col("answered")).alias("answered"))


@case_query(r"""with x as (select id, regexp_extract(coalesce(text, ''), '(\d{1,2})\s+de\s+(enero|marzo)\s+de\s+(\d{4})', ['d', 'm', 'y']) as x from docs)
  select id, make_date(try_cast(x.y as int), case x.m when 'enero' then 1 when 'marzo' then 3 end, try_cast(x.d as int)) as day from x""")
def f22_written_dates(t: World):
    return t.docs.select("id", written_date(F.col("text")).alias("day"))


@case_query(f"select id, {DATE.format('coalesce(nullif(answered, chr(0)), ruling1_date)')} + interval 10 day as due, created - interval 5 hour as shown from cases where answered is null or answered <> ''")
def f26_due_dates(t: World):
    # ten days from the notification, else from the ruling; times are shown five hours earlier
    base = parse_dmy(F.coalesce("answered", "ruling1_date"))
    d = t.cases.where("answered is null or answered <> ''")
    return d.select("id", F.date_add(base, 10).cast("timestamp").alias("due"), (F.col("created") - F.expr("interval 5 hours")).alias("shown"))


PRICES = [("deepseek", "chat", 0.27, 1.1), ("openai", "mini", 0.15, 0.6), ("anthropic", "reasoner", 3.0, 15.0)]


@case_query("""with p(provider, model, i, o) as (values ('deepseek', 'chat', 0.27::double, 1.1::double), ('openai', 'mini', 0.15, 0.6), ('anthropic', 'reasoner', 3.0, 15.0)),
  u as (select provider, model, sum(tokens_in)::double as a, sum(tokens_out)::double as b from usage group by 1, 2)
  select provider, model, (a * coalesce(i, 0) + b * coalesce(o, 0)) / 1e6 as usd from u left join p using (provider, model)""")
def f29_estimated_cost(t: World):
    prices = t.spark.createDataFrame(PRICES, "provider string, model string, i double, o double")
    u = t.usage.groupBy("provider", "model").agg(F.sum("tokens_in").cast("double").alias("a"), F.sum("tokens_out").cast("double").alias("b"))
    usd = (F.col("a") * F.coalesce("i", F.lit(0.0)) + F.col("b") * F.coalesce("o", F.lit(0.0))) / 1e6
    return u.join(F.broadcast(prices), ["provider", "model"], "left").select("provider", "model", usd.alias("usd"))


@case_query(f"""with x as (select id, {DATE.format('ruling2_date')} as d, * from cases)
  select id, case when coalesce(filing, '') = '' then null when filing = '3634740' then 'listed' when starts_with(filing, '68') then 'court id' when length(filing) < 7 then 'short' end as filing,
    case when coalesce(trim(appeal), '') <> '' and upper(trim(appeal)) not in ('SI', 'NO') then 'choice' end as appeal, case when coalesce(trim(state), '') <> '' and upper(state) not in ('ACTIVO', 'INACTIVO') then 'choice' end as state,
    case when coalesce(trim(ruling2_date), '') = '' then null when d is null then 'no date' when year(d) not between 2020 and 2030 then 'year' end as ruling2_date,
    case when coalesce(trim(admitted), '') = '' then null when {DATE.format('admitted')} is null then 'no date' when year({DATE.format('admitted')}) not between 2020 and 2030 then 'year' end as admitted from x""")
def f33_field_problems(t: World):
    return t.cases.select("id", *(classes.field_problem(n, F.col(n)).alias(n) for n in ("filing", "appeal", "state", "ruling2_date", "admitted")))


@case_query(f"""with x as (select *, {DATE.format('admitted')} as a, {DATE.format('ruling1_date')} as b, {DATE.format('ruling2_date')} as c from cases)
  select id, list_filter([case when a > b then 'admitted after ruling' end, case when b > c then 'rulings out of order' end, case when coalesce(ruling1, '') <> '' and coalesce(appeal, '') = '' then 'ruling without appeal field' end,
    case when coalesce(ruling2, '') <> '' and coalesce(appeal, '') <> 'SI' then 'second ruling without appeal' end, case when incident = 'SI' and coalesce(incident_date, '') = '' then 'incident without date' end], lambda x: x is not null) as warnings from x""")
def f34_cross_fields(t: World):
    names = ("admitted", "ruling1", "ruling1_date", "ruling2", "ruling2_date", "appeal", "incident", "incident_date")
    return t.cases.select("id", classes.cross_field_warnings(*map(F.col, names)).alias("warnings"))


@case_query(rf"""with f as (select docs.id as doc, list_distinct(regexp_extract_all(coalesce(text, ''), '68\d{{21}}')) as found, {DIGITS} as own from docs join cases on cases.id = docs.case_id),
  g as (select doc, list_filter(found, lambda x: x <> own) as others from f) select * from g where len(others) > 0""")
def f37_foreign_ids(t: World):
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(68\d{21})"), F.lit(1)))
    d = t.docs.select(F.col("id").alias("doc"), "case_id", found.alias("found")).where(F.size("found") > 0)
    own = t.cases.select(F.col("id").alias("case_id"), digits(F.coalesce("court_id", F.lit(""))).alias("own"))
    return d.join(own, "case_id").select("doc", F.array_except("found", F.array("own")).alias("others")).where(F.size("others") > 0)


LEVEL = "case " + " ".join(f"when contains(upper(coalesce(court, '')), '{w}') then '{n}'" for w, n in (("PROMISCUO", "PROMISCUO_MUNICIPAL"), ("MUNICIPAL", "PENAL_MUNICIPAL"), ("CIRCUITO", "CIRCUITO"), ("TRIBUNAL", "TRIBUNAL"), ("CORTE", "CORTE"))) + " else 'OTRO' end"


@case_query(f"""select case when contains(upper(coalesce(claimant, '')), 'PERSONER') then 'PERSONERO_MUNICIPAL' else 'PERSONA_NATURAL' end as format, {LEVEL} as level, count(*) as n from cases group by 1, 2""")
def a38_catalogue(t: World):
    return t.cases.groupBy(classes.party_format(F.col("claimant")).alias("format"), classes.court_level(F.col("court")).alias("level")).agg(F.count("*").alias("n"))


@case_query("""with e as (select upper(regexp_replace(trim(unnest(string_split(defendants, '-'))), '\\s+', ' ', 'g')) as e from cases where coalesce(defendants, '') <> '')
  select case when contains(e, 'SECRETARÍA DE EDUCACIÓN') then 'SECRETARIA DE EDUCACION' when contains(e, 'NUEVA EPS') then 'NUEVA EPS' when contains(e, 'GOBERNACION') then 'GOBERNACION SANTANDER' when contains(e, 'ALCALDIA') then 'ALCALDIA_MUNICIPAL' else e end as entity,
  count(*) as n from e where e <> '' group by 1""")
def f40_entities(t: World):
    d = t.cases.where(filled_sql(F.col("defendants"))).select(F.explode(F.split("defendants", r"\s*-\s*")).alias("e")).where(F.btrim("e") != "")
    return d.groupBy(classes.entity_name(F.btrim("e")).alias("entity")).agg(F.count("*").alias("n"))


@case_query("""select id, case when id % 30 = 29 then 'EDAD_DESCONOCIDA' when id % 30 <= 5 then 'EDAD_0_5' when id % 30 <= 10 then 'EDAD_6_10' when id % 30 <= 14 then 'EDAD_11_14' when id % 30 <= 17 then 'EDAD_15_17' else 'EDAD_ADULTO' end as age,
  coalesce(nullif(regexp_extract(upper(coalesce(text, '')), '([A-TV-Z][0-9]{2})', 1), ''), 'DX_UNK') as dx, right(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g'), 4) as tail from docs""")
def f41_generalised(t: World):
    age = F.when(F.col("id") % 30 != 29, F.col("id") % 30)
    return t.docs.select("id", classes.age_range(age).alias("age"), classes.diagnosis_family(F.col("text")).alias("dx"), classes.last_digits(F.col("text")).alias("tail"))


@case_query(r"""select id, regexp_replace(left(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(folder, ''), '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), '[. ]+$', ''), 20), '[. ]+$', '') as name from cases""")
def f45_safe_folder(t: World):
    return t.cases.select("id", classes.safe_folder(F.col("folder"), 20).alias("name"))


@case_query(r"""with b as (select id, 'Hola ' || coalesce(subject, '') || chr(10) || 'De: ' || coalesce(sender, '') || chr(10) || '_____' || chr(10) || 'x' || chr(10) || 'From: y' || chr(10) || '=====' || chr(10) as body from mails)
  select id, list_filter([trim('Hola ' || coalesce(split_part(body, chr(10) || 'De:', 1)[6:], '')), trim('De:' || split_part(split_part(body, '_____', 1), 'De:', 2), ' ' || chr(10)), 'x', 'From: y'], lambda x: x <> '') as blocks from b""")
def f44_forwarded(t: World):
    body = F.concat(F.lit("Hola "), F.coalesce("subject", F.lit("")), F.lit("\nDe: "), F.coalesce("sender", F.lit("")), F.lit("\n_____\nx\nFrom: y\n=====\n"))
    return t.mails.select("id", classes.forwarded_blocks(body).alias("blocks"))


@case_query("""select id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(defendants, '') || ' - ' || coalesce(linked, ''), ' - '), lambda x: trim(x)), lambda x: length(x) > 2))) as names from cases""")
def f46_institutions(t: World):
    return t.cases.select("id", F.array_sort(classes.institutions(F.concat_ws(" - ", "defendants", "linked"))).alias("names"))


@case_query(r"""with x as (select id, lower(coalesce(notes, '') || ' ' || coalesce(subject, '') || ' menor con autismo ' || case when id % 3 = 0 then 'violencia' else '' end || case when id % 5 = 0 then ' rc 12' else '' end) as t from cases)
  select id, list_filter(['menor_con_condicion_salud', case when contains(t, 'violenc') then 'violencia_detectada' end, case when contains(t, 'rc 1') then 'nuip_menor_presente' end], lambda x: x is not null) as hints from x""")
def f47_privacy_hints(t: World):
    more = F.concat(F.when(F.col("id") % 3 == 0, "violencia").otherwise(""), F.when(F.col("id") % 5 == 0, " rc 12").otherwise(""))
    text = F.concat(F.coalesce("notes", F.lit("")), F.lit(" "), F.coalesce("subject", F.lit("")), F.lit(" menor con autismo "), more)
    return t.cases.select("id", classes.privacy_hints(text).alias("hints"))


RULED = f"""case when trim(coalesce(ruling1, '')) = '' then 'SIN FALLO' else 'x' end"""
R1, R2 = "upper(trim(coalesce(ruling1, '')))", "upper(trim(coalesce(ruling2, '')))"
ALONE = f"case when contains({R1}, 'CONCEDE') then 'DESFAVORABLE' when contains({R1}, 'NIEGA') then 'FAVORABLE' when contains({R1}, 'IMPROCEDENTE') then 'IMPROCEDENTE' else 'OTRO' end"
FINAL = f"""case when {R1} = '' then 'SIN FALLO' when {R2} = '' and contains({R1}, 'DESISTIMIENTO') then 'DESISTIMIENTO' when {R2} = '' or contains({R2}, 'CONFIRMA') then {ALONE}
  when contains({R2}, 'REVOCA') then case when contains({R1}, 'CONCEDE') then 'FAVORABLE' else 'DESFAVORABLE' end when contains({R2}, 'MODIFICA') then 'MODIFICADO' else 'OTRO' end"""


@case_query(f"""select case when f in ('DESISTIMIENTO', 'OTRO') then 'IMPROCEDENTE' else f end as outcome, count(*) as n from (select {FINAL} as f from cases where {REAL}) group by 1""")
def a15_favourability_chart(t: World):
    f = final_ruling(F.col("ruling1"), F.col("ruling2"))
    return real_cases(t).groupBy(F.when(f.isin("DESISTIMIENTO", "OTRO"), "IMPROCEDENTE").otherwise(f).alias("outcome")).agg(F.count("*").alias("n"))


@case_query("""with u as (select coalesce(sum(tokens_in), 0)::bigint as i, coalesce(sum(tokens_out), 0)::bigint as o, coalesce(sum(try_cast(cost as double)), 0) as paid from usage)
  select i as tokens_in, o as tokens_out, paid, (i * 2.5 + o * 10.0) / 1e6 as other, (i * 2.5 + o * 10.0) / 1e6 - paid as saved from u""")
def a23_savings(t: World):
    d = t.usage.agg(F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.coalesce(F.sum(F.col("cost").try_cast("double")), F.lit(0.0)).alias("paid"))
    d = d.withColumn("other", (F.col("tokens_in") * 2.5 + F.col("tokens_out") * 10.0) / 1e6)
    return d.withColumn("saved", F.col("other") - F.col("paid"))


@case_query("""select (select count(*) from cases) as cases, (select count(*) from docs) as docs, (select count(*) from mails) as mails, (select count(*) from cases where state = 'ACTIVO') as active,
  (select count(*) from cases where ruling1 = 'CONCEDE') as granted, (select count(*) from mails where case_id is null) as unmatched, (select count(*) from docs where verified = 'SOSPECHOSO') as suspicious""")
def a27_statistics(t: World):
    c = t.cases.agg(F.count("*").alias("cases"), F.count_if(F.col("state") == "ACTIVO").alias("active"), F.count_if(F.col("ruling1") == "CONCEDE").alias("granted"))
    d = t.docs.agg(F.count("*").alias("docs"), F.count_if(F.col("verified") == "SOSPECHOSO").alias("suspicious"))
    m = t.mails.agg(F.count("*").alias("mails"), F.count_if(F.col("case_id").isNull()).alias("unmatched"))
    return c.crossJoin(d).crossJoin(m)  # three tables of one row


@case_query("""select lawyer, count(*) as n, count(*) filter (state = 'ACTIVO') as active, count(*) filter (coalesce(ruling1, '') <> '') as ruled, count(*) filter (ruling1 ilike '%niega%') as won from cases where lawyer ilike '%gil%' or lawyer ilike '%mesa%' group by 1""")
def a28_lawyer_analysis(t: World):
    d = t.cases.where(F.col("lawyer").ilike("%gil%") | F.col("lawyer").ilike("%mesa%")).groupBy("lawyer")
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("state") == "ACTIVO").alias("active"), F.count_if(filled_sql(F.col("ruling1"))).alias("ruled"), F.count_if(F.col("ruling1").ilike("%niega%")).alias("won"))


@case_query("select city, count(*) as n from cases where coalesce(city, '') <> '' group by 1 order by n desc, city limit 30")
def a29_municipalities(t: World):
    return top_k(t.cases.where(filled_sql(F.col("city"))).groupBy("city").agg(F.count("*").alias("n")), "n", 30, "city")


@case_query("""select field, count(*) as n from (select case id % 4 when 0 then 'court' when 1 then 'city' when 2 then 'ruling1' else 'claimant' end as field, id from mails where coalesce(status, '') <> 'IGNORADO') group by 1""")
def a31_corrections(t: World):
    field = F.element_at(F.array(*map(F.lit, ("court", "city", "ruling1", "claimant"))), (F.col("id") % 4 + 1).cast("int"))
    return t.mails.where(~F.col("status").eqNullSafe("IGNORADO")).groupBy(field.alias("field")).agg(F.count("*").alias("n"))


@case_query("""select field, count(*) as n from (select case id % 4 when 0 then 'court' when 1 then 'city' when 2 then 'ruling1' else 'claimant' end as field from mails where status = 'PROCESADO' order by received desc, id desc limit 500) group by 1""")
def a40_recent_corrections(t: World):
    field = F.element_at(F.array(*map(F.lit, ("court", "city", "ruling1", "claimant"))), (F.col("id") % 4 + 1).cast("int"))
    last = t.mails.where("status = 'PROCESADO'").select("id", "received").orderBy(F.desc("received"), F.desc("id")).limit(500)
    return last.groupBy(field.alias("field")).agg(F.count("*").alias("n"))


@case_query("""with s as (select coalesce(verified, 'NULL') as status, count(*) as n, (list(id order by id))[1:5] as sample from docs group by 1)
  select status, n, 100.0 * n / (select count(*) from docs) as pct, sample from s""")
def a35_diagnosis(t: World):
    # samples are the five smallest ids: kept per task, so no list of all ids is ever made
    d = t.docs.select(F.coalesce("verified", F.lit("NULL")).alias("status"), "id")
    n = d.groupBy("status").agg(F.count("*").alias("n"))
    ranked = d.withColumn("part", F.pmod("id", F.lit(64)))
    near = ranked.withColumn("k", F.row_number().over(Window.partitionBy("status", "part").orderBy("id"))).where("k <= 5")
    sample = near.groupBy("status").agg(F.slice(F.array_sort(F.collect_list("id")), 1, 5).alias("sample"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(sample, "status").crossJoin(total).select("status", "n", share(F.col("n"), F.col("total")).alias("pct"), "sample")


@case_query("""with g as (select subject, count(*) as n from mails where status is null or status <> 'PROCESADO' group by 1 having count(*) >= 2) select coalesce(subject, '') as subject, n from g order by n desc, subject limit 5""")
def a39_gaps(t: World):
    g = t.mails.where(~F.col("status").eqNullSafe("PROCESADO")).groupBy(F.coalesce("subject", F.lit("")).alias("subject")).agg(F.count("*").alias("n")).where("n >= 2")
    return top_k(g, "n", 5, "subject")


@case_query("""select 'city' as kind, city as name, n from (select city, count(*) as n from cases where coalesce(city, '') <> '' group by 1 order by n desc, city limit 10)
  union all select 'lawyer', lawyer, n from (select lawyer, count(*) as n from cases where coalesce(lawyer, '') <> '' group by 1 order by n desc, lawyer limit 10)""")
def a42_cover_lists(t: World):
    top = lambda c: top_k(t.cases.where(filled_sql(F.col(c))).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")), "n", 10, "name").select(F.lit(c).alias("kind"), "name", "n")
    return top("city").unionByName(top("lawyer"))


@case_query("""select count(*) as total, count(distinct message_id) as messages, count(*) filter (case_id is not null) as matched, count(*) filter (status = 'PROCESADO') as done, count(*) filter (status ilike 'ignorado') as ignored from mails""")
def a43_mail_totals(t: World):
    s = F.col("status")
    return t.mails.agg(F.count("*").alias("total"), F.count_distinct("message_id").alias("messages"), F.count_if(F.col("case_id").isNotNull()).alias("matched"), F.count_if(s == "PROCESADO").alias("done"), F.count_if(s.ilike("ignorado")).alias("ignored"))


@case_query("""select city, 100.0 * count(*) filter (length(trim(coalesce(claimant, ''))) > 0) / count(*) as claimant, 100.0 * count(*) filter (length(trim(coalesce(court, ''))) > 0) / count(*) as court from cases group by 1""")
def p10_blank_share(t: World):
    part = lambda c: share(F.count_if(filled_trim(F.col(c))), F.count("*")).alias(c)
    return t.cases.groupBy("city").agg(part("claimant"), part("court"))
