"""Further diagnosis, relocation, repair and extraction on cases, documents and mails."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import classes, extract
from lexmill.functions.cases import spaced_id
from lexmill.functions.compat import all_matches, digits, filled_sql, filled_trim, let, normal_name, parse_dmy, strip_accents
from lexmill.functions.patterns import CATALOGUE
from lexmill.operators import extraction, matching, relational
from lexmill.plans.casejoins import LONG, YEAR_SEQ, d08_fragments, w04_canonical_document
from lexmill.plans.casework import DATE, DIGITS, DOC_CLASS, NAME
from lexmill.plans.catalogue import ORACLES
from lexmill.plans.world import World, case_query


@case_query("select true as close, count(*) > 0 as some from mails")
def a46_approximate_distinct(t: World):
    # the sketch lies within three of its standard errors of 2 % of the exact number
    d = t.mails.agg(F.approx_count_distinct("message_id", 0.02).alias("a"), F.count_distinct("message_id").alias("e"), F.count("*").alias("n"))
    return d.select((F.abs(F.col("a") - F.col("e")) <= 0.06 * F.col("e")).alias("close"), (F.col("n") > 0).alias("some"))


@case_query("select status, id from (select coalesce(status, '') as status, id, row_number() over (partition by status order by id) as k from cases) where k <= 3")
def o07_samples(t: World):
    return matching.lowest(t.cases.select(F.coalesce("status", F.lit("")).alias("status"), "id"), "status", 3)


_NAMED = {"court_id": "radicado_23_continuous", "filing": "forest_specific", "claimant": "accionante_explicit", "city": "personero_municipio", "lawyer": "abogado_footer"}
_REGEX = {p.name: p.regex for p in CATALOGUE}
_IN_TEXTS = " union ".join(f"select case_id, '{f}' as field from docs where regexp_matches(text, '{_REGEX[n]}')" for f, n in _NAMED.items())
_IN_MAILS = " union ".join(f"select case_id, '{f}' as field from mails where case_id is not null and regexp_matches(subject, '{_REGEX[n]}')" for f, n in _NAMED.items())
_IN_ROWS = " union ".join(f"select id as case_id, '{f}' as field from cases where trim(coalesce({f}, '')) <> ''" for f in _NAMED)


@case_query(f"""with a as ({_IN_TEXTS}), b as ({_IN_MAILS}), c as ({_IN_ROWS}), k as (select * from a union select * from b union select * from c)
  select case_id, field, exists (select 1 from a where a.case_id = k.case_id and a.field = k.field) as in_texts, exists (select 1 from b where b.case_id = k.case_id and b.field = k.field) as in_mails, exists (select 1 from c where c.case_id = k.case_id and c.field = k.field) as in_rows from k""")
def u05_field_names(t: World):
    # the union of the fields that texts, mails and the case's own row give, and which of them do
    names = tuple(_NAMED.values())
    texts = extraction.found_values(t.docs, "id", "text", names).select("id", "field").distinct().join(t.docs.select("id", "case_id"), "id").select("case_id", "field", F.lit(0).alias("source"))
    mails = extraction.found_values(t.mails, "id", "subject", names).select("id", "field").distinct().join(t.mails.where("case_id is not null").select("id", "case_id"), "id").select("case_id", "field", F.lit(1).alias("source"))
    filled = F.filter(F.array(*(F.when(filled_trim(F.col(f)), F.lit(f)) for f in _NAMED)), lambda x: x.isNotNull())
    rows = t.cases.select(F.col("id").alias("case_id"), F.explode(filled).alias("field"), F.lit(2).alias("source"))
    from_ = lambda n, name: F.bool_or(F.col("source") == n).alias(name)
    return texts.unionByName(mails).unionByName(rows).groupBy("case_id", "field").agg(from_(0, "in_texts"), from_(1, "in_mails"), from_(2, "in_rows"))


@case_query(r"""with n as (select case_id, count(*) as docs from docs group by 1), k as (select id, coalesce(folder, '') as f, coalesce(docs, 0) as docs from cases left join n on case_id = id)
  select case when f = '' then 'unnamed' when regexp_matches(f, '^20\d{3}-') then 'typo' when coalesce(try_cast(nullif(regexp_extract(f, '^(\d{4})-(\d{4,})(?:\s|$)', 2), '') as bigint) >= 10000, false) then 'filing' when contains(upper(f), 'PENDIENTE') or contains(upper(f), 'CORREO') or not regexp_matches(f, '^\d{4}-\d{3,}') then 'suspicious' else 'case' end as kind,
  count(*) as folders, sum(docs)::bigint as docs, count(*) filter (docs = 0) as empty from k group by 1""")
def d09_folder_lists(t: World):
    n = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("docs"))
    f = F.coalesce("folder", F.lit(""))
    kind = F.when(f == "", "unnamed").when(classes.mistyped_folder(f), "typo").when(classes.filing_folder(f), "filing").when(classes.suspicious_folder(f).isNotNull(), "suspicious").otherwise("case")
    d = t.cases.select("id", kind.alias("kind")).join(n, "id", "left").na.fill(0, ["docs"])
    return d.groupBy("kind").agg(F.count("*").alias("folders"), F.sum("docs").alias("docs"), F.count_if(F.col("docs") == 0).alias("empty"))


@case_query(rf"""with x as (select case_id, regexp_extract_all(coalesce(text, ''), '68\d{{21}}') as ids, regexp_extract(coalesce(text, ''), 'accionante ([A-Z][a-z]+ [A-Z][a-z]+)', 1) as name from docs), i as (select case_id, unnest(ids) as i from x),
  n as (select x.case_id, count(distinct i) as ids, count(distinct nullif(name, '')) as names from x left join i on i.case_id = x.case_id group by 1)
  select case_id, ids, names, case when ids = 1 then 'SINGLE_BY_ID' when ids > 1 then 'MULTIPLE' when names = 1 then 'SINGLE_BY_NAME' else 'REVIEW' end as kind from n""")
def d11_folder_kinds(t: World):
    text = F.coalesce("text", F.lit(""))
    d = t.docs.select("case_id", F.explode_outer(F.regexp_extract_all(text, F.lit(r"(68\d{21})"), F.lit(1))).alias("i"), F.nullif(F.regexp_extract(text, r"accionante ([A-Z][a-z]+ [A-Z][a-z]+)", 1), F.lit("")).alias("name"))
    n = d.groupBy("case_id").agg(F.count_distinct("i").alias("ids"), F.count_distinct("name").alias("names"))
    return n.withColumn("kind", F.when(F.col("ids") == 1, "SINGLE_BY_ID").when(F.col("ids") > 1, "MULTIPLE").when(F.col("names") == 1, "SINGLE_BY_NAME").otherwise("REVIEW"))


TOKENS = f"list_distinct(list_filter(string_split({NAME}, ' '), lambda w: length(w) >= 3))"


@case_query(f"""with n as (select distinct {NAME} as name, {TOKENS} as w from cases), k as (select name, unnest(w) as w from n), p as (select a.name as a, b.name as b, count(*) as shared from k a join k b on a.w = b.w and a.name <> b.name group by 1, 2 having count(*) >= 2),
  m as (select id, {NAME} as name, city from cases where status = 'DUPLICATE_MERGED'), o as (select {NAME} as name, city, min(id) as id from cases where status is distinct from 'DUPLICATE_MERGED' group by 1, 2),
  s as (select m.id, o.id as canonical, shared + (coalesce(m.city = o.city, false))::int as score from m join p on p.a = m.name join o on o.name = p.b), r as (select *, row_number() over (partition by id order by score desc, canonical) as k from s where score >= 3)
  select id, canonical, score from r where k = 1""")
def d17_canonical_by_tokens(t: World):
    # names are few; tokens pair distinct names, cases meet through the smallest id of a name and city
    name = normal_name(F.coalesce("claimant", F.lit("")))
    cases = t.cases.select("id", name.alias("name"), "city", "status")
    tokens = F.array_distinct(F.filter(F.split("name", " "), lambda w: F.length(w) >= 3))
    pairs = relational.token_overlap(cases.select("name").distinct(), "name", tokens, 2)
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    m = cases.where("status = 'DUPLICATE_MERGED'").select("id", F.col("name").alias("a"), F.col("city").alias("own"))
    o = cases.where(~F.col("status").eqNullSafe("DUPLICATE_MERGED")).groupBy(F.col("name").alias("b"), "city").agg(F.min("id").alias("canonical"))
    s = m.join(pairs, "a").join(o, "b").withColumn("score", F.col("shared") + F.coalesce((F.col("own") == F.col("city")).cast("int"), F.lit(0))).where("score >= 3")
    return s.groupBy("id").agg(F.max_by(F.struct("canonical", "score"), F.struct("score", -F.col("canonical"))).alias("b")).select("id", "b.canonical", "b.score")


@case_query(f"""with k as (select id, left({LONG}, 20) as a, {YEAR_SEQ.format('folder')} as b from cases), x as (select a, count(*) as n, min(id) as lo, max(id) as hi from k where a is not null group by 1), y as (select b, count(*) as n, min(id) as lo, max(id) as hi from k where b is not null group by 1)
  select k.id, coalesce(x.n - 1, 0) as same_id, coalesce(y.n - 1, 0) as same_short from k left join x using (a) left join y using (b) where coalesce(x.n, 0) > 1 or coalesce(y.n, 0) > 1""")
def d19_potential_duplicates(t: World):
    k = matching.with_keys(t.cases.select("id", "court_id", "folder"), "folder")
    count = lambda key, out: k.where(F.col(key).isNotNull()).groupBy(key).agg((F.count("*") - 1).alias(out))
    d = k.join(count("__front", "same_id"), "__front", "left").join(count("__short", "same_short"), "__short", "left")
    return d.select("id", F.coalesce("same_id", F.lit(0)).alias("same_id"), F.coalesce("same_short", F.lit(0)).alias("same_short")).where("same_id > 0 or same_short > 0")


@case_query(f"""select 'missing id' as issue, count(*) as n from cases where {DIGITS} = '' union all select 'malformed id', count(*) from cases where length({DIGITS}) between 1 and 17 or length({DIGITS}) > 25
  union all select 'hash groups', count(*) from (select file_hash from docs group by 1 having count(*) > 1) union all select 'suspicious documents', count(*) from docs where verified = 'SOSPECHOSO'
  union all select 'documents without mail', count(*) from docs where mail_id is null union all select 'mails without case', count(*) from mails where case_id is null union all select 'unreviewed', count(*) from cases where status in ('REVISION', 'PENDIENTE')""")
def e08_diagnosis(t: World):
    n = F.length(digits(F.coalesce("court_id", F.lit(""))))
    hashes = t.docs.groupBy("file_hash").count().where("count > 1")
    issues = {
        "missing id": t.cases.where(n == 0), "malformed id": t.cases.where(n.between(1, 17) | (n > 25)), "hash groups": hashes, "suspicious documents": t.docs.where("verified = 'SOSPECHOSO'"),
        "documents without mail": t.docs.where("mail_id is null"), "mails without case": t.mails.where("case_id is null"), "unreviewed": t.cases.where(F.col("status").isin("REVISION", "PENDIENTE")),
    }
    out = None
    for name, d in issues.items():
        row = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("issue"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@case_query("""with d as (select id, case when mail_id is not null then mail_id end as m, case_id, regexp_extract(filename, '^Email_(\\d{8})_(\\w+?)_', 2) as word from docs), s as (select case_id, min(id) as mail from mails where case_id is not null and lower(subject) like '%traslado%' group by 1)
  select d.id, coalesce(d.m, case when d.word = 'traslado' then s.mail end) as mail, case when d.m is not null then 'path' when d.word = 'traslado' and s.mail is not null then 'subject' end as by from d left join s on s.case_id = d.case_id where d.m is not null or s.mail is not null""")
def j26_mail_of_document(t: World):
    # the mail a document names, else the first mail of its case whose subject has the word in the file's name
    word = F.regexp_extract("filename", r"^Email_(\d{8})_([A-Za-z]+?)_", 2)
    d = t.docs.select("id", "mail_id", "case_id", word.alias("word"))
    s = t.mails.where(F.col("case_id").isNotNull() & F.contains(F.lower("subject"), F.lit("traslado"))).groupBy("case_id").agg(F.min("id").alias("mail"))
    j = d.join(s, "case_id", "left").where("mail_id is not null or mail is not null")
    by_subject = (F.col("word") == "traslado") & F.col("mail").isNotNull()
    return j.select("id", F.coalesce("mail_id", F.when(by_subject, F.col("mail"))).alias("mail"), F.when(F.col("mail_id").isNotNull(), "path").when(by_subject, "subject").alias("by"))


@case_query(rf"""with d as (select id, case_id, left(regexp_extract(coalesce(text, ''), '68\d{{17,21}}'), 20) as front, regexp_extract(coalesce(text, ''), '(?i)FOREST\s*(?:No\.?\s*)?:?\s*(\d{{5,13}})', 1) as filing from docs where verified = 'SOSPECHOSO'),
  c as (select id, left({LONG}, 20) as front, filing from cases), h as (select d.id, min(c.id) as x from d join c on c.front = d.front and c.id <> d.case_id group by 1), f as (select d.id, min(c.id) as x from d join c on c.filing = d.filing and c.id <> d.case_id group by 1)
  select d.id, coalesce(h.x, f.x) as target, case when h.x is not null then 0.95::double else 0.9 end as confidence from d left join h on h.id = d.id left join f on f.id = d.id where h.x is not null or f.x is not null""")
def j35_relocations(t: World):
    text = F.coalesce("text", F.lit(""))
    d = t.docs.where("verified = 'SOSPECHOSO'").select(F.col("id").alias("doc"), "case_id", F.nullif(F.left(F.regexp_extract(text, r"(68\d{17,21})", 1), F.lit(20)), F.lit("")).alias("front"), F.nullif(F.regexp_extract(text, extract.FILING_WORD, 1), F.lit("")).alias("filing"))
    c = t.cases.select("id", F.left(matching.long_digits(F.coalesce("court_id", F.lit(""))), F.lit(20)).alias("front"), "filing")
    # two cases of a key are enough to find one that is not the document's own
    hit = lambda key, out: d.select("doc", "case_id", key).join(matching.lowest(c.select("id", key), key, 2), key).where("id <> case_id").groupBy("doc").agg(F.min("id").alias(out))
    j = d.select("doc").join(hit("front", "a"), "doc", "left").join(hit("filing", "b"), "doc", "left").where("a is not null or b is not null")
    return j.select(F.col("doc").alias("id"), F.coalesce("a", "b").alias("target"), F.when(F.col("a").isNotNull(), 0.95).otherwise(0.9).alias("confidence"))


@case_query(f"""with t as (select id as case_id, parent from ({ORACLES['d08_fragments']}) where parent is not null and confidence = 'ALTA')
  select docs.id, coalesce(parent, docs.case_id) as case_id, parent is not null as moved from docs left join t on t.case_id = docs.case_id""")
def m08_merge_fragments(t: World):
    to = d08_fragments(t).where("parent is not null and confidence = 'ALTA'").select(F.col("id").alias("case_id"), "parent")
    return t.docs.select("id", "case_id").join(to, "case_id", "left").select("id", F.coalesce("parent", "case_id").alias("case_id"), F.col("parent").isNotNull().alias("moved"))


@case_query(f"""with s as (select id, min(case_id) as own from ({ORACLES['j23_suggest']}) where tier = 'ALTA' group by 1),
  d as (select docs.id, case_id, mail_id, own from docs left join s on s.id = docs.id and verified = 'NO_PERTENECE'), p as (select mail_id, min(own) as together from d where own is not null and mail_id is not null group by 1)
  select d.id, coalesce(own, together, case_id) as case_id, coalesce(own, together) is not null as moved from d left join p on p.mail_id = d.mail_id""")
def m09_move_misfiled(t: World):
    # documents that surely belong elsewhere move, and those of the same mail with them
    sure = matching.suggest_cases(t.docs.where("verified = 'NO_PERTENECE'"), t.cases).where("tier = 'ALTA'").groupBy("id").agg(F.min("case_id").alias("own"))
    d = t.docs.select("id", "case_id", "mail_id").join(sure, "id", "left")
    package = d.where("own is not null and mail_id is not null").groupBy("mail_id").agg(F.min("own").alias("together"))
    return d.join(package, "mail_id", "left").select("id", F.coalesce("own", "together", "case_id").alias("case_id"), F.coalesce("own", "together").isNotNull().alias("moved"))


@case_query(r"""with n as (select id, 'Email_' || strftime(received, '%Y%m%d') || '_' || left(regexp_replace(coalesce(subject, 'sin asunto'), '[^A-Za-z0-9]+', '_', 'g'), 30) || '.md' as name, case_id from mails where case_id is not null)
  select name, case_id, min(id) as mail, count(*) as mails from n where not exists (select 1 from docs d where d.case_id = n.case_id and d.filename = n.name) group by 1, 2""")
def m14_missing_mail_files(t: World):
    subject = F.left(F.regexp_replace(F.coalesce("subject", F.lit("sin asunto")), r"[^A-Za-z0-9]+", "_"), F.lit(30))
    name = F.concat(F.lit("Email_"), F.date_format("received", "yyyyMMdd"), F.lit("_"), subject, F.lit(".md"))
    n = t.mails.where("case_id is not null").select("id", name.alias("name"), "case_id")
    there = t.docs.select("case_id", F.col("filename").alias("name"))
    return n.join(there, ["case_id", "name"], "left_anti").groupBy("name", "case_id").agg(F.min("id").alias("mail"), F.count("*").alias("mails"))


@case_query(rf"""with m as (select id, regexp_extract(coalesce(subject, ''), '(20\d\d)-0*(\d+)', 1) as y, regexp_extract(coalesce(subject, ''), '(20\d\d)-0*(\d+)', 2) as n from mails where case_id is null),
  c as (select distinct {YEAR_SEQ.format('folder')} as ys from cases) select y || '-' || repeat('0', greatest(5 - length(n), 0)::int) || n as folder, min(id) as mail, count(*) as mails from m where n <> '' and y || ':' || n not in (select ys from c where ys is not null) group by 1""")
def m16_cases_for_orphans(t: World):
    short = classes.folder_id(F.regexp_extract(F.coalesce("subject", F.lit("")), r"(20\d{2}-\d+)", 1))
    m = t.mails.where("case_id is null").select("id", short.alias("folder")).where("folder is not null").withColumn("ys", matching.year_sequence(F.col("folder")))
    known = t.cases.select(matching.year_sequence(F.col("folder")).alias("ys"))
    return m.join(known, "ys", "left_anti").groupBy("folder").agg(F.min("id").alias("mail"), F.count("*").alias("mails"))


@case_query("""with k as (select d.id, file_hash, verified, case_id, ((coalesce(court, '') <> '')::int + (coalesce(city, '') <> '')::int + (coalesce(claimant, '') <> '')::int) as f from docs d join cases c on c.id = d.case_id),
  r as (select *, row_number() over (partition by file_hash order by f desc, case_id, id) as k from k) select id, case when k > 1 then 'DUPLICADO' else verified end as verified from r""")
def m24_mark_duplicates(t: World):
    extra = w04_canonical_document(t).where("duplicate").select("id", F.lit("DUPLICADO").alias("mark"))
    return t.docs.select("id", "verified").join(extra, "id", "left").select("id", F.coalesce("mark", "verified").alias("verified"))


@case_query(r"""select id, case when coalesce(trim(claimant), '') = '' or length(trim(claimant)) < 5 then nullif(trim(regexp_replace(coalesce(folder, ''), '^20\d\d-\d+', '')), '') else claimant end as claimant from cases""")
def m28_repair_claimants(t: World):
    folder = F.nullif(F.btrim(F.regexp_replace(F.coalesce("folder", F.lit("")), r"^20\d{2}-\d+", "")), F.lit(""))
    poor = F.length(F.btrim(F.coalesce("claimant", F.lit("")))) < 5
    return t.cases.select("id", F.when(poor, folder).otherwise(F.col("claimant")).alias("claimant"))


@case_query(r"""with r as (select id, upper(trim(coalesce(ruling1, ''))) as r, coalesce(court_id, '') as c, trim(coalesce(notes, '')) as n, coalesce(folder, '') as f,
    coalesce(nullif(regexp_extract(coalesce(folder, ''), '(20\d\d-\d{3,5})', 1), ''), '-') as named, substr(coalesce(court_id, ''), 13, 4) || '-' || substr(coalesce(court_id, ''), 17, 5) as own from cases)
  select id, case when r = '' then null when contains(r, 'PARCIAL') then 'CONCEDE PARCIALMENTE' when starts_with(r, 'CONCEDE') or starts_with(r, 'TUTELA') or starts_with(r, 'AMPARA') then 'CONCEDE' when starts_with(r, 'NIEGA') or starts_with(r, 'DENIEGA') then 'NIEGA' when contains(r, 'IMPROCEDENTE') then 'IMPROCEDENTE' else 'OTRO' end as ruling,
    regexp_replace(c, '^(\d\d)(\d{3})(\d\d)(\d\d)(\d{3})(\d{4})(\d{5})(\d\d)$', '\1-\2-\3-\4-\5-\6-\7-\8') as court_id,
    concat_ws(' ', case when n <> '' then n || '.' end, case when named = '-' or named = own then 'Ver ' || f || '.' end, 'Fin.') as notes from r""")
def f35_validated(t: World):
    r = F.upper(F.btrim(F.coalesce("ruling1", F.lit(""))))
    ruling = (
        F.when(r == "", None).when(F.contains(r, F.lit("PARCIAL")), "CONCEDE PARCIALMENTE").when(F.regexp_like(r, F.lit("^(CONCEDE|TUTELA|AMPARA)")), "CONCEDE")
        .when(F.regexp_like(r, F.lit("^(NIEGA|DENIEGA)")), "NIEGA").when(F.contains(r, F.lit("IMPROCEDENTE")), "IMPROCEDENTE").otherwise("OTRO")
    )
    # sentences of the notes that name another year and sequence go
    c = F.coalesce("court_id", F.lit(""))
    own = F.concat(F.substring(c, 13, 4), F.lit("-"), F.substring(c, 17, 5))
    said = F.btrim(F.coalesce("notes", F.lit("")))
    sentences = (F.when(said != "", F.concat(said, F.lit("."))), F.concat(F.lit("Ver "), F.coalesce("folder", F.lit("")), F.lit(".")), F.lit("Fin."))
    foreign = lambda x: F.regexp_like(F.when(F.length(own) == 10, F.replace(x, own, F.lit(""))).otherwise(x), F.lit(r"20\d{2}-\d{3,5}"))
    kept = F.concat_ws(" ", *(F.when(~foreign(x), x) for x in sentences))
    return t.cases.select("id", ruling.alias("ruling"), spaced_id(F.coalesce("court_id", F.lit(""))).alias("court_id"), kept.alias("notes"))


THEMES = {"HEALTH": ["salud", "cita m[eé]dica"], "TEACHERS": ["docente", "n[oó]mina"], "ENROLMENT": ["cupo.*escolar", "matr[ií]cula"], "TRANSPORT": ["transporte escolar", "ruta"]}
_SCORE = {n: " + ".join(f"(regexp_matches(x, '{p}'))::int" for p in own) for n, own in THEMES.items()}
_THEME_ROWS = " union all ".join(f"select id, {i} as i, '{n}' as name, case when '{n}' = 'TEACHERS' and ({_SCORE['ENROLMENT']}) > 0 then 0 else {s} end as score from s" for i, (n, s) in enumerate(_SCORE.items()))


@case_query(f"""with s as (select id, lower(coalesce(subject, '') || ' ' || coalesce(rights, '')) as x from cases), r as ({_THEME_ROWS}), k as (select *, row_number() over (partition by id order by score desc, i) as k from r) select coalesce(case when score > 0 then name end, 'GENERAL') as theme, count(*) as n from k where k = 1 group by 1""")
def f38_themes(t: World):
    # also A30
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("rights", F.lit("")))
    theme = extract.category_scores(text, THEMES, {"TEACHERS": ("ENROLMENT",)})
    return t.cases.groupBy(F.coalesce(theme, F.lit("GENERAL")).alias("theme")).agg(F.count("*").alias("n"))


FAMILIES = [("E11", "SALUD"), ("E11", "VIDA DIGNA"), ("C50", "SALUD"), ("C50", "VIDA DIGNA"), ("C50", "SEGURIDAD SOCIAL")]


@case_query("""with f(family, name) as (values ('E11', 'SALUD'), ('E11', 'VIDA DIGNA'), ('C50', 'SALUD'), ('C50', 'VIDA DIGNA'), ('C50', 'SEGURIDAD SOCIAL')), d as (select id, unnest(regexp_extract_all(coalesce(text, ''), '[A-TV-Z][0-9]{2}')) as family from docs)
  select id, list_sort(list_distinct(list(name))) as rights from d join f using (family) group by 1""")
def f39_rights_of_diagnoses(t: World):
    f = t.spark.createDataFrame(FAMILIES, "family string, name string")
    d = t.docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-TV-Z][0-9]{2})"), F.lit(1)))).alias("family"))
    return d.join(F.broadcast(f), "family").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("rights"))


@case_query("""select id, 'a' || id as a, case when id % 3 > 0 then 'x, "y' end as b from cases""")
def f42_repaired_json(t: World):
    i = F.col("id").cast("string")
    whole = F.concat(F.lit('{"a": "a'), i, F.lit('", "b": "x, \\"y"}'))
    cut = F.when(F.col("id") % 3 == 0, F.concat(F.lit('Sure: {"a": "a'), i, F.lit('", "b": "x, \\"'))).when(F.col("id") % 3 == 1, whole).otherwise(F.concat(F.left(whole, F.length(whole) - 1), F.lit(', "c')))
    m = t.cases.select("id", extract.repaired_json(cut).alias("m"))
    return m.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@case_query(r"""select id, 'A' || chr(10) || chr(10) || 'b c' || left(coalesce(folder, ''), 9) || '[BOILERPLATE]z' as text from cases where length(coalesce(folder, '')) < 400 and not regexp_matches(left(coalesce(folder, ''), 9), ' {3}')""")
def f43_compressed(t: World):
    f = F.left(F.coalesce("folder", F.lit("")), F.lit(9))
    text = F.concat(F.lit("A\n\n\n\nb     c"), f, F.lit("AVISO DE CONFIDENCIALIDAD este\nmail\n\nz"))
    return t.cases.where(~F.contains(f, F.lit("   "))).select("id", extract.compressed(text).alias("text"))


PATTERNS = {"court_id": r"68\d{21}", "phone": r"3\d{9}", "email": r"[\w.]+@[\w.]+", "law": r"T-\d+ de \d{4}", "article": r"Art\. \d+", "diagnosis": r"[A-TV-Z]\d{2}", "dotted": r"\d{2}\.\d{3}\.\d{3}"}
#: What stands in every match, and a form of the same pattern that reads a run of letters once, whatever its length.
NEEDS = {"court_id": ("68",), "email": ("@",), "law": ("T-",), "article": ("Art. ",)}
SAME = {"email": r"(?<![\w.])[\w.]++@[\w.]+"}


@case_query("with x as (" + " union all ".join(f"select id, '{n}' as name, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '{p}'))) as value from docs" for n, p in PATTERNS.items()) + ") select name, count(*) as n, count(distinct value) as values_ from x group by 1")
def x01_pattern_counts(t: World):
    # also X25: every identifier of every document, once, by the pattern that finds it
    text = F.coalesce("text", F.lit(""))
    found = F.array(*(F.struct(F.lit(n).alias("name"), F.array_distinct(all_matches(text, SAME.get(n, p), NEEDS.get(n, ()))).alias("v")) for n, p in PATTERNS.items()))
    d = t.docs.select("id", F.explode(found).alias("f")).select("id", "f.name", F.explode("f.v").alias("value"))
    return d.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values_"))


@case_query(rf"""with d as (select case_id, id, {DOC_CLASS} as class, regexp_extract(coalesce(text, ''), '(?i)(\d{{1,2}})\s+de\s+(enero|marzo)\s+de\s+(\d{{4}})', ['d', 'm', 'y']) as x from docs), e as (select *, make_date(try_cast(x.y as int), case lower(x.m) when 'enero' then 1 when 'marzo' then 3 end, try_cast(x.d as int)) as day from d),
  r as (select *, case class when 'PDF_SENTENCIA' then 90 when 'PDF_AUTO_ADMISORIO' then 80 else 55 end as confidence from e where day is not null), k as (select *, row_number() over (partition by case_id order by confidence desc, id) as k from r) select case_id, day, confidence from k where k = 1""")
def x06_ruling_dates(t: World):
    from lexmill.functions.cases import written_date

    c = classes.document_class(F.col("filename"))
    sure = F.when(c == "PDF_SENTENCIA", 90).when(c == "PDF_AUTO_ADMISORIO", 80).otherwise(55)
    d = t.docs.select("case_id", "id", written_date(F.col("text")).alias("day"), sure.alias("confidence")).where("day is not null")
    return d.groupBy("case_id").agg(F.min_by(F.struct("day", "confidence"), F.struct(-F.col("confidence"), "id")).alias("b")).select("case_id", "b.day", "b.confidence")


@case_query(r"""select id, nullif(regexp_extract(coalesce(text, ''), 'accionante\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*)', 1), '') as claimant, nullif(regexp_extract(coalesce(text, ''), '\.\s*([A-Z][a-z]+), \d{1,2} de', 1), '') as city from docs where contains(text, 'accionante')""")
def x11_claimant_and_city(t: World):
    # also X8
    text = F.coalesce("text", F.lit(""))
    name = F.regexp_extract(text, r"accionante\s+([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?: [A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*)", 1)
    city = F.regexp_extract(text, r"\.\s*([A-Z][a-z]+), \d{1,2} de", 1)
    return t.docs.where(F.contains("text", F.lit("accionante"))).select("id", F.nullif(name, F.lit("")).alias("claimant"), F.nullif(city, F.lit("")).alias("city"))


@case_query(rf"""with d as (select case_id, id, case when contains(coalesce(text, ''), 'RESUELVE') then case when regexp_matches(text, 'CONCEDE|TUTELAR') then 'CONCEDE' when contains(lower(text), 'improcedente') then 'IMPROCEDENTE' when contains(text, 'NIEGA') then 'NIEGA' end end as z,
    case when contains(upper(filename), 'CONCEDE') then 'CONCEDE' when contains(upper(filename), 'NIEGA') then 'NIEGA' end as f from docs),
  r as (select case_id, coalesce(z, f) as ruling, case when z is not null then 85 else 70 end as confidence, row_number() over (partition by case_id order by (z is null)::int, id) as k from d where coalesce(z, f) is not null) select case_id, ruling, confidence from r where k = 1""")
def x10_ruling(t: World):
    text = F.coalesce("text", F.lit(""))
    zone = F.when(F.regexp_like(text, F.lit("CONCEDE|TUTELAR")), "CONCEDE").when(F.contains(F.lower(text), F.lit("improcedente")), "IMPROCEDENTE").when(F.contains(text, F.lit("NIEGA")), "NIEGA")
    z = F.when(F.contains(text, F.lit("RESUELVE")), zone)
    f = classes.by_words(F.upper("filename"), ((("CONCEDE",), "CONCEDE"), (("NIEGA",), "NIEGA")), None)
    d = t.docs.select("case_id", "id", z.alias("z"), f.alias("f")).where("coalesce(z, f) is not null")
    pick = F.struct(F.coalesce("z", "f").alias("ruling"), F.when(F.col("z").isNotNull(), 85).otherwise(70).alias("confidence"))
    return d.groupBy("case_id").agg(F.min_by(pick, F.struct(F.col("z").isNull(), "id")).alias("b")).select("case_id", "b.*")


@case_query("""with k as (select id, nullif(court, '') as r, case when id % 4 = 0 then 60 else 85 end as rc, case when id % 3 = 0 then 'COURT C' end as c, case when id % 5 = 0 then 'COURT A' end as a from cases)
  select id, case when a is not null then coalesce(case when upper(r) = a then r end, a) when c is not null and (r is null or rc < 80) then c else r end as value, case when a is not null then 'model' when c is not null and (r is null or rc < 80) then 'reading' when r is not null then 'pattern' end as source from k""")
def x16_three_sources(t: World):
    # the model's value first; the reading's where there is none and the pattern is missing or unsure; else the pattern's. Also X23
    r = F.nullif("court", F.lit(""))
    sure = F.when(F.col("id") % 4 == 0, 60).otherwise(85)
    reading, model = F.when(F.col("id") % 3 == 0, "COURT C"), F.when(F.col("id") % 5 == 0, "COURT A")
    read = reading.isNotNull() & (r.isNull() | (sure < 80))
    value = F.when(model.isNotNull(), model).when(read, reading).otherwise(r)
    return t.cases.select("id", value.alias("value"), F.when(model.isNotNull(), "model").when(read, "reading").when(r.isNotNull(), "pattern").alias("source"))


@case_query(r"""with d as (select id, case when contains(text, 'Bucaramanga') then '15 de marzo de 2024' when contains(text, 'Dado el') then '5 de enero de 2023' end as date from docs) select * from d where date is not null""")
def x20_nearest_date(t: World):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" leído 01/02/2020"))
    place = F.greatest(F.instr(text, F.lit("Bucaramanga")), F.instr(text, F.lit("Dado el")))
    return t.docs.select("id", place.alias("p"), extract.nearest_date(text, place).alias("date")).where("p > 0").drop("p")


@case_query(rf"""with m as (select case_id, 'mail' as kind, received::date as day, min(id) as id from mails where case_id is not null group by 1, 2, 3), d as (select c.id as case_id, 'ruling' as kind, {DATE.format('ruling1_date')} as day, c.id as id from cases c union all select c.id, 'answer', {DATE.format('answered')}, c.id from cases c),
  e as (select * from m union all select * from d where day is not null), r as (select *, row_number() over (partition by case_id order by day, kind) as k from e where year(day) between 2000 and 2030) select case_id, kind, day, k as place from r where k <= 8""")
def x21_timeline(t: World):
    m = t.mails.where("case_id is not null").groupBy("case_id", F.lit("mail").alias("kind"), F.to_date("received").alias("day")).agg(F.min("id").alias("id")).drop("id")
    day = lambda kind, c: t.cases.select(F.col("id").alias("case_id"), F.lit(kind).alias("kind"), parse_dmy(F.col(c)).alias("day"))
    e = m.unionByName(day("ruling", "ruling1_date")).unionByName(day("answer", "answered")).where(F.year("day").between(2000, 2030)).distinct()
    k = F.row_number().over(Window.partitionBy("case_id").orderBy("day", "kind"))
    return e.withColumn("place", k.cast("bigint")).where("place <= 8").select("case_id", "kind", "day", "place")


@case_query("""select id, 'Tutela de ' || coalesce(nullif(trim(claimant), ''), 'N/A') || ' contra ' || coalesce(nullif(defendants, ''), 'N/A') || case when coalesce(rights, '') <> '' then ' por ' || lower(rights) else '' end as narrative from cases""")
def x22_narrative(t: World):
    or_na = lambda c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), F.lit("N/A"))
    by = F.when(filled_sql(F.col("rights")), F.concat(F.lit(" por "), F.lower("rights"))).otherwise("")
    return t.cases.select("id", F.concat(F.lit("Tutela de "), or_na("claimant"), F.lit(" contra "), F.coalesce(F.nullif("defendants", F.lit("")), F.lit("N/A")), by).alias("narrative"))


CONTENT = {"SENTENCIA": [r"resuelve", r"concede|niega|improcedente"], "CORREO": [r"correo", r"@"], "HISTORIA": [r"diagn[oó]stico"], "FILING": [r"forest", r"radicado \d{8,}"]}
_CONTENT = {n: " + ".join(f"(regexp_matches(x, '{p}'))::int" for p in own) for n, own in CONTENT.items()}
_CONTENT_ROWS = " union all ".join(f"select id, x, {i} as i, '{n}' as name, {s} as score from s" for i, (n, s) in enumerate(_CONTENT.items()))


@case_query(f"""with s as (select id, lower(left(coalesce(text, ''), 2000)) as x from docs), r as ({_CONTENT_ROWS}), k as (select *, row_number() over (partition by id order by score desc, i) as k from r) select id, case when trim(x) = '' then 'SCAN_SIN_TEXTO' when score > 0 then name else 'OTRO' end as class from k where k = 1""")
def x24_content_class(t: World):
    head = F.left(F.coalesce("text", F.lit("")), F.lit(2000))
    found = F.coalesce(extract.category_scores(head, CONTENT), F.lit("OTRO"))
    return t.docs.select("id", F.when(F.btrim(head) == "", "SCAN_SIN_TEXTO").otherwise(found).alias("class"))


@case_query(r"""with x as (select id, coalesce(text, '') as x from docs), b as (select id, len(regexp_extract_all(x, '3\d{9}')) + len(regexp_extract_all(x, '[\w.]+@[\w.]+')) as before, regexp_replace(regexp_replace(x, '3\d{9}', '[TEL]', 'g'), '[\w.]+@[\w.]+', '[EMAIL]', 'g') as y from x)
  select sum(before)::bigint as before, sum(len(regexp_extract_all(y, '3\d{9}')) + len(regexp_extract_all(y, '[\w.]+@[\w.]+')))::bigint as after, count(*) filter (before > 0) as touched from b""")
def x35_before_and_after(t: World):
    phone, mail = r"3\d{9}", SAME["email"]
    left = lambda c: F.size(all_matches(c, phone)) + F.size(all_matches(c, mail, NEEDS["email"]))
    hidden = lambda c: F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, mail, "[EMAIL]")).otherwise(c)
    d = t.docs.select(F.coalesce("text", F.lit("")).alias("x"))
    # where there is nothing to hide, nothing is left
    d = d.select(left(F.col("x")).alias("b"), "x").select("b", F.when(F.col("b") > 0, let(let(F.regexp_replace("x", phone, "[TEL]"), hidden), left)).otherwise(0).alias("a"))
    return d.agg(F.sum("b").alias("before"), F.sum("a").alias("after"), F.count_if(F.col("b") > 0).alias("touched"))


@case_query("""with k as (select case_id, count(*) as n, max(id) as last from docs group by 1) select md5(coalesce(folder, '') || ':' || coalesce(n, 0) || ':' || coalesce(last, 0)) as print, id from cases left join k on case_id = id""")
def st06_folder_fingerprints(t: World):
    k = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("n"), F.max("id").alias("last"))
    text = F.concat_ws(":", F.coalesce("folder", F.lit("")), F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("last", F.lit(0)).cast("string"))
    return t.cases.select("id", "folder").join(k, "id", "left").select(F.md5(text.cast("binary")).alias("print"), "id")


@case_query("""select id, upper(strip_accents(coalesce(claimant, ''))) as plain from cases""")
def f02_plain_upper(t: World):
    return t.cases.select("id", F.upper(strip_accents(F.coalesce("claimant", F.lit("")))).alias("plain"))


@case_query(r"""with c as (select id, regexp_extract(left(coalesce(text, ''), 3000), '(?i)((?:JUZGADO|TRIBUNAL)[^\n]{3,120})', 1) as c from docs),
  d as (select id, nullif(trim(regexp_replace(c, '\s+(?:REF|RADICADO|ACCIONANTE|SEÑOR)\b.*$', '', 'i'), ' ,.-'), '') as court from c) select * from d where court is not null""")
def x07_court(t: World):
    return t.docs.select("id", extract.court_name(F.col("text")).alias("court")).where("court is not null")


@case_query(r"""with d as (select id, nullif(trim(regexp_replace(regexp_extract(coalesce(text, ''), '(?i)accionante:?\s+([\p{L} ]{5,60})', 1), '\s+(?:CONTRA|VS|ACCIONAD[OA]S?|RAD|RADICADO)\b.*$', '', 'i')), '') as claimant from docs)
  select * from d where claimant is not null""")
def x12_claimant_from_mail(t: World):
    # a document that came with a mail stands for the mail: its name the subject, its text the body
    d = t.docs.select("id", extract.claimant_in_mail(F.col("filename"), classes.forwarded_blocks(F.coalesce("text", F.lit("")))).alias("claimant"))
    return d.where("claimant is not null")


@case_query(f"""with d as (select d.case_id, d.id, c.lawyer, case {DOC_CLASS} when 'DOCX_RESPUESTA' then 1 when 'DOCX_IMPUGNACION' then 2 when 'DOCX_CUMPLIMIENTO' then 3 else 9 end as rank from docs d join cases c on c.id = d.case_id where ends_with(lower(filename), '.docx') and coalesce(c.lawyer, '') <> ''),
  r as (select *, row_number() over (partition by case_id order by rank, id) as k, count(*) over (partition by case_id) as letters from d) select case_id, id as letter, lawyer, letters from r where k = 1""")
def x13_lawyer_of_letters(t: World):
    # of several letters, the answer's signature counts before that of an appeal or of a compliance
    order = {"DOCX_RESPUESTA": 1, "DOCX_IMPUGNACION": 2, "DOCX_CUMPLIMIENTO": 3}
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), classes.document_class(F.col("filename"))), F.lit(9))
    c = t.cases.where(filled_sql(F.col("lawyer"))).select(F.col("id").alias("case_id"), "lawyer")
    d = t.docs.where(F.endswith(F.lower("filename"), F.lit(".docx"))).select("id", "case_id", rank.alias("rank")).join(c, "case_id")
    return d.groupBy("case_id").agg(F.min_by(F.struct(F.col("id").alias("letter"), "lawyer"), F.struct("rank", "id")).alias("b"), F.count("*").alias("letters")).select("case_id", "b.*", "letters")


@case_query(rf"""with t as (select id, coalesce(text, '') as x from docs), l as (select id, 'court_id' as field, regexp_extract(x, '{extract.ID_WHOLE}', 1) as value from t union all select id, 'filing', regexp_extract(x, '{extract.FILING_WORD}', 1) from t
  union all select id, 'diagnosis', regexp_extract(x, '([A-TV-Z]\d{{2}})', 1) from t) select * from l where value <> ''""")
def x14_all_extractors(t: World):
    text = F.coalesce("text", F.lit(""))
    fields = {"court_id": extract.ID_WHOLE, "filing": extract.FILING_WORD, "diagnosis": r"([A-TV-Z]\d{2})"}
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.regexp_extract(text, p, 1).alias("value")) for f, p in fields.items()))
    return t.docs.select("id", F.explode(F.filter(found, lambda x: x["value"] != "")).alias("x")).select("id", "x.*")


@case_query(r"""with m as (select case_id, strftime(received, '%Y%m%d') as day, lower(array_to_string(string_split(coalesce(subject, ''), ' ')[1:3], ' ')) as words, max(id) as mail from mails where case_id is not null group by 1, 2, 3),
  f as (select id as file, case_id, day, lower(w) as words from (select id, case_id, strftime(received, '%Y%m%d') as day, array_to_string(string_split(coalesce(subject, ''), ' ')[1:3], ' ') as w from mails where case_id is not null and id % 2 = 0)) select file, mail from f join m using (case_id, day, words)""")
def j34_legacy_mail_files(t: World):
    # files of old mails find their mail by case, day and the first three words of the subject; of equal ones the last counts
    words = F.lower(F.array_join(F.slice(F.split(F.coalesce("subject", F.lit("")), " "), 1, 3), " ")).alias("words")
    d = t.mails.where("case_id is not null").select("id", "case_id", F.date_format("received", "yyyyMMdd").alias("day"), words)
    last = d.groupBy("case_id", "day", "words").agg(F.max("id").alias("mail"))
    old = d.where("id % 2 = 0").withColumnRenamed("id", "file")  # the mails that left a file
    return old.join(last, ["case_id", "day", "words"]).select("file", "mail")
