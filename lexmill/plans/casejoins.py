"""Joins, matching, ranking, duplicates and set operations on cases, documents and mails."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import classes
from lexmill.functions.compat import digits, filled_sql, normal_name
from lexmill.operators import matching, relational
from lexmill.plans.casework import DIGITS, NAME
from lexmill.plans.world import World, case_query

LONG = f"case when length({DIGITS}) >= 18 then {DIGITS} end"
YEAR_SEQ = r"case when regexp_matches(coalesce({0}, ''), '^20\d\d[-\s]?0*\d+') then regexp_extract({0}, '^(20\d\d)[-\s]?0*(\d+)', 1) || ':' || regexp_extract({0}, '^(20\d\d)[-\s]?0*(\d+)', 2) end"


@case_query("select d.id, d.filename, c.folder from docs d join cases c on c.id = d.case_id where d.verified = 'SOSPECHOSO'")
def j03_suspicious(t: World):
    c = t.cases.select(F.col("id").alias("case_id"), "folder")
    return t.docs.where("verified = 'SOSPECHOSO'").select("id", "filename", "case_id").join(c, "case_id").drop("case_id")


@case_query("select count(distinct m.id) as n from mails m join docs d on d.mail_id = m.id where starts_with(d.filename, 'Email_')")
def j04_mails_with_file(t: World):
    d = t.docs.where(F.startswith("filename", F.lit("Email_"))).select(F.col("mail_id").alias("id"))
    return t.mails.select("id").join(d, "id", "left_semi").agg(F.count_distinct("id").alias("n"))


@case_query("select c.id from cases c left join docs d on d.case_id = c.id group by c.id having count(d.id) = 0")
def j09_empty_cases(t: World):
    return t.cases.select("id").join(t.docs.select(F.col("case_id").alias("id")), "id", "left_anti")


@case_query(f"""with k as (select id, kind, left({DIGITS}, 15) as p from cases where length({DIGITS}) >= 15) select a.id, min(b.id) as guardianship from k a join k b on a.p = b.p and a.id <> b.id where b.kind = 'TUTELA' group by a.id""")
def j17_incident_of(t: World):
    # the two smallest guardianships of a prefix are enough to find one that is not the case itself
    k = t.cases.select("id", "kind", F.left(digits(F.coalesce("court_id", F.lit(""))), F.lit(15)).alias("p")).where(F.length("p") >= 15)
    near = matching.lowest(k.where("kind = 'TUTELA'").select("id", "p"), "p", 2).withColumnRenamed("id", "other")
    return k.select("id", "p").join(near, "p").where("id <> other").groupBy("id").agg(F.min("other").alias("guardianship"))


@case_query("""with p as (select key, '6' || cast(key % 100 as varchar) as part from requests), x as (select distinct filing from cases where filing is not null and length(filing) > 3)
  select part, filing as text from (select distinct left(person, 7) as part from requests where length(person) >= 7) q join (select distinct notes as filing from cases) n on contains(lower(filing), lower(part))""")
def j18_containment(t: World):
    p = t.requests.select(F.left("person", F.lit(7)).alias("p"))
    return matching.containing(p, t.cases, "p", "notes", 5)


@case_query(f"""with c as (select *, {LONG} as d, {YEAR_SEQ.format('folder')} as ys from cases),
  n as (select *, {LONG.replace('{', '{')} as d, {YEAR_SEQ.format('short')} as ys, upper(regexp_extract(claimant, '[Pp]ersoner[oaí]a? (?:municipal )?del? (?:el )?([A-Za-z]+)', 1)) as town from requests),
  h as (
    select key, 1 as tier, 'court_id' as name, c.id from n join c on left(n.d, 20) = left(c.d, 20)
    union all select key, 2, 'court_parts', c.id from n join c on left(n.d, 5) = left(c.d, 5) and right(n.d, 12) = right(c.d, 12)
    union all select key, 3, 'person', c.id from n join c on length(n.person) >= 7 and list_contains(regexp_extract_all(concat_ws(' ', c.notes, c.claimant, c.subject), '\\d{{7,}}'), n.person) and c.status <> 'DUPLICATE_MERGED'
    union all select key, 4, 'filing', c.id from n join c on length(n.filing) >= 8 and n.filing = c.filing
    union all select key, 5, 'short', c.id from n join c on n.ys = c.ys and (n.d is null or c.d is null or substr(n.d, 6, 7) = substr(c.d, 6, 7))
    union all select key, 6, 'ombudsman', c.id from n join c on length(n.town) >= 3 and n.town not in ('SANTANDER', 'LA', 'DE') and contains(upper(c.claimant), n.town) and regexp_matches(upper(c.claimant), 'PERSONERO|PERSONERA|PERSONERÍA')
      and (n.ys is null or c.ys is null or n.ys = c.ys)
    union all select key, 7, 'claimant', f.id from (select key, n.ys as ys, min(c.id) as id from n join c on length(n.claimant) >= 8 and contains(lower(c.claimant), lower(left(n.claimant, 20))) group by 1, 2) f join c on c.id = f.id
      where f.ys is null or c.ys is null or f.ys = c.ys),
  r as (select *, row_number() over (partition by key order by tier, id) as k from h)
  select n.key, r.name as tier, r.id as case_id from n left join r on r.key = n.key and k = 1""")
def j20_match_cases(t: World):
    return matching.match_cases(t.requests, t.cases)


@case_query(f"""with c as (select *, {LONG} as d, {YEAR_SEQ.format('folder')} as ys, case when length(trim(claimant)) >= 8 then lower(trim(claimant)) end as nm from cases),
  n as (select *, {LONG} as d, {YEAR_SEQ.format('short')} as ys, case when length(trim(claimant)) >= 8 then lower(trim(claimant)) end as nm from requests),
  h as (select key, 1 as tier, 'court_id' as name, 0.95::double as confidence, c.id from n join c on left(n.d, 20) = left(c.d, 20) union all select key, 2, 'filing', 0.9, c.id from n join c on n.filing = c.filing
    union all select key, 3, 'short', 0.8, c.id from n join c on n.ys = c.ys union all select key, 4, 'claimant', 0.7, c.id from n join c on n.nm = c.nm),
  u as (select key, tier, name, confidence, min(id) as id from h group by 1, 2, 3, 4 having count(*) = 1), r as (select *, row_number() over (partition by key order by tier) as k from u)
  select key, name as tier, id as case_id, confidence from r where k = 1""")
def j22_match_unique(t: World):
    return matching.match_unique(t.requests, t.cases)


@case_query(rf"""with c as (select id, {LONG} as d, {YEAR_SEQ.format('folder')} as ys, nullif(upper(regexp_extract(trim(claimant), '^(\p{{L}}{{4,}})(?:[^\p{{L}}]|$)', 1)), '') as nm from cases),
  d as (select id as doc, case_id as own, list_transform(regexp_extract_all(coalesce(text, ''), '68\d{{17,21}}'), lambda x: right(x, 12)) as tails, list_transform(regexp_extract_all(coalesce(text, ''), '\b20\d\d-\d{{3,5}}\b'), lambda x: x[1:4] || ':' || ltrim(x[6:], '0')) as yss,
    regexp_extract_all(upper(filename), '\p{{L}}{{4,}}') as names from docs),
  h as (select doc, 1 as tier, id from (select doc, own, unnest(list_distinct(tails)) as k from d) x join c on k = right(c.d, 12) where own <> id union all select doc, 2, id from (select doc, own, unnest(list_distinct(yss)) as k from d) x join c on k = ys where own <> id
    union all select doc, 3, id from (select doc, own, unnest(list_distinct(names)) as k from d) x join c on k = nm where own <> id),
  b as (select doc, min(tier) as tier from h group by 1), r as (select distinct h.doc, h.tier, id from h join b on h.doc = b.doc and h.tier = b.tier), k as (select *, row_number() over (partition by doc order by id) as k from r)
  select doc as id, case tier when 1 then 'ALTA' when 2 then 'MEDIA' else 'BAJA' end as tier, id as case_id from k where k <= 5""")
def j23_suggest(t: World):
    return matching.suggest_cases(t.docs, t.cases)


@case_query(f"""with k as (select id, left({LONG}, 5) as a, nullif(upper(regexp_extract(trim(claimant), '^(\\S+)', 1)), '') as b from cases),
  l as (select *, row_number() over (partition by a order by id) as ka, row_number() over (partition by b order by id) as kb from k),
  h as (select x.id, y.id as other from k x join l y on x.a = y.a and ka <= 11 and x.id <> y.id union select x.id, y.id from k x join l y on x.b = y.b and kb <= 11 and x.id <> y.id),
  r as (select *, row_number() over (partition by id order by other) as k from h) select id, other from r where k <= 10""")
def j25_related(t: World):
    return matching.related_cases(t.cases)


@case_query(rf"""with m as (select id, regexp_extract(coalesce(subject, ''), '20\d\d-0*(\d+)', 1) as n, regexp_extract(coalesce(subject, ''), '(20\d\d)-0*\d+', 1) as y from mails),
  c as (select {YEAR_SEQ.format('folder')} as ys, min(id) as case_id from cases group by 1) select m.id, case_id from m join c on y || ':' || n = ys""")
def j27_subject_folder(t: World):
    ys = matching.year_sequence(F.regexp_extract(F.coalesce("subject", F.lit("")), r"(20\d{2}-\d+)", 1))
    c = t.cases.select("id", matching.year_sequence(F.col("folder")).alias("ys"))
    return matching.first_of(t.mails.select(F.col("id").alias("mail"), ys.alias("ys")), c, "ys", "case_id").where("case_id is not null").select(F.col("mail").alias("id"), "case_id")


@case_query("""with h as (select lower(left(claimant, 20)) as k, min(id) as target from cases where folder is null and length(claimant) > 3 group by 1) select key, target from requests join h on lower(left(claimant, 20)) = k""")
def j28_unnamed_by_claimant(t: World):
    head = F.lower(F.left("claimant", F.lit(20))).alias("k")
    open_ = t.cases.where(F.col("folder").isNull() & (F.length("claimant") > 3)).select("id", head)
    return matching.first_of(t.requests.select("key", head), open_, "k", "target").where("target is not null").select("key", "target")


@case_query("""with g as (select mail_id, count(*) as n, min(id) as first from docs where mail_id is not null group by 1) select d.id, n - 1 as siblings, first from docs d join g using (mail_id)""")
def j30_siblings(t: World):
    d = t.docs.where("mail_id is not null")
    g = d.groupBy("mail_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return d.select("id", "mail_id").join(g, "mail_id").select("id", (F.col("n") - 1).alias("siblings"), "first")


@case_query("""with a as (select city, count(*) as n from cases where state = 'ACTIVO' group by 1), b as (select city, count(*) as m from cases where kind = 'INCIDENTE' and city <> 'giron' group by 1)
  select coalesce(a.city, b.city) as city, n, m from a full join b on a.city = b.city""")
def j31_full_outer(t: World):
    a = t.cases.where("state = 'ACTIVO'").groupBy("city").agg(F.count("*").alias("n"))
    b = t.cases.where("kind = 'INCIDENTE' and city <> 'giron'").groupBy("city").agg(F.count("*").alias("m"))
    return a.join(b, "city", "full")


IDENTITY = f"case when length({DIGITS}) between 17 and 25 then {DIGITS} end"


@case_query(f"""with n as (select case_id, count(*) as docs from docs group by 1), k as (select c.id, {NAME} as name, coalesce(docs, 0) as docs,
  ((coalesce(court, '') <> '')::int + (coalesce(city, '') <> '')::int + (coalesce(rights, '') <> '')::int + (coalesce(ruling1, '') <> '')::int) as filled from cases c left join n on n.case_id = c.id),
  r as (select *, row_number() over (partition by name order by docs desc, id) as a, row_number() over (partition by name order by docs desc, filled desc, id) as b, count(*) over (partition by name) as members from k)
  select name, max(case when a = 1 then id end) as by_docs, max(case when b = 1 then id end) as by_filled, max(members) as members from r where members > 1 group by 1""")
def w01_canonical_case(t: World):
    n = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("docs"))
    filled = sum((filled_sql(F.col(c)).cast("int") for c in ("court", "city", "rights", "ruling1")), F.lit(0))
    d = t.cases.select("id", normal_name(F.coalesce("claimant", F.lit(""))).alias("name"), filled.alias("filled")).join(n, "id", "left").na.fill(0, ["docs"])
    return d.groupBy("name").agg(F.max_by("id", F.struct("docs", -F.col("id"))).alias("by_docs"), F.max_by("id", F.struct("docs", "filled", -F.col("id"))).alias("by_filled"), F.count("*").alias("members")).where("members > 1")


@case_query("""with k as (select d.id, file_hash, case_id, ((coalesce(court, '') <> '')::int + (coalesce(city, '') <> '')::int + (coalesce(claimant, '') <> '')::int) as f from docs d join cases c on c.id = d.case_id),
  r as (select *, row_number() over (partition by file_hash order by f desc, case_id, id) as k, count(*) over (partition by file_hash) as n from k) select id, file_hash, k > 1 as duplicate from r where n > 1""")
def w04_canonical_document(t: World):
    # also M24: all but the canonical document of a hash are marked as duplicates
    filled = sum((filled_sql(F.col(c)).cast("int") for c in ("court", "city", "claimant")), F.lit(0))
    d = t.docs.select("id", "file_hash", "case_id").join(t.cases.select(F.col("id").alias("case_id"), filled.alias("f")), "case_id")
    best = d.groupBy("file_hash").agg(F.max_by("id", F.struct("f", -F.col("case_id"), -F.col("id"))).alias("best"), F.count("*").alias("n")).where("n > 1")
    return d.join(best, "file_hash").select("id", "file_hash", (F.col("id") != F.col("best")).alias("duplicate"))


@case_query("""select id, lag(value) over w as before, lead(value) over w as after, round(sum(value) over (partition by sender order by received, id rows between 2 preceding and current row) * 100)::bigint as last3 from mails window w as (partition by sender order by received, id)""")
def w11_frames(t: World):
    w = Window.partitionBy("sender").orderBy("received", "id")
    return t.mails.select("id", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)) * 100).cast("bigint").alias("last3"))


@case_query("""with n as (select count(*) as total from cases where state = 'ACTIVO') select id, folder, total, ceil(total / 20.0)::bigint as pages from cases, n where state = 'ACTIVO' order by id desc limit 20 offset 20""")
def o01_page_and_total(t: World):
    d = t.cases.where("state = 'ACTIVO'").select("id", "folder")
    total = d.agg(F.count("*").alias("total"))
    return relational.page(d, [F.desc("id")], 2, 20).crossJoin(total).withColumn("pages", F.ceil(F.col("total") / 20))


@case_query("select id, coalesce(left(subject, 60), '') as subject, received from mails order by received desc, id desc limit 20 offset 40")
def o02_mail_page(t: World):
    d = t.mails.select("id", F.coalesce(F.left("subject", F.lit(60)), F.lit("")).alias("subject"), "received")
    return relational.page(d, [F.desc("received"), F.desc("id")], 3, 20)


@case_query(r"""with p as (select distinct filename, lower(strip_accents(regexp_replace(filename, '\d.*$', ''))) as text, try_cast(regexp_extract(filename, '\d+') as bigint) as number from docs order by text, number nulls first, filename limit 100)
  select filename, row_number() over (order by text, number nulls first, filename) as place from p""")
def o06_numeric_sort(t: World):
    # the first page, by letters without accents and case, then by the number in the name as a number
    text = F.lower(F.translate(F.regexp_replace("filename", r"\d.*$", ""), "áéíóúÁÉÍÓÚ", "aeiouAEIOU")).alias("text")
    number = F.nullif(F.regexp_extract("filename", r"(\d+)", 1), F.lit("")).try_cast("bigint").alias("number")
    order = ["text", F.asc_nulls_first("number"), "filename"]
    page = t.docs.select("filename").distinct().select("filename", text, number).orderBy(*order).limit(100)
    return page.select("filename", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("place"))


@case_query("""select case_id, id, row_number() over (partition by case_id order by case when contains(filename, 'SENTENCIA') then 1 when contains(filename, 'Auto') then 2 when starts_with(filename, 'Email') then 4 else 3 end, id) as place from docs""")
def o08_by_priority(t: World):
    rank = classes.by_words(F.col("filename"), ((("SENTENCIA",), "1"), (("Auto",), "2")), None)
    rank = F.coalesce(rank, F.when(F.startswith("filename", F.lit("Email")), "4").otherwise("3"))
    return t.docs.select("case_id", "id", F.row_number().over(Window.partitionBy("case_id").orderBy(rank, "id")).cast("bigint").alias("place"))


@case_query("""with a as (select distinct folder from cases where id % 3 <> 0 and folder <> ''), b as (select distinct folder from cases where id % 5 <> 0 and folder <> '')
  select folder, 'main' as side from (select * from a except select * from b) union all select folder, 'sandbox' from (select * from b except select * from a)""")
def u02_main_and_sandbox(t: World):
    named = t.cases.where(filled_sql(F.col("folder")))
    return relational.two_way_difference(named.where("id % 3 <> 0"), named.where("id % 5 <> 0"), "folder").replace({"left": "main", "right": "sandbox"}, subset=["side"])


@case_query("""select id, list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(rights, ''), ' - '), lambda x: upper(trim(x))), lambda x: x <> ''))) as have,
  len(list_distinct(list_filter(list_transform(string_split(coalesce(rights, '') || ' - salud - ' || coalesce(rights, ''), ' - '), lambda x: upper(trim(x))), lambda x: x <> ''))) as together from cases""")
def u04_union_of_rights(t: World):
    have = F.filter(F.transform(F.split(F.coalesce("rights", F.lit("")), " - "), lambda x: F.upper(F.btrim(x))), lambda x: x != "")
    more = F.array_union(have, F.array_union(F.array(F.lit("SALUD")), have))
    return t.cases.select("id", F.array_sort(F.array_distinct(have)).alias("have"), F.size(more).cast("bigint").alias("together"))


@case_query("select city from cases where state = 'ACTIVO' and city is not null intersect select city from cases where kind = 'INCIDENTE' except select city from cases where lawyer is null")
def u08_set_operations(t: World):
    c = lambda where: t.cases.where(where).select("city")
    return c("state = 'ACTIVO' and city is not null").intersect(c("kind = 'INCIDENTE'")).subtract(c("lawyer is null"))


COURT = f"substr({LONG}, 6, 7)"


@case_query(f"""with k as (select id, {LONG} as d from cases), g as (select right(left(d, 21), 9) as short, substr(d, 6, 7) as court, count(*) as n, min(id) as first, max(id) as last from k where d is not null group by 1, 2 having count(*) > 1) select * from g""")
def d02_same_short_and_court(t: World):
    d = t.cases.select("id", matching.long_digits(F.coalesce("court_id", F.lit(""))).alias("d")).where("d is not null")
    keys = F.right(F.left("d", F.lit(21)), F.lit(9)).alias("short"), F.substr("d", F.lit(6), F.lit(7)).alias("court")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("n > 1")


@case_query(f"""select {YEAR_SEQ.format('folder')} as short, count(*) as n, min(id) as first from cases where {YEAR_SEQ.format('folder')} is not null group by 1 having count(*) > 1""")
def d03_same_short(t: World):
    d = t.cases.select("id", matching.year_sequence(F.col("folder")).alias("short")).where("short is not null")
    return d.groupBy("short").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


@case_query(f"""select left({NAME}, 40) as name, left({DIGITS}, 20) as court, count(*) as n from cases where length({NAME}) > 0 group by 1, 2 having count(*) > 1""")
def d04_same_name_and_court(t: World):
    name = F.left(normal_name(F.coalesce("claimant", F.lit(""))), F.lit(40))
    d = t.cases.select(name.alias("name"), F.left(digits(F.coalesce("court_id", F.lit(""))), F.lit(20)).alias("court")).where("name <> ''")
    return d.groupBy("name", "court").agg(F.count("*").alias("n")).where("n > 1")


@case_query(rf"""with c as (select id, {DIGITS} as d, status from cases where status <> 'DUPLICATE_MERGED' or status is null),
  f as (select case_id, x, count(*) as n from (select case_id, unnest(regexp_extract_all(left(coalesce(text, ''), 15000), '68\d{{17,21}}')) as x from docs) y group by 1, 2),
  b as (select *, row_number() over (partition by case_id order by n desc, x) as k, count(*) over (partition by case_id) as candidates from f)
  select id, case when d = '' then 'missing' else 'malformed' end as kind, x as suggested, case when n >= 2 then 'ALTA' when n = 1 then 'MEDIA' end as confidence, candidates from c left join b on d = '' and case_id = id and k = 1
  where d = '' or length(d) < 18 or length(d) > 25""")
def d07_incomplete_ids(t: World):
    c = t.cases.where(~F.col("status").eqNullSafe("DUPLICATE_MERGED")).select("id", digits(F.coalesce("court_id", F.lit(""))).alias("d"))
    c = c.where("d = '' or length(d) < 18 or length(d) > 25").select("id", F.when(F.col("d") == "", "missing").otherwise("malformed").alias("kind"))
    found = F.regexp_extract_all(F.left(F.coalesce("text", F.lit("")), F.lit(15000)), F.lit(r"(68\d{17,21})"), F.lit(1))
    f = t.docs.select(F.col("case_id").alias("id"), F.explode(found).alias("x")).groupBy("id", "x").agg(F.count("*").alias("n"))
    b = f.groupBy("id").agg(F.min_by(F.struct("x", "n"), F.struct(-F.col("n"), "x")).alias("b"), F.count("*").alias("candidates")).withColumn("kind", F.lit("missing"))
    level = F.when(F.col("b.n") >= 2, "ALTA").when(F.col("b.n") == 1, "MEDIA")
    return c.join(b, ["id", "kind"], "left").select("id", "kind", F.col("b.x").alias("suggested"), level.alias("confidence"), "candidates")


@case_query(rf"""with f as (select id, filing from cases where coalesce(try_cast(nullif(regexp_extract(coalesce(folder, ''), '^(\d{{4}})-(\d{{4,}})(?:\s|$)', 2), '') as bigint) >= 10000, false)),
  v as (select distinct f.id, d.id as doc, x from f join docs d on d.case_id = f.id, unnest(list_distinct(regexp_extract_all(left(coalesce(text, ''), 15000), '68\d{{17,21}}'))) u(x)),
  n as (select id, x, count(*) as n from v group by 1, 2), c as (select id as parent, {LONG} as d from cases),
  p as (select n.id, n.x, n.n, min(parent) as parent from n join c on left(x, 5) = left(d, 5) and left(x, 18) = left(d, 18) and parent <> n.id group by 1, 2, 3),
  s as (select id, parent, sum(n) as votes from p group by 1, 2), r as (select *, row_number() over (partition by id order by votes desc, parent) as k from s),
  o as (select f.id, min(c.id) as parent from f join cases c on c.filing = f.filing and c.id <> f.id group by 1)
  select f.id, coalesce(r.parent, o.parent) as parent, case when r.votes >= 2 then 'ALTA' when r.votes = 1 then 'MEDIA' when o.parent is not null then 'ALTA' end as confidence from f left join r on r.id = f.id and r.k = 1 left join o on o.id = f.id""")
def d08_fragments(t: World):
    f = t.cases.where(classes.filing_folder(F.col("folder"))).select("id", "filing")
    found = F.array_distinct(F.regexp_extract_all(F.left(F.coalesce("text", F.lit("")), F.lit(15000)), F.lit(r"(68\d{17,21})"), F.lit(1)))
    n = t.docs.select(F.col("case_id").alias("id"), F.explode(found).alias("x")).join(f.select("id"), "id", "left_semi").groupBy("id", "x").agg(F.count("*").alias("n"))
    c = t.cases.select("id", F.left(matching.long_digits(F.coalesce("court_id", F.lit(""))), F.lit(18)).alias("front"))
    near = matching.lowest(c, "front", 2).withColumnRenamed("id", "parent")
    votes = n.withColumn("front", F.left("x", F.lit(18))).join(near, "front").where("id <> parent").groupBy("id", "x", "n").agg(F.min("parent").alias("parent")).groupBy("id", "parent").agg(F.sum("n").alias("votes"))
    best = votes.groupBy("id").agg(F.max_by(F.struct("parent", "votes"), F.struct("votes", -F.col("parent"))).alias("b"))
    same = matching.lowest(t.cases.select("id", "filing"), "filing", 2).withColumnRenamed("id", "other")
    other = f.join(same, "filing").where("id <> other").groupBy("id").agg(F.min("other").alias("other"))
    level = F.when(F.col("b.votes") >= 2, "ALTA").when(F.col("b.votes") == 1, "MEDIA").when(F.col("other").isNotNull(), "ALTA")
    return f.select("id").join(best, "id", "left").join(other, "id", "left").select("id", F.coalesce("b.parent", "other").alias("parent"), level.alias("confidence"))


@case_query("""with n as (select case_id, count(*) as n from docs group by 1) select id, list_filter([case when coalesce(court_id, '') = '' then 'no id' end, case when coalesce(claimant, '') = '' then 'no claimant' end, case when coalesce(n, 0) < 2 then 'few documents' end,
  case when status = 'REVISION' then 'review' end], lambda x: x is not null) as reasons from cases left join n on case_id = id where status in ('REVISION', 'PENDIENTE', 'COMPLETO')""")
def d10_reextraction(t: World):
    n = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("n"))
    d = t.cases.where(F.col("status").isin("REVISION", "PENDIENTE", "COMPLETO")).select("id", "court_id", "claimant", "status").join(n, "id", "left")
    rules = [(~filled_sql(F.col("court_id")), "no id"), (~filled_sql(F.col("claimant")), "no claimant"), (F.coalesce("n", F.lit(0)) < 2, "few documents"), (F.col("status") == "REVISION", "review")]
    return d.select("id", F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules))).alias("reasons"))


@case_query(r"""with d as (select case_id, regexp_extract(filename, '^(\d{1,3})[_.\s]+', 1) as series, x from docs left join unnest([1]) u(x) on true)
  select case_id, count(distinct series) filter (series <> '') as series, count(*) filter (series = '') as others, case when count(distinct series) filter (series <> '') = 1 then 'SINGLE' when count(distinct series) filter (series <> '') > 1 then 'MULTIPLE' else 'REVIEW' end as kind from d group by 1""")
def d12_series(t: World):
    d = t.docs.select("case_id", F.regexp_extract("filename", r"^(\d{1,3})[_.\s]+", 1).alias("s"))
    n = d.groupBy("case_id").agg(F.count_distinct(F.nullif("s", F.lit(""))).alias("series"), F.count_if(F.col("s") == "").alias("others"))
    return n.withColumn("kind", F.when(F.col("series") == 1, "SINGLE").when(F.col("series") > 1, "MULTIPLE").otherwise("REVIEW"))


@case_query(rf"""with k as (select id, {YEAR_SEQ.format('folder')} as own, {DIGITS} as d, filing from cases), m as (select *, case when regexp_matches(d, '20\d\d\d{{5}}\d\d$') then substr(d, length(d) - 10, 4) || ':' || ltrim(substr(d, length(d) - 6, 5), '0') end as official from k)
  select id, own, official, case when filing is not null and contains(filing, split_part(own, ':', 2)) then 'high' else 'medium' end as severity from m where own <> official""")
def d13_id_integrity(t: World):
    # also D14: the folder's year and sequence against those of the court's id
    d = digits(F.coalesce("court_id", F.lit("")))
    tail = r"(20\d{2})(\d{5})\d{2}$"
    official = F.when(F.regexp_like(d, F.lit(tail)), F.concat(F.regexp_extract(d, tail, 1), F.lit(":"), F.ltrim(F.regexp_extract(d, tail, 2), F.lit("0"))))
    k = t.cases.select("id", matching.year_sequence(F.col("folder")).alias("own"), official.alias("official"), "filing").where("own <> official")
    severe = F.coalesce(F.contains("filing", F.element_at(F.split("own", ":"), 2)), F.lit(False))
    return k.select("id", "own", "official", F.when(severe, "high").otherwise("medium").alias("severity"))


@case_query("""with n as (select case_id, count(*) as docs, count(*) filter (verified = 'NO_PERTENECE') as foreign_ from docs group by 1) select id, docs, foreign_, case when docs is null then 'archive' when foreign_ > 1 then 'split' when foreign_ = 1 then 'move' else 'keep' end as suggestion from cases left join n on case_id = id""")
def d15_suggest_by_counts(t: World):
    n = t.docs.groupBy(F.col("case_id").alias("id")).agg(F.count("*").alias("docs"), F.count_if(F.col("verified") == "NO_PERTENECE").alias("foreign_"))
    what = F.when(F.col("docs").isNull(), "archive").when(F.col("foreign_") > 1, "split").when(F.col("foreign_") == 1, "move").otherwise("keep")
    return t.cases.select("id").join(n, "id", "left").withColumn("suggestion", what)


@case_query(f"""with k as (select id, {LONG} as d, {YEAR_SEQ.format('folder')} as ys from cases), m as (select k.* from k join cases c on c.id = k.id where c.status = 'DUPLICATE_MERGED'), o as (select k.* from k join cases c on c.id = k.id where c.status <> 'DUPLICATE_MERGED' or c.status is null),
  a as (select m.id, min(o.id) as x from m join o on left(m.d, 20) = left(o.d, 20) group by 1), b as (select m.id, min(o.id) as x from m join o on m.ys = o.ys and (m.d is null or o.d is null or substr(m.d, 6, 7) = substr(o.d, 6, 7)) group by 1)
  select m.id, coalesce(a.x, b.x) as canonical, case when a.x is not null then 'court_id' when b.x is not null then 'short' end as by from m left join a on a.id = m.id left join b on b.id = m.id""")
def d16_canonical_of_merged(t: World):
    k = matching.with_keys(t.cases.select("id", "court_id", "folder", "status"), "folder")
    merged = k.where("status = 'DUPLICATE_MERGED'").withColumnRenamed("id", "key")
    open_ = k.where(~F.col("status").eqNullSafe("DUPLICATE_MERGED"))
    m = matching.first_allowed(matching.first_of(merged, open_, "__front", "a"), open_, "__short", "__court", "b")
    return m.select(F.col("key").alias("id"), F.coalesce("a", "b").alias("canonical"), F.when(F.col("a").isNotNull(), "court_id").when(F.col("b").isNotNull(), "short").alias("by"))


@case_query("""select id, message_id from (select *, row_number() over (partition by message_id order by received, id) as k from mails) where k = 1""")
def d20_mails_once(t: World):
    return t.mails.groupBy("message_id").agg(F.min_by("id", F.struct("received", "id")).alias("id")).select("id", "message_id")


@case_query("""select min(id) as id, coalesce(left(subject, 100), '') as subject, coalesce(left(sender, 50), '') as sender, count(*) as n from mails group by 2, 3""")
def d20_mails_by_subject(t: World):
    return t.mails.groupBy(F.coalesce(F.left("subject", F.lit(100)), F.lit("")).alias("subject"), F.coalesce(F.left("sender", F.lit(50)), F.lit("")).alias("sender")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@case_query("""select case_id, sha256(text) as hash, min(id) as first, count(*) as n from docs where text is not null group by 1, 2""")
def d21_content_once(t: World):
    return t.docs.where("text is not null").groupBy("case_id", F.sha2("text", 256).alias("hash")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
