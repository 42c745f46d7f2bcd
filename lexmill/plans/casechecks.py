"""Scores, coverage, search with snippets and the privacy gate on cases and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import classes
from lexmill.functions.compat import filled_sql, filled_trim, normal_name
from lexmill.operators import privacy, search
from lexmill.plans.casejoins import d13_id_integrity
from lexmill.plans.casework import NAME
from lexmill.plans.world import World, case_query

#: Fields whose filling is watched, and those that a case must have.
TRACKED = "court_id filing claimant defendants linked rights court city admitted state lawyer ruling1 ruling1_date appeal ruling2 incident office subject".split()
CRITICAL = "court_id claimant defendants rights court city admitted".split()
_FILLED = {c: f"(coalesce({c}, '') <> '')::int" for c in TRACKED}


@case_query(f"""with touched as (select distinct case_id as id from usage where case_id is not null), c as (select {' + '.join(_FILLED.values())} as n from cases join touched using (id))
  select count(*) as cases, (1.0 * sum(n) / count(*))::double as mean, count(*) filter (n < 5) as problems, min(n) as least, max(n) as most from c""")
def a20_touched_coverage(t: World):
    touched = t.usage.select(F.col("case_id").alias("id")).where("id is not null")
    n = sum((filled_sql(F.col(c)).cast("int") for c in TRACKED), F.lit(0))
    d = t.cases.select("id", n.alias("n")).join(touched, "id", "left_semi")
    return d.agg(F.count("*").alias("cases"), F.avg("n").alias("mean"), F.count_if(F.col("n") < 5).alias("problems"), F.min("n").cast("int").alias("least"), F.max("n").cast("int").alias("most"))


@case_query("with touched as (select distinct case_id as id from usage where case_id is not null), c as (select cases.* from cases join touched using (id)) " + " union all ".join(f"select '{c}' as field, (100.0 * sum({x}) / count(*))::double as pct from c" for c, x in _FILLED.items()))
def a20_field_coverage_18(t: World):
    touched = t.usage.select(F.col("case_id").alias("id")).where("id is not null")
    d = t.cases.join(touched, "id", "left_semi").agg(*((100.0 * F.count_if(filled_sql(F.col(c))) / F.count("*")).alias(c) for c in TRACKED))
    return d.unpivot([], TRACKED, "field", "pct")


FIELDS = "folder court_id filing claimant defendants linked rights court city admitted state lawyer ruling1 ruling1_date appeal appellant ruling2 ruling2_date incident incident_date incident_decision answered office subject notes status kind".split()


@case_query("select id, (" + " + ".join(f"(trim(coalesce({c}, '')) <> '')::int" for c in FIELDS) + f") * 100.0 / {len(FIELDS)} as pct from cases")
def p09_completeness(t: World):
    n = sum((filled_trim(F.col(c)).cast("int") for c in FIELDS), F.lit(0))
    return t.cases.select("id", (n * 100.0 / len(FIELDS)).alias("pct"))


@case_query("select " + ", ".join(f"100.0 * count(*) filter (coalesce({c}, '') <> '') / count(*) as {c}" for c in FIELDS) + " from cases")
def a08_all_fields(t: World):
    return t.cases.agg(*((100.0 * F.count_if(filled_sql(F.col(c))) / F.count("*")).alias(c) for c in FIELDS))


WEIGHTS = {"document duplicates": 2, "case duplicates": 5, "naming": 1, "orphans": 2, "suspicious": 1, "foreign": 2, "missing fields": 1, "mismatches": 2, "empty": 1}
_FOLDER = " ".join(f"when contains(upper(coalesce(folder, '')), '{w}') then 1" for w in classes.FRAGMENTS)


@case_query(rf"""with i as (select 'document duplicates' as issue, count(*) as n from (select case_id, file_hash from docs group by 1, 2 having count(*) > 1)
    union all select 'case duplicates', count(*) from (select left({NAME}, 40) as a, left(regexp_replace(coalesce(court_id, ''), '\D', '', 'g'), 20) as b from cases where {NAME} <> '' group by 1, 2 having count(*) > 1)
    union all select 'naming', count(*) from cases where coalesce(folder, '') = '' or case {_FOLDER} else 0 end = 1 or length(folder) > 120 or not regexp_matches(folder, '^\d{{4}}-\d{{3,}}')
    union all select 'orphans', count(*) from docs where case_id not in (select id from cases) union all select 'suspicious', count(*) from docs where verified = 'SOSPECHOSO' union all select 'foreign', count(*) from docs where verified = 'NO_PERTENECE'
    union all select 'missing fields', sum({' + '.join(f"(coalesce({c}, '') = '')::int" for c in CRITICAL)})::bigint from cases
    union all select 'mismatches', count(*) from (select regexp_extract(coalesce(folder, ''), '^(20\d\d)[-\s]?0*(\d+)', 1) || ':' || regexp_extract(coalesce(folder, ''), '^(20\d\d)[-\s]?0*(\d+)', 2) as own, regexp_replace(coalesce(court_id, ''), '\D', '', 'g') as d from cases) where own <> ':' and regexp_matches(d, '20\d\d\d{{5}}\d\d$') and own <> substr(d, length(d) - 10, 4) || ':' || ltrim(substr(d, length(d) - 6, 5), '0')
    union all select 'empty', count(*) from cases where id not in (select case_id from docs)),
  w(issue, weight) as (values {', '.join(f"('{k}', {v})" for k, v in WEIGHTS.items())}), s as (select sum(n * weight) as issues from i join w using (issue))
  select i.issue, i.n, weight, greatest(0, least(100, 100 - 100.0 * issues / (20 * (select count(*) from cases))))::double as score from i join w using (issue), s""")
def a36_purity_of_nine(t: World):
    docs, cases = t.docs, t.cases
    name = F.left(normal_name(F.coalesce("claimant", F.lit(""))), F.lit(40))
    front = F.left(F.regexp_replace(F.coalesce("court_id", F.lit("")), r"\D", ""), F.lit(20))
    groups = cases.select(name.alias("a"), front.alias("b")).where("a <> ''").groupBy("a", "b").count().where("count > 1")
    own = cases.select(F.col("id").alias("case_id"))
    found = {
        "document duplicates": docs.groupBy("case_id", "file_hash").count().where("count > 1"), "case duplicates": groups, "naming": cases.where(classes.suspicious_folder(F.col("folder")).isNotNull()),
        "orphans": docs.join(own, "case_id", "left_anti"), "suspicious": docs.where("verified = 'SOSPECHOSO'"), "foreign": docs.where("verified = 'NO_PERTENECE'"),
        "mismatches": d13_id_integrity(t), "empty": own.join(docs, "case_id", "left_anti"),
    }
    missing = cases.agg(F.sum(sum((~filled_sql(F.col(c))).cast("bigint") for c in CRITICAL)).alias("n")).select(F.lit("missing fields").alias("issue"), "n")
    counts = missing
    for issue, d in found.items():
        counts = counts.unionByName(d.agg(F.count("*").alias("n")).select(F.lit(issue).alias("issue"), "n"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), F.col("issue"))
    counts = counts.withColumn("weight", weight)
    whole = counts.agg(F.sum(F.col("n") * F.col("weight")).alias("issues")).crossJoin(cases.agg(F.count("*").alias("cases")))  # one row each
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100.0 * F.col("issues") / (20 * F.col("cases"))))
    return counts.crossJoin(whole).select("issue", "n", "weight", score.alias("score"))


@case_query("with x as (select id, regexp_replace(coalesce(text, '') || ' [TEL_1] calle 45 RC No. 1234567890', '" + privacy.TOKEN + "', ' ', 'g') as x from docs) select id, " + ", ".join(f"len(regexp_extract_all(x, '{p}')){' - len(regexp_extract_all(x, ' + chr(39) + privacy.RESIDUES['mobile'] + chr(39) + '))' if k == 'bare' else ''} as {k}" for k, p in privacy.RESIDUES.items()) + " from x")
def r09_gate_of_six(t: World):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [TEL_1] calle 45 RC No. 1234567890"))
    return t.docs.select("id", privacy.residues(text).alias("g")).select("id", "g.*")


@case_query("""with s as (select id, unnest([case when regexp_matches(coalesce(text, ''), '3\\d{9}') then 'PHONE' end, case when contains(coalesce(text, ''), '@') then 'EMAIL' end, case when regexp_matches(coalesce(text, ''), '[A-TV-Z]\\d{2}') then 'DIAGNOSIS' end]) as kind from docs)
  select kind, count(*) filter (kind in ('ID', 'NUIP', 'PHONE', 'EMAIL', 'ADDRESS')) as selective, count(*) as aggressive from s where kind is not null group by 1""")
def r06_policies(t: World):
    text = F.coalesce("text", F.lit(""))
    kinds = F.array(F.when(F.regexp_like(text, F.lit(r"3\d{9}")), "PHONE"), F.when(F.contains(text, F.lit("@")), "EMAIL"), F.when(F.regexp_like(text, F.lit(r"[A-TV-Z]\d{2}")), "DIAGNOSIS"))
    d = t.docs.select(F.explode(F.array_compact(kinds)).alias("kind"))
    of = lambda policy: F.count_if(F.col("kind").isin(*privacy.POLICIES[policy])).alias(policy)
    return d.groupBy("kind").agg(of("selective"), of("aggressive"))


SECRET = b"lexmill"
_PADS = {n: bytes(k ^ pad for k in SECRET.ljust(64, b"\0")).hex() for n, pad in (("inner", 0x36), ("outer", 0x5C))}


@case_query(f"""with v as (select case_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b3\\d{{9}}\\b'))) as value from docs), d as (select distinct * from v),
  h as (select *, left(sha256(from_hex('{_PADS['outer']}') || from_hex(sha256(from_hex('{_PADS['inner']}') || encode('PHONE:' || value)))), 24) as hash from d) select case_id, value, hash, '[TEL_' || row_number() over (partition by case_id order by hash) || ']' as token from h""")
def r07_keyed_tokens(t: World):
    # stable in a case: the keyed hash of a value, not its place, decides its number
    from pyspark.sql import Window

    v = t.docs.select("case_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b(3\d{9})\b"), F.lit(1))).alias("value")).distinct()
    h = v.withColumn("hash", privacy.keyed_hash_column(SECRET, F.lit("PHONE"), F.col("value")))
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("hash"))
    return h.select("case_id", "value", "hash", F.concat(F.lit("[TEL_"), n.cast("string"), F.lit("]")).alias("token"))


@case_query(r"""with w as (select id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') as t from docs), m as (select id, t, list_min(list_filter([list_position(t, 'proceso'), list_position(t, 'accionante'), list_position(t, 'radicado')], lambda x: x > 0)) as p from w
    where list_contains(t, 'radicado') and (list_contains(t, 'proceso') or list_contains(t, 'accionante')) and not list_contains(t, 'forest'))
  select id, array_to_string(list_transform(t[greatest(1, p - 2):greatest(1, p - 2) + 5], lambda x: case when x in ('radicado', 'proceso', 'accionante') then '<b>' || x || '</b>' else x end), ' ') as snippet from m""")
def n01_snippets(t: World):
    return search.matching(t.docs, "id", "text", ("radicado",), ("proceso", "accionante"), ("forest",), 6, 2)
