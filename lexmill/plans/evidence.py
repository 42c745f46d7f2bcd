"""What patterns find in the documents of cases, and personal data in them: spans, vault, redaction and restoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions.compat import let
from lexmill.functions.jsonrepair import repair_json
from lexmill.functions.patterns import CATALOGUE
from lexmill.operators import actors, casefile, extraction, privacy, redaction
from lexmill.plans.catalogue import Tables, query
from lexmill.plans.world import World, case_query
from lexmill.sources import files
from lexmill.streaming import state

#: Names and numbers of the queries' own vaults; a user gives the secret as a parameter.
SECRET = b"lexmill"


def _sql(regex: str) -> str:
    """A pattern as DuckDB reads it: what may not follow a number is taken along."""
    return regex.replace("(?!\\d)", "(?:\\D|$)").replace("'", "''")


def _counts() -> str:
    parts = []
    for p in CATALOGUE:
        parts.append(f"select id, '{p.name}' as pattern, len(regexp_extract_all(text, '{_sql(p.regex)}', {p.parts[-1]})) as n, regexp_extract(text, '{_sql(p.regex)}', {p.parts[-1]}) as first from d")
    return " union all ".join(parts)


@case_query(f"with d as (select id, coalesce(text, '') as text from docs), a as ({_counts()}) select * from a where n > 0")
def x01_catalogue(t: World):
    found = extraction.found_values(t.docs, "id", "text")
    own = t.docs.select("id", "text")
    # the matched text itself, by its place
    first = found.groupBy("id", "pattern").agg(F.count("*").alias("n"), F.min(F.struct("start", "end")).alias("at"))
    return first.join(own, "id").select("id", "pattern", "n", F.substring("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start")).alias("first"))


_PRIORITY = "case when filename ilike 'auto admisorio%' then 1 when filename ilike 'sentencia%' then 2 when filename ilike '%.docx' then 3 else 5 end"
_FIELD = [p for p in CATALOGUE if p.field in ("court_id", "short_id", "person_id", "minor_id", "online_id", "act_id", "file_id")]


def _short(p) -> str:
    take = lambda g: f"regexp_extract(text, '{_sql(p.regex)}', {g})"
    return f"{take(p.parts[0])} || '-' || lpad({take(p.parts[1])}, 5, '0')" if p.field == "short_id" else take(1)


@case_query(
    "with d as (select id, case_id, coalesce(text, '') as text, " + _PRIORITY + " as priority from docs), a as ("
    + " union all ".join(f"select case_id, '{p.field}' as field, trim({_short(p)}, ' ,.-') as value, {p.confidence} as confidence, '{p.name}' as pattern, id, priority, {i} as o from d where regexp_matches(text, '{_sql(p.regex)}')" for i, p in enumerate(CATALOGUE) if p in _FIELD)
    + r"), v as (select * from a where field <> 'court_id' or len(regexp_replace(value, '\D', '', 'g')) >= 20) select case_id, field, value, confidence, pattern, id from v qualify row_number() over (partition by case_id, field order by priority, o, id) = 1"
)
def x14_best_fields(t: World):
    found = extraction.found_values(t.docs, "id", "text", tuple(p.name for p in _FIELD))
    return extraction.best_fields(found, t.docs, "id", "case_id", F.expr(_PRIORITY))


def known(t: World):
    """What the cases' own rows tell: the claimant, the filing number, the person's number in the notes."""
    told = {"PERSON": F.btrim("claimant"), "RADICADO_FOREST": F.col("filing"), "CC": F.regexp_extract("notes", r"CC (\d+)", 1)}
    # the cases are made once, not once for each kind
    every = t.cases.select(F.col("id").alias("case_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in told.items())))).where("value <> ''")
    return every.repartition(t.parts, "case_id")


def spans_of(t: World, kinds=redaction.AGGRESSIVE, secret=None):
    # read by the vault and the redaction, so found, and hashed, once
    return files.staged(redaction.detected(t.docs, "id", "case_id", "text", known(t), kinds, secret=secret), "spans")


@case_query(r"""with d as (select id, coalesce(text, '') as text from docs), a as (
    select id, 'EMAIL' as kind, len(regexp_extract_all(text, '[\w.\-+]+@[\w.\-]+\.\w{2,}')) as n from d
    union all select id, 'NUIP', len(regexp_extract_all(text, '(?i)(?:RC|Registro\s+Civil)\s+(?:No\.?\s*)?(\d{10,11})')) from d
    union all select id, 'ADDRESS_EXACT', len(regexp_extract_all(text, '(?i)\b(?:calle|carrera|cra|cl)\.? \d+')) from d)
  select id, kind, n from a where n > 0""")
def r01_spans_by_kind(t: World):
    d = redaction.detected(t.docs, "id", "case_id", "text", None, ("EMAIL", "NUIP", "ADDRESS_EXACT"))
    return d.groupBy("id", "kind").agg(F.count("*").alias("n"))


@case_query()
def r05_settled_spans(t: World):
    # read once, so not staged
    return redaction.detected(t.docs, "id", "case_id", "text", known(t))


@case_query()
def r07_vault(t: World):
    vault = redaction.minted(spans_of(t, secret=SECRET), "id", "case_id", SECRET)
    return redaction.unlocked(redaction.locked(vault, SECRET), SECRET)


@case_query("select id, case_id, md5(text) as digest from docs")
def r10_restored(t: World):
    # every token counted, so what comes back is what was there, character by character
    spans = spans_of(t, secret=SECRET)
    vault = redaction.minted(spans, "id", "case_id", SECRET, counted=True)
    hidden = redaction.redacted(t.docs, "id", "case_id", "text", spans, vault, SECRET)
    return redaction.restored(hidden, "case_id", "redacted", vault).select("id", "case_id", F.md5(F.col("redacted").cast("binary")).alias("digest"))


@case_query()
def r08_redacted(t: World):
    # the tokens as a reader sees them: several values may share one
    spans = spans_of(t, redaction.SELECTIVE, SECRET)
    vault = redaction.minted(spans, "id", "case_id", SECRET)
    out = redaction.redacted(t.docs, "id", "case_id", "text", spans, vault, SECRET)
    return out.select("id", "case_id", "n_spans", F.md5(F.col("redacted").cast("binary")).alias("digest"))


@case_query("select id, case_id, md5(text) as digest from docs where text is not null")
def r10_rehydrated(t: World):
    # an answer in JSON, with what was redacted at some depth, gets its values back
    spans = spans_of(t, redaction.SELECTIVE, SECRET)
    vault = redaction.minted(spans, "id", "case_id", SECRET, counted=True)
    hidden = redaction.redacted(t.docs.where("text is not null"), "id", "case_id", "text", spans, vault, SECRET)
    answer = hidden.select("id", "case_id", F.to_json(F.struct(F.array(F.struct(F.col("redacted").alias("said"))).alias("parts"))).alias("answer"))
    back = redaction.restored(answer, "case_id", "answer", vault, as_json=True)
    said = F.get(F.from_json("answer", "parts array<struct<said:string>>")["parts"], F.lit(0))["said"]
    return back.select("id", "case_id", F.md5(said.cast("binary")).alias("digest"))


@case_query()
def r12_runs(t: World):
    # a row a case: what was found, minted and left
    spans = spans_of(t, redaction.SELECTIVE, SECRET)
    vault = redaction.minted(spans, "id", "case_id", SECRET)
    hidden = redaction.redacted(t.docs, "id", "case_id", "text", spans, vault, SECRET)
    left = let(privacy.residues(F.regexp_replace("redacted", redaction.TOKEN, " ")), lambda n: n["email"] + n["mobile"])
    per = hidden.groupBy("case_id").agg(F.sum("n_spans").alias("spans_detected"), F.coalesce(F.sum(left), F.lit(0)).alias("violations"))
    return per.join(vault.groupBy("case_id").agg(F.count_distinct("token").alias("tokens_minted")), "case_id", "left").na.fill(0, ["tokens_minted"])


# --- the document model -------------------------------------------------------------------------------------------------------


def _place(p: str) -> str:
    return f"case when regexp_matches(x, '{p}') then length(regexp_extract(x, '(?s)^(.*?)(?:' || '{p}' || ')', 1)) + 1 end"


_OPENED = ", ".join(f"struct_pack(s := coalesce({', '.join(map(_place, openings))}), z := '{z}')" for z, openings in casefile.ZONES.items())
_MODEL = rf"""x as (select id, case_id, filename, coalesce(text, '') as x, {_PRIORITY} as priority from docs), h as (select *, length(x) as n, unnest([{_OPENED}]) as h from x),
  z as (select id, h.z as zone, h.s as start, coalesce(lead(h.s) over (partition by id order by h.s, h.z), n + 1) - 1 as stop, x from h where h.s is not null)"""


@case_query(f"with {_MODEL} select id, zone, start::int as start, stop::int as stop, md5(substr(x, start, stop - start + 1)) as digest from z")
def x17_all_zones(t: World):
    d = t.docs.select("id", "text", F.explode(casefile.zones(F.col("text"))).alias("z"))
    return d.select("id", "z.zone", "z.start", F.col("z.end").alias("stop"), F.md5(F.substr("text", F.col("z.start"), F.col("z.end") - F.col("z.start") + 1).cast("binary")).alias("digest"))


_KNOWN = ("court_id", "claimant", "city")


@case_query(rf"""with {_MODEL},
  l as (select id, string_agg('[' || zone || '] ' || substr(x, start, stop - start + 1), chr(10) order by start, zone) as lines from z group by 1),
  b as (select id, row_number() over (partition by case_id order by priority, id) as k from x where x <> '' and priority <= 2 and id not in (select id from l)),
  d as (select x.case_id, x.priority, x.id, chr(10) || '=== ' || filename || ' [' || right(filename, 3) || '] ===' || chr(10) || coalesce(lines, '[body] ' || left(x, 3000)) as said from x left join l using (id) left join b using (id) where lines is not null or k <= 2),
  p as (select case_id, string_agg(said, chr(10) order by priority, id) as papers from d group by 1),
  m as (select *, row_number() over (partition by case_id order by received desc, id) as k from mails where case_id is not null),
  e as (select case_id, string_agg(chr(10) || '=== EMAIL: ' || left(coalesce(subject, ''), 60) || ' ===' || chr(10) || 'De: ' || coalesce(sender, '') || ' | Fecha: ' || strftime(received, '%Y-%m-%d') || case when coalesce(status, '') <> '' then chr(10) || left(status, 2000) else '' end, chr(10) order by k) as letters from m where k <= 5 group by 1),
  f as (select id as case_id, 'CASO: ' || coalesce(folder, '') as head, array_to_string(list_filter([{', '.join(f"case when {c} <> '' then '  {c}: ' || {c} end" for c in _KNOWN)}], lambda y: y is not null), chr(10)) as fields from cases)
  select case_id, md5(concat_ws(chr(10), head || case when fields <> '' then chr(10) || chr(10) || 'CAMPOS:' || chr(10) || fields else '' end, papers, letters)) as digest from f left join p using (case_id) left join e using (case_id)""")
def x31_prompt(t: World):
    model = casefile.documents(t.docs, F.expr(_PRIORITY), F.right("filename", F.lit(3)))
    out = casefile.prompts(model, t.cases, t.mails.withColumn("body", F.col("status")), list(_KNOWN))
    return out.select("case_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


# --- guards and pauses, cut-off answers --------------------------------------------------------------------------------------------

_PRINTS = """h as (select case_id, 1 as run, file_hash as h from docs union all select case_id, 2, file_hash from docs union all select case_id, 2, message_id from mails where case_id is not null and status = 'PROCESADO'),
  p as (select case_id, run, md5(string_agg(h, '|' order by h)) as print from h group by 1, 2)"""


@case_query(f"with {_PRINTS} select case_id, run, print, coalesce(print = lag(print) over (partition by case_id order by run), false) as unchanged from p")
def st07_fingerprint_guard(t: World):
    # two runs: before and after the mails came in; notes are kept where nothing new did
    before = t.docs.select("case_id", F.lit(1).alias("run"), F.col("file_hash").alias("h"))
    came = t.mails.where("case_id is not null and status = 'PROCESADO'").select("case_id", F.lit(2).alias("run"), F.col("message_id").alias("h"))
    every = before.unionByName(before.withColumn("run", F.lit(2))).unionByName(came)
    prints = every.groupBy("case_id", "run").agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "|").cast("binary")).alias("print"))
    return state.guarded_rows(prints, "case_id", "run", "print").select(F.col("key").alias("case_id"), F.col("seq").cast("int").alias("run"), "print", "unchanged")


@case_query("""with r as (select provider, id, used, coalesce(error ilike '%429%' or error ilike '%rate%', false) as refused from usage),
  l as (select *, max(case when refused then used end) over (partition by provider order by used, id rows between unbounded preceding and 1 preceding) as last from r)
  select provider, id, coalesce(used - last < interval 60 second, false) as paused from l""")
def st09_paused_calls(t: World):
    return state.paused_rows(t.usage, "provider", "id", "used", F.col("error").ilike("%429%") | F.col("error").ilike("%rate%"))


_CUT = """with j as (select o_orderkey, '{"lines":[' || string_agg('{"p":' || l_partkey || ',"q":' || l_quantity::bigint || '}', ',' order by l_linenumber, l_partkey, l_quantity::bigint || '}') || ']}' as j from orders join lineitem on l_orderkey = o_orderkey group by 1),
  c as (select o_orderkey, left(j, (10 + o_orderkey % (length(j) - 9))::int) as c from j)"""


@query(_CUT + r""" select o_orderkey, length(c) - length(replace(c, '{', '')) - 1 as lines, len(regexp_extract_all(c, '"p":(\d+),', 1)) as parts, coalesce(list_sum(list_transform(regexp_extract_all(c, '"q":(\d+)\}', 1), lambda x: x::bigint)), 0)::bigint as quantity from c""")
def f42_nested(t: Tables):
    # answers cut off at any place: lists of lines, of which the whole values come back
    line = F.concat(F.lit('{"p":'), F.col("l_partkey").cast("string"), F.lit(',"q":'), F.col("l_quantity").cast("bigint").cast("string"), F.lit("}"))
    d = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", line.alias("x")))).alias("x")).join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi")
    j = F.concat(F.lit('{"lines":['), F.array_join(F.transform("x", lambda x: x["x"]), ","), F.lit("]}"))
    d = d.select("o_orderkey", j.alias("j")).select("o_orderkey", F.left("j", (10 + F.col("o_orderkey") % (F.length("j") - 9)).cast("int")).alias("c"))
    lines = F.from_json(repair_json("c"), "lines array<struct<p:bigint,q:bigint>>")["lines"]
    d = d.select("o_orderkey", lines.alias("l"))
    q = F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["q"], F.lit(0)))
    return d.select("o_orderkey", F.size("l").cast("bigint").alias("lines"), F.size(F.filter("l", lambda x: x["p"].isNotNull())).cast("bigint").alias("parts"), q.alias("quantity"))


# --- actors ------------------------------------------------------------------------------------------------------------------------

_ROLES = " union all ".join(f"select '{r}' as role, count(*) as documents from docs where " + " or ".join(f"regexp_matches(text, '{p}')" for p, _, _ in rules) for r, rules in actors.GRAMMAR.items())


@case_query(f"select * from ({_ROLES}) where documents > 0")
def x18_roles(t: World):
    return actors.actors(t.docs, "id", "text").groupBy("role").agg(F.count_distinct("id").alias("documents"))


@case_query()
def x18_actors(t: World):
    return actors.actors_of_cases(actors.actors(t.docs, "id", "text", "case_id"), t.docs, "id", "case_id")


# --- versions of the catalogue ------------------------------------------------------------------------------------------------------

VERSIONS = {"first": ("radicado_23_continuous", "forest_specific"), "second": ("radicado_23_continuous", "radicado_23_separators", "forest_specific"), "current": ("radicado_23_continuous", "radicado_23_separators", "forest_specific", "forest_keyword")}
_TRIED = [(i, p) for i, p in enumerate(CATALOGUE) if p.name in VERSIONS["current"]]
_VERSION_ROWS = " union all ".join(
    f"select '{v}' as version, case_id, '{p.field}' as field, regexp_replace(regexp_extract(text, '{_sql(p.regex)}', 1), '\\D', '', 'g') as got, id, priority, {i} as o from d where regexp_matches(text, '{_sql(p.regex)}')"
    for v, names in VERSIONS.items()
    for i, p in _TRIED
    if p.name in names
)


@case_query(
    rf"""with d as (select id, case_id, coalesce(text, '') as text, {_PRIORITY} as priority from docs), a as ({_VERSION_ROWS}),
  v as (select * from a where case field when 'court_id' then len(got) >= 20 else length(got) >= 7 and got not in ('3634740', '6076337000', '6076336100', '6076336000') and not starts_with(got, '68') and length(replace(got, got[1], '')) > 0 end),
  b as (select * from v qualify row_number() over (partition by version, case_id, field order by priority, o, id) = 1),
  h as (select version, id as case_id, field, nullif(case when field = 'court_id' then regexp_replace(coalesce(court_id, ''), '\D', '', 'g') else regexp_replace(coalesce(filing, ''), '\D', '', 'g') end, '') as held
    from cases, (select unnest(['first', 'second', 'current']) as version), (select unnest(['court_id', 'filing']) as field)),
  j as (select h.*, got from h left join b using (version, case_id, field))
  select version, field, count(*) filter (held = got) as match, count(*) filter (held <> got) as mismatch, count(*) filter (held is not null and got is null) as row_only, count(*) filter (held is null and got is not null) as found_only from j group by 1, 2"""
)
def x34_versions(t: World):
    found = extraction.found_values(t.docs, "id", "text", VERSIONS["current"])
    rows = t.cases.select(F.col("id").alias("case_id"), "court_id", "filing")
    return extraction.compared_versions(found, t.docs, rows, "id", "case_id", F.expr(_PRIORITY), VERSIONS, {"court_id": F.col("court_id"), "filing": F.col("filing")})
