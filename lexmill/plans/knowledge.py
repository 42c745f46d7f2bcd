"""The kept full-text index of cases: its entries, its terms, and searches on it."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import fulltext, knowledge
from lexmill.sources import files, versions
from lexmill.plans.world import World, case_query

FIELDS = "claimant defendants linked court city rights subject notes court_id filing lawyer folder".split()
BUILT = datetime(2026, 1, 1)

_LINES = ", ".join(f"case when trim(coalesce({c}, '')) <> '' then '{c}: ' || {c} end" for c in FIELDS)
ENTRIES = rf"""
  own0 as (select id, case_id, case when ends_with(filename, '.docx') then 'docx' else 'pdf' end as source_type, filename as source_name, text as content from docs where length(trim(text)) >= 10),
  own as (select * from own0 qualify row_number() over (partition by case_id, content order by id) = 1),
  sent0 as (select id + 1099511627776 as id, case_id, 'email' as source_type, 'email_' || id || '_' || left(coalesce(subject, ''), 50) as source_name,
      'Subject: ' || coalesce(subject, '') || chr(10) || 'From: ' || coalesce(sender, '') || chr(10) || chr(10) || coalesce(status, '') || ' ' || message_id as content from mails),
  sent as (select * from sent0 where length(trim(content)) >= 10 and content not in (select content from own) qualify row_number() over (partition by content order by id) = 1),
  known as (select id + 2199023255552 as id, id as case_id, 'db_field' as source_type, 'case_' || id || '_fields' as source_name, array_to_string(list_filter([{_LINES}], lambda x: x is not null), chr(10)) as content from cases),
  kept0 as (select id + 3298534883328 as id, case_id, 'email_md' as source_type, 'Email_' || strftime(received, '%Y%m%d') || '.md' as source_name, '# ' || coalesce(subject, 'sin asunto') || chr(10) || coalesce(sender, '') as content from mails),
  kept as (select * from kept0 where length(trim(content)) >= 10 and content not in (select content from own) and content not in (select content from sent) qualify row_number() over (partition by content order by id) = 1),
  entries as (select id, case_id, source_type, source_name, left(content, 50000) as content from (select * from own union all select * from sent union all select * from known where content <> '' union all select * from kept))"""
#: The token lists of an entry's columns.
_TOKENS = r""", t as (select *, regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+') as c0, regexp_extract_all(lower(strip_accents(source_name)), '[\p{L}\p{N}]+') as c1, regexp_extract_all(lower(strip_accents(source_type)), '[\p{L}\p{N}]+') as c2 from entries)"""


def _starts(column: str, *words: str) -> str:
    """SQL: the places (from 1) in a token list where a phrase begins; a last word that ends in * is a prefix."""
    same = " and ".join(f"starts_with(coalesce({column}[i + {k}], ''), '{w[:-1]}')" if w.endswith("*") else f"{column}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"list_filter(range(1, len({column}) + 1), lambda i: {same})"


def _ranked(phrases: list[tuple[str, ...]], holds: str, k: int, only: str = "true", columns: str = "012") -> str:
    """SQL: the best rows by BM25; ``holds`` speaks of p0, p1, ... (times of the phrases) and s0, s1, ... (their places in the content)."""
    times = ", ".join(" + ".join(f"len({_starts(f'c{c}', *p)})" for c in columns) + f" as p{i}, {_starts('c0', *p)} as s{i}" for i, p in enumerate(phrases))
    counts = ", ".join(f"count(*) filter (p{i} > 0) as n{i}" for i in range(len(phrases)))
    score = " + ".join(f"greatest(ln((n_rows - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * p{i} * 2.2 / (p{i} + 1.2 * (0.25 + 0.75 * tokens / mean))" for i in range(len(phrases)))
    return f"""with {ENTRIES.lstrip()}{_TOKENS},
  f as (select id, case_id, source_type, len(c0) + len(c1) + len(c2) as tokens, {times} from t), a as (select count(*) as n_rows, avg(tokens) as mean, {counts} from f)
  select id, case_id, source_type, -({score})::double as rank from f, a where ({holds}) and {only} order by rank, id limit {k}"""


def rows(t: World) -> DataFrame:
    mails = t.mails.withColumn("body", F.concat(F.coalesce("status", F.lit("")), F.lit(" "), "message_id"))
    md = t.mails.select(
        "id", "case_id", F.concat(F.lit("Email_"), F.date_format("received", "yyyyMMdd"), F.lit(".md")).alias("filename"),
        F.concat(F.lit("# "), F.coalesce("subject", F.lit("sin asunto")), F.lit("\n"), F.coalesce("sender", F.lit(""))).alias("text"),
    )
    return knowledge.entries(t.docs, mails, t.cases, md, FIELDS)


def kept_index(t: World) -> fulltext.Index:
    """The index of these tables: built once in the shared folder, found again as long as the files that it is made of are the same."""
    needs = sorted(f for name in ("lineitem", "events", "orders", "customer", "nation") for f in getattr(t, name).inputFiles())
    sizes = [(f, *_stat(t, f)) for f in needs]
    root = f"{files.shared_root(t.spark)}/lexmill-index-{hashlib.md5(repr(sizes).encode()).hexdigest()}"
    index = fulltext.Index(t.spark, root, knowledge.COLUMNS, ["case_id"])
    if not versions.versions(t.spark, root):
        index.add(rows(t), BUILT)
    return index


def _stat(t: World, file: str) -> tuple[int, int]:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(file)
    status = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getLen(), status.getModificationTime()


@case_query(f"with {ENTRIES.lstrip()} select id, case_id, source_type, source_name, md5(content) as print, length(content)::bigint as chars from entries")
def n04_entries(t: World):
    d = rows(t)
    return d.select("id", "case_id", "source_type", "source_name", F.md5(F.col("content").cast("binary")).alias("print"), F.length("content").cast("bigint").alias("chars"))


@case_query(f"with {ENTRIES.lstrip()}{_TOKENS}, w as (select id, unnest(list_concat(list_concat(c0, c1), c2)) as term from t) select term, count(*) as tf, count(distinct id) as df from w group by 1")
def n04_kept_terms(t: World):
    return kept_index(t).term_totals()


def _search(t: World, query: str, k: int, only=None) -> DataFrame:
    return kept_index(t).search(query, k, only).select("id", "case_id", "source_type", "rank")


@case_query(_ranked([("tutela",), ("incidente",), ("fallo",)], "(p0 > 0 or p1 > 0) and p2 = 0", 200))
def n01_match(t: World):
    return _search(t, "(tutela OR incidente) NOT fallo", 200)


@case_query(_ranked([("primera", "instancia"), ("juzgado",)], "p0 > 0 and p1 > 0", 100))
def n01_phrase(t: World):
    return _search(t, '"Primera INSTANCIA" juzgado', 100)


@case_query(_ranked([("resuelve",), ("conced*",)], "p0 > 0 and p1 > 0 and (exists (select 1 from (select unnest(s0) as a) x, (select unnest(s1) as b) y where a + 1 + 4 >= b and b >= a or b + 1 + 4 >= a and a >= b))", 150))
def n01_near(t: World):
    return _search(t, "NEAR(resuelve conced*, 4)", 150)


@case_query(_ranked([("tutela",), ("corte",)], "p0 > 0 or p1 > 0", 120, "source_type = 'email'"))
def n01_source(t: World):
    # ranks are those among all sources
    return _search(t, "tutela OR corte", 120, F.col("source_type") == "email")


_CHANGED = r"""changed as (select id, case_id, filename, case when id % 5 = 0 then 'nuevo ' || coalesce(text, 'texto') else text end as text from docs where id % 7 <> 0),
  t as (select id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') as c0 from changed)"""


@case_query(f"""with {_CHANGED}, w as (select id, unnest(c0) as term from t) select term, count(*) as tf, count(distinct id) as df from w group by 1""")
def n05_maintained(t: World):
    # built, changed and thinned out by later segments, then merged: as if built of the last state
    d = t.docs.select("id", "text")
    index = fulltext.Index(t.spark, files.work_path(t.spark, "index"), ["text"])
    index.add(d, BUILT)
    changed = d.where("id % 5 = 0 and id % 7 <> 0").withColumn("text", F.concat(F.lit("nuevo "), F.coalesce("text", F.lit("texto"))))
    index.add(changed, BUILT, gone=d.where("id % 7 = 0"))
    index.merge(BUILT)
    return index.term_totals()
