"""Sources and sinks: each query writes a table as files in the shared folder and returns what its reader finds there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.catalogue import Tables, query
from lexmill.plans.world import World, case_query
from lexmill.sources import files


@query("""select c_custkey::varchar as id, c_name as name, nullif(c_mktsegment, 'BUILDING') as segment from customer where c_custkey % 5 <> 0""")
def s01_case_list(t: Tables):
    path = files.work_path(t.spark, "list")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment")
    t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), segment).write.option("sep", ";").option("header", True).csv(path)
    known = t.customer.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return files.case_list(t.spark, path, "id", known)


@query("select n_name as lawyers from nation")
def s16_settings(t: Tables):
    # a settings file holds one short list
    path = files.work_path(t.spark, "settings")
    t.nation.agg(F.sort_array(F.collect_list(F.concat("n_name", F.lit(" ")))).alias("lawyers")).coalesce(1).write.json(path)
    return files.settings_list(t.spark, path, "lawyers")


@case_query("""select 'cover' as sheet, 'cases' as a, count(*)::varchar as b from cases union all select 'cover', 'documents', count(*)::varchar from docs
  union all select 'data', id::varchar, nullif(coalesce(city, ''), '') from cases union all select 'stats', coalesce(nullif(state, ''), ''), count(*)::varchar from cases group by 2""")
def s17_sheets(t: World):
    count = lambda name, d: d.agg(F.count("*").alias("b")).select(F.lit(name).alias("a"), "b")
    sheets = {
        "cover": count("cases", t.cases).unionByName(count("documents", t.docs)),
        "data": t.cases.select(F.col("id").alias("a"), F.col("city").alias("b")),
        "stats": t.cases.groupBy(F.coalesce("state", F.lit("")).alias("a")).agg(F.count("*").alias("b")),
    }
    out = None
    for sheet, path in zip(sheets, files.write_sheets(sheets, files.work_path(t.spark, "book")), strict=True):
        d = t.spark.read.option("header", True).schema("a string, b string").csv(path)
        a = F.col("a") if sheet == "data" else F.coalesce("a", F.lit(""))
        d = d.select(F.lit(sheet).alias("sheet"), a.alias("a"), F.nullif("b", F.lit("")).alias("b"))
        out = d if out is None else out.unionByName(d)
    return out


@case_query(r"""select '| ' || id || ' | ' || replace(coalesce(city, ''), '|', '\|') || ' | ' || replace(coalesce(defendants, ''), '|', '\|') || ' |' as line from cases""")
def s18_markdown(t: World):
    return files.markdown_rows(t.cases.select("id", "city", "defendants"))


@case_query(r"""select id, 'Email_' || strftime(received, '%Y%m%d') || '_' || left(regexp_replace(coalesce(subject, ''), '[^\p{L}\p{N}]+', '_', 'g'), 80) || '.md' as filename from mails""")
def s19_mail_files(t: World):
    return files.mail_files(t.mails, "received", "subject").select("id", "filename")


@query("with n as (select n_name as name, n_nationkey as made from nation) select name, made from (select *, row_number() over (order by made desc, name desc) as k from n) where k > 7")
def s20_snapshots(t: Tables):
    path = files.snapshot(t.nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("made")), files.work_path(t.spark, "backup"), "one")
    return files.expired_snapshots(t.spark.read.parquet(path))


@case_query("select coalesce(status, 'NULL') as status, count(*) as n from cases group by 1")
def s21_statistics(t: World):
    path = files.work_path(t.spark, "stats")
    files.write_statistics(t.cases.groupBy(F.coalesce("status", F.lit("NULL")).alias("status")).agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("status string, n bigint").json(path)
