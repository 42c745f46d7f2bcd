"""What the full-text index holds of a case file: documents, mails, the cases' own fields and mail files, each content once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.compat import filled_trim
from lexmill.sources.files import staged

#: Characters of an entry that are indexed, and the fewest that make one (fixed values).
MOST, LEAST = 50_000, 10
#: Entries of the sources are numbered from multiples of this on.
SOURCE_STEP = 1 << 40
COLUMNS = ["content", "source_name", "source_type"]


def _entries(df: DataFrame, number: int, key: str, case: Column, kind: Column, name: Column, content: Column) -> DataFrame:
    # out of an array of one, a content is made once, not once more for each use of it
    d = df.select((F.col(key) + F.lit(number * SOURCE_STEP)).cast("bigint").alias("id"), case.cast("bigint").alias("case_id"), kind.alias("source_type"), name.alias("source_name"), F.explode(F.array(content)).alias("content"))
    return d.where(F.length(F.btrim("content")) >= LEAST).withColumn("print", F.unhex(F.md5(F.col("content").cast("binary"))))


def _first(df: DataFrame, *by: str) -> DataFrame:
    """The rows of the smallest id in each group. Rows that are dealt out by a part of ``by`` already stay where they are."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    return df.withColumn("__k", place).where("__k = 1").drop("__k")


def entries(docs: DataFrame, mails: DataFrame, cases: DataFrame, files: DataFrame, fields: list[str]) -> DataFrame:
    """(id, case_id, source_type, source_name, content).

    ``docs``: (id, case_id, filename, text); a content is indexed once a case. ``mails``: (id, case_id, subject, sender, body) and ``files``: (id,
    case_id, filename, text), the mails kept as files; a content is indexed once at all, the first source that has it counts. ``cases``: (id and ``fields``), one entry of the
    filled fields of each. Contents under ten characters are left out, longer ones than 50,000 are cut there. Null ids and names are left as they are.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when(F.endswith("filename", F.lit(".docx")), "docx").otherwise("pdf")
    every = _entries(docs, 0, "id", F.col("case_id"), kind, F.col("filename"), F.col("text"))
    own = _first(every, "case_id", "print")
    # what is compared is small and read twice; texts stay where they are
    prints = staged(every.select("print").distinct(), "prints")
    said = F.concat(F.lit("Subject: "), text("subject"), F.lit("\nFrom: "), text("sender"), F.lit("\n\n"), text("body"))
    name = F.concat(F.lit("email_"), F.col("id").cast("string"), F.lit("_"), F.left(text("subject"), F.lit(50)))
    sent = _first(_entries(mails, 1, "id", F.col("case_id"), F.lit("email"), name, said), "print").join(prints, "print", "left_anti")
    lines = F.array(*(F.when(filled_trim(F.col(c)), F.concat(F.lit(f"{c}: "), F.col(c))) for c in fields))
    about = F.array_join(lines, "\n")  # blank ones are null and left out
    # fields that are made of others are made once
    known = cases.select("id", F.inline(F.array(F.struct(*fields)))).select("id", about.alias("about")).where("about <> ''")
    known = known.select((F.col("id") + F.lit(2 * SOURCE_STEP)).alias("id"), F.col("id").alias("case_id"), F.lit("db_field").alias("source_type"), F.concat(F.lit("case_"), F.col("id").cast("string"), F.lit("_fields")).alias("source_name"), F.col("about").alias("content"))
    kept = _first(_entries(files, 3, "id", F.col("case_id"), F.lit("email_md"), F.col("filename"), F.col("text")), "print")
    kept = kept.join(prints.unionByName(sent.select("print")), "print", "left_anti")
    shown = ["id", "case_id", "source_type", "source_name"]
    cut = lambda d: d.select(*shown, F.left("content", F.lit(MOST)).alias("content"))
    return cut(own).unionByName(cut(sent)).unionByName(known).unionByName(cut(kept))
