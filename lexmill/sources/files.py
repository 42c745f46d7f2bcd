"""Readers and writers: delimited case lists, folder trees, mail files, snapshots."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_TYPES = ("pdf", "docx", "doc", "png", "jpg", "jpeg", "md")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a temporary one where it is unset, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/files-{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, on one machine only, a temporary one that the session keeps to."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        root = work_path(spark, "x").rpartition("/")[0]
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there, and lost executors do not matter."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def case_list(spark: SparkSession, path: str, id_column: str, known: DataFrame | None = None) -> DataFrame:
    """A ``;`` separated list with a header: values trimmed, empty ones null, rows whose id is known left out."""
    raw = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*(c.lstrip("﻿").strip() for c in raw.columns))
    d = raw.select(*(F.nullif(F.btrim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns))
    return d if known is None else d.join(known.select(id_column), id_column, "left_anti")


def folder_documents(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Documents under folders named ``20...``: folder, filename, extension, length, modified, md5 of the bytes (if ``content``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    d = files.select(
        F.get(parts, F.size(parts) - 2).alias("folder"),
        F.get(parts, F.size(parts) - 1).alias("filename"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"),
        "length",
        F.col("modificationTime").alias("modified"),
        *([F.md5("content").alias("hash"), "content"] if content else []),
    )
    return d.where(F.regexp_like("folder", F.lit(r"^20[2]\d")) & F.col("extension").isin(*DOCUMENT_TYPES))


def folder_fingerprints(documents: DataFrame) -> DataFrame:
    """One digest per folder of its name, number of files and newest time: equal while nothing changed."""
    d = documents.groupBy("folder").agg(F.count("*").alias("n"), F.max("modified").alias("newest"))
    return d.select("folder", F.md5(F.concat_ws(":", "folder", "n", F.unix_micros("newest")).cast("binary")).alias("fingerprint"))


def docx_text(documents: DataFrame) -> DataFrame:
    """folder, filename, text of ``content`` read as DOCX: the paragraphs of the body, null if it is none."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        def one(raw: bytes) -> str | None:
            try:
                body = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode()
            except (zipfile.BadZipFile, KeyError):
                return None
            return "\n".join(unescape("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)", p))) for p in re.findall(r"<w:p[ >].*?</w:p>", body, re.S))

        return content.map(one)

    return documents.select("folder", "filename", read("content").alias("text"))


def mail_files(mails: DataFrame, when: str, subject: str) -> DataFrame:
    """Adds ``filename``: Email_YYYYMMDD_subject.md, without characters that file systems refuse."""
    name = F.left(F.regexp_replace(F.coalesce(subject, F.lit("")), r"[^\p{L}\p{N}]+", "_"), F.lit(80))
    return mails.withColumn("filename", F.concat(F.lit("Email_"), F.date_format(when, "yyyyMMdd"), F.lit("_"), name, F.lit(".md")))


def snapshot(df: DataFrame, root: str, name: str) -> str:
    """A copy of ``df`` under ``root``; never overwrites."""
    path = f"{root}/{name}"
    df.write.parquet(path)
    return path


def settings_list(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The strings of an array in a JSON settings file, one a row, blanks left out."""
    d = spark.read.option("multiLine", True).json(path).select(F.explode(field).alias(field))
    return d.select(F.btrim(field).alias(field)).where(F.col(field) != "")


def write_sheets(sheets: dict[str, DataFrame], root: str) -> list[str]:
    """Each table as CSV with a header in a folder of its own under ``root``; the folders' paths."""
    paths = []
    for name, df in sheets.items():
        paths.append(f"{root}/{name}")
        df.write.mode("overwrite").option("header", True).csv(paths[-1])
    return paths


def markdown_rows(df: DataFrame) -> DataFrame:
    """``line``: every row as a row of a Markdown table; bars inside values are escaped, nulls are empty."""
    cells = [F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]


def write_statistics(df: DataFrame, path: str) -> None:
    """Statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def expired_snapshots(names: DataFrame, keep: int = 7) -> DataFrame:
    """Of (name, made), the snapshots beyond the ``keep`` newest."""
    newest = names.orderBy(F.desc("made"), F.desc("name")).limit(keep)
    return names.join(newest.select("name"), "name", "left_anti")
