"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on everything that its predecessor kept; ``run`` writes each
one's result as Parquet in the shared folder and hands it on. All stages but the last return the columns of
``documents``; the last returns a row for each copy of a document that the mix takes.

Null, empty and blank texts have no words, and the first stage rejects them; if they reach later stages, line dedup and
MinHash leave them as they are and the mix takes no copy. Rows with a null doc_id stay in every stage, are compared with none,
and get copies of their own; rows that share a doc_id are one document to line dedup and MinHash (what goes, goes in all)
and rows of their own to the mix. Ties go to the smallest doc_id. Empty tables give no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, linededup, minhash, mixing, quality_rules
from lexmill.llm.common import drop_staged, read_table, staged
from lexmill.llm.queries import multi_vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one holds; n_chars follows the text."""
    out = linededup.dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    extra = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(extra, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each row of ``docs`` as the mix takes copies of it, whether its doc_id is null, repeated or neither."""
    taken = mixing.mix(docs, carry=tuple(COLUMNS)).where("copies > 0").select("row", "copies")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of what they decode to."""
    vocabulary = multi_vocabulary()
    coded = bpe.decode(bpe.encode(docs, vocabulary, keep=("doc_id", "lang", "source")), vocabulary)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Line dedup aligns documents by a patience diff and BPE merges by rank, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return docs
