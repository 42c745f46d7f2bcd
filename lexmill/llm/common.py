"""Shared helpers: staged tables in the folder all executors see, hot-key-safe joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[ \x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where unset (tests on one machine), a new temporary one. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lexmill-" in root:
                spark = df.sparkSession
                path = spark._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, records: int = 500) -> None:
    """Bound what one Arrow batch holds, for tables whose rows carry long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)


def words(text: F.Column) -> F.Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null and blank give an empty array."""
    cut = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, BLANK_CLASS + "+"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge.

    ``edges``: (a, b) bigint, any order, repeats and loops allowed. Alternates large-star and small-star
    steps until the set of edges no longer changes; every step is a group-by with a map-side minimum and
    a join, and its result is a staged table. Returns (id, component_id); ids without an edge are absent.
    Null ids have no edges.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e = staged(e, "edges")
    mark = None
    for _ in range(rounds):
        both = e.select("v", "u").unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        # large-star: neighbours above v are tied to the smallest of v's neighbourhood
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # small-star: v and its lower neighbours are tied to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
            .select("x.v", "x.u")
            .where("v <> u")
            .distinct()
        )
        new = staged(small, "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        drop_staged(e)
        e = new
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("u").alias("id"), F.col("u").alias("component_id")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(roots)
