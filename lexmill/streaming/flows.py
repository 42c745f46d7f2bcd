"""Streams: ingestion once per key, usage by window, alerts without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files: int = 50) -> DataFrame:
    """New Parquet files under ``path``, ``files`` of them in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once_per_key(stream: DataFrame, ts: str, keys: list[str], look_back: str = "24 hours") -> DataFrame:
    """The first row of each key within ``look_back``; state older than that is dropped."""
    return stream.withWatermark(ts, look_back).dropDuplicatesWithinWatermark(keys)


def usage(stream: DataFrame, ts: str, group: str, value: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by tumbling or sliding window and group."""
    d = stream.withWatermark(ts, late) if stream.isStreaming else stream
    w = d.groupBy(F.window(ts, width, slide or width), group).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), group, "n", "total")


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a key's rows with no pause of ``gap`` or more."""
    d = df.withWatermark(ts, late) if df.isStreaming else df
    return d.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(batch: DataFrame, batch_id: int, path: str, key: str) -> None:
    """foreachBatch body: writes rows whose key is not there yet. A batch that is run again writes nothing twice."""
    if written(batch.sparkSession, path):
        batch = batch.join(batch.sparkSession.read.parquet(path).select(key), key, "left_anti")
    batch.dropDuplicates([key]).write.mode("append").parquet(path)


def new_alerts(found: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Alerts without an open equal one; nulls in ``keys`` are equal."""
    e = existing.where("status = 'open'").select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return found.join(e, same, "left_anti")
