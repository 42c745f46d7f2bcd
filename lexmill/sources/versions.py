"""Versioned tables under one root: a version is what its manifest names, and the manifest is written last.

``root/data/<token>/<table>`` holds Parquet, ``root/manifest/<number>.json`` says which folders make a version, when it was made and what
else is to be known. A write that is killed leaves folders that no manifest names; no reader sees them, and the next ``prune`` takes them away.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, and the age that the newest must have before another is made.
KEEP, LEAST_AGE = 7, timedelta(minutes=30)


@dataclass(frozen=True)
class Version:
    number: int
    made: datetime
    folders: dict[str, str]
    extra: dict = field(default_factory=dict)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    path, fs = _path(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, root: str) -> list[Version]:
    """Whole versions, oldest first."""
    out = []
    for name in _names(spark, f"{root}/manifest"):
        if name.endswith(".json"):
            path, fs = _path(spark, f"{root}/manifest/{name}")
            stream = fs.open(path)
            try:
                said = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
            out.append(Version(said["number"], datetime.fromisoformat(said["made"]), said["folders"], said["extra"]))
    return sorted(out, key=lambda v: v.number)


def write_folders(root: str, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Writes tables into a new folder; nothing reads them until a manifest names them. Returns the folder of each."""
    token = uuid.uuid4().hex
    for name, df in tables.items():
        # kept for long and read often, so packed closer than what is only staged
        df.write.option("compression", "zstd").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{root}/data/{token}/{name}")
    return {name: f"data/{token}/{name}" for name in tables}


def publish(spark: SparkSession, root: str, folders: dict[str, str], made: datetime, extra: dict | None = None) -> Version:
    """Makes ``folders`` the newest version, by renaming a finished manifest; fails if another writer has taken the number."""
    old = versions(spark, root)
    new = Version(old[-1].number + 1 if old else 1, made, folders, extra or {})
    draft, fs = _path(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({"number": new.number, "made": made.isoformat(), "folders": folders, "extra": new.extra}).encode()))
    out.close()
    final, _ = _path(spark, f"{root}/manifest/{new.number:012d}.json")
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"version {new.number} of {root} was made by someone else")
    return new


def commit(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], now: datetime, keep: int = KEEP, least_age: timedelta = LEAST_AGE, extra: dict | None = None
) -> Version | None:
    """A new version of ``tables``, and only the newest ``keep`` stay; None, and nothing written, if the newest is younger than ``least_age``."""
    old = versions(spark, root)
    if old and now - old[-1].made < least_age:
        return None
    new = publish(spark, root, write_folders(root, tables), now, extra)
    prune(spark, root, keep)
    return new


def prune(spark: SparkSession, root: str, keep: int = KEEP) -> None:
    """Deletes all but the newest ``keep`` versions, manifests first, then folders that no manifest names any more."""
    known = versions(spark, root)
    for v in known[:-keep]:
        path, fs = _path(spark, f"{root}/manifest/{v.number:012d}.json")
        fs.delete(path, False)
    named = {f.split("/")[1] for v in known[-keep:] for f in v.folders.values()}
    for token in _names(spark, f"{root}/data"):
        if token not in named:
            path, fs = _path(spark, f"{root}/data/{token}")
            fs.delete(path, True)


def read(spark: SparkSession, root: str, table: str, number: int | None = None) -> DataFrame:
    """A table of the newest version, or of that with the number."""
    known = {v.number: v for v in versions(spark, root)}
    if not known:
        raise FileNotFoundError(f"no version in {root}")
    return spark.read.parquet(f"{root}/{known[max(known) if number is None else number].folders[table]}")


def restore(spark: SparkSession, root: str, number: int, now: datetime) -> Version:
    """The tables of an old version as the newest one, without copying them."""
    old = next(v for v in versions(spark, root) if v.number == number)
    return publish(spark, root, old.folders, now, old.extra | {"restored": number})


def compare(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of the rows that differ between two roots' tables: only in ``a``, only in ``b``, or with other values in ``columns``."""
    side = lambda df, name: df.select(key, F.struct(*columns).alias(name))
    both = side(a, "x").join(side(b, "y"), key, "full")
    change = F.when(F.col("y").isNull(), "only_first").when(F.col("x").isNull(), "only_second").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
