"""Pairs of near vectors, over all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block; every block meets every other, two in memory at a time, so what is shuffled falls as blocks grow. Rows that are compared at once.
BLOCK_ROWS, STEP_ROWS = 4096, 256


def cosine_pairs(df: DataFrame, key: str, vector: str, threshold: float, block: str | None = None, rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) of all keys a < b whose cosine is at least ``threshold`` (above 0), in double precision.

    With ``block``, only of rows equal in it. Keys are integers and differ. Null and zero vectors are near to none; the
    vectors have one length. Blocks are dealt by a hash of the key and bounded, and their pairs are spread over the tasks.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    own = (F.col(block) if block else F.lit(None)).cast("string").alias("block")
    # single numbers travel as they are; tasks make them double
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    d = df.select(F.col(key).cast("bigint").alias("k"), F.col(vector).cast(kind).alias("v"), own).where("k is not null and v is not null")
    n = -(-d.count() // rows) or 1
    d = d.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).cast("int").alias("i")).agg(F.collect_list(F.struct("k", "v", "block")).alias("x"))
    left = d.select("i", F.explode(F.sequence("i", F.lit(n - 1))).alias("j"), "x")
    right = d.select(F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), F.col("x").alias("y"))

    def load(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = cell.values
        v = x.field("v")
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            m = m / np.linalg.norm(m, axis=1, keepdims=True)
        return x.field("k").to_numpy(zero_copy_only=False), m, np.array(x.field("block").to_pylist(), object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                (a, x, p), (b, y, q) = load(batch.column("x")[r]), load(batch.column("y")[r])
                same = batch.column("i")[r] == batch.column("j")[r]
                for at in range(0, len(a), STEP_ROWS):
                    own = slice(at, at + STEP_ROWS)
                    sim = x[own] @ y.T
                    near = sim >= threshold
                    if block:
                        near &= p[own, None] == q[None, :]
                    if same:
                        near &= a[own, None] < b[None, :]
                    s, t = np.nonzero(near)
                    columns = [np.minimum(a[own][s], b[t]), np.maximum(a[own][s], b[t]), sim[s, t]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "similarity"])

    joined = left.join(right, ["i", "j"]).select("i", "j", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")
