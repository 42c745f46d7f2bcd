"""Hard-negative mining over k-means inverted lists.

Each vector is in the list of its nearest centroid, and each list stores the largest distance to it, its radius. By
Cauchy-Schwarz the inner product of an anchor and any vector of a list is at most anchor . centroid +
|anchor| * radius and at least the same with a minus. An anchor visits lists in the order of that upper bound, skips lists whose
bounds lie outside the window of scores that it looks for, and stops when the bound falls strictly below its
k-th best score; at the k-th score itself a list is visited, since a smaller id may be there. Results are exact.

Visits go in rounds of growing numbers of lists: each round joins anchors and list blocks, multiplies them as
matrices and hands on the k best of each block, which set the next round's k-th scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import drop_staged, staged
from lexmill.llm.embeddings import codebook

#: Vectors by which the centroids of a width are fitted (by hash of the id), and bytes that they take at most; every vector is indexed.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
#: Widths with lists of their own; of any other, all vectors are one list, always visited.
FITTED_WIDTHS = 16
#: Lists of a width, and numbers that the centroids of a width hold, at most.
MAX_LISTS, MAX_NUMBERS = 1024, 1 << 20
#: Vectors of a list block, anchors of a block, and bytes of either, at most.
LIST_BLOCK, ANCHOR_BLOCK, BLOCK_BYTES = 4096, 512, 16 << 20
#: Lists that an anchor visits in the first round; each round ends at FACTOR times as many as the one before.
FIRST_VISITS, FACTOR = 4, 8
#: Longer vectors could have scores that 64 bits do not hold.
MAX_LENGTH = 2.0**31
_LOW, _HIGH = -(1 << 62), 1 << 62

_TARGET = "struct<target:bigint,base:bigint,low:bigint,high:bigint,least:bigint>"


def _vectors(df: DataFrame, key: str, vec_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, width, v): vectors of integers floor(scale * x), 4 bytes each; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, widths = [], []
            for x in batch.column("v").to_pylist():
                a = np.floor(np.array([math.nan if c is None else c for c in x], float) * scale)
                good = len(a) and np.isfinite(a).all() and np.sqrt((a * a).sum()) < MAX_LENGTH
                packed.append(a.astype("<i4").tobytes() if good else None)
                widths.append(len(a))
            keep = pa.array([p is not None for p in packed])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(widths, pa.int32()), pa.array(packed, pa.binary())], ["id", "label", "width", "v"]).filter(keep)

    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.where("id is not null and label is not null and v is not null").mapInArrow(run, "id bigint, label bigint, width int, v binary")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two sets of integer vectors."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((a * a).sum(1)).max() * np.sqrt((b * b).sum(1)).max() < 2**52:  # every partial sum is exact in doubles
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T).astype(np.int64)


def fit(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each of the most frequent widths, fitted on a bounded sample."""
    sizes = vectors.groupBy("width").count().orderBy(F.desc("count"), "width").limit(FITTED_WIDTHS).collect()
    out = {}
    for width, n in sizes:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width)))
        rows = vectors.where(F.col("width") == width).select("v", F.xxhash64("id").alias("o"), "id").orderBy("o", "id").limit(most).collect()
        points = np.frombuffer(b"".join(r["v"] for r in rows), "<i4").reshape(-1, width).astype(np.float64)
        k = max(1, min(MAX_LISTS, MAX_NUMBERS // width, math.ceil(math.sqrt(n)), len(points) // 4))
        out[width] = codebook(points, k)
    return out


def _listed(vectors: DataFrame, model: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the list of each (0 for widths without centroids) and its distance to the centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            lists, away = np.zeros(len(width), np.int32), np.zeros(len(width))
            for w in np.unique(width).tolist():
                c = shared.value.get(w)
                if c is None:
                    continue
                at = np.flatnonzero(width == w)
                for part in np.array_split(at, math.ceil(len(at) / 1024)):
                    x = matrix(batch.column("v").take(pa.array(part)), w)
                    own = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
                    lists[part], away[part] = own, np.sqrt(((x - c[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists), pa.array(away)], [*batch.schema.names, "list", "away"])

    return vectors.mapInArrow(run, "id bigint, label bigint, width int, v binary, list int, away double")


class Index:
    """Vectors in list blocks, with the centroids and the radius of each list of the fitted widths."""

    def __init__(self, vectors: DataFrame):
        self.model = fit(vectors)
        self.listed = staged(_listed(vectors, self.model), "lists")
        about = self.listed.groupBy("width", "list").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        fitted = about.where(F.col("width").isin(*self.model)).collect() if self.model else []  # FITTED_WIDTHS * MAX_LISTS rows at most
        self.radii = {w: np.full(len(c), -1.0) for w, c in self.model.items()}  # an empty list keeps -1 and is never visited
        for r in fitted:
            self.radii[r["width"]][r["list"]] = r["radius"]
        self.most = max([len(c) for c in self.model.values()], default=1)
        per_block = F.greatest(F.lit(1), F.least(F.lit(LIST_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("width") * 4))))
        self.sizes = staged(about.select("width", "list", F.ceil(F.col("n") / per_block).cast("int").alias("blocks")), "sizes")
        self.bounded = self.sizes.count() <= FITTED_WIDTHS * MAX_LISTS
        # a list that holds a large share of all vectors is dealt into blocks of bounded size
        self.rows = self.listed.join(self.by_list(self.sizes), ["width", "list"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int")).drop("blocks", "away")

    def by_list(self, table: DataFrame) -> DataFrame:
        """``table``, which has a row a list at most: broadcast, unless there are more than the lists of the fitted widths can be."""
        return F.broadcast(table) if self.bounded else table


def _bounds(a: np.ndarray, c: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of each anchor in each list, wide enough for rounding."""
    middle, reach = a @ c.T, np.sqrt((a * a).sum(1))[:, None] * np.maximum(radius, 0)[None, :]
    slack = 1.0 + 1e-9 * (np.abs(middle) + reach)
    return middle - reach - slack, middle + reach + slack


def _visits(anchors: DataFrame, index: Index, start: int, end: int) -> DataFrame:
    """(width, list, id, label, v, targets): the lists in places ``start`` to ``end`` of each anchor's order that may change the result of some target."""
    shared = anchors.sparkSession.sparkContext.broadcast((index.model, index.radii))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, radii = shared.value
        for batch in batches:
            width, row, lists = batch.column("width").to_numpy(), [], []
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                if w not in model:
                    row += at.tolist() if start == 0 else []
                    lists += [0] * len(at) if start == 0 else []
                    continue
                low, high = _bounds(matrix(batch.column("v").take(pa.array(at)), w), model[w], radii[w])
                order = np.argsort(-high, axis=1, kind="stable")
                for k, i in enumerate(at.tolist()):
                    own = order[k, start:end]
                    own = own[radii[w][own] >= 0]
                    top, bottom, wanted = high[k, own], low[k, own], np.zeros(len(own), bool)
                    for t in batch.column("targets")[i].as_py():
                        wanted |= (top >= t["least"]) & (top >= t["low"]) & (bottom <= t["high"])
                    lists += own[wanted].tolist()
                    row += [i] * int(wanted.sum())
            picked = batch.take(pa.array(row, pa.int32()))
            yield pa.RecordBatch.from_arrays([picked.column("width"), pa.array(lists, pa.int32()), *(picked.column(c) for c in ("id", "label", "v", "targets"))], ["width", "list", "id", "label", "v", "targets"])

    return anchors.select("width", "id", "label", "v", "targets").mapInArrow(run, f"width int, list int, id bigint, label bigint, v binary, targets array<{_TARGET}>")


def best_of_block(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest allowed scores of each row, equal scores by ascending id."""
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _compare(k: int, same: bool):
    """The k best of a list block for each target of the anchors of a block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        if left.num_rows and right.num_rows:
            width = left["width"][0].as_py()
            x, ids, labels = matrix(right["v"], width), right["id"].to_numpy(), right["label"].to_numpy()
            step = max(1, (1 << 20) // len(x))
            for at in range(0, left.num_rows, step):
                part = left.slice(at, step)
                anchor, label = part["id"].to_numpy(), part["label"].to_numpy()
                scores = products(matrix(part["v"], width), x)
                fit_ = (label[:, None] == labels[None, :]) & (anchor[:, None] != ids[None, :]) if same else label[:, None] != labels[None, :]
                targets = part["targets"].to_pylist()
                for j in range(max(map(len, targets))):
                    t = [ts[j] if j < len(ts) else None for ts in targets]
                    low = np.array([_HIGH if y is None else max(y["low"], y["least"]) for y in t])
                    high = np.array([_LOW if y is None else y["high"] for y in t])
                    row, col = best_of_block(scores, ids, fit_ & (scores >= low[:, None]) & (scores <= high[:, None]), k)
                    which = [np.array([(y and y[c]) or 0 for y in t], np.int64) for c in ("target", "base")]
                    for held, new in zip(found, (anchor[row], which[0][row], which[1][row], ids[col], scores[row, col]), strict=True):
                        held.append(new)
        return pa.table([np.concatenate(x) if x else np.zeros(0, np.int64) for x in found], names=["id", "target", "base", "other", "score"])

    return run


def search(anchors: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(id, target, base, other, score, rank): the k best rows for each target of each anchor, of its own label (not itself) or of others.

    ``anchors``: (id, label, width, v, targets), a target has bounds of its scores (low, high) and is told by (target, base); its ``least`` is
    the k-th score found so far. Staged; equal scores go by ascending id.
    """
    rank = F.row_number().over(Window.partitionBy("id", "target", "base").orderBy(F.desc("score"), "other"))
    per_block = F.greatest(F.lit(1), F.least(F.lit(ANCHOR_BLOCK), F.floor(F.lit(BLOCK_BYTES) / (F.col("width") * 4))))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    found, now, start, end = None, anchors, 0, FIRST_VISITS
    while start < index.most:
        visits = staged(_visits(now, index, start, end), "visits")
        asked = staged(visits.groupBy("width", "list").agg(F.count("*").alias("n")).select("width", "list", F.ceil(F.col("n") / per_block).cast("int").alias("parts")), "asked")
        left = visits.join(index.by_list(asked), ["width", "list"]).join(index.by_list(index.sizes), ["width", "list"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), "parts").cast("int"))
        left = left.withColumn("block", upto(F.col("blocks"))).select("width", "list", "block", "part", "id", "label", "v", "targets")
        right = index.rows.join(index.by_list(asked), ["width", "list"]).withColumn("part", upto(F.col("parts"))).select("width", "list", "block", "part", "id", "label", "v")
        by = ["width", "list", "block", "part"]
        hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare(k, same), "id bigint, target bigint, base bigint, other bigint, score bigint")
        hits = hits if found is None else hits.unionByName(found.drop("rank"))
        old, found = found, staged(hits.withColumn("rank", rank).where(F.col("rank") <= k), "hits")
        drop_staged(visits, asked, *([old] if old is not None else []))
        start, end = end, end * FACTOR
        if start < index.most:
            full = found.where(F.col("rank") == k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("target", "base"), "score"))).alias("full"))
            told = F.transform("targets", lambda t: t.withField("least", F.coalesce(F.try_element_at("full", F.struct(t["target"].alias("target"), t["base"].alias("base"))), t["least"])))
            now = anchors.join(full, "id", "left").withColumn("targets", told).drop("full")
    return found


def mine(
    df: DataFrame,
    every: int = 100,
    vec_col: str = "embedding",
    key: str = "vec_id",
    label_col: str = "label",
    scale: float = 256,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become integers floor(scale * x); a score is the integer inner product with the anchor, higher ones come first, ties by
    smaller key. Anchors are the rows whose key is divisible by ``every``. An anchor's positives are its first rows of the same label, other than itself; for each, its negatives are the first rows of other labels with
    low * positive <= 100 * negative <= high * positive. Fewer are returned where there are no more.

    Rows with a null key, label or vector, an empty vector, or a null or non-finite component take no part, nor do rows longer than 2**31
    after scaling, whose scores 64 bits might not hold. Vectors of different widths have no score. Keys are expected to differ: rows that share an
    anchor's key are one anchor (the first by vector), and none of them is its positive; positives that share a key and a
    score are one. An empty table gives no rows; other columns are not read.
    """
    vectors = staged(_vectors(df, key, vec_col, label_col, scale), "vectors")
    index = Index(vectors)
    first = vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("label", "width", "v")).alias("x")).select("id", "x.*")
    target = lambda t, base, lo, hi: F.struct(t.cast("bigint").alias("target"), base.cast("bigint").alias("base"), lo.cast("bigint").alias("low"), hi.cast("bigint").alias("high"), lo.cast("bigint").alias("least"))
    anchors = staged(first.withColumn("targets", F.array(target(F.lit(0), F.lit(0), F.lit(_LOW), F.lit(_HIGH)))), "anchors")
    near = search(anchors, index, positives, True)
    # 100 * negative within [low * p, high * p], in whole numbers
    p = F.col("score").cast("decimal(38,0)")
    lowest, highest = F.ceil(p * low / 100), F.floor(p * high / 100)
    windows = near.select("id", target(F.col("other"), F.col("score"), lowest, highest).alias("t")).where("t.low <= t.high").groupBy("id").agg(F.collect_set("t").alias("targets"))
    asked = staged(anchors.drop("targets").join(windows, "id"), "anchors")
    found = search(asked, index, negatives, False)
    drop_staged(vectors, index.listed, index.sizes, anchors, near, asked)
    return found.select(
        F.col("id").alias("anchor_id"), F.col("target").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("base").alias("positive_score"), F.col("score").alias("negative_score")
    )
