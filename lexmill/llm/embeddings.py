"""Embedding near-dedup by an inverted multi-index.

Each half of a vector has a codebook of its own; their product is a grid of cells. A vector visits cells in
the order of their distance (multi-sequence traversal) until the target recall, as measured on a sample and on
made-up neighbours at the threshold, and is compared there with the vectors of those cells, in double
precision. Visits go one way only, to the own cell and to cells of lower numbers, so each pair meets once.

Inside a cell, members and visitors are dealt into blocks of bounded size which are multiplied as matrices;
a block returns a count for each vector and the edges of a spanning forest, never its pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import components, staged

#: Vectors by which codebooks are fitted and the traversal is set.
SAMPLE = 8192
#: Of these, so many are compared with all vectors to measure recall.
PROBES = 128
#: Vectors in a cell on average, and in a block at most (about).
CELL, BLOCK = 512, 1024
MAX_CODES = 512
TARGET_RECALL = 0.995
MAX_DIMENSIONS = 64
SEED = 20240101


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids by Lloyd's method; empty ones are moved to the worst served points."""
    rng = np.random.default_rng(SEED)
    c = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        d = ((points**2).sum(1)[:, None] - 2 * points @ c.T) + (c**2).sum(1)
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, points)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = points[np.argsort(-d.min(1))[: (n == 0).sum()]][: (n == 0).sum()]
    return c


def distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of the halves of each vector to the codes of its codebook."""
    h = x.shape[1] // 2
    return tuple(np.maximum((p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1), 0) for p, c in zip((x[:, :h], x[:, h:]), books, strict=True))


def multi_sequence(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` nearest cells (i * k + j) of one vector in the order of d1[i] + d2[j]."""
    a, b, k = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    out, heap, seen = [], [(d1[a[0]] + d2[b[0]], 0, 0)], {(0, 0)}
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * k + int(b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < k and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (d1[a[p]] + d2[b[q]], p, q))
    return out


def place_in_traversal(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cells x[n] visits until it reaches the cell of y[n]."""
    (d1, d2), (e1, e2) = distances(x, books), distances(y, books)
    i, j = e1.argmin(1), e2.argmin(1)
    out = np.empty(len(x), np.int64)
    for n in range(len(x)):
        out[n] = (d1[n][:, None] + d2[n][None, :] <= d1[n, i[n]] + d2[n, j[n]]).sum()
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _unit_vectors(df: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(id, width, v): vectors scaled to length 1, packed doubles; null for those that link with nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            packed, widths = [], []
            for x in batch.column("v").to_pylist():
                a = np.array([math.nan if c is None else c for c in x or ()], float)
                top = np.abs(a).max() if len(a) and np.isfinite(a).all() else 0
                a = a / top if top else a  # lengths of very large or small vectors stay finite
                packed.append((a / np.sqrt((a * a).sum())).tobytes() if top else None)
                widths.append(len(a) if top else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(widths, pa.int64()), pa.array(packed, pa.binary())], ["id", "width", "v"])

    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return d.mapInArrow(run, "id bigint, width bigint, v binary")


def fit(vectors: DataFrame, width: int, n: int, threshold: float, target: float = TARGET_RECALL) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Codebooks and the number of cells to visit, from a bounded sample of ``vectors`` (id, v) by hash of the id."""
    rows = vectors.select("v", F.xxhash64("id").alias("o"), "id").orderBy("o", "id").limit(SAMPLE).collect()
    sample = np.frombuffer(b"".join(r["v"] for r in rows), np.float64).reshape(-1, width)
    k = max(1, min(MAX_CODES, math.ceil(math.sqrt(n / CELL)), len(sample)))
    h = width // 2
    books = codebook(sample[:, :h], k), codebook(sample[:, h:], k)
    # neighbours exactly at the threshold, in random directions, are the hardest to reach
    rng = np.random.default_rng(SEED)
    x = sample[:2048]
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    length = np.sqrt((away**2).sum(1))
    x, away = x[length > 0], away[length > 0] / length[length > 0, None]
    made = place_in_traversal(x, threshold * x + math.sqrt(max(0, 1 - threshold**2)) * away, books)
    visits = int(np.quantile(made, target, method="higher")) if len(made) else 1
    return books, max(visits, _measured(vectors, sample[:PROBES], books, threshold, target))


def _measured(vectors: DataFrame, probes: np.ndarray, books: tuple, threshold: float, target: float) -> int:
    """Cells to visit for the target recall of all links of the probes, found by brute force over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast((probes, books))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = shared.value
        places = np.zeros(own[0].shape[0] * own[1].shape[0] + 1, np.int64)
        for batch in it:
            y = matrix(batch.column("v"), q.shape[1])
            a, b = np.nonzero(q @ y.T >= threshold)
            if len(a):
                places += np.bincount(place_in_traversal(q[a], y[b], own), minlength=len(places))
        at = np.flatnonzero(places)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(places[at], pa.int64())], ["place", "n"])

    found = vectors.select("v").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    total, sofar = sum(r["n"] for r in found), 0
    for r in found:
        sofar += r["n"]
        if sofar >= target * total:
            return r["place"]
    return 1


def _meetings(width: int, visits: int, shared, threshold: float):
    """Counts the links between two blocks, and those whose vectors meet in the traversal."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"links": pa.array([], pa.int64()), "met": pa.array([], pa.int64())})
        x, y, met, links = matrix(left["v"].combine_chunks(), width), matrix(right["v"].combine_chunks(), width), 0, 0
        # a pair meets if the one of the higher cell visits the cell of the other
        cells = [d1.argmin(1) * d2.shape[1] + d2.argmin(1) for d1, d2 in (distances(x, shared.value), distances(y, shared.value))]
        for at in range(0, len(y), 4096):
            a, b = np.nonzero(x @ y[at : at + 4096].T >= threshold)
            b += at
            other = left["id"].to_numpy()[a] != right["id"].to_numpy()[b]
            a, b = a[other], b[other]
            if len(a):
                up = cells[0][a] >= cells[1][b]
                u, w = np.where(up[:, None], x[a], y[b]), np.where(up[:, None], y[b], x[a])
                met += int((place_in_traversal(u, w, shared.value) <= visits).sum())
                links += len(a)
        return pa.table({"links": [links], "met": [met]})

    return run


def recall(df: DataFrame, vec_col: str = "embedding", key: str = "vec_id", threshold: float = 0.9, target: float = TARGET_RECALL, every: int = 100) -> list[tuple[int, int, int, int]]:
    """(width, visits, links, of these met) for each width: the links between vectors whose key is divisible by ``every`` and all others,
    found by brute force over the whole table, and how many of them the traversal meets. Null and invalid vectors have none."""
    vectors = staged(_unit_vectors(df, key, vec_col).where("v is not null and id is not null"), "recall")
    out = []
    for width, n in [tuple(r) for r in vectors.groupBy("width").agg(F.count_distinct("v")).orderBy("width").collect()]:
        own = vectors.where(F.col("width") == width)
        books, visits = fit(own, width, n, threshold, target)
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        # queries and vectors in blocks, every block of the one with every block of the other
        blocks = max(1, math.ceil(n / 50_000))
        dealt = own.select("id", "v", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).alias("b"))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        asked = own.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", upto(blocks).alias("b"))
        asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(math.ceil(blocks / every))))
        dealt = dealt.withColumn("q", upto(math.ceil(blocks / every)))
        found = asked.groupBy("b", "q").cogroup(dealt.groupBy("b", "q")).applyInArrow(_meetings(width, visits, shared, threshold), "links bigint, met bigint")
        links, met = found.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.sum("met"), F.lit(0))).first()
        out.append((width, visits, links, met))
    return out


def _postings(vectors: DataFrame, books: tuple, width: int, visits: int) -> DataFrame:
    """(cell, role, id, mult, v): each vector once as a member (role 0) of its cell and as a visitor (role 1) of lower ones."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in it:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = matrix(batch.column("v"), width)
                d1, d2 = distances(x, own)
                home = d1.argmin(1) * d2.shape[1] + d2.argmin(1)
                row, cell = list(range(len(x))), home.tolist()
                for n in range(len(x)):
                    lower = [c for c in multi_sequence(d1[n], d2[n], visits) if c < home[n]]
                    row += [n] * len(lower)
                    cell += lower
                role = np.ones(len(row), np.int8)
                role[: len(x)] = 0
                picked = batch.take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(role, pa.int32()), picked.column("id"), picked.column("mult"), picked.column("v")], ["cell", "role", "id", "mult", "v"])

    return vectors.select("id", "mult", "v").mapInArrow(run, "cell bigint, role int, id bigint, mult bigint, v binary")


def block_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which rows of ``a`` and ``b`` link; if the two are one block, each pair once."""
    s = a @ b.T
    return np.triu(s >= threshold, 1) if same else s >= threshold


def forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, id) edges that join what the links of the block join, one for each linked vector at most."""
    a, b = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        m = np.minimum(a, np.where(mask, b[None, :], top).min(1, initial=top))
        n = np.minimum(b, np.where(mask, m[:, None], top).min(0, initial=top))
        m = np.minimum(m, np.where(mask, n[None, :], top).min(1, initial=top))
        if (m == a).all() and (n == b).all():
            break
        a, b = m, n
    x, y = np.concatenate([left, right]), np.concatenate([a, b])
    return x[x != y], y[x != y]


def _compare(postings: DataFrame, width: int, threshold: float) -> DataFrame:
    """(id, other, n): the links of id found in one block; ``other`` (null or an id) is an edge for the components."""
    # the grid is bounded, and so is this table of its cells
    sizes = postings.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("m"), F.count_if(F.col("role") == 1).alias("q"))
    sizes = sizes.where("m > 0 and m + q > 1").select("cell", F.ceil(F.col("m") / BLOCK).alias("mb"), F.ceil(F.col("q") / BLOCK).alias("qb"))
    dealt = postings.join(F.broadcast(sizes), "cell")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("role") == 0, F.col("mb")).otherwise(F.col("qb"))).cast("int")
    dealt = dealt.withColumn("own", mine)
    pair = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    own, mb, qb = F.col("own"), F.col("mb").cast("int"), F.col("qb").cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # members meet the members of every block of their cell once, and every block of its visitors
    among = F.transform(upto(mb), lambda o: pair(0, F.least(own, o), F.greatest(own, o)))
    across = F.when(qb > 0, F.transform(upto(qb), lambda o: pair(1, own, o))).otherwise(F.array().cast("array<struct<kind:int,x:int,y:int>>"))
    visiting = F.transform(upto(mb), lambda o: pair(1, o, own))
    tasks = F.when(F.col("role") == 0, F.concat(among, across)).otherwise(visiting)
    rows = dealt.select("cell", F.explode(tasks).alias("t"), "own", "role", "id", "mult", "v").select("cell", "t.kind", "t.x", "t.y", "own", "role", "id", "mult", "v")

    def run(t: pa.Table) -> pa.Table:
        kind, x, y = t["kind"][0].as_py(), t["x"][0].as_py(), t["y"][0].as_py()
        ids, mult, own_, role = (t[c].to_numpy() for c in ("id", "mult", "own", "role"))
        v = matrix(t["v"].combine_chunks(), width)
        first = (own_ == x) if kind == 0 else role == 0
        second = (own_ == y) if kind == 0 else role == 1
        same = kind == 0 and x == y
        mask = block_links(v[first], v[second], threshold, same)
        n = np.zeros(len(ids), np.int64)
        n[first] += mask @ mult[second]
        n[second] += mult[first] @ mask
        a, b = forest(mask, ids[first], ids[second])
        got = n > 0
        out_id = np.concatenate([ids[got], a])
        other = pa.array(np.concatenate([np.zeros(got.sum(), np.int64), b]), mask=np.arange(len(out_id)) < got.sum())
        return pa.table([pa.array(out_id, pa.int64()), other, pa.array(np.concatenate([n[got], np.zeros(len(a), np.int64)]), pa.int64())], ["id", "other", "n"])

    return rows.groupBy("cell", "kind", "x", "y").applyInArrow(run, "id bigint, other bigint, n bigint")


def near_duplicates(df: DataFrame, vec_col: str = "embedding", key: str = "vec_id", threshold: float = 0.9, target: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``df``: ``key``, n_links, component_id (smallest key reachable, itself included), kept.

    Null vectors, vectors of length zero and those with a null or non-finite component link with nothing, nor do
    vectors of different widths link. Equal vectors are compared once and counted each. A null key has no links.
    Rows that share a key are vectors of their own; each shows the links of all of them that come first in their classes. An empty
    table gives no rows; other columns are not read. A cosine equal to the threshold links; of equal labels the smallest key counts. Vectors
    of any width are read whole. ``recall`` measures the share of links that are found.
    """
    every = staged(_unit_vectors(df, key, vec_col), "vectors")
    valid = every.where("v is not null and id is not null")
    classes = staged(valid.groupBy("width", "v").agg(F.min("id").alias("id"), F.count("*").alias("mult")), "classes")
    widths = classes.groupBy("width").count().orderBy("width").limit(MAX_DIMENSIONS + 1).collect()
    if len(widths) > MAX_DIMENSIONS:
        raise ValueError(f"more than {MAX_DIMENSIONS} vector widths")
    found = None
    for width, n in widths:
        own = classes.where(F.col("width") == width)
        books, visits = fit(own, width, n, threshold, target)
        links = _compare(staged(_postings(own, books, width, visits), "postings"), width, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        counts, named = df.sparkSession.createDataFrame([], "id bigint, n bigint"), df.sparkSession.createDataFrame([], "id bigint, component_id bigint")
    else:
        found = staged(found, "links")
        counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
        named = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    members = every.select("id", "width", "v").join(classes.select("width", "v", F.col("id").alias("first"), "mult"), ["width", "v"], "left")
    info = classes.select(F.col("id").alias("first")).distinct().join(counts.withColumnRenamed("id", "first"), "first", "left").join(named.withColumnRenamed("id", "first"), "first", "left")
    out = members.select("id", "first", "mult").join(info, "first", "left")
    label = F.coalesce("component_id", "first", "id")
    links = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))
    return out.select(F.col("id").alias(key), links.cast("bigint").alias("n_links"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))
