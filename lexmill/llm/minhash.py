"""MinHash near-dedup by a signature-coordinate inverted join.

Documents with equal shingle sets are one class. A class is posted under its (coordinate, value) keys. Two
sets of similarity 0.8 share at least MATCHES of COORDINATES keys but for a chance of 2.2e-5, so they
meet under one of each other's COORDINATES - MATCHES + 1 rarest keys (prefix); longer lists are skipped and
count only in the comparison of whole signatures. What passes that is confirmed on whole shingle sets.

Under each key, classes are first compared with one pivot and merged, so a group of n near copies costs about
n comparisons. Then the classes of a key that are still in different components are dealt into blocks of
bounded size. A first pass over the blocks compares one byte of each coordinate, shortest set first, and keeps
the classes that have a partner of MATCHES; these bring their whole shingle sets to the same blocks, which
confirm the pairs and hand on a spanning forest of the links found. No pair ever leaves a task, only classes and
edges of forests do, and no link that joins two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import components, drop_staged, small_batches, staged

COORDINATES, MATCHES = 40, 21
#: Ids up to this number are broadcast (16 bytes each) to pick texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Classes and shingles of a key in one block at most (about), and bytes of rows compared in one go.
BLOCK, BLOCK_SHINGLES, HELD = 1024, 1 << 21, 32 << 20
#: Shingles of the partners of one class that are looked up at once.
LOOKED_UP = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RANDOM = np.random.default_rng(20240101)
_FACTORS = _RANDOM.integers(0, 1 << 32, (COORDINATES, 1), np.uint32) | np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, (COORDINATES, 1), np.uint32)
_NAMES = _RANDOM.integers(0, 1 << 64, COORDINATES, np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, hashes: dict, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of fewer words, one of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """One key for each coordinate: the shingle its 32-bit hash function puts first, whole, mixed with the coordinate's name."""
    half, first, least = (s >> np.uint64(32)).astype(np.uint32), None, None
    for k in range(0, len(s), 4096):
        h = half[k : k + 4096] * _FACTORS
        h += _SHIFTS
        at = h.argmin(1)
        value, shingle = h[np.arange(COORDINATES), at], s[k + at]
        if first is None:
            least, first = value, shingle
        else:
            first = np.where(value < least, shingle, first)
            least = np.minimum(value, least)
    return _mixed(first ^ _NAMES).view(np.int64)


def _signatures(df: DataFrame, key: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            sizes, same, keys = [], [], []
            for t in batch.column("__text"):
                s = shingle_set(t.as_py(), hashes, width)
                sizes.append(len(s))
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(signature(s) if len(s) else None)
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum([0 if k is None else COORDINATES for k in keys])]).astype(np.int32)
            out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            out.append(pa.array([None if k is None else k.astype(np.uint8).tobytes() for k in keys], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["id", "n", "same", "keys", "sig"])

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text_col).alias("__text")).mapInArrow(run, "id bigint, n bigint, same binary, keys array<bigint>, sig binary")


def _sets(df: DataFrame, key: str, text_col: str, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) for the wanted ids; shingles are packed sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            packed = [shingle_set(t.as_py(), hashes, width).tobytes() for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "shingles"])

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text_col).alias("__text")).join(ids, "id", "left_semi").mapInArrow(run, "id bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those with 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def _alike(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, u, v), those whose signatures agree in MATCHES coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_bytes(batch.column("u")) == _bytes(batch.column("v"))).sum(1) >= MATCHES
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "u", "v").mapInArrow(run, "a bigint, b bigint")


def block_suspects(t: pa.Table, percent: int) -> np.ndarray:
    """Which rows have a partner in their cell, but not in their component, with MATCHES equal coordinates and a size that ``percent`` allows.

    Rows are sorted by cell and size; a row meets those after it while sizes allow. Rows on one side (0 or 1)
    of a cell do not meet, those of side 2 all do.
    """
    cell, n, c, side = (t[x].to_numpy() for x in ("cell", "n", "c", "side"))
    sig, size = _bytes(t["sig"].combine_chunks()), len(cell)
    found, i, d = np.zeros(size, bool), np.arange(size), 0
    while len(i):
        d += 1
        i = i[: np.searchsorted(i, size - d)]
        i = i[(cell[i + d] == cell[i]) & (percent * n[i + d] <= 100 * n[i])]
        p = i[(c[i + d] != c[i]) & ((side[i] == 2) | (side[i + d] != side[i]))]
        p = p[(sig[p] == sig[p + d]).sum(1) >= MATCHES]
        found[p] = found[p + d] = True
    return found


def cell_links(t: pa.Table, percent: int) -> list[tuple[int, int]]:
    """(row, row) of one cell, sorted by size: links on whole sets that, with the components there are, join all that the cell's links join."""
    n, side, label = t["n"].to_numpy(), t["side"].to_numpy(), t["c"].to_numpy().copy()
    sig, packed = _bytes(t["sig"].combine_chunks()), t["shingles"].to_pylist()
    ends = np.cumsum(n)
    starts = ends - n
    known, code = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
    mine, out = np.zeros(len(known), bool), []
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, 100 * int(n[i]) // percent, "right"))
        others = np.arange(i + 1, end)
        others = others[(label[others] != label[i]) & ((side[i] == 2) | (side[others] != side[i]))]
        others = others[(sig[others] == sig[i]).sum(1) >= MATCHES]
        if not len(others):
            continue
        own = code[starts[i] : ends[i]]
        mine[own] = True
        for some in np.split(others, np.flatnonzero(np.diff(np.cumsum(n[others]) // LOOKED_UP)) + 1):
            upto = np.cumsum(n[some])
            at = np.arange(upto[-1]) + np.repeat(starts[some] - upto + n[some], n[some])
            common = np.add.reduceat(mine[code[at]], upto - n[some], dtype=np.int64)
            for j in some[100 * common >= percent * (n[i] + n[some] - common)]:
                if label[j] != label[i]:
                    out.append((i, int(j)))
                    label[label == label[j]] = label[i]
        mine[own] = False
    return out


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (k, id, n, ...) with cell and side: the rows of a key in one cell or, beyond a block, in a cell for each two of its blocks."""
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    large = staged(rows.groupBy("k").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = rows.join(large, "k", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    first, second = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumns({"cell": F.xxhash64("k", first, second), "side": side})


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, in tables of about HELD bytes none of which ends inside a cell."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD:
            t = pa.Table.from_batches(held).combine_chunks()
            cell = t["cell"].to_numpy()
            end = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if end:
                yield t.slice(0, end)
            held = t.slice(end).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _suspects(rows: DataFrame, percent: int) -> DataFrame:
    """Of the rows (k, id, n, c, sig), dealt into cells, those that have a candidate partner there: (cell, side, id, n, c, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            yield from t.filter(pa.array(block_suspects(t, percent))).to_batches()

    cells = _dealt(rows).select("cell", "side", "id", "n", "c", "sig").repartition("cell").sortWithinPartitions("cell", "n", "id")
    return cells.mapInArrow(run, cells.schema)


def _cell_forests(suspects: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of the cells, a spanning forest of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            cell, ids, found = t["cell"].to_numpy(), t["id"].to_numpy(), []
            ends = [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for start, end in zip([0, *ends], ends, strict=False):
                found += [(ids[start + i], ids[start + j]) for i, j in cell_links(t.slice(start, end - start), percent)]
            edges = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges.min(1)), pa.array(edges.max(1))], ["a", "b"])

    cells = suspects.join(sets, "id").select("cell", "side", "id", "n", "c", "sig", "shingles").repartition("cell").sortWithinPartitions("cell", "n", "id")
    return cells.mapInArrow(run, "a bigint, b bigint").distinct()


def _links(df: DataFrame, key: str, text_col: str, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links (a, b) whose components are those of all pairs of classes at ``percent`` or more."""
    posted = classes.select("id", F.explode("keys").alias("k"))
    lists = posted.groupBy("k").agg(F.count("*").alias("df")).where("df > 1")
    shared = posted.join(lists, "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "k"))).alias("ks")).where(F.size("ks") >= MATCHES)
    # keys that no other class has are the rarest of all: they fill the prefix first, and need no list
    slots = F.greatest(F.lit(0), F.size("ks") - (MATCHES - 1))
    prefix = shared.select("id", F.explode(F.transform(F.slice("ks", F.lit(1), slots), lambda x: x["k"])).alias("k"))
    lists = staged(prefix, "lists")
    if lists.isEmpty():
        return None
    sizes = classes.select("id", "n", "sig")

    def whole(ids: DataFrame) -> DataFrame:
        """The shingle sets of the classes in ``ids``; only their texts are read."""
        return _sets(df, key, text_col, staged(ids.distinct(), "ids"), width)

    # each class meets the smallest id of each of its keys
    pivots = lists.groupBy("k").agg(F.min("id").alias("a"))
    met = lists.join(pivots, "k").where("a < id").select("a", F.col("id").alias("b")).distinct()
    met = met.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("sig").alias("u")), "a")
    met = met.join(sizes.select(F.col("id").alias("b"), F.col("n").alias("o"), F.col("sig").alias("v")), "b")
    pairs = staged(_alike(met.where(100 * F.least("m", "o") >= percent * F.greatest("m", "o"))), "pairs")
    edges = staged(_confirmed(pairs, whole(pairs.select(F.explode(F.array("a", "b")).alias("id"))), percent), "links")
    drop_staged(pairs)
    # then those of each key that are not yet in one component meet each other
    now = lists.withColumn("component_id", F.lit(None).cast("bigint")) if edges.isEmpty() else lists.join(staged(components(edges), "labels"), "id", "left")
    now = now.withColumn("c", F.coalesce("component_id", "id")).select("k", "id", "c")
    open_ = now.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("k")
    rows = staged(now.join(open_, "k", "left_semi").join(sizes, "id"), "open")
    drop_staged(lists)
    suspects = staged(_suspects(rows, percent), "suspects")
    drop_staged(rows)
    if not suspects.isEmpty():
        edges = edges.unionByName(staged(_cell_forests(suspects, whole(suspects.select("id")), percent), "links"))
    drop_staged(suspects)
    return edges


def near_duplicates(df: DataFrame, text_col: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``key``, n_shingles, component_id (smallest key reachable), kept (key is it).

    Words are runs of characters other than space and U+0009 to U+000D, with A-Z lower-cased; a document's
    set holds its distinct ``width``-word shingles, or its whole sequence if shorter. Null, empty and blank
    texts have an empty set and link with nothing, nor do rows with a null key. Texts are read whole. Rows
    with one key and different texts are compared each; their links hold for the key. An empty table gives no rows.
    ``percent`` below 80 would need another MATCHES and is refused.
    """
    if percent < 80:
        raise ValueError("signatures are laid out for 80 percent or more")
    small_batches(df.sparkSession)
    docs = staged(_signatures(df, key, text_col, width), "signatures")
    classes = docs.where("same is not null and id is not null").groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = staged(classes.select("same", "id", "n", "keys", "sig"), "classes")
    edges = _links(df, key, text_col, classes, width, percent)
    found = components(edges) if edges is not None else None
    ids = docs.select("id", "n", "same").join(classes.select("same", F.col("id").alias("first")), "same", "left")
    # rows that share a key but not a text tie their classes together
    if docs.where("same is not null and id is not null").groupBy("id").agg(F.min("same").alias("s"), F.max("same").alias("t")).where("s <> t").isEmpty() is False:
        ties = ids.where("first is not null").select(F.col("id").alias("a"), F.col("first").alias("b"))
        found = components(ties.unionByName(edges) if edges is not None else ties)
        label = F.coalesce("component_id", "id")
        out = ids.join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").drop("of")
    else:
        label = F.coalesce("component_id", "first", "id")
        if found is None:
            out = ids.withColumn("component_id", F.lit(None).cast("bigint"))
        else:
            # by class, then by row: a class of many copies meets its component once
            named = classes.select("same", F.col("id").alias("first")).join(found.withColumnRenamed("id", "first"), "first", "left")
            out = docs.select("id", "n", "same").join(named, "same", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("id") == label, F.lit(True)).alias("kept"))


