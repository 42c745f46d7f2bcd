"""Ranked lexical search over a clustered index whose documents are reordered by recursive graph bisection.

Documents and terms are a bipartite graph. Bisection halves the documents so that terms gather on one side (each
move is rated by the change of the logarithmic gap cost of its terms), then halves the halves. The tree of halves is fitted on a bounded sample;
every document, sampled or not, then goes down the tree by the same cost of its terms against those of the two
sides, so the whole collection is reordered in one pass. The leaves, cut to bounded sizes, are the shards of the index.

A shard holds, for each term, postings (place, impact) and the highest impact. The sum of these over an item's terms bounds every score in
the shard. An item visits shards in the order of their bounds, in rounds of growing numbers, and stops when the next bound falls strictly
below its k-th best score; at that score a shard is still visited, since a smaller doc_id may be there. Results are exact:
the sample decides only how many shards can be left out. Places are mapped back to doc_id before ties are broken.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import drop_staged, small_batches, staged

#: Documents by which the bisection is fitted (by hash of the id), and the terms it looks at: the most frequent of the sample.
SAMPLE, MAX_TERMS = 4096, 8192
#: Terms of a sampled document that count in the fit, at most.
DOC_TERMS = 1024
#: Levels of the tree at most; documents of a leaf that are aimed at, documents of a shard at most (about).
MAX_DEPTH, LEAF, SHARD = 8, 1024, 2048
#: Swapping rounds at each level.
SWAPS = 12
#: Terms of a vocabulary that tasks hold in memory; beyond it the index holds all terms.
MAX_VOCABULARY = 1 << 20
#: Items that meet a shard in one group; shards that an item visits in the first round, and the growth of that number.
ITEM_BLOCK, FIRST_VISITS, FACTOR = 1024, 4, 8
#: Fixed values of the ranking: k1 and b as 8/1000 of m and 90 of 100.
WEIGHT, SCALE, TF, LENGTH, B = 1000, 1_000_000_000, 1000, 8, 90

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TO_TERMS = bytes.maketrans(_SEPARATORS + string.ascii_uppercase.encode(), b" " * len(_SEPARATORS) + string.ascii_lowercase.encode())


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters from U+0080 on, A-Z lower-cased, in UTF-8."""
    return (text or b"").translate(_TO_TERMS).split(b" ") if text else []


def counted(text: bytes | None) -> Counter[bytes]:
    found = Counter(terms(text))
    found.pop(b"", None)
    return found


# bisection ----------------------------------------------------------------------------------------------------------


def _cost(degree: np.ndarray, size: np.ndarray | float) -> np.ndarray:
    """Bits, about, of a term's gaps in a half of ``size`` documents of which ``degree`` have it."""
    return degree * np.log2(size / (degree + 1.0))


class Bisection:
    """A tree of halves: for each inner node (1, 2, 3, ... as in a heap) and term, by how much the left half is the cheaper place, and the least sum that goes left."""

    def __init__(self, vocabulary: list[bytes], depth: int, gain: np.ndarray, least: np.ndarray):
        self.places, self.depth, self.gain, self.least = {t: i for i, t in enumerate(vocabulary)}, depth, gain, least

    def leaves(self, docs: list[list[bytes]]) -> np.ndarray:
        """The leaf, from 0 in the tree's order, that each document comes to."""
        flat = [self.places.get(t, -1) for d in docs for t in d]
        term, doc = np.array(flat, np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        doc, term = doc[term >= 0], term[term >= 0]
        node = np.ones(len(docs), np.int64)
        for _ in range(self.depth):
            sums = np.bincount(doc, self.gain[node[doc], term], minlength=len(docs))
            node = 2 * node + (sums < self.least[node])
        return node - (1 << self.depth)


def bisect(docs: list[list[bytes]], depth: int) -> Bisection:
    """Recursive graph bisection of the sampled documents: at each level, pairs of documents swap sides while that lowers the cost."""
    often = Counter(t for d in docs for t in d)
    vocabulary = [t for t, n in sorted(often.items(), key=lambda x: (-x[1], x[0])) if n > 1][:MAX_TERMS]
    places, width, n = {t: i for i, t in enumerate(vocabulary)}, max(1, len(vocabulary)), len(docs)
    edges = [(i, places[t]) for i, d in enumerate(docs) for t in d if t in places]
    doc, term = np.array(edges, np.int64).reshape(-1, 2).T
    gain, least = np.zeros((1 << depth, width), np.float32), np.full(1 << depth, -np.inf)
    node = np.ones(n, np.int64)
    for level in range(depth):
        first = 1 << level
        # start from a split of each node by the documents' order
        order = np.argsort(node, kind="stable")
        start = np.searchsorted(node[order], node[order])
        size = np.bincount(node - first, minlength=first)
        right = np.empty(n, bool)
        right[order] = np.arange(n) - start >= (size[node[order] - first] + 1) // 2
        for swap in range(SWAPS + 1):
            own = node - first
            degrees = [np.bincount(own[doc[s]] * width + term[s], minlength=first * width).reshape(first, width) for s in (~right[doc], right[doc])]
            sizes = [np.maximum(np.bincount(own[s], minlength=first), 1)[:, None] for s in (~right, right)]
            # of a document in the left half: what its terms cost less in the right one, and the other way round
            to = []
            for a, b, x, y in ((0, 1, degrees[0], degrees[1]), (1, 0, degrees[1], degrees[0])):
                to.append(_cost(x, sizes[a]) + _cost(y, sizes[b]) - _cost(np.maximum(x - 1, 0), sizes[a]) - _cost(y + 1, sizes[b]))
            if swap == SWAPS:
                break
            moves = np.bincount(doc, np.where(right[doc], to[1][own[doc], term], to[0][own[doc], term]), minlength=n)
            ranked = np.lexsort((-moves, right, node))
            half = 2 * own[ranked] + right[ranked]
            place = np.arange(n) - np.searchsorted(half, half)
            best = np.full((2 * first, n and int(np.bincount(half, minlength=1).max())), -np.inf)
            best[half, place] = moves[ranked]
            both = best[0::2] + best[1::2]
            swapped = (both[half // 2, place] > 1e-9) & np.isfinite(both[half // 2, place])
            if not swapped.any():
                break
            right[ranked[swapped]] ^= True
        # where would a document outside the sample cost less
        left_cost = _cost(degrees[0] + 1, sizes[0]) - _cost(degrees[0], sizes[0])
        right_cost = _cost(degrees[1] + 1, sizes[1]) - _cost(degrees[1], sizes[1])
        gain[first : 2 * first] = right_cost - left_cost
        sums = np.bincount(doc, gain[node[doc], term], minlength=n) if len(doc) else np.zeros(n)
        for k in range(first, 2 * first):
            inside = np.sort(sums[node == k])
            if len(inside):
                least[k] = inside[len(inside) // 2]
        node = 2 * node + (sums < least[node])
    return Bisection(vocabulary, depth, gain, least)


# index --------------------------------------------------------------------------------------------------------------


def _counted_docs(df: DataFrame, key: str, text_col: str, vocabulary: frozenset[bytes] | None) -> DataFrame:
    """(id, n, terms, tfs): all terms of each document counted, those of the vocabulary listed."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            sizes, listed, tfs, ends = [], [], [], [0]
            for text in batch.column("text").cast(pa.binary()):
                own = counted(text.as_py())
                sizes.append(own.total())
                inside = own if wanted is None else own.keys() & wanted
                listed += inside
                tfs += [own[t] for t in inside]
                ends.append(len(listed))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((listed, pa.binary()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    d = df.select(F.col(key).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return d.mapInArrow(run, "id bigint, n bigint, terms array<binary>, tfs array<bigint>")


def _leaves(docs: DataFrame, tree: Bisection) -> DataFrame:
    """``docs`` with their leaves."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaves(batch.column("terms").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves.astype(np.int32))], [*batch.schema.names, "leaf"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms array<binary>, tfs array<bigint>, leaf int")


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """A posting's share of the score, without the term's weight."""
    n = n.astype(object) if len(n) and B * int(n.max()) * docs >= 1 << 63 else n
    m = (100 - B + (B * n * docs) // max(total, 1)).astype(np.int64)
    return (SCALE * tf) // (TF * tf + LENGTH * m)


def _inverted(docs: int, total: int):
    """A shard's documents as postings of each term."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("leaf", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, lists = t["id"].to_numpy(), t["terms"].combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        place = np.repeat(np.arange(len(ids)), lengths)
        q = impacts(t["tfs"].combine_chunks().flatten().to_numpy(), t["n"].to_numpy()[place], docs, total)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
        parts = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)) if len(ends) else []
        place, q = place[order].astype("<i4"), q[order].astype("<i4")
        columns = [
            pa.array(np.full(len(parts), t["shard"][0].as_py()), pa.int64()), coded.dictionary, pa.array([q[a:b].max() for a, b in parts], pa.int64()),
            pa.array([ids[place[a:b]].astype("<i8").tobytes() for a, b in parts], pa.binary()), pa.array([q[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([b - a for a, b in parts], pa.int64()),
        ]
        return pa.table(columns, names=["shard", "term", "top", "docs", "impacts", "df"])

    return run


class Index:
    """``postings``: (shard, term, top, docs, impacts, df), staged. ``docs`` are the documents in their new order, packed, ``impacts`` theirs."""

    def __init__(self, df: DataFrame, text_col: str = "text", key: str = "doc_id", vocabulary: frozenset[bytes] | None = None):
        small_batches(df.sparkSession)
        docs = staged(_counted_docs(df, key, text_col, vocabulary), "counted")
        self.docs, total = docs.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = docs.where(F.size("terms") > 0)
        depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(self.docs, 1) / LEAF))))
        share = min(1.0, 2 * SAMPLE / max(self.docs, 1))
        hashed = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20))
        rows = held.where(hashed < math.ceil(share * (1 << 20))).orderBy(hashed, "id").limit(SAMPLE).select(F.slice("terms", 1, DOC_TERMS).alias("t")).collect() if depth else []
        tree = bisect([[bytes(x) for x in r["t"]] for r in rows], depth)
        placed = staged(_leaves(held, tree), "leaves")
        # at most 2 ** MAX_DEPTH leaves; one that holds a large share of all documents is cut into shards of bounded size
        sizes = placed.groupBy("leaf").agg(F.greatest(F.lit(1), F.ceil(F.greatest(F.count("*") / SHARD, F.sum(F.size("terms")) / (SHARD * 1024)))).cast("bigint").alias("parts"))
        shards = placed.join(F.broadcast(sizes), "leaf").withColumn("shard", F.col("leaf") * F.lit(1 << 40) + F.pmod(F.xxhash64("id", F.lit(13)), "parts"))
        inverted = shards.groupBy("shard").applyInArrow(_inverted(self.docs, total), "shard bigint, term binary, top bigint, docs binary, impacts binary, df bigint")
        self.postings = staged(inverted, "postings")
        drop_staged(docs, placed)


# search -------------------------------------------------------------------------------------------------------------


def item_terms(items: DataFrame, key: str, text_col: str) -> DataFrame:
    """(item, term), each term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t) for k, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()), strict=True) for t in counted(text.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item", "term"])

    d = items.select(F.col(key).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    return d.mapInArrow(run, "item bigint, term binary").distinct()


def _scored(k: int):
    """The k best documents of a shard for each item of the group."""

    def run(asked: pa.Table, postings: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        held = {t: (np.frombuffer(d, "<i8"), np.frombuffer(q, "<i4")) for t, d, q in zip(*(postings[c].to_pylist() for c in ("term", "docs", "impacts")), strict=True)}
        for item, query in zip(*(asked[c].to_pylist() for c in ("item", "query")), strict=True):
            own = [(held[t["term"]], t["weight"]) for t in query if t["term"] in held]
            if not own:
                continue
            ids, at = np.unique(np.concatenate([d for (d, _), _ in own]), return_inverse=True)
            score = np.zeros(len(ids), np.int64)
            np.add.at(score, at, np.concatenate([q.astype(np.int64) * w for (_, q), w in own]))
            best = np.lexsort((ids, -score))[:k]
            for column, new in zip(found, (np.full(len(best), item, np.int64), ids[best], score[best]), strict=True):
                column.append(new)
        return pa.table([np.concatenate(c) if c else np.zeros(0, np.int64) for c in found], names=["item", "id", "score"])

    return run


def rank(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the k documents with the highest scores above 0 for each item, equal scores by ascending id."""
    spark = items.sparkSession
    wanted = staged(item_terms(items, key, text_col), "terms")
    # per shard first, so that a term is one number a shard
    df = index.postings.groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(WEIGHT * F.ln((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    asked = staged(wanted.join(df.withColumn("weight", weight), "term").where("weight > 0").select("item", "term", "weight"), "asked")
    tops = asked.join(index.postings.select("shard", "term", "top"), "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound")).where("bound > 0")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    tops = staged(tops.withColumn("place", F.row_number().over(order)), "bounds")
    most = tops.agg(F.max("place")).first()[0] or 0
    queries = asked.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("query"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    found, start, end = None, 0, FIRST_VISITS
    while start < most:
        now = tops.where((F.col("place") > start) & (F.col("place") <= end))
        if found is not None:
            # bounds fall along the order, so all shards from the first one strictly below the k-th score on are left out
            now = now.join(found.where(F.col("rank") == k).select("item", F.col("score").alias("least")), "item", "left").where("least is null or bound >= least")
        visits = staged(now.join(queries, "item").select("item", "shard", "query"), "visits")
        blocks = staged(visits.groupBy("shard").agg(F.ceil(F.count("*") / ITEM_BLOCK).cast("int").alias("blocks")), "blocks")
        left = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("item"), "blocks").cast("int")).select("shard", "block", "item", "query")
        terms_ = visits.select("shard", F.explode("query.term").alias("term")).distinct()
        right = index.postings.select("shard", "term", "docs", "impacts").join(terms_, ["shard", "term"], "left_semi").join(blocks, "shard")
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("shard", "block", "term", "docs", "impacts")
        hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_scored(k), "item bigint, id bigint, score bigint")
        hits = hits if found is None else hits.unionByName(found.drop("rank"))
        old, found = found, staged(hits.where("score > 0").withColumn("rank", best).where(F.col("rank") <= k), "hits")
        drop_staged(visits, blocks, *([old] if old is not None else []))
        start, end = end, end * FACTOR
    drop_staged(wanted, asked, tops)
    return found if found is not None else spark.createDataFrame([], "item bigint, id bigint, score bigint, rank int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents for each item.

    Only the terms that some item has are indexed, unless these are more than MAX_VOCABULARY; numbers and lengths count all terms of whole
    texts. Null texts have no terms; an item without terms, or whose terms no document holds, has no rows. Rows with a null key are not
    found and not counted, items with a null key not asked. Rows that share a key are documents of their own to the counts, and score together where
    they share a shard; keys are expected to differ. Items that share a key are one item with the terms of all. Empty tables give no rows; other columns are not read.
    """
    wanted = staged(item_terms(items, item_key, text_col).select("term").distinct(), "vocabulary")
    vocabulary = frozenset(bytes(r["term"]) for r in wanted.collect()) if wanted.count() <= MAX_VOCABULARY else None
    index = Index(docs, text_col, key, vocabulary)
    found = rank(index, items, k, item_key, text_col)
    drop_staged(index.postings, wanted)
    return found.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
