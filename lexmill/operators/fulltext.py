"""A kept full-text index: positional postings by term, in segments, searched by words, phrases and nearness with BM25 ranks.

A segment holds the postings of the rows that were added together, in blocks (the places of one term in the rows of a batch), in folders by a hash of
the term and sorted by term, so a search reads the folders of its words and of these only the row groups that can hold them. Rows that change or go are named in a later segment, which
hides what earlier ones say of them; ``merge`` writes the living rows as one segment. The list of segments is a version
(``lexmill.sources.versions``): a search sees a change as a whole or not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexmill.functions.compat import let
from lexmill.functions.match import COLUMN_STEP, Word, holds, parse, phrases_of, starts, words_in
from lexmill.operators.search import B, K1, LEAST_IDF, terms, tokens
from lexmill.sources import versions

BUCKETS = 64
#: Bytes of texts whose postings are made together.
TOGETHER = 1 << 23
_POSTINGS = "term string, tf bigint, df bigint, base bigint, places binary"


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def packed(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Numbers from 0 on, of which each value holds the next ``n``, by seven bits a byte."""
    values, size = values.astype(np.uint64), np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(size.max(initial=0)):
        of = np.flatnonzero(size > k)
        out[ends[of] - size[of] + k] = ((values[of] >> np.uint64(7 * k)) & np.uint64(127)) | ((size[of] > k + 1).astype(np.uint64) << np.uint64(7))
    bounds = np.r_[0, ends[np.cumsum(n) - 1]] if len(n) else np.zeros(1)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])


def unpacked(blocks: pa.Array) -> np.ndarray:
    """The numbers of all values of ``packed``, one after the other."""
    data = np.frombuffer(b"".join(blocks.to_pylist()), np.uint8)
    first = np.flatnonzero(np.r_[True, data[:-1] < 128][: len(data)])
    if not len(first):
        return np.zeros(0, np.int64)
    nth = np.arange(len(data)) - np.repeat(first, np.diff(np.r_[first, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), first)


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, tf, df, base, places): blocks of the places of a term, over all ``columns``. A block holds rows whose texts were read together: for each place
    the row's key, less the one before it (at first ``base``), and the position; a column's first token is at its number times COLUMN_STEP."""

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().sort_by("id")
        keys = t.column("id").to_numpy()
        row, at, code, terms = tokens(pa.concat_arrays([x for c in range(len(columns)) for x in t.column(f"c{c}").chunks]))
        at, row = at + row // len(keys) * COLUMN_STEP, row % len(keys)
        # by term, row and position: rows are in order, and in each column's tokens the positions are
        order = np.argsort(code * np.int64(len(keys)) + row, kind="stable")
        code, own, at = code[order], keys[row[order]], at[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        base, tf = own[first], np.diff(np.r_[first, len(code)])
        df = np.add.reduceat(np.r_[True, (code[1:] != code[:-1]) | (own[1:] != own[:-1])].astype(np.int64), first) if len(first) else first
        steps = np.diff(own, prepend=own[:1])
        steps[first] = 0
        return pa.RecordBatch.from_arrays([terms.take(pa.array(code[first])), pa.array(tf), pa.array(df), pa.array(base), packed(np.stack([steps, at], 1).ravel(), 2 * tf)], ["term", "tf", "df", "base", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            # texts that are large together are not read together
            for s in range(0, len(batch), 2048):
                held.append(batch.slice(s, 2048))
                size += held[-1].nbytes
                if size >= TOGETHER:
                    yield blocks(held)
                    held, size = [], 0
        if sum(map(len, held)):
            yield blocks(held)

    d = rows.select(F.col(key).cast("bigint").alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(columns)))
    return d.where("id is not null").mapInArrow(run, _POSTINGS)


def _each(blocks: DataFrame, *keep: Column | str) -> DataFrame:
    """(kept columns, id, position): a row a place."""
    d = blocks.select(*keep, F.col("tf").alias("__n"), "base", "places")
    names = d.columns[:-3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, steps = batch.column("__n").to_numpy(), unpacked(batch.column("places")).reshape(-1, 2)
            sums = np.cumsum(steps[:, 0])
            # a block's first step is 0, so what is summed up before it is the sum at its first place
            own = sums + np.repeat(batch.column("base").to_numpy() - sums[np.cumsum(n) - n], n)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(own), pa.array(steps[:, 1])], [*names, "id", "position"])

    return d.mapInArrow(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.select(*names).schema) + "id bigint, position bigint")


@F.arrow_udf(LongType())
def _n_tokens(*texts: pa.Array) -> pa.Array:
    """How many terms the texts of a row have."""
    return pa.array(sum(np.bincount(tokens(t)[0], minlength=len(t)) for t in texts), pa.int64())


class Index:
    """An index kept under ``root``; ``columns`` are what is searched, ``keep`` the further columns that rows show."""

    def __init__(self, spark: SparkSession, root: str, columns: list[str], keep: list[str] = (), key: str = "id", buckets: int = BUCKETS):
        self.spark, self.root, self.columns, self.keep, self.key, self.buckets = spark, root, list(columns), list(keep), key, buckets

    # segments

    def _segments(self) -> list[dict[str, str]]:
        known = versions.versions(self.spark, self.root)
        return known[-1].extra["segments"] if known else []

    def _publish(self, segments: list[dict[str, str]], now: datetime) -> None:
        folders = {f"{kind}{i}": s[kind] for i, s in enumerate(segments) for kind in s}
        versions.publish(self.spark, self.root, folders, now, {"segments": segments})

    def _written(self, rows: DataFrame, gone: DataFrame | None) -> dict[str, str]:
        shown = [F.col(self.key).cast("bigint").alias("id"), *self.columns, *self.keep]
        size = _n_tokens(*(F.col(c).cast("string") for c in self.columns))
        entries = rows.where(F.col(self.key).isNotNull()).select(*shown, size.alias("tokens"), F.lit(False).alias("gone"))
        if gone is not None:
            entries = entries.unionByName(gone.select(F.col(self.key).cast("bigint").alias("id"), F.lit(True).alias("gone")), allowMissingColumns=True)
        kept = versions.write_folders(self.root, {"entries": entries})
        # the texts are made once: postings are those of the rows as they were written
        held = self.spark.read.parquet(f"{self.root}/{kept['entries']}").where("not gone")
        # a bucket with a term that nearly all rows have is split over several tasks, each with its own file
        found = postings(held, "id", self.columns).withColumn("bucket", _bucket(F.col("term"), self.buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "base")
        return kept | versions.write_folders(self.root, {"postings": found}, {"postings": ["bucket"]})

    def add(self, rows: DataFrame, now: datetime, gone: DataFrame | None = None) -> None:
        """A segment of new or changed rows, and of the keys of rows that are gone; the rest stays as it is. Keys differ within ``rows``."""
        self._publish([*self._segments(), self._written(rows, gone)], now)

    def merge(self, now: datetime) -> None:
        """One segment of all living rows; their postings are made of the kept texts, which are fewer rows than the postings are."""
        self._publish([self._written(self.entries().drop("segment", "tokens").withColumnRenamed("id", self.key), None)], now)

    def _table(self, path: str, kind: str) -> DataFrame:
        # postings of no rows have no files, and so no schema of their own
        return self.spark.read.schema(_POSTINGS + ", bucket int").parquet(path) if kind == "postings" else self.spark.read.parquet(path)

    def _read(self, kind: str) -> DataFrame:
        parts = [self._table(f"{self.root}/{s[kind]}", kind).withColumn("segment", F.lit(i)) for i, s in enumerate(self._segments())]
        return reduce(DataFrame.unionByName, parts)

    def entries(self) -> DataFrame:
        """The living rows as they were last added, with the number of their segment."""
        every = self._read("entries")
        if len(self._segments()) > 1:
            newest = every.groupBy("id").agg(F.max("segment").alias("segment"))
            every = every.join(newest, ["id", "segment"], "left_semi")
        return every.where("not gone").drop("gone")

    def term_totals(self) -> DataFrame:
        """(term, tf, df) over the living rows."""
        places = self._read("postings")
        if len(self._segments()) > 1:
            living = _each(places, "term", "segment").join(self.entries().select("id", "segment"), ["id", "segment"], "left_semi")
            places = living.groupBy("term", "id").agg(F.count("*").alias("tf"), F.lit(1).cast("bigint").alias("df"))
        return places.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))

    # search

    def places(self, words: list[Word]) -> DataFrame:
        """(id, segment, w0, w1, ...): where each word stands, for the rows that have one of them. Reads the folders and terms of the words only."""
        whole = [w.text for w in words if not w.prefix]
        is_word = [F.startswith("term", F.lit(w.text)) if w.prefix else F.col("term") == w.text for w in words]
        found = self._read("postings").where(reduce(Column.__or__, is_word, F.lit(False)))
        if len(whole) == len(words):
            asked = self.spark.range(1).select(*(_bucket(F.lit(w), self.buckets).alias(f"b{i}") for i, w in enumerate(whole)))
            found = found.where(F.col("bucket").isin(*sorted(set(asked.first()))) if whole else F.lit(False))
        of = [F.array_sort(F.collect_list(F.when(F.col(f"is{i}"), F.col("position")))).alias(f"w{i}") for i in range(len(words))]
        return _each(found, "segment", *(c.alias(f"is{i}") for i, c in enumerate(is_word))).groupBy("id", "segment").agg(*of)

    def search(self, query: str, k: int = 20, only: Column | None = None, size: int = 64, lead: int = 8) -> DataFrame:
        """(id, kept columns, all searched ones but the first, snippet of that, rank): the ``k`` best rows that match, best first; lower ranks are better, equal ones go by id.

        Numbers of rows and lengths are those of all living rows, whatever ``only`` (a condition on kept columns) leaves out. A phrase
        counts with its places in all columns, also one that stands in NEAR or behind NOT. A query without words finds nothing.
        """
        wanted = parse(query)
        words, phrases = words_in(wanted), list(dict.fromkeys(phrases_of(wanted)))
        living = self.entries()
        held = self.places(words).join(living.select("id", "segment", "tokens"), ["id", "segment"])
        numbers = {c: i for i, c in enumerate(self.columns)}
        begins = {p: starts(p, {w: F.col(f"w{i}") for i, w in enumerate(words)}, numbers) for p in phrases}
        held = held.select("id", "tokens", *(b.alias(f"p{i}") for i, b in enumerate(begins.values())))
        begins = {p: F.col(f"p{i}") for i, p in enumerate(phrases)}
        about = living.agg(F.count("*").alias("rows"), F.avg("tokens").alias("mean"))
        # one row each
        counts = held.agg(*(F.count_if(F.size(b) > 0).alias(f"n{i}") for i, b in enumerate(begins.values())))
        d = held.where(holds(wanted, begins)).join(F.broadcast(about)).join(F.broadcast(counts))
        score = F.lit(0.0)
        for i, p in enumerate(phrases):
            f, n = F.size(begins[p]), F.col(f"n{i}")
            idf = F.greatest(F.ln((F.col("rows") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
            score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("tokens") / F.col("mean")))
        first = F.array_min(F.flatten(F.array(*(F.filter(b, lambda x: x < F.lit(COLUMN_STEP)) for b in begins.values()))))
        d = d.select("id", (-score).alias("rank"), first.alias("first"))
        shown = living.select("id", *self.keep, *self.columns)
        if only is not None:
            d = d.join(living.where(only).select("id"), "id", "left_semi")
        best = d.orderBy("rank", "id").limit(k)  # k rows, whose texts are then fetched
        d = shown.join(F.broadcast(best), "id")
        is_hit = lambda t: reduce(Column.__or__, (F.startswith(t, F.lit(w.text)) if w.prefix else t == w.text for w in words), F.lit(False))
        window = lambda ts: F.slice(ts, F.greatest(F.lit(1), F.coalesce("first", F.lit(0)) + 1 - lead).cast("int"), F.lit(size))
        mark = lambda t: F.when(is_hit(t), F.concat(F.lit("<b>"), t, F.lit("</b>"))).otherwise(t)
        snippet = let(terms(F.col(self.columns[0])), lambda ts: F.array_join(F.transform(window(ts), mark), " "))
        return d.select("id", *self.keep, *self.columns[1:], snippet.alias("snippet"), "rank")
