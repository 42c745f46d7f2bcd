"""Full-text search: postings and BM25 on built-in aggregates and joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.compat import ACCENTED, PLAIN, strip_accents
from lexmill.sources.files import staged

#: Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Different terms that a task counts before it hands its counts on.
HELD_TERMS = 1 << 18
# the same folding and the same runs as ``terms``
_FOLD, _TERMS = str.maketrans(ACCENTED, PLAIN), re.compile(r"[^\W_]+")


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, accents folded."""
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: By byte of UTF-8, whether it may be of a term: ASCII letters and digits, and all that is not ASCII.
_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])


def tokens(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(row, place in the row, number, terms by number) of all terms of some texts, in order; those of ``terms``. What stands between ASCII characters that no term has is folded once, however often it comes."""
    texts = texts.cast(pa.string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = _WORD[data]
    if b"\xce\xa3" in data.tobytes():
        # how a capital sigma is lowered depends on what is around it, so such a text stays in one piece
        for i in np.unique(np.searchsorted(ends, np.flatnonzero((data[:-1] == 0xCE) & (data[1:] == 0xA3)), "right") - 1):
            word[ends[i] : ends[i + 1]] = True
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    s = np.flatnonzero(word & (cut[:-1] | ~np.r_[False, word[:-1]]))
    e = np.flatnonzero(word & (cut[1:] | ~np.r_[word[1:], False])) + 1
    if not len(s):
        return *(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.string())
    # the pieces and, between them, what is left out
    pieces = pa.StringArray.from_buffers(2 * len(s) - 1, pa.py_buffer(np.stack([s, e], 1).ravel().astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    pieces = pieces.take(pa.array(np.arange(0, 2 * len(s), 2))).dictionary_encode()
    found = [[x.lower()] if x.isascii() and x.isalnum() else _TERMS.findall(x.translate(_FOLD).lower()) for x in pieces.dictionary.to_pylist()]
    counts = np.array([len(x) for x in found], np.int64)
    coded = pa.array([t for x in found for t in x], pa.string()).dictionary_encode()
    first, of = np.cumsum(counts) - counts, pieces.indices.to_numpy()
    n = counts[of]
    row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(s, ends))), n)
    numbers = coded.indices.to_numpy()[np.repeat(first[of], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
    per = np.bincount(row, minlength=len(texts))
    return row, np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per), numbers, coded.dictionary


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, size)."""
    d = df.select(key, terms(F.col(text)).alias("t"))
    return d.select(key, F.size("t").alias("size"), F.explode("t").alias("term")).groupBy("term", key, "size").agg(F.count("*").alias("tf"))


def term_totals(df: DataFrame, text: str) -> DataFrame:
    """(term, tf, df) over all rows. A task counts the terms of its rows as they come, so what is shuffled is a row a term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf: Counter[str] = Counter()
        rows: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            found = list(tf)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([tf[t] for t in found], pa.int64()), pa.array([rows[t] for t in found], pa.int64())], ["term", "tf", "df"])

        for batch in batches:
            for own in batch.column(0).to_pylist():
                found = _TERMS.findall((own or "").translate(_FOLD).lower())
                tf.update(found)
                rows.update(set(found))
            if len(tf) >= HELD_TERMS:
                yield counted()
                tf.clear()
                rows.clear()
        yield counted()

    found = df.select(F.col(text).cast("string")).mapInArrow(run, "term string, tf bigint, df bigint")
    return found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _times(text: Column, word: str) -> Column:
    """How often a term stands in a folded text."""
    return F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{word}\E(?![\p{{L}}\p{{N}}])"))


def bm25(df: DataFrame, key: str, text: str, query: list[str], every: bool = True) -> DataFrame:
    """(key, score): rows with all (or any) of the terms; lower scores are better, as the reference ranks them.

    Terms are counted in place, no list of a text's terms is made; sizes and counts come from the same scan of the texts.
    """
    words = sorted(set(query))
    d = df.select(key, F.lower(strip_accents(F.coalesce(text, F.lit("")))).alias("t"))
    # the counts are a few numbers a row; kept, so that texts are read once for them and for the totals
    d = staged(d.select(key, F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")).alias("size"), *(_times(F.col("t"), w).alias(f"f{i}") for i, w in enumerate(words))), "counts")
    about = d.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(words))))
    d = d.join(F.broadcast(about))  # one row
    total = F.lit(0.0)
    for i in range(len(words)):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.greatest(F.ln((F.col("docs") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        total = total + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.col("mean")))).otherwise(0.0)
    hits = [F.col(f"f{i}") > 0 for i in range(len(words))]
    keep = hits[0]
    for h in hits[1:]:
        keep = keep & h if every else keep | h
    return d.where(keep).select(key, (-total).alias("score"))


def matching(df: DataFrame, key: str, text: str, every: tuple[str, ...] = (), some: tuple[str, ...] = (), none: tuple[str, ...] = (), size: int = 64, lead: int = 8) -> DataFrame:
    """(key, snippet): rows with all terms of ``every``, one of ``some`` (if any are given) and none of ``none``.

    The snippet holds ``size`` terms from ``lead`` before the first hit on, hits between <b> and </b>.
    """
    hit = lambda x: x.isin(*every, *some)
    d = df.select(key, terms(F.col(text)).alias("t"))
    has = lambda w: F.array_contains("t", F.lit(w))
    keep = F.lit(True)
    for w in every:
        keep = keep & has(w)
    if some:
        keep = keep & F.arrays_overlap("t", F.array(*map(F.lit, some)))
    for w in none:
        keep = keep & ~has(w)
    places = F.array(*(F.nullif(F.array_position("t", F.lit(w)), F.lit(0)) for w in (*every, *some)))
    start = F.greatest(F.lit(1), F.array_min(places) - lead).cast("int")
    shown = F.transform(F.slice("t", start, F.lit(size)), lambda x: F.when(hit(x), F.concat(F.lit("<b>"), x, F.lit("</b>"))).otherwise(x))
    return d.where(keep).select(key, F.array_join(shown, " ").alias("snippet"))
