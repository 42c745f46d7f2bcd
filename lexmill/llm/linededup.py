"""Line dedup by pairwise alignment.

Overlapping documents are found through hashes of their shared lines: every line that has the words of a block, and
around shorter lines every shortest run that has, ties a later document to the document that holds it first, so a
line held by n documents makes n - 1 pairs, rare or not. Each pair is aligned with a patience diff (lines that are
unique in both are its anchors) and the aligned common blocks are deleted from the later document, then those common
runs that stand in another order. Any block of a document that any earlier one holds is thus deleted through the
first holders of its runs, whether or not these two documents were compared.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BLANKS, drop_staged, small_batches, staged

#: A common block of fewer words stays.
MIN_BLOCK_WORDS = 5
#: Runs with more holders than both LEAST_HOT and one HOT_RUNS-th of all holders of shared runs are dealt into salts.
LEAST_HOT, HOT_RUNS = 1000, 10_000
#: Pairs that one copy of an earlier document's lines serves.
HELD_PAIRS = 4096


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by their first number, whose second numbers rise."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        place = bisect_left(tops, y)
        back.append(at[place - 1] if place else -1)
        if place == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[place], at[place] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Positions (i, j) of lines matched in order, a[i] == b[j].

    Common ends are matched first, then the lines that are unique on both sides (the longest run of them in
    order), then what lies between these in the same way. Where common lines are left but none is unique,
    the rarest one's first places serve as the anchor.
    """
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        shared = in_a.keys() & in_b.keys()
        if not shared:
            continue
        unique = {x for x in shared if in_a[x] == 1 == in_b[x]}
        if unique:
            place = {b[j]: j for j in range(j0, j1) if b[j] in unique}
            anchors = _rising([(i, place[a[i]]) for i in range(i0, i1) if a[i] in unique])
        else:
            rare = min(shared, key=lambda x: (in_a[x] + in_b[x], x))
            anchors = [(next(i for i in range(i0, i1) if a[i] == rare), next(j for j in range(j0, j1) if b[j] == rare))]
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, i1, j0, j1))
    return sorted(out)


def _spans(sizes: Sequence[int], least: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs with ``least`` words from each line on and up to each line, where the text has them; sorted."""
    if all(n >= least for n in sizes):
        return [(i, i + 1) for i in range(len(sizes))]
    out, end, words = set(), 0, 0
    for start in range(len(sizes)):
        while words < least and end < len(sizes):
            words += sizes[end]
            end += 1
        if words >= least:
            out.add((start, end))
        words -= sizes[start]
    start = words = 0
    for end in range(len(sizes)):
        words += sizes[end]
        while words - sizes[start] >= least:
            words -= sizes[start]
            start += 1
        if words >= least:
            out.add((start, end + 1))
    return sorted(out)


def runs(hashes: Sequence[int], sizes: Sequence[int], least: int) -> Iterator[tuple[tuple[int, int], int]]:
    """((start, end), name) of the runs of ``_spans``; the name tells lines and, for a repeated run, which repeat it is."""
    seen: Counter[tuple[int, ...]] = Counter()
    for start, end in _spans(sizes, least):
        own = tuple(hashes[start:end])
        seen[own] += 1
        yield (start, end), own[0] if len(own) == seen[own] == 1 else xxhash.xxh3_64_intdigest(array("q", (*own, seen[own])).tobytes()) - (1 << 63)


def doomed(earlier: Sequence[int], later: Sequence[int], sizes: Sequence[int], least: int) -> list[int]:
    """Places in ``later`` of the aligned common blocks that hold at least ``least`` words, and of the common runs in another order.

    ``sizes`` are the words of the later document's lines; equal lines have as many in both.
    """
    gone = set(_blocks(patience(earlier, later), sizes, least))
    if len(gone) < len(later):
        words = dict(zip(later, sizes, strict=True))
        # lines that only the earlier one has make runs of their own, which the later one never holds
        held = {name for _, name in runs(earlier, [words.get(x, least) for x in earlier], least)}
        for place, name in runs(later, sizes, least):
            if name in held:
                gone.update(range(*place))
    return sorted(gone)


def _blocks(matches: list[tuple[int, int]], sizes: Sequence[int], least: int) -> list[int]:
    """Places in the later document of the matched blocks, adjacent in both, that hold at least ``least`` words."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*matches, (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _line_rows(df: DataFrame, text_col: str, key: str, least: int) -> DataFrame:
    """(key, at, sizes, hashes, names): place, words and hash of every line that has a word, and the names of the document's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1):
                at, sizes, hashes = [], [], []
                for k, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    if n := len(line.split()):  # bytes are split at exactly the blanks
                        at.append(k)
                        sizes.append(n)
                        hashes.append(xxhash.xxh3_64_intdigest(line) - (1 << 63))
                for column, own in zip(columns, (at, sizes, hashes, list({name for _, name in runs(hashes, sizes, least)})), strict=True):
                    column.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True))], [key, "at", "sizes", "hashes", "names"])

    kind = df.select(key).dtypes[0][1]
    return df.select(key, F.col(text_col).alias("__text")).mapInArrow(run, f"`{key}` {kind}, at array<int>, sizes array<int>, hashes array<bigint>, names array<bigint>")


def removals(df: DataFrame, text_col: str = "text", key: str = "doc_id", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(key, gone): the line numbers (from 0) to delete, for documents that lose lines.

    The earlier of two documents is that with the smaller key. A line stays in the document that holds it
    first, whatever happens to others; repeats within a document stay, but for as many as an earlier one holds. A document is
    aligned with the first holder of each of its runs, rare or frequent, which finds every block that any earlier one
    holds. Pairs come from hashes of 64 bits and the alignment compares them. Only arrays of hashes are moved, never texts.
    """
    small_batches(df.sparkSession)
    rows = _line_rows(df.where(F.col(key).isNotNull()), text_col, key, min_block_words)
    rows = staged(rows.groupBy(key).agg(*(F.max_by(c, F.struct(F.size("at"), F.hash("hashes"))).alias(c) for c in ("at", "sizes", "hashes", "names"))), "lines")
    held = rows.select(F.col(key).alias("later"), F.explode("names").alias("h"))
    first = held.groupBy("h").agg(F.min("later").alias("earlier"), F.max("later").alias("last"), F.count("*").alias("n")).where("earlier < last")
    first = staged(first.select("h", "earlier", "n"), "first")
    # a run that very many documents hold is dealt into salts; of such runs there are never more than HOT_RUNS
    most = max(LEAST_HOT, (first.agg(F.sum("n")).first()[0] or 0) // HOT_RUNS)
    salts = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(first.where(F.col("n") > most).select("h", salts.alias("salts")))
    salted = held.join(hot, "h", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("later"), "salts"), F.lit(0)).cast("int"))
    firsts = first.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("h", "salt", "earlier")
    pairs = salted.join(firsts, ["h", "salt"]).where("earlier < later").select("earlier", "later").distinct()
    # a document that is the first holder for very many is dealt into salts too: each part of its pairs gets a copy of its lines
    many = pairs.groupBy("earlier").agg(F.ceil(F.count("*") / HELD_PAIRS).cast("int").alias("parts")).where("parts > 1")
    many = staged(many, "holders")
    part = F.coalesce(F.pmod(F.xxhash64("later"), "parts"), F.lit(0)).cast("int")
    pairs = pairs.join(many, "earlier", "left").select("earlier", "later", part.alias("part"))
    a = rows.select(F.col(key).alias("earlier"), F.col("hashes").alias("theirs")).join(many, "earlier", "left")
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    b = rows.select(F.col(key).alias("later"), "at", "sizes", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            places = [[at[k] for k in doomed(x, y, s, min_block_words)] for x, y, s, at in zip(d["theirs"], d["hashes"], d["sizes"], d["at"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("later"), pa.array(places, pa.list_(pa.int32()))], ["later", "gone"])

    kind = df.select(key).dtypes[0][1]
    paired = pairs.join(a, ["earlier", "part"]).join(b, "later").select("later", "theirs", "at", "sizes", "hashes")
    found = paired.mapInArrow(run, f"later {kind}, gone array<int>").where(F.size("gone") > 0)
    gone = staged(found.groupBy(F.col("later").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    drop_staged(rows, first)
    return gone


def dedup(df: DataFrame, text_col: str = "text", key: str = "doc_id", min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``df`` with the common blocks of later documents deleted from ``text_col``, and ``n_removed`` (lines).

    A document that loses lines and keeps no word has an empty text. Null and empty texts, and rows with a null key, stay as
    they are; rows with the same key are one document, of which the row with most lines is compared, and
    each keeps what that row keeps (its deleted line numbers apply to all). Ties and repeated rows change
    nothing else. An empty table gives no rows. A column ``n_removed`` of ``df`` is replaced.
    """
    # what goes is as large as what documents share, so it is never broadcast
    gone = removals(df, text_col, key, min_block_words).withColumnRenamed("gone", "__gone").hint("merge")
    d = df.drop("n_removed").join(gone, key, "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    # blank lines are no lines that anything could share; where nothing else is left, they go too
    text = F.when(F.btrim(text, F.lit(BLANKS)) == "", F.lit("")).otherwise(text)
    d = d.withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint")).withColumn(text_col, F.when(F.col("__gone").isNotNull(), text).otherwise(F.col(text_col)))
    return d.select(*(c for c in df.columns if c != "n_removed"), "n_removed")
