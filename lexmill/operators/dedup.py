"""Duplicate groups, canonical rows and greedy clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.vectors import cosine_pairs
from lexmill.sources.files import staged


def identity_groups(df: DataFrame, identity: Column, key: str) -> DataFrame:
    """Identities that more than one row has: (identity fields, n, canonical). A null field equals a null."""
    d = df.select(identity.alias("i"), key)
    return d.groupBy("i").agg(F.count("*").alias("n"), F.min(key).alias("canonical")).where("n > 1").select("i.*", "n", "canonical")


def hash_duplicates(df: DataFrame, text: str, owner: str) -> DataFrame:
    """Per repeated text: rows, owners, and how many rows can go (one owner) or need a review (several)."""
    d = df.groupBy(F.md5(F.col(text).cast("binary")).alias("hash")).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("owners")).where("n > 1")
    return d.withColumn("removable", F.when(F.col("owners") == 1, F.col("n") - 1).otherwise(0)).withColumn("reviewable", F.when(F.col("owners") > 1, F.col("n") - F.col("owners")).otherwise(0))


#: Trigrams that a cell holds of its own, at least and at most, and into how many parts all of them are dealt in between; the fewest and most bits of a sketch;
#: (block, bin) rows that are broadcast; rows of pairs, codes and guests that are made at once.
LEAST_CELL, MOST_CELL, CELLS, LEAST_BITS, MOST_BITS, MOST_BINS, ROWS, CODES, GUESTS = 1 << 21, 1 << 24, 32, 256, 1 << 16, 1 << 16, 1 << 17, 1 << 20, 2048


def text_grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, each as one number, ascending; a shorter text is its own."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    c = np.pad(c, (0, max(0, 3 - len(c))))
    return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])


def sketch_bits(log_size: float) -> int:
    """A power of two, twice the size of a set or more."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << math.ceil(log_size / math.log(2) + 1)))


def sketch(grams: np.ndarray, bits: int) -> np.ndarray:
    """For each bucket whether an odd number of the trigrams fall into it; with half as many bits, the two halves' XOR."""
    mixed = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def loaded(n: pa.Array, bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and sketches of one width as rows of words."""
    n = n.to_numpy()
    return n, np.frombuffer(b"".join(bits.to_pylist()), np.uint64).reshape(len(n), -1) if len(n) else np.zeros((0, LEAST_BITS // 64), np.uint64)


def near(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], above: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks of (sizes, sketches) whose sets may overlap by more than ``above``; of the same block, each pair once, the first place the lower one."""
    half = lambda m: m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    (p, a), (q, b) = x, y
    if not len(p) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    while a.shape[1] != b.shape[1]:
        a, b = (half(a), b) if a.shape[1] > b.shape[1] else (a, half(b))
    # by size, so that sets of unlike sizes are not met
    s0 = np.argsort(p, kind="stable")
    t0 = s0 if same else np.argsort(q, kind="stable")
    p, a, q, b = p[s0].astype(np.int64), a[s0], q[t0].astype(np.int64), b[t0]
    a2, b2 = (np.ascontiguousarray(half(m).T) for m in (a, b))
    found = [(s0[:0], t0[:0])]
    for s in range(0, len(p), 64):
        u = slice(s, s + 64)
        first = s if same else np.searchsorted(q, p[s] * above * (1 - 1e-9))
        for t in range(first, np.searchsorted(q, p[u][-1] / above * (1 + 1e-9), "right"), 2048):
            v = slice(t, t + 2048)
            apart = np.zeros((len(p[u]), len(q[v])), np.uint16)
            for c, d in zip(a2, b2, strict=True):
                apart += np.bitwise_count(c[u, None] ^ d[None, v])
            m = np.maximum(p[u, None], q[None, v])
            # trigrams that may differ where floor(above m) + 1 are shared; the small part less is for rounding
            most = p[u, None] + q[None, v] - 2 * (np.floor(m * above - 1e-9).astype(np.int64) + 1)
            i, j = np.nonzero(apart <= most)
            i, j, most = i + s, j + t, most[i, j]
            fine = (np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= most) & ((i < j) | (not same))
            found.append((s0[i[fine]], t0[j[fine]]))
    i, j = (np.concatenate(z) for z in zip(*found, strict=True))
    return (np.minimum(i, j), np.maximum(i, j)) if same else (i, j)


def near_sketches(x: pa.StructArray, y: pa.StructArray, above: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks of (n, bits) whose sets may overlap by more than ``above``; of the same block, each pair once."""
    return near(*(loaded(z.field("n"), z.field("bits")) for z in (x, y)), above, same)


def by_cell(batches: Iterator[pa.RecordBatch], cell: list[str], make) -> Iterator[tuple[dict, object, object]]:
    """(cell, own, other) of rows sorted by ``cell`` and "guest": first a cell's own rows with themselves (other None), then with the guests, some at a time.
    ``make`` is called once on a cell's own rows (with None), once on each part of the guests (with what was made of the own ones)."""
    at, rows, own = None, [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in [*cell, "guest"]), strict=True))
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for s, e in zip([0, *ends], [*ends, len(keys)], strict=True):
            if s == e:
                continue
            if at != keys[s][:-1]:
                if rows:
                    yield dict(zip(cell, at, strict=True)), make(pa.Table.from_batches(rows), None), None
                at, rows, own = keys[s][:-1], [], None
            part = batch.slice(s, e - s)
            if not keys[s][-1]:
                rows.append(part)
                continue
            if rows:
                own, rows = make(pa.Table.from_batches(rows), None), []
                yield dict(zip(cell, at, strict=True)), own, None
            if own is not None:  # a cell may have no rows of its own
                for g in range(0, len(part), GUESTS):
                    yield dict(zip(cell, at, strict=True)), own, make(pa.Table.from_batches([part.slice(g, GUESTS)]), own)
    if rows:
        yield dict(zip(cell, at, strict=True)), make(pa.Table.from_batches(rows), None), None


class Sets:
    """Texts with their sets of trigrams, as sketches and as codes one after the other (the places in a vocabulary), and the keys of the rows that have each text."""

    def __init__(self, texts: pa.ChunkedArray, bits: int, keys: pa.ListArray, vocabulary: np.ndarray | None = None):
        self.n, self.keys, parts, held = np.zeros(len(texts), np.int64), keys, [], []
        words = np.zeros((len(texts), bits // 64), np.uint64)

        def coded() -> None:
            # numbers of 64 bits are held for some of the texts only
            every = np.concatenate(held)
            held.clear()
            if vocabulary is None:
                parts.append(tuple(x.astype(np.int64 if i == 0 else np.int32) for i, x in enumerate(np.unique(every, return_inverse=True))))
            else:
                at = np.minimum(np.searchsorted(vocabulary, every), len(vocabulary) - 1)
                parts.append(np.where(vocabulary[at] == every, at, len(vocabulary)).astype(np.int32))

        for i, t in enumerate(texts):
            grams = text_grams(t.as_py())
            self.n[i] = len(grams)
            words[i] = sketch(grams, bits).view(np.uint64)
            held.append(grams)
            if i + 1 == len(texts) or len(grams) >= CODES or len(held) % 256 == 0:
                coded()
        self.block, self.ends = (self.n, words), np.cumsum(self.n)
        if vocabulary is None:
            self.vocabulary = reduce(np.union1d, (v for v, _ in parts))
            parts = [np.searchsorted(self.vocabulary, v).astype(np.int32)[c] for v, c in parts]
        self.codes = np.concatenate(parts)

    def shared(self, other: Sets, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        """How many trigrams the s-th sets share with the t-th ones of ``other``, which is coded by the same vocabulary; ``s`` ascending."""
        mark, out = np.zeros(len(self.vocabulary) + 1, np.int32), np.zeros(len(s), np.int64)
        cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            i = s[lo]
            own = self.codes[self.ends[i] - self.n[i] : self.ends[i]]
            mark[own] = 1
            per = max(1, CODES // int(other.n[t[lo:hi]].max()))
            for at in range(lo, hi, per):
                j = t[at : min(at + per, hi)]
                n = other.n[j]
                first = np.cumsum(n) - n
                places = np.arange(n.sum()) + np.repeat(other.ends[j] - n - first, n)
                out[at : at + len(j)] = np.add.reduceat(mark[other.codes[places]], first)
            mark[own] = 0
        return out


def crossed(x: pa.ListArray, y: pa.ListArray, s: np.ndarray, t: np.ndarray) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """All pairs of a value of x[s] and one of y[t], and the place in s that they are of, some at once."""
    nx, ny = (z.value_lengths().to_numpy().astype(np.int64) for z in (x, y))
    ax, ay, vx, vy = np.cumsum(nx) - nx, np.cumsum(ny) - ny, x.flatten(), y.flatten()
    ends = np.cumsum(nx[s] * ny[t])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
        r = np.arange(lo, min(lo + ROWS, int(ends[-1])))
        at = np.searchsorted(ends, r, "right")
        i, j = s[at], t[at]
        rest = r - (ends[at] - nx[i] * ny[j])
        yield vx.take(pa.array(ax[i] + rest // ny[j])), vy.take(pa.array(ay[j] + rest % ny[j])), at


def similar_texts(df: DataFrame, key: str, text: str, least: int = 200, above: float = 0.9, block: str | None = None) -> DataFrame:
    """(a, b, overlap) of all pairs a < b of rows with different texts whose trigram overlap exceeds ``above``, on whole texts; with ``block``, only of rows equal in it (null to null).

    Rows of a block with the same text are one class. Classes whose sets are of like size meet in cells of bounded size, first by sketches: a bit for each of
    some buckets, whether an odd number of the set's trigrams fall into it. Bits that differ are never more than the trigrams that do, so no pair is lost. Only
    the classes that may be near to another one of a cell bring their texts there, once each, and are compared exactly; pairs never leave their task. Texts of
    ``least`` characters or fewer, and null ones, are left out.
    """
    spark = df.sparkSession
    own = F.coalesce(F.concat(F.lit("="), (F.col(block) if block else F.lit(None)).cast("string")), F.lit("")).alias("block")
    rows = df.where(F.length(text) > least).select(F.col(key).alias("k"), own, F.col(text).alias("t"))
    rows = rows.withColumn("h", F.substring(F.unhex(F.sha2(F.concat("block", F.lit("\0"), "t").cast("binary"), 256)), 1, 16))
    kind = rows.schema["k"].dataType.simpleString()

    # a class is of a bin by its size; sets of like size are at most one bin apart
    width = -math.log(above)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts that a batch has several times are read once
            h = batch.column("h").dictionary_encode()
            of = h.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            first = np.unique(of, return_index=True)[1]
            found = [text_grams(t) for t in batch.column("t").take(pa.array(first)).to_pylist()]
            bins = [int(math.log(len(g)) / width) for g in found]
            bits = [sketch(g, max(LEAST_BITS, sketch_bits(i * width) // 2)).tobytes() for g, i in zip(found, bins, strict=True)]
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(first)))].astype(np.int32))
            keys = pa.ListArray.from_arrays(ends, batch.column("k").take(pa.array(order)))
            more = [pa.array([len(g) for g in found], pa.int32()), pa.array(bins, pa.int32()), pa.array(bits, pa.binary()), keys]
            yield pa.RecordBatch.from_arrays([h.dictionary, batch.column("block").take(pa.array(first)), *more], ["h", "block", "n", "bin", "bits", "ks"])

    found = rows.select("k", "block", F.lower("t").alias("t"), "h").mapInArrow(sketched, f"h binary, block string, n int, bin int, bits binary, ks array<{kind}>")
    like = F.any_value(F.struct("block", "n", "bin", "bits")).alias("c")
    classes = staged(found.groupBy("h").agg(like, F.flatten(F.collect_list("ks")).alias("ks")).select("h", "c.*", "ks"), "classes")

    cell = ["block", "bin", "sub"]
    total = classes.agg(F.sum("n")).first()[0] or 0
    most = min(MOST_CELL, max(LEAST_CELL, total // CELLS))
    subs = F.ceil(F.sum("n") / most).cast("int").alias("subs")
    bins = classes.groupBy("block", "bin").agg(subs)
    bins = staged(bins.join(bins.select("block", (F.col("bin") + 1).alias("bin"), F.col("subs").alias("below")), ["block", "bin"], "left"), "bins")
    placed = classes.select("h", "block", "n", "bin", "bits").join(F.broadcast(bins) if bins.count() <= MOST_BINS else bins, ["block", "bin"])
    # a class is at home in one cell, and a guest in those before it of its bin, and in all of the bin below
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("h"), F.col("subs")).cast("int"))
    visit = lambda b, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(b.alias("bin"), i.alias("sub"), F.lit(True).alias("guest")))).otherwise(F.array())
    home = F.array(F.struct("bin", "sub", F.lit(False).alias("guest")))
    met = placed.select("h", "block", "n", "bits", F.inline(F.concat(home, visit(F.col("bin"), F.col("sub")), visit(F.col("bin") - 1, F.coalesce("below", F.lit(0))))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda d: d.repartition(tasks, *cell).sortWithinPartitions(*cell, "guest")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Part:
            def __init__(self, t: pa.Table, _: object):
                self.h, self.told = t.column("h").combine_chunks(), np.zeros(len(t), bool)
                bits = t.column("bits").combine_chunks()
                # guests of one batch are of one bin or of two, whose sketches may differ in width
                wide = pa.compute.binary_length(bits).to_numpy()
                self.blocks = [(np.flatnonzero(wide == w), loaded(t.column("n").combine_chunks().filter(pa.array(wide == w)), bits.filter(pa.array(wide == w)))) for w in np.unique(wide)]

        for at, x, y in by_cell(batches, cell, Part):
            hits = {False: [], True: []}
            for i, (p, a) in enumerate(x.blocks):
                for j, (q, b) in enumerate((y or x).blocks):
                    if y is None and j < i:
                        continue
                    s, t = near(a, b, above, y is None and i == j)
                    hits[False].append(p[s])
                    hits[y is not None].append(q[t])
            for guest, z in ((False, x), (True, y)):
                if hits[guest]:
                    new = np.unique(np.concatenate(hits[guest]))
                    new = new[~z.told[new]]
                    z.told[new] = True
                    n = len(new)
                    yield pa.RecordBatch.from_arrays([z.h.take(pa.array(new)), pa.array([at["block"]] * n, pa.string()), pa.array([at["bin"]] * n, pa.int32()), pa.array([at["sub"]] * n, pa.int32()), pa.array([guest] * n, pa.bool_())], ["h", *cell, "guest"])

    wanted = dealt(met).mapInArrow(marked, "h binary, block string, bin int, sub int, guest boolean").groupBy("h").agg(F.collect_list(F.struct(*cell, "guest")).alias("cells"))
    texts = rows.groupBy("h").agg(F.any_value(F.lower("t")).alias("t"))
    brought = texts.join(wanted, "h").join(classes.select("h", "ks"), "h").select("t", "ks", F.inline("cells"))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(t: pa.Table, own: Sets | None) -> Sets:
            return Sets(t.column("t"), sketch_bits(t.column("bin")[0].as_py() * width), t.column("ks").combine_chunks(), own and own.vocabulary)

        for _, x, y in by_cell(batches, cell, sets):
            s, t = near(x.block, (y or x).block, above, y is None)
            order = np.argsort(s, kind="stable")
            s, t = s[order], t[order]
            if not len(s):
                continue
            overlap = x.shared(y or x, s, t) / np.maximum(x.n[s], (y or x).n[t])
            s, t, overlap = (z[overlap > above] for z in (s, t, overlap))
            for a, b, at in crossed(x.keys, (y or x).keys, s, t):
                yield pa.RecordBatch.from_arrays([a, b, pa.array(overlap[at], pa.float64())], ["s", "e", "overlap"])

    pairs = dealt(brought).mapInArrow(confirmed, f"s {kind}, e {kind}, overlap double")
    return pairs.select(F.least("s", "e").alias("a"), F.greatest("s", "e").alias("b"), "overlap")


def greedy_clusters(df: DataFrame, key: str, vector: str, block: str | None, threshold: float) -> DataFrame:
    """First-seed clusters (key, block, seed), or (key, seed) of all rows without ``block``: rows join the first seed, in key order, that is near enough.

    Keys are integers and differ. Near pairs come from bounded blocks of vectors. In rounds, a row becomes a seed once
    no undecided row of a smaller key is near to it, and the rows near to a seed are decided; each takes its smallest seed.
    """
    kind = dict(df.dtypes)[key]
    pairs = staged(cosine_pairs(df, key, vector, threshold, block).select("a", "b"), "pairs")
    linked = pairs.select(F.col("b").alias("k"))
    # a row without a near one of a smaller key is a seed at once
    seeds = [staged(df.select(F.col(key).cast("bigint").alias("k")).join(linked, "k", "left_anti"), "seeds")]
    todo, left = staged(linked.distinct(), "undecided"), pairs
    while not todo.isEmpty():
        near = left.join(seeds[-1].select(F.col("k").alias("a")), "a", "left_semi").select(F.col("b").alias("k")).distinct()
        rest = staged(todo.join(near, "k", "left_anti"), "undecided")
        open_ = staged(left.join(rest.select(F.col("k").alias("a")), "a", "left_semi").join(rest.select(F.col("k").alias("b")), "b", "left_semi").select("a", "b"), "pairs")
        seeds.append(staged(rest.join(open_.select(F.col("b").alias("k")), "k", "left_anti"), "seeds"))
        todo, left = staged(rest.join(seeds[-1], "k", "left_anti"), "undecided"), open_
    found = seeds[0]
    for more in seeds[1:]:
        found = found.unionByName(more)
    found = staged(found, "seeds")
    joined = pairs.join(found.select(F.col("k").alias("a")), "a").join(found.select(F.col("k").alias("b")), "b", "left_anti").groupBy(F.col("b").alias("__k")).agg(F.min("a").alias("seed"))
    own = [key, block] if block else [key]
    out = df.select(*own).join(joined, F.col(key) == F.col("__k"), "left")
    return out.select(*own, F.coalesce("seed", key).cast(kind).alias("seed"))


def purge(df: DataFrame, canonical: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Rows that a purge deletes: those of a duplicate group other than its canonical row."""
    return df.join(canonical.select(*keys, F.col(key).alias("__c")), keys).where(F.col(key) != F.col("__c")).drop("__c")
