"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

A text is its words, each with an end mark that also stands for the blank, behind begin marks; the model, one for
each language, predicts every character and end mark from the ORDER - 1 symbols before it, those of earlier words
included, so the order of words counts as far as these reach. Training keeps counts only, as
tables sharded by n-gram. Texts are dealt into batches by hashes of their keys. Scoring sends the distinct n-grams of
each batch, packed, to their shards; each shard's distinct n-grams are joined with the counts of every order, and
the probabilities go back, packed in the same order, to the batch. A document whose perplexity exceeds its
language's quantile, taken over trusted texts that the model was not trained on, is not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import small_batches, staged

ORDER = 5
#: Of ten parts of the trusted texts (by hash of the text), one is held out for the quantiles.
FOLDS = 10
#: A language's threshold is this quantile of its held-out texts' perplexities, times SLACK.
QUANTILE, SLACK = 0.995, 1.1
#: Characters (about) of texts of one language that are scored together, that a task packs at once, and rows of all texts that make one shard more.
BATCH_CHARS, PACK_CHARS, SHARD_ROWS = 16 << 20, 64 << 20, 4096
#: Trusted ids up to this number are broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of languages up to this number are broadcast (a few numbers for each order); more are joined by a shuffle.
MAX_LANGS = 10_000
#: Ranges to a unit of the logarithm, in which values are counted before the one of a rank is looked for.
QUANTILE_STEPS = 1000
BEGIN, END = "\x02", "\x03"
#: Characters whose n-grams are taken apart at once; what a longer text has beyond is a further piece.
PIECE = 1 << 20


def symbols(text: str) -> str:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, each with an end mark: what the model predicts one by one."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at exactly these blanks
    return b"".join(w + END.encode() for w in words).decode("utf-8", "surrogatepass")


def _pieces(texts: list[str], order: int) -> Iterator[list[tuple[int, str]]]:
    """(place of the text, symbols with the ``order`` - 1 before them), grouped into about ``PIECE`` characters."""
    group: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        s = symbols(text)
        if s:
            s = BEGIN * (order - 1) + s
        for at in range(0, len(s) - order + 1, PIECE):
            group.append((k, s[at : at + PIECE + order - 1]))
            size += len(group[-1][1])
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def _grams(pieces: list[str], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of the pieces, none across two, and of every n-gram in order its place among these."""
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.unique(code)
    place = np.zeros(int(known[-1]) + 1, np.int64)
    place[known] = np.arange(len(known))
    dense = place[code]
    n = len(code) - order + 1
    ids, bound = dense[:n], len(known)
    for k in range(1, order):
        if bound * len(known) >= 1 << 62:
            ids = np.unique(ids, return_inverse=True)[1]
            bound = int(ids.max()) + 1
        ids = ids * len(known) + dense[k : k + n]
        bound *= len(known)
    whole = np.ones(n + order, bool)
    ends = np.cumsum([len(p) for p in pieces])
    for k in range(1, order):
        whole[ends - k] = False
    at = np.flatnonzero(whole[:n])
    _, first, inverse = np.unique(ids[at], return_index=True, return_inverse=True)
    body = code[at[first][:, None] + np.arange(order)].tobytes().decode("utf-32-le", "surrogatepass")
    return [body[i : i + order] for i in range(0, len(body), order)], inverse


class _Windows:
    """The n-grams of a batch of texts as numbers that sort like their symbols."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        self.groups = [([(k, len(p)) for k, p in g], np.frombuffer("".join(p for _, p in g).encode("utf-32-le", "surrogatepass"), np.uint32)) for g in _pieces(texts, order)]
        self.alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.unique(c) for _, c in self.groups)]))
        self.place = np.zeros(int(self.alphabet[-1]) + 1 if len(self.alphabet) else 0, np.int64)
        self.place[self.alphabet] = np.arange(len(self.alphabet))
        # numbers of all symbols might not fit in 62 bits: then those of the first symbols are numbered anew
        self.back, self.front = order // 2, None
        if len(self.alphabet) ** order >= 1 << 62:
            self.front = np.unique(np.concatenate([np.unique(self._number(c, 0, order - self.back)) for _, c in self.groups]))

    def _number(self, code: np.ndarray, start: int, length: int) -> np.ndarray:
        dense, n = self.place[code], len(code) - self.order + 1
        ids = np.zeros(n, np.int64)
        for j in range(start, start + length):
            ids = ids * len(self.alphabet) + dense[j : j + n]
        return ids

    def ids(self, sizes: list[tuple[int, int]], code: np.ndarray) -> np.ndarray:
        """Of every n-gram of a group in order; none lies across two pieces."""
        whole = np.ones(len(code), bool)
        ends = np.cumsum([n for _, n in sizes])
        for k in range(1, self.order):
            whole[ends - k] = False
        whole = whole[: len(code) - self.order + 1]
        if self.front is None:
            return self._number(code, 0, self.order)[whole]
        first = np.searchsorted(self.front, self._number(code, 0, self.order - self.back)[whole])
        return first * len(self.alphabet) ** self.back + self._number(code, self.order - self.back, self.back)[whole]

    def distinct(self) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(self.ids(*g)) for g in self.groups)]))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """The code points of n-grams, a row for each."""
        out, k, rest = np.zeros((len(ids), self.order), np.uint32), len(self.alphabet), ids
        for j in range(self.order - 1, -1, -1):
            if self.front is not None and j == self.order - self.back - 1:
                rest = self.front[rest]
            out[:, j] = self.alphabet[rest % k]
            rest = rest // k
        return out


class _Places:
    """Where numbers stand in a sorted array that holds them all, by a table of hashes; those that share a slot are searched for."""

    def __init__(self, ids: np.ndarray):
        bits = max(4, (16 * len(ids)).bit_length())
        self.ids, self.shift, self.table = ids, np.uint64(64 - bits), np.zeros(1 << bits, np.int32)
        self.table[self._slots(ids)] = np.arange(len(ids))

    def _slots(self, ids: np.ndarray) -> np.ndarray:
        return (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, ids: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(ids)]
        lost = np.flatnonzero(self.ids[at] != ids)
        at[lost] = np.searchsorted(self.ids, ids[lost])
        return at


_SPREAD = np.random.default_rng(20240101).integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def _shards(symbols_: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' places in the order of their shards, and where each shard starts and the last ends."""
    h = (symbols_.astype(np.uint64) * _SPREAD[: symbols_.shape[1]]).sum(1, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shard = ((h ^ (h >> np.uint64(32))) % np.uint64(n)).astype(np.int64)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=n))])


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _gram_rows(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): counts of a task's texts, in parts of about ``BATCH_CHARS``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def counted(lang: str | None) -> pa.RecordBatch:
            total: dict[str, int] = {}
            for group in _pieces(held.pop(lang)[0], order):
                own, which = _grams([p for _, p in group], order)
                for g, n in zip(own, np.bincount(which, minlength=len(own)).tolist(), strict=True):
                    total[g] = total.get(g, 0) + n
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "gram", "n"])

        for batch in it:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = held.setdefault(lang, [[], 0])
                own[0].append(text or "")
                own[1] += len(text or "")
                if own[1] >= BATCH_CHARS:
                    yield counted(lang)
        for lang in list(held):
            yield counted(lang)

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint")


def _packed_texts(rows: DataFrame) -> DataFrame:
    """(batch, lang, keys, held, sizes, texts): the texts of a task by batch, compressed."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for ident, (lang, keys, apart, texts) in held.items():
                columns = [pa.array([ident], pa.int64()), pa.array([lang], pa.string()), pa.array([keys], pa.list_(pa.int64())), pa.array([apart], pa.list_(pa.bool_()))]
                columns += [pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([_pack(b"".join(texts))], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["batch", "lang", "keys", "held", "sizes", "texts"])
            held.clear()

        for batch in it:
            for ident, lang, key, apart, text in zip(*(batch.column(c).to_pylist() for c in ("batch", "lang", "key", "held", "text")), strict=True):
                own = held.setdefault(ident, [lang, [], [], []])
                own[1].append(key)
                own[2].append(apart)
                own[3].append((text or "").encode("utf-8", "surrogatepass"))
                size += len(own[3][-1])
                if size >= PACK_CHARS:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.mapInArrow(run, "batch bigint, lang string, keys array<bigint>, held array<boolean>, sizes array<bigint>, texts binary")


def _unpacked(t: pa.Table) -> tuple[list, list, list[str]]:
    """Keys, held and texts of a batch."""
    keys, apart, texts = [], [], []
    for k, a, sizes, packed in zip(*(t[c].to_pylist() for c in ("keys", "held", "sizes", "texts")), strict=True):
        body, at = _unpack(packed), 0
        keys += k
        apart += a
        for size in sizes:
            texts.append(body[at : at + size].decode("utf-8", "surrogatepass"))
            at += size
    return keys, apart, texts


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MAX_LANGS else df


class Model:
    """Count tables of a trained model, by order: ``counts[k]`` (lang, gram, n), ``contexts[k]`` (lang, ctx, total, n1, n2, n3), and discounts."""

    def __init__(self, order: int, counts: dict[int, DataFrame], contexts: dict[int, DataFrame], discounts: DataFrame):
        self.order, self.counts, self.contexts, self.discounts = order, counts, contexts, discounts


def train(rows: DataFrame, order: int = ORDER) -> Model:
    """Modified Kneser-Ney counts of ``rows`` (key, lang, text): raw ones for the highest order, for lower ones the
    number of different characters that precede the n-gram. Discounts come from the counts of counts.
    """
    counts = {order: staged(_gram_rows(rows, order).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(order - 1, 0, -1):
        counts[k] = staged(counts[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    contexts, few = {}, None
    for k in range(1, order + 1):
        exactly = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)] + [F.count_if(F.col("n") >= 3).alias("n3")]
        contexts[k] = staged(counts[k].groupBy("lang", F.substring("gram", 1, k - 1).alias("ctx")).agg(F.sum("n").alias("total"), *exactly), "contexts")
        own = counts[k].groupBy("lang").agg(F.lit(k).alias("k"), *(F.count_if(F.col("n") == i).alias(f"c{i}") for i in (1, 2, 3, 4)), F.count("*").alias("types"))
        few = own if few is None else few.unionByName(own)
    few = staged(few, "discounts")
    y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))
    fallback = [0.5, 1.0, 1.5]
    d = [F.greatest(F.lit(0.1), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * F.try_divide(y * F.col(f"c{i + 1}"), F.col(f"c{i}")), F.lit(fallback[i - 1])))).alias(f"d{i}") for i in (1, 2, 3)]
    seen = (F.col("c1") > 0) & (F.col("c2") > 0)
    return Model(order, counts, contexts, few.select("lang", "k", "types", *(F.when(seen, x).otherwise(F.lit(fallback[i])).alias(f"d{i + 1}") for i, x in enumerate(d))))


def log_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """Adds ``logp``: ln p(last character | those before) of each (lang, gram); null for a language without a model.

    p_k = (n - D(n)) / total + gamma(context) p_(k-1), from order 1 up; below it every character that training
    saw, and one more for all others, is equally likely. A context that training lacks leaves p_(k-1) as it is.
    Each order is joined with its counts once, for the distinct endings that are asked for.
    """
    lang = F.coalesce("lang", F.lit("\x01")).alias("l")
    few = model.discounts.where("k = 1").count() <= MAX_LANGS
    rates = {k: model.discounts.where(F.col("k") == k).select(lang, "types", "d1", "d2", "d3") for k in range(1, model.order + 1)}
    wanted = {model.order: grams.select(lang, F.col("gram").alias("g")).distinct()}
    for k in range(model.order - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("l", F.expr(f"right(g, {k})").alias("g")).distinct()
    p = None
    for k in range(1, model.order + 1):
        own = wanted[k].join(F.broadcast(rates[k]) if few else rates[k], "l", "left").withColumn("x", F.expr(f"left(g, {k - 1})"))
        own = own.join(model.counts[k].select(lang, F.col("gram").alias("g"), "n"), ["l", "g"], "left")
        own = own.join(model.contexts[k].select(lang, F.col("ctx").alias("x"), "total", "n1", "n2", "n3"), ["l", "x"], "left")
        if p is None:
            own = own.withColumn("p", 1.0 / (F.col("types") + 1))
        else:
            own = own.withColumn("s", F.expr(f"right(g, {k - 1})")).join(p.withColumnRenamed("g", "s"), ["l", "s"])
        n = F.coalesce("n", F.lit(0))
        less = F.when(n == 0, 0.0).when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        own_p = (n - less) / F.col("total") + (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total") * F.col("p")
        p = own.select("l", "g", F.when(F.col("total").isNull(), F.col("p")).otherwise(own_p).alias("p"))
    out = grams.withColumn("l", lang).withColumn("g", F.col("gram")).join(p, ["l", "g"], "left")
    return out.select(*grams.columns, F.ln("p").alias("logp"))


def score(rows: DataFrame, model: Model) -> DataFrame:
    """(key, held, lang, n_symbols, logp) of every row of (key, held, lang, text): predicted characters and end marks, and the sum of their ln p.

    A text's batch depends on its key and itself alone, and a batch's n-grams on its texts, so what a lost executor computes anew is the same.
    """
    order = model.order
    spark = rows.sparkSession
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    sizes = staged(sizes.select("lang", "n", F.greatest(F.lit(1), F.ceil(F.col("chars") / BATCH_CHARS)).cast("bigint").alias("buckets")), "batches")
    shards = min(1 << 16, max(32, (sizes.agg(F.sum("n")).first()[0] or 0) // SHARD_ROWS))
    # the text too: rows without a key, or with one key, are dealt out as well
    bucket = F.pmod(F.xxhash64("key", "text"), F.col("buckets"))
    d = rows.join(_small(sizes.select(F.col("lang").alias("of"), "buckets")), F.col("lang").eqNullSafe(F.col("of"))).withColumn("batch", F.xxhash64("lang", bucket))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # both the n-grams and the scores of a batch are made of this one exchange
    packed = _packed_texts(d.select("batch", "lang", "key", "held", "text")).repartition(parts, "batch")

    def asked(t: pa.Table) -> pa.Table:
        w = _Windows(_unpacked(t)[2], order)
        codes = w.symbols(w.distinct())
        places, ends = _shards(codes, shards)
        there = np.flatnonzero(np.diff(ends))
        grams = [_pack(codes[places[ends[k] : ends[k + 1]]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")) for k in there]
        return pa.table([pa.array([t["lang"][0].as_py() or "\x01"] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array([t["batch"][0].as_py()] * len(there), pa.int64()), pa.array(grams, pa.binary())], ["lang", "shard", "batch", "grams"])

    def united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grams = None, set()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(grams), pa.string()), pa.array([now[1]] * len(grams), pa.int32()), pa.array(list(grams), pa.string())], ["lang", "shard", "gram"])

        for batch in it:
            for lang, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("lang", "shard", "grams")), strict=True):
                if now is not None and now != (lang, shard):
                    yield out()
                    grams = set()
                now = (lang, shard)
                text = _unpack(blob).decode("utf-8", "surrogatepass")
                grams.update(text[i : i + order] for i in range(0, len(text), order))
        if now is not None:
            yield out()

    def answered(requests: pa.Table, known: pa.Table) -> pa.Table:
        of = dict(zip(known["gram"].to_pylist(), (math.nan if x is None else x for x in known["logp"].to_pylist()), strict=True))
        values = []
        for blob in requests["grams"].to_pylist():
            text = _unpack(blob).decode("utf-8", "surrogatepass")
            values.append(_pack(np.fromiter((of[text[i : i + order]] for i in range(0, len(text), order)), float, len(text) // order).tobytes()))
        return pa.table([requests["batch"], requests["shard"], pa.array(values, pa.binary())], ["batch", "shard", "logp"])

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, apart, own = _unpacked(texts)
        w = _Windows(own, order)
        distinct = w.distinct()
        places, ends = _shards(w.symbols(distinct), shards)
        logp = np.full(len(distinct), math.nan)
        for shard, blob in zip(answers["shard"].to_pylist(), answers["logp"].to_pylist(), strict=True):
            logp[places[ends[shard] : ends[shard + 1]]] = np.frombuffer(_unpack(blob), float)
        n, total, place = np.zeros(len(own), np.int64), np.zeros(len(own)), _Places(distinct)
        for sizes_, code in w.groups:
            each, start = logp[place.of(w.ids(sizes_, code))], 0
            for k, length in sizes_:
                end = start + length - order + 1
                n[k] += end - start
                total[k] += each[start:end].sum()
                start = end
        lang = texts["lang"][0].as_py()
        return pa.table([pa.array(keys, pa.int64()), pa.array(apart, pa.bool_()), pa.array([lang] * len(keys), pa.string()), pa.array(n), pa.array(total)], ["key", "held", "lang", "n_symbols", "logp"])

    requests = packed.groupBy("batch").applyInArrow(asked, "lang string, shard int, batch bigint, grams binary").repartition(parts, "lang", "shard")
    # all columns, so that this too reads the one exchange of the requests
    distinct = requests.sortWithinPartitions("lang", "shard").mapInArrow(united, "lang string, shard int, gram string")
    known = log_probabilities(distinct, model).select("lang", "shard", "gram", "logp")
    answers = requests.groupBy("lang", "shard").cogroup(known.groupBy("lang", "shard")).applyInArrow(answered, "batch bigint, shard int, logp binary")
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(scored, "key bigint, held boolean, lang string, n_symbols bigint, logp double")


def quantiles(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, quantile): the value of rank ceil(q * n) of each group's n values above 0, exactly, the same in every run.

    Counts of narrow ranges of the logarithm tell in which range the rank lies; only the values of that range are then put in order.
    """
    d = df.select(F.col(group).alias("g"), F.col(value).alias("v"), F.floor(F.ln(value) * QUANTILE_STEPS).cast("bigint").alias("range"))
    counts = d.groupBy("g", "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("g", "range", "n", upto.alias("upto"), F.greatest(F.lit(1), F.ceil(F.sum("n").over(Window.partitionBy("g")) * F.lit(q))).alias("rank"))
    at = counts.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(F.col("g").alias("h"), "range", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    # copies have one value, which is one row here
    inside = d.join(_small(at), (F.col("g").eqNullSafe(F.col("h"))) & (d["range"] == at["range"])).groupBy("g", "v", "rank").agg(F.count("*").alias("n"))
    placed = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(F.col("g").alias(group), F.col("v").alias("quantile"))


def classify(
    df: DataFrame,
    trusted: DataFrame,
    text_col: str = "text",
    key: str = "doc_id",
    lang_col: str = "lang",
    order: int = ORDER,
    quantile: float = QUANTILE,
    slack: float = SLACK,
) -> DataFrame:
    """Per row of ``df``: ``key`` (an integer), lang, n_symbols, perplexity, threshold, kept.

    ``trusted`` holds the keys of the trusted texts in a column named as ``key``; nulls and repeats there
    change nothing. Texts are read whole. Kept: the perplexity is at most the language's threshold. Texts
    without a word (null, empty, blank) have a null perplexity and are not kept. A language without trusted
    text has a null perplexity and threshold, one without held-out text a null threshold: their texts are kept if they have a
    word. A null language is a language. Repeated rows are scored each; a perplexity equal to the threshold is kept. Very
    long texts are scored whole, in pieces. Empty tables give no rows; other columns are not read.
    """
    small_batches(df.sparkSession)
    fold = F.pmod(F.xxhash64(text_col), F.lit(FOLDS))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(lang_col).cast("string").alias("lang"), text, (fold == 0).alias("held"))
    ids = staged(trusted.select(F.col(key).cast("bigint").alias("key")).where("key is not null").distinct(), "trusted")
    by_size = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    model = train(rows.where(~F.col("held")).join(by_size, "key", "left_semi"), order)
    ppl = F.when((F.col("n_symbols") > 0) & ~F.isnan("logp"), F.exp(-F.col("logp") / F.col("n_symbols")))
    scored = staged(score(rows, model).withColumn("perplexity", ppl), "scores")
    trial = scored.where("held and perplexity is not null").join(by_size, "key", "left_semi")
    limits = quantiles(trial, "lang", "perplexity", quantile).select(F.col("lang").alias("l"), (F.col("quantile") * slack).alias("threshold"))
    out = scored.join(_small(limits), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    kept = (F.col("n_symbols") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("key").alias(key), "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))
