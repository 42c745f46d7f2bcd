"""Byte-level BPE encoding and decoding.

Whole pre-tokens that the vocabulary holds are resolved by a minimal perfect hash over its entries, a block
of distinct pre-tokens at a time; the others are merged with a heap over linked bytes. Both steps are maps
over the rows: no shuffle, and a lost executor costs only its own partitions.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import small_batches

#: Characters of text that are split into pre-tokens and looked up together.
BLOCK_CHARS = 1 << 20
#: Merged pre-tokens that a worker remembers before it starts afresh.
MEMO = 300_000
#: A vocabulary goes to every executor; one of more bytes is refused.
MAX_VOCAB_BYTES = 64 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


class MinimalPerfectHash:
    """n distinct keys onto 0..n-1 with one displacement for every bucket of about four keys.

    A bucket's displacement is the first that sends its keys to free slots; buckets of one key keep a free
    slot directly (as its negative). Large buckets are placed first.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        h = _hashes(keys)
        if len(np.unique(h)) < self.n:
            raise ValueError("the keys are not distinct")
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.n, bool)
        slot_of = np.zeros(self.n, np.int64)
        sizes = np.diff(starts)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            for d in range(1, 1 << 40, 64):
                tries = self._slots(h[own][:, None], np.arange(d, d + 64, dtype=np.int64)[None, :])
                free = ~taken[tries].any(0)
                for k in np.flatnonzero(free):
                    if len(set(tries[:, k].tolist())) == len(own):
                        break
                else:
                    continue
                self.shift[b], slot_of[own] = d + k, tries[:, k]
                taken[tries[:, k]] = True
                break
        for (b, key), slot in zip(singles, np.flatnonzero(~taken), strict=True):
            self.shift[b], slot_of[key] = -slot - 1, slot
        self.key_at: list[bytes] = [b""] * self.n
        for key, slot in zip(keys, slot_of.tolist(), strict=True):
            self.key_at[slot] = key
        self.slot_of = slot_of

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (_mixed(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, -1 for a key that is not one of the n."""
        if not keys or not self.n:
            return [-1] * len(keys)
        h = _hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(d < 0, -d - 1, self._slots(h, np.maximum(d, 0))).tolist()
        at = self.key_at
        return [s if at[s] == k else -1 for s, k in zip(slots, keys, strict=True)]


class Vocabulary:
    """Ranks of byte strings, with the pattern that splits a text before merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.hash = MinimalPerfectHash(keys)
        self.rank_at = [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.rank_at[slot] = ranks[key]
        self.pattern, self.ranks = pattern, ranks
        self.packed = {k: r.to_bytes(4, "little") for k, r in ranks.items()}
        self.token = {r: k for k, r in ranks.items()}
        self._split, self._merged = None, {}

    def __getstate__(self):
        return self.__dict__ | {"_split": None, "_merged": {}}

    def split(self, text: str) -> list[str]:
        if self._split is None:
            # White_Space is what the tokenizers' engine takes \s for; it holds no information separators
            self._split = regex.compile(self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        return self._split(text)

    def rank(self, parts: list[bytes]) -> list[int]:
        at = self.rank_at
        return [at[s] if s >= 0 else -1 for s in self.hash.lookup(parts)]

    def merge(self, piece: bytes) -> bytes:
        """Merge the bytes of one pre-token, lowest rank first and leftmost among equals; the ids packed.

        ``right`` and ``left`` link each part's first byte to the next and the previous part; a merged part's
        entry is len(piece). A heap entry holds rank, start and end of a possible merge in one integer.
        """
        n, get, pop, push = len(piece), self.ranks.get, heapq.heappop, heapq.heappush
        k = n.bit_length()
        low = (1 << k) - 1
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                heap.append((r << k | i) << k | i + 2)
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            end, i = x & low, x >> k & low
            gone = right[i]
            if gone >= n or right[gone] != end:
                continue  # one of its two parts has been merged since
            right[i], right[gone] = end, n
            before = left[i]
            if before >= 0 and (r := get(piece[before:end])) is not None:
                push(heap, (r << k | before) << k | end)
            if end < n:
                left[end] = i
                after = right[end]
                if (r := get(piece[i:after])) is not None:
                    push(heap, (r << k | i) << k | after)
        parts, i = [], 0
        while i < n:
            parts.append(self.packed[piece[i : right[i]]])
            i = right[i]
        return b"".join(parts)

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        distinct = list({p for parts in split for p in parts})
        as_bytes = [p.encode() for p in distinct]
        packed, merged = {}, self._merged
        if len(merged) > MEMO:
            merged.clear()
        for p, raw, r in zip(distinct, as_bytes, self.rank(as_bytes), strict=True):
            if r >= 0:
                packed[p] = r.to_bytes(4, "little")
            elif (ids := merged.get(raw)) is not None:
                packed[p] = ids
            else:
                packed[p] = merged[raw] = self.merge(raw)
        return [b"".join(map(packed.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_vocabulary(rank_file: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token, blank, rank on each line); every single byte must have a rank."""
    with open(rank_file, "rb") as f:
        body = f.read(MAX_VOCAB_BYTES + 1)
    if len(body) > MAX_VOCAB_BYTES:
        raise ValueError(f"{rank_file} has more than {MAX_VOCAB_BYTES} bytes")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, body.splitlines()) if a}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"{rank_file} lacks single bytes")
    return Vocabulary(ranks, pattern)


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about BLOCK_CHARS bytes of the column (one row at least)."""
    lengths = np.nan_to_num(np.array(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
    start, size = 0, 0.0
    for i, n in enumerate(lengths):
        if size and size + n > BLOCK_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0.0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids of every whole text.

    Returns the ``keep`` columns, ``n_tokens`` (bigint) and ``ids`` (binary: little-endian unsigned 32-bit
    integers). A null or empty text has no tokens. Repeated rows are encoded each; other columns of ``df``,
    whatever their names, are not read. No special tokens: their strings are ordinary text.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in _blocks(batch, "__text"):
                ids = v.encode_block([t or "" for t in part.column("__text").to_pylist()])
                out = [part.column(c) for c in keep] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [*keep, "n_tokens", "ids"])

    picked = df.select(*keep, F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in picked.select(*keep).dtypes) + ", n_tokens bigint, ids binary")


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the packed ids stand for; null ids give no bytes.

    An id outside the vocabulary raises. A column ``decoded`` that ``df`` already has is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in _blocks(batch, ids_col):
                out = [v.decode(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out, pa.binary())], [*kept, "decoded"])

    picked = df.select(*kept)
    return picked.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in picked.dtypes) + ", decoded binary")
