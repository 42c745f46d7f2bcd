"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed size. Equal blocks, brought together by a sort, get one integer name; then the
adjacent names of a document are paired, the pairs are sorted and named in turn, until one name is left. Names come from
comparisons of whole contents, so two documents have the same name and number of blocks if and only if their
texts are equal; no digest decides.

A document that holds a name found nowhere else is told from all others already and takes no part in further
rounds. Each level's blocks are put into dictionaries of bounded chunks first, so a block that very many
documents hold meets the sort once a chunk, and names come back to the chunks, not to single documents.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_staged, small_batches, staged

#: Bytes of a block.
BLOCK = 1024
#: What a chunk's dictionary holds at most: bytes of blocks, places of blocks. One document never spans two chunks.
CHUNK_BYTES, CHUNK_PLACES = 8 << 20, 1 << 18

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
_CHUNKS = "chunk bigint, local int, piece binary, places bigint, id bigint, digest binary, blocks bigint, own array<int>"
_NAMED = "id bigint, digest binary, blocks bigint, names array<bigint>, lone boolean"

Piece = tuple[int | None, bytes, int, list[bytes]]


def cut(text: bytes, size: int = BLOCK) -> list[bytes]:
    """Blocks of ``size`` bytes, the last one shorter; an empty text is one empty block."""
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def paired(names: np.ndarray) -> list[bytes]:
    """Adjacent names two by two as bytes; an odd last one is paired with -1, which names nothing."""
    even = np.append(names, -1) if len(names) % 2 else names
    packed = even.astype(">i8").tobytes()
    return [packed[i : i + 16] for i in range(0, len(packed), 16)]


def _blocks_of_texts(size: int) -> Callable[[pa.RecordBatch], Iterator[Piece]]:
    def run(batch: pa.RecordBatch) -> Iterator[Piece]:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            low = (text.as_py() or b"").translate(_LOWER)
            pieces = cut(low, size)
            yield key, hashlib.sha256(low).digest(), len(pieces), pieces

    return run


def _pairs_of_names(batch: pa.RecordBatch) -> Iterator[Piece]:
    names = batch.column("names")
    for i, (key, digest, blocks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "digest", "blocks")), strict=True)):
        yield key, digest, blocks, paired(names[i].values.to_numpy())


def _chunked(rows: DataFrame, pieces: Callable[[pa.RecordBatch], Iterator[Piece]]) -> DataFrame:
    """Two kinds of rows: (chunk, local, piece, places), the dictionary of a chunk, and (chunk, id, digest, blocks, own), its documents as local numbers."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32())]
    names = ["chunk", "local", "piece", "places", "id", "digest", "blocks", "own"]

    def table(chunk: int, known: dict[bytes, int], places: list[int], docs: list) -> pa.RecordBatch:
        n, m = len(known), len(docs)
        columns = [
            [chunk] * (n + m), [*range(n), *[None] * m], [*known, *[None] * m], [*places, *[None] * m],
            *([*[None] * n, *(d[k] for d in docs)] for k in range(4)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the table is written once and read by every later step, so the numbers need not come out the same in another attempt
        chunk, known, places, docs, held, total = TaskContext.get().partitionId() << 32, {}, [], [], 0, 0
        for batch in batches:
            for key, digest, blocks, own in pieces(batch):
                locals_ = []
                for p in own:
                    at = known.setdefault(p, len(known))
                    if at == len(places):
                        places.append(0)
                        held += len(p)
                    places[at] += 1
                    locals_.append(at)
                docs.append((key, digest, blocks, locals_))
                total += len(own)
                if held >= CHUNK_BYTES or total >= CHUNK_PLACES:
                    yield table(chunk, known, places, docs)
                    chunk, known, places, docs, held, total = chunk + 1, {}, [], [], 0, 0
        if docs:
            yield table(chunk, known, places, docs)

    return rows.mapInArrow(run, _CHUNKS)


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by piece: the piece's name, from the task's number and the rank, and whether it has one place only."""
    name, last, held = (TaskContext.get().partitionId() << 40) - 1, None, None
    for batch in batches:
        out = []
        for piece, chunk, local, places in zip(*(batch.column(c).to_pylist() for c in ("piece", "chunk", "local", "places")), strict=True):
            again = piece == last
            if held is not None:
                out.append((*held[:3], held[3] and not again))
            if not again:
                name, last = name + 1, piece
            held = (chunk, local, name, places == 1 and not again)
        yield _names(out)
    if held is not None:
        yield _names([held])


def _names(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "local", "name", "single"])


def _looked_up(docs: pa.Table, names: pa.Table) -> pa.Table:
    """The documents of a chunk with the names of their pieces; of those that a single name tells apart, the names are left out."""
    by = np.empty(names.num_rows, np.int64)
    single = np.empty(names.num_rows, bool)
    local = names["local"].to_numpy()
    by[local], single[local] = names["name"].to_numpy(), names["single"].to_numpy()
    own = docs["own"].combine_chunks()
    flat, offsets = own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
    lone = np.logical_or.reduceat(single[flat], offsets[:-1])
    lengths = np.diff(offsets)
    kept = by[flat][np.repeat(~lone, lengths)]
    left = np.concatenate([[0], np.cumsum(np.where(lone, 0, lengths))]).astype(np.int32)
    return pa.table({"id": docs["id"], "digest": docs["digest"], "blocks": docs["blocks"], "names": pa.ListArray.from_arrays(pa.array(left), pa.array(kept)), "lone": pa.array(lone)})


def _level(rows: DataFrame, pieces: Callable[[pa.RecordBatch], Iterator[Piece]]) -> DataFrame:
    """(id, digest, blocks, names, lone) of every row, after its pieces are named; staged."""
    chunks = _chunked(rows, pieces)
    chunks = staged(chunks, "chunks", compression="zstd")
    sorted_ = chunks.where("piece is not null").select("piece", "chunk", "local", "places").repartition("piece").sortWithinPartitions("piece", "chunk", "local")
    names = sorted_.mapInArrow(_ranked, "chunk bigint, local int, name bigint, single boolean")
    docs = chunks.where("piece is null").select("chunk", "id", "digest", "blocks", "own")
    named = staged(docs.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(_looked_up, _NAMED), "named")
    drop_staged(chunks)
    return named


def identities(df: DataFrame, text_col: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(id, digest, blocks, name): one row per row of ``df``; rows have equal (blocks, name) if and only if their texts are equal.

    A null ``name`` is that of a text which no other row has.
    """
    small_batches(df.sparkSession)
    level = _level(df.select(F.col(key).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")), _blocks_of_texts(block))
    done = []
    while True:
        ended = F.col("lone") | (F.size("names") == 1)
        done.append(level.where(ended).select("id", "digest", "blocks", F.when(~F.col("lone"), F.get("names", F.lit(0))).alias("name")))
        rest = level.where(~ended).select("id", "digest", "blocks", "names")
        if rest.isEmpty():
            break
        level = _level(rest, _pairs_of_names)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(df: DataFrame, text_col: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: ``key``, keep_id (largest key of the equal texts), group_size, kept (the key is it), text_sha256 (of the text in UTF-8).

    Texts are equal when identical after A-Z are lower-cased; null counts as empty, and empty texts are equal to each other.
    Texts of any length are read whole, a block at a time. Rows with the same key are counted each, and all of them stay if that key is the
    largest. A null key is smaller than all others; where all keys of a group are null, all its rows stay and keep_id is null. An empty table
    gives no rows; further columns are not read.
    """
    named = identities(df, text_col, key, block)
    shared = named.where("name is not null")
    groups = shared.groupBy("blocks", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    single = named.where("name is null").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    out = single.unionByName(shared.join(groups, ["blocks", "name"]).select("id", "digest", "keep_id", "group_size"))
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
