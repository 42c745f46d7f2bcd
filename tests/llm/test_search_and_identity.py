"""Exact dedup, hard negatives and ranked search against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import exactdedup, hardneg, lexical

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    """Columns with the names that the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in ("id", "name", "names", "blocks", "chunk", "piece", "digest", "score", "rank", "shard", "list", "targets", "least")})


# exact dedup --------------------------------------------------------------------------------------------------------


def brute_identities(rows):
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(ASCII_LOWER), []).append(key)
    out = []
    for key, text in rows:
        low = (text or "").translate(ASCII_LOWER)
        known = [k for k in groups[low] if k is not None]
        keep = max(known) if known else None
        out.append((key, keep, len(groups[low]), key == keep, hashlib.sha256(low.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [3, 1024])
def test_identities_equal_plain_grouping(spark, block):
    rng = random.Random(block)
    texts = [None, "", "", " ", "A", "a", "Ä", "ä", "ab", "ba", "abc", "abcabc", "abcabcabc", "abcabd", "x" * 3000, "X" * 3000, "x" * 3001, "x" * 2999 + "y", "a\x00b", "日本語" * 40, "日本語" * 40]
    texts += ["".join(rng.choice("aB") for _ in range(rng.randrange(1, 9))) for _ in range(300)]  # few blocks, many equal texts
    texts += ["no " * 700] * 200  # one group holds a third of all rows
    rows = [*enumerate(texts), (None, "a"), (None, "only without a key"), (None, "only without a key"), (5, "a"), (7, "other text of a key")]
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = exactdedup.exact_duplicates(df, block=block)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_identities(rows)


def test_identities_of_no_rows(spark):
    assert exactdedup.exact_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_blocks_and_pairs():
    assert exactdedup.cut(b"") == [b""]
    assert exactdedup.cut(b"abcde", 2) == [b"ab", b"cd", b"e"]
    assert len(exactdedup.paired(np.array([1, 2, 3]))) == 2
    assert exactdedup.paired(np.array([1, 2]))[0] != exactdedup.paired(np.array([2, 1]))[0] != exactdedup.paired(np.array([2]))[0]


# hard negatives -----------------------------------------------------------------------------------------------------


def brute_negatives(rows, every, scale=256, positives=5, negatives=10):
    valid = []
    for key, x, label in rows:
        if key is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        a = [math.floor(c * scale) for c in x]
        if math.sqrt(sum(c * c for c in a)) < 2**31:
            valid.append((key, a, label))
    out = []
    for key, a, label in valid:
        if key % every:
            continue
        scored = [(-sum(p * q for p, q in zip(a, b, strict=True)), k, m) for k, b, m in valid if len(a) == len(b)]
        for minus, p, _ in sorted(x for x in scored if x[2] == label and x[1] != key)[:positives]:
            score = -minus
            found = sorted((s, k) for s, k, m in scored if m != label and 30 * score <= -100 * s <= 90 * score)
            out += [(key, p, i + 1, k, score, -s) for i, (s, k) in enumerate(found[:negatives])]
    return sorted(out)


def vectors(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    return [(i, [float(np.float32(c)) for c in 0.4 * centers[rng.integers(6)] + 0.15 * rng.normal(size=dims)], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    # several rounds of visits over many small lists, lists and anchors in several blocks
    monkeypatch.setattr(hardneg, "FIRST_VISITS", 2)
    monkeypatch.setattr(hardneg, "FACTOR", 3)
    monkeypatch.setattr(hardneg, "LIST_BLOCK", 16)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 4)
    rows = vectors(600, seed)
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(250)]  # a third of all vectors are equal: ties, one hot list
    rows += [(2000, None, 1), (2010, [], 1), (2020, [0.1, None, *[0.2] * 6], 1), (2030, [math.nan] * 8, 1), (2040, [math.inf] * 8, 1), (2050, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2060, [0.0] * 8, 1), (2070, [1e12] * 8, 1), (2080, [0.3] * 3, 1), (2090, [0.4] * 3, 1), (2091, [0.2] * 3, 2)]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3))
    got = hardneg.mine(df, every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_negatives_of_large_components(spark):
    rows = [(i, [x * 2.0**20 for x in v], label) for i, v, label in vectors(80, 3)]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), every=10)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_negatives_beyond_the_fitted_widths(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "FITTED_WIDTHS", 1)
    rows = vectors(90, 4) + [(i + 100, v, label) for i, v, label in vectors(60, 5, 5)] + [(i + 200, v, label) for i, v, label in vectors(40, 6, 3)]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), every=10)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10)


def test_negatives_of_no_rows(spark):
    assert hardneg.mine(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_bounds_hold_and_lists_are_left_out(spark):
    rows = vectors(400, 7)
    index = hardneg.Index(hardneg._vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), "vec_id", "embedding", "label", 256))
    c, radius = index.model[8], index.radii[8]
    listed = index.rows.collect()
    x = np.array([np.frombuffer(r["v"], "<i4") for r in listed], float)
    low, high = hardneg._bounds(x[:20], c, radius)
    at = np.array([r["list"] for r in listed])
    scores = hardneg.products(x[:20], x)
    assert (scores >= low[:, at]).all() and (scores <= high[:, at]).all()
    best = np.sort(scores, axis=1)[:, -10]
    assert (high < best[:, None]).mean() > 0.3  # so many visits are saved


# ranked search ------------------------------------------------------------------------------------------------------


def brute_ranks(docs, items, k=10):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    held = [(i, find(t)) for i, t in docs if i is not None]
    held = [(i, t) for i, t in held if t]
    count, total = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = set(find(text))
        scored = []
        for i, t in held:
            m = 10 + (90 * len(t) * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in asked if x in t)
            if s > 0:
                scored.append((-s, i))
        out += [(item, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("limit", [lexical.MAX_VOCABULARY, 3])
def test_search_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lexical, "LEAF", 16)
    monkeypatch.setattr(lexical, "SHARD", 24)
    monkeypatch.setattr(lexical, "SAMPLE", 200)
    monkeypatch.setattr(lexical, "FIRST_VISITS", 1)
    monkeypatch.setattr(lexical, "FACTOR", 2)
    monkeypatch.setattr(lexical, "ITEM_BLOCK", 2)
    monkeypatch.setattr(lexical, "MAX_VOCABULARY", limit)  # with 3, all terms are indexed
    rng = random.Random(9)
    topics = [[f"{a}{b}" for b in range(30)] for a in "pqrst"]
    docs = [(i, " ".join(rng.choice(topics[i % 5]) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a third of all are equal: ties by doc_id
    docs += [(2000, None), (2001, ""), (2002, " .,;\n"), (2003, "p1 " * 20_000), (2004, "Ñandú ÑANDÚ ñandú niño"), (None, "p1 p2"), (2005, "q1\x00Q2-q3_q4"), (2006, "日本 p1")]
    items = [(0, "p1 P2 p3 p3"), (1, docs[3][1]), (2, "nothing here"), (3, ""), (4, None), (5, "Ñandú q1 q2"), (6, "r1 s1 t1 日本"), (7, "p0 q0 r0 s0 t0")]
    got = lexical.search(clashing(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)), spark.createDataFrame([*items, (None, "p1")], "item_id bigint, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_ranks(docs, items)


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(one, items.limit(0)).count() == 0
    assert [tuple(r) for r in lexical.search(one, items).collect()] == [tuple(r) for r in brute_ranks([(1, "a b")], [(1, "a")])]


def test_bisection_gathers_topics():
    rng = random.Random(3)
    docs = [list({f"{'ab'[i % 2]}{rng.randrange(40)}".encode() for _ in range(12)}) for i in range(200)]
    tree = lexical.bisect(docs, 1)
    leaves = tree.leaves(docs)
    sides = [sum(leaves[i] for i in range(k, 200, 2)) for k in (0, 1)]
    assert sorted(sides) == [0, 100]
    unseen = [list({f"{'ab'[i % 2]}{rng.randrange(40)}".encode() for _ in range(12)}) for i in range(100)]
    placed = tree.leaves(unseen)
    assert all(placed[i] == leaves[i % 2] for i in range(100))
    assert lexical.bisect([], 2).leaves([[b"a"], []]).tolist() == lexical.bisect([], 2).leaves([[], []]).tolist()


def test_impacts_in_whole_numbers():
    big = lexical.impacts(np.array([3]), np.array([10**10]), 10**9, 10**12)
    m = 10 + (90 * 10**10 * 10**9) // 10**12
    assert big.tolist() == [(10**9 * 3) // (1000 * 3 + 8 * m)]
