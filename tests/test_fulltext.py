"""The kept index against a plain scan of token lists."""

import random
import re
from datetime import datetime, timedelta

import pytest

from lexmill.functions import match
from lexmill.operators import fulltext
from lexmill.sources import files, versions

NOW = datetime(2026, 1, 1)


def tokens(text):
    return re.findall(r"[^\W_]+", match.fold(text or ""))


def begins(phrase, columns, names):
    out = []
    for c, name in enumerate(names):
        if phrase.column not in (None, name):
            continue
        own = columns[c]
        for i in range(len(own) if phrase.words else 0):
            if phrase.first and i:
                break
            said = own[i : i + len(phrase.words)]
            if len(said) == len(phrase.words) and all(t.startswith(w.text) if w.prefix else t == w.text for t, w in zip(said, phrase.words, strict=True)):
                out.append(c * match.COLUMN_STEP + i)
    return out


def plain(search, columns, names):
    if isinstance(search, match.Phrase):
        return bool(begins(search, columns, names))
    if isinstance(search, match.Both):
        return all(plain(p, columns, names) for p in search.parts)
    if isinstance(search, match.Either):
        return any(plain(p, columns, names) for p in search.parts)
    if isinstance(search, match.Without):
        return plain(search.wanted, columns, names) and not plain(search.unwanted, columns, names)
    places = [begins(p, columns, names) for p in search.phrases]
    for k, first in enumerate(search.phrases):
        for at in places[k]:
            if all(any(at <= x <= at + len(first.words) + search.within for x in other) for j, other in enumerate(places) if j != k):
                return True
    return False


QUERIES = [
    "uno", "uno dos", "uno AND dos", "uno OR dos", "uno NOT dos", '"uno dos"', "uno + dos tres", "tr*", '"uno dos" OR tres NOT cuatro', "(uno OR dos) (tres OR cuatro)", "NEAR(uno cuatro, 1)", 'NEAR("uno dos" tres, 2)',
    "NEAR(uno dos tres, 0)", "titulo : uno", "titulo : (uno OR dos) NOT texto : tres", "^dos", "Ñandú", "NANDU", "nada", '"" uno', "uno NOT dos OR tres NOT cuatro", 'NEAR(uno uno, 3)', "tres.cuatro",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    word = lambda: rng.choice(["uno", "dos", "tres", "cuatro", "trece", "Uno,", "TRES."])
    found = [(i, " ".join(word() for _ in range(rng.randrange(0, 12))), " ".join(word() for _ in range(rng.randrange(0, 3))), i % 3) for i in range(120)]
    return [*found, (200, None, None, 0), (201, "", "x", 1), (202, "el Ñandú corre", "uno", 2), (203, "uno " * 5000, "largo", 0), (204, "uno_dos uno-dos", "a", 1)]


def make(spark, rows):
    return spark.createDataFrame(rows, "id bigint, texto string, titulo string, kind int")


@pytest.mark.parametrize("merged", [False, True])
def test_searches_equal_a_scan(spark, rows, merged):
    index = fulltext.Index(spark, files.work_path(spark, "index"), ["texto", "titulo"], ["kind"], buckets=4)
    index.add(make(spark, [(i, "viejo uno", "uno", 0) if i % 4 == 0 else (i, x, y, k) for i, x, y, k in rows] + [(900, "uno dos tres", "uno", 0)]), NOW)
    index.add(make(spark, [r for r in rows if r[0] % 4 == 0]), NOW, gone=spark.createDataFrame([(900,)], "id bigint"))
    if merged:
        index.merge(NOW)
    held = {i: ([tokens(x), tokens(y)], k) for i, x, y, k in rows}
    for query in QUERIES if merged else QUERIES[:8]:
        wanted = match.parse(query)
        want = {i for i, (columns, _) in held.items() if plain(wanted, columns, ["texto", "titulo"])}
        got = index.search(query, 1000).collect()
        assert {r["id"] for r in got} == want, query
        assert all(r["rank"] < 0 for r in got)
    totals = {r["term"]: (r["tf"], r["df"]) for r in index.term_totals().collect()}
    every = [t for columns, _ in held.values() for c in columns for t in c]
    assert totals == {t: (every.count(t), sum(t in c[0] + c[1] for c, _ in held.values())) for t in set(every)}


def test_snippets_and_best_rows(spark, rows):
    index = fulltext.Index(spark, files.work_path(spark, "index"), ["texto", "titulo"], ["kind"])
    index.add(make(spark, rows), NOW)
    best = index.search("nandu", 5, size=3, lead=1).first()
    assert (best["id"], best["snippet"]) == (202, "el <b>nandu</b> corre")
    from pyspark.sql import functions as F

    only = {r["id"] for r in index.search("uno", 1000, F.col("kind") == 1).collect()}
    assert only and all(i in (201, 204) or i % 3 == 1 for i in only)
    assert index.search("uno", 1).count() == 1


def test_a_search_reads_its_buckets_only(spark, rows):
    index = fulltext.Index(spark, files.work_path(spark, "index"), ["texto"], buckets=16)
    index.add(make(spark, rows), NOW)
    plan = index.places([match.Word("uno")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "EqualTo(term,uno)" in plan


def test_postings_are_blocks(spark):
    # what is shuffled and kept grows with the terms of a batch, not with the terms of each row
    rows = [(i * 7, "uno dos uno" if i % 2 else "dos tres") for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, texto string").coalesce(1)
    blocks = fulltext.postings(df, "id", ["texto"])
    assert blocks.count() == 3
    assert {r["term"]: (r["tf"], r["df"]) for r in blocks.collect()} == {"uno": (600, 300), "dos": (600, 600), "tres": (300, 300)}
    got = sorted((r["term"], r["id"], r["position"]) for r in fulltext._each(blocks, "term").collect())
    assert got == sorted((w, i, k) for i, x in rows for k, w in enumerate(x.split()))


def test_postings_are_blocks_of_more_than_a_batch(spark):
    # a block holds what a task reads together, however it comes in
    rows = [(5000 - i * 7, "uno dos uno" if i % 2 else "dos tres", "uno" if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, texto string, titulo string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        blocks = fulltext.postings(df, "id", ["texto", "titulo"])
        assert blocks.count() == 3 and dict(blocks.dtypes)["places"] == "binary"
        got = sorted((r["term"], r["id"], r["position"]) for r in fulltext._each(blocks, "term").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((w, i, k + c * fulltext.COLUMN_STEP) for i, *texts in rows for c, x in enumerate(texts) for k, w in enumerate((x or "").split()))


def test_tokens_equal_terms(spark):
    import pyarrow as pa

    from lexmill.operators import search

    texts = [None, "", " ", "Año ÑANDÚ,x-1_b", "ΑΣ'Α ΟΔΟΣ", "ΑΣ", "İstanbul ǅ", "a", "...", "日本 語x", "e\u0301 x\u00aa", "x" * 70, "a\nb\0c", "uno dos Uno", "½ ²3"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [r["w"] for r in df.orderBy("i").select(search.terms(df["t"]).alias("w")).collect()]
    column = pa.array(["skipped", *texts], pa.string())[1:]
    row, place, number, known = search.tokens(column)
    got = [[] for _ in texts]
    for r, k, t in zip(row.tolist(), place.tolist(), number.tolist(), strict=True):
        assert k == len(got[r])
        got[r].append(known[t].as_py())
    assert got == want
    assert df.select("i", fulltext._n_tokens("t", "t").alias("n")).orderBy("i").toArrow().column("n").to_pylist() == [2 * len(w) for w in want]


def test_packed_numbers():
    import numpy as np

    rng = np.random.default_rng(3)
    values, n = np.r_[0, 127, 128, 2**62, rng.integers(0, 1 << 40, 995), 5], np.array([1, 4, 990, 5])
    assert (fulltext.unpacked(fulltext.packed(values, n)) == values).all()
    assert [fulltext.unpacked(fulltext.packed(values, n)[i : i + 1]).size for i in range(4)] == n.tolist()
    assert not len(fulltext.unpacked(fulltext.packed(values[:0], n[:0])))


@pytest.mark.parametrize("wrong", ["(uno", "uno )", "AND uno", "NEAR(uno, dos)", "uno OR", '"uno'])
def test_queries_without_meaning(wrong):
    with pytest.raises(ValueError):
        match.parse(wrong)


def test_an_empty_index(spark):
    index = fulltext.Index(spark, files.work_path(spark, "index"), ["texto"])
    index.add(spark.createDataFrame([], "id bigint, texto string"), NOW)
    assert index.search("uno").count() == 0


def test_versions(spark):
    root, made = files.work_path(spark, "versions"), []
    table = lambda i: spark.range(i + 1)
    for i in range(10):
        v = versions.commit(spark, root, {"t": table(i)}, NOW + timedelta(minutes=20 * i))
        made.append(v and v.number)
    assert made == [1, None, 2, None, 3, None, 4, None, 5, None]  # every second one is too young
    for i in range(10, 20):
        versions.commit(spark, root, {"t": table(i)}, NOW + timedelta(hours=i))
    assert [v.number for v in versions.versions(spark, root)] == list(range(9, 16))
    assert versions.read(spark, root, "t").count() == 20 and versions.read(spark, root, "t", 9).count() == 14
    # a write that never came to its manifest is not read, and goes with the next prune
    versions.write_folders(root, {"t": table(0)})
    assert versions.read(spark, root, "t").count() == 20
    assert versions.restore(spark, root, 10, NOW).number == 16
    assert versions.read(spark, root, "t").count() == 15
    versions.prune(spark, root, 3)
    assert versions.read(spark, root, "t").count() == 15 and len(versions.versions(spark, root)) == 3
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root + "x", "t")


def test_two_roots(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id bigint, x string, y int")
    b = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1)], "id bigint, x string, y int")
    assert {tuple(r) for r in versions.compare(a, b, "id", ["x", "y"]).collect()} == {(2, "changed"), (3, "only_first"), (4, "only_second")}
