import random
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import cases, classes, compat, extract
from lexmill.operators import dedup, matching, privacy, relational, search, vectors
from lexmill.sources import files
from lexmill.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_blank_and_empty_differ(spark):
    rows = spark.createDataFrame([(None,), ("",), (" ",), ("a",)], "c string")
    got = rows.select(compat.filled_trim(F.col("c")).alias("t"), compat.filled_sql(F.col("c")).alias("s")).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (False, True), (True, True)]


def test_dates_and_days(spark):
    assert one(spark, compat.parse_dmy(F.lit("5/3/2026"))) == date(2026, 3, 5)
    assert one(spark, compat.parse_dmy(F.lit("31/02/2026"))) is None
    assert one(spark, cases.written_date(F.lit("dado el 15 de Marzo de 2026"))) == date(2026, 3, 15)
    early, late = F.lit("2026-01-03 11:00:00").cast("timestamp"), F.lit("2026-01-01 12:00:00").cast("timestamp")
    assert one(spark, compat.floor_days(early, late)) == 1
    assert one(spark, compat.floor_days(late, early)) == -2


def test_title_case_breaks_at_every_other_character(spark):
    assert one(spark, compat.title_case(F.lit("san gil-bogota d.c."))) == "San Gil-Bogota D.C."


def test_final_ruling_table(spark):
    table = {
        ("", "REVOCA"): "SIN FALLO", (None, None): "SIN FALLO", ("Concede", ""): "DESFAVORABLE", ("NIEGA", None): "FAVORABLE", ("DESISTIMIENTO", ""): "DESISTIMIENTO",
        ("CONCEDE PARCIALMENTE", "REVOCA"): "FAVORABLE", ("NIEGA", "REVOCA"): "DESFAVORABLE", ("IMPROCEDENTE", "Confirma"): "IMPROCEDENTE",
        ("X", "CONFIRMA"): "OTRO", ("NIEGA", "MODIFICA"): "MODIFICADO", ("NIEGA", "y"): "OTRO",
    }
    rows = spark.createDataFrame([(*k, v) for k, v in table.items()], "a string, b string, want string")
    assert rows.where(~cases.final_ruling(F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0


def test_identifiers(spark):
    court = "68001400300120240012300"
    assert one(spark, cases.short_id(F.lit(court))) == "2024-00123"
    assert one(spark, cases.spaced_id(F.lit(court))) == "68-001-40-03-001-2024-00123-00"
    assert [one(spark, cases.valid_filing(F.lit(x))) for x in ("3634740", "1111111", "6812345678", "123456", "1234567")] == [False, False, False, False, True]


def test_filing_is_no_telephone_number(spark):
    assert [one(spark, cases.valid_filing(F.lit(x))) for x in ("6076337000", "607 633 6100", "6076336000", "6076337001")] == [False, False, False, True]


def test_traffic_light(spark):
    now = F.lit(datetime(2026, 1, 10))
    light = lambda state, due: one(spark, cases.traffic_light(F.lit(state), F.lit(due).cast("timestamp"), now))
    assert [light("X", d) for d in ("2026-01-09", "2026-01-13", "2026-01-17", "2026-01-18", None)] == ["VENCIDO", "URGENTE", "POR_VENCER", "EN_PLAZO", "SIN_PLAZO"]
    assert light("CUMPLIDO", "2026-01-09") == "CUMPLIDO"


def test_waterfall_prefers_tier_then_smallest_id(spark):
    left = spark.createDataFrame([(1, "a", "z"), (2, "q", "z"), (3, None, None)], "m int, k1 string, k2 string")
    right = spark.createDataFrame([(20, "a", "z"), (10, "b", "z"), (30, "a", None)], "c int, r1 string, r2 string")
    got = relational.waterfall(left, right, "m", "c", [(F.col("k1"), F.col("r1")), (F.col("k2"), F.col("r2"))])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 20), (2, 2, 10)]
    guarded = relational.waterfall(left, right, "m", "c", [(F.col("k2"), F.col("r2"))], F.col("r1") == F.col("k1"))
    assert sorted(map(tuple, guarded.collect())) == [(1, 1, 20)]


def test_as_of_and_difference(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (3, 1, "z")], "k int, u int, v string")
    assert sorted(map(tuple, relational.as_of(a, b, "k", "t", "u", "v").collect()), key=str) == [(1, 1, None), (1, 5, "y"), (2, 9, None)]
    assert sorted(map(tuple, relational.two_way_difference(a, b, "k").collect())) == [(2, "left"), (3, "right")]


def test_greedy_clusters_follow_key_order(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.8, 0.6], 0), (3, [0.0, 1.0], 0), (4, [0.0, 1.0], 1)], "id int, v array<double>, b int")
    got = dedup.greedy_clusters(rows, "id", "v", "b", 0.75)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (2, 0, 1), (3, 0, 3), (4, 1, 4)]


def test_token_overlap_of_all_keys(spark):
    words = [["a b c", "c b a", "a b", "x", "a b b", "c d a", "", None, "d x c a"][i % 9] for i in range(250)]
    df = spark.createDataFrame(list(enumerate(words)), "id bigint, w string")
    sets = [set((w or "").split(" ")) if w is not None else set() for w in words]
    want = {(i, j, len(sets[i] & sets[j])) for j in range(250) for i in range(j) if len(sets[i] & sets[j]) >= 2}
    got = relational.token_overlap_by_set(df, "id", F.split("w", " "), 2).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pairs_of_keys_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK", 3)
    words = [["a b c", "a b", "a b d", "x"][i % 4] for i in range(60)]
    df = spark.createDataFrame([*enumerate(words), (5, "a b"), (5, "a b d")], "id bigint, w string")
    sets = sorted({(i, frozenset(w.split())) for i, w in [*enumerate(words), (5, "a b d")]}, key=lambda s: (s[0], sorted(s[1])))
    want = sorted((*sorted((i, j)), len(v & w)) for n, (i, v) in enumerate(sets) for j, w in sets[:n] if len(v & w) >= 2)
    got = relational.token_overlap_by_set(df, "id", F.split("w", " "), 2)
    assert sorted(map(tuple, got.collect())) == want
    # few bytes make many rows: the tasks that write them out are as many as shuffles have, not one for so many bytes
    assert got.rdd.getNumPartitions() == 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(y") < plan.index("Exchange") and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("rows", [7, 1024])
def test_cosine_pairs_of_all_vectors(spark, rows):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(98, [0.0] * 4, 0), (99, None, 1)], "id int, v array<double>, b int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for j in range(60) for i in range(j) if u[i] @ u[j] >= 0.7}
    got = vectors.cosine_pairs(df, "id", "v", 0.7, rows=rows).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)
    assert all(abs(r["similarity"] - u[r["a"]] @ u[r["b"]]) < 1e-12 for r in got)
    got = vectors.cosine_pairs(df, "id", "v", 0.7, "b", rows).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted((i, j) for i, j in want if i % 3 == j % 3)


def test_single_numbers_travel_as_they_are(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<float>").coalesce(1)
    pairs = vectors.cosine_pairs(df, "id", "v", 0.9995)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= 0.9995, 1))
    got = pairs.collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(zip(i.tolist(), j.tolist(), strict=True)) and len(got) > 10


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [" ".join(word() for _ in range(n)) for n in (45, 60, 1100)]
    texts = [None, "", "short"] + base + base[:2]
    for t in base:
        for k in (1, 2, 4, 8):
            w = t.split()
            w[-k:] = [word() for _ in range(k)]
            texts += [" ".join(w)] * (1 + k % 3)
    texts.append(base[2][:5000] + " " + " ".join(str(1000000 + i) for i in range(300)))  # differs after 5,000 characters
    sets = [{t.lower()[i : i + 3] for i in range(len(t) - 2)} if t and len(t) > 200 else set() for t in texts]
    n = len(texts)
    want = {(i, j, round(len(sets[i] & sets[j]) / max(len(sets[i]), len(sets[j])), 9)) for j in range(n) for i in range(j) if sets[i] and sets[j] and texts[i] != texts[j]}
    want = {x for x in want if x[2] > 0.9}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = dedup.similar_texts(df, "id", "t").collect()
    assert sorted((r["a"], r["b"], round(r["overlap"], 9)) for r in got) == sorted(want) and len(want) > 20


def test_pairs_of_near_copies_are_not_shuffled(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(words + [str(i)]).upper() if i % 7 == 0 else " ".join(words + [str(i)])) for i in range(500)] + [(1000 + i, " ".join(words)) for i in range(30)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before, kept = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dedup.similar_texts(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # all with each other but for the rows of one text; each text goes to a few places, not to one for each pair
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 530 * 529 // 2 - 30 * 29 // 2 and all(r["a"] < r["b"] for r in got)
    assert 0 < written() - before < 1_000_000


@pytest.mark.parametrize("least", [64, 1 << 21])
def test_cells_lose_no_pair(spark, monkeypatch, least):
    # many small cells, or one for each bin: the same pairs, once each, within blocks (null to null) and without
    monkeypatch.setattr(dedup, "LEAST_CELL", least)
    monkeypatch.setattr(dedup, "CELLS", 1 << 20)
    monkeypatch.setattr(dedup, "MOST_BINS", 1)
    monkeypatch.setattr(dedup, "ROWS", 7)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefg ") for _ in range(n)) for n in (230, 260, 300, 420, 900)]
    texts = [t[: rng.randrange(201, len(t))] if rng.random() < 0.8 else t + t[:k] for t in base for k in range(24)]
    rows = [(str(i), rng.choice(["x", "y", None]), t) for i, t in enumerate(texts)]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    near = {tuple(sorted((str(i), str(j)))) for j in range(len(texts)) for i in range(j) if texts[i] != texts[j] and len(sets[i] & sets[j]) / max(len(sets[i]), len(sets[j])) > 0.9}
    df = spark.createDataFrame(rows, "id string, b string, t string")
    assert sorted((r["a"], r["b"]) for r in dedup.similar_texts(df, "id", "t").collect()) == sorted(near) and len(near) > 100
    within = {(a, b) for a, b in near if rows[int(a)][1] == rows[int(b)][1]}
    assert sorted((r["a"], r["b"]) for r in dedup.similar_texts(df, "id", "t", block="b").collect()) == sorted(within) and len(within) > 30


def test_sketches_lose_no_pair_and_keep_few():
    rng = np.random.default_rng(8)
    # sets of one small vocabulary: some near to an earlier one, most to none
    sets = [np.sort(rng.choice(4000, rng.integers(300, 420), replace=False)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[int(rng.integers(0, 40)) :], rng.integers(4000, 5000, int(rng.integers(0, 20)))])) for s in sets[:60]]
    bits = [dedup.sketch(s.astype(np.int64), dedup.sketch_bits(np.log(len(s)))) for s in sets]
    block = pa.StructArray.from_arrays([pa.array([len(s) for s in sets]), pa.array([dedup.sketch(s.astype(np.int64), 1024).tobytes() for s in sets])], ["n", "bits"])
    other = pa.StructArray.from_arrays([pa.array([len(s) for s in sets]), pa.array([dedup.sketch(s.astype(np.int64), 512).tobytes() for s in sets])], ["n", "bits"])
    assert all(len(b) * 8 >= 2 * len(s) for b, s in zip(bits, sets, strict=True))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) > 0.9 * max(len(sets[i]), len(sets[j]))}
    got = set(zip(*(x.tolist() for x in dedup.near_sketches(block, block, 0.9, True)), strict=True))
    crossed = set(zip(*(x.tolist() for x in dedup.near_sketches(block, other, 0.9, False)), strict=True))
    assert len(want) > 20 and want <= got and want <= crossed and len(got) < 3 * len(want)


@pytest.mark.parametrize("block", [None, "b"])
def test_greedy_clusters_equal_the_loop(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    ids = rng.permutation(150) * 3
    df = spark.createDataFrame([(int(i), v.tolist(), int(i) % 2) for i, v in zip(ids, x)] + [(999, [0.0] * 3, 0)], "id int, v array<double>, b int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, seeds = {999: 999}, []
    for n in np.argsort(ids):
        near = [s for s in seeds if u[s] @ u[n] >= 0.8 and (block is None or ids[s] % 2 == ids[n] % 2)]
        want[int(ids[n])] = int(ids[near[0] if near else n])
        seeds += [] if near else [n]
    got = dedup.greedy_clusters(df, "id", "v", block, 0.8).collect()
    assert {r["id"]: r["seed"] for r in got} == want and len(got) == len(want) and 2 < len(seeds) < 100


def test_bm25_order(spark):
    docs = spark.createDataFrame([(1, "tutela salud"), (2, "Tutela tutela"), (3, "otra cosa"), (4, None), (5, "nada"), (6, "mas")], "id int, t string")
    got = [r["id"] for r in search.bm25(docs, "id", "t", ["tutela"]).orderBy("score").collect()]
    assert got == [2, 1]


def test_redaction_leaves_nothing_and_numbers_from_the_end(spark):
    docs = spark.createDataFrame([(1, 7, "a@b.com y c@d.org y A@B.com"), (2, 7, "c@d.org 1.234.567"), (3, 8, None)], "id int, case_id int, t string")
    mapping = privacy.vault(docs, "case_id", "id", "t")
    out = privacy.redact(docs, "case_id", "id", "t", mapping)
    got = {r["id"]: r["redacted"] for r in out.collect()}
    assert got == {1: "[EMAIL_1] y [EMAIL_2] y [EMAIL_1]", 2: "[EMAIL_2] [ID_1]", 3: None}
    assert out.select(privacy.gate(F.col("redacted")).alias("g")).where("g.email + g.id + g.number + g.phone > 0").count() == 0


def test_case_list_and_folders(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿RAD;NAME\n 1 ; PARTY_A \n2;\n", encoding="utf-8")
    known = spark.createDataFrame([("2",)], "RAD string")
    assert [tuple(r) for r in files.case_list(spark, str(tmp_path / "c.csv"), "RAD", known).collect()] == [("1", "PARTY_A")]
    (tmp_path / "tree/2024-00001 PARTY_A").mkdir(parents=True)
    (tmp_path / "tree/2024-00001 PARTY_A/x.PDF").write_bytes(b"1")
    (tmp_path / "tree/2024-00001 PARTY_A/x.exe").write_bytes(b"1")
    d = files.folder_documents(spark, str(tmp_path / "tree"), content=True)
    assert [r["extension"] for r in d.collect()] == ["pdf"]
    assert files.folder_fingerprints(d).count() == 1
    assert files.docx_text(d).first()["text"] is None


def test_stream_equals_batch_and_ingests_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i // 4, i % 4), "a" if i % 2 else "b", 1.0) for i in range(12)], "id int, ts timestamp, kind string, v double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = flows.file_stream(spark, str(tmp_path / "in"), rows.schema, 1)
    q = flows.usage(stream, "ts", "kind", "v").writeStream.format("memory").queryName("lexmill_usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("lexmill_usage").collect())) == sorted(map(tuple, flows.usage(rows, "ts", "kind", "v").collect()))
    for _ in range(2):
        flows.append_new(rows, 0, str(tmp_path / "out"), "id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_alerts_do_not_repeat(spark):
    found = spark.createDataFrame([(None, "x"), (1, "x"), (2, "y")], "case_id int, kind string")
    existing = spark.createDataFrame([(None, "x", "open"), (1, "x", "closed")], "case_id int, kind string, status string")
    assert sorted(map(tuple, flows.new_alerts(found, existing, ["case_id", "kind"]).collect())) == [(1, "x"), (2, "y")]


def test_document_and_mail_classes(spark):
    files_ = {
        "Respuesta incidente.docx": "DOCX_DESACATO", "contestación impugnación.DOCX": "DOCX_IMPUGNACION", "respuesta.doc": "DOCX_RESPUESTA", "x con forest.docx": "DOCX_RESPUESTA", "oficio.docx": "DOCX_CARTA",
        "aclaratoria.docx": "DOCX_MEMORIAL", "nota.docx": "DOCX_OTRO", "Email_1.md": "EMAIL_MD", "rv_x.pdf": "PDF_GMAIL", "AVOCA.pdf": "PDF_AUTO_ADMISORIO", "fallo.pdf": "PDF_SENTENCIA", "impugna.pdf": "PDF_IMPUGNACION",
        "desacato.pdf": "PDF_INCIDENTE", "email 3.pdf": "EMAIL_DB", "a.JPEG": "SCREENSHOT", "a.pdf": "PDF_OTRO",
    }
    rows = spark.createDataFrame(list(files_.items()), "f string, want string")
    assert rows.where(classes.document_class(F.col("f")) != F.col("want")).count() == 0
    mails = {"Correo enviado: fallo": "SALIENTE", "Desacato": "INCIDENTE_DESACATO", "fallo 2": "FALLO_2DA", "impugna": "IMPUGNACION", "Sentencia": "FALLO_1RA", "avoca": "AUTO_ADMISORIO", "traslado": "TRASLADO", "x requerimiento": "REQUERIMIENTO", "notifica": "NOTIFICACION", "tutela": "TUTELA_NUEVA", None: "OTRO"}
    rows = spark.createDataFrame(list(mails.items()), "s string, want string")
    assert rows.where(classes.mail_class(F.col("s")) != F.col("want")).count() == 0


def test_court_ids(spark):
    table = {
        "TUTELA 2026-00057 radicado 20260066132": (None, "2026-00057"), "numero de radicado 20260066132": (None, None), "T-00053/2026 x": (None, "2026-00053"), "Radicado No. 2026-030.": (None, "2026-00030"),
        "68001400300120240012300 RAD. 2025-00001": ("68001400300120240012300", "2024-00123"), "68001-40-09-027-2026-00034-00": ("68001-40-09-027-2026-00034-00", "2026-00034"), "": (None, None),
    }
    rows = spark.createDataFrame([(k, *v) for k, v in table.items()], "t string, a string, b string").withColumn("r", extract.court_ids(F.col("t")))
    assert [r for r in rows.collect() if (r["r"]["long_id"], r["r"]["short"]) != (r["a"], r["b"])] == []


def test_membership_of_documents(spark):
    own, other, pad = "68001400300120240012300", "68001400300120240099900", " texto" * 20
    case = ("2024-00123 ANA ROJAS", own, "Ana Rojas Mora")
    table = [
        ("Email_1.md", "x", *case, "OK"), ("a.pdf", "short", *case, "OK"), ("a.pdf", other + pad, "SIN NUMERO", own, "Ana Rojas Mora", "OK"), ("a.pdf", own + pad, *case, "OK"), ("a.pdf", other + pad, *case, "NO_PERTENECE"),
        ("respuesta rojas.pdf", pad * 3, *case, "OK"), ("a.pdf", "habla Rojas con MORA" + pad, *case, "OK"), ("auto 123.pdf", "2021-00456" + pad, *case, "OK"), ("a.pdf", "en 2024-123 dice" + pad, *case, "REVISAR"),
        ("a.pdf", "en 2024-123 dice" + pad, case[0], None, case[2], "OK"), ("a.pdf", "ver 2021-00456 aqui" + pad, *case, "NO_PERTENECE"), ("a.pdf", "ver 2021-00756 y 2012-352 y 2050-00300" + pad, *case, "OK"),
        ("FABRA TORRES RAUL.pdf", pad * 3, *case, "SOSPECHOSO"), ("sentencia tutela fallo.pdf", pad * 3, *case, "OK"),
    ]
    rows = spark.createDataFrame(table, "f string, t string, folder string, id string, name string, want string")
    got = rows.withColumn("got", extract.belongs(F.col("f"), F.col("t"), F.col("folder"), F.col("id"), F.col("name"))).collect()
    assert [(r["f"], r["t"][:20], r["got"], r["want"]) for r in got if r["got"] != r["want"]] == []


def test_matching_tiers_and_guards(spark):
    cases_ = [
        (1, "68001400300120240012300", "2024-00123 A", "20260000001", "Ana Rojas Mora", None, None, "COMPLETO"), (2, "68999400300120240012300", "2024-00124 B", None, "Personero de Giron", "CC 12345678", None, "COMPLETO"),
        (3, None, "2024-00124 C", None, "Luis Gil Peña", None, None, None), (4, None, None, None, "Pedro Pablo Acosta", None, None, "DUPLICATE_MERGED"),
    ]
    c = spark.createDataFrame(cases_, "id bigint, court_id string, folder string, filing string, claimant string, notes string, subject string, status string")
    new = [
        (1, "68001-40-03-001-2024-00123-01", None, None, None, None), (2, "68001990199120240012300", None, None, None, None), (3, None, None, None, "12345678", None), (4, None, None, "20260000001", None, None),
        (5, "68001990300120250000100", "2024-124", None, None, None), (6, None, "2024-00124", None, None, None), (7, None, None, None, None, "personera municipal de el GIRON"), (8, None, None, None, None, "LUIS GIL PEÑA"),
        (9, None, "2020-00001", None, None, "Luis Gil Peña"), (10, None, "2020-00001", None, None, "Pedro Pablo Acosta Ruiz de la Vega"), (11, None, None, None, None, "otro"), (12, None, None, None, None, None),
    ]
    n = spark.createDataFrame(new, "key bigint, court_id string, short string, filing string, person string, claimant string")
    got = {r["key"]: (r["tier"], r["case_id"]) for r in matching.match_cases(n, c).collect()}
    none = (None, None)
    assert got == {1: ("court_id", 1), 2: ("court_parts", 1), 3: ("person", 2), 4: ("filing", 1), 5: ("short", 3), 6: ("short", 2), 7: ("ombudsman", 2), 8: ("claimant", 3), 9: none, 10: none, 11: none, 12: none}


def test_sheets_markdown_and_settings(spark, tmp_path):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "n bigint, t string")
    paths = files.write_sheets({"cover": d, "data": d.limit(1)}, str(tmp_path / "book"))
    assert [spark.read.option("header", True).csv(p).count() for p in paths] == [2, 1]
    assert files.markdown_head(d.columns) + sorted(r["line"] for r in files.markdown_rows(d).collect()) == ["| n | t |", "|---|---|", "| 1 | a\\|b |", "| 2 |  |"]
    files.write_statistics(d, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    (tmp_path / "x.json").write_text('{"lawyers": ["Ana", " ", "Luz "]}')
    assert sorted(r["lawyers"] for r in files.settings_list(spark, str(tmp_path / "x.json"), "lawyers").collect()) == ["Ana", "Luz"]
    made = spark.createDataFrame([(f"s{i}", i) for i in range(10)], "name string, made int")
    assert sorted(r["name"] for r in files.expired_snapshots(made).collect()) == ["s0", "s1", "s2"]


def test_spans_equal_the_plain_search():
    rng = random.Random(12)
    pieces = ["3101234567", "ana@x.co", "1.234.567", "12345678", " ", ".", "x", "3101234567@y.com"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(12))
        taken = []
        for kind, pattern in privacy._COMPILED.items():
            for m in pattern.finditer(text):
                if not any(m.start() < e and s < m.end() for s, e, *_ in taken):
                    taken.append((m.start(), m.end(), kind, m.group()))
        assert privacy.find_spans(text) == sorted(taken)
