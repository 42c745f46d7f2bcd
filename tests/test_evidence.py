"""The catalogue's self-tests, spans against plain loops, vaults and restoring."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import patterns
from lexmill.operators import extraction, redaction
from lexmill.operators.redaction import Span

#: name, text, value (None: no match)
SELF_TESTS = [
    ("radicado_23_continuous", "RAD 68001400902720260003400", "68001400902720260003400"), ("radicado_23_continuous", "RAD 12345", None),
    ("radicado_23_separators", "68001-40-09-027-2026-00034-00", "68001-40-09-027-2026-00034-00"), ("radicado_23_separators", "686694089001 – 2026 – 00060 – 00", "686694089001 – 2026 – 00060 – 00"),
    ("radicado_23_separators", "686694089001-2026-00060-00", "686694089001-2026-00060-00"), ("radicado_23_separators", "123456789", None),
    ("radicado_t_format", "T-00053/2026", "2026-00053"), ("radicado_t_format", "T123", None),
    ("radicado_label", "RAD. 2026-00095", "2026-00095"), ("radicado_label", "Radicado No. 2026-030", "2026-00030"), ("radicado_label", "RADICADO: 2026-00115", "2026-00115"), ("radicado_label", "Rad. 2026-00057", "2026-00057"),
    ("radicado_label", "texto sin radicado", None), ("radicado_label", "numero de radicado 20260066132", None), ("radicado_label", "con número de radicado 20260069467", None), ("radicado_label", "radicado 20260066132", None),
    ("radicado_generic", "caso 2026-00095", "2026-00095"), ("radicado_generic", "ref 2026-030 ok", "2026-00030"), ("radicado_generic", "fecha 2026", None), ("radicado_generic", "radicado 20260066132", None), ("radicado_generic", "20260069467", None),
    ("forest_specific", "El número de radicado es 20260054965", "20260054965"), ("forest_specific", "Radicado judicial 68001400900", None),
    ("forest_keyword", "FOREST: 20260024347", "20260024347"), ("forest_keyword", "Forest No. 2695882", "2695882"), ("forest_keyword", "FOREST sin numero", None),
    ("accionante_explicit", "ACCIONANTE: PARTE ALFA BETA", "PARTE ALFA BETA"), ("accionante_explicit", "accionante: Parte Alfa contra la entidad", "Parte Alfa"), ("accionante_explicit", "sin accionante aqui", None),
    ("accionante_demandante", "Demandante: PARTE GAMA DELTA", "PARTE GAMA DELTA"), ("accionante_promovida", "promovida por el señor PARTE EPSILON ZETA", "PARTE EPSILON ZETA"),
    ("personero_municipio", "Personero Municipal de Guavatá", "Guavatá"), ("personero_municipio", "Personera del Socorro en calidad de agente", "Socorro"), ("personero_municipio", "Juez de Bucaramanga", None),
    ("abogado_footer", "Proyectó: Letrado Uno Dos", "Letrado Uno Dos"), ("abogado_footer", "Revisó. Letrado Tres\notra línea", "Letrado Tres"),
    ("cc_accionante", "C.C. 1077467661", "1077467661"), ("cc_accionante", "identificada con documento: 91071881", "91071881"), ("cc_accionante", "cédula de ciudadanía No. 1005461409", "1005461409"), ("cc_accionante", "telefono 3204992211", None),
    ("tutela_online_no", "Tutela en Línea con número 3645440", "3645440"), ("tutela_online_no", "Generación de Tutela en línea No 3722226", "3722226"), ("tutela_online_no", "Tutela 2026-00057", None),
    ("acta_reparto_no", "ACTA DE REPARTO CIVIL No. 148", "148"), ("expediente_disciplinario", "Expediente No. 160-25", "160-25"), ("nuip_menor", "Registro Civil No. 1130104808", "1130104808"),
]


@pytest.mark.parametrize(("name", "text", "value"), SELF_TESTS)
def test_catalogue(name, text, value):
    found = [patterns.value_of(p, m) for p, m in patterns.finder((name,)).matches(text)]
    if value is None:
        assert not found or name == "accionante_explicit" and found[0] == ""
    else:
        assert found[0] == value


def test_every_pattern_has_a_self_test_and_what_it_needs():
    assert len(patterns.CATALOGUE) == 17 == len({p.name for p in patterns.CATALOGUE}) == len({n for n, _, v in SELF_TESTS if v})
    rng = random.Random(1)
    said = [t for _, t, _ in SELF_TESTS]
    for _ in range(300):  # the automaton leaves out no pattern that matches
        text = " ".join(rng.choice(said) if rng.random() < 0.5 else rng.choice(["de la", "20", "T-1", "ÍNDICE", "İ"]) for _ in range(6))
        got = [(p.name, m.span()) for p, m in patterns.finder().matches(text)]
        assert got == [(p.name, m.span()) for p in patterns.CATALOGUE for m in re.finditer(p.regex, text)]


def test_found_values_and_best_fields(spark):
    docs = [(1, 7, "a.pdf", "Rad. 2026-00057 y FOREST: 2026002"), (2, 7, "auto.pdf", "x T-00053/2026 68001-40-09-027-2026-00034-00"), (3, 7, "b.pdf", "68001400902720260003401"), (4, 8, "c.pdf", None), (5, 8, "d.pdf", ""), (6, 8, "e.pdf", "y " * 50_000 + "Expediente 160-25")]
    df = spark.createDataFrame(docs, "id bigint, case_id bigint, filename string, text string")
    found = extraction.found_values(df, "id", "text")
    for r in found.collect():
        text = docs[r["id"] - 1][3]
        assert text[r["start"] : r["end"]].lstrip("0") in r["value"] or r["field"] in ("claimant", "city")
    best = {(r["case_id"], r["field"]): (r["value"], r["confidence"], r["id"]) for r in extraction.best_fields(found, df, "id", "case_id", F.when(F.col("filename") == "auto.pdf", 1).otherwise(5)).collect()}
    assert best[7, "court_id"] == ("68001-40-09-027-2026-00034-00", 85, 2)  # the document of the first class before the better pattern
    assert best[7, "short_id"] == ("2026-00053", 85, 2)
    assert best[8, "file_id"] == ("160-25", 85, 6)


def plain_settled(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s.start, -(s.end - s.start))):
        if kept and s.start < kept[-1].end:
            old = kept[-1]
            a, b = ({"known": 3, "pattern": 2, "model": 1}[x.source] for x in (s, old))
            wins = a > b if a != b else s.score > old.score if abs(s.score - old.score) > 0.05 else s.end - s.start > old.end - old.start
            if wins:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def test_settled_equals_a_plain_loop():
    rng = random.Random(2)
    for _ in range(500):
        spans = []
        for _ in range(rng.randrange(12)):
            start = rng.randrange(40)
            spans.append(Span(start, start + rng.randrange(1, 12), "CC", "x", rng.choice([0.75, 0.8, 0.9, 0.95, 1.0]), rng.choice(["known", "pattern", "model"])))
        got = redaction.settled(spans)
        assert got == plain_settled(spans)
        assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize(
    ("text", "kept"),
    [
        ("cédula 63498732 de la parte", True), ("NIT 890201235-6", False), ("cédula 20241206", False), ("C.C. 123456", False), ("folios: 12, cédula 63498732", False), ("T.P. No. 63498732", False), ("Resolución No. 9 y C.C. 63498732", False),
        ("C.C. 63498732 de 2024", False), ("C.C. 63498732.pdf", False), ("C.C. 63498732-6", False), ("cédula No. 1.096961643", True), ("Tercero: 49736592 PARTE ALFA", True), ("x" * 60 + " C.C. 63498732", True),
        ("folios: 1 " + "x" * 60 + " C.C. 63498732", True),
    ],
)
def test_what_stands_around_a_number(text, kept):
    assert any(s.kind == "CC" for s in redaction.pattern_spans(text)) is kept


def test_known_values():
    known = [("PERSON", "Parte Alfa"), ("PERSON", "Alfa"), ("CC", "63498732"), ("PERSON", "ab"), ("PERSON", "aba")]
    text = "PARTE ALFA y alfa, 63498732; ababa"
    got = redaction.settled(redaction.known_spans(text, known))
    assert [(s.start, s.value) for s in got] == [(0, "PARTE ALFA"), (13, "alfa"), (19, "63498732"), (29, "aba")]
    assert sorted(s.value for s in redaction.known_spans("İ Parte Alfa", known)) == ["Alfa", "Parte Alfa"]
    assert redaction.known_spans(None, known) == [] == redaction.known_spans("x", [])


DOCS = [
    (1, 1, "primero ana@x.gov.co luego C.C. 63498732, al fin bob@y.edu.co"), (2, 1, "C.C. 63498732 otra vez y Registro Civil No. 1130104808; Parte Alfa"), (3, 2, "C.C. 63498732"), (4, 2, None), (5, 2, ""),
    (6, 1, "Registro Civil No. 1130104809 y Registro Civil No. 1130104808, 3101234567, 3101234568"), (7, 1, "La Entidad Pública " + "x " * 60_000 + "PARTE ALFA"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame(DOCS, "id bigint, case_id bigint, text string").withColumn("start", F.lit("clash"))
    known = spark.createDataFrame([(1, "PERSON", "Parte Alfa"), (1, "PERSON", "LA ENTIDAD PUBLICA")], "case_id bigint, kind string, value string")
    return df, redaction.detected(df, "id", "case_id", "text", known, public=("la entidad pública",))


def test_vault_and_tokens(spark, found):
    vault = {(r["case_id"], r["value"]): r["token"] for r in redaction.minted(found[1], "id", "case_id", b"k").collect()}
    assert vault[1, "63498732"] == "[CC_####8732]" == vault[2, "63498732"]
    assert (vault[1, "ana@x.gov.co"], vault[1, "bob@y.edu.co"]) == ("[EMAIL_GOV]", "[EMAIL_EDU]")
    # numbered from the end of each document, documents in order; the name as first met
    assert (vault[1, "1130104808"], vault[1, "1130104809"], vault[1, "Parte Alfa"]) == ("[NUIP_MENOR_1]", "[NUIP_MENOR_2]", "[ACCIONANTE_1]")
    assert not any("ENTIDAD" in v.upper() for _, v in vault)
    a, b = (redaction.value_hash(b"k", c, "CC", " 63498732 ") for c in (1, 2))
    assert a != b and len(a) == 24 and a == redaction.value_hash(b"k", 1, "CC", "63498732") != redaction.value_hash(b"j", 1, "CC", "63498732")


def test_redacted_and_restored(spark, found):
    df, spans = found
    vault = redaction.minted(spans, "id", "case_id", b"k", counted=True)
    kept = redaction.unlocked(redaction.locked(vault, b"k"), b"k")
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in vault.collect()}
    assert b"63498732" not in b"".join(bytes(r["value"]) for r in redaction.locked(vault, b"k").collect())
    hidden = redaction.redacted(df, "id", "case_id", "text", spans, vault, b"k")
    rows = {r["id"]: r["redacted"] for r in hidden.collect()}
    assert rows[4] is None and rows[5] == "" and "63498732" not in "".join(filter(None, rows.values()))
    back = {r["id"]: r["redacted"] for r in redaction.restored(hidden, "case_id", "redacted", vault).collect()}
    # values come back as first met in the case
    assert {i: (t or "").lower() for i, t in back.items()} == {i: (t or "").lower() for i, _, t in DOCS}


def test_restored_in_json(spark):
    vault = spark.createDataFrame([(1, "PERSON", "h", 'Parte "Alfa"\n', "[PERSONA_1]"), (2, "PERSON", "h", "otra", "[PERSONA_1]")], "case_id bigint, kind string, hash string, value string, token string")
    said = {"a": ["[PERSONA_1]", {"b": "x [PERSONA_1] [PERSONA_9] [P"}], "[PERSONA_1]": None}
    df = spark.createDataFrame([(1, json.dumps(said)), (2, json.dumps(said)), (3, json.dumps(said)), (1, None)], "case_id bigint, said string")
    got = [r["said"] and json.loads(r["said"]) for r in redaction.restored(df, "case_id", "said", vault, as_json=True).orderBy("case_id", F.desc_nulls_last("said")).collect()]
    want = lambda v: {"a": [v, {"b": f"x {v} [PERSONA_9] [P"}], v: None}
    assert got == [want('Parte "Alfa"\n'), None, want("otra"), said]


def test_zones_equal_plain_searches_and_are_sought_once(spark):
    from lexmill.operators import casefile

    rng = random.Random(4)
    said = ["JUZGADO 1 de", "Corte del ", "Radicado No. 1", "accionante:", "DEMANDADA.", "HECHOS:", "SÍNTESIS DE LOS HECHOS.", "primero.", "\nPRIMERO:", "solicita", "Pido al despacho", "derechos fundamentales invocados", "alegando vulneración de"]
    said += ["ADMÍTASE", "admiTASE ", "R e s\nU E L V E", "FALLO ", "Fallar", "NIÉGA ", "niega ", "NIéGAS ", "tutelar ", "IMPUGNACIÓN ", "ad  quem", "desacato ", "Auto de apertura", "NOTIFÍQUESE", "cÚmplase ", " x ", "\n"]
    texts = [None, "", *("".join(rng.choice(said) for _ in range(rng.randrange(9))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = [(z, F.coalesce(*(F.nullif(F.regexp_instr(F.coalesce("text", F.lit("")), F.lit(p)), F.lit(0)) for p in openings))) for z, openings in casefile.ZONES.items()]
    want = {r["id"]: sorted((r[z], z) for z, _ in plain if r[z]) for r in df.select("id", *(c.alias(z) for z, c in plain)).collect()}
    zones = df.select("id", casefile.zones(F.col("text")).alias("z"))
    assert {r["id"]: [(z["start"], z["zone"]) for z in r["z"]] for r in zones.collect()} == want
    # each opening stands once in the plan, not once more for the ends of zones
    plan = zones._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr(") == sum(map(len, casefile.ZONES.values()))


def test_prompts_have_all_documents_of_a_case(spark):
    from lexmill.operators import casefile

    # more than two million characters in the zones of one case, one more document behind them, and mails after those
    docs = spark.range(5).selectExpr("7L as case_id", "id", "concat(id, '.pdf') as filename", "concat('RESUELVE ', case when id < 4 then repeat('x', 600000) else 'last' end) as text")
    cases = spark.createDataFrame([(7, "folder", "Ana"), (8, None, "")], "id bigint, folder string, claimant string")
    mails = spark.createDataFrame([(1, 7, "s", "a@b", None, "b")], "id bigint, case_id bigint, subject string, sender string, received timestamp, body string")
    got = {r["case_id"]: r["prompt"] for r in casefile.prompts(casefile.documents(docs, F.lit(1), F.lit("pdf")), cases, mails, ["claimant"]).collect()}
    said = "\n".join(f"\n=== {i}.pdf [pdf] ===\n[resolves] RESUELVE " + ("x" * 600000 if i < 4 else "last") for i in range(5))
    assert got == {7: "CASO: folder\n\nCAMPOS:\n  claimant: Ana\n" + said + "\n\n=== EMAIL: s ===\nDe: a@b | Fecha: \nb", 8: "CASO: "}


def test_residues_equal_their_patterns(spark):
    from lexmill.operators import privacy

    rng = random.Random(5)
    said = ["calle 4", "Cra. 12", "accalle 4", "cl 9", "1234567", "12345678901", "x12345678", "ñ1234567", "1.234.567", "12.345.678.901", "ana@x.gov.co", "a@b.co-d@e.com", "@", "3101234567", "RC No. 1234567890", "registro civil 12345678901", "src 1234567890", "[TEL_1]", " ", "-", "_"]
    df = spark.createDataFrame([(i, "".join(rng.choice(said) for _ in range(rng.randrange(7)))) for i in range(600)] + [(-1, None)], "id int, text string")
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), privacy.TOKEN, " ")
    n = {k: F.size(F.regexp_extract_all(bare, F.lit(f"({p})"), F.lit(1))) for k, p in privacy.RESIDUES.items()}
    rows = df.select(privacy.residues(F.col("text")).alias("g"), *((c - n["mobile"] if k == "bare" else c).alias(k) for k, c in n.items())).collect()
    assert all(r["g"][k] == r[k] for r in rows for k in n) and all(any(r[k] for r in rows) for k in n)
    # mails are sought only where there is an @
    assert "contains" in df.select(privacy.residues(F.col("text")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_spans_are_sought_only_where_they_can_be():
    from time import perf_counter

    said = ["C.C. ", "cédula ", "1.", "1234567890", "3101234567", "310 123-4567", "TELÉFONO: ", "whatſapp ", "móvıl ", "registro cİvil No. ", "RC ", "FOREST", "radicado es ", "Tercero: 1234567 AB CD ", "calle 45 No. 3", "@", "a.b-c", "x.gov.co", " "]
    every = [(*redaction.CATALOGUED[p.name], re.compile(p.regex), None) for p in patterns.CATALOGUE if p.name in redaction.CATALOGUED] + list(redaction.OWN)
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(said) for _ in range(rng.randrange(9)))
        found = [Span(m.start(1), m.end(1), k, m.group(1), s, "pattern") for k, s, p, near in every for m in p.finditer(text) if near is None or near[1].search(text, max(0, m.start() - near[0]), m.start())]
        assert redaction.pattern_spans(text) == [s for s in found if s.kind != "CC" or not redaction.vetoed(text, s)]
    # a run of letters without what a mail needs was read from each of its places
    begun = perf_counter()
    assert redaction.pattern_spans("a" * 100_000) == []
    assert perf_counter() - begun < 2


def test_texts_are_dealt_out_once(spark, found):
    df, spans = found
    vault = redaction.minted(spans, "id", "case_id", b"k", counted=True)
    plan = redaction.redacted(df, "id", "case_id", "text", spans, vault, b"k")._jdf.queryExecution().optimizedPlan().toString()
    # only the last join meets the texts; before, a second one brought each the vault of its case
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "start" not in joins[0] and "hash" not in joins[0] and any("hash" in line for line in joins[1:]) and "__tokens" not in plan


def test_a_vault_is_dealt_out_once(spark):
    spans = spark.createDataFrame([(1, 1, 5, 9, "CC", "123", "h1"), (2, 1, 0, 3, "CC", "123", "h1"), (2, 1, 9, 12, "CC", "456", "h2"), (3, 2, 0, 3, "PERSON", "Ana", "h3")], "id bigint, case_id bigint, start int, end int, kind string, value string, hash string")
    vault = redaction.minted(spans, "id", "case_id", b"k", counted=True)
    shuffles = lambda d: sum("Exchange" in line for line in d._jdf.queryExecution().executedPlan().toString().splitlines())
    assert shuffles(vault) == 1
    assert sorted(tuple(r) for r in vault.collect()) == [(1, "CC", "h1", "123", "[CC_####123_1]"), (1, "CC", "h2", "456", "[CC_####456_2]"), (2, "PERSON", "h3", "Ana", "[ACCIONANTE_1]")]
    # and once more to be read by token, beside the texts that it meets
    texts = spark.createDataFrame([(1, 1, "a [CC_####456_2]"), (2, 3, "[CC_####456_2]")], "id bigint, case_id bigint, said string")
    back = redaction.restored(texts, "case_id", "said", vault)
    assert shuffles(back) == 3 and sorted(tuple(r) for r in back.collect()) == [(1, 1, "a 456"), (2, 3, "[CC_####456_2]")]


def test_texts_are_searched_together(monkeypatch):
    import pyarrow as pa

    said = ["C.C. ", "cédula ", "1.", "1234567890", "3101234567", "TELÉFONO: ", "whatſapp ", "el NÚMERO de radicado es ", "registro civil No. ", "FOREST", "Tercero: 1234567 AB CD ", "calle 45 No. 3", "@", "a.b-c", "x.gov.co", "folios: ", "\0", "İ", " "]
    rng = random.Random(7)
    for _ in range(600):
        monkeypatch.setattr(redaction, "TOGETHER", rng.choice([1, 30, 200, 1 << 18]))
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(said) for _ in range(rng.randrange(9))) for _ in range(6)]
        known = [[("PERSON", rng.choice(["gov", "Radicado", " 1234567 "]))] * rng.randrange(2) for _ in texts]
        got = [[] for _ in texts]
        for row, firsts, spans in redaction.spans_of_texts(pa.array(texts, pa.string()), iter(known)):
            for s in spans:
                i = max(i for i, first in enumerate(firsts) if first <= s.start)
                got[row + i].append(s._replace(start=s.start - firsts[i], end=s.end - firsts[i]))
        assert got == [redaction.settled([*redaction.known_spans(t, k), *redaction.pattern_spans(t)]) for t, k in zip(texts, known, strict=True)]
        assert redaction.rows_with(pa.array(texts, pa.string()), ("EMAIL", "CC")) == [i for i, t in enumerate(texts) if any(s.kind in ("EMAIL", "CC") for s in redaction.pattern_spans(t))]


def test_known_values_meet_documents_without_a_shuffle_of_texts(spark):
    from lexmill.plans import evidence
    from lexmill.plans.world import World

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:  # more than the documents are dealt into
        t = World(spark, "/root/testdata/sf0.001")
        plan = redaction.detected(t.docs, "id", "case_id", "text", evidence.known(t))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("40)" in line for line in shuffles)


def test_hashes_are_made_where_spans_are_found(spark, found):
    df, spans = found
    hashed = redaction.detected(df, "id", "case_id", "text", secret=b"k")
    assert hashed.count() and all(r["hash"] == redaction.value_hash(b"k", r["case_id"], r["kind"], r["value"]) for r in hashed.collect())
    once = redaction.minted(hashed, "id", "case_id", b"k", counted=True)
    again = redaction.minted(hashed.drop("hash"), "id", "case_id", b"k", counted=True)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))
    # two passes through Python: finding and naming
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2


def test_literals_are_found_at_once(monkeypatch):
    said = [*redaction._LITERALS, "RADICADO", "c.C", "cc.c", "caalle", "11.", "@@", "–", "ñ", "\0", " ", "núme", "c"]
    rng = random.Random(8)
    for _ in range(300):
        monkeypatch.setattr(redaction, "_SHORT", rng.choice([0, 1 << 20]))
        monkeypatch.setattr(redaction, "_PIECE", rng.choice([1, 7, 64, 1 << 20]))
        low = "".join(rng.choice(said) for _ in range(rng.randrange(40))).lower()
        assert redaction._stands(low) == {x: [m.start() for m in re.finditer(f"(?={re.escape(x)})", low)] for x in redaction._LITERALS}


def test_structs_are_tuples_of_their_fields():
    import pyarrow as pa

    rows = [[{"a": "x", "n": 1}, {"a": None, "n": None}], None, [], [{"a": "ñ", "n": 3}]]
    column = pa.array(rows, pa.list_(pa.struct([("a", pa.string()), ("n", pa.int64())])))
    want = [[(s["a"], s["n"]) for s in r or []] for r in rows]
    assert list(redaction.structs(column)) == want and list(redaction.structs(column.slice(1, 3))) == want[1:] and list(redaction.structs(column[:0])) == []


def test_cases_are_made_once_for_what_is_known(spark):
    from lexmill.plans import evidence
    from lexmill.plans.world import World

    t = World(spark, "/root/testdata/sf0.001")
    cases = t.cases.select("id", F.btrim("claimant"), "filing", F.regexp_extract("notes", r"CC (\d+)", 1)).collect()
    want = sorted((i, k, v) for i, *values in cases for k, v in zip(("PERSON", "RADICADO_FOREST", "CC"), values, strict=True) if v)
    assert sorted(map(tuple, evidence.known(t).collect())) == want
    plan = evidence.known(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("o_orderkey#") and plan.count("FileScan parquet [o_orderkey") == 1
    # read once, so found where it is read
    assert "MapInArrow" in evidence.r05_settled_spans(t)._jdf.queryExecution().optimizedPlan().toString()
