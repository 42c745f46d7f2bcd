"""The document model of a case: zones of every document by what opens them, documents in order of priority, and the text that is made of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.compat import holds_any, let

# --- fixed values: what opens each zone, the first that is found of each; the budgets of a prompt --------------------------------

ZONES: dict[str, tuple[str, ...]] = {
    "heading": (r"(?is)\b(?:Juzgado|Tribunal|Corte)\b.*?\b(?:de|del)\b", r"(?is)^.{0,200}Radicado\s+(?:No\.?\s*)?\d"),
    "parties": (r"(?i)(?:ACCIONANTE|DEMANDANTE|TUTELANTE)\s*[:.\-]", r"(?i)(?:ACCIONAD[OA]S?|DEMANDAD[OA]S?)\s*[:.\-]"),
    "facts": (r"(?i)\b(?:HECHOS?|ANTECEDENTES?|SÍNTESIS\s+DE\s+LOS\s+HECHOS)\b\s*[:.\-]", r"(?i)PRIMER[OA]?\s*[.\-]"),
    "claims": (r"(?i)\b(?:PRETENSIONES|SOLICITA|PIDE|PRETENDE)\b\s*[:.\-]?", r"(?i)\b(?:solicito|pido)\b\s+al\s+(?:despacho|honorable)"),
    "rights": (r"(?i)derechos?\s+(?:fundamentales?|constitucionales?)\s+(?:invocados?|alegados?|vulnerados?)", r"(?i)(?:invocando|alegando)\s+(?:la\s+)?vulneraci[oó]n\s+de"),
    "admits": (r"(?i)\bADM[ÍIíi]TASE\b",),
    "resolves": (r"(?i)\bR\s*E\s*S\s*U\s*E\s*L\s*V\s*E\b", r"(?m)^\s*(?:PRIMERO|SEGUNDO)\s*[:.\-]", r"(?i)\bFALLA\b|\bFALLO\b"),
    "grants": (r"(?i)\b(?:CONCEDE[SRN]?|NI[ÉEée]GA[SE]?|IMPROCEDENTE)\b", r"(?i)\b(?:TUTELAR|AMPARAR|DENEGAR|DENIEGA)\b"),
    "appeal": (r"(?i)\b(?:IMPUGNACI[ÓOóo]N|APELACI[ÓOóo]N)\b", r"(?i)(?:segunda\s+instancia|ad\s+quem)"),
    "contempt": (r"(?i)\b(?:incidente\s+de\s+)?(?:DESACATO|DESACATA)\b", r"(?is)Auto\s+(?:de\s+)?apertura.*?desacato"),
    "notice": (r"(?i)\bNOTIF[ÍIíi]QUESE\b", r"(?i)\bC[ÚUúu]MPLASE\b"),
}
#: By opening, literals in small letters (or a pattern, where none is), one of which stands in every text that has it in small letters.
NEEDS: dict[str, tuple[tuple[str, ...] | str, ...]] = {
    "heading": (("juzgado", "tribunal", "corte"), ("radicado",)),
    "parties": (("accionante", "demandante", "tutelante"), ("accionad", "demandad")),
    "facts": (("hecho", "antecedente", "ntesis"), ("primer",)),
    "claims": (("pretensiones", "solicita", "pide", "pretende"), ("solicito", "pido")),
    "rights": (("derecho",), ("invocando", "alegando")),
    "admits": (("tase",),),
    "resolves": (r"r\s*e\s*s\s*u\s*e\s*l\s*v\s*e", ("primero", "segundo"), ("falla", "fallo")),
    "grants": (("concede", "niega", "niéga", "improcedente"), ("tutelar", "amparar", "denegar", "deniega")),
    "appeal": (("impugnaci", "apelaci"), ("segunda", "quem")),
    "contempt": (("desacat",), ("desacato",)),
    "notice": (("quese",), ("mplase",)),
}
#: Characters of a body, documents whose bodies are shown and their last priority; mails, and characters of their subjects and bodies.
BODY, BODIES, BODY_PRIORITY, MAILS, SUBJECT, MAIL_BODY = 3000, 2, 2, 5, 60, 2000


def zones(c: Column) -> Column:
    """array(struct(start, end, zone)) by place, from 1: a zone begins where the first of its openings that a text has stands, and ends before the next one. Null and empty texts have none."""

    def hits(x: Column) -> Column:
        def at(p: str, needs: tuple[str, ...] | str) -> Column:
            there = F.regexp_like(x["low"], F.lit(needs)) if isinstance(needs, str) else holds_any(x["low"], needs)
            return F.when(there, let(F.regexp_instr(x["text"], F.lit(p)), lambda i: F.when(i > 0, i)))

        return F.array(*(F.struct(F.coalesce(*map(at, openings, NEEDS[z]), F.lit(0)).alias("start"), F.lit(z).alias("zone")) for z, openings in ZONES.items()))

    def ended(found: Column) -> Column:
        return F.transform(found, lambda h, i: F.struct(h["start"].alias("start"), (F.coalesce(F.get(found, i + 1)["start"], F.length(text) + 1) - 1).alias("end"), h["zone"].alias("zone")))

    text = F.coalesce(c, F.lit(""))
    # the hits are sought once a text, not once more for the end of each zone
    return let(F.array_sort(F.filter(let(F.struct(text.alias("text"), F.lower(text).alias("low")), hits), lambda h: h["start"] > 0)), ended)


def documents(docs: DataFrame, priority: Column, kind: Column) -> DataFrame:
    """(case_id, id, priority, kind, filename, zones): each document with the texts of its zones; one without any is a body."""
    d = docs.select("case_id", "id", priority.alias("priority"), kind.alias("kind"), "filename", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("z", zones(F.col("text")))
    cut = F.transform("z", lambda z: F.struct(z["zone"].alias("zone"), F.substr("text", z["start"], z["end"] - z["start"] + 1).alias("text")))
    body = F.array(F.struct(F.lit("body").alias("zone"), F.col("text").alias("text")))
    return d.select("case_id", "id", "priority", "kind", "filename", F.when(F.size("z") > 0, cut).when(F.col("text") != "", body).otherwise(F.array().cast("array<struct<zone:string,text:string>>")).alias("zones"))


def prompts(model: DataFrame, cases: DataFrame, mails: DataFrame, known: list[str]) -> DataFrame:
    """(case_id, prompt) of every case: its folder, the filled ``known`` fields, the zones of its documents by priority, and its newest mails.

    Zones are whole, of all documents that have some; of bodies, two of the first priorities are shown, 3,000 characters each; of mails five, 2,000
    characters each. A prompt is one string, so it is as long as the documents of its case make it. ``mails``: (id, case_id, subject, sender, received, body).
    """
    order = Window.partitionBy("case_id").orderBy("priority", "id")
    is_body = F.exists("zones", lambda z: z["zone"] == "body") & (F.col("priority") <= BODY_PRIORITY)
    d = model.withColumn("nth", F.when(is_body, F.sum(is_body.cast("int")).over(order)))
    shown = F.filter("zones", lambda z: (z["zone"] != "body") | (is_body & (F.col("nth") <= BODIES)))
    line = F.transform(shown, lambda z: F.concat(F.lit("["), z["zone"], F.lit("] "), F.when(z["zone"] == "body", F.left(z["text"], F.lit(BODY))).otherwise(z["text"])))
    head = F.concat(F.lit("\n=== "), "filename", F.lit(" ["), F.coalesce("kind", F.lit("")), F.lit("] ==="))
    d = d.select("case_id", "priority", "id", F.concat_ws("\n", head, line).alias("said"), F.size(shown).alias("n")).where("n > 0")
    papers = d.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("priority", "id", "said"))).alias("p")).select("case_id", F.array_join(F.transform("p", lambda x: x["said"]), "\n").alias("papers"))
    m = mails.where("case_id is not null").withColumn("nth", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc_nulls_last("received"), "id"))).where(F.col("nth") <= MAILS)
    e = lambda c: F.coalesce(c, F.lit(""))
    said = F.concat(
        F.lit("\n=== EMAIL: "), F.left(e("subject"), F.lit(SUBJECT)), F.lit(" ===\nDe: "), e("sender"), F.lit(" | Fecha: "), e(F.date_format("received", "yyyy-MM-dd")),
        F.when(e("body") != "", F.concat(F.lit("\n"), F.left("body", F.lit(MAIL_BODY)))).otherwise(""),
    )
    letters = m.select("case_id", "nth", said.alias("said")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("nth", "said"))).alias("m")).select("case_id", F.array_join(F.transform("m", lambda x: x["said"]), "\n").alias("letters"))
    fields = F.concat_ws("\n", *(F.when(F.col(c) != "", F.concat(F.lit(f"  {c}: "), F.col(c))) for c in known))
    about = F.concat(F.lit("CASO: "), e("folder"), F.when(fields != "", F.concat(F.lit("\n\nCAMPOS:\n"), fields)).otherwise(""))
    out = cases.select(F.col("id").alias("case_id"), about.alias("about")).join(papers, "case_id", "left").join(letters, "case_id", "left")
    return out.select("case_id", F.concat_ws("\n", "about", "papers", "letters").alias("prompt"))
