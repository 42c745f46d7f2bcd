"""What the texts of documents and mails tell: ids, filings, rulings, zones, events, and whether a document belongs to its case."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.cases import short_id, valid_filing
from lexmill.functions.compat import digits, first_hit, let, parse_dmy, strip_accents

# --- fixed values, which results depend on -------------------------------------------------------------------------------

#: Court ids, whole and in parts; year and sequence after T, after a label, and anywhere; filings after their words.
ID_WHOLE = r"(68\d{17,21})"
ID_PARTS = r"(68\d{3,5}[-\s.–—]?\d{2}[-\s.–—]?\d{2}[-\s.–—]?\d{3}[-\s.–—]?\d{4}[-\s.–—]?\d{5}[-\s.–—]?\d{2})"
SHORT_T = r"(?i)T[-\s]?(\d{3,5})\s*/\s*(20\d{2})"
SHORT_LABEL = r"(?i)(?:RAD\.?|RADICADO(?:\s+No\.?|\s*:)|Rad(?:icado)?\.|Rad(?:icado)?:)\s*#?\s*(?:No\.?\s*)?(20\d{2})[-–—/]\s*0*(\d{2,5})(?:\D|$)"
SHORT_ANY = r"(20\d{2})[-–—]\s*0*(\d{2,5})(?:\D|$)"
FILING_WORD = r"(?i)FOREST\s*(?:No\.?\s*)?:?\s*(\d{5,13})"
#: Verbs of a decision, and the words after which it is given.
DECIDES = r"(?i)RESUELVE|PRIMERO"
VERBS = {"CONCEDE": r"(?i)\b(?:CONCEDE|CONCEDER|TUTELAR|AMPARAR)\b", "NIEGA": r"(?i)\b(?:NIEGA|NEGAR|DENEGAR)\b", "IMPROCEDENTE": r"(?i)\bIMPROCEDENTE\b"}
#: Zones of a ruling by the words that start them.
ZONES = {"DECISION": r"(?i)\bRESUELVE\b", "NOTICE": r"(?i)\bNOTIF[IÍí]QUESE\b", "PARTIES": r"(?i)\baccionante\b", "PLACE": r"(?i)\bdado el\b"}
#: Words in a claimant that are no part of a name, and in a file's name.
NO_NAME = (
    "AGENTE", "OFICIOSO", "MENOR", "REPRESENTANTE", "LEGAL", "MUNICIPAL", "PERSONERO", "PERSONERA", "PERSONERIA", "ACCION", "TUTELA", "CONTRA",
    "HIJO", "HIJA", "COMO", "REPRESENTATE", "REPRESENTACION", "NOMBRE",
)
NO_FILE_NAME = (
    "RESPUESTA", "FOREST", "TUTELA", "FALLO", "AUTO", "SENTENCIA", "GMAIL", "EMAIL", "OFICIO", "NOTIFICA", "URGENTE", "ADMISORIO", "CONTESTACION", "IMPUGNACION",
    "INCIDENTE", "DESACATO", "EDUCACION", "SANTANDER", "GOBERNACION", "SECRETARIA", "MERGED", "ILOVEPDF", "COMPRESSED", "ANEXOS", "ESCRITO", "PRUEBA",
)
#: Fields that follow a pattern rather than the model's reading where both differ.
STRUCTURED = ("court_id", "filing", "admitted", "ruling1_date", "ruling2_date", "appeal", "incident", "incident_date", "court", "city")

# --- functions -----------------------------------------------------------------------------------------------------------


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(_text(c), pattern, group), F.lit(""))


def padded(sequence: Column) -> Column:
    """To five digits, longer ones as they are."""
    return F.lpad(sequence, F.greatest(F.length(sequence), F.lit(5)), F.lit("0"))


def court_ids(c: Column) -> Column:
    """struct(long_id, short): the court's id in a text, and year and sequence: of that id if it has them, else after T, a label, or anywhere."""
    long_ = F.coalesce(_found(c, ID_WHOLE), _found(c, ID_PARTS))
    after_t = F.concat(_found(c, SHORT_T, 2), F.lit("-"), padded(_found(c, SHORT_T, 1)))
    others = (F.concat(_found(c, p, 1), F.lit("-"), padded(_found(c, p, 2))) for p in (SHORT_LABEL, SHORT_ANY))
    return F.struct(long_.alias("long_id"), F.coalesce(short_id(long_), after_t, *others).alias("short"))


def filing_number(c: Column) -> Column:
    """The first valid filing number after its word; null without one."""
    n = _found(c, FILING_WORD)
    return F.when(valid_filing(n), n)


def decision(c: Column) -> Column:
    """The verb that comes first after the words of a decision: CONCEDE, NIEGA or IMPROCEDENTE; null without one."""
    start = F.regexp_instr(_text(c), F.lit(DECIDES))
    tail = F.substr(_text(c), start)
    hits = F.array(*(F.struct(F.regexp_instr(tail, F.lit(p)).alias("at"), F.lit(v).alias("verb")) for v, p in VERBS.items()))
    return F.when(start > 0, F.array_min(F.filter(hits, lambda h: h["at"] > 0))["verb"])


def zones(c: Column) -> Column:
    """array(struct(start, end, zone)) by place: a zone starts at its first marker (from 1) and ends before the next zone."""
    text = _text(c)
    hits = F.array(*(F.struct(F.regexp_instr(text, F.lit(p)).alias("start"), F.lit(z).alias("zone")) for z, p in ZONES.items()))
    found = F.array_sort(F.filter(hits, lambda h: h["start"] > 0))
    return F.transform(found, lambda h, i: F.struct(h["start"].alias("start"), (F.coalesce(F.get(found, i + 1)["start"], F.length(text) + 1) - 1).alias("end"), h["zone"].alias("zone")))


def merged_value(field: Column, pattern: Column, model: Column, confidence: Column) -> Column:
    """struct(value, confidence, source) of a field that a pattern (with its confidence) and the model have read.

    Equal values, or one within the other, confirm the pattern's, 15 more in confidence, 100 at most; else the pattern wins
    in structured fields and the model in all others. Blank is missing.
    """
    p, m = (F.nullif(F.btrim(_text(x)), F.lit("")) for x in (pattern, model))
    a, b = F.upper(p), F.upper(m)
    agree = F.contains(a, b) | F.contains(b, a)
    pick = lambda v, n, s: F.struct(v.alias("value"), n.cast("int").alias("confidence"), F.lit(s).alias("source"))
    return (
        F.when(p.isNull() & m.isNull(), pick(F.lit(None).cast("string"), F.lit(0), "none"))
        .when(m.isNull(), pick(p, confidence, "pattern"))
        .when(p.isNull(), pick(m, F.lit(70), "model"))
        .when(agree, pick(p, F.least(F.lit(100), F.greatest(confidence, F.lit(70)) + 15), "both"))
        .when(field.isin(*STRUCTURED), pick(p, confidence, "pattern"))
        .otherwise(pick(m, F.lit(70), "model"))
    )


def _plain(c: Column) -> Column:
    return F.upper(strip_accents(_text(c)))


def _count_in(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def belongs(filename: Column, text: Column, folder: Column, court_id: Column, claimant: Column) -> Column:
    """Whether a document belongs to its case: OK, REVISAR, SOSPECHOSO or NO_PERTENECE, by the first criterion that decides."""
    text, name, file = _text(text), _plain(claimant), _plain(filename)
    year, seq = F.regexp_extract(_text(folder), r"^(20\d{2})[-\s]?0*(\d+)", 1), F.regexp_extract(_text(folder), r"^(20\d{2})[-\s]?0*(\d+)", 2)
    own = F.regexp_replace(_text(court_id), r"[\s\-.]", "")
    ids = F.regexp_extract_all(F.regexp_replace(F.left(text, F.lit(8000)), r"[\s\-.]", ""), F.lit(ID_WHOLE), F.lit(1))
    known = (F.length(own) >= 15) & (F.size(ids) > 0)
    confirmed = F.exists(ids, lambda x: F.contains(x, F.right(own, F.lit(17))))
    words = F.filter(F.regexp_extract_all(name, F.lit(r"([A-Z]{4,})"), F.lit(1)), lambda w: ~w.isin(*NO_NAME))
    named = F.size(words) >= 2
    head = F.left(text, F.lit(5000))
    mentioned = F.regexp_like(head, F.concat(year, F.lit(r"[-\s]?0*"), seq, F.lit(r"(?:\D|$)")))
    pairs = F.transform(F.regexp_extract_all(head, F.lit(r"(20\d{2}[-\s]?0*\d{2,5})\b"), F.lit(1)), lambda x: F.struct(F.left(x, F.lit(4)).alias("y"), F.regexp_replace(F.substr(x, F.lit(5)), r"^[-\s]?0*", "").alias("s")))
    year_of, number = (lambda x: x["y"].try_cast("int")), (lambda x: x["s"].try_cast("int"))
    other = F.exists(
        pairs,
        lambda x: ~((x["y"] == year) & (x["s"] == seq)) & ~((x["y"] == "2012") & x["s"].isin("35", "352", "3526")) & (F.length(x["s"]) > 2) & year_of(x).between(2019, 2030) & (number(x) <= 600),
    )
    left = F.filter(F.array_distinct(F.regexp_extract_all(file, F.lit(r"([A-Z]{4,})"), F.lit(1))), lambda w: ~w.isin(*NO_FILE_NAME))
    rules = [
        (F.startswith(filename, F.lit("Email_")) & F.endswith(filename, F.lit(".md")), "OK"),
        (F.length(text) < 100, "OK"),
        (seq == "", "OK"),
        (known & confirmed, "OK"),
        (known, "NO_PERTENECE"),
        (named & (_count_in(F.slice(words, 1, 3), file) >= 1), "OK"),
        (named & (_count_in(F.slice(words, 1, 4), _plain(F.left(text, F.lit(10000)))) >= 2), "OK"),
        (F.contains(filename, seq) | F.contains(filename, padded(seq)), "OK"),
        (mentioned & (F.size(ids) == 0) & (own != ""), "REVISAR"),
        (mentioned & (F.size(ids) == 0), "OK"),
        (other, "NO_PERTENECE"),
        (named & (_count_in(F.slice(words, 1, 3), file) == 0) & (F.length(file) > 10) & (F.size(left) >= 2), "SOSPECHOSO"),
    ]
    return first_hit(rules, "OK")


def status_after(failed: Column, saved: Column, court_id: Column, folder: Column, claimant: Column) -> Column:
    """The status a case gets after extraction: to review if the model failed with fewer than five fields saved or the case has no identity."""
    has_id = F.length(digits(_text(court_id))) >= 18
    named = F.regexp_like(_text(folder), F.lit(r"^20\d{2}-\d+")) & (F.btrim(_text(claimant)) != "")
    return F.when(failed & (saved < 5), "REVISION").when(~(has_id | named), "REVISION").otherwise("COMPLETO")


EVENTS = {"RULING": r"(?i)fallo|sentencia|dado", "NOTICE": r"(?i)notific", "OTHER": r"(?i)\d"}


def day_after(c: Column, word: str) -> Column:
    """The first D/M/YYYY after a word, as a date; null without one."""
    return parse_dmy(F.nullif(F.regexp_extract(_text(c), rf"(?is){word}\D{{0,40}}(\d{{1,2}}/\d{{1,2}}/\d{{4}})", 1), F.lit("")))


def category_scores(c: Column, patterns: dict[str, list[str]], outranked: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The category of which most patterns are found, the first of equal ones, null if none is; ``outranked`` drop out where one of theirs is found."""

    def holds(text: Column, p: str) -> Column:
        return F.regexp_like(text, F.lit(p)) if re.search(r"[^\w\s@]", p) else F.contains(text, F.lit(p))

    def best(text: Column) -> Column:
        score = {n: sum((holds(text, p).cast("int") for p in own), F.lit(0)) for n, own in patterns.items()}
        for name, stronger in (outranked or {}).items():
            for other in stronger:
                score[name] = F.when(score[other] > 0, 0).otherwise(score[name])
        return F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("name")) for i, (n, s) in enumerate(score.items()))))

    # the text in small letters and the best of it are made once a row
    return let(let(F.lower(_text(c)), best), lambda b: F.when(b["score"] > 0, b["name"]))


def repaired_json(c: Column) -> Column:
    """A map of strings from a JSON object that may be cut off: what stands before the last whole entry, closed; null if nothing can be read."""
    text = F.regexp_extract(_text(c), r"(?s)(\{.*)", 1)
    whole = F.from_json(text, "map<string,string>")
    closed = F.concat(F.regexp_replace(text, r'(?s),?\s*"(?:[^"\\]|\\.)*"?\s*(?::\s*(?:"(?:[^"\\]|\\.)*)?)?$', ""), F.lit("}"))
    return F.coalesce(whole, F.from_json(closed, "map<string,string>"))


def compressed(c: Column, most: int = 400_000) -> Column:
    """Blank runs shortened, notices of confidentiality taken out, and the rest cut at ``most`` characters."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(c), r"\n{3,}", "\n\n"), r" {3,}", " "), r"\t+", " ")
    t = F.regexp_replace(t, r"(?is)(?:AVISO DE CONFIDENCIALIDAD|NOTA IMPORTANTE:|Este correo electrónico contiene información).*?(?:\n\n|$)", "[BOILERPLATE]")
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("[CUT]"))).otherwise(t)


def nearest_date(c: Column, place: Column) -> Column:
    """The written or numeric date whose start is nearest to a place in the text (from 1), the earlier of equally near ones."""
    text = _text(c)
    pattern = r"(\d{1,2}/\d{1,2}/\d{4}|\d{1,2} de [a-z]+ de \d{4})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    # each is looked for behind the end of the one before it
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<away:int,at:int,date:string>>").alias("all"))

    def step(acc: Column, d: Column) -> Column:
        at = F.call_function("locate", d, text, acc["at"])
        return F.struct((at + F.length(d)).alias("at"), F.concat(acc["all"], F.array(F.struct(F.abs(at - place).cast("int").alias("away"), at.alias("at"), d.alias("date")))).alias("all"))

    return F.array_min(F.aggregate(found, start, step)["all"])["date"]


#: Phrases at which the name of a court ends, and words at which a claimant's does.
COURT_ENDS, NAME_ENDS = r"(?i)\s+(?:REF|RADICADO|ACCIONANTE|SEÑOR)\b.*$", r"(?i)\s+(?:CONTRA|VS|ACCIONAD[OA]S?|RAD|RADICADO)\b.*$"


def court_name(c: Column) -> Column:
    """The court named in the first 3,000 characters of a text, cut where something else begins; null without one."""
    found = F.regexp_extract(F.left(_text(c), F.lit(3000)), r"(?i)((?:JUZGADO|TRIBUNAL)[^\n]{3,120})", 1)
    return F.nullif(F.btrim(F.regexp_replace(found, COURT_ENDS, ""), F.lit(" ,.-")), F.lit(""))


def claimant_in_mail(subject: Column, blocks: Column) -> Column:
    """The name after the word for a claimant in the subject, else in the first of five forwarded blocks that has one."""
    pattern = r"(?i)accionante:?\s+([\p{L} ]{5,60})"
    tidy = lambda x: F.nullif(F.btrim(F.regexp_replace(F.regexp_extract(x, pattern, 1), NAME_ENDS, "")), F.lit(""))
    later = F.filter(F.transform(F.slice(blocks, 1, 5), tidy), lambda x: x.isNotNull())
    return F.coalesce(tidy(_text(subject)), F.get(later, F.lit(0)))
