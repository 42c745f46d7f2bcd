"""Classes and normal forms of the texts that cases hold: names, cities, rights, folders, file names, mail subjects, fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.compat import digits, first_hit, parse_dmy, strip_accents, title_case

# --- fixed values, which results depend on -------------------------------------------------------------------------------

#: Suffixes of lawyers' names, spellings to mend, and how many words a name has before a post follows.
LAWYER_SUFFIX = r"(?i)\s+(CPS|OPS|CONTRATO|CC\.?\s*\d+).*$"
LAWYER_SPELLING = {"juan deigo cruz lizcano": "Juan Diego Cruz Lizcano", "maría cristina villamizar schiller": "Maria Cristina Villamizar Schiller"}
#: Cities by their lower-cased variants.
CITIES = {
    "bogota d.c.": "Bogotá D.C.", "bogota": "Bogotá D.C.", "bogotá": "Bogotá D.C.", "barrancabermeja": "Barrancabermeja",
    "bucaramanga": "Bucaramanga", "floridablanca": "Floridablanca", "giron": "Girón", "gambita": "Gámbita",
}
#: Rights: all words on the left make the right; the first five are those of the chart of lost cases.
RIGHTS = (
    (("EDUCACI",), "EDUCACION"), (("SALUD",), "SALUD"), (("PETICI",), "PETICION"), (("VIDA", "DIGNA"), "VIDA DIGNA"), (("IGUALDAD",), "IGUALDAD"),
    (("DEBIDO", "PROCESO"), "DEBIDO PROCESO"), (("TRABAJO",), "TRABAJO"), (("MINIMO", "VITAL"), "MINIMO VITAL"),
)
#: Decisions of contempt incidents, by words of the decision and by words of the notes.
DECISIONS = (
    (("SANCIONA", "SANCIÓN", "MULTA", "ARRESTO"), "SANCIONADO"), (("CONSULTA", "GRADO JURISDICCIONAL"), "EN CONSULTA"),
    (("NULIDAD", "DEVUELTO", "DEVOLVIÓ", "APERTURA", "ABRE", "PRUEBAS", "REQUERIMIENTO", "ARGUMENTA", "RESPONDE", "NO HA VULNERADO"), "EN TRÁMITE"),
    (("CUMPLIMIENTO", "CUMPLIDA", "CUMPLIÓ", "TERMINADO", "TERMINACIÓN", "FINALIZÓ"), "CUMPLIDO"),
    (("ABSTENERSE", "ABSTIENE", "ARCHIVAR", "ARCHIVA", "DENEGAR", "IMPROCEDENTE"), "ARCHIVADO"),
)
NOTES = (
    (("SANCION", "MULTA", "ARRESTO"), "SANCIONADO"), (("CONSULTA", "GRADO JURISDICCIONAL"), "EN CONSULTA"),
    (("CUMPLIMIENTO", "CUMPLIÓ", "CUMPLIDA"), "CUMPLIDO"), (("APERTURA INCIDENTE", "ABRE INCIDENTE", "REQUERIMIENTO PREVIO"), "EN TRÁMITE"),
    (("ARCHIV", "ABSTIENE", "NO PROCEDE"), "ARCHIVADO"), (("DESACATO",), "EN TRÁMITE"),
)
#: Words by which a folder's name is a fragment of a text, and the longest name of a case.
FRAGMENTS = (
    "PENDIENTE REVISION", "PENDIENTE IDENTIFICACION", "PENDIENTE", "REFERENCIA", "CORREO", "CUAL CUMPLIMIENTO",
    "NUEVA NIEGA", "FRAGMENTO", "DONDE EXPONE", "EN EL MUNICIPIO", "NOTIFICACION OBEDECER",
)
LONGEST_FOLDER = 120
#: Spellings to mend in subjects, one after the other; senders and subjects of no interest.
TYPOS = {
    "NOTIFIA": "NOTIFICA", "ADMISORIIO": "ADMISORIO", "NOTIFICAICON": "NOTIFICACION", "TUTLEA": "TUTELA",
    "SENTECIA": "SENTENCIA", "DESACTO": "DESACATO", "IMPUGNAICON": "IMPUGNACION", "AVOACAR": "AVOCAR",
}
IGNORED_SENDERS = ("noreply@google.com", "no-reply@accounts.google.com", "googleplay-noreply@google.com")
IGNORED_SUBJECTS = ("alerta de seguridad", "configurar tu dispositivo", "privacidad en play", "verify your")
#: Mail classes by words of the upper-cased subject.
MAILS = (
    (("ELEMENTOS ENVIADOS", "CORREO ENVIADO"), "SALIENTE"), (("INCIDENTE", "DESACATO"), "INCIDENTE_DESACATO"), (("SEGUNDA INSTANCIA", "2DA INSTANCIA", "FALLO 2"), "FALLO_2DA"),
    (("IMPUGNA",), "IMPUGNACION"), (("SENTENCIA", "FALLO"), "FALLO_1RA"), (("ADMITE", "ADMISORIO", "AVOCA"), "AUTO_ADMISORIO"), (("TRASLADO",), "TRASLADO"),
    (("REQUERIMIENTO",), "REQUERIMIENTO"), (("NOTIFIC",), "NOTIFICACION"), (("TUTELA",), "TUTELA_NUEVA"),
)
#: Classes of word-processor files, of their answers, and of all other files, by parts of the lower-cased name.
ANSWER = ("respuesta", "contestacion", "contestación")
ANSWERS = ((("incidente", "desacato"), "DOCX_DESACATO"), (("impugnacion", "impugnación"), "DOCX_IMPUGNACION"))
LETTERS = (
    (("cumplimiento",), "DOCX_CUMPLIMIENTO"), (("forest",), "DOCX_RESPUESTA"), (("solicitu", "insumo"), "DOCX_SOLICITUD"),
    (("memorial", "aclaratori"), "DOCX_MEMORIAL"), (("carta", "oficio"), "DOCX_CARTA"),
)
FILES = (
    (("auto", "admite", "avoca", "admisorio"), "PDF_AUTO_ADMISORIO"), (("sentencia", "fallo"), "PDF_SENTENCIA"),
    (("impugn",), "PDF_IMPUGNACION"), (("incidente", "desacato"), "PDF_INCIDENTE"),
)
PICTURES = (".png", ".jpg", ".jpeg", ".bmp", ".gif")
#: Values that fields of a fixed choice may have, and the years that dates may have.
CHOICES = {"appeal": ("SI", "NO"), "incident": ("SI", "NO"), "state": ("ACTIVO", "INACTIVO")}
FIRST_YEAR, LAST_YEAR = 2020, 2030
BAD_FILING, COURT_PREFIX = "3634740", "68"

# --- functions -----------------------------------------------------------------------------------------------------------


def has_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def by_words(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None) -> Column:
    """The label of the first rule of which ``c`` contains any part."""
    return first_hit([(has_any(c, parts), label) for parts, label in rules], default)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lawyer_name(c: Column) -> Column:
    """Title case without contract suffixes, known spellings mended; of more than five words the first four. Null: empty."""
    n = title_case(F.btrim(F.regexp_replace(F.btrim(_text(c)), LAWYER_SUFFIX, "")))
    n = F.coalesce(first_hit([(F.lower(n) == wrong, right) for wrong, right in LAWYER_SPELLING.items()], None), n)
    w = F.split(n, r"\s+")
    return F.when(F.size(w) > 5, F.array_join(F.slice(w, 1, 4), " ")).otherwise(n)


def city_name(c: Column) -> Column:
    """Title case without department and country, known variants made one. Null: empty."""
    t = title_case(F.btrim(_text(c)))
    t = F.regexp_replace(F.regexp_replace(t, r"(?i),?\s*Santander.*$", ""), r"(?i),?\s*Colombia.*$", "")
    t = F.btrim(F.regexp_replace(F.btrim(t), r",+$", ""))
    return F.coalesce(first_hit([(F.lower(t) == k, v) for k, v in CITIES.items()], None), t)


def right_name(c: Column, rules: int = len(RIGHTS)) -> Column:
    """The right that an upper-cased text names by the first ``rules`` rules, else the text."""
    out = F
    for parts, label in RIGHTS[:rules]:
        both = F.lit(True)
        for p in parts:
            both = both & F.contains(c, F.lit(p))
        out = out.when(both, F.lit(label))
    return out.otherwise(c)


def incident_class(decision: Column, notes: Column) -> Column:
    """Class of a contempt incident by its decision; without one (empty, PENDIENTE) by the notes, else PENDIENTE."""
    d, n = F.upper(_text(decision)), F.upper(_text(notes))
    return F.when((d != "") & (d != "PENDIENTE"), by_words(d, DECISIONS, "EN TRÁMITE")).otherwise(by_words(n, NOTES, "PENDIENTE"))


def suspicious_folder(c: Column) -> Column:
    """Why a folder's name is none of a case: empty, words of a fragment, length, or no number at its start; null if it may be."""
    name = _text(c)
    words = first_hit([(F.contains(F.upper(name), F.lit(w)), f"words: {w}") for w in FRAGMENTS], None)
    return F.when(name == "", "empty").otherwise(
        F.coalesce(words, F.when(F.length(name) > LONGEST_FOLDER, "long"), F.when(~F.regexp_like(name, F.lit(r"^\d{4}-\d{3,}")), "no number"))
    )


def mistyped_folder(c: Column) -> Column:
    """A year of five digits in front."""
    return F.regexp_like(_text(c), F.lit(r"^20\d{3}-"))


def filing_folder(c: Column) -> Column:
    """A folder named by a filing number (10,000 or more) instead of a court's."""
    return F.coalesce(F.regexp_extract(_text(c), r"^(\d{4})-(\d{4,})(?:\s|$)", 2).try_cast("bigint") >= 10000, F.lit(False))


def folder_id(c: Column, most: int = 6) -> Column:
    """``YYYY-NNNNN`` of a folder's name, its sequence (at most ``most`` digits after zeros) padded to five; null without one."""
    p = rf"(20\d{{2}})-0*(\d{{1,{most}}})"
    n = F.regexp_extract(_text(c), p, 2)
    return F.when(n != "", F.concat(F.regexp_extract(c, p, 1), F.lit("-"), F.lpad(n, F.greatest(F.length(n), F.lit(5)), F.lit("0"))))


def year_sequence(c: Column) -> Column:
    """``YYYY:N`` at the start of a text, zeros dropped; null without one."""
    p = r"^(20\d{2})[-\s]?0*(\d+)"
    n = F.regexp_extract(_text(c), p, 2)
    return F.when(n != "", F.concat(F.regexp_extract(c, p, 1), F.lit(":"), n))


def document_class(filename: Column) -> Column:
    """Class of a document by its file's name."""
    f = F.lower(filename)
    letter = F.endswith(f, F.lit(".docx")) | (F.endswith(f, F.lit(".doc")) & ~F.contains(f, F.lit(".doc ")))
    letters = F.when(has_any(f, ANSWER), by_words(f, ANSWERS, "DOCX_RESPUESTA")).otherwise(by_words(f, LETTERS, "DOCX_OTRO"))
    picture = F.lit(False)
    for end in PICTURES:
        picture = picture | F.endswith(f, F.lit(end))
    late = F.when(F.startswith(f, F.lit("email")), "EMAIL_DB").when(picture, "SCREENSHOT").otherwise("PDF_OTRO")
    other = (
        F.when(F.startswith(f, F.lit("email_")) & F.endswith(f, F.lit(".md")), "EMAIL_MD")
        .when(F.startswith(f, F.lit("gmail")) | F.startswith(f, F.lit("rv_")), "PDF_GMAIL")
        .otherwise(F.coalesce(by_words(f, FILES, None), late))
    )
    return F.when(letter, letters).otherwise(other)


def mend_typos(subject: Column) -> Column:
    out = _text(subject)
    for wrong, right in TYPOS.items():
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def mail_class(subject: Column) -> Column:
    return by_words(F.upper(_text(subject)), MAILS, "OTRO")


def ignorable_mail(subject: Column, sender: Column) -> Column:
    return has_any(F.lower(_text(sender)), IGNORED_SENDERS) | has_any(F.lower(_text(subject)), IGNORED_SUBJECTS)


def party_format(c: Column) -> Column:
    """How a claimant appears: an ombudsman, with others, by an agent, represented, or in person."""
    u = F.upper(_text(c))
    match = lambda p: F.regexp_like(_text(c), F.lit(p))
    rules = [(F.contains(u, F.lit("PERSONER")), "PERSONERO_MUNICIPAL"), (match(r"(?i)\bOTROS\b"), "MULTIPLE_Y_OTROS"), (match(r"(?i)agente\s+oficios[oa]"), "AGENTE_OFICIOSO"), (match(r"(?i)representa"), "REPRESENTACION")]
    return first_hit(rules, "PERSONA_NATURAL")


def court_level(c: Column) -> Column:
    """Rank of a court by its name."""
    ranks = ((("PROMISCUO",), "PROMISCUO_MUNICIPAL"), (("MUNICIPAL",), "PENAL_MUNICIPAL"), (("CIRCUITO",), "CIRCUITO"), (("TRIBUNAL",), "TRIBUNAL"), (("CORTE",), "CORTE"))
    return by_words(F.upper(_text(c)), ranks, "OTRO")


def entity_name(c: Column) -> Column:
    """The short name of an institution, else its first four words."""
    u = F.upper(F.regexp_replace(_text(c), r"\s+", " "))
    known = (
        (("SECRETARÍA DE EDUCACIÓN", "SECRETARIA DE EDUCACION"), "SECRETARIA DE EDUCACION"), (("NUEVA EPS",), "NUEVA EPS"), (("GOBERNACIÓN", "GOBERNACION"), "GOBERNACION SANTANDER"),
        (("MINISTERIO DE EDUCACIÓN", "MINISTERIO DE EDUCACION"), "MINISTERIO EDUCACION"), (("ALCALDÍA", "ALCALDIA"), "ALCALDIA_MUNICIPAL"), (("EPS",), "OTRAS_EPS"),
    )
    return F.coalesce(by_words(u, known, None), F.array_join(F.slice(F.split(F.btrim(u), " "), 1, 4), " "))


def field_problem(name: str, c: Column) -> Column:
    """What is wrong with the value of a field; null if nothing is or the value is blank."""
    v = F.btrim(_text(c))
    if name == "filing":
        d = digits(v)
        wrong = F.when(d == BAD_FILING, "listed").when(F.startswith(d, F.lit(COURT_PREFIX)), "court id").when(F.length(d) < 7, "short")
    elif name in CHOICES:
        wrong = F.when(~F.upper(v).isin(*CHOICES[name]), "choice")
    else:
        day = any_date(v)
        wrong = F.when(day.isNull(), "no date").when(~F.year(day).between(FIRST_YEAR, LAST_YEAR), "year")
    return F.when(v != "", wrong)


def any_date(c: Column) -> Column:
    """A date written with /, -, or . after day and month, or as ISO; else null."""
    other = [F.try_to_timestamp(c, F.lit(p)).cast("date") for p in ("d-M-yyyy", "d.M.yyyy")]
    return F.coalesce(parse_dmy(c), *other)


def cross_field_warnings(admitted: Column, ruling1: Column, ruling1_date: Column, ruling2: Column, ruling2_date: Column, appeal: Column, incident: Column, incident_date: Column) -> Column:
    """Names of the five contradictions that the fields of a case have."""
    a, b, c = any_date(admitted), any_date(ruling1_date), any_date(ruling2_date)
    given = lambda x: _text(x) != ""
    rules = [
        (a > b, "admitted after ruling"),
        (b > c, "rulings out of order"),
        (given(ruling1) & ~given(appeal), "ruling without appeal field"),
        (given(ruling2) & (_text(appeal) != "SI"), "second ruling without appeal"),
        ((incident == "SI") & ~given(incident_date), "incident without date"),
    ]
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for rule, name in rules)))


def safe_folder(c: Column, most: int = 200) -> Column:
    """A name that file systems take: forbidden characters out, blanks single, no dots or blanks at the end, cut."""
    t = F.btrim(F.regexp_replace(F.regexp_replace(_text(c), r'[<>:"/\\|?*\x00-\x1f]', ""), r"\s+", " "))
    return F.regexp_replace(F.left(F.regexp_replace(t, r"[. ]+$", ""), F.lit(most)), r"[. ]+$", "")


def forwarded_blocks(body: Column) -> Column:
    """The parts of a mail between rules of five or more _, - or = and before the headers of forwarded mails; blank parts left out."""
    parts = F.flatten(F.transform(F.split(_text(body), r"(?:_{5,}|-{5,}|={5,})\s*\n"), lambda x: F.split(x, r"\n(?=(?:De|From):\s)")))
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def institutions(c: Column) -> Column:
    """Names in a list parted by dashes, semicolons or line ends; each once, in order."""
    parts = F.transform(F.split(_text(c), r"\s+-\s+|;|\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def privacy_hints(text: Column) -> Column:
    """What in a text calls for strict redaction, in this order: a minor with a condition, violence, mental health, a birth record."""
    t = F.lower(_text(text))
    match = lambda p: F.regexp_like(t, F.lit(p))
    hints = [
        (match(r"(?U)\b(?:menor|niñ[oa]|adolescent)") & match(r"discapacidad|diagn[oó]stic[oa]|s[ií]ndrome|autismo|par[aá]lisis"), "menor_con_condicion_salud"),
        (match(r"violenc|maltrat|abus|agres"), "violencia_detectada"),
        (match(r"salud\s+mental|ansiedad|depresi[oó]n|psiqui[aá]tric"), "salud_mental"),
        (match(r"registro\s+civil|rc\s+\d"), "nuip_menor_presente"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in hints)))


def last_digits(c: Column, n: int = 4) -> Column:
    return F.right(digits(_text(c)), F.lit(n))


def age_range(age: Column) -> Column:
    by_age = F.when(age <= 5, "EDAD_0_5").when(age <= 10, "EDAD_6_10").when(age <= 14, "EDAD_11_14").when(age <= 17, "EDAD_15_17").otherwise("EDAD_ADULTO")
    return F.when(age.isNull(), "EDAD_DESCONOCIDA").otherwise(by_age)


def diagnosis_family(c: Column) -> Column:
    """The letter and two digits of a diagnosis code."""
    found = F.regexp_extract(F.upper(_text(c)), r"([A-TV-Z]\d{2})", 1)
    return F.when(found != "", found).otherwise("DX_UNK")
