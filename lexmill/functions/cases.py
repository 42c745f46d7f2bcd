"""Domain rules as column functions: rulings, deadlines, identifiers, document and mail classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.compat import digits, first_hit, floor_days, let, normal_name


def _has(c: Column, part: str) -> Column:
    return F.contains(c, F.lit(part))


def final_ruling(first: Column, second: Column) -> Column:
    """Outcome for the defendant from the rulings of both instances."""
    a, b = (F.upper(F.btrim(F.coalesce(x, F.lit("")))) for x in (first, second))
    alone = first_hit([(_has(a, "CONCEDE"), "DESFAVORABLE"), (_has(a, "NIEGA"), "FAVORABLE"), (_has(a, "IMPROCEDENTE"), "IMPROCEDENTE")], "OTRO")
    return (
        F.when(a == "", "SIN FALLO")
        .when((b == "") & _has(a, "DESISTIMIENTO") & (alone == "OTRO"), "DESISTIMIENTO")
        .when((b == "") | (~_has(b, "REVOCA") & _has(b, "CONFIRMA")), alone)
        .when(_has(b, "REVOCA"), F.when(_has(a, "CONCEDE"), "FAVORABLE").otherwise("DESFAVORABLE"))
        .when(_has(b, "MODIFICA"), "MODIFICADO")
        .otherwise("OTRO")
    )


def severity(days_left: Column) -> Column:
    return F.when(days_left < 0, "VENCIDO").when(days_left < 3, "URGENTE").otherwise("EN_PLAZO")


def traffic_light(state: Column, due: Column, now: Column) -> Column:
    """Follow-up state: done, appealed, without a date, or by the days that are left."""
    left = floor_days(due, now)
    by_days = F.when(left < 0, "VENCIDO").when(left <= 3, "URGENTE").when(left <= 7, "POR_VENCER").otherwise("EN_PLAZO")
    return F.when(state == "CUMPLIDO", "CUMPLIDO").when(state == "IMPUGNADO", "IMPUGNADO").when(due.isNull(), "SIN_PLAZO").otherwise(by_days)


def short_id(long_id: Column) -> Column:
    """``YYYY-NNNNN`` from the tail of a 23-digit court id, null without one."""
    d = digits(long_id)
    tail = r"(20\d{2})(\d{5})\d{2}$"
    return F.when(F.regexp_like(d, F.lit(tail)), F.concat_ws("-", F.regexp_extract(d, tail, 1), F.regexp_extract(d, tail, 2)))


def spaced_id(long_id: Column) -> Column:
    """A 23-digit id in groups of 2-3-2-2-3-4-5-2; anything else as it is."""
    return F.regexp_replace(long_id, r"^(\d{2})(\d{3})(\d{2})(\d{2})(\d{3})(\d{4})(\d{5})(\d{2})$", "$1-$2-$3-$4-$5-$6-$7-$8")


#: A filing number that is a form's own, and the digits of a court id's department.
FILING_BLACKLIST, COURT_PREFIX = ("3634740",), "68"
#: Telephone numbers of the office.
FILING_PHONES = ("6076337000", "6076336100", "6076336000")


def valid_filing(c: Column) -> Column:
    """Seven digits or more, not listed, not a court id, not one digit repeated, not a telephone number."""
    d = digits(c)
    return F.coalesce((F.length(d) >= 7) & ~d.isin(*FILING_BLACKLIST, *FILING_PHONES) & ~F.startswith(d, F.lit(COURT_PREFIX)) & ~F.regexp_like(d, F.lit(r"^(\d)\1+$")), F.lit(False))


def case_identity(long_id: Column, name: Column, text: Column) -> Column:
    """What makes two cases one: the id's digits (null unless 17 to 25), the normal name, who represents."""
    d = digits(long_id)
    t = normal_name(text)
    who = first_hit([(_has(t, "PERSONER"), "PERSONERIA"), (_has(t, "AGENTE OFICIOS"), "AGENTE"), (_has(t, "APODERAD"), "APODERADO")], "DIRECTO")
    return F.struct(F.when(F.length(d).between(17, 25), d).alias("long_id"), normal_name(name).alias("name"), who.alias("represented"))


def array_fingerprint(parts: Column) -> Column:
    """md5 of the sorted parts."""
    return F.md5(F.concat_ws("|", F.array_sort(parts)).cast("binary"))


def trigrams(c: Column, upto: int | None = 5000) -> Column:
    """Distinct trigrams of the lower-cased head (None: of the whole text); a shorter text is its own."""
    head = F.lower(c if upto is None else F.left(c, F.lit(upto)))
    three = lambda ch: F.transform(F.sequence(F.lit(0), F.size(ch) - 3), lambda i: F.concat(F.get(ch, i), F.get(ch, i + 1), F.get(ch, i + 2)))
    return F.when(F.length(head) < 3, F.array(head)).otherwise(F.array_distinct(let(F.split(head, ""), three)))


def trigram_overlap(a: Column, b: Column) -> Column:
    """Shared trigrams of two trigram sets over the larger set (not Jaccard)."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def written_date(c: Column) -> Column:
    """``15 de marzo de 2026`` to a date; null if there is none or it is impossible."""
    months = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
    p = r"(?i)(\d{1,2})\s+de\s+(" + "|".join(months) + r")\s+de(?:l)?\s+(\d{4})"
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(F.regexp_extract(c, p, 2)))
    text = F.concat_ws("/", F.regexp_extract(c, p, 1), month.cast("string"), F.regexp_extract(c, p, 3))
    return F.when(month > 0, F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date"))
