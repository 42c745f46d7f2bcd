"""Column helpers whose semantics differ from Spark's defaults: three-valued filters, LIKE, dates, rounding, ties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCENTED, PLAIN = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãéèêëíìîïóòôöõúùûüñç", "AAAAAEEEEIIIIOOOOOUUUUNCaaaaaeeeeiiiiooooouuuunc"


def like_ci(c: Column, part: str) -> Column:
    """``LIKE '%part%'`` without regard to case; % and _ inside ``part`` stay wildcards."""
    return c.ilike(f"%{part}%")


def filled_trim(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.btrim(c) != "", F.lit(False))


def filled_sql(c: Column) -> Column:
    """``c <> ''``: blanks count as filled, null does not."""
    return F.coalesce(c != "", F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """Percentage, 0 where ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def parse_dmy(c: Column) -> Column:
    """``D/M/YYYY`` or ISO to a date; impossible dates and other text give null."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("d/M/yyyy")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast("date")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded toward minus infinity."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("bigint")


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def normal_name(c: Column) -> Column:
    """Upper case, no accents, single blanks."""
    return F.btrim(F.regexp_replace(strip_accents(F.upper(c)), r"\s+", " "))


def title_case(c: Column) -> Column:
    """A capital after every character that is not a letter."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def top_k(df: DataFrame, count: str, k: int, *tie: str) -> DataFrame:
    """The ``k`` rows of highest ``count``; ties go by ``tie``, so the order is total."""
    return df.orderBy(F.desc(count), *tie).limit(k)


def first_hit(rules: list[tuple[Column, str]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = F
    for condition, label in rules:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def holds_any(c: Column, literals: tuple[str, ...]) -> Column:
    """Whether any of the literals stands in the text; far cheaper than a pattern, so patterns are tried only where what they need is there."""
    return reduce(Column.__or__, (F.contains(c, F.lit(x)) for x in literals))


def all_matches(c: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """Every match of ``pattern``, as an array; ``needs``: literals, one of which stands in every text that has a match."""
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    return F.when(holds_any(c, needs), found).otherwise(F.array().cast("array<string>")) if needs else found


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, wherever Catalyst moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
