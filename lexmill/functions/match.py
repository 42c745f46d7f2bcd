"""What a full-text search asks for: words, phrases, nearness, and their combination, as values over token positions.

``parse`` reads the usual notation: ``tutela salud`` and ``tutela AND salud``, ``OR``, ``NOT``, ``"words in a row"``, ``a + b``, ``pref*``,
``NEAR(a "b c", 5)``, ``column : word``, ``^first`` and brackets. NOT binds before AND, AND before OR, words side by side before all.
Words are folded as the index folds them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.compat import ACCENTED, PLAIN

#: Positions of a column's tokens start at its number times this.
COLUMN_STEP = 1 << 40
_FOLD = str.maketrans(ACCENTED, PLAIN)


@dataclass(frozen=True)
class Word:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[Word, ...]
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int = 10


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Without:
    wanted: object
    unwanted: object


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).translate(_FOLD).lower()


def words_of(text: str, prefix: bool = False) -> tuple[Word, ...]:
    found = re.findall(r"[^\W_]+", fold(text))
    return tuple(Word(w, prefix and i == len(found) - 1) for i, w in enumerate(found))


_LEXEMES = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([():+,^*])|([^\s():+,^*"]+))')


def parse(query: str):
    """A search from its notation; ValueError where it has no meaning."""
    lexemes: list[tuple[str, str]] = []
    at, text = 0, query.strip()
    while at < len(text):
        m = _LEXEMES.match(text, at)
        if not m:
            raise ValueError(f"unreadable from {text[at:]!r} on")
        lexemes.append(("quoted", m[1].replace('""', '"')) if m[1] is not None else ("sign", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    lexemes.append(("end", ""))
    place = 0

    def next_is(*wanted: str) -> bool:
        return lexemes[place][0] != "quoted" and lexemes[place][1] in wanted

    def take(*wanted: str) -> tuple[str, str]:
        nonlocal place
        if wanted and not next_is(*wanted):
            raise ValueError(f"{' or '.join(wanted)} expected before {lexemes[place][1]!r}")
        place += 1
        return lexemes[place - 1]

    def phrase(column: str | None = None) -> Phrase:
        first = next_is("^") and bool(take("^"))
        found: list[Word] = []
        while True:
            kind, said = take()
            if kind not in ("quoted", "word") or (kind == "word" and said in ("AND", "OR", "NOT")):
                raise ValueError(f"a word expected before {said!r}")
            starred = next_is("*") and bool(take("*"))
            found += words_of(said, starred)
            if not next_is("+"):
                return Phrase(tuple(found), column, first)
            take("+")

    def single(column: str | None = None):
        if next_is("("):
            take("(")
            inside = either()
            take(")")
            return inside
        if lexemes[place] == ("word", "NEAR") and lexemes[place + 1] == ("sign", "("):
            take()
            take("(")
            group = []
            while not next_is(")", ","):
                group.append(phrase(column))
            within = 10
            if next_is(","):
                take(",")
                within = int(take()[1])
            take(")")
            return Near(tuple(group), within)
        if lexemes[place][0] == "word" and lexemes[place + 1] == ("sign", ":"):
            name = take()[1]
            take(":")
            return single(name)
        return phrase(column)

    def side_by_side():
        parts = [single()]
        while lexemes[place][0] != "end" and not next_is(")", "AND", "OR", "NOT"):
            parts.append(single())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def without():
        found = side_by_side()
        while next_is("NOT"):
            take("NOT")
            found = Without(found, side_by_side())
        return found

    def joined(word: str, inner, kind):
        parts = [inner()]
        while next_is(word):
            take(word)
            parts.append(inner())
        return parts[0] if len(parts) == 1 else kind(tuple(parts))

    def either():
        return joined("OR", lambda: joined("AND", without, Both), Either)

    found = either()
    if lexemes[place][0] != "end":
        raise ValueError(f"nothing can follow {lexemes[place][1]!r}")
    return found


def phrases_of(search) -> list[Phrase]:
    """All phrases of a search, in order, repeats included."""
    if isinstance(search, Phrase):
        return [search]
    inner = search.phrases if isinstance(search, Near) else (search.wanted, search.unwanted) if isinstance(search, Without) else search.parts
    return [p for x in inner for p in phrases_of(x)]


def words_in(search) -> list[Word]:
    """The different words of a search, in order."""
    return list(dict.fromkeys(w for p in phrases_of(search) for w in p.words))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by).cast("bigint"))


def starts(phrase: Phrase, places: dict[Word, Column], columns: dict[str, int]) -> Column:
    """Where a phrase begins: its first word's places that the other words' follow one by one. A phrase without words begins nowhere."""
    if not phrase.words:
        return F.array().cast("array<bigint>")
    found = places[phrase.words[0]]
    for i, w in enumerate(phrase.words[1:], 1):
        found = F.array_intersect(found, _moved(places[w], i))
    if phrase.column is not None:
        low = F.lit(columns[phrase.column] * COLUMN_STEP)
        found = F.filter(found, lambda x: (x >= low) & (x < low + F.lit(COLUMN_STEP)))
    if phrase.first:
        found = F.filter(found, lambda x: F.pmod(x, F.lit(COLUMN_STEP)) == 0)
    return found


def holds(search, begins: dict[Phrase, Column]) -> Column:
    """Whether a row matches, given where each phrase begins in it."""
    if isinstance(search, Phrase):
        return F.size(begins[search]) > 0
    if isinstance(search, Both):
        return reduce(Column.__and__, (holds(p, begins) for p in search.parts))
    if isinstance(search, Either):
        return reduce(Column.__or__, (holds(p, begins) for p in search.parts))
    if isinstance(search, Without):
        return holds(search.wanted, begins) & ~holds(search.unwanted, begins)

    def follows(first: Phrase, at: Column, other: Phrase) -> Column:
        end = at + F.lit(len(first.words)).cast("bigint")
        return F.exists(begins[other], lambda x: (x >= at) & (x <= end + F.lit(search.within).cast("bigint")))

    # some phrase begins the clump, and each other one begins at most ``within`` tokens behind its end
    def clump(first: Phrase) -> Column:
        rest = [p for p in search.phrases if p is not first]
        return F.exists(begins[first], lambda at: reduce(Column.__and__, (follows(first, at, p) for p in rest), F.lit(True)))

    return reduce(Column.__or__, (clump(p) for p in search.phrases))
