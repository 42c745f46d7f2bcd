"""Who takes part in a case, by role: a grammar of formulas over whole texts, lists taken apart, names folded to tell repeats."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.compat import ACCENTED, PLAIN
from lexmill.functions.patterns import possible_in

# --- fixed values: formula, whether it gives a list, and confidence, by role; where a name ends; what a list's part begins with -----------

_CAPS = r"([A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ.]{2,}){1,6})"
_NAME = r"([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ]+(?:\s+[A-Za-zÁÉÍÓÚÑáéíóúñ]+){1,7})"
_ON_LINE = _NAME.replace(r"\s+", "[ \t]+")
GRAMMAR: dict[str, tuple[tuple[str, bool, float], ...]] = {
    "CLAIMANT": ((rf"(?:ACCIONANTE|DEMANDANTE|TUTELANTE|Accionante|Demandante)\s*[:.]\s*{_NAME}", False, 0.9), (rf"(?:interpuest[ao]?|promovida?)\s+por\s+(?:el señor |la señora )?{_NAME}", False, 0.85)),
    "DEFENDANT": ((r"(?:ACCIONAD[OA]S?|DEMANDAD[OA]S?|Accionad[oa]s?|Demandad[oa]s?)\s*[:.]\s*([^.\n]{4,300})", True, 0.8), (r"(?i)\bcontra\s+((?:la\s+|el\s+|los\s+)?[^.,\n]{3,120})", True, 0.7)),
    "LINKED": ((r"(?i)\bvinculad[oa]s?\s*[:.]\s*([^.\n]{4,300})", True, 0.75), (r"(?i)\bvinc[úu]lese\s+(?:de\s+oficio\s+)?(?:a\s+)?([^.\n]{4,500})", True, 0.7)),
    "JUDGE": ((rf"\b(?:JUEZ|JUEZA|Juez|Jueza)\s*[:.]\s*{_ON_LINE}", False, 0.7),),
    "LAWYER": ((rf"(?:Proyect[oó]|Elabor[oó]|Revis[oó]|Aprob[oó])\s*[:.]\s*{_ON_LINE}", False, 0.9),),
    "MINOR": ((rf"(?:agente\s+oficios[oa]\s+de\s+su\s+hij[oa]|su\s+hij[oa](?:\s+menor)?(?:\s+de\s+edad)?|representante\s+legal\s+del?\s+menor|\bmenor(?:\s+de\s+edad)?)\s+{_CAPS}", False, 0.8),),
}
ENDS = re.compile(r"(?i)\s+(?:contra|como|identificad[oa]|en\s+(?:calidad|nombre)|vs|act[uú]a|interpone|oficina)\b.*$", re.DOTALL)
LIST_PARTS, LEADING = re.compile(r"\s*[-–,;]\s*|\s+Y\s+|\s+y\s+(?=(?:la\s+|el\s+|al\s+)?[A-ZÁÉÍÓÚÑ])"), re.compile(r"(?i)^(?:(?:a\s+)?(?:la|las|el|los)\s+|al\s+|del?\s+)+")

# --------------------------------------------------------------------------------------------------------------------------------------

#: By formula, literals in small letters, one of which stands in every text that has a match.
NEEDS: dict[str, tuple[tuple[str, ...], ...]] = {
    "CLAIMANT": (("accionante", "demandante", "tutelante"), ("interpuest", "promovid")), "DEFENDANT": (("accionad", "demandad"), ("contra",)), "LINKED": (("vinculad",), ("lese",)),
    "JUDGE": (("juez",),), "LAWYER": (("proyect", "elabor", "revis", "aprob"),), "MINOR": (("hij", "menor"),),
}
_COMPILED = [(role, re.compile(p), many, sure, needs) for role, rules in GRAMMAR.items() for (p, many, sure), needs in zip(rules, NEEDS[role], strict=True)]
_FOLD = str.maketrans(ACCENTED, PLAIN)


class Actor(NamedTuple):
    role: str
    name: str
    folded: str
    start: int
    confidence: float


def folded(name: str) -> str:
    return re.sub(r"[^A-Z0-9 ]+", "", re.sub(r"\s+", " ", name).translate(_FOLD).upper()).strip()


def actors_of(text: str | None) -> list[Actor]:
    """The actors of a text, of each role a name once, in order of role and place; of the formulas that give a name the surest counts."""
    if not text:
        return []
    best: dict[tuple[str, str], Actor] = {}
    possible = possible_in(text)
    for role, pattern, many, sure, needs in _COMPILED:
        if not possible(needs):
            continue
        for m in pattern.finditer(text):
            said, at = m.group(1), m.start(1)
            for part in LIST_PARTS.split(said) if many else [said]:
                name = LEADING.sub("", ENDS.sub("", part).strip(" .,-\t\n")) if many else ENDS.sub("", said)
                name = re.sub(r"\s+", " ", name).strip(" .,-")
                key = role, folded(name)
                if len(key[1]) >= 3 and (key not in best or best[key].confidence < sure):
                    best[key] = Actor(role, name, key[1], max(text.find(part, at), at) if many else at, sure)
    order = list(GRAMMAR)
    return sorted(best.values(), key=lambda a: (order.index(a.role), a.start, a.folded))


def actors(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, role, name, folded, start, confidence, more columns) of every text; null and empty ones have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *a) for i, t in enumerate(batch.column(1).to_pylist()) for a in actors_of(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64())
            own = batch.select([key, *more]).take(pa.array(columns[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)), *own.columns[1:]], [key, *Actor._fields, *more])

    types = dict(df.dtypes)
    return df.select(key, F.col(text).alias("__text"), *more).mapInArrow(run, ", ".join([f"`{key}` {types[key]}, role string, name string, folded string, start int, confidence double", *(f"`{c}` {types[c]}" for c in more)]))


def actors_of_cases(found: DataFrame, documents: DataFrame, key: str, case: str) -> DataFrame:
    """(case, role, folded, name, confidence, documents): each actor of a case once, as its surest and then first document writes it. ``found`` may hold the case."""
    d = found if case in found.columns else found.join(documents.select(key, case), key)
    best = F.min_by(F.struct("name", "confidence"), F.struct(-F.col("confidence"), key, "start"))
    return d.groupBy(case, "role", "folded").agg(best.alias("b"), F.count_distinct(key).alias("documents")).select(case, "role", "folded", "b.name", "b.confidence", "documents")
