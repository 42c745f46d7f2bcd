"""Personal data: spans, redaction with tokens stable in a case, the gate, and putting values back."""

from __future__ import annotations

import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.compat import all_matches, let

#: Kinds of spans and their patterns; the first kind wins where two overlap.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"(?<![\d.])3\d{9}(?!\d)",
    "ID": r"(?<![\d.])\d{1,3}(?:\.\d{3}){2,3}(?![\d.])",
    "NUMBER": r"(?<!\d)\d{7,10}(?!\d)",
}
TOKEN = r"\[[A-Z_]+_\d+\]"
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def find_spans(text: str | None) -> list[tuple[int, int, str, str]]:
    """Spans that do not overlap, by place; earlier kinds of PATTERNS win."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in _COMPILED.items():
        starts, found = [x[0] for x in taken], []
        for m in pattern.finditer(text or ""):
            # taken spans do not overlap, so only the neighbours can
            k = bisect_left(starts, m.start())
            if (k == len(taken) or m.end() <= starts[k]) and (k == 0 or taken[k - 1][1] <= m.start()):
                found.append((m.start(), m.end(), kind, m.group()))
        taken = sorted(taken + found)
    return taken


@F.pandas_udf(SPAN)
def spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("start", "end", "kind", "value"), s, strict=True)) for s in find_spans(t)])


def keyed_hash(secret: bytes, kind: str, value: str) -> str:
    return hmac.new(secret, f"{kind}:{value.strip().lower()}".encode(), hashlib.sha256).hexdigest()[:24]


def keyed_hash_column(secret: bytes, kind: Column, value: Column) -> Column:
    """``keyed_hash`` as a column: HMAC-SHA256 of kind and normal value, 24 hexadecimal digits."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    message = F.concat(kind, F.lit(":"), F.lower(F.btrim(value))).cast("binary")
    return F.left(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256), F.lit(24))


#: Kinds that each policy redacts.
POLICIES = {"selective": ("ID", "NUIP", "PHONE", "EMAIL", "ADDRESS"), "aggressive": ("ID", "NUIP", "PHONE", "EMAIL", "ADDRESS", "NUMBER", "DIAGNOSIS")}
#: What the gate looks for once tokens are out. No look-around: each pattern stands alone.
RESIDUES = {
    "address": r"(?i)\b(?:calle|carrera|cra|cl)\.? \d+", "bare": r"\b\d{7,10}\b", "dotted": r"\b\d{1,3}(?:\.\d{3}){2,3}\b", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mobile": r"\b3\d{9}\b", "nuip": r"(?i)\b(?:RC|registro civil) (?:No\.? ?)?\d{10,11}\b",
}
#: The same patterns, with their first character before the word boundary that must precede it: a boundary is dear, and was sought at every place. What stands in every match.
QUICK = {
    "address": r"(?i)c(?<=\bc)(?:alle|arrera|ra|l)\.? \d+", "bare": r"\d(?<=\b\d)\d{6,9}\b", "dotted": r"\d(?<=\b\d)\d{0,2}(?:\.\d{3}){2,3}\b", "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "mobile": r"3(?<=\b3)\d{9}\b", "nuip": r"(?i)r(?<=\br)(?:C|egistro civil) (?:No\.? ?)?\d{10,11}\b",
}
RESIDUE_NEEDS = {"email": ("@",), "dotted": (".",)}


def residues(text: Column) -> Column:
    """Counts by kind of what is left of personal data once tokens are blanks; numbers that are mobile ones do not count as bare."""
    c = F.coalesce(text, F.lit(""))

    def counted(bare: Column) -> Column:
        n = {k: F.size(all_matches(bare, QUICK[k], RESIDUE_NEEDS.get(k, ()))).cast("bigint") for k in RESIDUES}
        return F.struct(*(n[k].alias(k) for k in RESIDUES))

    n = let(F.when(F.contains(c, F.lit("[")), F.regexp_replace(c, TOKEN, " ")).otherwise(c), counted)
    return let(n, lambda n: F.struct(*((n[k] - n["mobile"] if k == "bare" else n[k]).alias(k) for k in RESIDUES)))


def vault(df: DataFrame, case: str, order: str, text: str) -> DataFrame:
    """(case, kind, value, token): values numbered per case and kind by first appearance, documents in ``order``, each from its end."""
    s = df.select(case, order, F.explode(spans(F.coalesce(text, F.lit("")))).alias("s"))
    first = s.groupBy(case, F.col("s.kind").alias("kind"), F.lower(F.col("s.value")).alias("value")).agg(F.min(F.struct(F.col(order), -F.col("s.start"))).alias("at"))
    n = F.row_number().over(Window.partitionBy(case, "kind").orderBy("at"))
    return first.select(case, "kind", "value", F.concat(F.lit("["), "kind", F.lit("_"), n.cast("string"), F.lit("]")).alias("token"))


def redact(df: DataFrame, case: str, key: str, text: str, mapping: DataFrame) -> DataFrame:
    """``key``, case and the text with every span replaced by its token. Values meet tokens in an equi-join."""
    d = df.select(key, case, F.col(text).alias("text"), spans(F.coalesce(text, F.lit(""))).alias("s"))
    hits = d.select(key, case, F.explode("s").alias("x")).select(key, case, "x.start", "x.end", F.col("x.kind").alias("kind"), F.lower("x.value").alias("value"))
    tokens = hits.join(mapping, [case, "kind", "value"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("r"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, r in zip(pdf["text"], pdf["r"], strict=True):
                for x in reversed(list(r) if r is not None else []):
                    t = t[: x["start"]] + x["token"] + t[x["end"] :]
                out.append(t)
            yield pdf.assign(redacted=out).drop(columns=["text", "r"])

    kinds = dict(df.dtypes)
    joined = d.drop("s").join(tokens, key, "left")
    return joined.mapInPandas(run, f"{key} {kinds[key]}, {case} {kinds[case]}, redacted string")


def gate(text: Column) -> Column:
    """What personal data is left once tokens are taken out: counts by kind."""
    bare = F.regexp_replace(text, TOKEN, " ")
    return F.struct(*(F.size(F.regexp_extract_all(bare, F.lit(f"({p})"), F.lit(0))).cast("bigint").alias(k.lower()) for k, p in PATTERNS.items()))
