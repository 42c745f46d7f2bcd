"""Extraction of fields by the catalogue of patterns: one pass over each text, then the best value of each field of a case."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.cases import valid_filing
from lexmill.functions.compat import digits
from lexmill.functions.patterns import CATALOGUE, finder, value_of


def found_values(df: DataFrame, key: str, text: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """(key, pattern, field, value, start, end, confidence) of every match in every text, whole texts; places count characters from 0.

    ``names`` limits the patterns. Each text is read once, whatever the number of patterns; null texts have no match.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = finder(names)
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows += [(i, p.name, p.field, value_of(p, m), m.start(p.parts[-1]), m.end(p.parts[-1]), p.confidence) for p, m in own.matches(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int32())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], [key, "pattern", "field", "value", "start", "end", "confidence"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, pattern string, field string, value string, start int, end int, confidence int")


def _valid(field: Column, value: Column) -> Column:
    n = F.length(digits(value))
    return F.when(field == "court_id", (n >= 20) & F.startswith(digits(value), F.lit("68"))).when(field == "filing", F.coalesce(valid_filing(value), F.lit(False))).when(field.isin("claimant"), F.length(value) >= 5).when(field == "city", F.length(value) >= 3).otherwise(True)


def best_fields(found: DataFrame, documents: DataFrame, key: str, case: str, priority: Column) -> DataFrame:
    """(case, field, value, confidence, pattern, key): of each case and field the first valid value by the document's ``priority`` (low first), the catalogue's order, key and place."""
    order = F.lit(len(CATALOGUE))
    for i, p in enumerate(CATALOGUE):
        order = F.when(F.col("pattern") == p.name, i).otherwise(order)
    own = documents.select(key, case, priority.alias("priority"))
    d = found.where(_valid(F.col("field"), F.col("value"))).join(own, key)
    best = F.min_by(F.struct("value", "confidence", "pattern", key), F.struct("priority", order, key, "start"))
    return d.groupBy(case, "field").agg(best.alias("b")).select(case, "field", "b.value", "b.confidence", "b.pattern", f"b.{key}")


def compared_versions(found: DataFrame, documents: DataFrame, rows: DataFrame, key: str, case: str, priority: Column, versions: dict[str, tuple[str, ...]], fields: dict[str, Column]) -> DataFrame:
    """(version, field, match, mismatch, row_only, found_only): what each version, a set of patterns, would give the cases, against what their rows hold.

    ``rows`` has ``case`` and the columns that ``fields`` are made of; values are compared by their digits if they have any, else as they
    are. Texts are scanned once, whatever the number of versions: ``found`` has the matches of all patterns, and each version takes its own.
    """
    of = F.explode(F.filter(F.array(*(F.when(F.col("pattern").isin(*names), F.lit(v)) for v, names in versions.items())), lambda x: x.isNotNull()))
    order = F.lit(len(CATALOGUE))
    for i, p in enumerate(CATALOGUE):
        order = F.when(F.col("pattern") == p.name, i).otherwise(order)
    d = found.where(F.col("field").isin(*fields) & _valid(F.col("field"), F.col("value"))).select("*", of.alias("version")).join(documents.select(key, case, priority.alias("priority")), key)
    best = d.groupBy("version", case, "field").agg(F.min_by("value", F.struct("priority", order, key, "start")).alias("got"))
    every = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(f).alias("field"), c.alias("held")) for v in versions for f, c in fields.items())))
    held = rows.select(case, every.alias("x")).select(case, "x.*")
    plain = lambda c: F.nullif(F.coalesce(F.nullif(digits(F.col(c)), F.lit("")), F.upper(F.btrim(c))), F.lit(""))
    both = held.join(best, ["version", case, "field"], "left").select("version", "field", plain("held").alias("h"), plain("got").alias("g"))
    n = lambda c, name: F.count_if(c).alias(name)
    there, here = F.col("h").isNotNull(), F.col("g").isNotNull()
    return both.groupBy("version", "field").agg(n(there & here & (F.col("h") == F.col("g")), "match"), n(there & here & (F.col("h") != F.col("g")), "mismatch"), n(there & ~here, "row_only"), n(~there & here, "found_only"))
