"""Matching of incoming records to cases: the first tier that hits wins, within it the case of smallest id.

Cases are reduced to the smallest id of each key before the joins, so a key that many cases share makes no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.classes import year_sequence
from lexmill.functions.compat import digits

#: Digits that an id needs before its parts are compared, and where its court's code lies.
LEAST_DIGITS, COURT_AT, COURT_LENGTH = 18, 6, 7
#: Tiers by the offline variant's confidence.
CONFIDENCE = {"court_id": 0.95, "filing": 0.9, "short": 0.8, "claimant": 0.7}


def long_digits(c: Column) -> Column:
    """The digits of an id that has enough of them, else null."""
    d = digits(c)
    return F.when(F.length(d) >= LEAST_DIGITS, d)


def first_of(new: DataFrame, cases: DataFrame, key: str, out: str) -> DataFrame:
    """``new`` with ``out``: the smallest case id of its key; null keys match nothing."""
    least = cases.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(out))
    return new.join(least, key, "left")


def first_allowed(new: DataFrame, cases: DataFrame, key: str, guard: str, out: str) -> DataFrame:
    """As ``first_of``, but a case whose guard and the record's are both known and differ does not count."""
    known = cases.where(F.col(key).isNotNull())
    every = known.groupBy(key).agg(F.min("id").alias("__any"), F.min(F.when(F.col(guard).isNull(), F.col("id"))).alias("__free"))
    own = known.where(F.col(guard).isNotNull()).groupBy(key, guard).agg(F.min("id").alias("__own"))
    d = new.join(every, key, "left").join(own, [key, guard], "left")
    return d.withColumn(out, F.when(F.col(guard).isNull(), F.col("__any")).otherwise(F.least("__free", "__own"))).drop("__any", "__free", "__own")


def containing(parts: DataFrame, texts: DataFrame, part: str, text: str, gram: int) -> DataFrame:
    """(part, text) for distinct ``parts`` of at least ``gram`` characters that a distinct text contains, without regard to case.

    They meet where the part's first ``gram`` characters are a gram of the text; ``contains`` confirms.
    """
    p = parts.select(F.col(part).alias("part")).where(F.length("part") >= gram).distinct().withColumn("__g", F.left(F.lower("part"), F.lit(gram)))
    x = texts.select(F.col(text).alias("text")).where(F.length("text") >= gram).distinct()
    starts = F.sequence(F.lit(1), F.length("text") - (gram - 1))
    x = x.withColumn("__g", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substr(F.lower("text"), i, F.lit(gram))))))
    return p.join(x, "__g").where(F.contains(F.lower("text"), F.lower("part"))).select("part", "text")


def with_keys(d: DataFrame, short: str) -> DataFrame:
    """Adds the parts of ids by which records and cases meet."""
    long_ = long_digits(F.coalesce("court_id", F.lit("")))
    parts = {
        "__front": F.left(long_, F.lit(20)),
        "__ends": F.concat(F.left(long_, F.lit(5)), F.lit(":"), F.right(long_, F.lit(12))),
        "__court": F.substr(long_, F.lit(COURT_AT), F.lit(COURT_LENGTH)),
        "__short": year_sequence(F.col(short)),
    }
    return d.withColumns(parts)


def match_cases(new: DataFrame, cases: DataFrame) -> DataFrame:
    """(key, tier, case_id) of every record; both null if no case matches.

    ``new``: key, court_id, short, filing, person, claimant. ``cases``: id, court_id, folder, filing, claimant, notes, subject, status.
    Tiers: 20 digits of the court's id; its first 5 and last 12; the person's number in a text of the case; the
    filing; year and sequence, unless the courts are known and differ; an ombudsman's town; the claimant's first
    20 characters, which match nothing at all if year and sequence differ.
    """
    c = with_keys(cases, "folder")
    n = with_keys(new, "short")
    for key in ("__front", "__ends"):
        n = first_of(n, c, key, f"{key}_id")
    # numbers of seven digits or more in the texts of a case that was not merged
    numbers = F.regexp_extract_all(F.concat_ws(" ", "notes", "claimant", "subject"), F.lit(r"\d{7,}"), F.lit(0))
    persons = cases.where("status <> 'DUPLICATE_MERGED'").select("id", F.explode(F.array_distinct(numbers)).alias("__person"))
    n = first_of(n.withColumn("__person", F.when(F.length("person") >= 7, F.col("person"))), persons, "__person", "__person_id")
    n = first_of(n.withColumn("__filing", F.when(F.length("filing") >= 8, F.col("filing"))), cases.withColumn("__filing", F.col("filing")), "__filing", "__filing_id")
    n = first_allowed(n, c, "__short", "__court", "__short_id")
    # ombudsmen: the town that the record names, in the claimant of a case that is one
    town = F.upper(F.regexp_extract("claimant", r"(?iU)(?:personero|personera|personer[ií]a)\s+(?:municipal\s+)?(?:de|del)\s+(?:el\s+)?([A-Za-záéíóúñÁÉÍÓÚÑ]+)", 1))
    n = n.withColumn("__town", F.when((F.length(town) >= 3) & ~town.isin("SANTANDER", "LA", "DE"), town))
    ombudsmen = c.where(F.regexp_like(F.upper("claimant"), F.lit("PERSONER[OA]|PERSONERÍA")))
    named = containing(n, ombudsmen, "__town", "claimant", 3).select(F.col("part").alias("__town"), F.col("text").alias("claimant"))
    n = first_allowed(n, ombudsmen.select("id", "claimant", "__short").join(named, "claimant"), "__town", "__short", "__town_id")
    n = n.withColumn("__head", F.when(F.length("claimant") >= 8, F.left("claimant", F.lit(20))))
    named = containing(n, cases, "__head", "claimant", 8).select(F.col("part").alias("__head"), F.col("text").alias("claimant"))
    first = cases.select("id", "claimant", year_sequence(F.col("folder")).alias("__theirs")).join(named, "claimant").groupBy("__head").agg(F.min_by(F.struct("id", "__theirs"), "id").alias("__first"))
    n = n.join(first, "__head", "left")
    differ = F.coalesce(F.col("__first.__theirs") != F.col("__short"), F.lit(False))
    tiers = [("court_id", "__front_id"), ("court_parts", "__ends_id"), ("person", "__person_id"), ("filing", "__filing_id"), ("short", "__short_id"), ("ombudsman", "__town_id"), ("claimant", "__claimant_id")]
    n = n.withColumn("__claimant_id", F.when(~differ, F.col("__first.id")))
    hit = F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(t).alias("tier"), F.col(c).alias("case_id"))) for t, c in tiers))
    return n.select("key", hit.alias("__hit")).select("key", "__hit.tier", "__hit.case_id")


def match_unique(new: DataFrame, cases: DataFrame) -> DataFrame:
    """(key, tier, case_id, confidence) by the first tier that exactly one case meets; records without one are left out."""
    keys = {"court_id": "__front", "filing": "filing", "short": "__short", "claimant": "__name"}
    name = lambda d: d.withColumn("__name", F.when(F.length(F.btrim("claimant")) >= 8, F.lower(F.btrim("claimant"))))
    n, c = name(with_keys(new, "short")), name(with_keys(cases, "folder"))
    hits = []
    for tier, key in keys.items():
        one = c.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(f"__{tier}_id"), F.count("*").alias("__n")).where("__n = 1").drop("__n")
        n = n.join(one, key, "left")
        hits.append(F.when(F.col(f"__{tier}_id").isNotNull(), F.struct(F.lit(tier).alias("tier"), F.col(f"__{tier}_id").alias("case_id"), F.lit(CONFIDENCE[tier]).alias("confidence"))))
    return n.select("key", F.coalesce(*hits).alias("h")).where("h is not null").select("key", "h.*")


def lowest(d: DataFrame, key: str, k: int) -> DataFrame:
    """(key, id) of the ``k`` smallest ids of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("id"))
    return d.where(F.col(key).isNotNull()).withColumn("__k", place).where(F.col("__k") <= k).select(key, "id")


def suggest_cases(docs: DataFrame, cases: DataFrame, k: int = 5) -> DataFrame:
    """(id, tier, case_id): up to ``k`` other cases for each document; a tier counts only if none above it hits.

    ``docs``: id, case_id, text, filename. ALTA: the last 12 digits of an id in the text; MEDIA: a year and
    sequence in it; BAJA: a claimant's first name of four letters or more in the file's name.
    """
    c = with_keys(cases, "folder").withColumn("__tail", F.right(long_digits(F.coalesce("court_id", F.lit(""))), F.lit(12)))
    c = c.withColumn("__first", F.upper(F.regexp_extract(F.btrim("claimant"), r"(?U)^(\p{L}{4,})\b", 1))).withColumn("__first", F.nullif("__first", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    d = docs.select(
        F.col("id").alias("doc"),
        F.col("case_id").alias("own"),
        F.transform(F.regexp_extract_all(text, F.lit(r"68\d{17,21}"), F.lit(0)), lambda x: F.right(x, F.lit(12))).alias("__tail"),
        F.transform(F.regexp_extract_all(text, F.lit(r"\b20\d{2}-\d{3,5}\b"), F.lit(0)), year_sequence).alias("__short"),
        F.regexp_extract_all(F.upper("filename"), F.lit(r"(?U)\p{L}{4,}"), F.lit(0)).alias("__first"),
    )
    found = None
    for tier, key in ((1, "__tail"), (2, "__short"), (3, "__first")):
        # one more than k, as the document's own case may be among them
        hit = d.select("doc", "own", F.explode(F.array_distinct(key)).alias(key)).join(lowest(c.select("id", key), key, k + 1), key).where("id <> own").select("doc", F.lit(tier).alias("tier"), "id").distinct()
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy("doc").agg(F.min("tier").alias("tier"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("id"))
    out = found.join(best, ["doc", "tier"]).withColumn("__k", place).where(F.col("__k") <= k)
    return out.select(F.col("doc").alias("id"), F.element_at(F.array(*map(F.lit, ("ALTA", "MEDIA", "BAJA"))), F.col("tier")).alias("tier"), F.col("id").alias("case_id"))


def related_cases(cases: DataFrame, k: int = 10) -> DataFrame:
    """(id, other): up to ``k`` cases, of smallest ids, that share the first five digits of the id or the claimant's first name."""
    first = F.nullif(F.upper(F.regexp_extract(F.btrim("claimant"), r"^(\S+)", 1)), F.lit(""))
    d = cases.select("id", F.left(long_digits(F.coalesce("court_id", F.lit(""))), F.lit(5)).alias("__court"), first.alias("__first"))
    found = None
    for key in ("__court", "__first"):
        near = lowest(d.select("id", key), key, k + 1).withColumnRenamed("id", "other")
        hit = d.select("id", key).join(near, key).where("id <> other").select("id", "other")
        found = hit if found is None else found.unionByName(hit)
    place = F.row_number().over(Window.partitionBy("id").orderBy("other"))
    return found.distinct().withColumn("__k", place).where(F.col("__k") <= k).select("id", "other")
