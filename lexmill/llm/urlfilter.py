"""URL filters by host suffix and path prefix.

Each URL is expanded into (host suffix, path prefix) expressions. They meet the rules in an equi-join on a
short prefix of the expressions' digests; full digests confirm a hit and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast (about 200 bytes each); more are joined by a shuffle, salted.
BROADCAST_RULES = 100_000
#: Characters of a rule's path and labels of its host that its expression holds, which bounds the expressions of one URL; what a longer rule has
#: beyond is compared with the URL itself.
HEAD, LABELS = 2048, 127
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a text without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, HOST_PATH, 1), UPPER, LOWER), F.regexp_extract(url, HOST_PATH, 2)


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The verdict on each row's URL.

    ``rules``: (host, path, verdict), without nulls. A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; among fitting rules that with the longest host and path together wins, then the longer
    host, then ``block`` before ``allow``. Returns the ``keep`` columns, ``host``, ``path``, ``rule`` (host
    and path of the winner, else null) and ``verdict`` (``default`` without a rule). Repeated rows are judged
    each; null and malformed URLs have an empty host and path and fit no rule; an empty rule table gives
    every row ``default``, an empty ``df`` no rows. Other columns of ``df`` are not read. Very long URLs are judged whole: only suffixes
    with as many labels and prefixes with as many characters as some rule has are expanded.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    n_rules = rules.count()
    dots = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) + 1
    # at most LABELS and HEAD + 1 values, whatever the rules
    counts = [r[0] for r in rules.select(F.least(dots(F.col("host")), F.lit(LABELS)).alias("n")).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.least(F.length("path"), F.lit(HEAD)).alias("n")).distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    rows = df.select(*keep, F.monotonically_increasing_id().alias("__row"), host.alias("__host"), path.alias("__path"))

    there = F.filter(F.array(*map(F.lit, sorted(counts))).cast("array<int>"), lambda n: n <= dots(F.col("__host")))
    suffixes = F.transform(there, lambda n: F.call_function("substring_index", F.col("__host"), F.lit("."), -n))
    fitting = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("__path"))
    heads = F.transform(fitting, lambda n: F.substring(F.col("__path"), F.lit(1), n))
    salt = F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int") if n_rules > BROADCAST_RULES else F.lit(0)
    expressions = (
        rows.withColumn("__suffix", F.explode_outer(suffixes))
        .withColumn("__head", F.explode_outer(heads))
        .withColumn("__digest", _digest(F.col("__suffix"), F.col("__head")))
        .withColumn("__short", F.substring("__digest", 1, 8))
        .withColumn("__salt", salt)
    )
    listed = rules.select(
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("verdict"), F.concat("host", "path").alias("rule")
        ).alias("__rule"),
        _digest(F.substring_index("host", ".", -LABELS), F.substring("path", 1, HEAD)).alias("__full"),
        F.when(dots(F.col("host")) > LABELS, F.col("host")).alias("__long"),
        F.expr(f"substring(path, {HEAD + 1})").alias("__rest"),
    ).withColumn("__short", F.substring("__full", 1, 8))
    if n_rules > BROADCAST_RULES:
        listed = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    else:
        listed = F.broadcast(listed.withColumn("__salt", F.lit(0)))
    hits = expressions.join(listed, ["__short", "__salt"], "left")
    whole_host = F.col("__long").isNull() | (F.col("__host") == F.col("__long")) | F.endswith("__host", F.concat(F.lit("."), "__long"))
    whole_path = F.expr(f"startswith(substring(__path, {HEAD + 1}), __rest)")
    found = F.when((F.col("__digest") == F.col("__full")) & whole_host & whole_path, F.col("__rule"))
    # all expressions of a row come from one task: the map side reduces them to one row before the shuffle
    best = hits.groupBy("__row").agg(*(F.first(c).alias(c) for c in [*keep, "__host", "__path"]), F.max(found).alias("__best"))
    return best.select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict")
    )
