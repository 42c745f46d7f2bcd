"""Quality rules as a short-circuit cascade.

Each rule measures a text and says of the measure whether it rejects. A random sample shows what each rule costs and
how much it rejects; the cascade then tries the rules in order of rejection per cost and stops at the first that
fails. The order changes the work, never the verdict. What the cascade has measured is handed on, so that statistics
of the same texts do not measure it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import BLANKS, words

#: Rows (about) by which costs and selectivities are estimated; each rule is timed so often, and the least time counts.
SAMPLE_ROWS, TIMED, SEED = 1000, 2, 20240101
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``measure`` maps a text without nulls and the array of its words to a column of type ``kind``; ``fails`` maps that and the words to a boolean: true rejects."""

    name: str
    kind: str
    measure: Callable[[F.Column, F.Column], F.Column]
    fails: Callable[[F.Column, F.Column], F.Column]


def _let(value: F.Column, f) -> F.Column:
    """``f`` of a value that is computed once, wherever Catalyst moves the expression."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _length_without(text: F.Column, characters: str) -> F.Column:
    return F.length(F.translate(text, characters, ""))


def word_chars(text: F.Column) -> F.Column:
    return _length_without(text, BLANKS)


def n_symbols(text: F.Column) -> F.Column:
    return F.length(text) - _length_without(text, SYMBOLS)


def lines_with_words(text: F.Column) -> F.Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_dup_lines(lines: F.Column) -> F.Column:
    """Lines that equal an earlier one."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def n_repeat_words(w: F.Column) -> F.Column:
    """Words covered by 3-word windows that ``w`` holds twice or more.

    A window is a number: as many low bits as the positions need hold its position, the others bits of its
    hash. Sorted, windows of equal hash are neighbours; their words are compared, and the gaps between the
    positions of those that repeat tell what they cover.
    """
    n = F.size(w) - 2

    def counted(bits: F.Column) -> F.Column:
        code = lambda i: F.call_function("shiftleft", _window_hash(w, i), bits).bitwiseOR(i.cast("bigint"))
        codes = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), code))
        return _let(codes, lambda c: _let(_repeated(c, bits, w), _covered))

    return F.when(n >= 2, _let(F.length(F.bin(n)), counted)).otherwise(F.lit(0))


def _window_hash(w: F.Column, i: F.Column) -> F.Column:
    return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))


def _repeated(c: F.Column, bits: F.Column, w: F.Column) -> F.Column:
    """Positions of the windows whose words another window has, sorted."""
    place = lambda k: F.get(c, k).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1).cast("int")
    near = F.filter(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.call_function("shiftright", F.get(c, k - 1).bitwiseXOR(F.get(c, k)), bits) == 0)

    def differ(k: F.Column) -> F.Column:
        p, q = place(k - 1), place(k)
        return (F.get(w, p) != F.get(w, q)) | (F.get(w, p + 1) != F.get(w, q + 1)) | (F.get(w, p + 2) != F.get(w, q + 2))

    def settled(k: F.Column) -> F.Column:
        places = F.array_distinct(F.flatten(F.transform(k, lambda x: F.array(place(x - 1), place(x)))))
        # different windows of one hash may lie between equal ones: then windows are sorted by their words
        return F.when(F.exists(k, differ), _let(places, lambda x: _same_words(x, w))).otherwise(F.sort_array(places))

    return _let(near, settled)


def _same_words(places: F.Column, w: F.Column) -> F.Column:
    """Of the windows at ``places``, the sorted positions of those whose words another of them has."""
    named = F.sort_array(F.transform(places, lambda p: F.struct(F.concat_ws(" ", F.slice(w, p + 1, 3)).alias("g"), p.alias("p"))))

    def equal(x: F.Column) -> F.Column:
        k = F.filter(F.sequence(F.lit(1), F.size(x) - 1), lambda k: F.get(x, k)["g"] == F.get(x, k - 1)["g"])
        return F.sort_array(F.array_distinct(F.flatten(F.transform(k, lambda k: F.array(F.get(x, k - 1)["p"], F.get(x, k)["p"])))))

    return _let(named, equal)


def _covered(places: F.Column) -> F.Column:
    """Words that windows at these positions cover."""
    following = F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1)))
    steps = F.zip_with(places, following, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x)


#: Each looks at the text and its words, and measures only what it needs.
RULES = [
    Rule("short", "int", lambda t, w: F.size(w), lambda x, w: x < 50),
    Rule("repeats", "int", lambda t, w: n_repeat_words(w), lambda x, w: 100 * x.cast("bigint") > 50 * F.size(w).cast("bigint")),
    Rule("symbols", "int", lambda t, w: n_symbols(t), lambda x, w: 100 * x.cast("bigint") > 10 * F.size(w).cast("bigint")),
    Rule("word_length", "int", lambda t, w: word_chars(t), lambda x, w: ~x.cast("bigint").between(2 * F.size(w).cast("bigint"), 20 * F.size(w).cast("bigint"))),
    Rule(
        "dup_lines",
        "struct<repeated:int,lines:int>",
        lambda t, w: _let(lines_with_words(t), lambda x: F.struct(n_dup_lines(x).alias("repeated"), F.size(x).alias("lines"))),
        lambda x, w: 100 * x["repeated"].cast("bigint") > 50 * x["lines"].cast("bigint"),
    ),
    Rule(
        "shouting",
        "struct<upper:int,chars:int>",
        lambda t, w: F.struct(F.length(F.regexp_replace(t, r"\P{Lu}+", "")).alias("upper"), word_chars(t).alias("chars")),
        lambda x, w: 100 * x["upper"].cast("bigint") > 50 * x["chars"].cast("bigint"),
    ),
]
#: The statistics of a text, and the rule that measures the same with how to read it there.
STATISTICS = {
    "n_words": (lambda t, w: F.size(w), "short", lambda x: x),
    "word_chars": (lambda t, w: word_chars(t), "word_length", lambda x: x),
    "n_symbols": (lambda t, w: n_symbols(t), "symbols", lambda x: x),
    "n_dup_lines": (lambda t, w: _let(lines_with_words(t), n_dup_lines), "dup_lines", lambda x: x["repeated"]),
    "n_repeat_words": (lambda t, w: n_repeat_words(w), "repeats", lambda x: x),
}


def _statistics(text: F.Column, w: F.Column, measured: F.Column | None, rules: list[Rule]) -> list[F.Column]:
    names, out = {r.name for r in rules if r in RULES}, []
    for name, (count, rule, read) in STATISTICS.items():
        own = count(text, w)
        out.append((F.coalesce(read(measured[rule]), own) if measured is not None and rule in names else own).cast("bigint").alias(name))
    return out


def text_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds counts over each whole text (null: empty) to ``df``, in place of columns of the same names.

    n_words, word_chars, n_symbols, n_dup_lines (lines with a word, equal to an earlier one) and n_repeat_words
    (words covered by 3-word windows that the text holds twice or more), all bigint. Hashes only bring windows
    together, words decide. Work and memory are linear in a text's words but for the sort of its windows, so very long
    and very repetitive texts are counted whole. An empty table gives no rows; repeated rows are counted each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(*(c for c in df.columns if c not in STATISTICS), _let(words(text), lambda w: F.struct(*_statistics(text, w, None, []))).alias("__counts"))
    return d.select(*d.columns[:-1], "__counts.*")


def order_rules(sample: DataFrame, rules: list[Rule], text_col: str = "text") -> list[Rule]:
    """Rules by rejection per second on ``sample``, a bounded table that is at hand. Equal scores keep their order.

    What a job without a rule takes (start, reading, words) is no cost of a rule and taken off.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    nothing = Rule("", "int", lambda t, w: F.size(w), lambda x, w: x < 0)

    def timed(r: Rule) -> tuple[float, int]:
        least, rejected = float("inf"), 0
        for _ in range(TIMED):
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(cascade(text, [r])["rejected_by"].isNotNull())).first()[0]
            least = min(least, time.perf_counter() - began)
        return least, rejected

    timed(nothing)  # the first job compiles what all share
    base, scores = timed(nothing)[0], []
    for i, r in enumerate(rules):
        took, rejected = timed(r)
        scores.append((-rejected / max(took - base, 1e-3), i))
    return [rules[i] for _, i in sorted(scores)]


def _cascade(text: F.Column, w: F.Column, rules: list[Rule]) -> F.Column:
    def result(name: F.Column, measured: dict[str, F.Column]) -> F.Column:
        fields = [measured.get(r.name, F.lit(None).cast(r.kind)).alias(r.name) for r in sorted(rules, key=lambda r: r.name)]
        return F.struct(name.cast("string").alias("rejected_by"), F.struct(*fields).alias("measured"))

    def step(k: int, measured: dict[str, F.Column]) -> F.Column:
        if k == len(rules):
            return result(F.lit(None), measured)
        r = rules[k]
        return _let(r.measure(text, w).cast(r.kind), lambda x: F.when(r.fails(x, w), result(F.lit(r.name), measured | {r.name: x})).otherwise(step(k + 1, measured | {r.name: x})))

    return step(0, {})


def cascade(text: F.Column, rules: list[Rule]) -> F.Column:
    """rejected_by: the name of the first rule that rejects, null if none does; measured: what the rules tried have measured, null for later ones, which are not evaluated."""
    return _let(words(text), lambda w: _cascade(text, w, rules)) if rules else F.struct(F.lit(None).cast("string").alias("rejected_by"))


def judge(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, statistics: bool = False) -> DataFrame:
    """``df`` with ``rejected_by`` (the first failing rule in the order found) and ``kept``; with ``statistics``, the columns of ``text_statistics`` too.

    Null, empty and blank texts have no words and are rejected. Repeated rows are judged each. An empty table
    gives no rows. Columns of ``df`` with the names of those added are replaced. Which rule is named may change with
    the measured order where several reject; ``kept`` never does.
    """
    rules = RULES if rules is None else rules
    share = min(1.0, SAMPLE_ROWS / max(df.count(), 1))
    sample = df.select(text_col).sample(False, share, SEED).repartition(2).cache()
    try:
        sample.count()
        ordered = order_rules(sample, rules, text_col)
    finally:
        sample.unpersist()
    text = F.coalesce(F.col(text_col), F.lit(""))

    def judged(w: F.Column) -> F.Column:
        if not ordered:
            return F.struct(F.lit(None).cast("string").alias("rejected_by"), *(_statistics(text, w, None, []) if statistics else []))
        found = lambda x: F.struct(x["rejected_by"].alias("rejected_by"), *(_statistics(text, w, x["measured"], ordered) if statistics else []))
        return _let(_cascade(text, w, ordered), found)

    added = {"rejected_by", "kept", *(STATISTICS if statistics else ())}
    d = df.select(*(c for c in df.columns if c not in added), _let(words(text), judged).alias("__judged"))
    return d.select(*d.columns[:-1], "__judged.*").withColumn("kept", F.col("rejected_by").isNull())
