"""Mixing sources to target weights by entropy balancing.

A document of size x in source s is taken at the rate min(cap, exp(lambda_s x)): the rates nearest to 1 (in
relative entropy) that meet each source's token target and the cap. Distributed Newton steps find lambda on
a table of (source, size, count), then rates become whole copies. DataFrame operations only; the driver
holds one row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import staged, words

#: The dual vector is on the driver and broadcast: so many sources at most.
MAX_SOURCES = 100_000
#: (source, size) cells up to this number are broadcast to the documents (about 60 bytes each); more are joined by a shuffle.
BROADCAST_CELLS = 100_000
#: Documents of one cell that are ranked together.
RANKED = 1024
CYCLE = (5.0, 2.0, 1.0)


def spread_targets(sizes: list[float], weights: list[float], cap: float) -> list[float]:
    """Shares of the total by weight; what exceeds ``cap`` times a source's size is reshared until nothing does."""
    targets, total, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        left = total - sum(t for i, t in enumerate(targets) if i not in free)
        by_weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / by_weight > cap * sizes[i]}
        for i in over or free:
            targets[i] = float(cap * sizes[i]) if over else left * weights[i] / by_weight
        free -= over or free
    return targets


def _with(table: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``table`` with the per-source ``rows`` (first field: source, null matching null); sources without one go."""
    own = table.sparkSession.createDataFrame(rows, schema.replace("source", "__source", 1))
    return table.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _rate(cap: float) -> F.Column:
    return F.when(F.col("tilt") * F.col("size") / F.col("scale") >= math.log(cap), F.lit(cap)).otherwise(F.exp(F.col("tilt") * F.col("size") / F.col("scale")))


def solve_tilts(cells: DataFrame, sources: list[tuple], cap: float, rounds: int = 80) -> dict:
    """source -> tilt. ``sources``: (source, mean size, target, size). Newton's method, kept inside a bracket."""
    tilt = {s: 0.0 for s, *_ in sources}
    low, high = dict.fromkeys(tilt, -math.inf), dict.fromkeys(tilt, math.inf)
    tilt |= {s: math.inf for s, _, t, words in sources if words and t >= cap * words * (1 - 1e-12)}
    open_ = [x for x in sources if x[3] and tilt[x[0]] == 0.0]
    for _ in range(rounds):
        if not open_:
            break
        d = _with(cells, [(s, scale, tilt[s]) for s, scale, *_ in open_], "source string, scale double, tilt double").withColumn("rate", _rate(cap))
        exact = lambda c: F.sum(c.cast("decimal(38,8)")).cast("double")  # noqa: E731  sums that no order of rows changes
        sums = d.groupBy("source").agg(
            exact(F.col("n") * F.col("size") * F.col("rate")).alias("got"),
            exact(F.when(F.col("rate") < cap, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * F.col("rate")).otherwise(0.0)).alias("slope"),
        )
        got = {r["source"]: (r["got"], r["slope"]) for r in sums.collect()}
        still = []
        for s, scale, target, words in open_:
            value, slope = got[s]
            if abs(value - target) <= max(1e-7 * target, 0.01):
                continue
            (low if value < target else high)[s] = tilt[s]
            nxt = tilt[s] + (target - value) / slope if slope > 0 else math.nan
            if not low[s] < nxt < high[s] or abs(nxt - tilt[s]) > 4 * (1 + abs(tilt[s])):
                if math.isinf(high[s]):
                    nxt = max(1.0, 2 * low[s] + 1)
                elif math.isinf(low[s]):
                    nxt = min(-1.0, 2 * high[s] - 1)
                else:
                    nxt = (low[s] + high[s]) / 2
            tilt[s] = nxt
            still.append((s, scale, target, words))
        open_ = still
    return tilt


def mix(df: DataFrame, text_col: str = "text", source_col: str = "source", key: str = "doc_id", cycle: tuple[float, ...] = CYCLE, cap: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    Sources in code point order, null last, weigh ``cycle``, repeating; they share all words, none above
    ``cap`` times its own. Returns ``key``, ``source``, ``size`` (words), ``source_size``, ``target`` (its
    source's), ``copies`` (0 to ``cap``) and ``taken`` (copies times size). Null and blank texts have size 0
    and no copies; a null source is a source. Repeated rows are documents of their own; rows equal in key,
    source and size are ranked by key hash only, so which of them gets the extra copy is arbitrary but the
    result as a table is the same. With ``carry``, these columns come along as a struct ``row``, so that no join
    by ``key`` is needed, and they decide between such rows. Reruns agree. An empty table gives no rows.
    """
    row = [F.struct(*carry).alias("row")] if carry else []
    names = ["row"] if carry else []
    docs = staged(df.select(*row, F.col(key), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("bigint").alias("size")), "sizes")
    cells = staged(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in totals]
    targets = spread_targets(sizes, [cycle[i % len(cycle)] for i in range(len(totals))], cap)
    sources = [(r["source"], max(r["words"], 1) / r["docs"], t, r["words"]) for r, t in zip(totals, targets, strict=True)]
    tilt = solve_tilts(cells, sources, cap)
    schema = "source string, source_size bigint, target double, scale double, tilt double"
    state = [(s, w, t, scale, tilt[s] if math.isfinite(tilt[s]) else 1e300) for s, scale, t, w in sources]
    # cumulated rates, largest documents first: rounding never strays by more than half a document
    run = Window.partitionBy("source").orderBy(F.desc("size"))
    rated = _with(cells, state, schema).withColumn("want", F.col("n") * F.when(F.col("size") > 0, _rate(cap)).otherwise(0.0))
    rated = rated.withColumn("upto", F.sum("want").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.round("upto").cast("bigint")
    rated = rated.withColumn("copies", F.greatest(F.lit(0), F.least(whole - F.lag(whole, 1, 0).over(run), cap * F.col("n"))).cast("bigint"))
    rated = staged(rated.select("source", "size", "n", "source_size", "target", "copies"), "rated")
    changes = _settle(rated, cap)
    if changes:
        more = docs.sparkSession.createDataFrame(changes, "__source string, __size bigint, more bigint")
        rated = rated.join(F.broadcast(more), F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")), "left")
        rated = rated.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("__source", "__size", "more")
    plan = rated.select(F.col("source").alias("__source"), F.col("size").alias("__size"), "n", "source_size", "target", "copies")
    plan = F.broadcast(plan) if cells.count() <= BROADCAST_CELLS else plan
    d = docs.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size"))).drop("__source", "__size")
    d = d.withColumn("parts", F.ceil(F.col("n") / RANKED)).withColumn("part", F.pmod(F.xxhash64(F.col(key), F.lit(1), *names), F.col("parts")))
    group = Window.partitionBy("source", "size", "part")
    extra = F.col("copies") % F.col("n")
    shift = F.pmod(F.xxhash64("source", "size", "part"), F.lit(1 << 20)) / (1 << 20)
    quota = F.floor(F.count("*").over(group) * extra / F.col("n") + shift)
    ranked = F.row_number().over(group.orderBy(F.xxhash64(key), key, *names)) <= quota
    d = d.withColumn("share", F.floor(F.col("copies") / F.col("n")).cast("bigint") + ranked.cast("bigint"))
    return d.select(*names, key, "source", "size", "source_size", "target", F.least("share", F.lit(cap)).cast("bigint").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _settle(rated: DataFrame, cap: int, rounds: int = 16, near: float = 2e-4) -> list[tuple]:
    """(source, size, copies to add or take away): brings sums that are still off nearer to their targets.

    Each round gives or takes, per source, as many copies as fit of the largest size that fits into what is
    off. What is off is at most one document at first, so only small sources need it at all.
    """
    sums = rated.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("got"), F.max("target").alias("target"))
    off = {r["source"]: [r["target"] - r["got"], 1 << 60, r["target"]] for r in sums.collect()}
    changes = []
    for _ in range(rounds):
        rows = [(s, float(gap), limit) for s, (gap, limit, target) in off.items() if abs(gap) > max(0.5, near * target)]
        if not rows:
            break
        d = _with(rated, rows, "source string, gap double, below bigint")
        room = F.when(F.col("gap") > 0, cap * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        fits = d.withColumn("room", room).where((F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (F.col("size") < F.col("below")) & (F.col("room") > 0))
        found = fits.groupBy("source").agg(F.max(F.struct("size", "room")).alias("best")).collect()
        for s in {r[0] for r in rows} - {r["source"] for r in found}:
            off[s][0] = 0.0
        for r in found:
            gap, (size, room_) = off[r["source"]][0], r["best"]
            k = min(int(abs(gap) // size), room_)
            k = k if gap > 0 else -k
            changes.append((r["source"], size, k))
            off[r["source"]][0], off[r["source"]][1] = gap - k * size, size
    return changes
