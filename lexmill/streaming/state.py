"""Keyed state in streams: the guard of notes by fingerprint, the pause after a refused call, and the body of a mail batch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.functions import classes, extract
from lexmill.operators.matching import match_cases

#: Seconds that a provider is left alone after a refused call (fixed value).
PAUSE_SECONDS = 60
#: State is kept in RocksDB, which transformWithState asks for.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Guard(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "print string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        pdf = pd.concat(rows).sort_values("seq")
        before = pdf["print"].shift(1)
        before.iloc[0] = last
        said = pdf["print"].fillna("") != ""
        if said.any():
            self.last.update((pdf["print"][said].iloc[-1],))
        # an empty print says nothing and leaves the last one in place
        before = before.where(before.fillna("") != "").ffill()
        yield pd.DataFrame({"key": key[0], "seq": pdf["seq"], "print": pdf["print"], "unchanged": said & (pdf["print"] == before)})


def guarded(stream: DataFrame, key: str, seq: str, print_: str) -> DataFrame:
    """(key, seq, print, unchanged): whether a key's print is the last one that it had; empty prints are never unchanged and are not remembered.

    One value a key is held. Rows of a key are taken in order of ``seq`` within a batch, batches as they come.
    """
    d = stream.select(F.col(key).cast("bigint").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(print_).alias("print"))
    return d.groupBy("key").transformWithStateInPandas(_Guard(), "key bigint, seq bigint, print string, unchanged boolean", "Append", "None")


def guarded_rows(df: DataFrame, key: str, seq: str, print_: str) -> DataFrame:
    """``guarded`` of a table, by a window."""
    d = df.select(F.col(key).cast("bigint").alias("key"), F.col(seq).cast("bigint").alias("seq"), F.col(print_).alias("print"))
    before = F.last(F.nullif("print", F.lit("")), ignorenulls=True).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return d.select("key", "seq", "print", F.coalesce((F.col("print") != "") & (F.col("print") == before), F.lit(False)).alias("unchanged"))


class _Pause(StatefulProcessor):
    def __init__(self, seconds: int):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        # a refusal older than the pause means nothing, so its state may go
        self.refused = handle.getValueState("refused", "at bigint", ttlDurationMs=self.micros // 1000 * 60)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.refused.get()[0] if self.refused.exists() else None
        pdf = pd.concat(rows).sort_values(["at", "id"])
        paused = []
        for at, refused in zip(pdf["at"], pdf["refused"], strict=True):
            paused.append(last is not None and at - last < self.micros)
            if refused:
                last = int(at)
        if last is not None:
            self.refused.update((last,))
        yield pd.DataFrame({"provider": key[0], "id": pdf["id"], "paused": paused})


def paused(stream: DataFrame, provider: str, key: str, ts: str, refused, seconds: int = PAUSE_SECONDS) -> DataFrame:
    """(provider, id, paused): whether a call falls within ``seconds`` after a refused one of its provider. The state of a provider without refusals for an hour goes."""
    d = stream.select(F.col(provider).alias("provider"), F.col(key).cast("bigint").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(refused, F.lit(False)).alias("refused"))
    return d.groupBy("provider").transformWithStateInPandas(_Pause(seconds), "provider string, id bigint, paused boolean", "Append", "ProcessingTime")


def paused_rows(df: DataFrame, provider: str, key: str, ts: str, refused, seconds: int = PAUSE_SECONDS) -> DataFrame:
    """``paused`` of a table. Providers are few, so time is cut into spans of the pause's length, and a span looks at itself and the one before it only."""
    micros = seconds * 1_000_000
    d = df.select(F.col(provider).alias("provider"), F.col(key).cast("bigint").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(refused, F.lit(False)).alias("refused"))
    d = d.withColumn("span", F.floor(F.col("at") / micros).cast("bigint"))
    last = d.where("refused").groupBy("provider", (F.col("span") + 1).alias("span")).agg(F.max("at").alias("earlier"))
    own = F.max(F.when(F.col("refused"), F.col("at"))).over(Window.partitionBy("provider", "span").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("own", own).join(last, ["provider", "span"], "left")
    return d.select("provider", "id", F.coalesce(F.col("at") - F.greatest("own", "earlier") < micros, F.lit(False)).alias("paused"))


def take_in(batch: DataFrame, batch_id: int, root: str, cases: DataFrame, now: datetime) -> None:
    """foreachBatch body for mails (id, subject, sender, body): each is classified and matched to a case, or a case is made for it; mails, cases and audit rows are stored.

    Everything is written in the batch's own folder, which another attempt at the same batch replaces, so nothing is read back and nothing
    is stored twice. Mails to be ignored are stored and matched to none. A case made for a mail has minus the mail's id for its own.
    """
    subject = classes.mend_typos(F.col("subject"))
    m = batch.withColumns({"class": classes.mail_class(subject), "ignored": classes.ignorable_mail(F.col("subject"), F.col("sender"))})
    said = F.concat_ws(" ", "subject", "body")
    ids = extract.court_ids(said)
    none = F.lit(None).cast("string")
    asked = m.where("not ignored").select(F.col("id").alias("key"), ids["long_id"].alias("court_id"), ids["short"].alias("short"), extract.filing_number(said).alias("filing"), none.alias("person"), none.alias("claimant"))
    found = match_cases(asked, cases).select(F.col("key").alias("id"), "tier", "case_id")
    stored = m.join(found, "id", "left").withColumn("made", ~F.col("ignored") & F.col("case_id").isNull())
    stored = stored.withColumn("case_id", F.when(F.col("made"), -F.col("id")).otherwise(F.col("case_id")))
    folder = lambda name: f"{root}/{name}/batch={batch_id}"
    stored.write.mode("overwrite").parquet(folder("mails"))
    stored = batch.sparkSession.read.parquet(folder("mails"))
    stored.where("made").select(F.col("case_id").alias("id"), F.concat(F.lit("[PENDIENTE REVISION] "), F.coalesce("subject", F.lit(""))).alias("folder"), F.lit("PENDIENTE").alias("status")).write.mode("overwrite").parquet(folder("cases"))
    action = F.when(F.col("ignored"), "IGNORED").when(F.col("made"), "CASE_MADE").otherwise("MATCHED")
    stored.select(F.col("id").alias("mail_id"), "case_id", action.alias("action"), F.col("tier").alias("source"), F.lit(now).alias("at")).write.mode("overwrite").parquet(folder("audit"))
