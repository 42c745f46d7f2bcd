"""Streams with keyed state give the batch result, also after a restart in mid-stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.streaming import flows, state

NOW = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def store(spark):
    for k, v in state.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in state.STATE_STORE:
        spark.conf.unset(k)


def parts(spark, rows, schema, n):
    """The rows as n files, oldest first."""
    path = files.work_path(spark, "in")
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run(query, path, checkpoint, body=None, stop=None):
    """All that is there, batch by batch; with ``stop``, the batch of that number fails once, after it has written."""
    failed = []

    def write(df, batch_id):
        (body or (lambda d, b: d.write.mode("overwrite").parquet(f"{path}/batch={b}")))(df, batch_id)
        if batch_id == stop and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost")

    start = lambda: query.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if stop is not None:
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination(300)
    start().awaitTermination(300)


def test_guard_by_fingerprint(spark, store):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, rng.choice(["a", "b", "", None])) for i in range(80)]
    schema = "case_id bigint, seq bigint, print string"
    src, out = parts(spark, rows, schema, 4), files.work_path(spark, "out")
    run(state.guarded(flows.file_stream(spark, src, spark.createDataFrame(rows, schema).schema, 1), "case_id", "seq", "print"), out, files.work_path(spark, "check"), stop=1)
    got = {(r["key"], r["seq"]): r["unchanged"] for r in spark.read.parquet(out).collect()}
    last, want = {}, {}
    for case, seq, print_ in rows:
        want[case, seq] = bool(print_) and last.get(case) == print_
        last[case] = print_ or last.get(case)
    assert got == want
    assert {(r["key"], r["seq"]): r["unchanged"] for r in state.guarded_rows(spark.createDataFrame(rows, schema), "case_id", "seq", "print").collect()} == want


def test_pause_after_a_refusal(spark, store):
    rng, at, rows = random.Random(5), NOW, []
    for i in range(80):
        at += timedelta(seconds=rng.choice([0, 5, 20, 59, 60, 61]))
        rows.append((rng.choice("pq"), i, at, rng.choice([True, False, None, False])))
    schema = "provider string, id bigint, ts timestamp, limited boolean"
    src, out = parts(spark, rows, schema, 4), files.work_path(spark, "out")
    stream = flows.file_stream(spark, src, spark.createDataFrame(rows, schema).schema, 1)
    run(state.paused(stream, "provider", "id", "ts", F.col("limited")), out, files.work_path(spark, "check"), stop=2)
    got = {r["id"]: r["paused"] for r in spark.read.parquet(out).collect()}
    last, want = {}, {}
    for p, i, ts, limited in rows:
        want[i] = p in last and ts - last[p] < timedelta(seconds=60)
        if limited:
            last[p] = ts
    assert got == want
    assert {r["id"]: r["paused"] for r in state.paused_rows(spark.createDataFrame(rows, schema), "provider", "id", "ts", F.col("limited")).collect()} == want


def test_mails_are_taken_in_once(spark):
    cases = spark.createDataFrame([(7, "2026-00057 PARTE ALFA", "68001400902720260005700", "20260012345", "PARTE ALFA BETA", None, "COMPLETO", None)], "id bigint, folder string, court_id string, filing string, claimant string, notes string, status string, subject string")
    mails = [
        (1, "Fallo 68001400902720260005700", "a@x", "texto", NOW), (2, "Tutela nueva", "a@x", "sin número", NOW), (3, "Alerta de seguridad", "noreply@google.com", "", NOW), (4, None, None, None, NOW), (5, "RV", "b@x", "FOREST 20260012345", NOW),
        (1, "Fallo 68001400902720260005700", "a@x", "texto", NOW),
    ]
    schema = "id bigint, subject string, sender string, body string, received timestamp"
    src, out = parts(spark, mails, schema, 2), files.work_path(spark, "out")
    stream = flows.once_per_key(flows.file_stream(spark, src, spark.createDataFrame(mails, schema).schema, 1), "received", ["id"])
    run(stream, out, files.work_path(spark, "check"), lambda d, b: state.take_in(d, b, out, cases, NOW), stop=0)
    stored = {r["id"]: (r["case_id"], r["ignored"]) for r in spark.read.parquet(f"{out}/mails").collect()}
    assert stored == {1: (7, False), 2: (-2, False), 3: (None, True), 4: (-4, False), 5: (7, False)}
    assert {r["id"] for r in spark.read.parquet(f"{out}/cases").collect()} == {-2, -4}
    audit = [(r["mail_id"], r["action"]) for r in spark.read.parquet(f"{out}/audit").collect()]
    assert sorted(audit) == [(1, "MATCHED"), (2, "CASE_MADE"), (3, "IGNORED"), (4, "CASE_MADE"), (5, "MATCHED")]
