"""Streams over files that come in one after the other: restarts, late rows, batches put twice, state that goes, sessions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rooftally.operators.decisions import agreement, fail_closed_reasons, review_action, unseen
from rooftally.streaming import jobs, sinks

SCHEMA = "event_id long, ts timestamp, cell long, pred long, present boolean, auto boolean"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def decisions(spark, folder, out, **limits):
    rows = jobs.source(spark, folder).withColumn("action", review_action(F.col("present")))
    reasons = fail_closed_reasons(F.col("action"), F.col("auto"), F.col("present"))
    return jobs.Decisions(rows, ["cell", "pred"], ["ts", "event_id"], reasons, out, **limits).drain()


def test_latest_decisions_over_files_a_late_row_and_a_restart(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, [(1, at(0), 1, 1, True, False), (2, at(5), 1, 1, None, False), (3, at(1), 1, 2, False, True), (4, at(6), 1, 2, True, True), (5, at(2), 2, 1, None, None)])
    job = decisions(spark, folder, out, delay="10 hours", ttl=24 * 3_600_000)
    latest = lambda j: {(r.cell, r.pred): (r.event_id, r.action) for r in j.latest.rows().collect()}
    assert latest(job) == {(1, 1): (2, "review"), (1, 2): (3, "drop"), (2, 1): (5, "review")}
    assert [(r.event_id, r.reasons) for r in job.rejected.rows().collect()] == [(4, "auto_drop_without_drop,auto_drop_of_pv")]

    # a file with an older row that isn't late, a newer one, a tie in time, and one far ahead
    add(spark, folder, [(6, at(3), 1, 1, True, False), (7, at(6), 1, 2, True, False), (8, at(2), 2, 1, True, False), (9, at(100), 3, 3, True, False)])
    job = decisions(spark, folder, out, delay="10 hours", ttl=24 * 3_600_000)
    want = {(1, 1): (2, "review"), (1, 2): (7, "keep"), (2, 1): (8, "keep"), (3, 3): (9, "keep")}
    assert latest(job) == want and job.late.rows().count() == 0
    changed = job.latest.changes.rows().groupBy("batch").count().collect()
    assert sorted(r["count"] for r in changed if r["count"]) == [3, 3]  # the second file changes three of four keys

    # the watermark is at 90 hours: one row is late, one isn't; the state of 1-1 is gone, and its new row is newer than all that was
    add(spark, folder, [(10, at(80), 2, 1, None, False), (11, at(95), 1, 1, True, False)])
    job = decisions(spark, folder, out, delay="10 hours", ttl=24 * 3_600_000)
    assert latest(job) == want | {(1, 1): (11, "keep")}
    assert job.late.rows().agg(F.sum("n")).first()[0] == 1

    before = sorted(job.latest.rows().collect())
    job.latest.compact()
    assert sorted(job.latest.rows().collect()) == before and job.latest.changes.rows().count() == 0
    add(spark, folder, [(12, at(101), 3, 3, None, False)])
    assert latest(decisions(spark, folder, out, delay="10 hours", ttl=24 * 3_600_000))[3, 3] == (12, "review")


def test_state_goes_after_its_time(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, rows in enumerate(([(1, at(0), 1, 1, True, False), (2, at(1), 1, 2, True, False)], [(3, at(200), 9, 9, True, False)], [(4, at(201), 9, 9, True, False)])):
        add(spark, folder, rows)
        decisions(spark, folder, out, delay="1 hour", ttl=2 * 3_600_000)
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{out}/progress")
    assert [tuple(r) for r in state.select("key.cell", "key.pred").collect()] == [(9, 9)]


def test_a_batch_put_twice_adds_nothing(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, [(1, at(0), 1, 1, True, False), (2, at(0), 1, 1, True, False), (3, at(0), 2, 2, None, False), (4, at(0), 3, 3, None, False), (5, at(0), 4, 4, None, False)])
    agreed = spark.createDataFrame([(1, 1, "admit"), (2, 2, "disagree"), (4, 4, "admit")], "cell long, pred long, outcome string")
    pool = spark.createDataFrame([(4, 4), (4, 4), (None, None)], "cell long, pred long")
    rows = jobs.source(spark, folder).select("cell", "pred", "ts")
    job = jobs.Ingest(rows, ["cell", "pred"], agreed, pool, out).drain()
    told = lambda: sorted((r.cell, r.pred, r.outcome) for r in job.log.rows().collect())
    first = [(1, 1, "admit"), (2, 2, "disagree"), (3, 3, "unreviewed"), (4, 4, "in_pool")]
    assert told() == first
    batch = spark.createDataFrame([(1, 1, at(0), "admit"), (5, 5, at(900), "admit"), (5, 5, at(901), "admit")], "cell long, pred long, ts timestamp, outcome string")
    for _ in range(2):  # one number, twice: a key of an earlier batch isn't added, the new one is once
        job.put(batch, 7)
        assert told() == [*first, (5, 5, "admit")]
    # long after its state is gone a repeat comes again
    add(spark, folder, [(6, at(500), 1, 1, True, False), (7, at(500), 6, 6, True, False)])
    job = jobs.Ingest(jobs.source(spark, folder).select("cell", "pred", "ts"), ["cell", "pred"], agreed, pool, out)
    job.drain()
    assert told() == [*first, (5, 5, "admit"), (6, 6, "unreviewed")]


def test_windows_are_written_when_they_change(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, [(k, at(k / 4), 1, k % 2, True, False) for k in range(12)])
    make = lambda: jobs.Throughput(jobs.source(spark, folder), ["pred"], [F.count("*").alias("n")], out, delay="2 hours").drain()
    job = make()
    add(spark, folder, [(20, at(2.5), 1, 0, True, False), (21, at(9), 1, 0, True, False)])
    job = make()
    got = {(r.start.hour, r.pred): r.n for r in job.status.rows().collect()}
    assert got == {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 1): 2, (2, 0): 3, (2, 1): 2, (9, 0): 1}
    assert sorted(r["count"] for r in job.status.changes.rows().groupBy("batch").count().collect()) == [2, 6]


def test_sessions_that_are_over(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add(spark, folder, [(1, at(0), 1, 1, True, False), (2, at(5.5), 1, 1, True, False), (3, at(11.6), 1, 1, True, False), (4, at(1), 2, 1, True, False)])
    make = lambda: jobs.Sessions(jobs.source(spark, folder), ["cell"], [F.count("*").alias("n")], out).drain()
    assert sorted((r.cell, r.start, r.end, r.n) for r in make().closed.rows().collect()) == [(2, at(1), at(7), 1)]
    add(spark, folder, [(5, at(40), 2, 1, True, False)])
    job = make()
    want = [(1, at(0), at(11.5), 2), (1, at(11.6), at(17.6), 1), (2, at(1), at(7), 1)]
    assert sorted((r.cell, r.start, r.end, r.n) for r in job.closed.rows().collect()) == want
    first = job.closed.rows().orderBy("batch").first().batch
    again = spark.createDataFrame(job.closed.rows().where(F.col("batch") == first).drop("batch").collect(), job.closed.schema)
    job.closed.put(again, first)
    assert job.closed.rows().count() == 3


@pytest.mark.parametrize("rows,want", [([], []), ([(None, True, 0), (None, False, 1)], [(None, "disagree")]), ([(1, False, 0), (1, None, 1)], [(1, "disagree")]), ([(1, False, 0)], [(1, "one_reviewer")]),
                                       ([(1, False, 0), (1, False, 1), (1, False, 1)], [(1, "admit")]), ([(2, True, 0), (2, None, 1)], [(2, "positive")])])
def test_agreement(spark, rows, want):
    df = spark.createDataFrame(rows, "k long, present boolean, who int")
    assert [tuple(r) for r in agreement(df, ["k"], F.col("who") == 1, F.col("present")).collect()] == want


def test_unseen_and_reasons(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k long")
    assert sorted((r.k for r in unseen(df, df.where("k = 1"), ["k"]).collect()), key=str) == [2, None]
    rows = spark.createDataFrame([("drop", None, False), ("keep", True, None), ("drop", True, False), ("keep", None, True)], "action string, auto boolean, present boolean")
    got = [r.r for r in rows.select(fail_closed_reasons(F.col("action"), F.col("auto"), F.col("present")).alias("r")).collect()]
    assert got == [["drop_without_auto"], ["auto_drop_without_drop", "auto_drop_of_pv"], [], []]


def test_a_log_without_batches_has_no_rows(spark, tmp_path):
    log = sinks.Log(spark, str(tmp_path / "log"), sinks.LATE)
    assert log.rows().columns == ["n", "batch"] and log.rows().count() == 0
