"""Queries that run a stream over the event log until it is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators.decisions import agreement, fail_closed_reasons, review_action
from rooftally.plans.registry import query
from rooftally.sources.views import TEXTS, view, with_views
from rooftally.streaming import jobs


def _events(spark, d):
    return jobs.source(spark, f"{d}/events.parquet")


@query(f"""{with_views('decisions')}, r AS (SELECT *, confidence >= 0.5 AS auto_drop, CASE WHEN pv_present IS NULL THEN 'review' WHEN pv_present THEN 'keep' ELSE 'drop' END AS action FROM decisions),
g AS (SELECT * FROM r WHERE NOT (auto_drop AND action <> 'drop') AND NOT (auto_drop AND pv_present IS DISTINCT FROM false) AND NOT (action = 'drop' AND NOT auto_drop))
SELECT grid_id, pred_id, event_id, action, confidence FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, pred_id ORDER BY ts DESC, event_id DESC) AS k FROM g) WHERE k = 1""")
def o1_stream_decisions(spark, d):
    rows = spark.sql(TEXTS["decisions"], events=_events(spark, d))
    rows = rows.withColumns({"auto_drop": F.col("confidence") >= 0.5, "action": review_action(F.col("pv_present"))})
    reasons = fail_closed_reasons(F.col("action"), F.col("auto_drop"), F.col("pv_present"))
    job = jobs.Decisions(rows, ["grid_id", "pred_id"], ["ts", "event_id"], reasons, jobs.new_folder(spark))
    return job.drain().latest.rows().select("grid_id", "pred_id", "event_id", "action", "confidence")


#: A chip is what a user did in a day; two reviewers share its events. The pool holds the chips of two regions.
_CHIP = "CAST(user_id * 31 + extract(DAY FROM ts) AS {text})"


@query(f"""{with_views('negative_pool')}, c AS (SELECT {_CHIP.format(text='VARCHAR')} AS chip_id, event_id, event_type IN ('signup', 'error') AS says_no, event_type = 'view' AS no_verdict FROM events),
a AS (SELECT chip_id, bool_and(says_no AND NOT no_verdict) FILTER (WHERE event_id % 2 = 0) AS f, bool_and(says_no AND NOT no_verdict) FILTER (WHERE event_id % 2 = 1) AS s FROM c GROUP BY chip_id)
SELECT chip_id, CASE WHEN chip_id IN (SELECT chip_id FROM negative_pool WHERE region IN ('EUROPE', 'AFRICA')) THEN 'in_pool' WHEN f IS NULL OR s IS NULL THEN 'one_reviewer' WHEN f AND s THEN 'admit' WHEN f OR s THEN 'disagree' ELSE 'positive' END AS outcome FROM a""")
def o2_stream_pool_ingest(spark, d):
    chip = F.expr(_CHIP.format(text="STRING")).alias("chip_id")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    present = F.when(F.col("event_type") != "view", ~F.col("event_type").isin("signup", "error"))
    agreed = agreement(events.select(chip, "event_id", present.alias("present")), ["chip_id"], F.col("event_id") % 2 == 1, F.col("present"))
    pool = view(spark, d, "negative_pool").where("region in ('EUROPE', 'AFRICA')")
    job = jobs.Ingest(_events(spark, d).select(chip, "ts"), ["chip_id"], agreed, pool, jobs.new_folder(spark))
    return job.drain().log.rows().select("chip_id", "outcome")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value > 10) AS BIGINT) AS n_high FROM events GROUP BY ALL")
def o3_stream_cell_status(spark, d):
    counts = [F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("n_high")]
    job = jobs.Throughput(_events(spark, d), ["event_type"], counts, jobs.new_folder(spark))
    return job.drain().status.rows().withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS end_us, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k
HAVING date_trunc('millisecond', max(ts)) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def o3_stream_sessions(spark, d):
    """A user's sessions that are over: the watermark, in whole milliseconds, has passed their end."""
    job = jobs.Sessions(_events(spark, d), ["user_id"], [F.count("*").alias("n")], jobs.new_folder(spark))
    return job.drain().closed.rows().select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
