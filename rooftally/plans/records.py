"""Queries on single rows, reviews, samples, dates, grids and contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rooftally.operators import columns, decisions, joins, matching, ranks, sampling, stats
from rooftally.plans.registry import query
from rooftally.sources.views import RUNS, for_each_run, table, view, with_views

_P = with_views("predictions")
_SIZE = "CASE WHEN area < 4000 THEN 'small' WHEN area < 10000 THEN 'medium' ELSE 'large' END"
_CONF = "CASE WHEN confidence <= 0.7 THEN 'c_lo' ELSE 'c_hi' END"
_TIERS = [(10000.0, 0.6), (4000.0, 0.7), (0.0, 0.8)]


def _size(c="area"):
    return columns.bucket(F.col(c), [4000, 10000], ["small", "medium", "large"])


def _conf():
    return columns.bucket(F.col("confidence"), [0.7], ["c_lo", "c_hi"], closed="right")


@query(f"""{_P} SELECT poly_id, area, round(CAST(greatest(x1 - x0, y1 - y0) AS DOUBLE) / least(x1 - x0, y1 - y0), 6) AS elongation, 2 * (x1 - x0 + y1 - y0) AS perimeter,
round(2 * (x1 - x0 + y1 - y0) / (2 * sqrt(pi() * area)), 6) AS complexity FROM predictions""")
def b1_box_shape(spark, d):
    return columns.box_shape(view(spark, d, "predictions")).select("poly_id", "area", F.round("elongation", 6).alias("elongation"), "perimeter", F.round("complexity", 6).alias("complexity"))


@query(f"""{with_views('task_grid')}, p AS (SELECT grid_id, gx * 9.0E0 - 179 AS lon, gy * 3.0E0 - 60 AS lat FROM task_grid)
SELECT grid_id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INTEGER) AS epsg,
round(lon * (pi() / 180 * 6378137.0), 3) AS mx, round(ln(tan(pi() / 4 + lat * (pi() / 360))) * 6378137.0, 3) AS my FROM p""")
def b2_b3_projection(spark, d):
    p = view(spark, d, "task_grid").select("grid_id", (F.col("gx") * 9.0 - 179).alias("lon"), (F.col("gy") * 3.0 - 60).alias("lat"))
    x, y = columns.web_mercator(F.col("lon"), F.col("lat"))
    return p.select("grid_id", columns.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), F.round(x, 3).alias("mx"), F.round(y, 3).alias("my"))


@query(f"{_P} SELECT region, {_SIZE} AS size_class, {_CONF} AS conf_bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(area) AS BIGINT) AS area FROM predictions GROUP BY ALL")
def b7_buckets(spark, d):
    return view(spark, d, "predictions").groupBy("region", _size().alias("size_class"), _conf().alias("conf_bucket")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query(f"""{_P} SELECT poly_id, CASE WHEN mean_r < 40 AND mean_g < 40 AND mean_b < 40 THEN 'shadow' WHEN (mean_r + mean_g + mean_b) / 3.0E0 < 70 THEN 'dark' WHEN mean_b > mean_r + 40 THEN 'blue'
WHEN area < 2000 THEN 'small' WHEN greatest(x1 - x0, y1 - y0) > 5 * least(x1 - x0, y1 - y0) THEN 'elongated' ELSE 'other' END AS error_type FROM predictions WHERE review_status = 'delete'""")
def b9_triage_error_type(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    rules = [
        ((F.col("mean_r") < 40) & (F.col("mean_g") < 40) & (F.col("mean_b") < 40), "shadow"), ((F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3 < 70, "dark"),
        (F.col("mean_b") > F.col("mean_r") + 40, "blue"), (F.col("area") < 2000, "small"), (F.greatest(w, h) > 5 * F.least(w, h), "elongated"),
    ]
    return view(spark, d, "predictions").where("review_status = 'delete'").select("poly_id", columns.first_match(rules, "other").alias("error_type"))


_KEEP = "CASE WHEN area >= 10000 THEN confidence >= 0.6 WHEN area >= 4000 THEN confidence >= 0.7 WHEN area >= 0 THEN confidence >= 0.8 ELSE false END"
_ANY = "(area >= 10000 AND confidence >= 0.6) OR (area >= 4000 AND confidence >= 0.7) OR (area >= 0 AND confidence >= 0.8)"


@query(f"{_P} SELECT region, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {_KEEP}) AS BIGINT) AS first_tier, CAST(count(*) FILTER (WHERE {_ANY}) AS BIGINT) AS any_tier FROM predictions GROUP BY region")
def c2_c3_tiers(spark, d):
    a, c = F.col("area"), F.col("confidence")
    return view(spark, d, "predictions").groupBy("region").agg(F.count("*").alias("n"), F.count_if(columns.tiered_keep(a, c, _TIERS)).alias("first_tier"), F.count_if(columns.tiered_keep_any(a, c, _TIERS)).alias("any_tier"))


_C4 = ["area >= 1500", "CAST(greatest(x1 - x0, y1 - y0) AS DOUBLE) / least(x1 - x0, y1 - y0) <= CASE WHEN area >= 10000 THEN 4 ELSE 3 END", "NOT (mean_r < 30 AND mean_g < 30 AND mean_b < 30)", _KEEP]


@query(f"{_P} SELECT region, model_run, CAST(count(*) AS BIGINT) AS n_in, " + ", ".join(f"CAST(count(*) FILTER (WHERE {' AND '.join(f'({r})' for r in _C4[: k + 1])}) AS BIGINT) AS n_{n}" for k, n in enumerate(("area", "shape", "colour", "confidence"))) + " FROM predictions GROUP BY region, model_run")
def c4_postproc_funnel(spark, d):
    p = columns.box_shape(view(spark, d, "predictions"))
    return columns.funnel(p, ["region", "model_run"], [
        ("area", F.col("area") >= 1500), ("shape", F.col("elongation") <= F.when(F.col("area") >= 10000, 4).otherwise(3)),
        ("colour", ~((F.col("mean_r") < 30) & (F.col("mean_g") < 30) & (F.col("mean_b") < 30))), ("confidence", columns.tiered_keep(F.col("area"), F.col("confidence"), _TIERS))])


@query(f"""{_P} SELECT region, CAST(count(*) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE confidence >= 0.7) AS BIGINT) AS n_detector, CAST(count(*) FILTER (WHERE confidence >= 0.7 AND second_score >= 0.6) AS BIGINT) AS n_second,
CAST(count(*) FILTER (WHERE confidence >= 0.7 AND second_score >= 0.6 AND area BETWEEN 2000 AND 25000) AS BIGINT) AS n_area FROM predictions GROUP BY region""")
def c5_inventory_policy(spark, d):
    rules = [("detector", F.col("confidence") >= 0.7), ("second", F.col("second_score") >= 0.6), ("area", F.col("area").between(2000, 25000))]
    return columns.funnel(view(spark, d, "predictions"), ["region"], rules)


@query(f"{with_views('negative_pool')} SELECT chip_id, lower(trim(coalesce(training_eligible, ''))) <> 'false' AS eligible FROM negative_pool")
def c8_training_eligible(spark, d):
    return view(spark, d, "negative_pool").select("chip_id", columns.eligible(F.col("training_eligible")).alias("eligible"))


@query(f"""{with_views('negative_pool')} SELECT region, CAST(count(*) AS BIGINT) AS n_in, CAST(count(*) FILTER (WHERE training_eligible <> 'false') AS BIGINT) AS n_eligible,
CAST(count(*) FILTER (WHERE training_eligible <> 'false' AND archetype_confidence IN ('A1', 'A2')) AS BIGINT) AS n_floor, CAST(count(*) FILTER (WHERE training_eligible <> 'false' AND archetype_confidence IN ('A1', 'A2') AND bbox_geo <> '') AS BIGINT) AS n_geometry FROM negative_pool GROUP BY region""")
def c9_negative_pool_select(spark, d):
    rank = F.substring("archetype_confidence", 2, 1).cast("int")
    rules = [("eligible", columns.eligible(F.col("training_eligible"))), ("floor", rank <= 2), ("geometry", F.trim("bbox_geo") != "")]
    return columns.funnel(view(spark, d, "negative_pool"), ["region"], rules)


@query(f"""{with_views('task_grid', 'negative_pool')} SELECT grid_id, region, grid_id IN (SELECT grid_id FROM negative_pool WHERE training_eligible <> 'false' AND archetype_confidence = 'A1' AND region = 'ASIA') AS leaks FROM task_grid""")
def d16_leakage_split(spark, d):
    pool = view(spark, d, "negative_pool").where(columns.eligible(F.col("training_eligible")) & (F.col("archetype_confidence") == "A1") & (F.col("region") == "ASIA"))
    return joins.leaks(view(spark, d, "task_grid").select("grid_id", "region"), pool, ["grid_id"])


@query(f"""{with_views('predictions', 'task_grid')}, a AS (SELECT grid_id, model_run, count(*) AS n, sum(area) AS area FROM predictions WHERE confidence >= 0.95 GROUP BY ALL)
SELECT grid_id, model_run, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(area, 0) AS BIGINT) AS area, CASE WHEN n IS NULL THEN 'not_reached' ELSE 'ok' END AS status FROM (SELECT grid_id, unnest({RUNS}) AS model_run FROM task_grid) LEFT JOIN a USING (grid_id, model_run)""")
def d18_grid_left_join_fill(spark, d):
    a = view(spark, d, "predictions").where("confidence >= 0.95").groupBy("grid_id", "model_run").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    return joins.left_join_fill(for_each_run(view(spark, d, "task_grid").select("grid_id")), a, ["grid_id", "model_run"], ["n", "area"])


_W = "1.96 * 1.96"
_HT = f"""{_P}, s AS (SELECT *, {_SIZE} AS size_class, {_CONF} AS conf_bucket FROM predictions),
r AS (SELECT *, row_number() OVER (PARTITION BY model_run, grid_id, size_class, conf_bucket ORDER BY sha256(concat('42:', poly_id)), poly_id) AS k, count(*) OVER (PARTITION BY model_run, grid_id, size_class, conf_bucket) AS pop FROM s),
t AS (SELECT *, least(pop, 5) AS taken, CAST(pop AS DOUBLE) / least(pop, 5) AS weight FROM r WHERE k <= 5)"""


def _sampled(spark, d):
    p = view(spark, d, "predictions").withColumns({"size_class": _size(), "conf_bucket": _conf()})
    return sampling.stratified(p, ["model_run", "grid_id", "size_class", "conf_bucket"], "poly_id", 5)


@query(f"{_HT} SELECT model_run, poly_id, grid_id, size_class, conf_bucket, CAST(pop AS BIGINT) AS stratum_pop, CAST(taken AS BIGINT) AS stratum_sampled, round(weight, 6) AS sample_weight FROM t")
def j1_stratified_sample(spark, d):
    return _sampled(spark, d).select("model_run", "poly_id", "grid_id", "size_class", "conf_bucket", "stratum_pop", F.col("stratum_sampled").cast("long").alias("stratum_sampled"), F.round("sample_weight", 6).alias("sample_weight"))


@query(f"""{_HT}, g AS (SELECT model_run, size_class, conf_bucket, grid_id, count(*) AS n, sum(CASE WHEN review_status = 'delete' THEN 0 ELSE weight END) / sum(weight) AS p FROM t GROUP BY GROUPING SETS ((model_run, size_class, conf_bucket), (model_run, grid_id), (model_run)))
SELECT model_run, size_class, conf_bucket, grid_id, CAST(n AS BIGINT) AS n, round(p, 6) AS precision, round(greatest((p + {_W} / (2 * n)) / (1 + {_W} / n) - 1.96 * sqrt(greatest(p * (1 - p) / n + {_W} / (4 * n * n), 0)) / (1 + {_W} / n), 0), 6) AS ci_low,
round(least((p + {_W} / (2 * n)) / (1 + {_W} / n) + 1.96 * sqrt(greatest(p * (1 - p) / n + {_W} / (4 * n * n), 0)) / (1 + {_W} / n), 1), 6) AS ci_high FROM g""")
def h12_ht_precision(spark, d):
    rows = spark.sql("""SELECT model_run, size_class, conf_bucket, grid_id, count(*) AS n, sum(CASE WHEN review_status = 'delete' THEN 0 ELSE sample_weight END) / sum(sample_weight) AS p
        FROM {sample} GROUP BY GROUPING SETS ((model_run, size_class, conf_bucket), (model_run, grid_id), (model_run))""", sample=_sampled(spark, d))
    low, high = stats.wilson(F.col("p"), F.col("n"))
    return rows.select("model_run", "size_class", "conf_bucket", "grid_id", "n", F.round("p", 6).alias("precision"), F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"))


@query(f"{_P} SELECT grid_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(area) AS BIGINT) AS total, round(avg(area), 4) AS mean, round(median(area), 4) AS median, round(quantile_cont(area, 0.1), 4) AS p10, round(quantile_cont(area, 0.9), 4) AS p90, max(area) AS largest, CAST(count(*) FILTER (WHERE area >= 10000) AS BIGINT) AS n_large, round(100 * sum(area) / 9000000.0E0, 6) AS coverage_pct FROM predictions GROUP BY grid_id")
def h18_plausibility(spark, d):
    a = F.col("area")
    return view(spark, d, "predictions").groupBy("grid_id").agg(
        F.count("*").alias("n"), F.sum(a).alias("total"), F.round(F.avg(a), 4).alias("mean"), F.round(F.median(a), 4).alias("median"), F.round(F.percentile(a, 0.1), 4).alias("p10"), F.round(F.percentile(a, 0.9), 4).alias("p90"),
        F.max(a).alias("largest"), F.count_if(a >= 10000).alias("n_large"), F.round(100 * F.sum(a) / 9000000, 6).alias("coverage_pct"))


@query("""WITH e AS (SELECT user_id, day(ts) AS day, event_type, event_id, event_id % 3 AS who FROM events),
a AS (SELECT user_id, day, arg_max(event_type, event_id) AS a_label FROM e WHERE who < 2 GROUP BY ALL), b AS (SELECT user_id, day, arg_max(event_type, event_id) AS b_label FROM e WHERE who > 0 GROUP BY ALL),
m AS (SELECT CASE WHEN b_label IS NULL THEN 'only_a' WHEN a_label IS NULL THEN 'only_b' ELSE 'shared' END AS bucket, a_label, b_label FROM a FULL JOIN b USING (user_id, day))
SELECT bucket, 'agreement' AS side, a_label, b_label, CAST(count(*) AS BIGINT) AS n FROM m WHERE bucket = 'shared' GROUP BY ALL UNION ALL SELECT bucket, 'a', a_label, NULL, CAST(count(*) AS BIGINT) FROM m WHERE bucket <> 'only_b' GROUP BY ALL
UNION ALL SELECT bucket, 'b', NULL, b_label, CAST(count(*) AS BIGINT) FROM m WHERE bucket <> 'only_a' GROUP BY ALL UNION ALL SELECT bucket, 'all', NULL, NULL, CAST(count(*) AS BIGINT) FROM m GROUP BY ALL""")
def h22_rater_overlap(spark, d):
    """Two raters of a user's days: what both saw and each alone, their labels there, and where they agree."""
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_type", "event_id", (F.col("event_id") % 3).alias("who"))
    last = lambda rule: e.where(rule).groupBy("user_id", "day").agg(F.max_by("event_type", "event_id").alias("label"))
    return decisions.label_tables(decisions.rater_overlap(last("who < 2"), last("who > 0"), ["user_id", "day"]))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tt, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tf, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS ft, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS ff, CAST(count(*) AS DOUBLE) AS n FROM labels),
e AS (SELECT *, (tt + ff) / n AS po, ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / (n * n) AS pe FROM c)
SELECT round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa, round(CAST(tt AS DOUBLE) / (tt + tf), 6) AS recall_true, round(CAST(ff AS DOUBLE) / (ft + ff), 6) AS recall_false FROM e""")
def h21_kappa(spark, d):
    return stats.kappa(table(spark, d, "labels"), [], F.col("quality") == 1, F.col("toxic") == 0).select("accuracy", "kappa", "recall_true", "recall_false")


@query(f"""{_P}, t AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), n AS (SELECT count(*) FILTER (WHERE review_status <> 'delete') AS pos FROM predictions)
SELECT threshold, CAST(count(*) FILTER (WHERE review_status <> 'delete') AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE review_status = 'delete') AS BIGINT) AS fp, CAST(any_value(pos) - count(*) FILTER (WHERE review_status <> 'delete') AS BIGINT) AS fn,
round(count(*) FILTER (WHERE review_status <> 'delete') / CAST(count(*) AS DOUBLE), 6) AS precision, round(count(*) FILTER (WHERE review_status <> 'delete') / CAST(any_value(pos) AS DOUBLE), 6) AS recall,
round(2 * count(*) FILTER (WHERE review_status <> 'delete') / CAST(count(*) + any_value(pos) AS DOUBLE), 6) AS f1 FROM predictions, t, n WHERE confidence >= threshold GROUP BY threshold""")
def h23_conf_sweep(spark, d):
    p = view(spark, d, "predictions").select("confidence", (F.col("review_status") != "delete").alias("pos"))
    every = p.withColumn("threshold", F.explode(F.array(*map(F.lit, [0.5, 0.6, 0.7, 0.8, 0.9]))))
    kept = F.col("confidence") >= F.col("threshold")
    return matching.prf(every.groupBy("threshold").agg(F.count_if(kept & F.col("pos")).alias("tp"), F.count_if(kept & ~F.col("pos")).alias("fp"), F.count_if(~kept & F.col("pos")).alias("fn")))


@query(f"{with_views('units')} SELECT grid_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(centiwatts) AS BIGINT) AS total, CAST(coalesce(sum(centiwatts) FILTER (WHERE customer_type = 'residential'), 0) AS BIGINT) AS residential, CAST(coalesce(sum(centiwatts) FILTER (WHERE customer_type = 'industrial'), 0) AS BIGINT) AS industrial FROM units WHERE kw >= 0 GROUP BY grid_id")
def h38_unit_kw_rollup(spark, d):
    part = lambda t: F.coalesce(F.sum(F.when(F.col("customer_type") == t, F.col("centiwatts"))), F.lit(0)).alias(t)
    return view(spark, d, "units").where("kw >= 0").groupBy("grid_id").agg(F.count("*").alias("n"), F.sum("centiwatts").alias("total"), part("residential"), part("industrial"))


@query(f"{_P} SELECT region, grid_id, CAST(count(*) FILTER (WHERE review_status = 'correct') AS BIGINT) AS n_correct, CAST(count(*) FILTER (WHERE review_status = 'edit') AS BIGINT) AS n_edit, CAST(count(*) FILTER (WHERE review_status = 'delete') AS BIGINT) AS n_delete FROM predictions GROUP BY region, grid_id")
def h51_review_parts(spark, d):
    n = lambda s: F.count_if(F.col("review_status") == s).alias(f"n_{s}")
    return view(spark, d, "predictions").groupBy("region", "grid_id").agg(n("correct"), n("edit"), n("delete"))


@query(f"{with_views('task_grid')} SELECT grid_id, CAST(row_number() OVER (PARTITION BY region ORDER BY gy DESC, gx) AS INTEGER) AS seq FROM task_grid")
def i1_sequential_ids(spark, d):
    return view(spark, d, "task_grid").select("grid_id", F.row_number().over(Window.partitionBy("region").orderBy(F.desc("gy"), "gx")).alias("seq"))


@query(f"{with_views('decisions')} SELECT grid_id, pred_id, max(event_id) AS event_id, arg_max(coalesce(CAST(pv_present AS VARCHAR), 'abstain'), event_id) AS pv_present, round(arg_max(confidence, event_id), 6) AS confidence FROM decisions GROUP BY grid_id, pred_id")
def i2_latest_wins(spark, d):
    last = F.max_by(F.struct("pv_present", "confidence"), "event_id").alias("m")
    rows = view(spark, d, "decisions").groupBy("grid_id", "pred_id").agg(F.max("event_id").alias("event_id"), last)
    return rows.select("grid_id", "pred_id", "event_id", F.coalesce(F.col("m.pv_present").cast("string"), F.lit("abstain")).alias("pv_present"), F.round("m.confidence", 6).alias("confidence"))


@query(f"{_P} SELECT grid_id, poly_id, area FROM predictions QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY area DESC, poly_id) <= 3")
def i3_topk(spark, d):
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("area"), "poly_id"))
    return view(spark, d, "predictions").withColumn("k", rank).where("k <= 3").select("grid_id", "poly_id", "area")


@query(f"{_P} SELECT poly_id, sha256(concat('42:', poly_id)) AS digest FROM predictions ORDER BY digest, poly_id LIMIT 100")
def j2_hash_sample(spark, d):
    return sampling.hash_sample(view(spark, d, "predictions"), "poly_id", 100).select("poly_id", "digest")


@query(f"""{_P}, c AS (SELECT region, count(*) AS n FROM predictions GROUP BY region), t AS (SELECT *, least(997, sum(n) OVER ()) AS cap, sum(n) OVER () AS total FROM c), f AS (SELECT *, (cap * n) // total AS base, (cap * n) % total AS rest FROM t)
SELECT region, CAST(n AS BIGINT) AS n, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, n DESC, region) <= cap - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f""")
def j3_largest_remainder(spark, d):
    return sampling.largest_remainder(view(spark, d, "predictions").groupBy("region").agg(F.count("*").alias("n")), "region", "n", 997)


@query(f"{_P} SELECT grid_id, poly_id FROM predictions WHERE review_status = 'delete' QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY sha256(concat('42:', poly_id)), poly_id) <= greatest(1, floor(count(*) OVER (PARTITION BY grid_id) * 0.1))")
def j5_per_group_fraction(spark, d):
    return sampling.fraction_per_group(view(spark, d, "predictions").where("review_status = 'delete'"), ["grid_id"], "poly_id", 0.1).select("grid_id", "poly_id")


@query(f"""{_P}, c AS (SELECT region, grid_id, count(*) FILTER (WHERE review_status = 'correct' AND area > 8000) AS n FROM predictions GROUP BY region, grid_id)
SELECT region, grid_id, CAST(n AS BIGINT) AS n, CASE WHEN coalesce(sum(n) OVER (PARTITION BY region ORDER BY n DESC, sha256(concat('42:', grid_id)), grid_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < floor(sum(n) OVER (PARTITION BY region) * 0.2) THEN 'val' ELSE 'train' END AS split FROM c WHERE n > 0
UNION ALL SELECT region, grid_id, CAST(n AS BIGINT), CASE WHEN row_number() OVER (PARTITION BY region ORDER BY sha256(concat('42:', grid_id)), grid_id) <= greatest(1, floor(count(*) OVER (PARTITION BY region) * 0.2)) THEN 'val' ELSE 'train' END FROM c WHERE n = 0""")
def j11_greedy_val_split(spark, d):
    c = view(spark, d, "predictions").groupBy("region", "grid_id").agg(F.count_if((F.col("review_status") == "correct") & (F.col("area") > 8000)).alias("n"))
    return sampling.greedy_split(c, ["region"], "grid_id", "n", 0.2)


@query(f"""{with_views('intervals')}, m AS (SELECT date_trunc('month', start_date) AS a, date_diff('month', start_date, end_date) + 1 AS k FROM intervals), e AS (SELECT CAST(a + to_months(CAST(i AS INTEGER)) AS DATE) AS month, k FROM m, LATERAL (SELECT unnest(generate_series(0, k - 1)) AS i))
SELECT month, CAST(count(*) AS BIGINT) AS n, round(sum(1.0E0 / k), 6) AS mass FROM e GROUP BY month""")
def l1_interval_spread_monthly(spark, d):
    months = F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("interval 1 month"))
    rows = view(spark, d, "intervals").withColumn("months", months).select(F.explode("months").alias("month"), (1 / F.size("months")).alias("w"))
    return rows.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("mass"))


@query(f"{with_views('intervals')} SELECT CASE WHEN d <= 30 THEN 'month' WHEN d <= 90 THEN 'quarter' WHEN d <= 365 THEN 'year' ELSE 'longer' END AS width, CAST(count(*) AS BIGINT) AS n, round(median(d), 4) AS median_days FROM (SELECT date_diff('day', start_date, end_date) AS d FROM intervals) GROUP BY ALL")
def l3_window_width_buckets(spark, d):
    days = F.datediff("end_date", "start_date")
    rows = view(spark, d, "intervals").select(days.alias("d")).withColumn("width", columns.bucket(F.col("d"), [30, 90, 365], ["month", "quarter", "year", "longer"], closed="right"))
    return rows.groupBy("width").agg(F.count("*").alias("n"), F.round(F.median("d"), 4).alias("median_days"))


@query(f"{with_views('intervals')} SELECT coalesce(date_status, undated_reason, 'undated') AS outcome, CAST(count(*) AS BIGINT) AS n FROM intervals GROUP BY ALL")
def l4_outcome_status(spark, d):
    return view(spark, d, "intervals").groupBy(F.coalesce("date_status", "undated_reason", F.lit("undated")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""{with_views('intervals')}, h AS (SELECT year(end_date) AS y, CASE WHEN month(end_date) <= 6 THEN 1 ELSE 2 END AS half, count(*) AS n FROM intervals GROUP BY ALL)
SELECT CAST(y AS INTEGER) AS y, CAST(half AS INTEGER) AS half, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER (ORDER BY y, half) AS BIGINT) AS adopted FROM h QUALIFY y >= 1994""")
def i5_cumulative_adoption(spark, d):
    half = F.when(F.month("end_date") <= 6, 1).otherwise(2)
    h = view(spark, d, "intervals").groupBy(F.year("end_date").alias("y"), half.alias("half")).agg(F.count("*").alias("n"))
    return h.withColumn("adopted", F.sum("n").over(Window.orderBy("y", "half").rowsBetween(Window.unboundedPreceding, 0))).where("y >= 1994")  # one row a half-year


#: One usable first-stage verdict a candidate, and the second stage for skylights.
_STAGES = f"""{with_views('decisions')}, f AS (SELECT grid_id, pred_id, arg_max(event_id, event_id) AS id FROM decisions GROUP BY grid_id, pred_id), s1 AS (SELECT d.* FROM decisions d JOIN f ON event_id = id),
s2 AS (SELECT grid_id, pred_id, arg_max(coalesce(CAST(pv_present AS VARCHAR), 'null'), event_id) AS pv2 FROM decisions WHERE lookalike IS NULL AND confidence > 0.05 GROUP BY grid_id, pred_id),
m AS (SELECT s1.grid_id, s1.pred_id, CASE WHEN s1.pv_present IS NULL THEN 'stage1_abstain' WHEN s1.pv_present THEN 'stage1_pv' WHEN coalesce(s1.lookalike, '') <> 'skylight' THEN 'stage1_drop' WHEN pv2 = 'true' THEN 'stage2_keep' WHEN pv2 = 'false' THEN 'stage2_drop' ELSE 'stage2_missing' END AS source FROM s1 LEFT JOIN s2 USING (grid_id, pred_id)),
a AS (SELECT *, CASE WHEN source IN ('stage1_pv', 'stage2_keep') THEN 'keep' WHEN source LIKE '%drop' THEN 'drop' ELSE 'review' END AS action FROM m)"""


def merged_decisions(spark, d):
    """First and second review stage to one action; what abstains is reviewed, never dropped."""
    rows = view(spark, d, "decisions")
    first = rows.groupBy("grid_id", "pred_id").agg(F.max_by(F.struct("pv_present", "lookalike"), "event_id").alias("s1"))
    second = rows.where("lookalike is null and confidence > 0.05").groupBy("grid_id", "pred_id").agg(F.max_by(F.struct("pv_present"), "event_id").alias("s2"))
    joined = first.join(second, ["grid_id", "pred_id"], "left")
    rules = [
        (F.col("s1.pv_present").isNull(), "stage1_abstain"), (F.col("s1.pv_present"), "stage1_pv"), (F.coalesce("s1.lookalike", F.lit("")) != "skylight", "stage1_drop"),
        (F.coalesce(F.col("s2.pv_present"), F.lit(False)), "stage2_keep"), (F.col("s2.pv_present").isNotNull(), "stage2_drop"),
    ]
    out = joined.select("grid_id", "pred_id", columns.first_match(rules, "stage2_missing").alias("source"))
    action = columns.first_match([(F.col("source").isin("stage1_pv", "stage2_keep"), "keep"), (F.col("source").endswith("drop"), "drop")], "review")
    return out.withColumn("action", action)


@query(f"{_STAGES} SELECT grid_id, pred_id, source, action FROM a")
def n2_merge_stage_decisions(spark, d):
    return merged_decisions(spark, d)


@query(f"{_STAGES} SELECT action, source, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ROLLUP (action, source)")
def h37_decision_funnel(spark, d):
    return merged_decisions(spark, d).rollup("action", "source").agg(F.count("*").alias("n"))


@query(f"""{with_views('decisions')}, r AS (SELECT event_id, pv_present, confidence >= 0.5 AS auto_drop, CASE WHEN pv_present IS NULL THEN 'review' WHEN pv_present THEN 'keep' ELSE 'drop' END AS action FROM decisions),
v AS (SELECT event_id, list_filter([CASE WHEN auto_drop AND action <> 'drop' THEN 'auto_drop_without_drop' END, CASE WHEN auto_drop AND pv_present IS DISTINCT FROM false THEN 'auto_drop_of_pv' END, CASE WHEN action = 'drop' AND NOT auto_drop THEN 'drop_without_auto' END], lambda x: x IS NOT NULL) AS reasons FROM r)
SELECT event_id, array_to_string(reasons, ',') AS reasons FROM v WHERE len(reasons) > 0""")
def n1_fail_closed_violations(spark, d):
    r = view(spark, d, "decisions").withColumns({"auto_drop": F.col("confidence") >= 0.5, "action": decisions.review_action(F.col("pv_present"))})
    reasons = decisions.fail_closed_reasons(F.col("action"), F.col("auto_drop"), F.col("pv_present"))
    return r.select("event_id", reasons.alias("reasons")).where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ","))


_LANES = ", ':', ".join(f"CAST(sum(CAST(concat('0x', substr(d, {8 * k + 1}, 8)) AS BIGINT)) AS VARCHAR)" for k in range(8))


@query(f"{with_views('negative_pool')}, s AS (SELECT region, sha256(concat('v', chip_id)) AS d FROM negative_pool) SELECT region, sha256(concat(CAST(count(*) AS VARCHAR), ':', {_LANES})) AS fingerprint, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY region")
def m15_fingerprint(spark, d):
    return ranks.fingerprint(view(spark, d, "negative_pool"), ["region"], F.col("chip_id"))


@query(f"""{with_views('negative_pool')}, new AS (SELECT chip_id, archetype FROM negative_pool WHERE region IN ('ASIA', 'EUROPE')), pool AS (SELECT chip_id FROM negative_pool WHERE region IN ('EUROPE', 'AFRICA'))
SELECT chip_id, min(archetype) AS archetype FROM new WHERE chip_id NOT IN (SELECT chip_id FROM pool) GROUP BY chip_id""")
def k5_idempotent_append(spark, d):
    rows = view(spark, d, "negative_pool")
    new, pool = rows.where("region in ('ASIA', 'EUROPE')"), rows.where("region in ('EUROPE', 'AFRICA')")
    return decisions.unseen(new, pool, ["chip_id"]).groupBy("chip_id").agg(F.min("archetype").alias("archetype"))
