"""Queries on areas of unions, per-grid accuracy and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rooftally.operators import spatial, stats
from rooftally.operators.matching import ratio
from rooftally.plans.registry import query
from rooftally.sources.views import view, with_views

KEYS = ["region", "model_run", "grid_id"]
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9]


def per_run(g: DataFrame, p: DataFrame) -> DataFrame:
    """Ground truth once for each run that has predictions in its grid."""
    return g.join(p.select(*KEYS).distinct(), ["region", "grid_id"])


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = view(spark, d, "predictions")
    return per_run(view(spark, d, "ground_truth"), p), p


def slab(name: str, src: str, keys: str) -> str:
    """SQL for the union area per key, in slabs between the x edges."""
    bk = ", ".join(f"b.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_e AS (SELECT {keys}, x AS xa, lead(x) OVER (PARTITION BY {keys} ORDER BY x) AS xb FROM (SELECT DISTINCT {keys}, unnest([x0, x1]) AS x FROM {src})),
{name}_r AS (SELECT {bk}, xa, xb, y0, y1, max(y1) OVER (PARTITION BY {bk}, xa ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM {src} b JOIN {name}_e e USING ({keys}) WHERE xb IS NOT NULL AND x0 <= xa AND x1 >= xb),
{name} AS (SELECT {keys}, CAST(sum((xb - xa) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS BIGINT) AS union_area FROM {name}_r GROUP BY {keys})"""


GR = "gr AS (SELECT g.*, r.model_run FROM ground_truth g JOIN (SELECT DISTINCT region, grid_id, model_run FROM predictions) r USING (region, grid_id))"
_K = "region, model_run, grid_id"
PAIRS = f"""pairs AS (SELECT g.region, g.model_run, g.grid_id, g.gt_id, p.poly_id, g.area AS gt_area, p.area AS pred_area, p.confidence,
  greatest(g.x0, p.x0) AS x0, greatest(g.y0, p.y0) AS y0, least(g.x1, p.x1) AS x1, least(g.y1, p.y1) AS y1,
  (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter
  FROM gr g JOIN predictions p USING ({_K}) WHERE least(g.x1, p.x1) > greatest(g.x0, p.x0) AND least(g.y1, p.y1) > greatest(g.y0, p.y0))"""
SETS = f"""{GR},
tagged AS (SELECT {_K}, x0, y0, x1, y1, unnest(['p', 'b']) AS tag FROM predictions UNION ALL SELECT {_K}, x0, y0, x1, y1, unnest(['g', 'b']) FROM gr),
{slab("u", "tagged", _K + ", tag")},
sets AS (SELECT {_K}, coalesce(max(CASE WHEN tag = 'p' THEN union_area END), 0) AS pred_union, coalesce(max(CASE WHEN tag = 'g' THEN union_area END), 0) AS gt_union,
  coalesce(max(CASE WHEN tag = 'p' THEN union_area END), 0) + coalesce(max(CASE WHEN tag = 'g' THEN union_area END), 0) - coalesce(max(CASE WHEN tag = 'b' THEN union_area END), 0) AS inter_union
  FROM u GROUP BY {_K})"""
ERRORS = """errs AS (SELECT *, coalesce(inter_union / nullif(CAST(gt_union AS DOUBLE), 0), 0) AS area_recall, coalesce(inter_union / nullif(CAST(pred_union AS DOUBLE), 0), 0) AS area_precision,
  coalesce(2 * inter_union / nullif(CAST(pred_union + gt_union AS DOUBLE), 0), 0) AS area_f1, abs(pred_union - gt_union) AS abs_error,
  abs(pred_union - gt_union) / CAST(greatest(gt_union, 1) AS DOUBLE) AS abs_rel_error, (pred_union - gt_union) / CAST(greatest(gt_union, 1) AS DOUBLE) AS signed_rel_error,
  pred_union / CAST(greatest(gt_union, 1) AS DOUBLE) AS pred_gt_ratio FROM sets)"""
_SETS = f"{with_views('predictions', 'ground_truth')}, {SETS}"


@query(f"{with_views('predictions')}, {slab('u', 'predictions', _K)} SELECT * FROM u")
def e1_union_area(spark, d):
    return spatial.union_area(view(spark, d, "predictions"), KEYS)


@query(f"{_SETS} SELECT {_K}, pred_union, gt_union, inter_union FROM sets")
def e2_intersection_area(spark, d):
    g, p = both(spark, d)
    return spatial.area_sets(p, g, KEYS).drop("pred_sum")


@query(f"""{_SETS}, {ERRORS}, s AS (SELECT {_K}, CAST(sum(area) AS BIGINT) AS pred_sum FROM predictions GROUP BY {_K})
SELECT {_K}, pred_union, gt_union, inter_union, round(area_recall, 6) AS area_recall, round(area_precision, 6) AS area_precision, round(area_f1, 6) AS area_f1, abs_error,
  round(abs_rel_error, 6) AS abs_rel_error, round(signed_rel_error, 6) AS signed_rel_error, round(pred_gt_ratio, 6) AS pred_gt_ratio, round(pred_sum / CAST(pred_union AS DOUBLE), 6) AS overlap_factor
FROM errs JOIN s USING ({_K})""")
def e3_area_prf(spark, d):
    g, p = both(spark, d)
    rows = stats.with_area_errors(spatial.area_sets(p, g, KEYS))
    names = ["area_recall", "area_precision", "area_f1", "abs_rel_error", "signed_rel_error", "pred_gt_ratio"]
    return rows.select(*KEYS, "pred_union", "gt_union", "inter_union", "abs_error", *[F.round(n, 6).alias(n) for n in names], F.round(ratio("pred_sum", "pred_union"), 6).alias("overlap_factor"))


_COVER = f"{with_views('predictions', 'ground_truth')}, {GR}, {PAIRS}, {slab('c', 'pairs', _K + ', gt_id')}"


@query(f"{_COVER} SELECT {_K}, gt_id, gr.area, coalesce(c.union_area, 0) AS covered FROM gr LEFT JOIN c USING ({_K}, gt_id)")
def e4_gt_covered_area(spark, d):
    g, p = both(spark, d)
    covered = spatial.cover_by_union(g, p, KEYS, "gt_id")
    return g.join(covered, [*KEYS, "gt_id"], "left").select(*KEYS, "gt_id", "area", F.coalesce("covered", F.lit(0)).alias("covered"))


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, {PAIRS}
SELECT {_K}, gt_id, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(inter) AS BIGINT) AS inter_sum, round(least(1.0, sum(inter) / CAST(max(gt_area) AS DOUBLE)), 6) AS coverage FROM pairs GROUP BY {_K}, gt_id""")
def e5_coverage_sum_capped(spark, d):
    g, p = both(spark, d)
    pairs = spatial.overlaps(g, p.select(*KEYS, "area", *spatial.BOX), KEYS)
    return pairs.groupBy(*KEYS, "gt_id").agg(F.count("*").alias("n_hits"), F.sum("inter").alias("inter_sum"), F.round(F.least(F.lit(1.0), F.sum("inter") / F.max("area")), 6).alias("coverage"))


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, {PAIRS}
SELECT {_K}, poly_id, CAST(count(*) AS BIGINT) AS n_hits, round(least(1.0, sum(inter) / CAST(max(pred_area) AS DOUBLE)), 6) AS purity FROM pairs GROUP BY {_K}, poly_id""")
def e5_pred_purity(spark, d):
    g, p = both(spark, d)
    pairs = spatial.overlaps(p.select(*KEYS, "poly_id", "area", *spatial.BOX), g.select(*KEYS, "area", *spatial.BOX), KEYS)
    return pairs.groupBy(*KEYS, "poly_id").agg(F.count("*").alias("n_hits"), F.round(F.least(F.lit(1.0), F.sum("inter") / F.max("area")), 6).alias("purity"))


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, {PAIRS},
t AS (SELECT pairs.*, t.threshold FROM pairs JOIN (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold) t ON confidence >= threshold),
{slab('c', 't', _K + ', gt_id, threshold')},
n AS (SELECT region, model_run, count(*) AS n_gt FROM gr GROUP BY region, model_run)
SELECT region, model_run, threshold, CAST(n_gt AS BIGINT) AS n_gt, CAST(count(*) FILTER (WHERE 2 * c.union_area >= gr.area) AS BIGINT) AS n_cov50,
  round(count(*) FILTER (WHERE 2 * c.union_area >= gr.area) / CAST(n_gt AS DOUBLE), 6) AS cov50
FROM c JOIN gr USING ({_K}, gt_id) JOIN n USING (region, model_run) GROUP BY region, model_run, threshold, n_gt""")
def e6_cov50_sweep(spark, d):
    g, p = both(spark, d)
    pairs = spatial.box_join(g, p.select(*KEYS, "confidence", *spatial.BOX), KEYS)
    clipped = pairs.select(*KEYS, "gt_id", "area", "b_confidence", *[F.greatest(f"{c}0", f"b_{c}0").alias(f"{c}0") for c in "xy"], *[F.least(f"{c}1", f"b_{c}1").alias(f"{c}1") for c in "xy"])
    wide = spatial.union_areas(clipped, [*KEYS, "gt_id", "area"], {f"c{i}": F.col("b_confidence") >= t for i, t in enumerate(THRESHOLDS)})
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("covered")) for i, t in enumerate(THRESHOLDS)]))
    rows = wide.select("region", "model_run", "area", at.alias("r")).where("r.covered > 0").groupBy("region", "model_run", "r.threshold")
    total = g.groupBy("region", "model_run").agg(F.count("*").alias("n_gt"))
    rows = rows.agg(F.count_if(2 * F.col("r.covered") >= F.col("area")).alias("n_cov50"))
    return rows.join(total, ["region", "model_run"]).withColumn("cov50", F.round(F.col("n_cov50") / F.col("n_gt"), 6))


def tiles(spark: SparkSession, d: str, n: int = 4) -> DataFrame:
    """n x n tiles of each grid cell."""
    s = 3000 // n
    g = view(spark, d, "task_grid").select("grid_id")
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    at = lambda c: (F.col(c) * s).cast("long")
    return g.select("grid_id", (F.col("i") * n + F.col("j")).cast("long").alias("tile"), at("i").alias("x0"), at("j").alias("y0"), (at("i") + s).alias("x1"), (at("j") + s).alias("y1"))


TILES = """tiles AS (SELECT grid_id, CAST(i * 4 + j AS BIGINT) AS tile, CAST(i * 750 AS BIGINT) AS x0, CAST(j * 750 AS BIGINT) AS y0, CAST(i * 750 + 750 AS BIGINT) AS x1, CAST(j * 750 + 750 AS BIGINT) AS y1
  FROM task_grid, (SELECT unnest([0, 1, 2, 3]) AS i), (SELECT unnest([0, 1, 2, 3]) AS j))"""


@query(f"""{with_views('predictions', 'task_grid')}, {TILES}
SELECT p.region, p.model_run, p.grid_id, t.tile, CAST(count(*) AS BIGINT) AS n_boxes,
  CAST(sum((least(p.x1, t.x1) - greatest(p.x0, t.x0)) * (least(p.y1, t.y1) - greatest(p.y0, t.y0))) AS BIGINT) AS clipped_area
FROM predictions p JOIN tiles t ON p.grid_id = t.grid_id AND p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1 GROUP BY ALL""")
def e7_clip_area(spark, d):
    p = view(spark, d, "predictions")
    pairs = spatial.box_join(p.select(*KEYS, *spatial.BOX), tiles(spark, d), ["grid_id"], size=750)
    return pairs.groupBy(*KEYS, F.col("b_tile").alias("tile")).agg(F.count("*").alias("n_boxes"), F.sum("inter").alias("clipped_area"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    g, p = both(spark, d)
    return stats.with_area_errors(spatial.area_sets(p, g, KEYS))


def _tier1_sql(keys: str, center: str, src: str = "errs") -> str:
    m = "mean_ratio" if center == "unweighted" else "br / b"
    r4 = lambda e, n: f"round({e}, 4) AS {n}"
    k = f"{keys}, " if keys else ""
    cols = [r4("CAST(inter_total AS DOUBLE) / nullif(gt_total, 0)", "agg_recall"), r4("CAST(inter_total AS DOUBLE) / nullif(pred_total, 0)", "agg_precision"),
        r4("CASE WHEN inter_total > 0 THEN 2 * (CAST(inter_total AS DOUBLE) / nullif(gt_total, 0)) * (CAST(inter_total AS DOUBLE) / nullif(pred_total, 0)) / (CAST(inter_total AS DOUBLE) / nullif(gt_total, 0) + CAST(inter_total AS DOUBLE) / nullif(pred_total, 0)) END", "agg_f1"),
        r4("mean_f1", "mean_f1"), r4("CAST(pred_total AS DOUBLE) / nullif(gt_total, 0)", "bulk"), *[r4(n, n) for n in ("mae", "mre", "signed_mre", "within_20", "mean_ratio", "std_ratio")],
        r4(f"sqrt(greatest((brr - 2 * ({m}) * br + ({m}) * ({m}) * b) / nullif(b, 0), 0))", "std_ratio_bw"),
        r4(f"CASE WHEN ({m}) <> 0 THEN sqrt(greatest((brr - 2 * ({m}) * br + ({m}) * ({m}) * b) / nullif(b, 0), 0)) / ({m}) END", "cv_ratio_bw"),
        *[r4(n, n) for n in ("std_logratio", "rmse", "ols_slope", "ols_r2", "thru0_slope")]]
    return f"""s AS (SELECT {k}CAST(count(*) AS BIGINT) AS n_grids, CAST(sum(pred_union) AS BIGINT) AS pred_total, CAST(sum(gt_union) AS BIGINT) AS gt_total, CAST(sum(inter_union) AS BIGINT) AS inter_total,
  avg(area_f1) AS mean_f1, avg(abs_error) AS mae, avg(abs_rel_error) AS mre, avg(signed_rel_error) AS signed_mre, avg(CASE WHEN pred_gt_ratio BETWEEN 0.8 AND 1.2 THEN 1.0 ELSE 0.0 END) AS within_20,
  avg(pred_gt_ratio) AS mean_ratio, stddev_samp(pred_gt_ratio) AS std_ratio, stddev_samp(CASE WHEN gt_union > 0 AND pred_union > 0 THEN ln(CAST(pred_union AS DOUBLE) / gt_union) END) AS std_logratio,
  sqrt(avg(CAST(pred_union - gt_union AS DOUBLE) * (pred_union - gt_union))) AS rmse, sum(gt_union * pred_gt_ratio) AS br, sum(gt_union * pred_gt_ratio * pred_gt_ratio) AS brr, sum(CAST(gt_union AS DOUBLE)) AS b,
  regr_slope(CAST(pred_union AS DOUBLE), CAST(gt_union AS DOUBLE)) AS ols_slope, regr_r2(CAST(pred_union AS DOUBLE), CAST(gt_union AS DOUBLE)) AS ols_r2,
  sum(CAST(pred_union AS DOUBLE) * gt_union) / nullif(sum(CAST(gt_union AS DOUBLE) * gt_union), 0) AS thru0_slope FROM {src} {f'GROUP BY {keys}' if keys else ''})
SELECT {k}n_grids, pred_total, gt_total, inter_total, {', '.join(cols)} FROM s"""


@query(f"{_SETS}, {ERRORS}, {_tier1_sql('region, model_run', 'unweighted')}")
def h1_tier1_summary(spark, d):
    return stats.tier1_summary(errors(spark, d), ["region", "model_run"])


@query(f"{_SETS}, {ERRORS}, {_tier1_sql('region, model_run', 'weighted')}")
def h2_dispersion_audit(spark, d):
    return stats.tier1_summary(errors(spark, d), ["region", "model_run"], center="weighted")


@query(f"{_SETS}, {ERRORS}, both_ AS (SELECT * FROM errs UNION ALL SELECT * REPLACE ('ALL' AS region) FROM errs), {_tier1_sql('region, model_run', 'unweighted', 'both_')}")
def h50_pooled_vs_group(spark, d):
    rows = errors(spark, d)
    pooled = rows.withColumn("region", F.explode(F.array("region", F.lit("ALL"))))
    return stats.tier1_summary(pooled, ["region", "model_run"])


_OLS = "round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 6) AS r2"


@query(f"{_SETS} SELECT region, model_run, CAST(count(*) AS BIGINT) AS n, {_OLS} FROM (SELECT *, CAST(pred_union AS DOUBLE) AS y, CAST(gt_union AS DOUBLE) AS x FROM sets) GROUP BY region, model_run")
def h3_ols(spark, d):
    rows = errors(spark, d).withColumns({"y": F.col("pred_union").cast("double"), "x": F.col("gt_union").cast("double")})
    return rows.groupBy("region", "model_run").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


@query(f"""{_SETS}, b AS (SELECT region, model_run, sum(CAST(pred_union AS DOUBLE) * gt_union) / nullif(sum(CAST(gt_union AS DOUBLE) * gt_union), 0) AS beta, avg(pred_union) AS m FROM sets GROUP BY region, model_run)
SELECT region, model_run, round(max(beta), 6) AS beta, round(1 - sum((pred_union - beta * gt_union) * (pred_union - beta * gt_union)) / nullif(sum((pred_union - m) * (pred_union - m)), 0), 6) AS r2
FROM sets JOIN b USING (region, model_run) GROUP BY region, model_run""")
def h4_through_origin(spark, d):
    rows, keys = errors(spark, d), ["region", "model_run"]
    x, y = F.col("gt_union").cast("double"), F.col("pred_union").cast("double")
    fit = rows.groupBy(*keys).agg((F.sum(x * y) / F.when(F.sum(x * x) != 0, F.sum(x * x))).alias("beta"), F.avg(y).alias("m"))
    res, dev = y - F.col("beta") * x, y - F.col("m")
    return rows.join(fit, keys).groupBy(*keys).agg(F.round(F.max("beta"), 6).alias("beta"), F.round(1 - F.sum(res * res) / F.when(F.sum(dev * dev) != 0, F.sum(dev * dev)), 6).alias("r2"))


#: Resampling by times drawn; VALUE is of ``errs``, STAT is made of w (rows drawn), v and vv (sums of values and squares).
_BOOT = f"""r AS (SELECT region, model_run, VALUE AS v, grid_id FROM errs WHERE VALUE IS NOT NULL),
bu AS (SELECT region, model_run, v, draw, CAST(concat('0x', substr(md5(concat('42:', draw, ':', grid_id)), 1, 8)) AS BIGINT) AS u FROM r, (SELECT unnest(generate_series(1, 1000)) AS draw)),
t AS (SELECT region, model_run, draw, v, {' + '.join(f'CAST(u >= {x} AS INTEGER)' for x in stats.DRAWN)} AS w FROM bu),
s AS (SELECT region, model_run, draw, count(*) AS n, sum(w) AS w, sum(w * v) AS v, sum(w * v * v) AS vv FROM t GROUP BY ALL),
q AS (SELECT region, model_run, n, CASE WHEN w > 0 THEN round(STAT, 9) END AS s FROM s)
SELECT region, model_run, CAST(max(n) AS BIGINT) AS n, round(CASE WHEN max(n) >= 3 THEN quantile_cont(s, 0.025) END, 6) AS ci_low, round(CASE WHEN max(n) >= 3 THEN quantile_cont(s, 0.975) END, 6) AS ci_high FROM q GROUP BY region, model_run"""


@query(f"{_SETS}, {ERRORS}, " + _BOOT.replace("VALUE", "area_f1").replace("STAT", "v / w"))
def h5_bootstrap_mean_f1(spark, d):
    return stats.bootstrap_ci(errors(spark, d), ["region", "model_run"], "grid_id", "area_f1", "mean")


@query(f"{_SETS}, {ERRORS}, " + _BOOT.replace("VALUE", "CAST(abs_error AS DOUBLE)").replace("STAT", "sqrt(vv / w)"))
def h5_bootstrap_rmse(spark, d):
    return stats.bootstrap_ci(errors(spark, d), ["region", "model_run"], "grid_id", "abs_error", "rms")


_SWEEP = f"""{with_views('predictions', 'ground_truth')}, {GR}, th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
tagged AS (SELECT {_K}, threshold, x0, y0, x1, y1, unnest(['p', 'b']) AS tag FROM predictions, th WHERE confidence >= threshold UNION ALL SELECT {_K}, threshold, x0, y0, x1, y1, unnest(['g', 'b']) FROM gr, th),
{slab('u', 'tagged', _K + ', threshold, tag')},
sets AS (SELECT {_K}, threshold, coalesce(max(CASE WHEN tag = 'p' THEN union_area END), 0) AS pred_union, coalesce(max(CASE WHEN tag = 'g' THEN union_area END), 0) AS gt_union,
  coalesce(max(CASE WHEN tag = 'p' THEN union_area END), 0) + coalesce(max(CASE WHEN tag = 'g' THEN union_area END), 0) - coalesce(max(CASE WHEN tag = 'b' THEN union_area END), 0) AS inter_union FROM u GROUP BY {_K}, threshold), {ERRORS}"""


def swept(spark: SparkSession, d: str) -> DataFrame:
    """Per-grid area rows at every confidence threshold, in one job."""
    g, p = both(spark, d)
    rules = [((t,), F.col("confidence") >= t) for t in THRESHOLDS]
    return stats.with_area_errors(spatial.swept_sets(p.select(*KEYS, *spatial.BOX, "confidence"), g, KEYS, rules, ["threshold"]))


@query(f"{_SWEEP}, {_tier1_sql('model_run, threshold', 'unweighted')}")
def h25_poly_conf_sweep(spark, d):
    return stats.tier1_summary(swept(spark, d), ["model_run", "threshold"])


@query(f"""{_SWEEP}, z AS (SELECT * FROM (WITH {_tier1_sql('model_run, threshold', 'unweighted')})) SELECT model_run, min_by(threshold, (round(std_ratio_bw + rmse / 100000, 6), threshold)) AS threshold,
  min(round(std_ratio_bw + rmse / 100000, 6)) AS cost FROM z WHERE bulk BETWEEN 0.5 AND 2 GROUP BY model_run""")
def h25_rank_lock(spark, d):
    """The threshold of least dispersion plus error, among those whose bulk is sensible."""
    rows = stats.tier1_summary(swept(spark, d), ["model_run", "threshold"]).where("bulk between 0.5 and 2")
    cost = F.round(F.col("std_ratio_bw") + F.col("rmse") / 100000, 6)
    return rows.groupBy("model_run").agg(F.min(F.struct(cost.alias("cost"), F.col("threshold"))).alias("m")).select("model_run", "m.threshold", "m.cost")
