"""Queries on matched and merged boxes, fits, probes, and tables of grids and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rooftally.operators import columns, graph, joins, matching, sampling, spatial, stats
from rooftally.operators.matching import ratio
from rooftally.plans.area import GR, KEYS, PAIRS, THRESHOLDS, both, slab
from rooftally.plans import loops
from rooftally.plans.registry import query
from rooftally.sources.views import table, view, with_views

_K = ", ".join(KEYS)
_PG = with_views("predictions", "ground_truth")
_P = with_views("predictions")
_SIZES = ([4000, 10000], ["small", "medium", "large"])
_SIZE = "CASE WHEN {0} < 4000 THEN 'small' WHEN {0} < 10000 THEN 'medium' ELSE 'large' END"


_IOU = "inter / CAST(gt_area + pred_area - inter AS DOUBLE)"
_STRICT = "iou DESC, gt_id, poly_id"
_MATCHED = f"""{_PG}, {GR}, {PAIRS}, e AS (SELECT *, {_IOU} AS iou FROM pairs WHERE {_IOU} >= 0.3), {loops.pick_pairs('m', 'e', _K, _STRICT)},
mm AS (SELECT m.model_run, m.iou, g.area AS gt_area, p.area AS pred_area FROM m JOIN gr g USING (model_run, gt_id) JOIN predictions p ON p.poly_id = m.poly_id)"""


def _by_size(c="area"):
    return columns.bucket(F.col(c), *_SIZES)


def _matched(spark, d, iou=0.3):
    g, p = both(spark, d)
    m = matching.match_strict(g, p, KEYS, iou).select("model_run", "gt_id", "poly_id", "iou")
    return g, m, m.join(g.select("model_run", "gt_id", F.col("area").alias("gt_area")), ["model_run", "gt_id"]).join(p.select("poly_id", F.col("area").alias("pred_area")), "poly_id")


@query(f"{_MATCHED} SELECT model_run, CAST(count(*) AS BIGINT) AS n, round(avg(iou), 6) AS iou_mean, round(quantile_cont(iou, 0.25), 6) AS iou_p25, round(quantile_cont(iou, 0.5), 6) AS iou_p50, round(quantile_cont(iou, 0.75), 6) AS iou_p75, round(quantile_cont(dice, 0.25), 6) AS dice_p25, round(quantile_cont(dice, 0.5), 6) AS dice_p50, round(quantile_cont(dice, 0.75), 6) AS dice_p75, round(avg(CASE WHEN iou >= 0.5 THEN 1.0E0 ELSE 0.0E0 END), 6) AS share_half FROM (SELECT *, 2 * iou / (1 + iou) AS dice FROM mm) GROUP BY model_run")
def h7_footprint_quality(spark, d):
    """IoU and Dice of matched pairs per run."""
    m = _matched(spark, d)[2].withColumn("dice", 2 * F.col("iou") / (1 + F.col("iou")))
    spread = [F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_p{round(100 * q)}") for c in ("iou", "dice") for q in (0.25, 0.5, 0.75)]
    return m.groupBy("model_run").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("iou_mean"), *spread, F.round(F.avg((F.col("iou") >= 0.5).cast("double")), 6).alias("share_half"))


@query(f"""{_MATCHED} SELECT model_run, {_SIZE.format('gt_area')} AS size_class, CAST(count(*) AS BIGINT) AS n, CAST(sum(pred_area - gt_area) AS BIGINT) AS signed_error, CAST(sum(abs(pred_area - gt_area)) AS BIGINT) AS abs_error, round(avg(abs(pred_area - gt_area) / CAST(gt_area AS DOUBLE)), 6) AS relative_error FROM mm GROUP BY ALL""")
def h8_area_error_by_size(spark, d):
    m = _matched(spark, d)[2].withColumns({"size_class": _by_size("gt_area"), "error": F.col("pred_area") - F.col("gt_area")})
    return m.groupBy("model_run", "size_class").agg(
        F.count("*").alias("n"), F.sum("error").alias("signed_error"), F.sum(F.abs("error")).alias("abs_error"), F.round(F.avg(F.abs("error") / F.col("gt_area")), 6).alias("relative_error"),
    )


@query(f"""{_PG}, {GR}, {PAIRS}, th AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS level), e AS (SELECT pairs.*, level, {_IOU} AS iou FROM pairs, th WHERE {_IOU} >= level), {loops.pick_pairs('m', 'e', _K + ', level', _STRICT)}
SELECT g.model_run, {_SIZE.format('g.area')} AS size_class, th.level, CAST(count(*) AS BIGINT) AS n_gt, CAST(count(m.gt_id) AS BIGINT) AS tp, round(count(m.gt_id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM gr g JOIN th ON true LEFT JOIN m ON m.model_run = g.model_run AND m.gt_id = g.gt_id AND m.level = th.level GROUP BY ALL""")
def h9_recall_by_size(spark, d):
    """Recall of one matching per IoU; the thresholds are a key."""
    g, p = both(spark, d)
    levels = F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)]))
    keys = [*KEYS, "level"]
    edges = spatial.overlaps(g, p, KEYS).withColumn("level", levels).where("iou >= level").select(*keys, "gt_id", F.col("b_poly_id").alias("poly_id"), "iou")
    hit = graph.greedy_match(edges, keys, "gt_id", "poly_id", [-F.col("iou"), F.col("gt_id"), F.col("poly_id")]).select("model_run", "gt_id", "level", F.lit(1).alias("hit"))
    rows = g.select("model_run", "gt_id", _by_size().alias("size_class"), levels.alias("level")).join(hit, ["model_run", "gt_id", "level"], "left")
    return rows.groupBy("model_run", "size_class", "level").agg(F.count("*").alias("n_gt"), F.count("hit").alias("tp")).withColumn("recall", F.round(ratio("tp", "n_gt"), 6))


@query(f"""{_PG}, {GR}, th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold), gt AS (SELECT * FROM gr, th), pt AS (SELECT * FROM predictions, th WHERE confidence >= threshold),
{loops.pick_groups('m', 'gt', 'pt', _K + ', threshold', 0.3)}, {loops.counted('c', 'gt', 'pt', 'model_run, threshold', 'm', 'm_hit')} SELECT * FROM c""")
def h11_pr_curve(spark, d):
    """Precision and recall per confidence threshold, installations matched to unions; the threshold is a key."""
    g, p = both(spark, d)
    keys, per = [*KEYS, "threshold"], ["model_run", "threshold"]
    cover, near = matching.merged_cover(g, p, KEYS, {f"c{i}": F.col("confidence") >= t for i, t in enumerate(THRESHOLDS)}, ("confidence",))
    of = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), f"c{i}.union_area", f"c{i}.covered") for i, t in enumerate(THRESHOLDS)]))
    cover = cover.select(*KEYS, "gt_id", "area", of.alias("c")).select(*KEYS, "gt_id", "area", "c.*").withColumn("iou", matching.merged_iou())
    accepted, members = matching.accept_merged(cover.where("covered > 0 and iou >= 0.3"), stats.through_thresholds(near, THRESHOLDS, "confidence"), keys)
    p = stats.through_thresholds(p, THRESHOLDS, "confidence")
    g = g.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    c = matching.counts(g, p, per, accepted, members)
    return matching.prf(c).select("model_run", "threshold", "tp", "fp", "fn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")])


@query(f"""{_PG}, {GR}, {PAIRS}, b AS (SELECT poly_id, max(inter / (gt_area + pred_area - inter)) AS iou, arg_max(gt_area, (inter / (gt_area + pred_area - inter), -gt_id)) AS gt_area FROM pairs GROUP BY poly_id),
r AS (SELECT model_run, p.area / CAST(gt_area AS DOUBLE) AS r FROM predictions p JOIN b USING (poly_id) WHERE iou >= 0.2)
SELECT model_run, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90, CAST(count(*) FILTER (WHERE r > 1.1) AS BIGINT) AS n_larger, CAST(count(*) FILTER (WHERE r < 0.9) AS BIGINT) AS n_smaller FROM r GROUP BY ALL""")
def h30_refine_halo_audit(spark, d):
    g, p = both(spark, d)
    pairs = spatial.overlaps(p, g, KEYS).groupBy("model_run", "poly_id", "area").agg(F.max(F.struct("iou", (-F.col("b_gt_id")).alias("n"), F.col("b_area").alias("gt_area"))).alias("m"))
    r = pairs.where("m.iou >= 0.2").select("model_run", (F.col("area") / F.col("m.gt_area")).alias("r"))
    return r.groupBy("model_run").agg(
        F.count("*").alias("n"), *[F.round(F.percentile("r", F.lit(q)), 6).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)],
        F.count_if(F.col("r") > 1.1).alias("n_larger"), F.count_if(F.col("r") < 0.9).alias("n_smaller"),
    )


@query(f"""{_PG}, {GR}, {PAIRS}, b AS (SELECT model_run, gt_id, max(CASE WHEN confidence >= 0.8 THEN inter / (gt_area + pred_area - inter) END) AS strict, max(inter / (gt_area + pred_area - inter)) AS loose FROM pairs GROUP BY ALL),
c AS (SELECT model_run, {_SIZE.format('area')} AS stratum, CASE WHEN strict >= 0.5 THEN 'covered_by_baseline' WHEN loose >= 0.5 THEN 'nms_recoverable' ELSE 'no_proposal' END AS category FROM gr LEFT JOIN b USING (model_run, gt_id))
SELECT model_run, coalesce(stratum, 'ALL') AS stratum, CAST(count(*) AS BIGINT) AS n_gt, {', '.join(f"CAST(count(*) FILTER (WHERE category = '{c}') AS BIGINT) AS n_{c}" for c in ('covered_by_baseline', 'nms_recoverable', 'no_proposal'))} FROM c GROUP BY GROUPING SETS ((model_run, stratum), (model_run))""")
def h32_suppression_class(spark, d):
    """Ground truth covered by confident predictions, by any, or by none; per stratum and for all."""
    g, p = both(spark, d)
    best = spatial.overlaps(g, p, KEYS).groupBy("model_run", "gt_id").agg(F.max(F.when(F.col("b_confidence") >= 0.8, F.col("iou"))).alias("strict"), F.max("iou").alias("loose"))
    category = columns.first_match([(F.col("strict") >= 0.5, "covered_by_baseline"), (F.col("loose") >= 0.5, "nms_recoverable")], "no_proposal")
    c = g.select("model_run", "gt_id", _by_size().alias("stratum")).join(best, ["model_run", "gt_id"], "left").withColumn("category", category)
    rows = c.select("model_run", F.explode(F.array("stratum", F.lit("ALL"))).alias("stratum"), "category")
    return rows.groupBy("model_run", "stratum").agg(F.count("*").alias("n_gt"), *[F.count_if(F.col("category") == x).alias(f"n_{x}") for x in ("covered_by_baseline", "nms_recoverable", "no_proposal")])


@query(f"""{_PG}, {GR}, {PAIRS}, v AS (SELECT region, gt_id, {', '.join(f"coalesce(max(inter / (gt_area + pred_area - inter)) FILTER (WHERE model_run = 'run_{r}'), 0) >= 0.4 AS hit_{r}" for r in 'ABC')} FROM pairs GROUP BY ALL)
SELECT coalesce(region, 'ALL') AS region, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE hit_A) AS BIGINT) AS n_a, CAST(count(*) FILTER (WHERE hit_A OR hit_B) AS BIGINT) AS n_ab, CAST(count(*) FILTER (WHERE hit_A OR hit_B OR hit_C) AS BIGINT) AS n_abc FROM v GROUP BY GROUPING SETS ((region), ())""")
def h33_view_conversion(spark, d):
    """What each further run adds to the ground truth found."""
    g, p = both(spark, d)
    best = spatial.overlaps(g, p, KEYS).groupBy("region", "gt_id").pivot("model_run", ["run_A", "run_B", "run_C"]).agg(F.max("iou"))
    a, b, c = (F.coalesce(F.col(f"run_{r}"), F.lit(0)) >= 0.4 for r in "ABC")
    rows = best.withColumns({"a": a, "ab": a | b, "abc": a | b | c}).withColumn("region", F.explode(F.array("region", F.lit("ALL"))))
    return rows.groupBy("region").agg(F.count("*").alias("n"), *[F.count_if(x).alias(f"n_{x}") for x in ("a", "ab", "abc")])


def _platt(bins: str, steps: int = 6) -> str:
    """``WITH`` members w0 … wN: Newton steps of a logistic fit y ~ a + b·s per run, on counts per score. One text for both engines."""
    out = ["w0 AS (SELECT DISTINCT model_run, 0.0E0 AS a, 0.0E0 AS b FROM bins)"]
    for k in range(steps):
        out.append(f"""g{k} AS (SELECT model_run, max(a) AS a, max(b) AS b, sum(y - n * q) AS ga, sum((y - n * q) * s) AS gb, sum(n * q * (1 - q)) AS haa, sum(n * q * (1 - q) * s) AS hab, sum(n * q * (1 - q) * s * s) AS hbb
FROM (SELECT bins.model_run, a, b, s, n, y, 1 / (1 + exp(-(a + b * s))) AS q FROM bins JOIN w{k} ON bins.model_run = w{k}.model_run) x GROUP BY model_run)""")
        out.append(f"w{k + 1} AS (SELECT model_run, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{k})")
    return f"bins AS ({bins}),\n" + ",\n".join(out)


_BINS = "SELECT model_run, confidence AS s, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS y FROM {0} GROUP BY model_run, confidence"
_FIT = """SELECT w6.model_run, round(max(a), 5) AS a, round(max(b), 5) AS b, round(sum(y * pow(1 - q, 2) + (n - y) * q * q) / sum(n), 6) AS brier
FROM (SELECT bins.model_run, s, n, y, 1 / (1 + exp(-(a + b * s))) AS q, a, b FROM bins JOIN w6 ON bins.model_run = w6.model_run) w6 GROUP BY w6.model_run"""


@query(f"""{_PG}, {GR}, {PAIRS}, top AS (SELECT poly_id, max(inter / CAST(pred_area AS DOUBLE)) AS iof FROM pairs GROUP BY poly_id),
scored AS (SELECT model_run, confidence, coalesce(iof, 0) >= 0.5 AS hit FROM predictions LEFT JOIN top USING (poly_id)), {_platt(_BINS.format('scored'))} {_FIT}""")
def h28_platt_fit(spark, d):
    """Logistic calibration of the score on all rows. Steps run on counts per score, so each is a join of two small tables."""
    g, p = both(spark, d)
    top = spatial.overlaps(p, g, KEYS).groupBy("poly_id").agg(F.max("iof").alias("iof"))
    scored = p.select("model_run", "poly_id", "confidence").join(top, "poly_id", "left").withColumn("hit", F.coalesce("iof", F.lit(0)) >= 0.5)
    return spark.sql(f"WITH {_platt(_BINS.format('{scored}'))} {_FIT}", scored=scored)


@query(f"""{_P}, t AS (SELECT region, model_run, grid_id, count(*) FILTER (WHERE review_status <> 'delete') AS trusted, count(*) FILTER (WHERE review_status = 'delete') AS untrusted FROM predictions GROUP BY ALL)
SELECT region, model_run, CAST(sum(trusted) AS BIGINT) AS trusted, CAST(sum(untrusted) AS BIGINT) AS untrusted, CAST(count(*) AS BIGINT) AS n_tiles, round(sum(untrusted) / CAST(sum(trusted) AS DOUBLE), 6) AS ratio FROM t GROUP BY ALL""")
def h47_build_composition(spark, d):
    gone = F.col("review_status") == "delete"
    t = view(spark, d, "predictions").groupBy(*KEYS).agg(F.count_if(~gone).alias("trusted"), F.count_if(gone).alias("untrusted"))
    out = t.groupBy("region", "model_run").agg(F.sum("trusted").alias("trusted"), F.sum("untrusted").alias("untrusted"), F.count("*").alias("n_tiles"))
    return out.withColumn("ratio", F.round(ratio("untrusted", "trusted"), 6))


@query(f"""{with_views('markers')}, y AS (SELECT grid_id, CAST(year(created) AS INTEGER) AS year, created FROM markers)
SELECT grid_id, CAST(count(DISTINCT created) AS BIGINT) AS n_dates, CAST(count(DISTINCT year) AS BIGINT) AS n_years, {', '.join(f"CAST(min(created) FILTER (WHERE year = {y}) AS VARCHAR) AS first_{y}" for y in (1995, 1996, 1997))} FROM y GROUP BY grid_id""")
def h48_vintage_availability(spark, d):
    y = F.year("created")
    return view(spark, d, "markers").groupBy("grid_id").agg(
        F.countDistinct("created").alias("n_dates"), F.countDistinct(y).alias("n_years"), *[F.min(F.when(y == k, F.col("created"))).cast("string").alias(f"first_{k}") for k in (1995, 1996, 1997)])


@query(f"""{loops.recursive(with_views('ground_truth'))}, e AS (SELECT a.gt_id AS a, b.gt_id AS b FROM ground_truth a JOIN ground_truth b USING (region, grid_id) WHERE a.gt_id < b.gt_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
  AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 100), {loops.components('lab', 'e')},
t AS (SELECT g.*, coalesce(component, gt_id) AS component FROM ground_truth g LEFT JOIN lab ON gt_id = node), {slab('u', 't', 'region, grid_id, component')}
SELECT region, grid_id, component, CAST(count(*) AS BIGINT) AS n_members, string_agg(DISTINCT source, '+' ORDER BY source) AS source, any_value(u.union_area) AS union_area FROM t JOIN u USING (region, grid_id, component) GROUP BY region, grid_id, component""")
def f10_dissolve_clean_gt(spark, d):
    """Ground truth that overlaps by over 100 square decimetres becomes one; sources are listed, areas are of the union."""
    return matching.dissolve_overlaps(view(spark, d, "ground_truth"), ["region", "grid_id"], 100)


@query(f"""{with_views('predictions', 'task_grid')}, p AS (SELECT p.grid_id, poly_id, area, x0 + gx * 3000 AS x0, y0 + gy * 3000 AS y0, x1 + gx * 3000 AS x1, y1 + gy * 3000 AS y1 FROM predictions p JOIN task_grid t USING (grid_id) WHERE review_status <> 'delete'),
r AS (SELECT * FROM p WHERE x0 % 3000 < 250 OR x1 % 3000 < 250 OR y0 % 3000 < 250 OR y1 % 3000 < 250),
s AS (SELECT a.*, b.poly_id AS b_poly_id, b.area AS b_area, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter, (a.x0 + a.x1 - b.x0 - b.x1) / 2.0E0 AS dx, (a.y0 + a.y1 - b.y0 - b.y1) / 2.0E0 AS dy
  FROM r a JOIN r b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.grid_id <> b.grid_id),
e AS (SELECT poly_id AS h, b_poly_id AS l, -area AS c FROM s WHERE inter / CAST(area + b_area - inter AS DOUBLE) >= 0.3 AND dx * dx + dy * dy <= 22500 AND (area > b_area OR (area = b_area AND poly_id < b_poly_id))),
{loops.suppressed('gone', 'e', '', 'c')} SELECT grid_id, poly_id, CAST(row_number() OVER (PARTITION BY grid_id ORDER BY poly_id) AS INTEGER) AS new_no FROM p WHERE poly_id NOT IN (SELECT id FROM gone)""")
def f14_dedup_cross_grid(spark, d):
    """Of boxes in different cells, centres 150 at most apart and IoU 0.3 or more, the larger stays."""
    cells = view(spark, d, "task_grid").select("grid_id", (F.col("gx") * 3000).alias("ox"), (F.col("gy") * 3000).alias("oy"))
    p = view(spark, d, "predictions").where("review_status <> 'delete'").join(cells, "grid_id").select("grid_id", "poly_id", "area", *[(F.col(c) + F.col(f"o{c[0]}")).alias(c) for c in spatial.BOX])
    # only what reaches over the border of its cell can meet a box of another cell
    reach = p.where("x0 % 3000 < 250 or x1 % 3000 < 250 or y0 % 3000 < 250 or y1 % 3000 < 250")
    dx, dy = ((F.col(f"{c}0") + F.col(f"{c}1") - F.col(f"b_{c}0") - F.col(f"b_{c}1")) / 2 for c in "xy")
    pairs = spatial.overlaps(reach, reach, []).where("grid_id <> b_grid_id and iou >= 0.3").where(dx * dx + dy * dy <= 22500)
    first = (F.col("area") > F.col("b_area")) | ((F.col("area") == F.col("b_area")) & (F.col("poly_id") < F.col("b_poly_id")))
    kept = graph.priority_keep(p, pairs.where(first).select(F.col("poly_id").alias("h"), F.col("b_poly_id").alias("l"), "area"), "poly_id", "h", "l", [-F.col("area"), F.col("h")])
    return kept.select("grid_id", "poly_id", F.row_number().over(Window.partitionBy("grid_id").orderBy("poly_id")).alias("new_no"))


@query(f"""{_PG}, e AS (SELECT g.region, g.grid_id, p.model_run, g.gt_id, p.poly_id, (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) AS inter, g.area AS ga, p.area AS pa
  FROM ground_truth g JOIN predictions p ON g.region = p.region AND g.grid_id = p.grid_id AND g.x0 < p.x1 AND p.x0 < g.x1 AND g.y0 < p.y1 AND p.y0 < g.y1), f AS (SELECT *, inter / CAST(ga + pa - inter AS DOUBLE) AS iou FROM e WHERE inter / CAST(ga + pa - inter AS DOUBLE) > 0.5),
{loops.pick_pairs('m', 'f', _K, 'gt_id, iou DESC, poly_id')}
SELECT p.region, p.model_run, p.grid_id, p.poly_id, m.gt_id AS old_id, CAST(row_number() OVER (PARTITION BY p.region, p.model_run, p.grid_id ORDER BY m.gt_id IS NULL, m.gt_id, p.poly_id) AS INTEGER) AS place FROM predictions p LEFT JOIN m ON m.poly_id = p.poly_id""")
def f17_stable_reindex(spark, d):
    """Old rows that a new box matches (IoU above 0.5, each once, in old order) keep their place; further new boxes follow."""
    keys, new = KEYS, view(spark, d, "predictions")
    old = view(spark, d, "ground_truth").join(new.select(*KEYS).distinct(), ["region", "grid_id"])
    edges = spatial.overlaps(old, new, keys).where("iou > 0.5").select(*keys, "gt_id", F.col("b_poly_id").alias("poly_id"), "iou")
    kept = graph.greedy_match(edges, keys, "gt_id", "poly_id", [F.col("gt_id"), -F.col("iou"), F.col("poly_id")]).select("poly_id", F.col("gt_id").alias("old_id"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("old_id").isNull(), "old_id", "poly_id"))
    return new.select(*keys, "poly_id").join(kept, "poly_id", "left").select(*keys, "poly_id", "old_id", place.alias("place"))


@query(f"""{_P}, {slab('u', 'predictions', 'region, grid_id, order_id')}, n AS (SELECT region, grid_id, order_id, count(*) AS num_parts, min(poly_id) AS first_id FROM predictions GROUP BY ALL)
SELECT region, grid_id, order_id, CAST(num_parts AS BIGINT) AS num_parts, union_area, concat(CAST(grid_id AS VARCHAR), '_', lpad(CAST(row_number() OVER (PARTITION BY region, grid_id ORDER BY first_id) AS VARCHAR), 5, '0')) AS installation_id FROM n JOIN u USING (region, grid_id, order_id)""")
def f19_merge_same_name(spark, d):
    """Parts of one order in a cell are one installation."""
    p, keys = view(spark, d, "predictions"), ["region", "grid_id", "order_id"]
    n = p.groupBy(*keys).agg(F.count("*").alias("num_parts"), F.min("poly_id").alias("first_id")).join(spatial.union_area(p, keys), keys)
    no = F.row_number().over(Window.partitionBy("region", "grid_id").orderBy("first_id")).cast("string")
    return n.select(*keys, "num_parts", "union_area", F.concat(F.col("grid_id").cast("string"), F.lit("_"), F.lpad(no, 5, "0")).alias("installation_id"))


@query(f"""{with_views('predictions', 'units')}, u AS (SELECT grid_id, count(*) AS n_units FROM units GROUP BY ALL), g AS (SELECT region, p.grid_id, count(*) AS n, avg(area) AS score FROM predictions p GROUP BY ALL),
s AS (SELECT g.*, coalesce(n_units, 0) AS n_units, CASE WHEN n < 590 THEN 'low' WHEN n < 610 THEN 'mid' ELSE 'high' END AS stratum FROM g LEFT JOIN u USING (grid_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY region, stratum ORDER BY score DESC, grid_id) <= 2 AS quota FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY region, quota ORDER BY score DESC, grid_id) AS k, count(*) FILTER (WHERE quota) OVER (PARTITION BY region) AS taken FROM r),
c AS (SELECT *, CASE WHEN quota THEN 'quota' WHEN k <= 8 - taken THEN 'fallback' END AS by_ FROM f), x AS (SELECT *, row_number() OVER (PARTITION BY region, by_ IS NULL ORDER BY n_units, grid_id) AS k2 FROM c)
SELECT region, stratum, grid_id, coalesce(by_, 'sparse') AS chosen_by FROM x WHERE by_ IS NOT NULL OR k2 <= 2""")
def j8_quota_fill(spark, d):
    """Two per stratum, then by score until eight of a region are chosen, then the two with the fewest buildings among the rest."""
    u = view(spark, d, "units").groupBy("grid_id").agg(F.count("*").alias("n_units"))
    g = view(spark, d, "predictions").groupBy("region", "grid_id").agg(F.count("*").alias("n"), F.avg("area").alias("score")).join(u, "grid_id", "left").na.fill(0, ["n_units"])
    s = g.withColumn("stratum", columns.bucket(F.col("n"), [590, 610], ["low", "mid", "high"]))
    return sampling.quota_fill(s, ["region"], "stratum", "grid_id", "score", 2, 8, ("n_units", 2)).select("region", "stratum", "grid_id", "chosen_by")


@query(f"""{with_views('predictions', 'task_grid')}, g AS (SELECT t.region, t.grid_id, gx, gy, CAST(sum(area) AS BIGINT) AS score FROM predictions p JOIN task_grid t USING (grid_id) GROUP BY ALL),
e AS (SELECT a.region, a.grid_id AS h, b.grid_id AS l, -a.score AS c FROM g a JOIN g b ON a.region = b.region AND a.grid_id <> b.grid_id AND abs(a.gx - b.gx) <= 2 AND abs(a.gy - b.gy) <= 2 WHERE a.score > b.score OR (a.score = b.score AND a.grid_id < b.grid_id)),
{loops.suppressed('gone', 'e', 'region', 'c')}, r AS (SELECT *, grid_id IN (SELECT id FROM gone) AS near FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY near, score DESC, grid_id) AS k FROM r)
SELECT region, grid_id, score, CASE WHEN near THEN 'fill' ELSE 'spaced' END AS chosen_by FROM k WHERE k <= 12""")
def j7_spaced_pick(spark, d):
    """Twelve cells of a region: by score, none within two steps of a chosen one; where these are too few, the best of the others."""
    score = view(spark, d, "predictions").groupBy("grid_id").agg(F.sum("area").alias("score"))
    g = view(spark, d, "task_grid").select("region", "grid_id", "gx", "gy").join(score, "grid_id")
    return sampling.spaced_pick(g, ["region"], "grid_id", "score", ("gx", "gy"), 2, 12).select("region", "grid_id", "score", "chosen_by")




@query(f"""{_P} SELECT poly_id, (x0 + grid_id % 40 * 3000) / 10.0E0 AS east, (y0 + grid_id // 40 * 3000) / 10.0E0 AS north, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS tier FROM predictions""")
def b4_b8_hint_layer(spark, d):
    """Corners in metres of the whole area, with a tier of confidence."""
    p, tier = view(spark, d, "predictions"), columns.bucket(F.col("confidence"), [0.7, 0.9], ["low", "medium", "high"])
    return p.select("poly_id", ((F.col("x0") + F.col("grid_id") % 40 * 3000) / 10).alias("east"), ((F.col("y0") + F.floor(F.col("grid_id") / 40) * 3000) / 10).alias("north"), tier.alias("tier"))


_TRUE, _FALSE = ("true", "1", "yes", "present", "pv"), ("false", "0", "no", "absent", "not_pv", "non_pv")


@query(f"""SELECT event_id, CASE WHEN t IN {_TRUE} THEN true WHEN t IN {_FALSE} THEN false END AS flag FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Yes' WHEN 1 THEN 'PV ' WHEN 2 THEN 'non_pv' WHEN 3 THEN '0' ELSE event_type END AS raw FROM events), LATERAL (SELECT lower(trim(raw)) AS t) x""")
def b14_tri_state(spark, d):
    k = F.col("event_id") % 7
    raw = F.when(k == 0, " Yes").when(k == 1, "PV ").when(k == 2, "non_pv").when(k == 3, "0").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", columns.tri_state(raw).alias("flag"))



@query(f"""{_P}, s AS (SELECT DISTINCT grid_id FROM predictions WHERE grid_id % 10 = 3 OR regexp_matches(CAST(grid_id AS VARCHAR), '^(1|7[0-4])')) SELECT grid_id, CAST(count(*) AS BIGINT) AS n FROM predictions WHERE grid_id NOT IN (SELECT grid_id FROM s) GROUP BY ALL""")
def d15_pattern_anti_join(spark, d):
    """Without the cells that a suite lists or whose name fits one of its patterns."""
    listed = view(spark, d, "task_grid").where("grid_id % 10 = 3")
    return joins.without_listed(view(spark, d, "predictions"), "grid_id", listed, ["^(1|7[0-4])"]).groupBy("grid_id").agg(F.count("*").alias("n"))


@query(f"""{_PG}, t AS (SELECT grid_id, CAST(regexp_extract(concat('cell_', CAST(grid_id AS VARCHAR), '_n', CAST(140 + grid_id % 20 AS VARCHAR), '.parquet'), '_n([0-9]+)', 1) AS BIGINT) AS declared, count(*) AS n FROM ground_truth GROUP BY ALL)
SELECT grid_id, declared, CAST(n AS BIGINT) AS n, CASE WHEN declared = n THEN 'yes' ELSE 'MISMATCH' END AS agrees FROM t""")
def n10_declared_count_check(spark, d):
    name = F.concat(F.lit("cell_"), F.col("grid_id").cast("string"), F.lit("_n"), (140 + F.col("grid_id") % 20).cast("string"), F.lit(".parquet"))
    t = view(spark, d, "ground_truth").groupBy("grid_id").agg(F.count("*").alias("n")).withColumn("declared", F.regexp_extract(name, "_n([0-9]+)", 1).cast("long"))
    return t.select("grid_id", "declared", "n", F.when(F.col("declared") == F.col("n"), "yes").otherwise("MISMATCH").alias("agrees"))


@query(f"""{with_views('decisions')}, l AS (SELECT grid_id, pred_id, arg_max(pv_present, event_id) FILTER (WHERE event_id = m) AS pv, max(confidence) FILTER (WHERE event_id = m) AS c FROM (SELECT *, max(event_id) OVER (PARTITION BY grid_id, pred_id) AS m FROM decisions) GROUP BY ALL)
SELECT grid_id, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE pv = false AND c >= 0.3) AS BIGINT) AS n_drop, CAST(count(*) FILTER (WHERE pv IS NULL OR (pv = false AND c < 0.3)) AS BIGINT) AS n_review, CAST(count(*) FILTER (WHERE pv) AS BIGINT) AS n_keep FROM l GROUP BY grid_id""")
def n3_apply_decisions(spark, d):
    """The last decision of each candidate; what is unsure goes to review, never away."""
    last = view(spark, d, "decisions").groupBy("grid_id", "pred_id").agg(F.max(F.struct("event_id", "pv_present", "confidence")).alias("m")).select("grid_id", F.col("m.pv_present").alias("pv"), F.col("m.confidence").alias("c"))
    sure = F.col("c") >= 0.3
    return last.groupBy("grid_id").agg(F.count("*").alias("n"), F.count_if(~F.col("pv") & sure).alias("n_drop"), F.count_if(F.col("pv").isNull() | (~F.col("pv") & ~sure)).alias("n_review"), F.count_if("pv").alias("n_keep"))
