"""Queries on rule cascades, review decisions, training pools and plans of grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rooftally.operators import columns, decisions, joins, ranks, sampling, spatial
from rooftally.plans.area import GR, KEYS, both
from rooftally.plans.registry import query
from rooftally.sources.views import RUNS, for_each_run, table, view, with_views

_P = with_views("predictions")
_TILE, _EDGE = 600, 50
_RUN = ["region", "model_run"]


def _size(c="area"):
    return columns.bucket(F.col(c), [4000, 10000], ["small", "medium", "large"])


_SIZE = "CASE WHEN area < 4000 THEN 'small' WHEN area < 10000 THEN 'medium' ELSE 'large' END"

_EDGES = f"""e AS (SELECT *, CAST(floor((x0 + x1) / 2) AS BIGINT) AS cx, CAST(floor((y0 + y1) / 2) AS BIGINT) AS cy FROM predictions),
f AS (SELECT *, cx % {_TILE} < {_EDGE} OR cx % {_TILE} >= {_TILE - _EDGE} OR cy % {_TILE} < {_EDGE} OR cy % {_TILE} >= {_TILE - _EDGE} AS at_edge, cx >= 3000 OR cy >= 3000 AS outside FROM e)"""


def edge_flags(p):
    """Whether the centre is near the edge of its tile, and whether it is outside of its cell."""
    p = p.withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2), "cy": F.floor((F.col("y0") + F.col("y1")) / 2)})
    near = [(F.col(c) % _TILE < _EDGE) | (F.col(c) % _TILE >= _TILE - _EDGE) for c in ("cx", "cy")]
    return p.withColumns({"at_edge": near[0] | near[1], "outside": (F.col("cx") >= 3000) | (F.col("cy") >= 3000)})


@query(f"{_P}, {_EDGES} SELECT poly_id, at_edge, outside FROM f")
def b19_tile_edge_flags(spark, d):
    return edge_flags(view(spark, d, "predictions")).select("poly_id", "at_edge", "outside")


_NEAR = "greatest(a.x0 - b.x1, b.x0 - a.x1, 0) * greatest(a.x0 - b.x1, b.x0 - a.x1, 0) + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) * greatest(a.y0 - b.y1, b.y0 - a.y1, 0)"


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, {_EDGES}, del AS (SELECT * FROM predictions WHERE review_status = 'delete'),
nc AS (SELECT a.poly_id, min({_NEAR}) AS dist2 FROM del a JOIN predictions b USING (region, model_run, grid_id) WHERE b.review_status = 'correct' AND {_NEAR} <= 3600 GROUP BY ALL),
ms AS (SELECT * FROM gr g WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.region = g.region AND p.model_run = g.model_run AND p.grid_id = g.grid_id AND p.x0 < g.x1 AND g.x0 < p.x1 AND p.y0 < g.y1 AND g.y0 < p.y1)),
fn AS (SELECT DISTINCT a.poly_id FROM del a JOIN ms b USING (region, model_run, grid_id) WHERE {_NEAR} <= 900),
tl AS (SELECT region, model_run, grid_id, (x0 + x1) // 2 // 600 AS ti, (y0 + y1) // 2 // 600 AS tj, bool_or(area >= 20000) AS large_tile, bool_or(review_status = 'edit') AS edited_tile FROM predictions GROUP BY ALL),
b AS (SELECT f.*, dist2, fn.poly_id IS NOT NULL AS missed, large_tile, edited_tile, CASE WHEN review_status = 'correct' THEN 'not_fp' WHEN second_score < 0.6 THEN 'segmentation_error' WHEN review_status = 'edit' THEN 'boundary_editable'
  WHEN outside OR (at_edge AND confidence < 0.85) THEN 'uncertain_postproc' ELSE 'true_fp' END AS fp_bucket
  FROM f LEFT JOIN nc USING (poly_id) LEFT JOIN fn USING (poly_id) JOIN tl ON tl.region = f.region AND tl.model_run = f.model_run AND tl.grid_id = f.grid_id AND ti = (x0 + x1) // 2 // 600 AND tj = (y0 + y1) // 2 // 600)
SELECT region, model_run, fp_bucket, CASE WHEN review_status <> 'delete' THEN 'not_applicable' WHEN fp_bucket = 'segmentation_error' THEN 'exclude_seg_error' WHEN outside THEN 'exclude_postproc_artifact' WHEN dist2 <= 3600 THEN 'exclude_near_true_panel'
WHEN large_tile THEN 'exclude_large_array_context' WHEN missed OR edited_tile THEN 'exclude_near_true_panel' ELSE 'safe_true_fp' END AS hn_safety, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""")
def b10_fp_bucket(spark, d):
    """Kinds of false positives, and whether they are safe negatives: by the nearest true panel, missed ones, and what else the tile holds."""
    g, p = both(spark, d)
    rows = edge_flags(p)
    tile = [F.floor(F.col(c) / _TILE).alias(t) for c, t in (("cx", "ti"), ("cy", "tj"))]
    held = rows.groupBy(*KEYS, *tile).agg(F.bool_or(F.col("area") >= 20000).alias("large_tile"), F.bool_or(F.col("review_status") == "edit").alias("edited_tile"))
    deleted, box = p.where("review_status = 'delete'").select(*KEYS, "poly_id", *spatial.BOX), [*KEYS, *spatial.BOX]
    true = spatial.near_boxes(deleted, p.where("review_status = 'correct'").select(*box), KEYS, decisions.NEAR_TRUE).groupBy("poly_id").agg(F.min("dist2").alias("true_dist2"))
    missed = g.select(*box, "gt_id").join(spatial.box_join(g.select(*box, "gt_id"), p.select(*box), KEYS).select(*KEYS, "gt_id").distinct(), [*KEYS, "gt_id"], "left_anti")
    near = spatial.near_boxes(deleted, missed.select(*box), KEYS, decisions.NEAR_MISSED).select("poly_id", F.lit(True).alias("missed_near")).distinct()
    rows = rows.select("*", *tile).join(held, [*KEYS, "ti", "tj"]).join(true, "poly_id", "left").join(near, "poly_id", "left")
    status, c = F.col("review_status"), F.col
    rows = rows.withColumn("fp_bucket", decisions.fp_bucket(status, c("second_score") < 0.6, c("outside"), c("at_edge"), c("confidence")))
    safety = decisions.hn_safety(status, c("fp_bucket"), c("outside"), c("true_dist2"), c("large_tile"), c("missed_near"), c("edited_tile"))
    return rows.groupBy(*_RUN, "fp_bucket", safety.alias("hn_safety")).agg(F.count("*").alias("n"))


_WEIGHTS = {"confidence": 0.5, "area": 0.3, "mean_r": -0.2}


def _share_sql(column: str, weight: float) -> str:
    order = f"{column} DESC" if weight < 0 else column
    ties = f"count(*) OVER (PARTITION BY region, model_run, {column})"
    return f"{abs(weight)} * (rank() OVER (PARTITION BY region, model_run ORDER BY {order}) + ({ties} - 1) / 2.0E0) / count(*) OVER (PARTITION BY region, model_run)"


@query(f"{_P} SELECT poly_id, round({' + '.join(_share_sql(c, w) for c, w in _WEIGHTS.items())}, 6) AS priority FROM predictions")
def b11_sample_priority(spark, d):
    """Weighted sum of average-rank shares; ranks come from counts per value, so no group is sorted row by row."""
    p = view(spark, d, "predictions").select(*_RUN, "poly_id", *_WEIGHTS)
    for c, w in _WEIGHTS.items():
        by_value, group = Window.partitionBy(*_RUN).orderBy(F.col(c).desc() if w < 0 else F.col(c)), Window.partitionBy(*_RUN)
        n = p.groupBy(*_RUN, c).agg(F.count("*").alias("n"))
        shares = n.select(*_RUN, c, ((F.sum("n").over(by_value) - F.col("n") + 1 + (F.col("n") - 1) / 2) / F.sum("n").over(group)).alias(f"share_{c}"))
        p = p.join(shares, [*_RUN, c])
    return p.select("poly_id", F.round(reduce(lambda a, b: a + b, [abs(w) * F.col(f"share_{c}") for c, w in _WEIGHTS.items()]), 6).alias("priority"))


_TRUST = {"reviewed": ("human_reviewed", True), "redrawn": ("human_drawn", True)}


@query(f"""{with_views('ground_truth')} SELECT region, CASE source WHEN 'reviewed' THEN 'human_reviewed' WHEN 'redrawn' THEN 'human_drawn' ELSE 'unknown' END AS label_source,
source IN ('reviewed', 'redrawn') AS trusted, CAST(count(*) AS BIGINT) AS n FROM ground_truth GROUP BY ALL""")
def b12_label_source(spark, d):
    """Provenance to class and trust; what isn't listed is untrusted."""
    dim = spark.createDataFrame([(k, *v) for k, v in _TRUST.items()], "source string, label_source string, trusted boolean")
    rows = view(spark, d, "ground_truth").join(F.broadcast(dim), "source", "left")
    return rows.groupBy("region", F.coalesce("label_source", F.lit("unknown")).alias("label_source"), F.coalesce("trusted", F.lit(False)).alias("trusted")).agg(F.count("*").alias("n"))


@query(f"""{_P} SELECT region, model_run, CAST(count(*) AS BIGINT) AS n_in, CAST(sum(CASE WHEN area > 20000 THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped, CAST(sum(CASE WHEN area <= 20000 THEN 1 ELSE 0 END) AS BIGINT) AS n_kept,
CAST(sum(CASE WHEN area <= 20000 THEN area ELSE 0 END) AS BIGINT) AS kept_area FROM predictions WHERE greatest(abs(x0), abs(y0), abs(x1), abs(y1)) <= 1000000 GROUP BY ALL""")
def c1_clean_metric(spark, d):
    fits = F.col("area") <= 20000
    p = view(spark, d, "predictions").where(F.greatest(*[F.abs(c) for c in spatial.BOX]) <= 1000000)
    return p.groupBy(*_RUN).agg(F.count("*").alias("n_in"), F.count_if(~fits).alias("n_dropped"), F.count_if(fits).alias("n_kept"), F.coalesce(F.sum(F.when(fits, F.col("area"))), F.lit(0)).alias("kept_area"))


@query(f"{_P} SELECT region, model_run, CAST(count(*) AS BIGINT) AS n FROM predictions WHERE coalesce(CASE WHEN review_status = 'edit' THEN NULL ELSE confidence END, second_score) >= 0.7 GROUP BY ALL")
def c6_score_gate(spark, d):
    score = F.coalesce(F.when(F.col("review_status") != "edit", F.col("confidence")), "second_score")
    return view(spark, d, "predictions").where(score >= 0.7).groupBy(*_RUN).agg(F.count("*").alias("n"))


_WINDOWS = "w AS (SELECT grid_id, grid_id % 5 * 600 AS wx, grid_id % 3 * 1000 AS wy FROM task_grid)"


@query(f"""{with_views('predictions', 'task_grid')}, {_WINDOWS} SELECT p.grid_id, poly_id, area FROM predictions p JOIN w USING (grid_id)
WHERE floor((x0 + x1) / 2) >= wx AND floor((x0 + x1) / 2) < wx + 1000 AND floor((y0 + y1) / 2) >= wy AND floor((y0 + y1) / 2) < wy + 1000""")
def c7_clip_to_window(spark, d):
    w = view(spark, d, "task_grid").select("grid_id", (F.col("grid_id") % 5 * 600).alias("wx"), (F.col("grid_id") % 3 * 1000).alias("wy"))
    cx, cy = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
    inside = (cx >= F.col("wx")) & (cx < F.col("wx") + 1000) & (cy >= F.col("wy")) & (cy < F.col("wy") + 1000)
    return view(spark, d, "predictions").join(w, "grid_id").where(inside).select("grid_id", "poly_id", "area")


@query(f"""{with_views('predictions', 'task_grid')}, w AS (SELECT grid_id, 750 * i AS wx FROM task_grid, (SELECT unnest([0, 1, 2, 3]) AS i))
SELECT w.grid_id, wx, CAST(sum((least(x1, wx + 750) - greatest(x0, wx)) * (y1 - y0)) AS BIGINT) AS cut_area, CAST(count(*) AS BIGINT) AS n FROM w JOIN predictions p ON w.grid_id = p.grid_id AND x0 < wx + 750 AND x1 > wx AND y0 < 4000 GROUP BY ALL""")
def d8_overlay_area(spark, d):
    cells = view(spark, d, "task_grid").select("grid_id", F.explode(F.array(*[F.lit(750 * i) for i in range(4)])).alias("wx"))
    cells = cells.select("grid_id", "wx", F.col("wx").alias("x0"), F.lit(-100).alias("y0"), (F.col("wx") + 750).alias("x1"), F.lit(4000).alias("y1"))
    p = view(spark, d, "predictions").select("grid_id", "poly_id", *spatial.BOX)
    return spatial.box_join(p, cells, ["grid_id"]).groupBy("grid_id", F.col("b_wx").alias("wx")).agg(F.sum("inter").alias("cut_area"), F.count("*").alias("n"))


@query(f"""{with_views('predictions', 'decisions')}, t AS (SELECT model_run, poly_id, grid_id, poly_id % 500 AS pred_id FROM predictions),
a AS (SELECT grid_id, pred_id, max(event_id) AS e1 FROM decisions WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT pred_id, max(event_id) AS e2 FROM decisions WHERE event_id % 3 = 0 GROUP BY ALL),
c AS (SELECT grid_id, max(event_id) AS e3 FROM decisions GROUP BY ALL)
SELECT model_run, poly_id, coalesce(e1, e2, e3) AS event_id, CASE WHEN e1 IS NOT NULL THEN 'candidate' WHEN e2 IS NOT NULL THEN 'image' WHEN e3 IS NOT NULL THEN 'grid' ELSE 'none' END AS matched_by
FROM t LEFT JOIN a USING (grid_id, pred_id) LEFT JOIN b USING (pred_id) LEFT JOIN c USING (grid_id)""")
def d11_decision_join(spark, d):
    """Last decision of the candidate, else of the image, else of the grid."""
    t = view(spark, d, "predictions").select("model_run", "poly_id", "grid_id", (F.col("poly_id") % 500).alias("pred_id"))
    levels = [("candidate", ["grid_id", "pred_id"], F.expr("event_id % 2 = 0")), ("image", ["pred_id"], F.expr("event_id % 3 = 0")), ("grid", ["grid_id"], F.lit(True))]
    return joins.decision_join(t, view(spark, d, "decisions"), levels, "event_id").select("model_run", "poly_id", "event_id", "matched_by")


@query(f"""{with_views('task_grid', 'units')}, a AS (SELECT grid_id, concat('L', CAST(grid_id % 60 AS VARCHAR)) AS old_id, CASE WHEN grid_id < 60 THEN 0 ELSE 1 END AS tier FROM task_grid)
SELECT old_id, min(grid_id) FILTER (WHERE tier = m) AS grid_id, m AS tier, count(*) > 1 AS ambiguous FROM (SELECT *, min(tier) OVER (PARTITION BY old_id) AS m FROM a) GROUP BY old_id, m""")
def d13_crosswalk(spark, d):
    """Old name to grid: the active namespace before the retired one; more than one candidate is flagged."""
    a = view(spark, d, "task_grid").select("grid_id", F.concat(F.lit("L"), F.col("grid_id") % 60).alias("old_id"), F.when(F.col("grid_id") < 60, 0).otherwise(1).alias("tier"))
    return joins.crosswalk(a, "old_id", "grid_id", "tier")


@query(f"""{with_views('task_grid')}, c AS (SELECT grid_id, layer, prio FROM task_grid, (VALUES ('aerial', 2, 3), ('satellite', 1, 2), ('archive', 3, 1)) v(layer, prio, m) WHERE (grid_id + m) % (m + 1) <> 0)
SELECT t.grid_id, coalesce(arg_min(layer, prio), 'none') AS layer, CAST(count(layer) AS BIGINT) AS n_layers FROM task_grid t LEFT JOIN c USING (grid_id) GROUP BY t.grid_id""")
def d14_resolve_imagery_layer(spark, d):
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(p).alias("prio"), F.lit(m).alias("m")) for n, p, m in (("aerial", 2, 3), ("satellite", 1, 2), ("archive", 3, 1))])
    grids = view(spark, d, "task_grid").select("grid_id")
    c = grids.withColumn("v", F.explode(layers)).select("grid_id", "v.*")
    return joins.resolve_layer(grids, c.where((F.col("grid_id") + F.col("m")) % (F.col("m") + 1) != 0), "grid_id", "layer", "prio")


@query(f"""{with_views('predictions', 'units')}, t AS (SELECT grid_id, model_run, CAST(sum(centiwatts) AS BIGINT) AS cw FROM units, (SELECT unnest({RUNS}) AS model_run) GROUP BY ALL), p AS (SELECT grid_id, model_run, CAST(sum(area) AS BIGINT) AS area FROM predictions WHERE confidence >= 0.7 GROUP BY ALL)
SELECT grid_id, model_run, coalesce(cw, 0) AS centiwatts, coalesce(area, 0) AS area, CASE WHEN cw IS NULL THEN 'predicted_only' WHEN area IS NULL THEN 'truth_only' ELSE 'both' END AS side FROM t FULL JOIN p USING (grid_id, model_run)""")
def d19_full_outer_units(spark, d):
    t = for_each_run(view(spark, d, "units").groupBy("grid_id").agg(F.sum("centiwatts").alias("centiwatts")))
    p = view(spark, d, "predictions").where("confidence >= 0.7").groupBy("grid_id", "model_run").agg(F.sum("area").alias("area"))
    return joins.both_sides(t, p, ["grid_id", "model_run"], "centiwatts", "area")


@query(f"""{with_views('ground_truth', 'task_grid')}, b AS (SELECT grid_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ground_truth GROUP BY ALL)
SELECT grid_id, x0 >= -10 AND y0 >= -10 AND x1 <= 3200 AND y1 <= 3200 AS inside, x0, y0, x1, y1 FROM b JOIN task_grid USING (grid_id)""")
def d20_gt_bounds_inside(spark, d):
    g = view(spark, d, "ground_truth").join(view(spark, d, "task_grid").select("grid_id"), "grid_id", "left_semi")
    return joins.bounds_inside(g, ["grid_id"], -10, 3200)


@query(f"""{with_views('predictions', 'units')}, h AS (SELECT grid_id, model_run, sum(centiwatts) AS cw FROM units, (SELECT unnest({RUNS}) AS model_run) GROUP BY ALL), p AS (SELECT DISTINCT grid_id, model_run FROM predictions WHERE confidence >= 0.95)
SELECT model_run, CAST(coalesce(sum(CASE WHEN p.grid_id IS NOT NULL THEN cw END), 0) AS BIGINT) AS covered, CAST(coalesce(sum(CASE WHEN p.grid_id IS NULL THEN cw END), 0) AS BIGINT) AS uncovered, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(p.grid_id) AS BIGINT) AS n_covered FROM h LEFT JOIN p USING (grid_id, model_run) GROUP BY model_run""")
def h40_kw_coverage(spark, d):
    h = for_each_run(view(spark, d, "units").groupBy("grid_id").agg(F.sum("centiwatts").alias("cw")))
    return joins.coverage_by(h, view(spark, d, "predictions").where("confidence >= 0.95"), ["grid_id", "model_run"], ["model_run"], "cw")



@query(f"""{with_views('ground_truth')} SELECT grid_id, CAST(count(*) AS BIGINT) AS n, round(median(area), 4) AS median_area, CAST(sum(area) AS BIGINT) AS total_area, CAST(count(*) FILTER (WHERE x0 < 0 OR y0 < 0) AS BIGINT) AS n_outside,
CASE WHEN count(*) <= 50 THEN 'sparse' WHEN count(*) <= 100 THEN 'medium' ELSE 'dense' END AS density FROM ground_truth GROUP BY grid_id""")
def h46_annotation_qa(spark, d):
    g = view(spark, d, "ground_truth").groupBy("grid_id").agg(F.count("*").alias("n"), F.round(F.percentile("area", F.lit(0.5)), 4).alias("median_area"), F.sum("area").alias("total_area"), F.count_if((F.col("x0") < 0) | (F.col("y0") < 0)).alias("n_outside"))
    return g.withColumn("density", columns.bucket(F.col("n"), [50, 100], ["sparse", "medium", "dense"], closed="right"))


@query(f"""{with_views('predictions', 'ground_truth')}, e AS (SELECT p.* FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM ground_truth g WHERE g.grid_id = p.grid_id AND g.area >= 38500)), g AS (SELECT model_run, grid_id, count(*) FILTER (WHERE confidence >= 0.9 AND area < 1500) AS n, coalesce(sum(area) FILTER (WHERE confidence >= 0.9 AND area < 1500), 0) AS area FROM e GROUP BY ALL)
SELECT model_run, CAST(count(*) AS BIGINT) AS n_grids, CAST(sum(n) AS BIGINT) AS n_fp, CAST(sum(area) AS BIGINT) AS fp_area, round(avg(CASE WHEN n = 0 THEN 1.0E0 ELSE 0.0E0 END), 6) AS share_zero FROM g GROUP BY model_run""")
def h49_empty_grid_probe(spark, d):
    """Predictions in grids without large ground truth count as false."""
    small = (F.col("confidence") >= 0.9) & (F.col("area") < 1500)
    p = view(spark, d, "predictions").join(view(spark, d, "ground_truth").where("area >= 38500").select("grid_id").distinct(), "grid_id", "left_anti")
    g = p.groupBy("model_run", "grid_id").agg(F.count_if(small).alias("n"), F.coalesce(F.sum(F.when(small, F.col("area"))), F.lit(0)).alias("area"))
    return g.groupBy("model_run").agg(F.count("*").alias("n_grids"), F.sum("n").alias("n_fp"), F.sum("area").alias("fp_area"), F.round(F.avg((F.col("n") == 0).cast("double")), 6).alias("share_zero"))


@query(f"""{_P}, r AS (SELECT *, row_number() OVER (PARTITION BY region, {_SIZE} ORDER BY second_score DESC, poly_id) AS k1, count(*) OVER (PARTITION BY region, {_SIZE}) AS n FROM predictions),
s AS (SELECT *, CASE WHEN k1 > 12 THEN row_number() OVER (PARTITION BY region, {_SIZE}, k1 > 12 ORDER BY sha2) END AS k2 FROM (SELECT *, concat(sha256(concat('42:', CAST(poly_id AS VARCHAR))), CAST(poly_id AS VARCHAR)) AS sha2 FROM r))
SELECT region, {_SIZE} AS size_class, poly_id, k1 <= 12 AS by_priority FROM s WHERE k1 <= 12 OR k2 <= 8""")
def j9_priority_plus_random(spark, d):
    """Per stratum of 20: 12 by priority, 8 by digest among the rest. Both ranks are bounded, so tasks keep a few rows each before the shuffle."""
    keys = ["region", "size_class"]
    p = view(spark, d, "predictions").withColumn("size_class", _size()).select(*keys, "poly_id", "second_score")
    w = Window.partitionBy(*keys)
    top = p.withColumn("k", F.row_number().over(w.orderBy(F.desc("second_score"), "poly_id"))).where("k <= 12")
    rest = p.join(top.select("poly_id"), "poly_id", "left_anti").withColumn("_d", sampling.digest("42", F.col("poly_id")))
    rest = rest.withColumn("k", F.row_number().over(w.orderBy("_d", "poly_id"))).where("k <= 8")
    return top.select(*keys, "poly_id", F.lit(True).alias("by_priority")).unionByName(rest.select(*keys, "poly_id", F.lit(False).alias("by_priority")))


@query(f"""{_P}, n AS (SELECT region, CAST(floor(count(*) FILTER (WHERE review_status = 'correct') * 0.5) AS BIGINT) AS quota FROM predictions GROUP BY region),
r AS (SELECT region, poly_id, row_number() OVER (PARTITION BY region ORDER BY sha256(concat('42:', CAST(poly_id AS VARCHAR))), poly_id) AS k FROM predictions WHERE review_status = 'delete')
SELECT region, poly_id, 'negative' AS kind FROM r JOIN n USING (region) WHERE k <= quota UNION ALL SELECT region, poly_id, 'positive' FROM predictions WHERE review_status = 'correct'""")
def j10_balance_negatives(spark, d):
    p = view(spark, d, "predictions").select("region", "poly_id", "review_status")
    quota = p.groupBy("region").agg(F.floor(F.count_if(F.col("review_status") == "correct") * 0.5).alias("quota"))
    negatives = p.where("review_status = 'delete'").withColumn("digest", sampling.digest("42", F.col("poly_id")))
    negatives = ranks.places(negatives, ["region"], [F.col("digest"), F.col("poly_id")]).join(quota, "region").where("place <= quota")
    return negatives.select("region", "poly_id", F.lit("negative").alias("kind")).unionByName(p.where("review_status = 'correct'").select("region", "poly_id", F.lit("positive").alias("kind")))


@query(f"{with_views('predictions', 'ground_truth')} SELECT region, grid_id, x0, y0, x1, y1, area, 'prediction' AS origin FROM predictions WHERE review_status = 'correct' UNION ALL SELECT region, grid_id, x0, y0, x1, y1, area, 'ground_truth' FROM ground_truth")
def k1_concat_common(spark, d):
    p, g = view(spark, d, "predictions").where("review_status = 'correct'"), view(spark, d, "ground_truth")
    common = [c for c in p.columns if c in g.columns]
    return p.select(*common, F.lit("prediction").alias("origin")).unionByName(g.select(*common, F.lit("ground_truth").alias("origin")))


@query(f"""{_P}, m AS (SELECT model_run, region, v.* FROM (SELECT model_run, region, count(*) AS n, min(area) AS least, max(area) AS most FROM predictions GROUP BY ALL), LATERAL (SELECT unnest(['n', 'least', 'most']) AS metric, unnest([n, least, most]) AS value) v)
SELECT coalesce(a.model_run, 'run_A') AS model_run, coalesce(a.region, b.region) AS region, coalesce(a.metric, b.metric) AS metric, b.value AS base, a.value AS value, a.value - b.value AS delta
FROM (SELECT * FROM m WHERE model_run <> 'run_A') a JOIN (SELECT * FROM m WHERE model_run = 'run_A') b ON a.region = b.region AND a.metric = b.metric WHERE a.value IS DISTINCT FROM b.value""")
def k3_run_diff(spark, d):
    """What differs between each run and the first, key by key."""
    m = view(spark, d, "predictions").groupBy(*_RUN).agg(F.count("*").alias("n"), F.min("area").alias("least"), F.max("area").alias("most")).unpivot(_RUN, ["n", "least", "most"], "metric", "value")
    base = m.where("model_run = 'run_A'").select("region", "metric", F.col("value").alias("base"))
    return m.where("model_run <> 'run_A'").join(base, ["region", "metric"]).where("not (value <=> base)").select("model_run", "region", "metric", "base", "value", (F.col("value") - F.col("base")).alias("delta"))


@query(f"""{with_views('predictions', 'ground_truth')} SELECT model_run, region, grid_id, poly_id AS item_id, 'correct' AS status, 'reviewed' AS origin FROM predictions WHERE review_status = 'correct'
UNION ALL SELECT NULL, region, grid_id, gt_id, 'correct', 'added' FROM ground_truth WHERE source = 'marked'""")
def k6_accepted_annotations(spark, d):
    p, g = (view(spark, d, v).withColumnRenamed(c, "item_id") for v, c in (("predictions", "poly_id"), ("ground_truth", "gt_id")))
    return joins.accepted([(p, F.col("review_status") == "correct", "reviewed"), (g, F.col("source") == "marked", "added")], ["model_run", "region", "grid_id", "item_id"])


@query(f"""{with_views('intervals')}, m AS (SELECT year(start_date + CAST(floor(date_diff('day', start_date, end_date) / 2) AS INTEGER)) AS year, month(start_date + CAST(floor(date_diff('day', start_date, end_date) / 2) AS INTEGER)) AS month FROM intervals WHERE date_status = 'dated')
SELECT CAST(year AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE month <= 6) AS BIGINT) AS first_half, CAST(count(*) FILTER (WHERE month > 6) AS BIGINT) AS second_half FROM m GROUP BY year""")
def l2_install_histogram(spark, d):
    middle = F.date_add("start_date", F.floor(F.datediff("end_date", "start_date") / 2).cast("int"))
    m = view(spark, d, "intervals").where("date_status = 'dated'").select(F.year(middle).alias("year"), F.month(middle).alias("month"))
    return m.groupBy("year").agg(F.count("*").alias("n"), F.count_if(F.col("month") <= 6).alias("first_half"), F.count_if(F.col("month") > 6).alias("second_half"))


@query(f"""{with_views('task_grid')}, c AS (SELECT *, CASE WHEN coverage_fraction < 0.2 THEN 'skip' WHEN coverage_fraction < 0.5 THEN 'aerial_needed' WHEN coverage_fraction < 0.9 THEN 'partial' ELSE 'full' END AS plan FROM task_grid)
SELECT grid_id, plan, CASE WHEN plan IN ('full', 'partial') THEN 'satellite' WHEN region = 'AFRICA' THEN 'aerial_1' WHEN gx < 20 THEN 'aerial_2' ELSE 'aerial_3' END AS primary_source,
CASE WHEN plan = 'aerial_needed' AND region = 'ASIA' AND gx < 20 THEN 'aerial_3' ELSE '' END AS fallback_source FROM c WHERE plan <> 'skip' AND (plan <> 'aerial_needed' OR region IN ('AFRICA', 'ASIA'))""")
def m3_imagery_plan(spark, d):
    region, plan = F.col("region"), columns.bucket(F.col("coverage_fraction"), [0.2, 0.5, 0.9], ["skip", "aerial_needed", "partial", "full"])
    c = view(spark, d, "task_grid").withColumn("plan", plan).where((F.col("plan") != "skip") & ((F.col("plan") != "aerial_needed") | region.isin("AFRICA", "ASIA")))
    primary = columns.first_match([(F.col("plan").isin("full", "partial"), "satellite"), (region == "AFRICA", "aerial_1"), (F.col("gx") < 20, "aerial_2")], "aerial_3")
    fallback = columns.first_match([((F.col("plan") == "aerial_needed") & (region == "ASIA") & (F.col("gx") < 20), "aerial_3")], "")
    return c.select("grid_id", "plan", primary.alias("primary_source"), fallback.alias("fallback_source"))


@query(f"""{with_views('task_grid')} SELECT grid_id, concat('C', lpad(CAST(grid_id AS VARCHAR), 6, '0')) AS new_id, coverage_fraction >= 0.5 AS kept, CASE WHEN coverage_fraction >= 0.5 THEN 'covered' WHEN coverage_fraction > 0 THEN 'below_threshold' ELSE 'no_coverage' END AS reason FROM task_grid""")
def m4_regrid_crosswalk(spark, d):
    c = F.col("coverage_fraction")
    reason = columns.first_match([(c >= 0.5, "covered"), (c > 0, "below_threshold")], "no_coverage")
    return view(spark, d, "task_grid").select("grid_id", F.concat(F.lit("C"), F.lpad(F.col("grid_id").cast("string"), 6, "0")).alias("new_id"), (c >= 0.5).alias("kept"), reason.alias("reason"))


@query(f"""{_P}, w AS (SELECT grid_id, CAST(least(floor(floor((x0 + x1) / 2) / 1000), 2) * 3 + least(floor(floor((y0 + y1) / 2) / 1000), 2) AS BIGINT) AS part, count(*) AS n FROM predictions GROUP BY ALL)
SELECT grid_id, CAST(count(*) AS BIGINT) AS n_parts, CAST(max(n) AS BIGINT) AS most, round(quantile_cont(n, 0.9), 4) AS p90 FROM w GROUP BY grid_id""")
def m5_subwindows(spark, d):
    third = lambda a, b: F.least(F.floor(F.floor((F.col(a) + F.col(b)) / 2) / 1000), F.lit(2))
    w = view(spark, d, "predictions").groupBy("grid_id", (third("x0", "x1") * 3 + third("y0", "y1")).alias("part")).agg(F.count("*").alias("n"))
    return w.groupBy("grid_id").agg(F.count("*").alias("n_parts"), F.max("n").alias("most"), F.round(F.percentile("n", F.lit(0.9)), 4).alias("p90"))


_CHIPS = "c AS (SELECT grid_id, i * 500 AS cx, j * 500 AS cy FROM task_grid, (SELECT unnest(range(7)) AS i), (SELECT unnest(range(7)) AS j))"
_CLIP = "greatest(x0, cx) AS ax, greatest(y0, cy) AS ay, least(x1, cx + 500) AS bx, least(y1, cy + 500) AS by_"


def _chips(spark, d):
    steps = F.sequence(F.lit(0), F.lit(3000), F.lit(500))
    c = view(spark, d, "task_grid").select("grid_id", F.explode(steps).alias("cx")).withColumn("cy", F.explode(steps))
    return c.select("grid_id", "cx", "cy", F.col("cx").alias("x0"), F.col("cy").alias("y0"), (F.col("cx") + 500).alias("x1"), (F.col("cy") + 500).alias("y1"))


def _chip_hits(spark, d):
    """Ground truth cut at the chips of its cell; pieces under 400 square decimetres go."""
    g = view(spark, d, "ground_truth").select("grid_id", "gt_id", *spatial.BOX, "source")
    return spatial.box_join(g, _chips(spark, d), ["grid_id"]).where("inter >= 400").withColumnsRenamed({"b_cx": "cx", "b_cy": "cy"})


@query(f"""{with_views('ground_truth', 'task_grid')}, {_CHIPS}, h AS (SELECT c.grid_id, cx, cy, gt_id, source, {_CLIP} FROM ground_truth g JOIN c ON g.grid_id = c.grid_id AND x0 < cx + 500 AND x1 > cx AND y0 < cy + 500 AND y1 > cy)
SELECT grid_id, cx, cy, gt_id, ax - cx AS left_, ay - cy AS top_, bx - ax AS width, by_ - ay AS height, (bx - ax) * (by_ - ay) AS area, source IN ('reviewed', 'redrawn') AS trusted FROM h WHERE (bx - ax) * (by_ - ay) >= 400""")
def m10_chip_annotations(spark, d):
    low, high = {c: F.greatest(f"{c}0", f"b_{c}0") for c in "xy"}, {c: F.least(f"{c}1", f"b_{c}1") for c in "xy"}
    return _chip_hits(spark, d).select(
        "grid_id", "cx", "cy", "gt_id", (low["x"] - F.col("cx")).alias("left_"), (low["y"] - F.col("cy")).alias("top_"),
        (high["x"] - low["x"]).alias("width"), (high["y"] - low["y"]).alias("height"), F.col("inter").alias("area"), F.col("source").isin(*_TRUST).alias("trusted"),
    )


@query(f"""{with_views('ground_truth', 'task_grid')}, {_CHIPS}, h AS (SELECT c.grid_id, cx, cy, gt_id, {_CLIP} FROM ground_truth g JOIN c ON g.grid_id = c.grid_id AND x0 < cx + 500 AND x1 > cx AND y0 < cy + 500 AND y1 > cy)
SELECT grid_id, cx, cy, CAST(count(*) AS BIGINT) AS n_hits, string_agg(CAST(gt_id AS VARCHAR), ',' ORDER BY gt_id) AS hits FROM h WHERE (bx - ax) * (by_ - ay) >= 400 GROUP BY ALL""")
def m18_positive_chips(spark, d):
    hits = F.array_join(F.transform(F.array_sort(F.collect_list("gt_id")), lambda x: x.cast("string")), ",")
    return _chip_hits(spark, d).groupBy("grid_id", "cx", "cy").agg(F.count("*").alias("n_hits"), hits.alias("hits"))


@query(f"""{with_views('predictions', 'ground_truth')} SELECT p.region, p.model_run, p.grid_id, poly_id, CAST(floor((x0 + x1) / 2) - 250 AS BIGINT) AS wx, CAST(floor((y0 + y1) / 2) - 250 AS BIGINT) AS wy FROM predictions p WHERE review_status = 'delete' AND NOT EXISTS
(SELECT 1 FROM predictions q WHERE q.region = p.region AND q.model_run = p.model_run AND q.grid_id = p.grid_id AND q.review_status = 'correct' AND q.x0 < floor((p.x0 + p.x1) / 2) + 250 AND q.x1 > floor((p.x0 + p.x1) / 2) - 250 AND q.y0 < floor((p.y0 + p.y1) / 2) + 250 AND q.y1 > floor((p.y0 + p.y1) / 2) - 250)""")
def m12_hn_candidates(spark, d):
    """Windows around false detections that no accepted one reaches into."""
    keys, p = ["region", "model_run", "grid_id"], view(spark, d, "predictions")
    w = p.where("review_status = 'delete'").select(*keys, "poly_id", (F.floor((F.col("x0") + F.col("x1")) / 2) - 250).alias("wx"), (F.floor((F.col("y0") + F.col("y1")) / 2) - 250).alias("wy"))
    boxes = w.withColumns({"x0": F.col("wx"), "y0": F.col("wy"), "x1": F.col("wx") + 500, "y1": F.col("wy") + 500})
    met = spatial.box_join(boxes, p.where("review_status = 'correct'").select(*keys, *spatial.BOX), keys)
    return w.join(met.select("poly_id").distinct(), "poly_id", "left_anti").select(*keys, "poly_id", "wx", "wy")


@query(f"""{with_views('predictions', 'ground_truth', 'decisions')}, l AS (SELECT grid_id, pred_id, event_id, pv_present, confidence, lookalike FROM (SELECT *, row_number() OVER (PARTITION BY grid_id, pred_id ORDER BY event_id DESC) AS k FROM decisions) WHERE k = 1),
c AS (SELECT p.poly_id, p.grid_id, p.model_run, l.pv_present, l.confidence, l.lookalike, p.x0, p.y0, p.x1, p.y1, p.area FROM predictions p JOIN l ON l.grid_id = p.grid_id AND l.pred_id = p.poly_id % 500),
o AS (SELECT poly_id, max((least(c.x1, g.x1) - greatest(c.x0, g.x0)) * (least(c.y1, g.y1) - greatest(c.y0, g.y0)) / CAST(c.area AS DOUBLE)) AS share FROM c JOIN ground_truth g ON g.grid_id = c.grid_id AND c.x0 < g.x1 AND g.x0 < c.x1 AND c.y0 < g.y1 AND g.y0 < c.y1 GROUP BY ALL),
t AS (SELECT c.*, coalesce(share, 0) AS share, c.grid_id IN (SELECT grid_id FROM ground_truth WHERE area >= 36000) AS has_truth, CASE WHEN lookalike = 'shadow' THEN 'skip_quality_shadow' WHEN confidence IS NULL THEN 'skip_missing_confidence' WHEN pv_present THEN CASE WHEN confidence >= 0.3 THEN 'weak_positive' ELSE 'skip_low_conf_positive' END
  WHEN NOT pv_present THEN CASE WHEN confidence >= 0.2 THEN 'hard_negative_candidate' ELSE 'skip_low_conf_negative' END ELSE 'skip_null_presence' END AS first_triage FROM c LEFT JOIN o USING (poly_id))
SELECT model_run, poly_id, round(share, 6) AS share, CASE WHEN first_triage = 'hard_negative_candidate' AND share > 0.1 THEN 'drop_hn_gt_overlap' WHEN first_triage = 'hard_negative_candidate' AND NOT has_truth THEN 'skip_hn_no_gt_available' ELSE first_triage END AS triage FROM t""")
def m14_weak_label_triage(spark, d):
    """What the last decision of each prediction is good for; hard negatives are looked at beside the ground truth of their cell, if it has any large enough to have been searched."""
    last = view(spark, d, "decisions").groupBy("grid_id", "pred_id").agg(F.max_by(F.struct("pv_present", "confidence", "lookalike"), "event_id").alias("m")).select("grid_id", "pred_id", "m.pv_present", "m.confidence", "m.lookalike")
    p = view(spark, d, "predictions").select("model_run", "grid_id", "poly_id", "area", *spatial.BOX).withColumn("pred_id", F.col("poly_id") % 500)
    g = view(spark, d, "ground_truth")
    share = spatial.overlaps(p.select("grid_id", "poly_id", "area", *spatial.BOX), g.select("grid_id", "area", *spatial.BOX), ["grid_id"]).groupBy("poly_id").agg(F.max("iof").alias("share"))
    searched = g.where("area >= 36000").select("grid_id", F.lit(True).alias("has_truth")).distinct()
    rows = p.join(last, ["grid_id", "pred_id"]).join(share, "poly_id", "left").join(searched, "grid_id", "left")
    triage = decisions.weak_label(F.col("pv_present"), F.col("confidence"), F.col("lookalike") == "shadow")
    return rows.select("model_run", "poly_id", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), decisions.truth_audit(triage, F.col("share"), F.col("has_truth")).alias("triage"))


@query(f"""{with_views('predictions', 'units')}, v AS (SELECT poly_id, customer_type, count(*) AS n FROM predictions p JOIN units u ON p.grid_id = u.grid_id AND greatest(x0 - x, x - x1, 0) * greatest(x0 - x, x - x1, 0) + greatest(y0 - y, y - y1, 0) * greatest(y0 - y, y - y1, 0) <= 40000 GROUP BY ALL)
SELECT model_run, p.poly_id, coalesce(arg_min(customer_type, (-n, customer_type)) FILTER (WHERE n IS NOT NULL), 'residential') AS land_use FROM predictions p LEFT JOIN v USING (poly_id) GROUP BY model_run, p.poly_id""")
def m16_land_use_vote(spark, d):
    """The commonest class of units near a box, the first by name among equals; residential where none is near."""
    p = view(spark, d, "predictions").select("model_run", "grid_id", "poly_id", *spatial.BOX)
    return joins.vote_near(p, view(spark, d, "units"), ["grid_id"], "poly_id", "customer_type", 200, "residential").select("model_run", "poly_id", F.col("vote").alias("land_use"))


@query(f"""{with_views('ground_truth')} SELECT grid_id, gt_id AS source_id, concat(CAST(grid_id AS VARCHAR), '_', lpad(CAST(row_number() OVER (PARTITION BY grid_id ORDER BY gt_id) AS VARCHAR), 3, '0')) AS annotation_id, 'default' AS tier FROM ground_truth WHERE area <= 25000 AND x0 >= 0 AND y0 >= 0""")
def m17_annotation_manifest(spark, d):
    k = F.row_number().over(Window.partitionBy("grid_id").orderBy("gt_id"))
    g = view(spark, d, "ground_truth").where("area <= 25000 and x0 >= 0 and y0 >= 0").withColumn("k", k.cast("string"))
    return g.select("grid_id", F.col("gt_id").alias("source_id"), F.concat(F.col("grid_id").cast("string"), F.lit("_"), F.lpad("k", 3, "0")).alias("annotation_id"), F.lit("default").alias("tier"))


@query(f"""{with_views('decisions')}, s AS (SELECT event_id, pred_id, pv_present, lookalike, pred_id % 3 = 0 AS labelled_pv FROM decisions WHERE pv_present IS NOT NULL)
SELECT CASE WHEN pv_present THEN 'flip' ELSE 'drop' END AS kind, CASE WHEN pv_present AND labelled_pv THEN 'correct_save' WHEN pv_present THEN 'wrong_restore' WHEN labelled_pv THEN 'tp_loss' ELSE 'correct_cut' END AS verdict, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT pred_id) AS BIGINT) AS n_preds FROM s GROUP BY ALL""")
def n4_flip_drop_audit(spark, d):
    pv, label = F.col("pv_present"), F.col("pred_id") % 3 == 0
    verdict = columns.first_match([(pv & label, "correct_save"), (pv, "wrong_restore"), (label, "tp_loss")], "correct_cut")
    return view(spark, d, "decisions").where("pv_present is not null").groupBy(columns.first_match([(pv, "flip")], "drop").alias("kind"), verdict.alias("verdict")).agg(F.count("*").alias("n"), F.countDistinct("pred_id").alias("n_preds"))


@query(f"""{with_views('decisions')}, r AS (SELECT event_id, concat_ws(',', CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END, CASE WHEN pv_present AND lookalike IS NOT NULL THEN 'lookalike_on_positive' END, CASE WHEN NOT pv_present AND lookalike IS NULL THEN 'lookalike_missing' END) AS reasons FROM decisions) SELECT * FROM r WHERE reasons <> ''""")
def n5_audit_schema_violations(spark, d):
    rules = [(~F.col("confidence").between(0, 1), "confidence_range"), (F.col("pv_present") & F.col("lookalike").isNotNull(), "lookalike_on_positive"), (~F.col("pv_present") & F.col("lookalike").isNull(), "lookalike_missing")]
    return view(spark, d, "decisions").select("event_id", F.concat_ws(",", *[F.when(c, F.lit(x)) for c, x in rules]).alias("reasons")).where("reasons <> ''")


@query(f"""{with_views('negative_pool', 'task_grid')} SELECT chip_id, CASE WHEN t.grid_id IS NULL THEN 'unknown_grid' WHEN p.region <> t.region THEN 'region_mismatch' ELSE 'bad_level' END AS problem
FROM negative_pool p LEFT JOIN task_grid t USING (grid_id) WHERE t.grid_id IS NULL OR p.region <> t.region OR archetype_confidence NOT IN ('A1', 'A2', 'A3')""")
def n6_registry_violations(spark, d):
    t = view(spark, d, "task_grid").select("grid_id", F.col("region").alias("known"))
    problem = columns.first_match([(F.col("known").isNull(), "unknown_grid"), (F.col("region") != F.col("known"), "region_mismatch"), (~F.col("archetype_confidence").isin("A1", "A2", "A3"), "bad_level")], None)
    return view(spark, d, "negative_pool").join(t, "grid_id", "left").select("chip_id", problem.alias("problem")).where("problem is not null")


@query(f"""{with_views('decisions', 'negative_pool')}, a AS (SELECT grid_id, pred_id, bool_and(NOT coalesce(pv_present, true)) FILTER (WHERE event_id % 2 = 0) AS first_says, bool_and(NOT coalesce(pv_present, true)) FILTER (WHERE event_id % 2 = 1) AS second_says FROM decisions GROUP BY ALL)
SELECT grid_id, pred_id, CASE WHEN first_says IS NULL OR second_says IS NULL THEN 'one_reviewer' WHEN first_says AND second_says THEN 'admit' WHEN first_says OR second_says THEN 'disagree' ELSE 'positive' END AS outcome FROM a""")
def n8_pool_ingest_agreement(spark, d):
    return decisions.agreement(view(spark, d, "decisions"), ["grid_id", "pred_id"], F.col("event_id") % 2 == 1, F.col("pv_present"))


@query(f"""{with_views('negative_pool')}, f AS (SELECT p.*, CASE WHEN p_size > 10 THEN concat('BOX ', p_name) END AS found FROM negative_pool p JOIN part ON CAST(p_partkey AS VARCHAR) = chip_id)
SELECT chip_id, coalesce(nullif(trim(bbox_geo), ''), found, '') AS bbox_geo, CASE WHEN trim(bbox_geo) <> '' THEN 'present' WHEN found IS NOT NULL THEN 'filled' ELSE 'no_match' END AS status,
coalesce(nullif(training_eligible, ''), CASE WHEN region = 'ASIA' THEN 'false' ELSE 'true' END) AS training_eligible FROM f""")
def n9_backfill_geometry(spark, d):
    """Fills blanks only; what is there stays."""
    found = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("chip_id"), F.concat(F.lit("BOX "), "p_name").alias("found"))
    blank = F.trim("bbox_geo") == ""
    status = columns.first_match([(~blank, "present"), (F.col("found").isNotNull(), "filled")], "no_match")
    eligible = F.coalesce(F.nullif("training_eligible", F.lit("")), F.when(F.col("region") == "ASIA", "false").otherwise("true"))
    return view(spark, d, "negative_pool").join(found, "chip_id", "left").select("chip_id", F.when(blank, F.coalesce("found", F.lit(""))).otherwise(F.trim("bbox_geo")).alias("bbox_geo"), status.alias("status"), eligible.alias("training_eligible"))


@query(f"""{_P}, c AS (SELECT poly_id, grid_id, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, model_run FROM predictions)
SELECT model_run, poly_id, CAST((cx // 600) * 5 + (cy // 600) AS BIGINT) AS tile FROM c WHERE cx < 3000 AND cy < 3000""")
def c15_reviewable_only(spark, d):
    """Boxes whose centre lies in a tile, with the tile's number."""
    p = view(spark, d, "predictions").withColumns({"cx": F.floor((F.col("x0") + F.col("x1")) / 2), "cy": F.floor((F.col("y0") + F.col("y1")) / 2)})
    return p.where("cx < 3000 and cy < 3000").select("model_run", "poly_id", (F.floor(F.col("cx") / _TILE) * 5 + F.floor(F.col("cy") / _TILE)).alias("tile"))


@query(f"""{with_views('task_grid')}, r AS (SELECT gx, gy FROM task_grid WHERE grid_id % 17 = 0), b AS (SELECT grid_id, gx, gy FROM task_grid WHERE grid_id % 17 <> 0)
SELECT grid_id, CAST(min((b.gx - r.gx) * (b.gx - r.gx) + (b.gy - r.gy) * (b.gy - r.gy)) AS BIGINT) AS dist2, min(greatest(abs(b.gx - r.gx), abs(b.gy - r.gy))) <= 1 AS touches FROM b, r
WHERE greatest(abs(b.gx - r.gx), abs(b.gy - r.gy)) <= 3 GROUP BY grid_id""")
def d17_overlap_audit(spark, d):
    """Cells within three steps of a reserved one: the distance, and whether they touch it."""
    t = view(spark, d, "task_grid").select("grid_id", "gx", "gy")
    box = lambda df: df.withColumns({"x0": F.col("gx"), "y0": F.col("gy"), "x1": F.col("gx"), "y1": F.col("gy")})
    pairs = spatial.box_join(box(t.where("grid_id % 17 <> 0")), box(t.where("grid_id % 17 = 0")), [], margin=3, closed=True, size=8)
    dx, dy = F.abs(F.col("gx") - F.col("b_gx")), F.abs(F.col("gy") - F.col("b_gy"))
    return pairs.groupBy("grid_id").agg(F.min(dx * dx + dy * dy).cast("long").alias("dist2"), (F.min(F.greatest(dx, dy)) <= 1).alias("touches"))


@query(f"""{with_views('predictions', 'ground_truth')}, p AS (SELECT model_run, grid_id, count(*) FILTER (WHERE review_status = 'correct') AS tp, count(*) FILTER (WHERE review_status = 'delete') AS fp FROM predictions GROUP BY ALL), g AS (SELECT grid_id, count(*) AS n_gt FROM ground_truth WHERE area > 12000 GROUP BY ALL)
SELECT model_run, CASE WHEN n_gt IS NULL THEN 'no_gt' WHEN tp > n_gt * 4 THEN 'invalid' WHEN grid_id % 4 = 0 THEN 'legacy' ELSE 'configured' END AS class, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM p LEFT JOIN g USING (grid_id) GROUP BY ALL""")
def h17_metrics_tracker(spark, d):
    """Classes of evaluated cells; rows without a hit stay."""
    p = view(spark, d, "predictions").groupBy("model_run", "grid_id").agg(F.count_if(F.col("review_status") == "correct").alias("tp"), F.count_if(F.col("review_status") == "delete").alias("fp"))
    g = view(spark, d, "ground_truth").where("area > 12000").groupBy("grid_id").agg(F.count("*").alias("n_gt"))
    kind = columns.first_match([(F.col("n_gt").isNull(), "no_gt"), (F.col("tp") > F.col("n_gt") * 4, "invalid"), (F.col("grid_id") % 4 == 0, "legacy")], "configured")
    return p.join(g, "grid_id", "left").groupBy("model_run", kind.alias("class")).agg(F.count("*").alias("n_rows"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


@query(f"""{with_views('ground_truth', 'task_grid')}, q AS (SELECT grid_id, source, count(*) AS n FROM ground_truth GROUP BY ALL), b AS (SELECT grid_id, arg_max(source, (n, source)) AS source, max(n) AS n FROM q GROUP BY grid_id)
SELECT t.grid_id, coalesce(b.source, 'none') AS source, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN n IS NULL THEN 'zero_gt' WHEN n >= 60 THEN 'richest' ELSE 'only' END AS action FROM task_grid t LEFT JOIN b USING (grid_id)""")
def a13_ingest_annotations(spark, d):
    """The richest source of each cell; cells without one stay with zero."""
    q = view(spark, d, "ground_truth").groupBy("grid_id", "source").agg(F.count("*").alias("n"))
    b = q.groupBy("grid_id").agg(F.max(F.struct("n", "source")).alias("m")).select("grid_id", "m.source", "m.n")
    action = columns.first_match([(F.col("n").isNull(), "zero_gt"), (F.col("n") >= 60, "richest")], "only")
    return view(spark, d, "task_grid").select("grid_id").join(b, "grid_id", "left").select("grid_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("n", F.lit(0)).alias("n"), action.alias("action"))


@query(f"""{with_views('predictions', 'ground_truth', 'negative_pool')}, a AS (SELECT region, grid_id, gt_id AS item_id, source AS provenance, 1 AS prio FROM ground_truth UNION ALL SELECT region, grid_id, poly_id, 'prediction', 2 FROM predictions WHERE review_status = 'correct'),
b AS (SELECT *, min(prio) OVER (PARTITION BY region, grid_id, item_id) AS best FROM a), n AS (SELECT DISTINCT grid_id FROM negative_pool WHERE archetype = 'ECONOMY')
SELECT b.item_id, b.grid_id, provenance, CASE provenance WHEN 'reviewed' THEN 'trusted' WHEN 'redrawn' THEN 'trusted' ELSE 'untrusted' END AS trust, n.grid_id IS NOT NULL AS shares_cell FROM b LEFT JOIN n USING (grid_id) WHERE prio = best""")
def m13_training_pool_manifest(spark, d):
    """Every annotation once, the first source before the second, with its trust and whether the negative pool uses its cell."""
    g = view(spark, d, "ground_truth").select("region", "grid_id", F.col("gt_id").alias("item_id"), F.col("source").alias("provenance"))
    p = view(spark, d, "predictions").where("review_status = 'correct'").select("region", "grid_id", F.col("poly_id").alias("item_id"), F.lit("prediction").alias("provenance"))
    return joins.pool_manifest([g, p], ["region", "grid_id"], "item_id", "provenance", list(_TRUST), view(spark, d, "negative_pool").where("archetype = 'ECONOMY'"), "grid_id")


@query(f"""{_P}, v AS (SELECT * FROM predictions WHERE grid_id % 5 = 0), t AS (SELECT region, grid_id, count(*) AS n FROM predictions WHERE grid_id % 5 <> 0 AND review_status <> 'delete' GROUP BY ALL)
SELECT region, grid_id, CAST(n AS BIGINT) AS n, 'train' AS split FROM t UNION ALL SELECT region, grid_id, CAST(count(*) AS BIGINT), 'val' FROM v GROUP BY ALL""")
def c10_split_selection(spark, d):
    """Held-out cells keep all; training cells leave out what reviewers deleted."""
    held = F.col("grid_id") % 5 == 0
    p = view(spark, d, "predictions").where(held | (F.col("review_status") != "delete"))
    return p.groupBy("region", "grid_id", F.when(held, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"))
