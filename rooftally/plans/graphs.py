"""Queries on joins of boxes and points, matching, suppression, merging and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators import graph, matching, spatial, stats
from rooftally.operators.matching import ratio
from rooftally.plans.area import GR, KEYS, PAIRS, TILES, both, slab, tiles
from rooftally.plans import loops
from rooftally.plans.registry import query
from rooftally.sources.views import view, with_views

_K = "region, model_run, grid_id"
CALIBERS = [0.1, 0.2, 0.3, 0.5, 0.7]
_PG = f"{with_views('predictions', 'ground_truth')}, {GR}, {PAIRS}"
_IOU = "inter / CAST(gt_area + pred_area - inter AS DOUBLE)"
#: Pairs of predictions of one run and grid, each once.
_SELF = f"""{with_views('predictions')}, self AS (SELECT a.region, a.model_run, a.grid_id, a.poly_id, b.poly_id AS b_poly_id, a.area, b.area AS b_area, a.confidence, b.confidence AS b_confidence,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter
  FROM predictions a JOIN predictions b USING ({_K}) WHERE a.poly_id < b.poly_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""
_STRICT = "iou DESC, gt_id, poly_id"
_SIOU = "inter / CAST(area + b_area - inter AS DOUBLE)"


@query(f"{_PG} SELECT {_K}, gt_id, poly_id, inter, round({_IOU}, 6) AS iou, round(inter / CAST(gt_area AS DOUBLE), 6) AS iof, round(inter / CAST(pred_area AS DOUBLE), 6) AS cover FROM pairs")
def d2_pair_overlap(spark, d):
    g, p = both(spark, d)
    return spatial.overlaps(g, p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS).select(*KEYS, "gt_id", F.col("b_poly_id").alias("poly_id"), "inter", *[F.round(c, 6).alias(c) for c in ("iou", "iof", "cover")])


@query(f"{_PG} SELECT {_K}, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(inter) AS BIGINT) AS inter FROM pairs GROUP BY {_K}")
def d1_spatial_join(spark, d):
    g, p = both(spark, d)
    return spatial.box_join(g, p.select(*KEYS, *spatial.BOX), KEYS).groupBy(*KEYS).agg(F.count("*").alias("n_pairs"), F.sum("inter").alias("inter"))


def _deleted(spark, d):
    return view(spark, d, "predictions").where("review_status = 'delete'").select("grid_id", "poly_id", *spatial.BOX)


_DEL = "del AS (SELECT grid_id, poly_id, x0, y0, x1, y1 FROM predictions WHERE review_status = 'delete')"


@query(f"{with_views('predictions', 'markers')}, {_DEL} SELECT m.grid_id, marker_id, poly_id FROM markers m JOIN del USING (grid_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def d3_points_within(spark, d):
    return spatial.points_within(view(spark, d, "markers").select("grid_id", "marker_id", "x", "y"), _deleted(spark, d), ["grid_id"]).select("grid_id", "marker_id", F.col("b_poly_id").alias("poly_id"))


_DIST = "greatest(x0 - x, x - x1, 0) * greatest(x0 - x, x - x1, 0) + greatest(y0 - y, y - y1, 0) * greatest(y0 - y, y - y1, 0)"


@query(f"{with_views('predictions', 'markers')}, {_DEL} SELECT m.grid_id, marker_id, poly_id, CAST({_DIST} AS BIGINT) AS dist2 FROM markers m JOIN del USING (grid_id) WHERE {_DIST} <= 2500")
def d4_buffered_join(spark, d):
    return spatial.points_within(view(spark, d, "markers").select("grid_id", "marker_id", "x", "y"), _deleted(spark, d), ["grid_id"], margin=50).select("grid_id", "marker_id", F.col("b_poly_id").alias("poly_id"), "dist2")


@query(f"""{with_views('predictions')} SELECT a.region, a.model_run, a.grid_id, a.poly_id, b.poly_id AS near_id,
  CAST(pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2) AS BIGINT) AS dist2
  FROM predictions a JOIN predictions b USING ({_K}) WHERE a.poly_id < b.poly_id AND pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2) <= 25""")
def d5_distance_join(spark, d):
    p = view(spark, d, "predictions").select(*KEYS, "poly_id", *spatial.BOX)
    return spatial.near_boxes(p, p, KEYS, 5).where("poly_id < b_poly_id").select(*KEYS, "poly_id", F.col("b_poly_id").alias("near_id"), "dist2")


_SAMPLED = "CAST(floor((x0 + x1) / 2) AS BIGINT) AS x, CAST(floor((y0 + y1) / 2) AS BIGINT) AS y"


def _centres(spark, d, status):
    p = view(spark, d, "predictions").where(F.col("review_status") == status)
    return p.select(*KEYS, "poly_id", F.floor((F.col("x0") + F.col("x1")) / 2).alias("x"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("y"))


@query(f"""{with_views('predictions')}, a AS (SELECT {_K}, poly_id, {_SAMPLED} FROM predictions WHERE review_status = 'delete'), b AS (SELECT {_K}, poly_id AS target, {_SAMPLED} FROM predictions WHERE review_status = 'correct')
SELECT a.region, a.model_run, a.grid_id, a.poly_id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist2,
  arg_min(b.target, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.target)) FILTER (WHERE b.target IS NOT NULL) AS target FROM a LEFT JOIN b USING ({_K}) GROUP BY ALL""")
def d6_nearest(spark, d):
    return spatial.nearest(_centres(spark, d, "delete"), _centres(spark, d, "correct").withColumnRenamed("poly_id", "target_id"), KEYS, "poly_id", "target_id").select(*KEYS, "poly_id", "dist2", "target")


@query(f"""{with_views('predictions')}, a AS (SELECT {_K}, poly_id, {_SAMPLED} FROM predictions WHERE review_status = 'correct')
SELECT a.region, a.model_run, a.grid_id, a.poly_id, CAST(count(*) - 1 AS BIGINT) AS n_near FROM a JOIN a b USING ({_K}) WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 160000 GROUP BY ALL""")
def d7_neighbour_count(spark, d):
    return spatial.neighbour_counts(_centres(spark, d, "correct"), KEYS, "poly_id", 400)


@query(f"""{with_views('predictions', 'task_grid')}, {TILES}
SELECT p.model_run, p.grid_id, p.poly_id, min(t.tile) AS tile FROM predictions p JOIN tiles t ON p.grid_id = t.grid_id AND floor((p.x0 + p.x1) / 2) >= t.x0 AND floor((p.x0 + p.x1) / 2) < t.x1 AND floor((p.y0 + p.y1) / 2) >= t.y0 AND floor((p.y0 + p.y1) / 2) < t.y1 GROUP BY ALL""")
def d10_assign_tile_centroid(spark, d):
    p = view(spark, d, "predictions").select("model_run", "grid_id", "poly_id", F.floor((F.col("x0") + F.col("x1")) / 2).alias("x"), F.floor((F.col("y0") + F.col("y1")) / 2).alias("y"))
    met = spatial.points_within(p, tiles(spark, d), ["grid_id"]).where("x >= b_x0 and x < b_x1 and y >= b_y0 and y < b_y1")
    return met.groupBy("model_run", "grid_id", "poly_id").agg(F.min("b_tile").alias("tile"))


@query(f"""{with_views('predictions', 'task_grid')}, {TILES} SELECT p.model_run, p.grid_id, p.poly_id, t.tile FROM predictions p JOIN tiles t ON p.grid_id = t.grid_id AND p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1""")
def d10_assign_tile_intersects(spark, d):
    """Every tile that a box shares an area with."""
    p = view(spark, d, "predictions").select("model_run", "grid_id", "poly_id", *spatial.BOX)
    return spatial.box_join(p, tiles(spark, d), ["grid_id"], size=750).select("model_run", "grid_id", "poly_id", F.col("b_tile").alias("tile"))


@query(f"""{_PG}, e AS (SELECT *, {_IOU} AS iou FROM pairs WHERE {_IOU} >= 0.3), {loops.pick_pairs('m', 'e', _K, _STRICT)} SELECT {_K}, gt_id, poly_id, round(iou, 6) AS iou FROM m""")
def f1_match_strict(spark, d):
    g, p = both(spark, d)
    return matching.match_strict(g, p, KEYS, 0.3).select(*KEYS, "gt_id", "poly_id", F.round("iou", 6).alias("iou"))


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, {loops.pick_groups('m', 'gr', 'predictions', _K, 0.3)}, {loops.counted('c', 'gr', 'predictions', _K, 'm', 'm_hit')} SELECT * FROM c""")
def f2_match_merge(spark, d):
    g, p = both(spark, d)
    accepted, hit = matching.match_merged(g, p, KEYS, 0.3)
    return matching.counts(g, p, KEYS, accepted, hit)


@query(f"""{_PG}, e AS (SELECT *, {_IOU} AS iou FROM pairs WHERE {_IOU} >= 0.5), {loops.pick_pairs('m', 'e', _K, 'confidence DESC, poly_id, iou DESC, gt_id')} SELECT {_K}, gt_id, poly_id, round(iou, 6) AS iou FROM m""")
def f3_match_by_confidence(spark, d):
    g, p = both(spark, d)
    return matching.match_by_confidence(g, p, KEYS, 0.5).select(*KEYS, "gt_id", "poly_id", F.round("iou", 6).alias("iou"))


@query(f"""{_PG}, m AS (SELECT {_K}, gt_id, max({_IOU}) AS best_iou, arg_min(poly_id, (-({_IOU}), poly_id)) AS best_poly_id, max(inter / CAST(pred_area AS DOUBLE)) AS best_cover, sum(inter) AS inter_sum, count(*) AS n_hits FROM pairs GROUP BY {_K}, gt_id)
SELECT {_K}, gt_id, round(best_iou, 6) AS best_iou, best_poly_id, round(best_cover, 6) AS best_cover, CAST(inter_sum AS BIGINT) AS inter_sum, CAST(n_hits AS BIGINT) AS n_hits FROM gr LEFT JOIN m USING ({_K}, gt_id)""")
def f4_best_match(spark, d):
    g, p = both(spark, d)
    best = matching.best_match(g, p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS, "gt_id", "poly_id")
    return best.select(*KEYS, "gt_id", F.round("best_iou", 6).alias("best_iou"), "best_poly_id", F.round("best_cover", 6).alias("best_cover"), "inter_sum", "n_hits")


@query(f"""{_SELF}, e AS (SELECT {_K}, CASE WHEN confidence >= b_confidence THEN poly_id ELSE b_poly_id END AS h, CASE WHEN confidence >= b_confidence THEN b_poly_id ELSE poly_id END AS l, -greatest(confidence, b_confidence) AS c FROM self WHERE {_SIOU} > 0.1),
{loops.suppressed('gone', 'e', _K, 'c')} SELECT {_K}, poly_id, confidence FROM predictions WHERE poly_id NOT IN (SELECT id FROM gone)""")
def f5_nms_score(spark, d):
    return matching.nms_score(view(spark, d, "predictions"), KEYS, 0.1).select(*KEYS, "poly_id", "confidence")


@query(f"""{_SELF}, e AS (SELECT {_K}, poly_id AS i, b_poly_id AS j, area >= b_area AS larger FROM self WHERE {_SIOU} > 0.1), {loops.larger_stays('gone', 'e', _K)} SELECT {_K}, poly_id, area FROM predictions WHERE poly_id NOT IN (SELECT id FROM gone)""")
def f6_nms_area(spark, d):
    return matching.nms_area(view(spark, d, "predictions"), KEYS, 0.1).select(*KEYS, "poly_id", "area")


#: Components by the smallest member, for the SQL that checks them.
_COMP = f"""e AS (SELECT poly_id AS a, b_poly_id AS b FROM self WHERE RULE UNION SELECT b_poly_id, poly_id FROM self WHERE RULE),
reach AS (SELECT a AS node, a AS seen FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM reach r JOIN e ON r.seen = e.a),
lab AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_RSELF = _SELF.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_RSELF}, {_COMP.replace('RULE', f'{_SIOU} > 0.1')} SELECT poly_id, coalesce(component, poly_id) AS component FROM predictions LEFT JOIN lab ON poly_id = node")
def f8_connected_components(spark, d):
    p = view(spark, d, "predictions")
    pairs = matching.conflicts(p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS, 0.1)
    return graph.with_component(p.select("poly_id"), pairs, "poly_id", "poly_id", "b_poly_id")


_MERGE = """, t AS (SELECT p.*, coalesce(component, poly_id) AS component FROM predictions p LEFT JOIN lab ON poly_id = node), SLAB
SELECT region, model_run, grid_id, component, CAST(count(*) AS BIGINT) AS n_merged, max(confidence) AS confidence, arg_min(poly_id, (-confidence, poly_id)) AS best_poly_id, CAST(sum(area) AS BIGINT) AS area_sum, any_value(u.union_area) AS union_area
FROM t JOIN u USING (region, model_run, grid_id, component) GROUP BY region, model_run, grid_id, component""".replace("SLAB", slab("u", "t", f"{_K}, component"))


@query(f"{_RSELF}, {_COMP.replace('RULE', f'{_SIOU} > 0.3')}{_MERGE}")
def f7_merge_overlapping(spark, d):
    p = view(spark, d, "predictions")
    return matching.merge_groups(p, matching.conflicts(p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS, 0.3), KEYS)


@query(f"{_RSELF}, {_COMP.replace('RULE', f'{_SIOU} >= 0.5')}{_MERGE}")
def f11_mutual_iou_set(spark, d):
    p = view(spark, d, "predictions")
    return matching.merge_groups(p, matching.conflicts(p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS, 0.5, strict=False), KEYS)


@query(f"""{loops.recursive(_PG)}, e AS (SELECT gt_id * 2 AS a, poly_id * 2 + 1 AS b FROM pairs), {loops.components('lab', 'e')},
n AS (SELECT {_K}, gt_id * 2 AS node, 'g' AS side, x0, y0, x1, y1 FROM gr UNION ALL SELECT {_K}, poly_id * 2 + 1, 'p', x0, y0, x1, y1 FROM predictions),
t AS (SELECT n.*, coalesce(component, n.node) AS component, unnest([side, 'b']) AS tag FROM n LEFT JOIN lab USING (node)), {slab('u', 't', _K + ', component, tag')},
w AS (SELECT {_K}, component, coalesce(max(CASE WHEN tag = 'p' THEN union_area END), 0) AS p, coalesce(max(CASE WHEN tag = 'g' THEN union_area END), 0) AS g, max(CASE WHEN tag = 'b' THEN union_area END) AS b FROM u GROUP BY {_K}, component),
c AS (SELECT {_K}, component, count(*) FILTER (WHERE tag = 'g') AS n_gt, count(*) FILTER (WHERE tag = 'p') AS n_pred FROM t GROUP BY {_K}, component),
r AS (SELECT *, coalesce((p + g - b) / nullif(CAST(g AS DOUBLE), 0), 0) AS rec, coalesce((p + g - b) / nullif(CAST(p AS DOUBLE), 0), 0) AS prec FROM c JOIN w USING ({_K}, component))
SELECT {_K}, component, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, round(rec, 6) AS recall, round(prec, 6) AS precision,
  round(coalesce(2 * rec * prec / nullif(rec + prec, 0), 0) * CASE WHEN n_gt > 0 AND n_pred > 0 THEN least(n_gt, n_pred) / CAST(greatest(n_gt, n_pred) AS DOUBLE) ELSE 0 END, 6) AS balanced,
  CASE WHEN n_gt > 0 AND n_pred > 0 THEN CASE WHEN rec >= 0.5 AND prec >= 0.3 THEN 'matched' ELSE 'partial' END WHEN n_pred > 0 THEN 'fp_only' ELSE 'fn_only' END AS kind FROM r""")
def f13_cluster_metrics(spark, d):
    """Area accuracy of each component of the two-sided overlap graph."""
    g, p = both(spark, d)
    nodes = matching.clusters(g, p, KEYS, inside=["region", "grid_id"])
    keys = [*KEYS, "component"]
    sets = spatial.area_sets(nodes.where("side = 'p'"), nodes.where("side = 'g'"), keys)
    sizes = nodes.groupBy(*keys).agg(F.count_if(F.col("side") == "g").alias("n_gt"), F.count_if(F.col("side") == "p").alias("n_pred"))
    rec, prec = F.coalesce(ratio("inter_union", "gt_union"), F.lit(0.0)), F.coalesce(ratio("inter_union", "pred_union"), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * rec * prec, rec + prec), F.lit(0.0))
    penalty = F.when((F.col("n_gt") > 0) & (F.col("n_pred") > 0), F.least("n_gt", "n_pred") / F.greatest("n_gt", "n_pred")).otherwise(0.0)
    kind = F.when((F.col("n_gt") > 0) & (F.col("n_pred") > 0), F.when((rec >= 0.5) & (prec >= 0.3), "matched").otherwise("partial")).when(F.col("n_pred") > 0, "fp_only").otherwise("fn_only")
    return sizes.join(sets, keys).select(*keys, "n_gt", "n_pred", F.round(rec, 6).alias("recall"), F.round(prec, 6).alias("precision"), F.round(f1 * penalty, 6).alias("balanced"), kind.alias("kind"))


@query(f"""{_SELF}, f AS (SELECT {_K}, poly_id, b_poly_id FROM self WHERE {_SIOU} >= 0.3 OR 2 * inter >= area OR 2 * inter >= b_area)
SELECT poly_id, CASE WHEN poly_id IN (SELECT poly_id FROM f UNION SELECT b_poly_id FROM f) THEN 'both' ELSE 'one' END AS detector FROM predictions""")
def f15_cross_tag(spark, d):
    """Whether another box of the run overlaps it by IoU or contains half of either."""
    p = view(spark, d, "predictions").select(*KEYS, "poly_id", "area", *spatial.BOX)
    hit = spatial.overlaps(p, p, KEYS).where("poly_id <> b_poly_id and (iou >= 0.3 or 2 * inter >= area or 2 * inter >= b_area)").select("poly_id").distinct()
    return p.join(hit.withColumn("hit", F.lit(True)), "poly_id", "left").select("poly_id", F.when(F.col("hit"), "both").otherwise("one").alias("detector"))


@query(f"""{_PG}, th AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold), e AS (SELECT pairs.*, threshold, {_IOU} AS iou FROM pairs, th WHERE {_IOU} >= threshold), {loops.pick_pairs('m', 'e', _K + ', threshold', _STRICT)},
gt AS (SELECT * FROM gr, th), pt AS (SELECT * FROM predictions, th), {loops.counted('c', 'gt', 'pt', 'region, model_run, threshold', 'm', 'm')}
SELECT *, round(coalesce(5 * tp / nullif(CAST(5 * tp + 4 * fn + fp AS DOUBLE), 0), 0), 6) AS f2, concat('iou_', threshold) AS iou_caliber, 'one_to_one' AS merge_mode FROM c""")
def h6_presence_metrics(spark, d):
    """Strict matching at several IoUs, F1 and F2, tagged with caliber and mode: the pairs are found once, the threshold is a key."""
    g, p = both(spark, d)
    edges = spatial.overlaps(g, p.select(*KEYS, "poly_id", "area", *spatial.BOX), KEYS).select(*KEYS, "gt_id", F.col("b_poly_id").alias("poly_id"), "iou")
    keys = [*KEYS, "threshold"]
    edges = stats.through_thresholds(edges, CALIBERS, "iou")
    won = graph.greedy_match(edges, keys, "gt_id", "poly_id", [-F.col("iou"), F.col("gt_id"), F.col("poly_id")])
    per = ["region", "model_run", "threshold"]
    every = F.explode(F.array(*map(F.lit, CALIBERS)))
    rows = matching.counts(g.withColumn("threshold", every), p.withColumn("threshold", every), per, won, won)
    f2 = F.coalesce(ratio(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")), F.lit(0.0))
    return rows.withColumns({"f2": F.round(f2, 6), "iou_caliber": F.concat(F.lit("iou_"), F.col("threshold").cast("string")), "merge_mode": F.lit("one_to_one")})
