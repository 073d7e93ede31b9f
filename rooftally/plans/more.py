"""Further queries: clusters and deduplication across grids, censuses, tessellation, tables and their differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rooftally.operators import columns, graph, matching, ranks, sampling, spatial, windows
from rooftally.plans.area import GR, KEYS, TILES, both, slab, tiles
from rooftally.plans.graphs import _IOU, _PG, _SELF, _SIOU, _STRICT
from rooftally.plans import loops
from rooftally.plans.registry import query
from rooftally.sources.views import table, view, with_views

_P = with_views("predictions")
_K = "region, model_run, grid_id"


@query(f"{_PG} SELECT p.region, p.model_run, CAST(count(*) AS BIGINT) AS n FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.poly_id = p.poly_id AND 10 * q.inter >= q.pred_area) GROUP BY p.region, p.model_run")
def c13_background_proposals(spark, d):
    """Predictions less than a tenth of which lies in any ground truth."""
    g, p = both(spark, d)
    near = spatial.overlaps(p.select(*KEYS, "poly_id", "area", *spatial.BOX), g.select(*KEYS, "area", *spatial.BOX), KEYS).where("10 * inter >= area").select("poly_id").distinct()
    return p.join(near, "poly_id", "left_anti").groupBy("region", "model_run").agg(F.count("*").alias("n"))


@query(f"{_PG} SELECT p.poly_id FROM predictions p WHERE review_status = 'delete' AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.poly_id = p.poly_id AND 20 * q.inter > q.pred_area)")
def c14_pure_fp(spark, d):
    g, p = both(spark, d)
    p = p.where("review_status = 'delete'").select(*KEYS, "poly_id", "area", *spatial.BOX)
    hit = spatial.overlaps(p, g.select(*KEYS, "area", *spatial.BOX), KEYS).where("20 * inter > area").select("poly_id").distinct()
    return p.join(hit, "poly_id", "left_anti").select("poly_id")


@query(f"""{with_views('ground_truth')}, r AS (SELECT grid_id, count(*) AS n_raw, count(*) FILTER (WHERE area BETWEEN 1 AND 12000 AND x0 >= 0 AND y0 >= 0) AS n_clean FROM ground_truth GROUP BY grid_id)
SELECT grid_id, CAST(n_raw AS BIGINT) AS n_raw, CAST(n_clean AS BIGINT) AS n_clean, n_raw >= 10 AND 2 * n_clean < n_raw AS corrupt FROM r""")
def c12_corrupt_gt_guard(spark, d):
    clean = F.col("area").between(1, 12000) & (F.col("x0") >= 0) & (F.col("y0") >= 0)
    r = view(spark, d, "ground_truth").groupBy("grid_id").agg(F.count("*").alias("n_raw"), F.count_if(clean).alias("n_clean"))
    return r.withColumn("corrupt", (F.col("n_raw") >= 10) & (2 * F.col("n_clean") < F.col("n_raw")))


@query(f"""{with_views('predictions', 'task_grid')}, {TILES}, c AS (SELECT region, model_run, p.grid_id, t.tile, greatest(p.x0, t.x0) AS x0, greatest(p.y0, t.y0) AS y0, least(p.x1, t.x1) AS x1, least(p.y1, t.y1) AS y1
  FROM predictions p JOIN tiles t ON p.grid_id = t.grid_id AND p.x0 < t.x1 AND t.x0 < p.x1 AND p.y0 < t.y1 AND t.y0 < p.y1), {slab('u', 'c', _K + ', tile')}
SELECT {_K}, tile, union_area, round(union_area / 562500.0E0, 6) AS fraction, union_area < 562500 AS edge FROM u""")
def d9_coverage_fraction(spark, d):
    pairs = spatial.box_join(view(spark, d, "predictions").select(*KEYS, *spatial.BOX), tiles(spark, d), ["grid_id"], size=750)
    cut = pairs.select(*KEYS, F.col("b_tile").alias("tile"), F.greatest("x0", "b_x0").alias("x0"), F.greatest("y0", "b_y0").alias("y0"), F.least("x1", "b_x1").alias("x1"), F.least("y1", "b_y1").alias("y1"))
    u = spatial.union_area(cut, [*KEYS, "tile"])
    return u.withColumns({"fraction": F.round(F.col("union_area") / 562500, 6), "edge": F.col("union_area") < 562500})


@query(f"""{_PG}, r AS (SELECT gt_id, model_run, max(CASE WHEN pred_area > gt_area THEN 1 ELSE 0 END) AS larger, max(CASE WHEN pred_area <= gt_area THEN 1 ELSE 0 END) AS smaller FROM pairs GROUP BY gt_id, model_run)
SELECT gr.gt_id, gr.model_run, CASE WHEN larger = 1 AND smaller = 1 THEN 'mixed' WHEN larger = 1 THEN 'A' WHEN smaller = 1 THEN 'B' ELSE 'uncovered' END AS kind FROM gr LEFT JOIN r ON gr.gt_id = r.gt_id AND gr.model_run = r.model_run WHERE source = 'redrawn'""")
def f16_edit_replacement_kind(spark, d):
    g, p = both(spark, d)
    g = g.where("source = 'redrawn'")
    hits = spatial.box_join(g, p.select(*KEYS, "area", *spatial.BOX), KEYS).groupBy("gt_id", "model_run").agg(F.bool_or(F.col("b_area") > F.col("area")).alias("larger"), F.bool_or(F.col("b_area") <= F.col("area")).alias("smaller"))
    rules = [(F.col("larger") & F.col("smaller"), "mixed"), (F.col("larger"), "A"), (F.col("smaller"), "B")]
    return g.join(hits, ["gt_id", "model_run"], "left").select("gt_id", "model_run", columns.first_match(rules, "uncovered").alias("kind"))


@query(f"""{loops.recursive(_PG)}, e AS (SELECT gt_id * 2 AS a, poly_id * 2 + 1 AS b FROM pairs WHERE {_IOU} > 0.1), {loops.components('lab', 'e')},
n AS (SELECT region, model_run, gt_id * 2 AS node FROM gr UNION ALL SELECT region, model_run, poly_id * 2 + 1 FROM predictions),
c AS (SELECT region, model_run, coalesce(component, n.node) AS component, count(*) FILTER (WHERE node % 2 = 0) AS n_gt, count(*) FILTER (WHERE node % 2 = 1) AS n_pred FROM n LEFT JOIN lab USING (node) GROUP BY ALL)
SELECT region, model_run, CAST(n_gt AS BIGINT) AS n_gt, CAST(n_pred AS BIGINT) AS n_pred, CAST(count(*) AS BIGINT) AS n_clusters FROM c GROUP BY ALL""")
def f12_overlap_clusters(spark, d):
    """Sizes of the components of the two-sided overlap graph, lone boxes included."""
    g, p = both(spark, d)
    nodes = matching.clusters(g, p, KEYS, 0.1, ["region", "grid_id"])
    sizes = nodes.groupBy(*KEYS, "component").agg(F.count_if(F.col("side") == "g").alias("n_gt"), F.count_if(F.col("side") == "p").alias("n_pred"))
    return sizes.groupBy("region", "model_run", "n_gt", "n_pred").agg(F.count("*").alias("n_clusters"))


@query(f"""{loops.recursive(_P)}, e AS (SELECT a.poly_id AS a, b.poly_id AS b FROM predictions a JOIN predictions b USING ({_K}) WHERE a.poly_id < b.poly_id AND pow(greatest(b.x0 - a.x1, a.x0 - b.x1, 0), 2) + pow(greatest(b.y0 - a.y1, a.y0 - b.y1, 0), 2) <= 25),
{loops.components('lab', 'e')}, t AS (SELECT p.*, coalesce(component, poly_id) AS component FROM predictions p LEFT JOIN lab ON poly_id = node), {slab('u', 't', _K + ', component')}
SELECT {_K}, component, CAST(count(*) AS BIGINT) AS n_members, arg_min(poly_id, (-area, poly_id)) AS base_id, max(confidence) AS confidence, max(second_score) AS second_score, any_value(u.union_area) AS union_area FROM t JOIN u USING ({_K}, component) GROUP BY {_K}, component""")
def f9_dissolve_hairline(spark, d):
    """Boxes within half a metre become one: the largest member names it, numbers take their maximum."""
    p = view(spark, d, "predictions")
    box = p.select(*KEYS, "poly_id", *spatial.BOX)
    tagged = graph.with_component(p, spatial.near_boxes(box, box, KEYS, 5).where("poly_id < b_poly_id"), "poly_id", "poly_id", "b_poly_id", KEYS)
    best = F.max_by("poly_id", F.struct("area", (-F.col("poly_id")).alias("n"))).alias("base_id")
    rows = tagged.groupBy(*KEYS, "component").agg(F.count("*").alias("n_members"), best, F.max("confidence").alias("confidence"), F.max("second_score").alias("second_score"))
    return rows.join(spatial.union_area(tagged, [*KEYS, "component"]), [*KEYS, "component"])


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, sure AS (SELECT * FROM predictions WHERE confidence >= 0.7), {loops.pick_groups('m', 'gr', 'sure', _K, 0.3)} SELECT region, model_run, source, CAST(count(*) AS BIGINT) AS n_missed FROM gr ANTI JOIN m USING ({_K}, gt_id) GROUP BY ALL""")
def f21_missed_gt(spark, d):
    """Ground truth that the many-to-one matching at confidence 0.7 leaves."""
    g, p = both(spark, d)
    accepted, _ = matching.match_merged(g, p.where("confidence >= 0.7"), KEYS, 0.3)
    return g.join(accepted.select(*KEYS, "gt_id"), [*KEYS, "gt_id"], "left_anti").groupBy("region", "model_run", "source").agg(F.count("*").alias("n_missed"))


@query(f"""{_P}, s AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 1 ELSE 0 END AS hit FROM predictions), t AS (SELECT unnest([0.9, 0.95]::DOUBLE[]) AS target),
r AS (SELECT model_run, confidence, row_number() OVER (PARTITION BY model_run ORDER BY confidence DESC, poly_id) AS k, count(*) OVER (PARTITION BY model_run) AS n FROM s WHERE review_status <> 'delete')
SELECT model_run, target, confidence AS threshold FROM r, t WHERE k = ceil(round(target * n, 6))""")
def h29_threshold_at_recall(spark, d):
    """The largest confidence at which the share of kept true rows reaches the target: confidences are counted, and the count walked."""
    r = view(spark, d, "predictions").where("review_status <> 'delete'").select("model_run", "confidence")
    targets = {"0.9": 0.9, "0.95": 0.95}
    found = ranks.values_at(r, ["model_run"], "confidence", {n: F.ceil(F.round(F.lit(t) * F.col("n"), 6)) for n, t in targets.items()})
    at = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{n}`").alias("threshold")) for n, t in targets.items()])
    return found.select("model_run", F.explode(at).alias("r")).select("model_run", "r.*")


@query(f"{_P} SELECT grid_id, CAST(count(*) AS BIGINT) AS installs, CAST(sum(area) AS BIGINT) AS area, round(median(area), 4) AS median_area, CAST(row_number() OVER (ORDER BY sum(area) DESC, grid_id) AS INTEGER) AS k FROM predictions WHERE confidence >= 0.8 GROUP BY grid_id ORDER BY area DESC, grid_id LIMIT 5")
def h41_census_top_cells(spark, d):
    """The five cells with the largest area."""
    c = view(spark, d, "predictions").where("confidence >= 0.8").groupBy("grid_id").agg(F.count("*").alias("installs"), F.sum("area").alias("area"), F.round(F.median("area"), 4).alias("median_area"))
    return c.orderBy(F.desc("area"), "grid_id").limit(5).withColumn("k", F.row_number().over(Window.orderBy(F.desc("area"), "grid_id")))


@query(f"""{with_views('task_grid', 'predictions')}, s AS (SELECT grid_id, count(*) AS n FROM predictions GROUP BY grid_id), m AS (SELECT user_id % 100 + 1 AS grid_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS ok FROM events GROUP BY ALL)
SELECT grid_id, CASE WHEN ok = 1 AND n > 500 THEN 'ok' WHEN ok = 1 THEN 'empty' WHEN failed = 1 THEN 'download_failed' ELSE 'not_reached' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n FROM task_grid LEFT JOIN m USING (grid_id) LEFT JOIN s USING (grid_id)""")
def h42_coverage_manifest(spark, d):
    marks = table(spark, d, "events").groupBy((F.col("user_id") % 100 + 1).alias("grid_id")).agg(F.bool_or(F.col("event_type") == "error").alias("failed"), F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    n = view(spark, d, "predictions").groupBy("grid_id").agg(F.count("*").alias("n"))
    rules = [(F.col("ok") & (F.col("n") > 500), "ok"), (F.col("ok"), "empty"), (F.col("failed"), "download_failed")]
    rows = view(spark, d, "task_grid").join(marks, "grid_id", "left").join(n, "grid_id", "left")
    return rows.select("grid_id", columns.first_match(rules, "not_reached").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_P} SELECT grid_id, poly_id, bool_or(review_status = 'edit') OVER w AS any_edit, bool_or(area >= 10000) OVER w AS any_large FROM predictions WINDOW w AS (PARTITION BY grid_id, x0 // 750, y0 // 750)")
def i6_tile_context(spark, d):
    w = Window.partitionBy("grid_id", F.floor(F.col("x0") / 750), F.floor(F.col("y0") / 750))
    return view(spark, d, "predictions").select("grid_id", "poly_id", F.bool_or(F.col("review_status") == "edit").over(w).alias("any_edit"), F.bool_or(F.col("area") >= 10000).over(w).alias("any_large"))


@query(f"""{_P}, r AS (SELECT region, poly_id, area, rank() OVER (PARTITION BY region ORDER BY area) AS k, count(*) OVER (PARTITION BY region, area) AS ties, count(*) OVER (PARTITION BY region) AS n FROM predictions)
SELECT region, poly_id, round((k + (ties - 1) / 2.0E0) / n, 6) AS pct FROM r""")
def i4_pct_rank(spark, d):
    """Share of a region's rows up to the middle of a row's ties, by area; a region's rows lie in many ranges."""
    p = view(spark, d, "predictions").select("region", "poly_id", "area")
    return ranks.percent_ranks(p, ["region"], "area").select("region", "poly_id", F.round("pct", 6).alias("pct"))


@query(f"""{_P}, a AS (SELECT grid_id, count(*) AS na, sum(area) AS aa FROM predictions WHERE model_run = 'run_A' AND confidence >= 0.9 GROUP BY grid_id), b AS (SELECT grid_id, count(*) AS nb, sum(area) AS ab FROM predictions WHERE model_run = 'run_B' AND confidence >= 0.9 GROUP BY grid_id)
SELECT coalesce(a.grid_id, b.grid_id) AS grid_id, CAST(coalesce(na, 0) AS BIGINT) AS n_base, CAST(coalesce(nb, 0) AS BIGINT) AS n_new, CASE WHEN a.grid_id IS NULL THEN 'added' WHEN b.grid_id IS NULL THEN 'removed' WHEN na IS DISTINCT FROM nb OR aa IS DISTINCT FROM ab THEN 'changed' ELSE 'same' END AS diff FROM a FULL OUTER JOIN b ON a.grid_id = b.grid_id""")
def k2_build_equivalence(spark, d):
    side = lambda run, n, a: view(spark, d, "predictions").where(f"model_run = '{run}' and confidence >= 0.9").groupBy("grid_id").agg(F.count("*").alias(n), F.sum("area").alias(a))
    rows = side("run_A", "na", "aa").join(side("run_B", "nb", "ab"), "grid_id", "full_outer")
    rules = [(F.col("na").isNull(), "added"), (F.col("nb").isNull(), "removed"), (~(F.col("na").eqNullSafe(F.col("nb")) & F.col("aa").eqNullSafe(F.col("ab"))), "changed")]
    return rows.select("grid_id", F.coalesce("na", F.lit(0)).alias("n_base"), F.coalesce("nb", F.lit(0)).alias("n_new"), columns.first_match(rules, "same").alias("diff"))


_SIDE = "SELECT p_partkey AS tile, 600 + p_size * 13 AS width, 500 + p_size * 7 AS height FROM part"


def _origins(side: str, mode: str) -> str:
    if mode == "training":
        return f"list_filter(range(0, {side}, 96), lambda x: least(128, {side} - x) >= 64)"
    if mode == "anchored":
        return f"CASE WHEN {side} <= 128 THEN [CAST(0 AS BIGINT)] WHEN ({side} - 128) % 96 = 0 THEN range(0, {side} - 127, 96) ELSE range(0, {side} - 127, 96) || [CAST({side} - 128 AS BIGINT)] END"
    return f"CASE WHEN {side} > 128 THEN range(0, ({side} - 1) // 96 * 96, 96) || [CAST({side} - 128 AS BIGINT)] ELSE [CAST(0 AS BIGINT)] END"


@query(f"WITH t AS ({_SIDE}) " + " UNION ALL ".join(f"SELECT tile, '{m}' AS mode, x, y, CAST(least(128, width - x) AS BIGINT) AS w, CAST(least(128, height - y) AS BIGINT) AS h FROM (SELECT *, unnest({_origins('height', m)}) AS y FROM (SELECT *, unnest({_origins('width', m)}) AS x FROM t))" for m in windows.MODES))
def m6_chip_windows(spark, d):
    """Windows of 128 at steps of 96 over each raster, in each of the three modes."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("tile"), (600 + F.col("p_size") * 13).alias("width"), (500 + F.col("p_size") * 7).alias("height"))
    rows = [windows.chip_windows(t, 128, 0.25, m).select("tile", F.lit(m).alias("mode"), "x", "y", "w", "h") for m in windows.MODES]
    return reduce(DataFrame.unionByName, rows)


@query(f"""{with_views('task_grid', 'ground_truth')}, {TILES}, b AS (SELECT DISTINCT t.grid_id, t.tile // 4 AS i, t.tile % 4 AS j FROM ground_truth g JOIN tiles t ON g.grid_id = t.grid_id AND g.x0 < t.x1 AND t.x0 < g.x1 AND g.y0 < t.y1 AND t.y0 < g.y1 WHERE g.area >= 33000),
n AS (SELECT grid_id, i + dx AS i, j + dy AS j, abs(dx) + abs(dy) AS ring FROM b, (SELECT unnest([-2, -1, 0, 1, 2]) AS dx), (SELECT unnest([-2, -1, 0, 1, 2]) AS dy) WHERE abs(dx) + abs(dy) <= 2 AND i + dx BETWEEN 0 AND 3 AND j + dy BETWEEN 0 AND 3)
SELECT grid_id, i * 4 + j AS tile, CAST(min(ring) AS INTEGER) AS ring, CASE WHEN min(ring) = 0 THEN 'building' ELSE concat('buffer_', min(ring)) END AS reason FROM n GROUP BY grid_id, i, j""")
def m8_tile_mask(spark, d):
    """Tiles that large footprints touch (ring 0), and two rings of neighbours."""
    met = spatial.box_join(view(spark, d, "ground_truth").where("area >= 33000").select("grid_id", *spatial.BOX), tiles(spark, d), ["grid_id"], size=750)
    held = met.select("grid_id", F.floor(F.col("b_tile") / 4).alias("i"), (F.col("b_tile") % 4).alias("j"))
    return windows.tile_mask(held, ["grid_id"], 2, 4, 4).select("grid_id", (F.col("i") * 4 + F.col("j")).alias("tile"), "ring", "reason")


@query(f"""{_P}, p AS (SELECT model_run, count(*) FILTER (WHERE review_status <> 'delete' AND confidence >= 0.8) AS trusted, count(*) FILTER (WHERE review_status = 'edit') AS untrusted FROM predictions GROUP BY model_run)
SELECT model_run, CAST(trusted AS BIGINT) AS trusted, CAST(untrusted AS BIGINT) AS untrusted, untrusted <= 4 * trusted AS passes FROM p""")
def m19_trust_ratio_gate(spark, d):
    p = view(spark, d, "predictions").groupBy("model_run").agg(F.count_if((F.col("review_status") != "delete") & (F.col("confidence") >= 0.8)).alias("trusted"), F.count_if(F.col("review_status") == "edit").alias("untrusted"))
    return p.withColumn("passes", F.col("untrusted") <= 4 * F.col("trusted"))


_DRAW = "ln((CAST(concat('0x', substr(sha256(concat('42:', CAST(grid_id AS VARCHAR))), 1, 8)) AS BIGINT) + 1) / 4294967298.0E0) / n"


@query(f"""{with_views('predictions', 'task_grid')}, c AS (SELECT t.region, t.grid_id, stratum, count(*) AS n FROM predictions p JOIN task_grid t USING (grid_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_DRAW} DESC, grid_id) AS k, {_DRAW} AS u FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY region, stratum ORDER BY u DESC, grid_id) AS k2 FROM r WHERE k > 5)
SELECT region, grid_id, stratum, CAST(n AS BIGINT) AS n, 'core' AS part FROM r WHERE k <= 5 UNION ALL SELECT region, grid_id, stratum, CAST(n AS BIGINT), 'oversample' FROM s WHERE k2 <= 1""")
def j6_weighted_sample(spark, d):
    """Five grids of a region, likelier by their predictions, and one more of each stratum among the rest."""
    n = view(spark, d, "predictions").groupBy("grid_id").agg(F.count("*").alias("n")).join(view(spark, d, "task_grid").select("region", "grid_id", "stratum"), "grid_id")
    core = sampling.weighted_without_replacement(n, ["region"], "grid_id", "n", 5)
    more = sampling.weighted_without_replacement(n.join(core.select("grid_id"), "grid_id", "left_anti"), ["region", "stratum"], "grid_id", "n", 1)
    names = ["region", "grid_id", "stratum", "n"]
    return core.select(*names, F.lit("core").alias("part")).unionByName(more.select(*names, F.lit("oversample").alias("part")))


@query(f"{with_views('negative_pool')} SELECT region, CAST(count(DISTINCT archetype) AS BIGINT) AS n_archetypes, CAST(count(DISTINCT grid_id) AS BIGINT) AS n_grids, CASE WHEN count(DISTINCT archetype) >= 5 THEN 'broad' ELSE 'narrow' END AS verdict FROM negative_pool WHERE training_eligible <> 'false' GROUP BY region")
def h36_hn_breadth(spark, d):
    p = view(spark, d, "negative_pool").where(columns.eligible(F.col("training_eligible"))).groupBy("region").agg(F.countDistinct("archetype").alias("n_archetypes"), F.countDistinct("grid_id").alias("n_grids"))
    return p.withColumn("verdict", F.when(F.col("n_archetypes") >= 5, "broad").otherwise("narrow"))


@query(f"""{_SELF}, c AS (SELECT region, model_run, count(*) AS n_pairs, count(*) FILTER (WHERE {_SIOU} > 0.1) AS n_overlapping, sum(inter) AS inter FROM self GROUP BY region, model_run) SELECT region, model_run, CAST(n_pairs AS BIGINT) AS n_pairs, CAST(n_overlapping AS BIGINT) AS n_overlapping, CAST(inter AS BIGINT) AS inter FROM c""")
def d2_self_overlap(spark, d):
    p = view(spark, d, "predictions").select(*KEYS, "poly_id", "area", *spatial.BOX)
    pairs = spatial.overlaps(p, p, KEYS).where("poly_id < b_poly_id")
    return pairs.groupBy("region", "model_run").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("iou") > 0.1).alias("n_overlapping"), F.sum("inter").alias("inter"))


@query(f"""{_PG}, e AS (SELECT *, {_IOU} AS iou FROM pairs WHERE {_IOU} >= 0.5), {loops.pick_pairs('s', 'e', _K, _STRICT)}, {loops.pick_groups('m', 'gr', 'predictions', _K, 0.5)},
{loops.counted('a', 'gr', 'predictions', 'region, model_run', 's', 's')}, {loops.counted('b', 'gr', 'predictions', 'region, model_run', 'm', 'm_hit')}
SELECT region, model_run, a.f1 AS f1_strict, b.f1 AS f1_merge, round(b.f1 - a.f1, 6) AS gain FROM a JOIN b USING (region, model_run)""")
def h44_strict_vs_merge(spark, d):
    """F1 of the one-to-one and of the many-to-one matching by region and run."""
    g, p = both(spark, d)
    per = ["region", "model_run"]
    strict = matching.match_strict(g, p, KEYS, 0.5)
    accepted, hit = matching.match_merged(g, p, KEYS, 0.5)
    a = matching.counts(g, p, per, strict, strict).select(*per, F.col("f1").alias("f1_strict"))
    b = matching.counts(g, p, per, accepted, hit).select(*per, F.col("f1").alias("f1_merge"))
    return a.join(b, per).withColumn("gain", F.round(F.col("f1_merge") - F.col("f1_strict"), 6))
