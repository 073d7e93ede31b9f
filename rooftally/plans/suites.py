"""Queries on suites of grids, two-way sweeps, gates, identifiers and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators import columns, joins, names, spatial
from rooftally.operators.matching import ratio
from rooftally.plans.area import _SETS, ERRORS, GR, KEYS, both, errors, slab
from rooftally.plans.registry import query
from rooftally.sources.views import table, view, with_views

_P = with_views("predictions")
_K = "region, model_run, grid_id"
_SUITE = """su AS (SELECT model_run, CASE WHEN grid_id % 4 = 0 THEN 'dense' ELSE 'open' END AS suite, count(*) AS n_grids, sum(inter_union) AS i, sum(pred_union) AS a, sum(gt_union) AS b, avg(area_f1) AS macro FROM errs GROUP BY ALL),
sm AS (SELECT model_run, suite, n_grids, CAST(i AS DOUBLE) / a AS p, CAST(i AS DOUBLE) / b AS r, CAST(2 * i AS DOUBLE) / (a + b) AS f1, macro FROM su)"""


def suite_summary(spark, d):
    """Micro and macro accuracy of each run over each suite of grids."""
    rows = errors(spark, d).withColumn("suite", F.when(F.col("grid_id") % 4 == 0, "dense").otherwise("open"))
    s = rows.groupBy("model_run", "suite").agg(F.count("*").alias("n_grids"), F.sum("inter_union").alias("i"), F.sum("pred_union").alias("a"), F.sum("gt_union").alias("b"), F.avg("area_f1").alias("macro"))
    return s.select("model_run", "suite", "n_grids", ratio("i", "a").alias("p"), ratio("i", "b").alias("r"), ratio(2 * F.col("i"), F.col("a") + F.col("b")).alias("f1"), "macro")


@query(f"{_SETS}, {ERRORS}, {_SUITE} SELECT model_run, suite, CAST(n_grids AS BIGINT) AS n_grids, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS micro_f1, round(macro, 6) AS macro_f1 FROM sm")
def h15_suite_summary(spark, d):
    s = suite_summary(spark, d)
    return s.select("model_run", "suite", "n_grids", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f1", 6).alias("micro_f1"), F.round("macro", 6).alias("macro_f1"))


@query(f"""{_SETS}, {ERRORS}, {_SUITE}, dl AS (SELECT m.model_run, m.suite, m.f1 - b.f1 AS delta FROM sm m JOIN sm b ON m.suite = b.suite AND b.model_run = 'run_A')
SELECT model_run, CAST(count(*) AS BIGINT) AS n_suites, round(min(delta), 6) AS worst, round(max(delta), 6) AS best, CASE WHEN min(delta) >= 0.001 THEN 'improved' WHEN max(delta) <= -0.001 THEN 'regressed' WHEN max(abs(delta)) < 0.001 THEN 'flat' ELSE 'mixed' END AS verdict FROM dl GROUP BY model_run""")
def h16_baseline_delta(spark, d):
    s = suite_summary(spark, d)
    base = s.where("model_run = 'run_A'").select("suite", F.col("f1").alias("base"))
    rows = s.join(base, "suite").groupBy("model_run").agg(F.count("*").alias("n_suites"), F.min(F.col("f1") - F.col("base")).alias("lo"), F.max(F.col("f1") - F.col("base")).alias("hi"))
    rules = [(F.col("lo") >= 0.001, "improved"), (F.col("hi") <= -0.001, "regressed"), ((F.col("hi") < 0.001) & (F.col("lo") > -0.001), "flat")]
    return rows.select("model_run", "n_suites", F.round("lo", 6).alias("worst"), F.round("hi", 6).alias("best"), columns.first_match(rules, "mixed").alias("verdict"))


_T2 = "threshold, second"


@query(f"""{with_views('predictions', 'ground_truth')}, {GR}, th AS (SELECT * FROM (SELECT unnest([0.6, 0.8]::DOUBLE[]) AS threshold), (SELECT unnest([0.5, 0.7]::DOUBLE[]) AS second)),
tagged AS (SELECT {_K}, {_T2}, x0, y0, x1, y1, unnest(['p', 'b']) AS tag FROM predictions, th WHERE confidence >= threshold AND second_score >= second UNION ALL SELECT {_K}, {_T2}, x0, y0, x1, y1, unnest(['g', 'b']) FROM gr, th),
{slab('u', 'tagged', f'{_K}, {_T2}, tag')}, s AS (SELECT model_run, {_T2}, sum(CASE WHEN tag = 'p' THEN union_area ELSE 0 END) AS a, sum(CASE WHEN tag = 'g' THEN union_area ELSE 0 END) AS b, sum(CASE WHEN tag = 'b' THEN -union_area ELSE union_area END) AS i FROM u GROUP BY model_run, {_T2})
SELECT model_run, {_T2}, round(CAST(i AS DOUBLE) / a, 6) AS precision, round(CAST(i AS DOUBLE) / b, 6) AS recall, round(CAST(2 * i AS DOUBLE) / (a + b), 6) AS f1 FROM s""")
def h27_inventory_sweep(spark, d):
    """Area accuracy over two thresholds at once: both are keys of one job."""
    g, p = both(spark, d)
    rules = [((c, k), (F.col("confidence") >= c) & (F.col("second_score") >= k)) for c in (0.6, 0.8) for k in (0.5, 0.7)]
    sets = spatial.swept_sets(p.select(*KEYS, *spatial.BOX, "confidence", "second_score"), g, KEYS, rules, ["threshold", "second"])
    per = ["model_run", "threshold", "second"]
    s = sets.groupBy(*per).agg(F.sum("pred_union").alias("a"), F.sum("gt_union").alias("b"), F.sum("inter_union").alias("i"))
    return s.select(*per, F.round(ratio("i", "a"), 6).alias("precision"), F.round(ratio("i", "b"), 6).alias("recall"), F.round(ratio(2 * F.col("i"), F.col("a") + F.col("b")), 6).alias("f1"))


@query(f"""{with_views('predictions', 'task_grid')}, c AS (SELECT stratum, grid_id, bool_or(review_status = 'delete' AND confidence >= 0.95 AND area > 20000) AS affected FROM predictions JOIN task_grid USING (grid_id) GROUP BY stratum, grid_id)
SELECT coalesce(stratum, 'ALL') AS stratum, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE affected) AS BIGINT) AS n_affected, CASE WHEN count(*) < 10 THEN 'INSUFFICIENT' WHEN 10 * count(*) FILTER (WHERE affected) <= 9 * count(*) THEN 'PASS' ELSE 'KILL' END AS gate FROM c GROUP BY ROLLUP (stratum)""")
def h35_gate(spark, d):
    """Share of sampled cells with a confirmed fault, by stratum and over all."""
    p = view(spark, d, "predictions").join(view(spark, d, "task_grid").select("grid_id", "stratum"), "grid_id")
    hit = (F.col("review_status") == "delete") & (F.col("confidence") >= 0.95) & (F.col("area") > 20000)
    c = p.groupBy("stratum", "grid_id").agg(F.bool_or(hit).alias("affected"))
    r = c.rollup("stratum").agg(F.count("*").alias("n"), F.count_if("affected").alias("n_affected"))
    rules = [(F.col("n") < 10, "INSUFFICIENT"), (10 * F.col("n_affected") <= 9 * F.col("n"), "PASS")]
    return r.select(F.coalesce("stratum", F.lit("ALL")).alias("stratum"), "n", "n_affected", columns.first_match(rules, "KILL").alias("gate"))


@query(f"{_P} SELECT poly_id, printf('%d_pred%06d', grid_id, CAST(poly_id % 1000000 AS INTEGER)) AS candidate_id, concat_ws(':', region, grid_id, model_run, poly_id) AS pool_id FROM predictions")
def b13_ids(spark, d):
    return view(spark, d, "predictions").select("poly_id", F.format_string("%d_pred%06d", "grid_id", F.col("poly_id") % 1000000).alias("candidate_id"), F.concat_ws(":", "region", "grid_id", "model_run", "poly_id").alias("pool_id"))


#: What stands for the names of files and runs: made of the tables' values, since they hold none.
_NAME = "concat('results/', CASE o_orderkey % 4 WHEN 0 THEN 'G' WHEN 1 THEN 'JHB' WHEN 2 THEN 'cpt' ELSE '' END, lpad(CAST(o_custkey % 10000 AS {text}), 4, '0'), '_V', CAST(o_orderkey % 5 AS {text}), '_', date_format(o_orderdate, 'yyMMdd'), '_pred', CAST(o_custkey AS {text}), '.gpkg')"
_RUN_NAME = "concat(CASE o_orderkey % 3 WHEN 0 THEN 'v4_aerial/' ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN 'benchmark_lineup_V3-A' WHEN 1 THEN 'benchmark_old_V9' WHEN 2 THEN 'EXP7_targeted' WHEN 3 THEN 'v4.2_tuned' ELSE 'plain' END)"
_FAMILIES = [("v4[._]2", "v4.2"), ("exp7", "v4.1"), ("v4_aerial", "v4"), ("benchmark", "bench")]
_TAGS = {"v3-a": "v3", "v4.2": "v4.2"}
_DUCK = lambda text: text.replace("{text}", "VARCHAR").replace("date_format(o_orderdate, 'yyMMdd')", "strftime(o_orderdate, '%y%m%d')")


@query(f"""WITH n AS (SELECT o_orderkey, {_DUCK(_NAME)} AS path, {_RUN_NAME} AS run FROM orders), s AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '\\.[^.]*$', '') AS stem, lower(run) AS low FROM n)
SELECT o_orderkey, nullif(regexp_extract(stem, '^(?:((?:JHB|G)[0-9]{{4}}))', 1), '') AS grid_id, nullif(regexp_extract(stem, '_([0-9]{{6}})(?:_|$)', 1), '') AS vintage, TRY_CAST(nullif(regexp_extract(stem, '_pred([0-9]+)', 1), '') AS BIGINT) AS pred_idx,
CASE WHEN contains(low, 'benchmark_') AND string_split(low, '_')[-1] = 'v3-a' THEN 'v3' WHEN contains(low, 'benchmark_') AND string_split(low, '_')[-1] = 'v4.2' THEN 'v4.2' WHEN regexp_matches(low, 'v4[._]2') THEN 'v4.2' WHEN contains(low, 'exp7') THEN 'v4.1' WHEN contains(low, 'v4_aerial') THEN 'v4' WHEN contains(low, 'benchmark') THEN 'bench' ELSE 'other' END AS family FROM s""")
def b15_b16_name_grammars(spark, d):
    """Cell, vintage and number from a file's name, null where it doesn't fit; the family of a run by its tag, else by the first rule that fits."""
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_NAME.replace("{text}", "STRING")).alias("path"), F.expr(_RUN_NAME).alias("run"))
    stem = names.file_stem(F.col("path"))
    parts = [names.part(stem, "((?:JHB|G)[0-9]{4})", whole=True).alias("grid_id"), names.part(stem, "_([0-9]{6})(?:_|$)").alias("vintage"), names.part(stem, "_pred([0-9]+)").try_cast("bigint").alias("pred_idx")]
    return o.select("o_orderkey", *parts, names.family(F.col("run"), F.lit(None).cast("string"), _FAMILIES, tagged="benchmark_", tags=_TAGS).alias("family"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, CASE WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS family FROM pages""")
def b15_b16_page_grammars(spark, d):
    """The same for the addresses of pages."""
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"), names.part(url, r"/([0-9]+)").try_cast("bigint").alias("number"), names.family(url, F.lit(""), [("page=", "paged"), (r"\?", "query")], "plain").alias("family"))


@query(f"{with_views('intervals')} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE date_trunc('month', start_date) = DATE '1996-03-01' AND date_trunc('month', end_date) = DATE '1996-05-01') AS BIGINT) AS n_gap, CAST(count(*) FILTER (WHERE year(end_date) <= 1996) AS BIGINT) AS n_vintage FROM intervals")
def l5_l6_brackets(spark, d):
    """Intervals that begin and end in a given pair of months, and those up to a vintage."""
    month = lambda c, m: F.trunc(c, "month") == F.lit(m).cast("date")
    return view(spark, d, "intervals").agg(F.count("*").alias("n"), F.count_if(month("start_date", "1996-03-01") & month("end_date", "1996-05-01")).alias("n_gap"), F.count_if(F.coalesce(F.year("end_date"), F.lit(2099)) <= 1996).alias("n_vintage"))


@query(f"{_P} SELECT region, review_status AS label, CAST(count(*) AS BIGINT) AS n, CAST(sum(area) AS BIGINT) AS area FROM predictions WHERE confidence >= 0.65 AND confidence < 0.85 AND review_status <> 'edit' GROUP BY region, review_status")
def c11_confidence_band(spark, d):
    p = view(spark, d, "predictions").where((F.col("confidence") >= 0.65) & (F.col("confidence") < 0.85) & (F.col("review_status") != "edit"))
    return p.groupBy("region", F.col("review_status").alias("label")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query(f"""{with_views('predictions', 'decisions')}, r AS (SELECT grid_id, pred_id, arg_max(coalesce(CAST(pv_present AS VARCHAR), 'abstain'), event_id) AS verdict FROM decisions GROUP BY grid_id, pred_id), p AS (SELECT model_run, grid_id, poly_id % 500 AS pred_id, poly_id, area FROM predictions)
SELECT model_run, verdict, CAST(count(*) AS BIGINT) AS n, CAST(sum(area) AS BIGINT) AS area FROM p JOIN r USING (grid_id, pred_id) WHERE verdict <> 'abstain' GROUP BY model_run, verdict""")
def d12_review_join(spark, d):
    """Predictions with their last verdict; rows whose reviewer abstained stay out of the counts."""
    p = view(spark, d, "predictions").select("model_run", "grid_id", (F.col("poly_id") % 500).alias("pred_id"), "area")
    rows = joins.review_join(p, view(spark, d, "decisions"), ["grid_id", "pred_id"], "pv_present", "event_id")
    return rows.groupBy("model_run", F.col("pv_present").cast("string").alias("verdict")).agg(F.count("*").alias("n"), F.sum("area").alias("area"))
