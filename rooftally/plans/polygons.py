"""Queries on rings: shapes, projections, wobble."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators import columns, rings
from rooftally.plans.registry import query
from rooftally.sources.views import view, with_views

_P, _G = with_views("predictions"), with_views("ground_truth")
#: Fixed values of the projection, for the SQL that checks it.
_B, _D = (", ".join(map(repr, x)) for x in (rings.BETA, rings.DELTA))
_EPSG, _MID, _R = 32734, "radians(21)", repr(rings._R)


def notched(df):
    """Boxes without a corner of a third of their width and half of their height, as rings."""
    cw, ch = F.floor((F.col("x1") - F.col("x0")) / 3), F.floor((F.col("y1") - F.col("y0")) / 2)
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    return df.withColumn("ring", rings.of_points([(x0, y0), (x1, y0), (x1, y1 - ch), (x1 - cw, y1 - ch), (x1 - cw, y1), (x0, y1)]))


@query(f"""{_P}, s AS (SELECT poly_id, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) // 3 AS cw, (y1 - y0) // 2 AS ch FROM predictions),
p AS (SELECT *, sqrt(CAST(cw * cw + ch * ch AS DOUBLE)) AS len, [0, w * cw, w * cw - (h - ch) * ch, (w - cw) * cw - h * ch, -h * ch] AS a, [0, w * ch, w * ch + (h - ch) * cw, (w - cw) * ch + h * cw, h * cw] AS b FROM s),
m AS (SELECT *, (list_max(a) - list_min(a)) / len AS da, (list_max(b) - list_min(b)) / len AS db FROM p),
r AS (SELECT *, round(da * db, 9) < round(CAST(w * h AS DOUBLE), 9) AS slanted FROM m)
SELECT poly_id, CAST(w * h - cw * ch AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, round(CASE WHEN slanted THEN greatest(da, db) / least(da, db) ELSE greatest(w, h) / CAST(least(w, h) AS DOUBLE) END, 6) AS elongation,
  round((w * h - cw * ch) / (w * h - cw * ch / 2.0E0), 6) AS solidity FROM r""")
def b1_geom_props(spark, d):
    """Area, length, elongation by the smallest rectangle and solidity by the hull of rings that aren't convex."""
    p = notched(view(spark, d, "predictions")).select("poly_id", "ring", rings.shape(F.col("ring")).alias("m"))
    ring, m = F.col("ring"), F.col("m")
    return p.select("poly_id", rings.area(ring).alias("area"), rings.perimeter(ring).alias("perimeter"), F.round(rings.elongation(m), 6).alias("elongation"), F.round(rings.solidity(ring, m), 6).alias("solidity"))


def _series(coefficients: str, of: str) -> str:
    return " + ".join(f"{c} * ({of.replace('J', str(2 * j))})" for j, c in enumerate(coefficients.split(", "), 1))


@query(f"""{with_views('predictions', 'task_grid')}, c AS (SELECT poly_id, 500000 + (gx - 20) * 300 + x0 / 10.0E0 AS e, 6250000 + gy * 300 + y0 / 10.0E0 AS n, area FROM predictions JOIN task_grid USING (grid_id)),
k AS (SELECT *, (n - 10000000) / {_R} AS xi, (e - 500000) / {_R} AS eta FROM c), u AS (SELECT *, xi - ({_series(_B, 'sin(J * xi) * cosh(J * eta)')}) AS u, eta - ({_series(_B, 'cos(J * xi) * sinh(J * eta)')}) AS v FROM k),
x AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM u), l AS (SELECT *, degrees({_MID} + atan2(sinh(v), cos(u))) AS lon, degrees(chi + {_series(_D, 'sin(J * chi)')}) AS lat FROM x)
SELECT poly_id, round(lon, 7) AS lon, round(lat, 7) AS lat, round(lon * (pi() / 180 * 6378137.0), 2) AS mx, round(ln(tan(pi() / 4 + lat * (pi() / 360))) * 6378137.0, 2) AS my, round(e, 3) AS back_x, round(n, 3) AS back_y, round(area / 100.0E0, 3) AS back_area FROM l""")
def b3_reproject(spark, d):
    """Rings from a metric zone to degrees, to web Mercator, and back to the zone."""
    cells = view(spark, d, "task_grid").select("grid_id", "gx", "gy")
    p = view(spark, d, "predictions").join(cells, "grid_id")
    zone = F.lit(_EPSG)
    metric = rings.mapped(rings.box_ring(), lambda x, y: (500_000 + (F.col("gx") - 20) * 300 + x / 10, 6_250_000 + F.col("gy") * 300 + y / 10))
    p = p.select("poly_id", metric.alias("metric")).withColumn("degrees", rings.ring_from_utm(F.col("metric"), zone))
    p = p.withColumns({"web": rings.mapped(F.col("degrees"), columns.web_mercator), "back": rings.ring_to_utm(F.col("degrees"), zone)})
    first = lambda c, f, n, name: F.round(F.element_at(c, 1)[f], n).alias(name)
    return p.select("poly_id", first("degrees", "x", 7, "lon"), first("degrees", "y", 7, "lat"), first("web", "x", 2, "mx"), first("web", "y", 2, "my"), first("back", "x", 3, "back_x"), first("back", "y", 3, "back_y"),
        F.round(rings.area(rings.mapped(F.col("back"), lambda x, y: (x - 500_000, y - 6_250_000))), 3).alias("back_area"))


def dented(df, depth):
    """Boxes whose sides are pushed in at their middles by ``depth``, as rings."""
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    return df.withColumn("ring", rings.of_points([(x0, y0), (mx, y0 + depth), (x1, y0), (x1 - depth, my), (x1, y1), (mx, y1 - depth), (x0, y1), (x0 + depth, my)]))


_WOBBLE = "CASE WHEN k > 4 THEN 1.0E0 ELSE (4 * sqrt((w / 2.0E0) * (w / 2.0E0) + k * k) + 4 * sqrt((h / 2.0E0) * (h / 2.0E0) + k * k)) / (2.0E0 * (w + h)) END"


@query(f"{_P} SELECT poly_id, round({_WOBBLE}, 6) AS wobble FROM (SELECT poly_id, x1 - x0 AS w, y1 - y0 AS h, poly_id % 9 AS k FROM predictions)")
def b5_edge_wobble(spark, d):
    p = dented(view(spark, d, "predictions"), F.col("poly_id") % 9)
    return p.select("poly_id", F.round(rings.wobble(F.col("ring"), 4.0), 6).alias("wobble"))


_SIZES = ([4000, 10000], ["small", "medium", "large"])


@query(f"""{_G}, w AS (SELECT source, CASE WHEN area < 4000 THEN 'small' WHEN area < 10000 THEN 'medium' ELSE 'large' END AS size, {_WOBBLE} AS v FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h, gt_id % 9 AS k FROM ground_truth))
SELECT source, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, {', '.join(f"round(quantile_cont(v, 0.5) FILTER (WHERE size = '{s}'), 6) AS {s}" for s in _SIZES[1])} FROM w GROUP BY source""")
def h34_wobble_summary(spark, d):
    """Quartiles of the wobble by source, and its median by source and size."""
    g = dented(view(spark, d, "ground_truth"), F.col("gt_id") % 9)
    w = g.select("source", columns.bucket(F.col("area"), *_SIZES).alias("size"), rings.wobble(F.col("ring"), 4.0).alias("v"))
    return columns.quartiles(w, "source", "size", _SIZES[1], "v")
