"""Queries on hexagons and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators import hexes, nested
from rooftally.plans.registry import query
from rooftally.sources.views import table, view, with_views

#: Side of a hexagon in metres.
SIDE = 200.0


def _hex(name: str, src: str, columns: str, x: str, y: str) -> str:
    """``name``: ``columns`` of ``src`` with q and r of the hexagon of (x, y)."""
    f = f"SELECT {columns}, ({hexes._WIDE!r} * {x} - {hexes._HALF!r} * {y}) / {SIDE} AS fq, ({hexes._HIGH!r} * {y}) / {SIDE} AS fr FROM {src}"
    g = f"SELECT *, floor(fq + 0.5) AS a, floor(fr + 0.5) AS b, floor(-fq - fr + 0.5) AS c FROM ({f})"
    return f"""{name} AS (SELECT {columns}, CAST(CASE WHEN abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c + fq + fr) THEN -b - c ELSE a END AS BIGINT) AS q,
  CAST(CASE WHEN abs(b - fr) > abs(c + fq + fr) AND NOT (abs(a - fq) > abs(b - fr) AND abs(a - fq) > abs(c + fq + fr)) THEN -a - c ELSE b END AS BIGINT) AS r FROM ({g}))"""


_PLANE = "gx * 300 + {x} / 10.0E0"
_LON, _LAT = "(18.4E0 + (gx * 300 + x / 10.0E0) / 92000)", "(-33.9E0 + (gy * 300 + y / 10.0E0) / 111000)"


@query(f"""{with_views('markers', 'task_grid')}, d AS (SELECT marker_id, {_LON} * (pi() / 180 * 6378137.0E0) AS mx, ln(tan(pi() / 4 + {_LAT} * (pi() / 360))) * 6378137.0E0 AS my FROM markers JOIN task_grid USING (grid_id)),
{_hex('h', 'd', 'marker_id', 'mx', 'my')} SELECT * FROM h""")
def h39_hex_keys(spark, d):
    """The hexagon of each marker, from its degrees."""
    m = view(spark, d, "markers").join(view(spark, d, "task_grid").select("grid_id", "gx", "gy"), "grid_id")
    lon, lat = 18.4 + (F.col("gx") * 300 + F.col("x") / 10) / 92000, -33.9 + (F.col("gy") * 300 + F.col("y") / 10) / 111000
    return m.select("marker_id", hexes.key_of_degrees(lon, lat, SIDE).alias("h")).select("marker_id", "h.*")


_XY = {v: f"{v} AS (SELECT t.*, gx * 300 + {x} / 10.0E0 AS px, gy * 300 + {y} / 10.0E0 AS py FROM {src} t JOIN task_grid USING (grid_id))" for v, src, x, y in (("pm", "predictions", "((x0 + x1) / 2.0E0)", "((y0 + y1) / 2.0E0)"), ("um", "units", "x", "y"))}


@query(f"""{with_views('predictions', 'units', 'task_grid')}, {_XY['pm']}, {_XY['um']}, {_hex('ph', 'pm', 'model_run, area', 'px', 'py')}, {_hex('uh', 'um', 'customer_type, centiwatts', 'px', 'py')},
a AS (SELECT model_run, q, r, sum(area) / 100.0E0 AS m2 FROM ph GROUP BY ALL), n AS (SELECT a.model_run, a.q, a.r, a.m2, sum(coalesce(b.m2, 0)) AS around FROM (SELECT *, unnest([{', '.join(f'{{q: {q}, r: {r}}}' for q, r in hexes.AROUND)}]) AS s FROM a) a LEFT JOIN a b ON b.model_run = a.model_run AND b.q = a.q + a.s.q AND b.r = a.r + a.s.r GROUP BY ALL),
k AS (SELECT customer_type, q, r, sum(centiwatts) / 100000.0E0 AS kw FROM uh GROUP BY ALL), j AS (SELECT * FROM n JOIN k USING (q, r)),
f AS ({' UNION ALL '.join(f"SELECT model_run, customer_type, '{n}' AS population, CAST(count(*) AS BIGINT) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2 FROM j WHERE {w} GROUP BY model_run, customer_type" for n, y, x, w in (('all', 'kw', 'm2', 'true'), ('dense', 'kw', 'm2', 'around > m2 * 3'), ('log', 'ln(kw)', 'ln(m2)', 'kw > 0 AND m2 > 0')))})
SELECT model_run, customer_type, population, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2 FROM f WHERE n > 2""")
def h39_area_to_kw_fits(spark, d):
    """Power over detected area by hexagon, for each run and customer type: all hexagons, those with more around than in them, and logarithms."""
    cells = view(spark, d, "task_grid").select("grid_id", "gx", "gy")
    at = lambda df, x, y: df.join(cells, "grid_id").withColumn("h", hexes.key(F.col("gx") * 300 + x / 10, F.col("gy") * 300 + y / 10, SIDE))
    p, u = view(spark, d, "predictions"), view(spark, d, "units")
    p = at(p, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2).groupBy("model_run", "h").agg((F.sum("area") / 100).alias("m2"))
    p = hexes.sums_around(p, ["model_run"], "h", "m2", "around")
    u = at(u, F.col("x"), F.col("y")).groupBy("customer_type", "h").agg((F.sum("centiwatts") / 100000).alias("kw"))
    fits = hexes.fits(p.join(u, "h"), ["model_run", "customer_type"], "m2", "kw", {"all": (F.lit(True), False), "dense": (F.col("around") > F.col("m2") * 3, False), "log": (F.lit(True), True)})
    return fits.where("n > 2").select("model_run", "customer_type", "population", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


_JSON = """concat('{"run": {"id": ', CAST(event_id AS {text}), ', "tags": ["', event_type, '", {"by": [', CAST(user_id AS {text}), ', null]}]}, "props": ', props, ', "none": {}, "list": [], "ok": true}')"""


@query(f"""WITH e AS (SELECT event_id, CAST({_JSON.replace('{text}', 'VARCHAR')} AS JSON) AS doc FROM events), t AS (SELECT event_id, j.fullkey, j.type, j.atom, CAST(j.value AS VARCHAR) AS text FROM e, json_tree(doc) j)
SELECT event_id, regexp_replace(regexp_replace(substr(fullkey, 3), '\\[([0-9]+)\\]', '.\\1', 'g'), '"', '', 'g') AS path, CASE WHEN type IN ('OBJECT', 'ARRAY') THEN text WHEN type = 'NULL' THEN NULL ELSE json_extract_string(CAST(atom AS JSON), '$') END AS value FROM t WHERE type NOT IN ('OBJECT', 'ARRAY') OR text IN ('{{}}', '[]')""")
def b17_json_flatten(spark, d):
    """Nested objects and arrays as rows of a dotted key and a value."""
    e = table(spark, d, "events").select("event_id", F.expr(_JSON.replace("{text}", "STRING")).alias("doc"))
    return nested.flattened(e, ["event_id"], "doc")
