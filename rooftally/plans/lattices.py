"""Queries on lattices over a region's plane, in which its cells of 300 m lie side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from rooftally.operators import lattice, rings
from rooftally.plans.area import slab
from rooftally.plans.polygons import notched
from rooftally.plans.registry import query
from rooftally.sources.views import view, with_views

SIZE, ORIGIN = 1700.0, (-500.0, 250.0)
_I, _J = (f"CAST(floor(({{{a}}} - ({o})) / {SIZE}) AS BIGINT)" for a, o in zip("xy", ORIGIN))
#: Coverage of each cell: its western part; the parts of a region don't overlap.
_COVER = "cover AS (SELECT region, CAST(gx * 3000 AS DOUBLE) AS x0, CAST(gy * 3000 AS DOUBLE) AS y0, gx * 3000 + 3000 * coverage_fraction AS x1, CAST(gy * 3000 + 3000 AS DOUBLE) AS y1 FROM task_grid)"


def _cut(name: str, src: str) -> str:
    """``name``: the boxes of ``src`` (region, x0, y0, x1, y1) cut at the lattice, with i and j."""
    return f"""{name}_c AS (SELECT *, unnest(range({_I.format(x='x0')}, {_I.format(x='x1')} + 1)) AS i FROM {src}), {name}_d AS (SELECT *, unnest(range({_J.format(y='y0')}, {_J.format(y='y1')} + 1)) AS j FROM {name}_c),
{name} AS (SELECT * FROM (SELECT region, i, j, greatest(x0, {ORIGIN[0]} + i * {SIZE}) AS x0, least(x1, {ORIGIN[0]} + (i + 1) * {SIZE}) AS x1, greatest(y0, {ORIGIN[1]} + j * {SIZE}) AS y0, least(y1, {ORIGIN[1]} + (j + 1) * {SIZE}) AS y1 FROM {name}_d) WHERE x1 > x0 AND y1 > y0)"""


_GRID = f"""{_COVER}, {_cut('parts', 'cover')}, sh AS (SELECT region, i, j, sum((x1 - x0) * (y1 - y0)) / ({SIZE} * {SIZE}) AS share FROM parts GROUP BY ALL),
cells AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY j DESC, i) AS BIGINT) AS no FROM sh WHERE round(share, 9) >= 0.25)"""


def _coverage(spark, d):
    g = view(spark, d, "task_grid")
    left, low = F.col("gx") * 3000, F.col("gy") * 3000
    right = left + 3000 * F.col("coverage_fraction")
    return g.select("region", rings.of_points([(left, low), (right, low), (right, low + 3000), (left, low + 3000)]).alias("ring"))


def _cells(spark, d):
    return lattice.task_grid(_coverage(spark, d), ["region"], SIZE, ORIGIN)


@query(f"{with_views('task_grid')}, {_GRID} SELECT region, i, j, no, {ORIGIN[0]} + i * {SIZE} AS x0, {ORIGIN[1]} + (j + 1) * {SIZE} AS y1, round(share, 6) AS share FROM cells")
def m1_build_task_grid(spark, d):
    """Cells of 170 m, off the other grid, of which coverage holds a quarter at least."""
    return _cells(spark, d).select("region", "i", "j", "no", "x0", "y1", F.round("share", 6).alias("share"))


def _moved(spark, d, name, *points):
    """A view in its region's plane: columns in ``points`` (x or y) moved by the cell's place."""
    cells = view(spark, d, "task_grid").select("grid_id", F.col("region").alias("_region"), "gx", "gy")
    rows = view(spark, d, name).join(cells, "grid_id")
    return rows.withColumns({"region": F.col("_region")} | {c: F.col(c) + F.col("gx" if c[0] == "x" else "gy") * 3000 for c in points})


_UNIT = f"un AS (SELECT t.region, customer_type, {_I.format(x='(x + gx * 3000)')} AS i, {_J.format(y='(y + gy * 3000)')} AS j FROM units JOIN task_grid t USING (grid_id))"
_PLANE = "(SELECT t.region, {x0} + gx * 3000 AS x0, {y0} + gy * 3000 AS y0, {x1} + gx * 3000 AS x1, {y1} + gy * 3000 AS y1 FROM {src} JOIN task_grid t USING (grid_id) WHERE {where})"
#: The two boxes that a ring is.
_G2 = " UNION ALL ".join(_PLANE.format(x0="x0", y0=a, x1=b, y1=c, src="ground_truth", where="true") for a, b, c in (("y0", "x1", "y1 - (y1 - y0) // 2"), ("y1 - (y1 - y0) // 2", "x1 - (x1 - x0) // 3", "y1")))


@query(f"""{with_views('task_grid', 'units', 'ground_truth')}, {_GRID}, {_UNIT}, gb AS ({_G2}), {_cut('gc', 'gb')}, {slab('gu', 'gc', 'region, i, j')}, n AS (SELECT region, i, j, count(*) AS n FROM un GROUP BY ALL),
r AS (SELECT region, i, j, round(share, 6) AS share, coalesce(n, 0) AS n_buildings, coalesce(union_area, 0) / ({SIZE} * {SIZE}) AS imagery FROM cells LEFT JOIN n USING (region, i, j) LEFT JOIN gu USING (region, i, j))
SELECT region, i, j, share, CAST(n_buildings AS BIGINT) AS n_buildings, round(imagery, 3) AS imagery, CASE WHEN n_buildings = 0 THEN 'skip' WHEN imagery >= 0.08 THEN 'full' WHEN imagery >= 0.03 THEN 'partial' ELSE 'aerial_needed' END AS plan FROM r""")
def m2_admin_grid(spark, d):
    """The lattice's cells with their buildings and what footprints cover of them, which stand for imagery."""
    g = notched(_moved(spark, d, "ground_truth", "x0", "y0", "x1", "y1"))
    rows = lattice.planned(_cells(spark, d), g, _moved(spark, d, "units", "x", "y"), ["region"], SIZE, ORIGIN, full=0.08, partial=0.03)
    return rows.select("region", "i", "j", F.round("share", 6).alias("share"), "n_buildings", F.round("imagery", 3).alias("imagery"), "plan")


@query(f"""{with_views('task_grid', 'units', 'ground_truth')}, {_GRID}, {_UNIT}, gb AS ({_G2}), {_cut('gc', 'gb')}, {slab('gu', 'gc', 'region, i, j')}, n AS (SELECT region, i, j, count(*) AS n, avg(CASE WHEN customer_type = 'industrial' THEN 1.0E0 ELSE 0.0E0 END) AS works FROM un GROUP BY ALL),
r AS (SELECT region, i, j, coalesce(n, 0) AS n, coalesce(works, 0) AS works, round(coalesce(union_area, 0) / ({SIZE} * {SIZE} * share), 6) AS density FROM cells LEFT JOIN n USING (region, i, j) LEFT JOIN gu USING (region, i, j)),
q AS (SELECT region, quantile_cont(density, 0.75) AS hi, min({{n: -n, i: i, j: j}}) AS core FROM r GROUP BY region)
SELECT region, i, j, density, CASE WHEN works >= 0.3 THEN 'industrial' WHEN density >= hi THEN 'dense' ELSE 'residential' END AS stratum, CAST((i - core.i) * (i - core.i) + (j - core.j) * (j - core.j) AS BIGINT) AS core_dist2, round(density / nullif(hi, 0), 4) AS score FROM r JOIN q USING (region)""")
def m9_region_strata(spark, d):
    """Strata of the lattice's cells by what footprints cover of their covered part, industrial units, and the distance to the cell of most units."""
    i, j = lattice.cell_of(F.col("x"), F.col("y"), SIZE, ORIGIN)
    u = _moved(spark, d, "units", "x", "y").groupBy("region", i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"), F.avg((F.col("customer_type") == "industrial").cast("double")).alias("works"))
    g = lattice.covered(notched(_moved(spark, d, "ground_truth", "x0", "y0", "x1", "y1")), ["region"], SIZE, ORIGIN).withColumnRenamed("share", "built")
    rows = _cells(spark, d).join(u, ["region", "i", "j"], "left").join(g, ["region", "i", "j"], "left").na.fill(0, ["n", "works", "built"])
    rows = rows.withColumn("density", F.round(F.col("built") / F.col("share"), 6))
    return lattice.strata(rows, ["region"], "density", "works", "n").select("region", "i", "j", "density", "stratum", "core_dist2", F.round("score", 4).alias("score"))
