"""Lattices of any size and origin over rings."""

import pytest
from pyspark.sql import functions as F

from rooftally.operators import lattice, rings

SCHEMA = f"k string, ring {rings.RING}"


def square(x, y, w, h):
    return [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def test_shares_numbers_and_the_least_share(spark):
    triangle = [(0.0, 0.0), (20.0, 0.0), (0.0, 20.0)]
    rows = [("a", square(0, 0, 30, 10)), ("a", square(5, 0, 30, 10)), ("a", square(0, 10, 5, 5)), ("b", triangle), ("b", triangle), (None, square(-12, -12, 5, 5)), ("c", None), ("c", [])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.k, r.i, r.j): r.share for r in lattice.covered(df, ["k"], 10).collect()}
    assert got == pytest.approx({("a", 0, 0): 1, ("a", 1, 0): 1, ("a", 2, 0): 1, ("a", 3, 0): 0.5, ("a", 0, 1): 0.25, ("b", 0, 0): 1, ("b", 1, 0): 0.5, ("b", 0, 1): 0.5, (None, -1, -1): 0.09, (None, -2, -2): 0.04, (None, -1, -2): 0.06, (None, -2, -1): 0.06})
    grid = {(r.k, r.no): (r.i, r.j, r.x0, r.y1) for r in lattice.task_grid(df, ["k"], 10, least=0.25).collect()}
    assert grid == {("a", 1): (0, 1, 0, 20), ("a", 2): (0, 0, 0, 10), ("a", 3): (1, 0, 10, 10), ("a", 4): (2, 0, 20, 10), ("a", 5): (3, 0, 30, 10), ("b", 1): (0, 1, 0, 20), ("b", 2): (0, 0, 0, 10), ("b", 3): (1, 0, 10, 10)}
    moved = {(r.i, r.j): r.share for r in lattice.covered(df.where("k = 'b'"), ["k"], 40, (-20, -20)).collect()}
    assert moved == pytest.approx({(0, 0): 200 / 1600})
    assert lattice.task_grid(df.limit(0), ["k"], 10).count() == 0


def test_plans_and_strata(spark):
    cells = lattice.task_grid(spark.createDataFrame([("a", square(0, 0, 40, 10))], SCHEMA), ["k"], 10)
    imagery = spark.createDataFrame([("a", square(0, 0, 14, 10)), ("a", square(0, 0, 9, 9))], SCHEMA)
    buildings = spark.createDataFrame([("a", 1.0, 1.0), ("a", 10.0, 0.0), ("a", 25.0, 5.0), ("b", 35.0, 1.0)], "k string, x double, y double")
    rows = lattice.planned(cells, imagery, buildings, ["k"], 10)
    assert {r.i: (r.plan, r.n_buildings, round(r.imagery, 6)) for r in rows.collect()} == {0: ("full", 1, 1), 1: ("partial", 1, 0.4), 2: ("aerial_needed", 1, 0), 3: ("skip", 0, 0)}
    told = lattice.strata(rows.withColumn("works", F.when(F.col("i") == 2, 0.5).otherwise(0.0)), ["k"], "imagery", "works", "n_buildings")
    assert {r.i: (r.stratum, r.core_dist2) for r in told.collect()} == {0: ("dense", 0), 1: ("residential", 1), 2: ("industrial", 4), 3: ("residential", 9)}
