"""Keyed joins on hand-made rows: nulls, ties, repeated rows, empty tables, extra columns."""

from pyspark.sql import functions as F

from rooftally.operators import joins


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_decisions_by_levels(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b"), (None, 1, "c"), (3, 9, "d"), (3, 9, "d")], "grid int, pred int, extra string")
    d = spark.createDataFrame([(1, 1, 5), (1, 1, 3), (1, 7, 8), (9, 2, 6), (9, 1, 4), (None, 1, 99)], "grid int, pred int, event int")
    got = joins.decision_join(t, d, [("exact", ["grid", "pred"], F.lit(True)), ("image", ["pred"], F.col("event") < 50), ("grid", ["grid"], F.lit(True))], "event")
    assert rows(got, "grid", "pred", "extra", "event", "matched_by") == sorted([(1, 1, "a", 5, "exact"), (1, 2, "a", 6, "image"), (2, 1, "b", 5, "image"), (None, 1, "c", 5, "image"), (3, 9, "d", None, "none"), (3, 9, "d", None, "none")], key=str)
    assert joins.decision_join(t.limit(0), d, [("grid", ["grid"], F.lit(True))], "event").count() == 0
    assert rows(joins.decision_join(t, d.limit(0), [("grid", ["grid"], F.lit(True))], "event").distinct(), "matched_by") == [("none",)] * 5


def test_reviews_that_abstain_go(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    d = spark.createDataFrame([(1, True, 1), (1, False, 2), (2, True, 1), (2, None, 2), (None, True, 1)], "k int, v boolean, e int")
    assert rows(joins.review_join(t, d, ["k"], "v", "e"), "k", "v") == [(1, False)]


def test_crosswalk_and_layers(spark):
    a = spark.createDataFrame([("L1", 5, 1), ("L1", 3, 1), ("L1", 9, 0), ("L2", 4, 1), (None, 1, 0)], "old string, new int, tier int")
    assert rows(joins.crosswalk(a, "old", "new", "tier"), "old", "new", "tier", "ambiguous") == sorted([("L1", 9, 0, True), ("L2", 4, 1, False), (None, 1, 0, False)], key=str)
    cells = spark.createDataFrame([(1,), (1,), (2,), (3,)], "cell int")
    layers = spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "c", 0), (2, "z", None), (2, "y", 2), (None, "x", 0)], "cell int, layer string, prio int")
    got = joins.resolve_layer(cells, layers, "cell", "layer", "prio")
    assert rows(got, "cell", "layer", "n_layers") == [(1, "c", 3), (2, "y", 2), (3, "none", 0)]


def test_fills_and_sides(spark):
    cells = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "k int, n_extra string")
    counts = spark.createDataFrame([(1, 0, 7), (4, 1, 1), (None, 3, 3)], "k int, n int, area int")
    assert rows(joins.left_join_fill(cells, counts, ["k"], ["n", "area"]), "k", "n", "area", "status") == sorted([(1, 0, 7, "ok"), (2, 0, 0, "not_reached"), (None, 0, 0, "not_reached")], key=str)
    a, b = spark.createDataFrame([(1, 5), (2, None), (None, 1)], "k int, cw int"), spark.createDataFrame([(1, 6), (3, 7), (None, 2)], "k int, area int")
    assert rows(joins.both_sides(a, b, ["k"], "cw", "area"), "k", "cw", "area", "side") == sorted([(1, 5, 6, "both"), (2, 0, 0, "truth_only"), (3, 0, 7, "predicted_only"), (None, 1, 0, "truth_only"), (None, 0, 2, "predicted_only")], key=str)


def test_bounds_leaks_and_lists(spark):
    b = spark.createDataFrame([("a", 0, 0, 5, 5), ("a", 4, 4, 10, 9), ("b", -1, 0, 5, 5)], "k string, x0 int, y0 int, x1 int, y1 int")
    assert rows(joins.bounds_inside(b, ["k"], 0, 10), "k", "inside", "x1") == [("a", True, 10), ("b", False, 5)]
    cells, pool = spark.createDataFrame([(1, "leaks?"), (2, ""), (None, "")], "k int, name string"), spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(joins.leaks(cells, pool, ["k"]), "k", "leaks") == sorted([(1, True), (2, False), (None, False)], key=str)
    names = spark.createDataFrame([("g1",), ("g2",), ("h1",), (None,)], "name string")
    assert rows(joins.without_listed(names, "name", names.where("name = 'g2'"), ["^h"]), "name") == sorted([("g1",), (None,)], key=str)
    assert joins.without_listed(names, "name", names.limit(0), []).count() == 4


def test_accepted_and_manifest(spark):
    p = spark.createDataFrame([("r", 1, "ok"), ("r", 2, "no"), ("r", 3, None)], "run string, item int, s string")
    g = spark.createDataFrame([(1, "new"), (9, "old")], "item int, s string")
    assert rows(joins.accepted([(p, F.col("s") == "ok", "reviewed"), (g, F.col("s") == "new", "added")], ["run", "item"]), "run", "item", "origin") == sorted([("r", 1, "reviewed"), (None, 1, "added")], key=str)
    one, two = spark.createDataFrame([(1, 10, "b"), (1, 10, "a"), (2, 20, "a")], "cell int, item int, p string"), spark.createDataFrame([(1, 10, "pred"), (3, 30, "pred"), (None, 40, None)], "cell int, item int, p string")
    got = joins.pool_manifest([one, two], ["cell"], "item", "p", ["a"], spark.createDataFrame([(3,), (3,)], "cell int"), "cell")
    assert rows(got, "item", "cell", "p", "trust", "shares_cell") == sorted([(10, 1, "a", "trusted", False), (20, 2, "a", "trusted", False), (30, 3, "pred", "untrusted", True), (40, None, None, "untrusted", False)], key=str)


def test_votes_and_coverage(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 500, 500, 510, 510), (2, 3, 0, 0, 10, 10)], "g int, id int, x0 long, y0 long, x1 long, y1 long")
    points = spark.createDataFrame([(1, "b", 5, 5), (1, "a", 12, 10), (1, "a", 100, 100), (1, None, 5, 5), (1, None, 6, 5)], "g int, label string, x long, y long")
    assert rows(joins.vote_near(boxes, points, ["g"], "id", "label", 3, "none"), "id", "vote") == [(1, "a"), (2, "none"), (3, "none")]
    units = spark.createDataFrame([(1, "r", 5), (2, "r", 7), (3, "s", None)], "k int, run string, cw int")
    hits = spark.createDataFrame([(1, "r"), (1, "r"), (3, "r")], "k int, run string")
    assert rows(joins.coverage_by(units, hits, ["k", "run"], ["run"], "cw"), "run", "covered", "uncovered", "n_cells", "n_covered") == [("r", 5, 7, 2, 1), ("s", 0, 0, 1, 0)]
