"""Round-based steps against the one-by-one loops that they stand for."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rooftally.operators import graph, matching, spatial

KEYS = ["grid_id"]


def boxes(n, seed, name):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, w, h = rng.randrange(400), rng.randrange(400), rng.randrange(20, 120), rng.randrange(20, 120)
        rows.append({"grid_id": i % 3, name: i, "x0": x, "y0": y, "x1": x + w, "y1": y + h, "area": w * h, "confidence": rng.randrange(5, 10) / 10})
    return rows


def inter(a, b):
    return max(0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) * max(0, min(a["y1"], b["y1"]) - max(a["y0"], b["y0"]))


def iou(a, b):
    i = inter(a, b)
    return i / (a["area"] + b["area"] - i)


def covered(box, others):
    cells = set()
    for o in others:
        cells |= {(x, y) for x in range(max(box["x0"], o["x0"]), min(box["x1"], o["x1"])) for y in range(max(box["y0"], o["y0"]), min(box["y1"], o["y1"]))}
    return len(cells)


@pytest.fixture(scope="module")
def sides(spark):
    g, p = boxes(60, 1, "gt_id"), boxes(140, 2, "poly_id")
    return g, p, spark.createDataFrame(g), spark.createDataFrame(p)


def test_union_area(sides):
    _, p, _, dp = sides
    got = {r.grid_id: r.union_area for r in spatial.union_area(dp, KEYS).collect()}
    whole = {"x0": -1, "y0": -1, "x1": 1000, "y1": 1000}
    assert got == {k: covered(whole, [b for b in p if b["grid_id"] == k]) for k in range(3)}


def test_strict_matching(sides):
    g, p, dg, dp = sides
    edges = sorted((-iou(a, b), a["gt_id"], b["poly_id"]) for a in g for b in p if a["grid_id"] == b["grid_id"] and iou(a, b) >= 0.2)
    used_g, used_p, want = set(), set(), set()
    for _, a, b in edges:
        if a not in used_g and b not in used_p:
            used_g.add(a), used_p.add(b), want.add((a, b))
    assert {(r.gt_id, r.poly_id) for r in matching.match_strict(dg, dp, KEYS, 0.2).collect()} == want


def test_matching_by_confidence(sides):
    g, p, dg, dp = sides
    used, want = set(), set()
    for b in sorted(p, key=lambda b: (-b["confidence"], b["poly_id"])):
        free = [(-iou(a, b), a["gt_id"]) for a in g if a["grid_id"] == b["grid_id"] and a["gt_id"] not in used and iou(a, b) >= 0.2]
        if free:
            used.add(min(free)[1])
            want.add((min(free)[1], b["poly_id"]))
    assert {(r.gt_id, r.poly_id) for r in matching.match_by_confidence(dg, dp, KEYS, 0.2).collect()} == want


def test_merged_matching(sides):
    g, p, dg, dp = sides
    rows = []
    for a in g:
        near = [b for b in p if b["grid_id"] == a["grid_id"] and a["x0"] <= b["x1"] and b["x0"] <= a["x1"] and a["y0"] <= b["y1"] and b["y0"] <= a["y1"]]
        if near:
            i = covered(a, near)
            u = covered({"x0": -1, "y0": -1, "x1": 1000, "y1": 1000}, near)
            rows.append((-i / (u + a["area"] - i), a["gt_id"], {b["poly_id"] for b in near}))
    used, want = set(), set()
    for v, a, near in sorted(rows, key=lambda r: r[:2]):
        if -v >= 0.1 and near - used:
            want.add(a)
            used |= near
    accepted, hit = matching.match_merged(dg, dp, KEYS, 0.1)
    assert {r.gt_id for r in accepted.collect()} == want
    assert {r.poly_id for r in hit.collect()} == used


def test_suppression(sides):
    _, p, _, dp = sides
    kept = []
    for b in sorted(p, key=lambda b: (-b["confidence"], b["poly_id"])):
        if not any(k["grid_id"] == b["grid_id"] and iou(k, b) > 0.2 for k in kept):
            kept.append(b)
    assert {r.poly_id for r in matching.nms_score(dp, KEYS, 0.2).collect()} == {b["poly_id"] for b in kept}
    keep = {b["poly_id"]: True for b in p}
    for i, a in enumerate(p):
        if keep[i]:
            for b in p[i + 1 :]:
                if keep[b["poly_id"]] and a["grid_id"] == b["grid_id"] and iou(a, b) > 0.2:
                    if a["area"] >= b["area"]:
                        keep[b["poly_id"]] = False
                    else:
                        keep[i] = False
                        break
    assert {r.poly_id for r in matching.nms_area(dp, KEYS, 0.2).collect()} == {k for k, v in keep.items() if v}


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_nearest_and_neighbours(spark):
    rng = random.Random(3)
    a = [(i % 2, i, rng.randrange(3000), rng.randrange(3000)) for i in range(80)]
    b = [(0, i, rng.randrange(3000), rng.randrange(3000)) for i in range(12)]
    da, db = spark.createDataFrame(a, "grid_id long, id long, x long, y long"), spark.createDataFrame(b, "grid_id long, t long, x long, y long")
    got = {r.id: (r.dist2, r.target) for r in spatial.nearest(da, db, KEYS, "id", "t").collect()}
    for k, i, x, y in a:
        near = [((x - u) ** 2 + (y - v) ** 2, t) for g, t, u, v in b if g == k]
        assert got[i] == (min(near) if near else (None, None))
    counts = {r.id: r.n_near for r in spatial.neighbour_counts(da, KEYS, "id", 500).collect()}
    assert counts == {i: sum((x - u) ** 2 + (y - v) ** 2 <= 250_000 for g, j, u, v in a if g == k and j != i) for k, i, x, y in a}


def test_box_join_once(spark):
    one = spark.createDataFrame([(0, 0, 0, 1000, 1000)], "grid_id long, x0 long, y0 long, x1 long, y1 long")
    assert spatial.box_join(one, one, KEYS).select(F.count("*"), F.sum("inter")).first()[:] == (1, 1_000_000)
    touching = spark.createDataFrame([(0, 1000, 0, 1100, 50)], one.schema)
    assert spatial.box_join(one, touching, KEYS).count() == 0
    assert spatial.box_join(one, touching, KEYS, closed=True).count() == 1


def test_components_of_a_long_path(spark):
    ids = list(range(1000))
    random.Random(2).shuffle(ids)
    got = graph.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"), "a", "b").collect()
    assert {r.node: r.label for r in got} == dict.fromkeys(ids, 0)


def test_components_of_a_long_path_with_its_start_at_the_far_end(spark):
    n = 5000
    path = [0, *range(n, 0, -1)]
    started, cuts = time.time(), []
    kept = graph.cut
    graph.cut = lambda *df: cuts.append(1) or kept(*df)
    try:
        got = graph.components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long"), "a", "b").collect()
    finally:
        graph.cut = kept
    assert {r.label for r in got} == {0} and len(got) == n + 1
    assert len(cuts) <= 2 + 20 and time.time() - started < 120  # one cut a round


@pytest.fixture(params=[(1, 200_000), (1, 0)], ids=["folds", "rounds to the end"])
def ways(request, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", request.param[0])
    monkeypatch.setattr(graph, "FOLD", request.param[1])


def test_all_ways_give_the_same(spark, ways):
    g, p = boxes(60, 1, "gt_id"), boxes(140, 2, "poly_id")
    sides = g, p, spark.createDataFrame(g), spark.createDataFrame(p)
    test_strict_matching(sides)
    test_matching_by_confidence(sides)
    test_merged_matching(sides)
    test_suppression(sides)


def test_a_row_of_a_thousand_tied_boxes(spark):
    row = [{"grid_id": 1, "poly_id": i, "x0": i * 10, "y0": 0, "x1": i * 10 + 16, "y1": 10, "area": 160, "confidence": 0.5} for i in range(1000)]
    p = spark.createDataFrame(row)
    assert {r.poly_id for r in matching.nms_score(p, KEYS, 0.2).collect()} == set(range(0, 1000, 2))
    g = p.withColumnRenamed("poly_id", "gt_id").withColumn("x0", F.col("x0") + 3).withColumn("x1", F.col("x1") + 3)
    assert {(r.gt_id, r.poly_id) for r in matching.match_strict(g, p, KEYS, 0.1).collect()} == {(i, i) for i in range(1000)}
    accepted, _ = matching.match_merged(g, p, KEYS, 0.1)
    free, want = set(range(1000)), set()
    rows = []
    for i in range(1000):
        own = [j for j in range(1000) if j * 10 <= i * 10 + 19 and i * 10 + 3 <= j * 10 + 16]
        whole = 10 * (max(own) * 10 + 16 - min(own) * 10)
        inside = 10 * (min(max(own) * 10 + 16, i * 10 + 19) - max(min(own) * 10, i * 10 + 3))
        rows.append((-inside / (whole + 160 - inside), i, own))
    for v, i, own in sorted(rows, key=lambda r: r[:2]):
        if -v >= 0.1 and free & set(own):
            want.add(i)
            free -= set(own)
    assert {r.gt_id for r in accepted.collect()} == want


def test_clusters_of_ids_near_the_end_of_a_long(spark):
    """A box's number among both sides is a multiple of its id, which a long doesn't hold from some 20 times the larger tables on."""
    top = 7 * 10**18
    side = lambda rows, name: spark.createDataFrame(rows, f"k long, {name} long, x0 long, y0 long, x1 long, y1 long").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    g = side([(1, top, 0, 0, 10, 10), (1, top + 1, 100, 0, 110, 10), (1, 3, 200, 0, 210, 10)], "gt_id")
    p = side([(1, top, 5, 0, 15, 10), (1, top + 1, 100, 0, 110, 10), (1, 5, 400, 0, 410, 10)], "poly_id")
    nodes = matching.clusters(g, p, ["k"])
    rows = nodes.groupBy("component").agg(F.count_if(F.col("side") == "g").alias("g"), F.count_if(F.col("side") == "p").alias("p")).collect()
    assert sorted((r.g, r.p) for r in rows) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert {r.component for r in rows} >= {6, 11}  # 2 * 3 and 2 * 5 + 1


def test_wide_numbers_stay_apart(spark):
    top = 2**62
    ids = spark.createDataFrame([(5,), (top + 5,), (2**63 - 1,)], "id long")
    rows = ids.select("id", graph.wide(F.col("id"), 4, 1).alias("w")).withColumn("l", graph.as_long(F.col("w"))).collect()
    assert [int(r.w) for r in rows] == [4 * r.id + 1 for r in rows]
    assert [r.l for r in rows] == [(int(r.w) + 2**63) % 2**64 - 2**63 for r in rows]
    nodes = ids.withColumn("node", graph.wide(F.col("id"), 4, 0))
    edges = spark.createDataFrame([(5, 2**63 - 1)], "a long, b long").select(graph.wide(F.col("a"), 4, 0).alias("a"), graph.wide(F.col("b"), 4, 0).alias("b"))
    assert {r.id: int(r.component) for r in graph.with_component(nodes, edges, "node", "a", "b").collect()} == {5: 20, 2**63 - 1: 20, top + 5: 4 * (top + 5)}


def test_matching_goes_through_keys_in_one_pass(spark, monkeypatch):
    """No rounds for keys of few edges; the keys beyond FOLD go in rounds beside them, with the same result."""
    g, p = boxes(60, 1, "gt_id"), boxes(140, 2, "poly_id")
    g, p = [r | {"grid_id": r["gt_id"] % 9 // 4} for r in g], [r | {"grid_id": r["poly_id"] % 9 // 4} for r in p]
    sides = g, p, spark.createDataFrame(g), spark.createDataFrame(p)
    calls, matched, merged = [], graph._matched, graph._merged
    monkeypatch.setattr(graph, "_matched", lambda *a, **k: calls.append(1) or matched(*a, **k))
    monkeypatch.setattr(graph, "_merged", lambda *a, **k: calls.append(1) or merged(*a, **k))
    for fold, rounds in ((200_000, False), (60, True)):
        monkeypatch.setattr(graph, "FOLD", fold)
        calls.clear()
        for test in (test_strict_matching, test_matching_by_confidence, test_merged_matching):
            test(sides)
        assert bool(calls) == rounds


def test_components_inside_keys(spark, monkeypatch):
    """As without keys, also where nodes are in several keys or keys have more edges than a task takes; in one pass where neither is so."""
    rng = random.Random(4)
    inside = [(k, 100 * k + rng.randrange(100), 100 * k + rng.randrange(100)) for k in range(6) for _ in range(40)]
    across = inside + [(rng.randrange(6), rng.randrange(600), rng.randrange(600)) for _ in range(30)]
    rounds, plain = [], graph.components
    for rows, fold, whole in ((inside, 200_000, True), (inside, 10, False), (across, 200_000, False), (across + [(None, 5, 7)], 40, False)):
        df = spark.createDataFrame(rows, "k long, a long, b long")
        want = {(r.node, r.label) for r in plain(df, "a", "b").collect()}
        monkeypatch.setattr(graph, "components", lambda *a: rounds.append(1) or plain(*a))
        monkeypatch.setattr(graph, "FOLD", fold)
        rounds.clear()
        got = graph.components_inside(df, ["k"], "a", "b").collect()
        assert len(got) == len(want) and {(r.node, r.label) for r in got} == want and bool(rounds) != whole
        monkeypatch.undo()
    assert graph.components_inside(df.limit(0), ["k"], "a", "b").count() == 0
