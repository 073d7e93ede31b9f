"""Areas of unions of boxes against a raster."""

import numpy as np
from pyspark.sql import functions as F

from rooftally.operators import matching, spatial


def test_union_areas_of_crowded_and_sparse_keys(spark):
    """A bucket of some thousand boxes is no more than its raster: it isn't copied for each slab. Many layers, coordinates below 0, null keys and empty boxes."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, n, reach, far in (("sparse", 40, 3000, 2500), (None, 15, 900, -3000), ("crowded", 4000, 180, 10)):
        x0, y0 = rng.integers(0, reach, (2, n)) + far
        x1, y1 = x0 + rng.integers(0, 60, n), y0 + rng.integers(0, 60, n)
        score = rng.integers(0, 30, n)
        raster = np.zeros((3100, 3100), np.int8)
        for a, b, c, d, s in zip(x0 - far, y0 - far, x1 - far, y1 - far, score):
            raster[a:c, b:d] = np.maximum(raster[a:c, b:d], s + 1)
        want[key] = [int((raster > t).sum()) for t in range(30)]
        rows += [(key, *map(int, r)) for r in zip(x0, y0, x1, y1, score)]
    df = spark.createDataFrame(rows * 2, "k string, x0 long, y0 long, x1 long, y1 long, score int")
    plan = spatial.union_areas(df, ["k"], {f"a{t}": F.col("score") >= t for t in range(30)})
    assert {r[0]: list(r[1:]) for r in plan.collect()} == want
    assert not spatial.union_areas(df.where("x1 <= x0"), ["k"], {"a": F.lit(True)}).collect()


def test_a_bucket_is_one_row(spark):
    """What is shuffled is a row a bucket; slabs aren't rows of the plan."""
    df = spark.createDataFrame([("k", 0, 0, 5, 5)], "k string, x0 long, y0 long, x1 long, y1 long")
    plan = spatial.union_area(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "MapInArrow" in plan


def test_cover_of_ground_truth_in_one_pass(spark):
    """Union of what touches a box and its part inside, for several rules at once, against a raster; pairs are found once and written, so they aren't joined again."""
    rng = np.random.default_rng(5)
    side = lambda n, first: [(k % 2, first + k, *map(int, (a, b, a + w, b + h)), int(w * h), float(c)) for k, (a, b, w, h, c) in enumerate(zip(*rng.integers(-300, 300, (2, n)), *rng.integers(1, 120, (2, n)), rng.integers(5, 11, n) / 10))]
    gt, pred = side(30, 0), [*side(60, 100), (0, 200, 5000, 5000, 5010, 5010, 100, 0.9)]
    gt.append((0, 99, 5010, 5000, 5020, 5010, 100, 0.9))  # touches 200, which covers nothing of it
    frame = lambda rows, name: spark.createDataFrame(rows, f"k long, {name} long, x0 long, y0 long, x1 long, y1 long, area long, confidence double")
    want, touch = {}, set()
    for k, i, a, b, c, d, area, _ in gt:
        near = [r for r in pred if r[0] == k and r[2] <= c and a <= r[4] and r[3] <= d and b <= r[5]]
        touch |= {(k, i, r[1]) for r in near}
        found = []
        for least in (0.5, 0.8):
            grid = np.zeros((700, 700), bool)
            at = min([a, *[r[2] for r in near]]), min([b, *[r[3] for r in near]])
            for r in near:
                if r[7] >= least:
                    grid[r[2] - at[0] : r[4] - at[0], r[3] - at[1] : r[5] - at[1]] = True
            found += [int(grid.sum()), int(grid[a - at[0] : c - at[0], b - at[1] : d - at[1]].sum())]
        if near:
            want[k, i] = found
    cover, near = matching.merged_cover(frame(gt, "gt_id"), frame(pred, "poly_id"), ["k"], {"low": F.col("confidence") >= 0.5, "high": F.col("confidence") >= 0.8}, ("confidence",))
    assert {(r.k, r.gt_id): [*r.low, *r.high] for r in cover.collect()} == want
    assert {(r.k, r.gt_id, r.poly_id) for r in near.collect()} == touch and want[0, 99] == [100, 0, 100, 0]
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
