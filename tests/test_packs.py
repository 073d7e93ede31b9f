"""Packs of boxes against the plain first fit."""

import numpy as np

from rooftally.operators import matching


def _plain(boxes, chip, most):
    packs, out = [], []
    for box in boxes:
        for i, (n, *old) in enumerate(packs):
            a, b, c, d = (*map(min, old[:2], box[:2]), *map(max, old[2:], box[2:]))
            if n < most and c - a <= chip and d - b <= chip:
                packs[i] = (n + 1, a, b, c, d)
                break
        else:
            i = len(packs)
            packs.append((1, *box))
        out.append(i + 1)
    return out


def test_tiles_are_packed_many_a_batch(spark):
    """Equal to looking at all packs for each box: full and oversized packs, ties of confidence, null keys, a crowded tile. Tiles aren't a call of Python each."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, n, reach, side in (("a", 60, 750, 200), (None, 9, 100, 40), ("wide", 50, 750, 700), ("crowded", 3000, 750, 60)):
        x0, y0 = rng.integers(-50, reach, (2, n))
        found = [(key, 1, 10_000 * len(want) + i, float(c), int(a), int(b), int(a + w), int(b + h)) for i, (a, b, w, h, c) in enumerate(zip(x0, y0, *rng.integers(1, side, (2, n)), rng.integers(5, 11, n) / 10))]
        found.sort(key=lambda r: (-r[3], r[2]))
        want |= {r[2]: pack for r, pack in zip(found, _plain([r[4:] for r in found], 400, 4))}
        rows += found
    df = spark.createDataFrame(rows[::-1], "k string, tile long, poly_id long, confidence double, x0 long, y0 long, x1 long, y1 long")
    packs = matching.pack_targets(df, ["k"], "tile", 400, 4)
    assert packs.columns == ["k", "tile", "poly_id", "pack"]
    assert {r.poly_id: r.pack for r in packs.collect()} == want
    plan = packs._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert matching.pack_targets(df.limit(0), ["k"], "tile", 400, 4).count() == 0
