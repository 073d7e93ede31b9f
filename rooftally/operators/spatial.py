"""Joins of boxes and points, and exact areas of unions of boxes.

A box is ``x0, y0, x1, y1`` (whole numbers, half-open). Joins list a box under each square
bucket that it touches, so they are equi-joins on keys and bucket; a pair is kept only in
the bucket that holds the lower corner of its intersection, so it comes out once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket's side; pairs of box and slab that a task looks at at a time.
BUCKET, PLACES = 250, 1 << 21
BOX = ("x0", "y0", "x1", "y1")


def _cells(low: Column, high: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def bucketed(df: DataFrame, box: tuple[str, str, str, str] = BOX, size: int = BUCKET, margin: int = 0, closed: bool = False) -> DataFrame:
    """Adds ``bx`` and ``by``, a row for each bucket that the box (grown by ``margin``) touches."""
    x0, y0, x1, y1 = map(F.col, box)
    last = 0 if closed else 1
    out = df.withColumn("bx", _cells(x0 - margin, x1 + margin - last, size))
    return out.withColumn("by", _cells(y0 - margin, y1 + margin - last, size))


def box_join(a: DataFrame, b: DataFrame, keys: list[str], margin: int = 0, closed: bool = False, size: int = BUCKET) -> DataFrame:
    """Pairs whose boxes overlap (``closed``: or touch), ``a`` grown by ``margin``. b's columns that aren't keys get ``b_``.

    Adds ``inter``, the area of the overlap of the boxes as they are.
    """
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    left = bucketed(a, BOX, size, margin, closed)
    right = bucketed(right, ("b_x0", "b_y0", "b_x1", "b_y1"), size, 0, closed)
    pairs = left.join(right, [*keys, "bx", "by"])
    low_x, low_y = F.greatest(F.col("x0") - margin, "b_x0"), F.greatest(F.col("y0") - margin, "b_y0")
    high_x, high_y = F.least(F.col("x1") + margin, "b_x1"), F.least(F.col("y1") + margin, "b_y1")
    meets = (high_x >= low_x) & (high_y >= low_y) if closed else (high_x > low_x) & (high_y > low_y)
    first = (F.floor(low_x / size) == F.col("bx")) & (F.floor(low_y / size) == F.col("by"))
    width = F.greatest(F.least("x1", "b_x1") - F.greatest("x0", "b_x0"), F.lit(0))
    height = F.greatest(F.least("y1", "b_y1") - F.greatest("y0", "b_y0"), F.lit(0))
    return pairs.where(meets & first).drop("bx", "by").withColumn("inter", width * height)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], **kw) -> DataFrame:
    """``box_join`` with ``iou``, ``iof`` (of a's area) and ``cover`` (of b's area); both need ``area``."""
    return box_join(a, b, keys, **kw).withColumns({
        "iou": F.col("inter") / (F.col("area") + F.col("b_area") - F.col("inter")),
        "iof": F.col("inter") / F.col("area"),
        "cover": F.col("inter") / F.col("b_area"),
    })


def points_as_boxes(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumns({"x0": F.col(x), "y0": F.col(y), "x1": F.col(x), "y1": F.col(y)})


def points_within(points: DataFrame, boxes: DataFrame, keys: list[str], margin: int = 0) -> DataFrame:
    """Pairs of a point (``x``, ``y``) and a box (``b_`` columns) no further than ``margin`` on each axis' outside, by distance."""
    pairs = box_join(points_as_boxes(points), boxes, keys, margin=margin, closed=True).drop("inter", *BOX)
    dx = F.greatest(F.col("b_x0") - F.col("x"), F.col("x") - F.col("b_x1"), F.lit(0))
    dy = F.greatest(F.col("b_y0") - F.col("y"), F.col("y") - F.col("b_y1"), F.lit(0))
    return pairs.withColumn("dist2", dx * dx + dy * dy).where(F.col("dist2") <= margin * margin)


def near_boxes(a: DataFrame, b: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """Pairs of boxes whose boundaries' distance is ``tolerance`` at most; adds ``dist2``."""
    pairs = box_join(a, b, keys, margin=tolerance, closed=True)
    dx = F.greatest(F.col("b_x0") - F.col("x1"), F.col("x0") - F.col("b_x1"), F.lit(0))
    dy = F.greatest(F.col("b_y0") - F.col("y1"), F.col("y0") - F.col("b_y1"), F.lit(0))
    return pairs.withColumn("dist2", dx * dx + dy * dy).where(F.col("dist2") <= tolerance * tolerance)


def neighbour_counts(points: DataFrame, keys: list[str], id_col: str, radius: int) -> DataFrame:
    """``n_near``: other points of the same keys within ``radius``."""
    boxes = points_as_boxes(points).select(*keys, id_col, "x", "y", *BOX)
    pairs = box_join(boxes, boxes, keys, margin=radius, closed=True)
    dist2 = F.pow(F.col("x") - F.col("b_x"), 2) + F.pow(F.col("y") - F.col("b_y"), 2)
    near = (dist2 <= radius * radius) & (F.col(id_col) != F.col(f"b_{id_col}"))
    return pairs.groupBy(*keys, id_col).agg(F.count_if(near).alias("n_near"))


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], id_col: str, target_id: str, reach: tuple[int, ...] = (250, 1000, 4500)) -> DataFrame:
    """The nearest target of each point: ``dist2`` and ``target``; null where the keys have none within the last reach.

    Points that find a target within a reach are done, for nothing outside it is nearer; the
    rest look further. Ties go to the smaller target.
    """
    left, found = points_as_boxes(points).select(*keys, id_col, "x", "y", *BOX), None
    right = points_as_boxes(targets).select(*keys, target_id, "x", "y", *BOX)
    for r in reach:
        pairs = box_join(left, right, keys, margin=r, closed=True, size=max(BUCKET, r))
        dist2 = (F.col("x") - F.col("b_x")) * (F.col("x") - F.col("b_x")) + (F.col("y") - F.col("b_y")) * (F.col("y") - F.col("b_y"))
        best = pairs.withColumn("dist2", dist2).where(F.col("dist2") <= r * r).groupBy(*keys, id_col).agg(F.min(F.struct("dist2", F.col(f"b_{target_id}").alias("t"))).alias("best"))
        best = best.select(*keys, id_col, F.col("best.dist2").alias("dist2"), F.col("best.t").alias("target"))
        found = best if found is None else found.unionByName(best)
        left = left.join(best.select(*keys, id_col), [*keys, id_col], "left_anti")
    return points.select(*keys, id_col).join(found, [*keys, id_col], "left")


def box_areas(bucket: np.ndarray, boxes: np.ndarray, flags: np.ndarray, buckets: int, size: int) -> np.ndarray:
    """(buckets, layers): areas of unions in buckets of ``size``. bucket: of each box, ascending; boxes: (4, n) as x0, y0, x1, y1 from 0 to size; flags: (layers, n).

    Between two neighbouring edges of a bucket lies a slab; in it the boxes, by lower edge, add what lies above the highest edge so far. Where that
    would take more places than a bucket has whole numbers, corners are added up on its raster instead.
    """
    out = np.zeros((buckets, len(flags)), np.int64)
    (x0, y0, x1, y1), n, m = boxes, len(bucket), size + 1
    edges, place = np.unique(np.concatenate((bucket * m + x0, bucket * m + x1)), return_inverse=True)
    start, spans = place[:n], place[n:] - place[:n]
    pairs = np.bincount(bucket, spans, buckets).astype(np.int64)
    crowded = pairs > size * size // 8
    for k in np.flatnonzero(crowded):
        own = slice(*np.searchsorted(bucket, [k, k + 1]))
        for layer, some in enumerate(flags[:, own]):
            a, b, c, d = boxes[:, own][:, some]
            corners = np.bincount(np.concatenate((a * m + b, c * m + d)), minlength=m * m) - np.bincount(np.concatenate((a * m + d, c * m + b)), minlength=m * m)
            out[k, layer] = np.count_nonzero(corners.reshape(m, m).cumsum(0).cumsum(1))
    some = np.flatnonzero(~crowded[bucket])
    some = some[np.argsort(bucket[some] * m + y0[some], kind="stable")]
    bound = np.concatenate(([0], np.cumsum(spans[some])))
    ends = np.flatnonzero(np.diff(bucket[some], append=-1)) + 1
    at = 0
    while at < len(some):  # whole buckets, so many places at a time
        to = int(ends[max(np.searchsorted(bound[ends], bound[at] + PLACES, "right") - 1, np.searchsorted(ends, at, "right"))])
        own = some[at:to]
        box = np.repeat(own, spans[own])
        slab = np.arange(len(box)) - np.repeat(bound[at:to] - bound[at] - start[own], spans[own])
        by = np.argsort(slab, kind="stable")  # boxes are in order of their lower edges already
        slab, box = slab[by], box[by]
        width, lift, of = edges[slab + 1] - edges[slab], slab * m, bucket[box]
        low, high = y0[box] + lift, y1[box] + lift
        for layer, flag in enumerate(flags):
            # slabs are lifted above each other, so that one running maximum serves all
            reach = np.where(flag[box], high, lift)
            before = np.maximum(np.concatenate(([0], np.maximum.accumulate(reach)[:-1])), lift)
            gain = np.maximum(reach - np.maximum(low, before), 0) * width
            out[:, layer] += np.bincount(of, gain, buckets).astype(np.int64)
        at = to
    return out


def union_areas(df: DataFrame, keys: list[str], layers: dict[str, Column], size: int = 4 * BUCKET) -> DataFrame:
    """Per key, the area of the union of the boxes for which a layer's condition holds, a column a layer; a key of ``df`` without any has 0.

    Boxes are cut at bucket edges, so areas of buckets add up. A bucket is one row: its distinct boxes, each with its layers a number
    or two; `box_areas` measures all buckets of an Arrow batch at once. A layer is one more highest edge in the same walk, so many thresholds cost one pass.
    """
    width = size.bit_length()
    x0, y0, x1, y1 = (F.col(c).cast("long") for c in BOX)
    cells = bucketed(df.where((x1 > x0) & (y1 > y0)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *BOX, *[F.coalesce(c, F.lit(False)).alias(f"_f{i}") for i, c in enumerate(layers.values())]), size=size)
    left, bottom = F.col("bx") * size, F.col("by") * size
    sides = [F.greatest(x0 - left, F.lit(0)), F.greatest(y0 - bottom, F.lit(0)), F.least(x1 - left, F.lit(size)), F.least(y1 - bottom, F.lit(size))]
    bits = [(c, width) for c in sides] + [(F.col(f"_f{i}").cast("long"), 1) for i in range(len(layers))]
    words, at = [F.lit(0).cast("long")], [0]
    for c, n in bits:
        if at[-1] + n > 63:
            words.append(F.lit(0).cast("long"))
            at.append(0)
        words[-1] = words[-1].bitwiseOR(F.shiftleft(c.cast("long"), at[-1]))
        at[-1] += n
    own, widths, single = [f"_k{i}" for i in range(len(keys))], [n for _, n in bits], len(words) == 1
    names = [*own, *[f"a{i}" for i in range(len(layers))]]
    rows = cells.groupBy(*own, "bx", "by").agg(F.collect_set(F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words)]) if len(words) > 1 else words[0]).alias("_boxes")).select(*own, "_boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(own))
            bucket = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            held, fields, w, low = [c.to_numpy(zero_copy_only=False) for c in ([flat] if single else flat.flatten())], [], 0, 0
            for n in widths:
                if low + n > 63:
                    w, low = w + 1, 0
                fields.append(held[w] >> low & ((1 << n) - 1))
                low += n
            areas = box_areas(bucket, np.stack(fields[:4]), np.stack(fields[4:]).astype(bool), len(lists), size)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), *map(pa.array, areas.T)], names)

    schema = rows.select(*own).schema
    for i in range(len(layers)):
        schema = schema.add(f"a{i}", "long")
    found = rows.mapInArrow(run, schema).groupBy(*own).agg(*[F.sum(f"a{i}").alias(n) for i, n in enumerate(layers)])
    return found.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], *layers)


def union_area(df: DataFrame, keys: list[str], size: int = 4 * BUCKET) -> DataFrame:
    """``union_area`` per key of the boxes of ``df``."""
    return union_areas(df, keys, {"union_area": F.lit(True)}, size)


def two_sides(p: DataFrame, g: DataFrame, keys: list[str], more: list[str] = []) -> DataFrame:
    """Boxes of both sides with ``side`` (p or g) and ``more`` columns of the predictions, null on the other side."""
    mine = p.select(*keys, *BOX, F.lit("p").alias("side"), *more)
    return mine.unionByName(g.select(*keys, *BOX, F.lit("g").alias("side")), allowMissingColumns=True)


def area_sets(p: DataFrame, g: DataFrame, keys: list[str]) -> DataFrame:
    """pred_union, gt_union, inter_union and pred_sum per key; absent sides count 0.

    The intersection of two unions is what their areas have more than their common union,
    so one pass over the boxes of both sides gives all three.
    """
    side = F.col("side")
    wide = union_areas(two_sides(p, g, keys), keys, {"p": side == "p", "g": side == "g", "b": F.lit(True)})
    sums = p.groupBy(*keys).agg(F.sum("area").alias("pred_sum"))
    return wide.join(sums, keys, "left").select(*keys, F.col("p").alias("pred_union"), F.col("g").alias("gt_union"), (F.col("p") + F.col("g") - F.col("b")).alias("inter_union"), F.coalesce("pred_sum", F.lit(0)).alias("pred_sum"))


def swept_sets(p: DataFrame, g: DataFrame, keys: list[str], rules: list[tuple[tuple, Column]], names: list[str]) -> DataFrame:
    """``area_sets`` without sums for each rule on the predictions: a row per key and rule, told by the rule's values under ``names``.

    All rules come from one pass: each is two layers. Predictions carry the columns that the rules name in ``p``.
    """
    side, more = F.col("side"), [c for c in p.columns if c not in (*keys, *BOX)]
    layers = {"g": side == "g"}
    for i, (_, rule) in enumerate(rules):
        layers |= {f"p{i}": (side == "p") & rule, f"b{i}": (side == "g") | rule}
    wide = union_areas(two_sides(p, g, keys, more), keys, layers)
    of = lambda i, at: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, at)], F.col(f"p{i}").alias("pred_union"), F.col("g").alias("gt_union"), (F.col(f"p{i}") + F.col("g") - F.col(f"b{i}")).alias("inter_union"))
    rows = wide.select(*keys, F.explode(F.array(*[of(i, at) for i, (at, _) in enumerate(rules)])).alias("r")).select(*keys, "r.*")
    return rows.where("pred_union > 0 or gt_union > 0")


def cover_by_union(g: DataFrame, p: DataFrame, keys: list[str], gt_id: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Per ground-truth box: the area of it under the union of the predictions, ``covered``; ``more`` are further keys of p."""
    extra = [f"b_{m}" for m in more]
    pairs = box_join(g, p.select(*keys, *more, *BOX), keys)
    clipped = pairs.select(*keys, gt_id, *extra, F.greatest("x0", "b_x0").alias("x0"), F.greatest("y0", "b_y0").alias("y0"), F.least("x1", "b_x1").alias("x1"), F.least("y1", "b_y1").alias("y1"))
    out = union_area(clipped, [*keys, gt_id, *extra]).withColumnRenamed("union_area", "covered")
    return out.withColumnsRenamed({f"b_{m}": m for m in more})


def closing_area(df: DataFrame, keys: list[str], reach: int, size: int = BUCKET) -> DataFrame:
    """``closed_area`` per key: the union of the boxes grown by ``reach`` and shrunk again by as much, so gaps of up to twice ``reach`` are filled.

    What isn't covered by grown boxes is found bucket by bucket as the gaps of each slab, with the empty buckets beside covered ones;
    grown by ``reach``, it is what shrinking takes away. ``reach`` is below the bucket's size. All of it stays inside a bucket and its neighbours.
    """
    grown = df.select(*keys, *[(F.col(c) - reach).alias(c) for c in BOX[:2]], *[(F.col(c) + reach).alias(c) for c in BOX[2:]])
    part, low = [*keys, "bx", "by"], F.lit(-(2**62))
    cut = bucketed(grown, size=size)
    left, bottom = F.col("bx") * size, F.col("by") * size
    cut = cut.withColumns({"x0": F.greatest("x0", left), "x1": F.least("x1", left + size), "y0": F.greatest("y0", bottom), "y1": F.least("y1", bottom + size)}).where("x1 > x0 and y1 > y0")
    cells = cut.groupBy(*part).agg(F.collect_set("x0").alias("a"), F.collect_set("x1").alias("b"), F.collect_set(F.struct("y0", "y1", "x0", "x1")).alias("boxes"))
    edges = F.array_sort(F.array_union(F.array_union("a", "b"), F.array(left, left + size)))
    cells = cells.withColumn("edges", edges).persist()
    slabs = F.zip_with(F.slice("edges", F.lit(1), F.size("edges") - 1), F.slice("edges", F.lit(2), F.size("edges") - 1), lambda a, b: F.struct(a.alias("xa"), b.alias("xb")))
    rows = cells.select(*part, "boxes", F.explode(slabs).alias("s"))
    inside = F.array_sort(F.filter("boxes", lambda q: (q["x0"] <= F.col("s.xa")) & (q["x1"] >= F.col("s.xb"))))
    spans = F.concat(F.transform(inside, lambda q: F.struct(q["y0"].alias("y0"), q["y1"].alias("y1"))), F.array(F.struct((bottom + size).alias("y0"), (bottom + size).alias("y1"))))
    start = F.struct(bottom.cast("long").alias("top"), F.array().cast("array<struct<y0:bigint,y1:bigint>>").alias("gaps"))

    def step(state: Column, q: Column) -> Column:
        gap = F.array(F.struct(state["top"].alias("y0"), q["y0"].cast("long").alias("y1")))
        return F.struct(F.greatest(state["top"], q["y1"]).cast("long").alias("top"), F.when(q["y0"] > state["top"], F.concat(state["gaps"], gap)).otherwise(state["gaps"]).alias("gaps"))

    gaps = rows.select(*keys, F.col("s.xa").alias("x0"), F.col("s.xb").alias("x1"), F.explode(F.aggregate(spans, start, step, lambda s: s["gaps"])).alias("g")).select(*keys, "x0", "g.y0", "x1", "g.y1")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    empty = cells.select(*keys, "bx", "by", around.alias("d")).select(*keys, (F.col("bx") + F.col("d.dx")).alias("bx"), (F.col("by") + F.col("d.dy")).alias("by")).distinct().join(cells.select(*part), part, "left_anti")
    gaps = gaps.unionByName(empty.select(*keys, left.alias("x0"), bottom.alias("y0"), (left + size).alias("x1"), (bottom + size).alias("y1")))
    taken = bucketed(gaps.select(*keys, *[(F.col(c) - reach).alias(c) for c in BOX[:2]], *[(F.col(c) + reach).alias(c) for c in BOX[2:]]), size=size).join(cells.select(*part), part, "left_semi")
    taken = taken.withColumns({"x0": F.greatest("x0", left), "x1": F.least("x1", left + size), "y0": F.greatest("y0", bottom), "y1": F.least("y1", bottom + size)}).where("x1 > x0 and y1 > y0")
    away = union_area(taken, part, size)
    rest = cells.select(*part).join(away, part, "left").groupBy(*keys)
    return rest.agg(F.sum(size * size - F.coalesce("union_area", F.lit(0))).cast("long").alias("closed_area"))


def within_gap(df: DataFrame, keys: list[str], id_col: str, gap: int) -> DataFrame:
    """Pairs (a, b) of boxes, a < b, that are at most ``gap`` apart on both axes, with that distance (the larger of the two) as ``apart``."""
    box = df.select(*keys, id_col, *BOX)
    pairs = box_join(box, box, keys, margin=gap, closed=True).where(F.col(id_col) < F.col(f"b_{id_col}"))
    apart = F.greatest(*[F.greatest(F.col(f"b_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"b_{c}1")) for c in "xy"], F.lit(0))
    return pairs.select(*keys, F.col(id_col).alias("a"), F.col(f"b_{id_col}").alias("b"), apart.alias("apart"))
