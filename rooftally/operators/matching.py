"""Matching, suppression and merging of boxes with the graph steps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.functions.session import cut
from rooftally.operators import graph
from rooftally.operators.spatial import BOX, area_sets, box_join, overlaps, union_area, union_areas


def match_strict(g: DataFrame, p: DataFrame, keys: list[str], iou: float = 0.3) -> DataFrame:
    """One-to-one by IoU, at or above ``iou``; ties by gt_id, then poly_id. (keys, gt_id, poly_id, iou)"""
    edges = overlaps(g, p, keys).where(F.col("iou") >= iou).select(*keys, "gt_id", F.col("b_poly_id").alias("poly_id"), "iou")
    return graph.greedy_match(edges, keys, "gt_id", "poly_id", [-F.col("iou"), F.col("gt_id"), F.col("poly_id")])


def match_by_confidence(g: DataFrame, p: DataFrame, keys: list[str], iou: float = 0.5) -> DataFrame:
    """Predictions by confidence take the free ground truth of the highest IoU. (keys, gt_id, poly_id, iou)

    As edges: by confidence, then by IoU, an edge is taken if both of its ends are free.
    """
    edges = overlaps(p, g, keys).where(F.col("iou") >= iou).select(*keys, "poly_id", F.col("b_gt_id").alias("gt_id"), "iou", "confidence")
    return graph.greedy_match(edges, keys, "gt_id", "poly_id", [-F.col("confidence"), F.col("poly_id"), -F.col("iou"), F.col("gt_id")]).drop("confidence")


def merged_cover(g: DataFrame, p: DataFrame, keys: list[str], rules: dict[str, Column] | None = None, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Ground truth with the union of the predictions that touch it: (cover, near). cover: keys, gt_id, area, and ``union_area`` and ``covered`` (its part under the union);
    with ``rules`` on ``more`` columns of p, a struct of both for each rule under its name. near: keys, gt_id, poly_id and ``more`` of each pair that touches.

    The pairs are found and written once. What lies under a union is what it and the box have more than both together, so all areas come from one pass over the pairs' boxes.
    """
    near = box_join(g.select(*keys, "gt_id", *BOX), p.select(*keys, "poly_id", *more, *BOX), keys, closed=True)
    near = cut(near.select(*keys, "gt_id", *[F.col(f"b_{c}").alias(c) for c in ("poly_id", *more, *BOX)]))
    named = rules or {"_c": F.lit(True)}
    mine = near.select(*keys, "gt_id", *BOX, F.lit("p").alias("_side"), *more)
    boxes = mine.unionByName(g.select(*keys, "gt_id", *BOX, F.lit("g").alias("_side")), allowMissingColumns=True)
    gt, layers = F.col("_side") == "g", {"_g": F.col("_side") == "g"}
    for i, rule in enumerate(named.values()):
        layers |= {f"_p{i}": ~gt & rule, f"_b{i}": gt | rule}
    areas = union_areas(boxes, [*keys, "gt_id"], layers).where(F.greatest(F.lit(0), *[F.col(f"_p{i}") for i in range(len(named))]) > 0)
    both = [F.struct(F.col(f"_p{i}").alias("union_area"), (F.col(f"_p{i}") + F.col("_g") - F.col(f"_b{i}")).alias("covered")).alias(n) for i, n in enumerate(named)]
    cover = areas.select(*keys, "gt_id", *both).join(g.select(*keys, "gt_id", "area"), [*keys, "gt_id"])
    return (cover if rules else cover.select(*keys, "gt_id", "area", "_c.*")), near.select(*keys, "gt_id", "poly_id", *more)


def merged_iou() -> Column:
    """Of a row of `merged_cover`."""
    return F.col("covered") / (F.col("union_area") + F.col("area") - F.col("covered"))


def match_merged(g: DataFrame, p: DataFrame, keys: list[str], iou: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Ground truth against the union of all predictions that touch it: (accepted with iou, its predictions)."""
    cover, members = merged_cover(g, p, keys)
    return accept_merged(cover.withColumn("iou", merged_iou()).where((F.col("covered") > 0) & (F.col("iou") >= iou)), members, keys)


def accept_merged(cover: DataFrame, members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`match_merged` of candidates (keys, gt_id, iou) and their predictions (keys, gt_id, poly_id)."""
    accepted = graph.merge_match(cover.select(*keys, "gt_id", "iou"), members, keys, "gt_id", "poly_id", [-F.col("iou"), F.col("gt_id")])
    return accepted, members.join(accepted.select(*keys, "gt_id"), [*keys, "gt_id"], "left_semi")


def counts(g: DataFrame, p: DataFrame, keys: list[str], matched_gt: DataFrame, matched_pred: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per key of either side."""
    sides = [
        g.groupBy(*keys).agg(F.count("*").alias("n_gt")), p.groupBy(*keys).agg(F.count("*").alias("n_pred")),
        matched_gt.groupBy(*keys).agg(F.count("*").alias("tp")), matched_pred.groupBy(*keys).agg(F.countDistinct("poly_id").alias("hit")),
    ]
    out = reduce(lambda x, y: x.join(y, keys, "full_outer"), sides).na.fill(0, ["n_gt", "n_pred", "tp", "hit"])
    return prf(out.select(*keys, "tp", (F.col("n_pred") - F.col("hit")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn")))


def ratio(a, b) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b != 0, a / b)


def prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return df.withColumns({
        "precision": F.round(F.coalesce(ratio(tp, tp + fp), F.lit(0.0)), 6),
        "recall": F.round(F.coalesce(ratio(tp, tp + fn), F.lit(0.0)), 6),
        "f1": F.round(F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6),
    })


def best_match(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """For each box of ``a`` the box of ``b`` with the highest IoU (ties to the smaller id), null if none meets it."""
    pairs = overlaps(a, b, keys)
    best = pairs.groupBy(*keys, a_id).agg(
        F.max(F.struct("iou", (-F.col(f"b_{b_id}")).alias("n"))).alias("m"), F.max("cover").alias("best_cover"), F.sum("inter").alias("inter_sum"), F.count("*").alias("n_hits"))
    best = best.select(*keys, a_id, F.col("m.iou").alias("best_iou"), (-F.col("m.n")).alias(f"best_{b_id}"), "best_cover", "inter_sum", "n_hits")
    return a.join(best, [*keys, a_id], "left")


def conflicts(p: DataFrame, keys: list[str], iou: float, strict: bool = True) -> DataFrame:
    """Pairs of one table above ``iou`` (``strict``) or at least, each once with poly_id < b_poly_id."""
    pairs = overlaps(p, p, keys).where("poly_id < b_poly_id")
    return pairs.where(F.col("iou") > iou if strict else F.col("iou") >= iou)


def nms_score(p: DataFrame, keys: list[str], iou: float = 0.5) -> DataFrame:
    """Keeps boxes by confidence (ties by poly_id) unless their IoU with a kept one is above ``iou``."""
    pairs = conflicts(p.select(*keys, "poly_id", "area", "confidence", "x0", "y0", "x1", "y1"), keys, iou)
    first = F.col("confidence") >= F.col("b_confidence")
    ends = [F.struct(F.col(f"{x}poly_id").alias("id"), F.col(f"{x}confidence").alias("c")) for x in ("", "b_")]
    edges = pairs.select(F.when(first, ends[0]).otherwise(ends[1]).alias("h"), F.when(first, ends[1]["id"]).otherwise(ends[0]["id"]).alias("l"))
    edges = edges.select(F.col("h.id").alias("h"), "l", F.col("h.c").alias("c"))
    return graph.priority_keep(p, edges, "poly_id", "h", "l", [-F.col("c"), F.col("h")])


def nms_area(p: DataFrame, keys: list[str], iou: float = 0.5) -> DataFrame:
    """In row order the smaller box of a pair above ``iou`` goes; a box that goes stops looking, its earlier victims stay gone.

    The outcome depends on the order inside a component of overlapping boxes alone, so components
    are folded in order, some thousands of pairs at a time, with their pairs already found; components too large for a task go in rounds.
    """
    pairs = conflicts(p.select(*keys, "poly_id", "area", "x0", "y0", "x1", "y1"), keys, iou).select(F.col("poly_id").alias("i"), F.col("b_poly_id").alias("j"), (F.col("area") >= F.col("b_area")).alias("larger"))
    small, large = graph.foldable(pairs, F.col("i"), F.col("j"))

    def fold(pdf):
        pdf = pdf.sort_values(["i", "j"])
        out = set()
        for i, rows in pdf.groupby("i", sort=False):
            for j, larger in zip(rows["j"], rows["larger"]):
                if i in out:
                    break
                if j not in out:
                    out.add(j if larger else i)
        return pdf[["i", "j"]].melt(value_name="poly_id")[["poly_id"]].drop_duplicates().loc[lambda d: d["poly_id"].isin(out)]

    gone = cut(small.groupBy("_group").applyInPandas(fold, "poly_id long"))
    if not large.isEmpty():
        gone = gone.unionByName(_area_rounds(cut(large)))
    return p.join(gone, "poly_id", "left_anti")


def _area_rounds(pairs: DataFrame) -> DataFrame:
    """(poly_id) of the boxes that go. A box looks once no earlier box may still touch it or anything that it touches."""
    gone = pairs.select(F.col("i").alias("poly_id")).limit(0)
    while not pairs.isEmpty():
        first = pairs.groupBy("j").agg(F.min("i").alias("first"))
        ready = pairs.join(first, "j").groupBy("i").agg(F.every(F.col("i") == F.col("first")).alias("ready")).where("ready").select("i")
        ready = ready.join(first.select(F.col("j").alias("i")), "i", "left_anti")
        looks = pairs.join(ready, "i", "left_semi").join(gone.withColumnRenamed("poly_id", "j"), "j", "left_anti")
        looks = looks.join(gone.withColumnRenamed("poly_id", "i"), "i", "left_anti")
        stops = looks.groupBy("i").agg(F.min(F.when(~F.col("larger"), F.col("j"))).alias("stop"))
        victims = looks.join(stops, "i").where("stop is null or j < stop").select(F.col("j").alias("poly_id"))
        gone = cut(gone.unionByName(victims).unionByName(stops.where("stop is not null").select(F.col("i").alias("poly_id"))).distinct())
        pairs = cut(pairs.join(ready, "i", "left_anti"), pairs)
    return gone


def merge_groups(p: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per component of ``pairs``: its union's area, members, the values of its best member."""
    tagged = graph.with_component(p, pairs.select(*keys, "poly_id", "b_poly_id"), "poly_id", "poly_id", "b_poly_id", keys)
    area = union_area(tagged, [*keys, "component"])
    best = tagged.groupBy(*keys, "component").agg(
        F.count("*").alias("n_merged"), F.max("confidence").alias("confidence"), F.max(F.struct("confidence", (-F.col("poly_id")).alias("n"))).alias("m"), F.sum("area").alias("area_sum"))
    return best.join(area, [*keys, "component"]).select(*keys, "component", "n_merged", "confidence", (-F.col("m.n")).alias("best_poly_id"), "area_sum", "union_area")


def clusters(g: DataFrame, p: DataFrame, keys: list[str], iou: float = 0.0, inside: list[str] | None = None) -> DataFrame:
    """(keys, node, component, side): components of the two-sided overlap graph, lone boxes included. Predictions are odd nodes. ``inside``: the keys that tell a node, where a box of one side is under several of the others.

    A node is twice its box's id, plus 1 for a prediction. The id is shifted, so that doubles beyond a long go on below 0; each box still has a number of its own.
    """
    gt, pred = lambda c: F.shiftleft(c, 1), lambda c: F.shiftleft(c, 1).bitwiseOR(F.lit(1))
    edges = overlaps(g, p, keys).where(F.col("iou") > iou).select(*keys, gt("gt_id").alias("a"), pred("b_poly_id").alias("b"))
    box = ["area", "x0", "y0", "x1", "y1"]
    nodes = g.select(*keys, gt("gt_id").alias("node"), F.lit("g").alias("side"), *box).unionByName(p.select(*keys, pred("poly_id").alias("node"), F.lit("p").alias("side"), *box))
    return graph.with_component(nodes, edges, "node", "a", "b", inside or keys)


def rank_fraction(order: list[Column], keys: list[str]) -> Column:
    return F.percent_rank().over(Window.partitionBy(*keys).orderBy(*order))


def match_sets(g: DataFrame, p: DataFrame, keys: list[str], gt: str, iou: float) -> tuple[DataFrame, DataFrame]:
    """As `match_merged`, for ground truth of several boxes: all of one ``gt`` against the union of the predictions that touch any of them."""
    near = box_join(g.select(*keys, gt, *BOX), p.select(*keys, "poly_id", *BOX), keys, closed=True)
    near = cut(near.select(*keys, gt, F.col("b_poly_id").alias("poly_id"), *[F.col(f"b_{c}").alias(c) for c in BOX]).distinct())
    sets = area_sets(near.withColumn("area", F.lit(0)), g.join(near.select(*keys, gt).distinct(), [*keys, gt], "left_semi"), [*keys, gt])
    sets = sets.withColumn("iou", F.col("inter_union") / (F.col("pred_union") + F.col("gt_union") - F.col("inter_union"))).where(F.col("iou") >= iou)
    members = near.select(*keys, gt, "poly_id")
    accepted = graph.merge_match(sets.select(*keys, gt, "iou"), members, keys, gt, "poly_id", [-F.col("iou"), F.col(gt)])
    return accepted, members.join(accepted.select(*keys, gt), [*keys, gt], "left_semi")


def first_fit(boxes: list[tuple], chip: int, most: int) -> list[int]:
    """The pack of each box (from 1): the first one that still fits a square of ``chip`` with it and holds fewer than ``most``.

    Packs that are full or larger than the square can take nothing and aren't looked at again; of the others no two fit together, so
    in a tile there are few, however many boxes it has.
    """
    held, out, n = [], [], 0
    for a, b, c, d in boxes:
        for k, (i, m, u, v, w, z) in enumerate(held):
            u, v, w, z = a if a < u else u, b if b < v else v, c if c > w else w, d if d > z else z
            if w - u <= chip and z - v <= chip:
                out.append(i)
                if m + 1 < most:
                    held[k] = i, m + 1, u, v, w, z
                else:
                    del held[k]
                break
        else:
            n += 1
            out.append(n)
            if most > 1 and c - a <= chip and d - b <= chip:
                held.append((n, 1, a, b, c, d))
    return out


def pack_targets(p: DataFrame, keys: list[str], tile: str, chip: int, most: int) -> DataFrame:
    """``pack`` (from 1, by tile): boxes by falling confidence, then id, go into the first pack of their tile that still fits a
    square of ``chip`` with them and holds fewer than ``most``. A box larger than that is alone. A tile is one row, packed in one task, many tiles a batch."""
    own = [*keys, tile]
    order = F.struct((-F.col("confidence")).alias("c"), F.col("poly_id").alias("id"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("confidence").isNull().alias("n"), order.alias("o"), *BOX)))
    rows = p.groupBy(*own).agg(listed.alias("_b")).select(*own, F.col("_b.o.id").alias("poly_id"), *[F.col(f"_b.{c}").alias(c) for c in BOX])
    schema = p.select(*own, "poly_id").schema.add("pack", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(own))
            many = ids.value_lengths().to_numpy(zero_copy_only=False)
            boxes = list(zip(*[batch.column(len(own) + 1 + k).flatten().to_numpy(zero_copy_only=False).tolist() for k in range(4)]))
            packs, at = [], 0
            for n in many.tolist():
                packs += first_fit(boxes[at : at + n], chip, most)
                at += n
            told = batch.select(list(range(len(own)))).take(pa.array(np.repeat(np.arange(len(many)), many)))
            yield pa.RecordBatch.from_arrays([*told.columns, ids.flatten(), pa.array(packs, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def dissolve_overlaps(g: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Boxes (gt_id, source, area) that overlap by more than ``least`` become one: members, their distinct sources joined by +, area of their union."""
    pairs = overlaps(g, g, keys).where((F.col("gt_id") < F.col("b_gt_id")) & (F.col("inter") > least))
    tagged = graph.with_component(g, pairs.select(*keys, "gt_id", "b_gt_id"), "gt_id", "gt_id", "b_gt_id", keys)
    rows = tagged.groupBy(*keys, "component").agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"))
    return rows.join(union_area(tagged, [*keys, "component"]), [*keys, "component"])
