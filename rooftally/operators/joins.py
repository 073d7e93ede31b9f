"""Joins of keyed tables: decisions by levels, crosswalks, layers by priority, fills, both sides of a count, leaks, pools.

All are functions of any tables. Unless said otherwise a null key meets nothing, and tables without rows give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.operators import spatial
from rooftally.operators.columns import first_match


def decision_join(rows: DataFrame, decisions: DataFrame, levels: list[tuple[str, list[str], Column]], value: str, none: str = "none") -> DataFrame:
    """``rows`` with ``value`` and ``matched_by``: the largest value of the first level that has one.

    A level is its name, the keys on which it is joined, and which decisions count for it. A row that no level meets has a null value and the name ``none``.
    """
    out, places = rows, []
    for i, (name, keys, rule) in enumerate(levels):
        place = f"_v{i}"
        out = out.join(decisions.where(rule).groupBy(*keys).agg(F.max(value).alias(place)), keys, "left")
        places.append((F.col(place), name))
    by = first_match([(c.isNotNull(), name) for c, name in places], none)
    return out.select(*rows.columns, F.coalesce(*[c for c, _ in places]).alias(value), by.alias("matched_by"))


def review_join(rows: DataFrame, decisions: DataFrame, keys: list[str], verdict: str, order: str) -> DataFrame:
    """``rows`` with the verdict of the last decision of their keys; those without a decision, or whose last one abstains (null), go."""
    last = decisions.groupBy(*keys).agg(F.max_by(F.struct(verdict), order).alias("_m"))
    return rows.join(last, keys).where(F.col(f"_m.{verdict}").isNotNull()).select(*rows.columns, F.col(f"_m.{verdict}").alias(verdict))


def crosswalk(aliases: DataFrame, old: str, new: str, tier: str) -> DataFrame:
    """old, new, tier, ambiguous: of an old name's candidates the one of the lowest tier, the smallest among equals; more than one is ambiguous. A null old name is a name."""
    best = aliases.groupBy(old).agg(F.min(F.struct(tier, new)).alias("_b"), F.count("*").alias("_n"))
    return best.select(old, F.col(f"_b.{new}").alias(new), F.col(f"_b.{tier}").alias(tier), (F.col("_n") > 1).alias("ambiguous"))


def resolve_layer(cells: DataFrame, layers: DataFrame, key: str, layer: str, priority: str, none: str = "none") -> DataFrame:
    """key, layer, n_layers: the layer of the smallest priority, null ones last, the first by name among equals, of those that a cell has; ``none`` without any."""
    best = F.min(F.when(F.col(layer).isNotNull(), F.struct(F.col(priority).isNull().alias("_last"), priority, layer)))
    met = cells.select(key).distinct().join(layers.select(key, layer, priority), key, "left").groupBy(key).agg(best.alias("_b"), F.count(layer).alias("n_layers"))
    return met.select(key, F.coalesce(F.col(f"_b.{layer}"), F.lit(none)).alias(layer), "n_layers")


def left_join_fill(cells: DataFrame, counts: DataFrame, keys: list[str], sums: list[str], reached: str = "ok", missing: str = "not_reached") -> DataFrame:
    """Every row of ``cells`` with ``sums``, 0 where ``counts`` has no row of its keys, and ``status``, which tells those from a counted 0."""
    told = counts.select(*keys, *sums, F.lit(True).alias("_met"))
    status = F.when(F.col("_met").isNull(), missing).otherwise(reached)
    return cells.join(told, keys, "left").select(*cells.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in sums], status.alias("status"))


def both_sides(truth: DataFrame, predicted: DataFrame, keys: list[str], measure: str, other: str) -> DataFrame:
    """keys, ``measure`` of the truth and ``other`` of the prediction, 0 where absent, and ``side``: both, truth_only or predicted_only. A row of null keys is on its side alone."""
    a, b = truth.select(*keys, measure, F.lit(True).alias("_a")), predicted.select(*keys, other, F.lit(True).alias("_b"))
    side = first_match([(F.col("_a").isNull(), "predicted_only"), (F.col("_b").isNull(), "truth_only")], "both")
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce(measure, F.lit(0)).alias(measure), F.coalesce(other, F.lit(0)).alias(other), side.alias("side"))


def bounds_inside(boxes: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """keys, inside, x0, y0, x1, y1: the bounds of all boxes of a key, and whether they lie between ``low`` and ``high`` on both axes."""
    b = boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return b.select(*keys, ((F.least("x0", "y0") >= low) & (F.greatest("x1", "y1") <= high)).alias("inside"), *spatial.BOX)


def leaks(cells: DataFrame, pool: DataFrame, keys: list[str], name: str = "leaks") -> DataFrame:
    """``cells`` with ``name``: whether the pool has a row of the same keys."""
    return cells.join(pool.select(*keys, F.lit(True).alias("_hit")).distinct(), keys, "left").select(*cells.columns, F.coalesce("_hit", F.lit(False)).alias(name))


def without_listed(df: DataFrame, name: str, listed: DataFrame, patterns: list[str]) -> DataFrame:
    """The rows whose ``name`` isn't in ``listed`` and fits none of the patterns; null names stay."""
    fits = reduce(lambda a, b: a | b, [F.col(name).cast("string").rlike(p) for p in patterns], F.lit(False))
    return df.where(~F.coalesce(fits, F.lit(False))).join(listed.select(name), name, "left_anti")


def accepted(sources: list[tuple[DataFrame, Column, str]], columns: list[str], status: str = "correct") -> DataFrame:
    """``columns``, status and origin of the rows that a source's rule accepts, source after source; a column that a source lacks is null."""
    rows = [df.where(rule).select(*[c for c in columns if c in df.columns], F.lit(status).alias("status"), F.lit(origin).alias("origin")) for df, rule, origin in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).select(*columns, "status", "origin")


def pool_manifest(sources: list[DataFrame], keys: list[str], item: str, provenance: str, trusted: list[str], used: DataFrame, cell: str) -> DataFrame:
    """item, cell, provenance, trust, shares_cell: each item once, as the first of ``sources`` that has it says (the smallest provenance if it says several), with its trust and whether ``used`` has its cell."""
    rows = reduce(DataFrame.unionByName, [df.select(*keys, item, provenance, F.lit(i).alias("_i")) for i, df in enumerate(sources)])
    once = rows.groupBy(*keys, item).agg(F.min(F.struct("_i", provenance)).alias("_m")).select(*keys, item, F.col(f"_m.{provenance}").alias(provenance))
    trust = F.when(F.col(provenance).isin(*trusted), "trusted").otherwise("untrusted")
    return leaks(once, used, [cell], "shares_cell").select(item, cell, provenance, trust.alias("trust"), "shares_cell")


def vote_near(boxes: DataFrame, points: DataFrame, keys: list[str], box_id: str, label: str, margin: int, none: str) -> DataFrame:
    """``boxes`` with ``vote``: the label that most points within ``margin`` of the box have, the first by name among equals; ``none`` where none with a label is near."""
    near = spatial.points_within(points.where(F.col(label).isNotNull()).select(*keys, label, "x", "y"), boxes.select(*keys, box_id, *spatial.BOX), keys, margin=margin)
    votes = near.groupBy(F.col(f"b_{box_id}").alias(box_id), label).agg(F.count("*").alias("_n"))
    best = votes.groupBy(box_id).agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias("_best"))
    return boxes.join(best, box_id, "left").select(*boxes.columns, F.coalesce("_best", F.lit(none)).alias("vote"))


def coverage_by(units: DataFrame, hits: DataFrame, keys: list[str], per: list[str], amount: str) -> DataFrame:
    """per, covered, uncovered, n_cells, n_covered: the amount of the cells (``keys``) that ``hits`` has and of the others."""
    met = leaks(units, hits, keys, "_met")
    sums = [F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0)).alias(n) for n, c in (("covered", F.col("_met")), ("uncovered", ~F.col("_met")))]
    return met.groupBy(*per).agg(*sums, F.count("*").alias("n_cells"), F.count_if("_met").alias("n_covered"))
