"""Deterministic samples and splits, drawn by digests of seed and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.operators import graph, spatial


def digest(seed: str, id_: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def stratified(df: DataFrame, strata: list[str], id_col: str, k: int, seed: str = "42") -> DataFrame:
    """At most ``k`` rows of each stratum, with stratum_pop, stratum_sampled and sample_weight."""
    w = Window.partitionBy(*strata)
    out = df.withColumns({"_rank": F.row_number().over(w.orderBy(digest(seed, F.col(id_col)), id_col)), "stratum_pop": F.count("*").over(w)})
    out = out.where(F.col("_rank") <= k).drop("_rank").withColumn("stratum_sampled", F.least("stratum_pop", F.lit(k)))
    return out.withColumn("sample_weight", F.col("stratum_pop") / F.col("stratum_sampled"))


def hash_sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """The ``n`` rows with the smallest digests."""
    return df.withColumn("digest", digest(seed, F.col(id_col))).orderBy("digest", id_col).limit(n)


def fraction_per_group(df: DataFrame, keys: list[str], id_col: str, share: float, seed: str = "42") -> DataFrame:
    """max(1, floor(n * share)) rows of each group."""
    w = Window.partitionBy(*keys)
    out = df.withColumns({"_rank": F.row_number().over(w.orderBy(digest(seed, F.col(id_col)), id_col)), "_n": F.count("*").over(w)})
    return out.where(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_rank", "_n")


def largest_remainder(df: DataFrame, key: str, available: str, total: int) -> DataFrame:
    """``quota`` per row (one a stratum): Hamilton's shares of ``total``, never above what is available.

    Left-over seats go by fractional part, then availability, then key. As total is capped by
    the sum and shares are proportional, a floor is below its availability unless all are full.
    """
    everything = Window.partitionBy()
    capped = F.least(F.lit(total), F.sum(available).over(everything))
    rows = df.where(F.col(available) > 0).withColumn("_cap", capped)
    scaled = F.col("_cap") * F.col(available)
    rows = rows.withColumns({"_sum": F.sum(available).over(everything)}).withColumns({
        "_floor": F.expr(f"div(_cap * {available}, _sum)"), "_rest": scaled % F.col("_sum")})
    seats = F.col("_cap") - F.sum("_floor").over(everything)
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), F.desc(available), key))
    rows = rows.withColumn("quota", (F.col("_floor") + (rank <= seats).cast("long")).cast("long")).drop("_cap", "_sum", "_floor", "_rest")
    return rows.unionByName(df.where(F.coalesce(F.col(available), F.lit(0)) <= 0).withColumn("quota", F.lit(0).cast("long")))


def weighted_without_replacement(df: DataFrame, keys: list[str], id_col: str, weight: str, n: int, seed: str = "42") -> DataFrame:
    """``n`` rows of each group, likelier by weight: the largest of ln(u) / weight."""
    u = (F.conv(F.substring(digest(seed, F.col(id_col)), 1, 8), 16, 10).cast("double") + 1) / (2.0**32 + 2)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_key"), id_col))
    return df.where(F.col(weight) > 0).withColumn("_key", F.log(u) / F.col(weight)).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_key", "_rank")


def spaced_pick(df: DataFrame, keys: list[str], id_col: str, score: str, at: tuple[str, str], spacing: int, n: int) -> DataFrame:
    """``n`` rows of each group with ``chosen_by``: by score, none within ``spacing`` steps on both axes of a chosen one; then the best others, spaced or not.

    Ties go to the smaller id. Rows stand on a lattice of whole numbers, a row a place or few, so a group holds no more rows than its places.
    """
    x, y = at
    boxes = df.select(*keys, id_col, score, F.col(x).alias("x0"), F.col(y).alias("y0"), (F.col(x) + 1).alias("x1"), (F.col(y) + 1).alias("y1"))
    near = spatial.box_join(boxes, boxes, keys, margin=spacing, closed=True, size=max(8, 2 * spacing)).where(F.col(id_col) != F.col(f"b_{id_col}"))
    near = near.where((F.abs(F.col("x0") - F.col("b_x0")) <= spacing) & (F.abs(F.col("y0") - F.col("b_y0")) <= spacing))
    first = (F.col(score) > F.col(f"b_{score}")) | ((F.col(score) == F.col(f"b_{score}")) & (F.col(id_col) < F.col(f"b_{id_col}")))
    pairs = near.where(first).select(F.col(id_col).alias("h"), F.col(f"b_{id_col}").alias("l"), F.col(score).alias("c"))
    kept = graph.priority_keep(df, pairs, id_col, "h", "l", [-F.col("c"), F.col("h")]).select(id_col, F.lit("spaced").alias("chosen_by"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("chosen_by").isNull(), F.desc(score), id_col))
    return df.join(kept, id_col, "left").withColumn("_k", rank).where(F.col("_k") <= n).drop("_k").withColumn("chosen_by", F.coalesce("chosen_by", F.lit("fill")))


def quota_fill(df: DataFrame, keys: list[str], stratum: str, id_col: str, score: str, quota: int, total: int, sparse: tuple[str, int]) -> DataFrame:
    """Rows with ``chosen_by``: ``quota`` of each stratum by score, then by score up to ``total`` of a group, then of the rest the lowest by ``sparse``."""
    order = [F.desc(score), F.asc(id_col)]
    s = df.withColumn("_q", F.row_number().over(Window.partitionBy(*keys, stratum).orderBy(*order)) <= quota)
    s = s.withColumns({"_k": F.row_number().over(Window.partitionBy(*keys, "_q").orderBy(*order)), "_t": F.count_if("_q").over(Window.partitionBy(*keys))})
    s = s.withColumn("chosen_by", F.when(F.col("_q"), "quota").when(F.col("_k") <= total - F.col("_t"), "fallback"))
    last = F.row_number().over(Window.partitionBy(*keys, F.col("chosen_by").isNull()).orderBy(sparse[0], id_col))
    return s.withColumn("_l", last).where(F.col("chosen_by").isNotNull() | (F.col("_l") <= sparse[1])).drop("_q", "_k", "_t", "_l").withColumn("chosen_by", F.coalesce("chosen_by", F.lit("sparse")))


def greedy_split(df: DataFrame, keys: list[str], id_col: str, n_col: str, share: float, seed: str = "42") -> DataFrame:
    """``split``: the groups with the most annotations go to val while val holds less than the target; empty ones by share.

    Going down the counts, val takes one while the sum before it is below the target, so it is a running sum.
    """
    w = Window.partitionBy(*keys)
    down = w.orderBy(F.desc(n_col), digest(seed, F.col(id_col)), id_col)
    before = F.coalesce(F.sum(n_col).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.floor(F.sum(n_col).over(w) * share)
    full = df.where(F.col(n_col) > 0).withColumn("split", F.when(before < target, "val").otherwise("train"))
    rank = F.row_number().over(w.orderBy(digest(seed, F.col(id_col)), id_col))
    empty = df.where(F.col(n_col) == 0).withColumn("split", F.when(rank <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share)), "val").otherwise("train"))
    return full.unionByName(empty)
