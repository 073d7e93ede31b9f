"""Mixing sources to target weights: capped water-filling, then whole and fractional epochs.

Sources get shares of the whole mass by weight. A source may be repeated ``max_epochs``
times at most; what it can't take goes to the others by weight until nobody is above.
Sorted by cap / weight, the clamped sources are a prefix, so the fixed point of that
clamping is found with running sums over one row per source. These rows pass one task, which
spills: some hundred bytes a source, so about a gigabyte for ten million sources.

Each source then needs ``whole`` epochs of all its rows and part of one more. The part is
taken in the order of a seeded digest of the id, up to the row that the target falls into
(taken if at least half of it is below). Ranks are not sorted over a source: rows fall
into about sqrt(n) ranges of the digest, sums of ranges find the one that holds the target,
and only that one is ordered row by row. So a source with a third of all rows costs one
aggregation and a window over sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.llm.text import BROADCAST_KEYS, fresh

#: Rows of the source table up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def cycled_weights(sources: DataFrame, source: str, cycle: tuple[int, ...]) -> DataFrame:
    """``weight`` by the rank of the source's name in code point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources: one row each with ``size`` and ``weight`` (longs). Adds ``target`` (double).

    A source without size gets 0; without any size all get 0. If all caps together are
    below the mass, each source stays at its cap. Ties of cap / weight share one level.
    """
    cap = F.col("size") * max_epochs
    everything = Window.partitionBy()
    before = Window.orderBy((cap / F.col("weight")).asc(), F.col("weight").asc(), F.col("size").asc()).rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("size").over(everything), F.sum("weight").over(everything)
    rows = sources.withColumns({
        "_left": total - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "_open": weights - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    rows = rows.withColumn("_free", F.col("weight") * F.col("_left") < cap * F.col("_open"))
    level = F.max(F.when(F.col("_free"), F.col("_left") / F.col("_open"))).over(everything)
    rows = rows.withColumn("_level", level)
    target = F.when(F.col("_free"), F.col("weight") * F.col("_level")).otherwise(cap.cast("double"))
    return rows.withColumn("target", target).drop("_left", "_open", "_free", "_level")


def _digest(ids: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))))


def mix(df: DataFrame, id_col: str, source_col: str, size: Column, cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, source, size, source_size, weight, target, repeats, taken.

    ``taken`` is size x repeats. Rows of size 0 take 0; a null source is a source of its own;
    rows repeated with the same id are ranked by size and count one by one; an empty table
    gives no rows. Only id, source and size are kept, so other columns can't clash.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size")).withColumn("digest", _digest(F.col("id"), seed)).persist()
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sources = water_fill(cycled_weights(sources, "source", cycle), max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long")).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "weight", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("size")).alias("part"),
        F.pow(F.lit(2), F.ceil(F.log2(F.col("n")) / 2)).cast("long").alias("ranges"),
    ).persist()
    hint = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda x: x
    at = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(2**32)).cast("long")
    placed = rows.join(hint(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("at", at)
    sums = placed.groupBy("source", "at").agg(F.sum("size").alias("mass"), F.first("part").alias("part"))
    below = F.sum("mass").over(Window.partitionBy("source").orderBy("at")) - F.col("mass")
    cuts = sums.withColumn("below", below).where((F.col("below") <= F.col("part")) & (F.col("part") < F.col("below") + F.col("mass")))
    cuts = cuts.select(F.col("source").alias("s"), F.col("at").alias("cut"), "below")
    placed = placed.join(hint(cuts), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # without a cut the part is nothing or the whole source
    more = F.when(F.col("cut").isNull(), F.col("part") > 0).otherwise(F.col("at") < F.col("cut")).cast("long")
    inside = F.coalesce(F.col("at") == F.col("cut"), F.lit(False))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") + F.col("below")
    edge = placed.where(inside).withColumn("more", (2 * before + F.col("size") <= 2 * F.col("part")).cast("long"))
    out = placed.where(~inside).withColumn("more", more).unionByName(edge)
    repeats = F.col("whole") + F.col("more")
    return out.select("id", "source", "size", "source_size", "weight", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def repeated(df: DataFrame, mixed: DataFrame, id_col: str) -> DataFrame:
    """``df`` with each row as often as ``mixed`` says (``id``, ``repeats``); of rows with one id, the most counts for all.

    A null id is an id like others. ``df`` may have any names; rows that ``mixed`` doesn't have, or has with 0, go.
    """
    key, n = fresh(df.columns, "_id", "_n")
    counts = mixed.groupBy(F.col("id").alias(key)).agg(F.max("repeats").cast("int").alias(n)).where(F.col(n) > 0).persist()
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts
    joined = df.join(counts, df[id_col].eqNullSafe(F.col(key)))
    return joined.withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*df.columns)
