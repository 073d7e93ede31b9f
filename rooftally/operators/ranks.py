"""Ranks and running totals of groups of any size: no task holds a whole group.

Rows are dealt out by ranges of keys and order, so a large group lies in many ranges, one after the other. Totals of
ranges are added up first; a row's own total is what came before its range and what comes before it inside.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rooftally.functions.session import cut


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns])


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str = "before", parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` (whole numbers) over the rows of the same keys that come before by ``order``, which must tell rows apart.

    Nulls of ``order`` come first unless it says otherwise; a null amount counts 0; null keys are a key. No rows give none. The ranges are written to the
    shared folder, so that they stay as they are however often they are read.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", F.coalesce(amount, F.lit(0)).cast("long")).repartitionByRange(parts, *keys, *order)
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    written = cut(ranged)
    totals = written.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    offsets = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("__part"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = written.join(offsets, _same(written, offsets, [*keys, "_part"]))
    return joined.withColumn(name, F.col("_offset") + F.sum("_amount").over(inside) - F.col("_amount")).select(*df.columns, name)


def places(df: DataFrame, keys: list[str], order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with each row's number within its keys by ``order``, from 1; as `running_total`."""
    return running_total(df, keys, order, F.lit(1), name, parts).withColumn(name, F.col(name) + 1)


def percent_ranks(df: DataFrame, keys: list[str], value: str, name: str = "pct", parts: int | None = None) -> DataFrame:
    """``df`` with the share of its group's rows that are smaller, equal ones half and itself half more: the average rank of ties over the count.

    Values are counted first, so a tie of any size is one row of what is ranked. Null values are smallest, and tie.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    below = running_total(counts, keys, [F.col(value)], F.col("_ties"), "_below", parts)
    whole = counts.groupBy(*keys).agg(F.sum("_ties").alias("__rows"))
    ranked = below.join(whole.select(*[F.col(k).alias(f"_{k}") for k in keys], "__rows"), reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    ranked = ranked.select(*[F.col(c).alias(f"_{c}") for c in (*keys, value)], ((F.col("_below") + (F.col("_ties") + 1) / 2) / F.col("__rows")).alias(name))
    return df.join(ranked, _same(df, ranked, [*keys, value])).select(*df.columns, name)


def values_at(df: DataFrame, keys: list[str], value: str, at: dict[str, Column], parts: int | None = None) -> DataFrame:
    """keys and a column for each of ``at``: the value at that place among the group's rows by falling value. ``at`` are expressions of ``n``, the rows of the group; values aren't null."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    above = running_total(counts, keys, [F.col(value).desc()], F.col("_ties"), "_above", parts)
    whole = counts.groupBy(*keys).agg(F.sum("_ties").alias("n")).select(*[F.col(k).alias(f"_{k}") for k in keys], "n")
    rows = above.join(whole, _same(above, whole, keys))
    held = lambda c: (F.col("_above") < c) & (c <= F.col("_above") + F.col("_ties"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(held(c), F.col(value))).alias(name) for name, c in at.items()])


def fingerprint(df: DataFrame, keys: list[str], identity: Column) -> DataFrame:
    """keys, fingerprint, n: a digest of the rows' identities as a multiset, in no order, changed by any row more, less or other.

    Each identity's SHA-256 is eight numbers; their sums and the count are digested again. Sums merge, so no row grows with the group. A null identity is
    told from an empty one.
    """
    digest = F.sha2(F.concat(F.when(identity.isNull(), "n").otherwise("v"), F.coalesce(identity.cast("string"), F.lit(""))), 256)
    lanes = [F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    sums = df.select(*keys, digest.alias("_d")).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_s{k}") for k, c in enumerate(lanes)])
    told = F.concat_ws(":", "n", *[f"_s{k}" for k in range(8)])
    return sums.select(*keys, F.sha2(told, 256).alias("fingerprint"), "n")
