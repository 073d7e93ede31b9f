"""Training tables: chips of a split with positives, balanced negatives and hard negatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.operators import sampling


def smallest(df: DataFrame, group: str, quota: dict, id_: Column, seed: str) -> DataFrame:
    """Of each group, the ``quota[group]`` rows of the smallest digests, group by group: each is a top-k that tasks cut before they send it."""
    d = sampling.digest(seed, id_)
    parts = [df.where(F.col(group) == g).withColumns({"_d": d, "_i": id_}).orderBy("_d", "_i").limit(int(n)).drop("_d", "_i") for g, n in quota.items()]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else df.limit(0)


def dataset_build(chips: DataFrame, hits: DataFrame, faults: DataFrame, split: Column, id_: Column, negatives: float, hard: int, untrusted: float, seed: str = "42") -> DataFrame:
    """``chips`` with ``split``, ``kind`` (positive, hard_negative, negative) and ``trusted``.

    hits: chip rows with ``trusted``, any of which makes a chip trusted; untrusted positives stay up to ``untrusted`` times the trusted ones of their split, by
    digest. Hard negatives are chips with a row in ``faults`` and no hit, ``hard`` of a split at most; negatives are other chips without a hit, ``negatives`` times
    the positives. Splits are few; a split without trusted positives has none. ``id_`` names a chip.
    """
    keys = chips.columns
    chips = chips.withColumn("split", split)
    found = hits.groupBy(*keys).agg(F.bool_or("trusted").alias("trusted"))
    positive = chips.join(found, keys)
    sure = {r[0]: r[1] for r in positive.where("trusted").groupBy("split").count().collect()}  # a row a split
    unsure = smallest(positive.where("not trusted"), "split", {s: n * untrusted for s, n in sure.items()}, id_, seed)
    positive = positive.where("trusted").unionByName(unsure).withColumn("kind", F.lit("positive"))
    many = {r[0]: r[1] for r in positive.groupBy("split").count().collect()}
    rest = chips.join(found, keys, "left_anti")
    bad = faults.select(*keys).distinct()
    worst = smallest(rest.join(bad, keys, "left_semi"), "split", dict.fromkeys(many, hard), id_, seed)
    plain = smallest(rest.join(bad, keys, "left_anti"), "split", {s: n * negatives for s, n in many.items()}, id_, seed)
    none = F.lit(None).cast("boolean")
    return positive.unionByName(worst.withColumns({"trusted": none, "kind": F.lit("hard_negative")})).unionByName(plain.withColumns({"trusted": none, "kind": F.lit("negative")}))
