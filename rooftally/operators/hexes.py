"""Hexagons over a metric plane by axial numbers (q, r): keys and neighbours as expressions, and fits by hexagon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.operators import columns

#: Steps from a hexagon to its six neighbours.
AROUND = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))
_WIDE, _HALF, _HIGH = math.sqrt(3) / 3, 1 / 3, 2 / 3


def key(x: Column, y: Column, side: float) -> Column:
    """struct(q, r) of the hexagon, with a corner on top and sides of ``side``, that holds the point; points on a border belong to one of its sides.

    Both fractional numbers and minus their sum are rounded; the one that moved furthest is set so that the three add up to nothing.
    """
    fq, fr = (_WIDE * x - _HALF * y) / side, (_HIGH * y) / side
    fs = -fq - fr
    q, r, s = (F.floor(v + 0.5) for v in (fq, fr, fs))
    dq, dr, ds = F.abs(q - fq), F.abs(r - fr), F.abs(s - fs)
    return F.struct(
        F.when((dq > dr) & (dq > ds), -r - s).otherwise(q).cast("long").alias("q"), F.when((dr > ds) & ~((dq > dr) & (dq > ds)), -q - s).otherwise(r).cast("long").alias("r")
    )


def key_of_degrees(lon: Column, lat: Column, side: float) -> Column:
    """`key` on the web Mercator plane, whose metres grow with the latitude as they do there."""
    return key(*columns.web_mercator(lon, lat), side)


def center(h: Column, side: float) -> tuple[Column, Column]:
    return side * math.sqrt(3) * (h["q"] + h["r"] / 2), side * 1.5 * h["r"]


def neighbours(h: Column) -> Column:
    """The six hexagons around, as an array."""
    return F.array(*[F.struct((h["q"] + q).cast("long").alias("q"), (h["r"] + r).cast("long").alias("r")) for q, r in AROUND])


def distance(a: Column, b: Column) -> Column:
    """Steps from one hexagon to another."""
    q, r = a["q"] - b["q"], a["r"] - b["r"]
    return ((F.abs(q) + F.abs(r) + F.abs(q + r)) / 2).cast("long")


def sums_around(df: DataFrame, keys: list[str], h: str, value: str, name: str) -> DataFrame:
    """``df`` (a row for each of keys and hexagon) with ``name``: the sum of ``value`` over the hexagon's neighbours that have rows, 0 without any."""
    told = df.select(*keys, F.explode(neighbours(F.col(h))).alias("_h"), F.col(value).alias("_v")).groupBy(*keys, F.col("_h").alias(h)).agg(F.sum("_v").alias(name))
    return df.join(told, [*keys, h], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def fits(df: DataFrame, keys: list[str], x: str, y: str, populations: dict[str, tuple[Column, bool]]) -> DataFrame:
    """keys, population, n, slope, intercept, r2 of y over x for each population (condition, and whether both are taken as logarithms, which leaves out what isn't positive).

    A population without a row in a key has none; one point or equal ones have no slope. Null values are left out.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    every = []
    for name, (rule, logs) in populations.items():
        some = F.coalesce(rule, F.lit(False)) & both & ((F.col(x) > 0) & (F.col(y) > 0) if logs else F.lit(True))
        a, b = (F.when(some, F.log(c) if logs else F.col(c).cast("double")) for c in (x, y))
        every.append(F.struct(F.lit(name).alias("population"), F.count_if(some).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2")))
    return df.groupBy(*keys).agg(F.array(*every).alias("f")).select(*keys, F.explode("f").alias("f")).select(*keys, "f.*").where("n > 0")
