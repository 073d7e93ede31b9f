"""Derived columns: buckets, cascades, tiers, identifiers, normalised texts, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], otherwise: str | None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(otherwise)
    for rule, label in reversed(rules):
        out = F.when(rule, F.lit(label)).otherwise(out)
    return out


def bucket(value: Column, edges: list[float], labels: list[str], closed: str = "left") -> Column:
    """Label of the class of ``value``: [a, b) if ``closed`` is left, (a, b] if right. The last class is open."""
    below = (lambda e: value < e) if closed == "left" else (lambda e: value <= e)
    out = first_match([(below(e), x) for e, x in zip(edges, labels)], labels[-1])
    return F.when(value.isNotNull(), out)


def tiered_keep(area: Column, value: Column, tiers: list[tuple[float, float]]) -> Column:
    """(least area, least value) tiers from the largest area down: the first whose area fits decides; none drops."""
    out = F.lit(False)
    for least, bound in reversed(tiers):
        out = F.when(area >= least, value >= bound).otherwise(out)
    return out


def tiered_keep_any(area: Column, value: Column, tiers: list[tuple[float, float]]) -> Column:
    """Any tier whose area and value fit admits."""
    out = F.lit(False)
    for least, bound in tiers:
        out = out | ((area >= least) & (value >= bound))
    return out


def box_shape(df: DataFrame) -> DataFrame:
    """area, elongation (long side over short), perimeter, complexity (perimeter over that of a circle of the area)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    perimeter = 2 * (w + h)
    return df.withColumns({
        "area": w * h,
        "elongation": F.when(F.least(w, h) > 0, F.greatest(w, h) / F.least(w, h)).otherwise(1.0),
        "perimeter": perimeter,
        "complexity": F.when(w * h > 0, perimeter / (2 * F.sqrt(F.lit(math.pi) * w * h))),
    })


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.least(F.greatest(F.floor((lon + 180) / 6) + 1, F.lit(1)), F.lit(60))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("int")


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return lon * (math.pi / 180 * r), F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360))) * r


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return x * (180 / math.pi / r), (2 * F.atan(F.exp(y / r)) - math.pi / 2) * (180 / math.pi)


def tri_state(value: Column) -> Column:
    """true, false or null from the spellings that reviewers use; what isn't known stays null."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1", "yes", "y", "pv"), True).when(low.isin("false", "0", "no", "n", "not_pv", "non_pv"), False)


def eligible(value: Column) -> Column:
    """Only an explicit false gates out; blank and missing are eligible."""
    return F.lower(F.trim(F.coalesce(value, F.lit("")))) != "false"


def funnel(df: DataFrame, keys: list[str], stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows that pass each stage and all before it, in one pass; a null verdict doesn't pass."""
    passed, counts = F.lit(True), [F.count("*").alias("n_in")]
    for name, rule in stages:
        passed = passed & F.coalesce(rule, F.lit(False))
        counts.append(F.count_if(passed).alias(f"n_{name}"))
    return df.groupBy(*keys).agg(*counts)


def quartiles(df: DataFrame, key: str, by: str, kinds: list[str], value: str) -> DataFrame:
    """Per key: n, p25, p50 and p75 of ``value``, and its median for each of ``kinds`` of ``by`` in a column of that name."""
    all_ = [F.round(F.percentile(value, F.lit(q)), 6).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    of = [F.round(F.percentile(F.when(F.col(by) == k, F.col(value)), F.lit(0.5)), 6).alias(k) for k in kinds]
    return df.groupBy(key).agg(F.count("*").alias("n"), *all_, *of)


def degree_tiles(df: DataFrame, lon: str, lat: str, side: str, step: float) -> DataFrame:
    """Tiles of ``step`` degrees of each square (lower left corner and side), by col and row, the last ones cut at its edge."""
    n = F.ceil(F.round(F.col(side) / step, 6)).cast("int")
    t = df.withColumn("col", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), n - 1)))
    low = lambda start, i: F.round(F.col(start) + F.col(i) * step, 6)
    high = lambda start, i: F.round(F.least(F.col(start) + (F.col(i) + 1) * step, F.col(start) + F.col(side)), 6)
    return t.withColumns({"x0": low(lon, "col"), "y0": low(lat, "row"), "x1": high(lon, "col"), "y1": high(lat, "row")})
