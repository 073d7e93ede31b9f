"""Ranks over many ranges, resampling, fingerprints, hexagons and flattened texts against plain loops."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rooftally.operators import hexes, nested, ranks, stats


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["one", "one", "one", "two", None]), rng.choice([1, 1, 1, 2, 3, 5, None, rng.randrange(50)]), i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_places_and_totals(spark, parts):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = {r.i: (r.place, r.before) for r in ranks.running_total(ranks.places(df, ["k"], [F.col("v").desc_nulls_last(), F.col("i")], parts=parts), ["k"], [F.col("v").desc_nulls_last(), F.col("i")], F.col("v"), parts=parts).collect()}
    want = {}
    for k in {r[0] for r in data}:
        total = 0
        for place, (_, v, i) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is None, -(r[1] or 0), r[2])), 1):
            want[i] = (place, total)
            total += v or 0
    assert got == want


@pytest.mark.parametrize("parts", [1, 9])
def test_percent_ranks_and_values_at(spark, parts):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, v int, i int")
    got = {r.i: r.pct for r in ranks.percent_ranks(df, ["k"], "v", parts=parts).collect()}
    for k, v, i in data:
        own = [-1 if r[1] is None else r[1] for r in data if r[0] == k]
        x = -1 if v is None else v
        assert got[i] == pytest.approx((sum(y < x for y in own) + (own.count(x) + 1) / 2) / len(own))
    whole = df.where("v is not null")
    found = {r.k: (r.first, r.middle) for r in ranks.values_at(whole, ["k"], "v", {"first": F.lit(1), "middle": F.ceil(F.col("n") / 2)}, parts).collect()}
    for k in {r[0] for r in data}:
        own = sorted((r[1] for r in data if r[0] == k and r[1] is not None), reverse=True)
        assert found[k] == (own[0], own[math.ceil(len(own) / 2) - 1])
    assert ranks.percent_ranks(df.limit(0), ["k"], "v").count() == 0


def test_no_range_holds_a_group(spark):
    df = spark.range(20_000).select(F.lit("all").alias("k"), (F.col("id") % 3).alias("v"), "id")
    placed = ranks.places(df, ["k"], [F.col("v"), F.col("id")], parts=8)
    assert placed.agg(F.min("place"), F.max("place"), F.countDistinct("place")).first() == (1, 20_000, 20_000)
    sizes = [r["count"] for r in df.repartitionByRange(8, "k", "v", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(300)] + [("b", "x"), ("b", None), (None, "")], "k string, i string")
    of = lambda d: {r.k: (r.fingerprint, r.n) for r in ranks.fingerprint(d, ["k"], F.col("i")).collect()}
    one = of(df)
    assert of(df.repartition(7).orderBy(F.rand(3))) == one and one["a"][1] == 300 and one[None][1] == 1
    for changed in (df.where("i != '17'"), df.unionByName(df.where("i = '17'")), df.withColumn("i", F.when(F.col("i") == "17", "170").otherwise(F.col("i")))):
        assert of(changed)["a"][0] != one["a"][0]
    assert of(df.na.fill(""))["b"][0] != one["b"][0] and of(df.limit(0)) == {}


def test_intervals_hold_the_mean_and_follow_its_error(spark):
    rng = random.Random(7)
    data = [("wide", i, rng.gauss(5, 2)) for i in range(400)] + [("two", i, float(i)) for i in range(2)] + [(None, i, 3.0) for i in range(5)] + [("wide", 9999, None)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    own = [v for k, _, v in data if k == "wide" and v is not None]
    mean, sd = sum(own) / 400, math.sqrt(sum((v - sum(own) / 400) ** 2 for v in own) / 399)
    got = {r.k: r for r in stats.bootstrap_ci(df, ["k"], "i", "v").collect()}
    half = 1.96 * sd / 20
    assert got["wide"].n == 400 and got["wide"].ci_low == pytest.approx(mean - half, abs=0.06) and got["wide"].ci_high == pytest.approx(mean + half, abs=0.06)
    assert got["two"].ci_low is None and (got[None].ci_low, got[None].ci_high) == (3.0, 3.0)
    spread = {r.k: r for r in stats.bootstrap_ci(df, ["k"], "i", "v", "std").collect()}
    assert spread["wide"].ci_low < sd < spread["wide"].ci_high and spread["wide"].ci_high - spread["wide"].ci_low < 0.5
    assert stats.bootstrap_ci(df.repartition(5), ["k"], "i", "v").where("k = 'wide'").first() == got["wide"]
    far = stats.bootstrap_ci(df.withColumn("v", F.col("v") + 1e9), ["k"], "i", "v", "std").where("k = 'wide'").first()
    assert far.ci_low == pytest.approx(spread["wide"].ci_low, abs=1e-4)


def test_hexagons(spark):
    rng = random.Random(9)
    points = [(i, rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(500)]
    side = 70.0
    h = hexes.key(F.col("x"), F.col("y"), side)
    cx, cy = hexes.center(F.col("h"), side)
    df = spark.createDataFrame(points, "i int, x double, y double").withColumn("h", h).withColumns({"cx": cx, "cy": cy})
    near = df.withColumn("far", F.array_min(F.transform(hexes.neighbours(F.col("h")), lambda n: F.hypot(hexes.center(n, side)[0] - F.col("x"), hexes.center(n, side)[1] - F.col("y")))))
    assert near.where(F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")) > F.col("far") + 1e-9).count() == 0  # none of the six centres is nearer
    steps = near.select(F.forall(hexes.neighbours(F.col("h")), lambda n: hexes.distance(n, F.col("h")) == 1).alias("ok")).distinct().collect()
    assert [r.ok for r in steps] == [True]
    cells = spark.createDataFrame([("r", (0, 0), 1), ("r", (1, 0), 2), ("r", (0, 1), 4), ("r", (5, 5), 8), ("s", (0, -1), 16)], "k string, h struct<q:long,r:long>, v int")
    assert {(r.k, tuple(r.h)): r.around for r in hexes.sums_around(cells, ["k"], "h", "v", "around").collect()} == {("r", (0, 0)): 6, ("r", (1, 0)): 5, ("r", (0, 1)): 3, ("r", (5, 5)): 0, ("s", (0, -1)): 0}


def test_fits(spark):
    df = spark.createDataFrame([("a", float(x), 2.0 * x + 1, x % 2) for x in range(8)] + [("b", 1.0, 1.0, 0), ("a", None, 5.0, 1)], "k string, x double, y double, odd int")
    got = {(r.k, r.population): r for r in hexes.fits(df, ["k"], "x", "y", {"all": (F.lit(True), False), "odd": (F.col("odd") == 1, False), "log": (F.lit(True), True)}).collect()}
    assert (got["a", "all"].n, round(got["a", "all"].slope, 9), round(got["a", "all"].intercept, 9)) == (8, 2, 1) and got["a", "odd"].n == 4 and got["a", "log"].n == 7
    assert ("b", "odd") not in got and got["b", "all"].slope is None


def leaves(v, path=""):
    if isinstance(v, (dict, list)) and v:
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, f"{path}.{k}" if path else str(k))
    else:
        yield path, v


def test_flattened_texts(spark):
    deep = 1
    for k in range(9):
        deep = {"d": deep} if k % 2 else [deep, {}]
    docs = [{"a": {"b": [1, {"c": "x"}, None, [], [[2]]], "e": {}}, "t": True, "f": 1.5}, deep, [], "alone", 7, None, {"a.b": {"c": 1}}]
    data = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(50, "{broken"), (51, None)]
    got = defaultdict(list)
    for r in nested.flattened(spark.createDataFrame(data, "i int, doc string"), ["i"], "doc").collect():
        got[r.i].append((r.path, r.value))
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted((p, text(v)) for p, v in leaves(d)) for i, d in enumerate(docs)}
    assert nested.flattened(spark.createDataFrame([], "i int, doc string"), ["i"], "doc").count() == 0
