"""Cutting lineage: the estimate stays small over rounds, names, types and nulls stay, files of rounds that are over go."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from rooftally.functions.session import cut, drop
from rooftally.operators.graph import components


def estimate(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_estimate_stays_small_over_rounds(spark):
    df = spark.range(50).select("id", F.lit(1).alias("n"))
    for _ in range(30):
        df = cut(df.join(df.select("id", F.col("n").alias("m")), "id").select("id", (F.col("n") + F.col("m") - 1).alias("n")), df)
        assert estimate(df) < 1 << 40
    assert df.agg(F.sum("n")).first()[0] == 50 * 1


def test_names_types_and_nulls_stay(spark):
    rows = spark.createDataFrame([(1, "x", Decimal("12345678901234567890"), [1, None], None), (None, None, None, None, None)], "a long, A string, d decimal(38,0), l array<int>, v void")
    back = cut(rows)
    assert back.columns == rows.columns and back.dtypes == rows.dtypes
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)
    assert cut(rows.limit(0)).count() == 0 and cut(rows.select("v")).count() == 2


def test_files_of_a_round_go(spark):
    one = cut(spark.range(3))
    two = cut(one.select(F.col("id") + 1), one)
    place = lambda df: df._files.removeprefix("file:")
    assert not os.path.exists(place(one)) and os.path.exists(place(two)) and two.count() == 3
    drop(two, spark.range(1))
    assert not os.path.exists(place(two))


def test_components_of_their_own_labels(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = components(edges, "a", "b")
    assert estimate(labels) < 1 << 30
    again = components(labels, "node", "label")
    assert again.agg(F.count("*"), F.max("label")).first() == (3001, 0)
