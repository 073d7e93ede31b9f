"""Queries that choose, merge and write tables of footprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rooftally.operators import columns
from rooftally.plans.registry import query
from rooftally.sources.views import view, with_views

_P = with_views("predictions")


@query(f"{_P}, c AS (SELECT region, grid_id, model_run, count(*) AS n FROM predictions GROUP BY ALL) SELECT region, grid_id, model_run AS layer, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY region, grid_id ORDER BY n DESC, model_run) = 1")
def a2_pick_largest_layer(spark, d):
    c = view(spark, d, "predictions").groupBy("region", "grid_id", F.col("model_run").alias("layer")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("region", "grid_id").orderBy(F.desc("n"), "layer"))
    return c.withColumn("k", rank).where("k = 1").drop("k")


@query("""WITH f AS (SELECT p_partkey % 97 AS grid_id, concat('G', p_partkey % 97, CASE p_size % 4 WHEN 0 THEN '_SAM2_' WHEN 1 THEN '_V4_' WHEN 2 THEN '_reviewed' ELSE '' END, p_partkey) AS name FROM part)
SELECT grid_id, name FROM f QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY CASE WHEN name LIKE '%\\_SAM2\\_%' ESCAPE '\\' THEN 0 WHEN name LIKE '%\\_V4\\_%' ESCAPE '\\' THEN 1 WHEN name LIKE '%\\_reviewed%' ESCAPE '\\' THEN 2 ELSE 3 END, name DESC) = 1""")
def a3_discover_best_file(spark, d):
    """The file of each grid: by the tag in its name, inside a tag the newest name."""
    tag = F.element_at(F.array(*map(F.lit, ("_SAM2_", "_V4_", "_reviewed", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    grid = F.col("p_partkey") % 97
    f = spark.read.parquet(f"{d}/part.parquet").select(grid.alias("grid_id"), F.concat(F.lit("G"), grid, tag, "p_partkey").alias("name"))
    best = columns.first_match([(F.col("name").contains(t), str(i)) for i, t in enumerate(("_SAM2_", "_V4_", "_reviewed"))], "3")
    rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(best, F.desc("name")))
    return f.withColumn("k", rank).where("k = 1").drop("k")
