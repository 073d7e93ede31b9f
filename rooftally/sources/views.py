"""Footprint views over the star-schema tables: one text for Spark and for the SQL that checks it.

Coordinates are whole decimetres inside a cell of 300 m, boxes are half-open, areas are
exact square decimetres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 3000

_P = """
SELECT r.r_name AS region,
       concat('run_', CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END) AS model_run,
       l_suppkey AS grid_id,
       (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS poly_id,
       (l_orderkey * 7919 + l_partkey * 31) % 3000 AS x0,
       (l_orderkey * 104729 + l_partkey * 17) % 3000 AS y0,
       (l_orderkey * 7919 + l_partkey * 31) % 3000 + 20 + CAST(l_quantity AS BIGINT) * 4 AS x1,
       (l_orderkey * 104729 + l_partkey * 17) % 3000 + 20 + l_partkey % 160 AS y1,
       (20 + CAST(l_quantity AS BIGINT) * 4) * (20 + l_partkey % 160) AS area,
       CAST(round(1.0 - 5 * l_discount, 2) AS DOUBLE) AS confidence,
       CAST(round(0.5 + 5 * l_tax, 2) AS DOUBLE) AS second_score,
       CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'N' THEN 'edit' ELSE 'delete' END AS review_status,
       l_partkey % 256 AS mean_r, l_orderkey % 256 AS mean_g, (l_partkey + l_orderkey) % 256 AS mean_b,
       CAST(l_shipdate AS DATE) AS interval_end, l_orderkey AS order_id
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
"""

_G = """
SELECT r.r_name AS region, l_suppkey AS grid_id,
       (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS gt_id,
       (l_orderkey * 7919 + l_partkey * 31) % 3000 + l_orderkey % 21 - 10 AS x0,
       (l_orderkey * 104729 + l_partkey * 17) % 3000 + l_partkey % 21 - 10 AS y0,
       (l_orderkey * 7919 + l_partkey * 31) % 3000 + l_orderkey % 21 + 10 + CAST(l_quantity AS BIGINT) * 4 AS x1,
       (l_orderkey * 104729 + l_partkey * 17) % 3000 + l_partkey % 21 + 10 + l_partkey % 160 AS y1,
       (20 + CAST(l_quantity AS BIGINT) * 4) * (20 + l_partkey % 160) AS area,
       CASE l_returnflag WHEN 'A' THEN 'reviewed' WHEN 'N' THEN 'redrawn' ELSE 'marked' END AS source
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
WHERE l_linestatus = 'O' AND (l_orderkey + l_partkey) % 3 = 0
"""

_GRID = """
SELECT s_suppkey AS grid_id, r.r_name AS region, s_suppkey % 40 AS gx, CAST(floor(s_suppkey / 40) AS BIGINT) AS gy,
       (s_suppkey * 37 % 101) / 100.0E0 AS coverage_fraction,
       concat('stratum_', CAST(s_suppkey % 6 AS VARCHAR(2))) AS stratum
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey
"""

_UNITS = """
SELECT c_custkey AS unit_id, c_custkey % (SELECT count(*) FROM {supplier}) + 1 AS grid_id, c_acctbal / 1000 AS kw, CAST(round(c_acctbal * 100) AS BIGINT) AS centiwatts,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'MACHINERY' THEN 'industrial' ELSE 'commercial' END AS customer_type,
       c_custkey * 7919 % 3000 AS x, c_custkey * 104729 % 3000 AS y
FROM {customer}
"""

_MARKERS = """
SELECT o_orderkey AS marker_id, o_custkey % (SELECT count(*) FROM {supplier}) + 1 AS grid_id,
       o_orderkey * 7919 % 3000 AS x, o_orderkey * 104729 % 3000 AS y, CAST(o_orderdate AS DATE) AS created
FROM {orders}
"""

_INTERVALS = """
SELECT l_orderkey * 8 + l_linenumber AS item_id, l_suppkey AS grid_id, CAST(o_orderdate AS DATE) AS start_date,
       CAST(greatest(l_shipdate, o_orderdate) AS DATE) AS end_date,
       CASE WHEN l_linestatus = 'O' THEN 'dated' ELSE NULL END AS date_status,
       CASE WHEN l_returnflag = 'R' THEN 'no_imagery' ELSE NULL END AS undated_reason
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

_DECISIONS = """
SELECT event_id, user_id % 500 AS pred_id, user_id % 100 + 1 AS grid_id, ts,
       CASE event_type WHEN 'purchase' THEN true WHEN 'click' THEN true WHEN 'view' THEN NULL ELSE false END AS pv_present,
       CASE event_type WHEN 'signup' THEN 'skylight' WHEN 'error' THEN 'shadow' ELSE NULL END AS lookalike,
       CAST(least(value, 100) / 100 AS DOUBLE) AS confidence
FROM {events}
"""

_POOL = """
SELECT CAST(p_partkey AS VARCHAR(20)) AS chip_id, p_type AS archetype,
       CASE p_size % 3 WHEN 0 THEN 'A1' WHEN 1 THEN 'A2' ELSE 'A3' END AS archetype_confidence,
       CASE p_partkey % 5 WHEN 0 THEN 'AFRICA' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'ASIA' WHEN 3 THEN 'EUROPE' ELSE 'MIDDLE EAST' END AS region,
       p_partkey % 100 + 1 AS grid_id,
       CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS training_eligible,
       CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat('BOX ', CAST(p_partkey AS VARCHAR(20))) END AS bbox_geo
FROM {part}
"""

TEXTS = {
    "predictions": _P, "ground_truth": _G, "task_grid": _GRID, "units": _UNITS, "markers": _MARKERS,
    "intervals": _INTERVALS, "decisions": _DECISIONS, "negative_pool": _POOL,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The number of a box. At order keys of 11 million and more it is beyond a long, where SQL has no result; Spark goes on with its lowest 63 bits, which no later sum or product of the view overflows.
_ID = "(((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)"
#: The same as (its 11 lowest bits, the others): 100000 * 10000 * 100 is 48828125 * 2 ** 11, and shifts drop what doesn't fit.
_REST = "(l_partkey * 1000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT))"
_HIGH = f"((l_orderkey * 8 + l_linenumber) * 48828125 + shiftright({_REST}, 11))"
_LONG_ID = f"((shiftleft({_HIGH}, 11) | ({_REST} & 2047)) & IF({_HIGH} < {2**52}, -1L, {2**63 - 1}))"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEXTS[name].replace(_ID, _LONG_ID)
    return spark.sql(text.replace("VARCHAR(20)", "STRING").replace("VARCHAR(2)", "STRING"), **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


#: The model runs of the tables.
RUNS = ["run_A", "run_B", "run_C"]


def for_each_run(df: DataFrame) -> DataFrame:
    """``df`` once for each run, told in ``model_run``."""
    return df.withColumn("model_run", F.explode(F.array(*map(F.lit, RUNS))))


def with_views(*names: str) -> str:
    """``WITH`` clause of the views, for the SQL that checks a query."""
    return "WITH " + ",\n".join(f"{n} AS ({TEXTS[n].format(**{t: t for t in TABLES})})" for n in names)
