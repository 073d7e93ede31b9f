"""Queries that write tables to the shared folder in several formats and read them back with the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rooftally.functions.session import shared_dir
from rooftally.operators import columns, rings
from rooftally.plans.registry import query
from rooftally.sources import readers
from rooftally.sources.views import table, view, with_views

_P, _G = with_views("predictions"), with_views("ground_truth")


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"{_P} SELECT 'first' AS pick, region, model_run AS layer, CAST(count(*) AS BIGINT) AS n, CAST(sum(area) AS DOUBLE) AS area FROM predictions WHERE model_run = 'run_A' GROUP BY ALL UNION ALL SELECT 'named', region, model_run, CAST(count(*) AS BIGINT), CAST(sum(area) AS DOUBLE) FROM predictions WHERE model_run = 'run_C' GROUP BY ALL")
def a1_read_polygons(spark, d):
    """A file of layers: the first, and one by name; areas are of the rings that were read."""
    out = folder(spark, "layers")
    p = view(spark, d, "predictions").select("region", "poly_id", F.col("model_run").alias("layer"), (F.ascii(F.substring("model_run", 5, 1)) - 65).alias("layer_no"), rings.to_wkt(rings.box_ring()).alias("wkt"))
    p.write.parquet(out)
    both = [readers.read_polygons(spark, out).withColumn("pick", F.lit("first")), readers.read_polygons(spark, out, "run_C").withColumn("pick", F.lit("named"))]
    return both[0].unionByName(both[1]).groupBy("pick", "region", "layer").agg(F.count("*").alias("n"), F.sum(rings.area(F.col("ring"))).alias("area"))


_TAG = "CASE WHEN grid_id % 5 = 0 AND source = 'marked' THEN '_SAM2_' WHEN grid_id % 3 = 0 AND source = 'redrawn' THEN '_V4_' WHEN source = 'reviewed' THEN '_reviewed' ELSE 'plain' END"


@query(f"""{_G}, f AS (SELECT *, {_TAG} AS tag FROM ground_truth), c AS (SELECT region, grid_id, tag, count(*) AS n, sum(area) AS area FROM f GROUP BY ALL)
SELECT region, grid_id, tag, CAST(n AS BIGINT) AS n, CAST(area AS BIGINT) AS area FROM c QUALIFY row_number() OVER (PARTITION BY region, grid_id ORDER BY CASE tag WHEN '_SAM2_' THEN 0 WHEN '_V4_' THEN 1 WHEN '_reviewed' THEN 2 ELSE 3 END, tag DESC) = 1""")
def a3_discover_gt(spark, d):
    """Ground truth in folders named by a tag: of each grid, the file with the best tag in its path."""
    out = folder(spark, "truth")
    g = view(spark, d, "ground_truth").withColumn("tag", F.expr(_TAG))
    g.select("region", "grid_id", "gt_id", "area", "tag").write.partitionBy("tag").parquet(out)
    rank = columns.first_match([(F.col("path").contains(t), str(i)) for i, t in enumerate(("_SAM2_", "_V4_", "_reviewed"))], "3")
    rows = readers.discover(spark, out, ["region", "grid_id"], rank, [F.desc("path")])
    return rows.groupBy("region", "grid_id", "tag").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query(f"""{_G}, k AS (SELECT r_name AS region, CASE r_regionkey % 3 WHEN 0 THEN 'marked' WHEN 1 THEN 'redrawn' ELSE 'none_yet' END AS scheme FROM region),
c AS (SELECT g.region, grid_id, source AS scheme, k.scheme IS NOT NULL AS is_registered, count(*) AS n FROM ground_truth g LEFT JOIN k ON g.region = k.region AND g.source = k.scheme WHERE grid_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 11 = 0) GROUP BY ALL)
SELECT region, grid_id, scheme, is_registered, CAST(n AS BIGINT) AS n FROM c QUALIFY row_number() OVER (PARTITION BY region, grid_id ORDER BY NOT is_registered, scheme) = 1""")
def a4_discover_annotations(spark, d):
    """A region's registered scheme first, then whatever the folders hold; some grids are excluded."""
    out = folder(spark, "annotations")
    view(spark, d, "ground_truth").select("region", F.col("source").alias("scheme"), "grid_id", "gt_id").write.partitionBy("region", "scheme").parquet(out)
    key = F.col("r_regionkey") % 3
    registered = table(spark, d, "region").select(F.col("r_name").alias("region"), F.when(key == 0, "marked").when(key == 1, "redrawn").otherwise("none_yet").alias("scheme"))
    excluded = table(spark, d, "supplier").where("s_suppkey % 11 = 0").select(F.col("s_suppkey").alias("grid_id"))
    rows = readers.discover_annotations(spark, out, ["region", "grid_id"], registered, excluded)
    return rows.groupBy("region", "grid_id", "scheme", "is_registered").agg(F.count("*").alias("n"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS chip_id, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_partkey % 100 + 1 AS INTEGER) END AS grid_id, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS eligible, p_retailprice AS price,
CASE WHEN p_partkey % 13 = 0 THEN 'grid_id' ELSE '' END AS bad FROM part""")
def a5_read_manifest_csv(spark, d):
    """A manifest as CSV with some grids that are no numbers and blank flags."""
    out, k = folder(spark, "manifest"), F.col("p_partkey")
    rows = table(spark, d, "part").select(k.cast("string").alias("chip_id"), F.when(k % 13 == 0, "n/a").otherwise((k % 100 + 1).cast("string")).alias("grid_id"), F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("").alias("eligible"), F.col("p_retailprice").alias("price"))
    rows.write.option("header", "true").csv(out)
    return readers.read_manifest_csv(spark, out, "chip_id string, grid_id int, eligible boolean, price double")


@query(f"""{with_views('decisions')} SELECT CASE WHEN event_id % 50 <> 7 THEN event_id END AS event_id, CASE WHEN event_id % 50 <> 7 THEN grid_id END AS grid_id, CASE WHEN event_id % 50 <> 7 THEN pv_present END AS pv_present,
CASE WHEN event_id % 50 = 7 THEN concat('{{"event_id": ', event_id, ', broken') END AS broken FROM decisions""")
def a6_read_decisions_jsonl(spark, d):
    """A log of JSON lines, some of them cut off; booleans that are absent stay null."""
    out, good = folder(spark, "log"), F.col("event_id") % 50 != 7
    line = F.when(good, F.to_json(F.struct("event_id", "grid_id", "pv_present"))).otherwise(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", broken")))
    view(spark, d, "decisions").select(line.alias("value")).write.text(out)
    return readers.read_decisions_jsonl(spark, out, "event_id bigint, grid_id bigint, pv_present boolean", strict=False)


@query(f"""{_G} SELECT concat('G', grid_id, '_', gt_id) AS name, CASE WHEN gt_id % 7 <> 3 THEN CAST(grid_id AS VARCHAR) END AS grid, CASE WHEN gt_id % 9 <> 4 THEN CAST(area AS DOUBLE) END AS area, gt_id % 9 = 4 AS is_empty FROM (SELECT * REPLACE (CASE WHEN gt_id % 7 = 3 THEN -1 ELSE grid_id END AS grid_id) FROM ground_truth)""")
def a7_read_kml_placemarks(spark, d):
    """Placemarks with a name and an outer ring; some names hold no grid, some rings are empty."""
    out = folder(spark, "kml")
    g = view(spark, d, "ground_truth").withColumn("name", F.concat(F.lit("G"), F.when(F.col("gt_id") % 7 == 3, -1).otherwise(F.col("grid_id")).cast("string"), F.lit("_"), F.col("gt_id").cast("string")))
    ring = rings.box_ring()
    points = F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), F.lit("0"))), " ")
    shape = F.struct(F.struct(F.struct(points.alias("coordinates")).alias("LinearRing")).alias("outerBoundaryIs"))
    g.select("name", F.when(F.col("gt_id") % 9 != 4, shape).alias("Polygon")).write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(out)
    rows = readers.read_kml_placemarks(spark, out, r"^G([0-9]+)_")
    return rows.select("name", "grid", rings.area(F.col("ring")).alias("area"), F.col("ring").isNull().alias("is_empty"))


@query(f"{_P} SELECT region, model_run, grid_id, CAST(x0 // 750 AS BIGINT) AS chip_x, CAST(y0 // 750 AS BIGINT) AS chip_y, poly_id, confidence, area FROM predictions")
def a8_read_raw_artifact(spark, d):
    """Detections nested by grid and chip, flattened again."""
    out, keys = folder(spark, "artifact"), ["region", "model_run", "grid_id"]
    p = view(spark, d, "predictions").withColumns({"chip_x": F.floor(F.col("x0") / 750), "chip_y": F.floor(F.col("y0") / 750)})
    readers.as_artifact(p, keys, ["chip_x", "chip_y"], ["poly_id", "confidence", "area"]).write.parquet(out)
    return readers.read_raw_artifact(spark, out)


@query(f"""{with_views('task_grid')} SELECT grid_id, concat('t', i, '_', j) AS name, CAST(i * 75 + gx * 300 AS DOUBLE) AS x0, CAST(j * 75 + gy * 300 AS DOUBLE) AS y0, CAST(i * 75 + 75 + gx * 300 AS DOUBLE) AS x1, CAST(j * 75 + 75 + gy * 300 AS DOUBLE) AS y1, 750 AS width, 750 AS height
FROM task_grid, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)""")
def a9_read_tile_index(spark, d):
    """Tiles of each cell stored as raster files are: a size in pixels and an affine transform with the upper left corner."""
    out, every = folder(spark, "tiles"), F.explode(F.sequence(F.lit(0), F.lit(3)))
    t = view(spark, d, "task_grid").withColumn("i", every).withColumn("j", every)
    affine = F.struct(F.lit(0.1).alias("a"), F.lit(0.0).alias("b"), (F.col("i") * 75 + F.col("gx") * 300).cast("double").alias("c"), F.lit(0.0).alias("d"), F.lit(-0.1).alias("e"), (F.col("j") * 75 + 75 + F.col("gy") * 300).cast("double").alias("f"))
    t.select("grid_id", F.format_string("t%d_%d", "i", "j").alias("name"), F.lit(750).alias("width"), F.lit(750).alias("height"), affine.alias("t")).write.parquet(out)
    edges = [F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return readers.read_tile_index(spark, out).select("grid_id", "name", *edges, "width", "height")


@query(f"""{with_views('predictions', 'task_grid')} SELECT p.region, model_run, poly_id, area, confidence, strftime(interval_end, '%Y-%m-%d') AS interval_end, true AS in_all, 'v1' AS config
FROM predictions p WHERE confidence >= 0.9""")
def a10_write_inventory(spark, d):
    """The inventory by region and run, its exchange copy, CSV and configuration; rows that all three copies agree on."""
    out, contract = folder(spark, "inventory"), ["poly_id", "area", "confidence", "interval_end"]
    rows = view(spark, d, "predictions").where("confidence >= 0.9")
    place = rings.from_utm(500_000 + F.col("x0") / 10, 6_250_000 + F.col("y0") / 10, F.lit(32734))
    readers.write_inventory(rows, out, contract, ["region", "model_run"], place, {"policy": "v1"})
    metric = spark.read.schema("poly_id bigint, area bigint, confidence double, interval_end date, region string, model_run string").parquet(f"{out}/metric")
    flat = readers.read_manifest_csv(spark, f"{out}/table", "poly_id bigint, area bigint, confidence double, interval_end date").drop("bad").withColumn("csv", F.lit(True))
    exchange = spark.read.parquet(f"{out}/exchange").where("lat between -34 and -33 and lon between 20 and 22").select("poly_id", F.lit(True).alias("exchange"))
    config = spark.read.schema("policy string").json(f"{out}/config")
    policy = config.first()[0]  # one row
    rows = metric.join(flat, contract, "left").join(exchange, "poly_id", "left")
    agreed = F.coalesce(F.col("csv") & F.col("exchange"), F.lit(False))
    return rows.select("region", "model_run", "poly_id", "area", "confidence", F.date_format("interval_end", "yyyy-MM-dd").alias("interval_end"), agreed.alias("in_all"), F.lit(policy).alias("config"))


@query(f"""{with_views('predictions', 'task_grid')}, r AS (SELECT unnest(['run_A', 'run_B', 'run_C']) AS model_run), c AS (SELECT grid_id, model_run, count(*) FILTER (WHERE confidence >= 0.99 AND area > 19000) AS n FROM predictions GROUP BY ALL)
SELECT t.region, r.model_run, CASE WHEN n > 0 THEN 'with_detections' WHEN n = 0 THEN 'empty' ELSE 'missing' END AS status, CAST(count(*) AS BIGINT) AS n_grids, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM task_grid t JOIN r ON true LEFT JOIN c ON c.grid_id = t.grid_id AND c.model_run = r.model_run GROUP BY ALL""")
def a11_merge_census(spark, d):
    """Grids with detections, empty and missing ones of each run's census, by region."""
    keep = (F.col("confidence") >= 0.99) & (F.col("area") > 19000)
    _, status = readers.merge_census(view(spark, d, "predictions"), view(spark, d, "task_grid").select("region", "grid_id"), ["run_A", "run_B", "run_C"], keep)
    return status.groupBy("region", "model_run", "status").agg(F.count("*").alias("n_grids"), F.sum("n").alias("n"))


@query(f"{_P} SELECT poly_id, grid_id AS gridcell_id, concat_ws('/', region, model_run) AS layer, area FROM predictions WHERE confidence >= 0.9")
def a11_merged_rows(spark, d):
    """The census as one table, each row with its cell and layer."""
    rows, _ = readers.merge_census(view(spark, d, "predictions"), view(spark, d, "task_grid").select("region", "grid_id"), ["run_A", "run_B", "run_C"], F.col("confidence") >= 0.9)
    return rows.select("poly_id", "gridcell_id", "layer", "area")


@query(f"""{_P}, c AS (SELECT region, model_run AS run, count(*) AS n, min(year(interval_end)) AS y, model_run = 'run_C' OR region = 'ASIA' AS bare FROM predictions GROUP BY region, model_run)
SELECT region, run, CASE WHEN bare OR run = 'run_B' THEN substr(run, 5, 1) ELSE concat(region, '-2') END AS version, CASE WHEN NOT bare THEN concat('aerial ', y) END AS imagery, CAST(n AS BIGINT) AS n_rows FROM c""")
def a12_inventory_snapshot(spark, d):
    """What a result tree holds, by region, run, version and imagery source: from its paths and files, and from the configurations that some runs have."""
    out, p = folder(spark, "results"), view(spark, d, "predictions")
    p.select("region", "model_run", "poly_id", "area").write.partitionBy("region", "model_run").parquet(f"{out}/rows")
    some = p.where("not (model_run = 'run_C' or region = 'ASIA')").groupBy("region", "model_run").agg(F.concat(F.lit("aerial "), F.min(F.year("interval_end"))).alias("source"))
    version = F.when(F.col("model_run") == "run_B", " ").otherwise(F.concat("region", F.lit("-2")))
    some.select("region", "model_run", F.struct(version.alias("version")).alias("model"), F.struct("source").alias("imagery")).write.partitionBy("region", "model_run").json(f"{out}/configs")
    return readers.inventory_snapshot(spark, f"{out}/rows", r"_([A-Z])$", f"{out}/configs")