"""Readers and writers of tables of footprints in Parquet, CSV, JSON lines, XML and nested artifacts.

All go through Spark's readers, so any store that Spark reaches will do. Listings are DataFrames too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rooftally.operators import rings


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under ``root`` whose name fits; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def path_value(path: Column, name: str) -> Column:
    """The value of ``name=value`` in a path; null if there is none."""
    return F.nullif(F.url_decode(F.regexp_extract(path, rf"/{name}=([^/]*)", 1)), F.lit(""))


def read_polygons(spark: SparkSession, path: str, layer: str | None = None, wkt: str = "wkt") -> DataFrame:
    """One layer of a table of several (``layer``, ``layer_no``, WKT texts): the named one, else the first. Adds ``ring``.

    An empty table or a name that isn't there gives no rows. What isn't a polygon has a null ring.
    """
    rows = spark.read.parquet(path)
    if layer is None:
        first = rows.agg(F.min(F.struct("layer_no", "layer")).alias("m")).select("m.layer")
        rows = rows.join(F.broadcast(first), "layer", "left_semi")
    else:
        rows = rows.where(F.col("layer") == layer)
    return rows.withColumn("ring", rings.from_wkt(F.col(wkt)))


def discover(spark: SparkSession, root: str, keys: list[str], rank: Column, tie: list[Column]) -> DataFrame:
    """Rows of the Parquet tree under ``root`` that lie in the best file of their keys, with ``path``.

    Files are ranked by ``rank`` and ``tie`` (ascending) on ``path``; all parts of a folder are one file.
    """
    rows = spark.read.option("basePath", root).parquet(root).select("*", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("path"))
    best = rows.select(*keys, "path").distinct().withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, *tie))).where("_k = 1").drop("_k")
    return rows.join(best, [*keys, "path"], "left_semi")


def discover_annotations(spark: SparkSession, root: str, keys: list[str], registered: DataFrame, excluded: DataFrame) -> DataFrame:
    """Of each key (region and grid, say), the rows of its registered scheme, else those of the first scheme found in the folder tree.

    registered: (region, scheme). Keys in ``excluded`` are left out. Adds ``is_registered``.
    """
    rows = spark.read.option("basePath", root).parquet(root).join(excluded, excluded.columns, "left_anti")
    known = registered.withColumn("_known", F.lit(True))
    rows = rows.join(F.broadcast(known) if known.count() <= 100_000 else known, registered.columns, "left").withColumn("is_registered", F.coalesce("_known", F.lit(False))).drop("_known")
    best = rows.groupBy(*keys).agg(F.min(F.struct((~F.col("is_registered")).alias("later"), "scheme")).alias("m")).select(*keys, "m.scheme")
    return rows.join(best, [*keys, "scheme"], "left_semi")


def read_manifest_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, read as texts and then coerced: what doesn't fit its type is null, and its column is named in ``bad``."""
    types = StructType.fromDDL(schema)
    raw = spark.read.option("header", "true").schema(", ".join(f"`{f.name}` string" for f in types)).csv(path)
    fits = [F.col(f.name).try_cast(f.dataType) for f in types]
    bad = F.array_compact(F.array(*[F.when((F.trim(f.name) != "") & c.isNull(), F.lit(f.name)) for f, c in zip(types, fits)]))
    return raw.select(*[c.alias(f.name) for f, c in zip(types, fits)], F.array_join(bad, ",").alias("bad"))


def read_decisions_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a broken line is an error that names file and line. Else it is a row of nulls with the line in ``broken``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows


def read_kml_placemarks(spark: SparkSession, path: str, name_pattern: str) -> DataFrame:
    """(name, grid, ring): a row a placemark; the grid by the first group of a pattern on its name, null if it doesn't fit; the outer ring, null if empty."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    text = F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")
    return marks.select("name", F.nullif(F.regexp_extract("name", name_pattern, 1), F.lit("")).alias("grid"), rings.from_coordinates(text, r"\s+", ",").alias("ring"))


#: Version of the nested artifact that is read.
ARTIFACT_VERSION = 1


def as_artifact(detections: DataFrame, keys: list[str], chip: list[str], values: list[str]) -> DataFrame:
    """A row per key with ``chips``, each with its detections: what a detector writes for one grid, so a row is as large as a grid's detections."""
    chips = detections.groupBy(*keys, *chip).agg(F.array_sort(F.collect_list(F.struct(*values))).alias("detections"))
    return chips.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*chip, "detections"))).alias("chips")).withColumn("schema_version", F.lit(ARTIFACT_VERSION))


def read_raw_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A row per detection of nested artifacts, with its key and chip columns. Another version is an error; grids or chips without detections give no rows."""
    rows = spark.read.parquet(path)
    version = F.assert_true(F.col("schema_version") == ARTIFACT_VERSION, F.concat(F.lit("artifact version "), F.col("schema_version").cast("string")))
    keys = [c for c in rows.columns if c not in ("chips", "schema_version")]
    chips = rows.where(version.isNull()).select(*keys, F.explode("chips").alias("c"))
    fields = [f for f in chips.schema["c"].dataType.names if f != "detections"]
    found = chips.select(*keys, *[F.col(f"c.{f}").alias(f) for f in fields], F.explode("c.detections").alias("d"))
    return found.select(*keys, *fields, "d.*")


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """(grid_id, name, width, height, and bounds) of tiles that are stored with an affine transform (a, b, c, d, e, f), as raster files have it."""
    t = spark.read.parquet(path)
    at = lambda x, y: (F.col("t.a") * x + F.col("t.b") * y + F.col("t.c"), F.col("t.d") * x + F.col("t.e") * y + F.col("t.f"))
    (ax, ay), (bx, by) = at(F.lit(0), F.lit(0)), at(F.col("width"), F.col("height"))
    return t.select("grid_id", "name", "width", "height", F.least(ax, bx).alias("x0"), F.least(ay, by).alias("y0"), F.greatest(ax, bx).alias("x1"), F.greatest(ay, by).alias("y1"), "t")


def write_inventory(df: DataFrame, root: str, contract: list[str], parts: list[str], lon_lat: tuple[Column, Column], config: dict[str, str]) -> None:
    """The metric table by ``parts``, an exchange copy with ``lon`` and ``lat``, a CSV of the contract's columns in its order, and the configuration as JSON."""
    rows = df.select(*contract, *[c for c in parts if c not in contract])
    rows.write.partitionBy(*parts).parquet(f"{root}/metric")
    df.select(*contract, lon_lat[0].alias("lon"), lon_lat[1].alias("lat")).write.parquet(f"{root}/exchange")
    df.select(*contract).write.option("header", "true").csv(f"{root}/table")
    df.sparkSession.createDataFrame([tuple(config.values())], ", ".join(f"{k} string" for k in config)).write.json(f"{root}/config")


def inventory_snapshot(spark: SparkSession, root: str, version_pattern: str, configs: str | None = None) -> DataFrame:
    """(region, run, version, imagery, n_rows) of a result tree ``region=…/model_run=…``: names by the paths, rows by file.

    ``configs`` is a tree of the same names with a JSON file each, from which version and imagery source come; where it has none, or they
    are empty, the version is what a pattern finds in the run's name, and the imagery null. A file that isn't JSON counts as none.
    """
    files = spark.read.parquet(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    run = path_value(F.col("path"), "model_run")
    rows = files.groupBy(path_value(F.col("path"), "region").alias("region"), run.alias("run")).agg(F.sum("n").alias("n_rows"))
    named = F.nullif(F.regexp_extract("run", version_pattern, 1), F.lit(""))
    if configs is None:
        return rows.select("region", "run", named.alias("version"), F.lit(None).cast("string").alias("imagery"), "n_rows")
    told = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(configs)
    value = lambda path: F.nullif(F.trim(F.get_json_object("value", path)), F.lit(""))
    at = F.col("_metadata.file_path")
    told = told.groupBy(path_value(at, "region").alias("region"), path_value(at, "model_run").alias("run")).agg(F.max(value("$.model.version")).alias("_version"), F.max(value("$.imagery.source")).alias("imagery"))
    return rows.join(told, ["region", "run"], "left").select("region", "run", F.coalesce("_version", named).alias("version"), "imagery", "n_rows")


def merge_census(layers: DataFrame, grids: DataFrame, runs: list[str], keep: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, status). rows: those of ``layers`` that ``keep`` holds for, with ``gridcell_id`` and ``layer``. status: per grid and run, with_detections, empty or missing."""
    tagged = layers.where(keep).withColumns({"gridcell_id": F.col("grid_id"), "layer": F.concat_ws("/", "region", "model_run")})
    counts = layers.groupBy("grid_id", "model_run").agg(F.count_if(keep).alias("n"))
    every = grids.withColumn("model_run", F.explode(F.array(*map(F.lit, runs))))
    status = F.when(F.col("n") > 0, "with_detections").when(F.col("n") == 0, "empty").otherwise("missing")
    return tagged, every.join(counts, ["grid_id", "model_run"], "left").withColumns({"status": status, "n": F.coalesce("n", F.lit(0))})
