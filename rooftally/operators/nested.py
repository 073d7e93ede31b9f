"""Nested values as rows: JSON texts of any depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rooftally.functions.session import cut


def flattened(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, value): a row for each leaf of the JSON in ``text``, with its dotted path; places in arrays count from 0.

    Values are texts: strings as they are, true and false, numbers as Spark writes them; a JSON null has value null. An empty object or array is a leaf, with value
    ``{}`` or ``[]``. A text that is one value alone has path ''. Null and malformed texts have no rows. All objects and arrays of a level are opened at once, and
    levels go on until none is left, so the deepest text decides how many there are; each is cut, as the next would parse all again.
    """
    rows = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(text).alias("v")).where("v is not null")
    leaves = []
    while True:
        kind = F.substring(F.schema_of_variant("v"), 1, 3)
        level = rows.withColumn("kind", kind)
        done = level.where("kind not in ('OBJ', 'ARR')").select(*keys, "path", F.try_variant_get("v", "$", "string").alias("value"))
        # of what is open, an empty one has no rows when it is opened, and so is a leaf
        whole = level.where("kind in ('OBJ', 'ARR')").withColumn("text", F.to_json("v"))
        empty = whole.where("text in ('{}', '[]')").select(*keys, "path", F.col("text").alias("value"))
        leaves += [done, empty]
        inner = whole.where("text not in ('{}', '[]')").select(*keys, "path", "v")
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).select("pos", "key", F.col("value").alias("_v")))
        step = F.coalesce("key", F.col("pos").cast("string"))
        rows = cut(opened.select(*keys, F.when(F.col("path") == "", step).otherwise(F.concat_ws(".", "path", step)).alias("path"), F.to_json("_v").alias("t")))
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        rows = rows.select(*keys, "path", F.parse_json("t").alias("v"))
