"""Where streams write: folders by batch, so that a batch that is tried again replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rooftally.functions.session import remove


class Log:
    """Rows in a folder for each batch under ``path``; ``put`` twice with one number keeps the second alone.

    A folder that is new has no rows. ``rows`` has the number in ``batch``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def written_as(self, name: str) -> StructType:
        return StructType([*self.schema.fields, StructField(name, LongType())])

    def put(self, df: DataFrame, batch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.written_as("batch")).parquet(self.path)

    def before(self, batch: int) -> DataFrame:
        return self.rows().where(F.col("batch") < batch)


class Upserts:
    """The last row put for each key. A batch writes the keys that it changes, a row each; `compact` folds all batches so far into one table.

    As with `Log`, a batch may be put again; after `compact` only later ones.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType):
        self.keys, self.names = keys, schema.names
        self.changes = Log(spark, f"{path}/changes", schema)
        self.base = Log(spark, f"{path}/base", self.changes.written_as("changed"))

    def put(self, df: DataFrame, batch: int) -> None:
        self.changes.put(df, batch)

    def _last(self) -> tuple[int, DataFrame]:
        """The batch up to which the base goes; the base's rows and those changed after it, by key."""
        upto = self.base.rows().agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        changes = self.changes.rows().where(F.col("batch") > upto).withColumnRenamed("batch", "changed")
        every = self.base.rows().where(F.col("batch") == upto).drop("batch").unionByName(changes)
        rest = [c for c in self.names if c not in self.keys]
        best = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "changed"), "changed").alias("_r"))
        return upto, best.select(*self.keys, "_r.*").select(*self.names, "changed")

    def rows(self) -> DataFrame:
        return self._last()[1].drop("changed")

    def compact(self) -> None:
        """Between batches alone: writes what `rows` has as the new base, then removes the changes that are in it and the base before."""
        before, rows = self._last()
        batches = [r.batch for r in self.changes.rows().where(F.col("batch") > before).select("batch").distinct().collect()]  # numbers alone
        if batches:
            self.base.put(rows, max(batches))
            for b in batches:
                remove(self.changes.spark, f"{self.changes.path}/batch={b}")
            if before >= 0:
                remove(self.base.spark, f"{self.base.path}/batch={before}")


def drained(rows: DataFrame, put: Callable[[DataFrame, int], None], mode: str, path: str, late: Log | None = None) -> None:
    """Runs ``rows`` into ``put`` until the source has nothing more; goes on where the last run under ``path`` stopped.

    Rows that come after the watermark has passed them are dropped by Spark, which tells how many: ``late`` gets the number of each batch.
    """
    query = rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    told = -1
    while True:
        over = query.awaitTermination(20)
        told = _tell_late(query, late, told) if late else told
        if over:
            return


LATE = StructType([StructField("n", LongType())])


def _tell_late(query: StreamingQuery, late: Log, told: int) -> int:
    for p in query.recentProgress:
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        if p.batchId > told:
            if dropped:
                late.put(late.spark.createDataFrame([(dropped,)], LATE), p.batchId)
            told = p.batchId
    return told
