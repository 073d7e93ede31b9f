"""Append-as-you-go logs as streams: latest decisions, ingestion into a pool, running status and sessions.

Each job reads what a folder has that it hasn't read, keeps its state and progress beside its output in the shared folder, and
can be started again where it stopped. State is bounded by a watermark: what is older is dropped and counted, or closed and written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from rooftally.functions.session import shared_dir
from rooftally.operators.decisions import unseen
from rooftally.streaming.sinks import LATE, Log, Upserts, drained

#: The state store that timers and typed state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The growing folder at ``path``; if it is one file, its folder with other names left out. ``ts`` is an instant."""
    rows = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(rows.schema)
    one_file = rows.inputFiles()[:1] and rows.inputFiles()[0].endswith(f"/{name}")
    stream = stream.option("pathGlobFilter", name).parquet(folder) if one_file else stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _state_in(spark: SparkSession, provider: str):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Latest(StatefulProcessor):
    """Tells a key's row whenever it comes after the one before, and each row that the gate rejects. The columns ``_o0``, … are compared in turn.

    State is one row of these for a key; a timer forgets it once the watermark is ``ttl`` milliseconds beyond it.
    """

    def __init__(self, order: StructType, ttl: int):
        self.order, self.ttl = order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([*self.order.fields, StructField("_ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, before = None, self.last.get()[:-1] if self.last.exists() else None
        for row in rows:
            if row["reasons"]:
                yield Row(**row.asDict() | {"kind": "rejected"})
                continue
            at = tuple(row[c] for c in self.order.names)
            if before is None or at > before:
                best, before = row, at
        if best is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.last.update((*before, best["_ms"]))
            self.handle.registerTimer(max(best["_ms"] + self.ttl, timerValues.getCurrentWatermarkInMs() + 1))
            yield Row(**best.asDict() | {"kind": "latest"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            self.last.clear()
        return iter([])


class Decisions:
    """The latest decision of each key as a log grows, in ``folder`` (given again, it goes on there).

    ``reasons``: array of the rules that a row breaks; a row that breaks any is rejected and never becomes the latest. Rows that are ``delay`` behind
    the newest instant in ``ts`` are late: dropped, their number told by batch. Among others the order in which rows come doesn't matter:
    ``order`` (no nulls) decides. A key's state goes ``ttl`` milliseconds after its latest row; ``ttl`` must not be less than the delay.
    """

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], reasons: Column, folder: str, delay: str = "1 day", ttl: int = 7 * 86_400_000):
        spark, names = rows.sparkSession, rows.columns
        self.folder = folder
        # instants are compared as numbers: what state gives back has another time zone than what comes in
        places = {f"_o{i}": F.unix_micros(c) if isinstance(rows.schema[c].dataType, TimestampType) else F.col(c) for i, c in enumerate(order)}
        ready = rows.withColumns({"reasons": F.array_join(reasons, ","), "_ms": F.unix_millis("ts"), "kind": F.lit(""), **places}).withWatermark("ts", delay)
        told = ready.groupBy(*keys).transformWithState(Latest(ready.select(*places).schema, ttl), ready.schema, "update", "eventTime")
        self.out, self.names = told, names
        self.latest = Upserts(spark, f"{folder}/latest", keys, rows.schema)
        self.rejected = Log(spark, f"{folder}/rejected", StructType([*rows.schema.fields, StructField("reasons", StringType())]))
        self.late = Log(spark, f"{folder}/late", LATE)

    def put(self, df: DataFrame, batch: int) -> None:
        """A batch is kept while its two outputs are written: its state can't be walked through twice."""
        df = df.persist()
        self.latest.put(df.where("kind = 'latest'"), batch)
        self.rejected.put(df.where("kind = 'rejected'"), batch)
        df.unpersist()

    def drain(self) -> Decisions:
        with _state_in(self.out.sparkSession, STORE):
            drained(self.out, self.put, "update", self.folder, self.late)
        return self


class Ingest:
    """Candidates that come in, each told once by ``keys`` with its outcome, in ``folder`` (given again, it goes on there).

    ``agreement`` (keys, outcome) and ``pool`` (keys) are tables, joined with the stream: a candidate of the pool is ``in_pool``, one that no reviewer saw
    ``unreviewed``, others have their outcome. Repeats within ``delay`` are dropped by state, later ones as they are in an earlier batch's output. A batch
    replaces what it wrote before, and looks at earlier ones alone, so running it again adds nothing and changes nothing.
    """

    def __init__(self, rows: DataFrame, keys: list[str], agreement: DataFrame, pool: DataFrame, folder: str, delay: str = "1 hour"):
        self.folder, self.keys = folder, keys
        pooled = pool.select(*keys).distinct().withColumn("_pooled", F.lit(True))
        once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
        joined = once.join(agreement, keys, "left").join(pooled, keys, "left")
        outcome = F.when(F.col("_pooled"), "in_pool").otherwise(F.coalesce("outcome", F.lit("unreviewed")))
        self.out = joined.select(*rows.columns, outcome.alias("outcome"))
        self.log = Log(rows.sparkSession, f"{folder}/ingested", StructType([*rows.schema.fields, StructField("outcome", StringType())]))
        self.late = Log(rows.sparkSession, f"{folder}/late", LATE)

    def put(self, df: DataFrame, batch: int) -> None:
        self.log.put(unseen(df.dropDuplicates(self.keys), self.log.before(batch), self.keys), batch)

    def drain(self) -> Ingest:
        drained(self.out, self.put, "append", self.folder, self.late)
        return self


class Throughput:
    """Counts by tumbling window and key, changed windows alone written, in ``folder``. A window is closed once ``delay`` has passed it."""

    def __init__(self, rows: DataFrame, keys: list[str], counts: list[Column], folder: str, width: str = "1 hour", delay: str = "1 hour"):
        self.folder = folder
        self.out = rows.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(*counts).select(F.col("window.start").alias("start"), "*").drop("window")
        self.status = Upserts(rows.sparkSession, f"{folder}/status", ["start", *keys], self.out.schema)
        self.late = Log(rows.sparkSession, f"{folder}/late", LATE)

    def drain(self) -> Throughput:
        drained(self.out, self.status.put, "update", self.folder, self.late)
        return self


class Sessions:
    """Runs of a key's rows with ``gap`` at most between neighbours, written once when they are over, in ``folder``.

    Session windows have no update mode: a session whose end, the last row plus the gap, the watermark hasn't passed is still state, and isn't in the output.
    """

    def __init__(self, rows: DataFrame, keys: list[str], counts: list[Column], folder: str, gap: str = "6 hours", delay: str = "1 hour"):
        self.folder = folder
        out = rows.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(*counts)
        self.out = out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "*").drop("session_window")
        self.closed = Log(rows.sparkSession, f"{folder}/sessions", self.out.schema)
        self.late = Log(rows.sparkSession, f"{folder}/late", LATE)

    def drain(self) -> Sessions:
        drained(self.out, self.closed.put, "append", self.folder, self.late)
        return self
