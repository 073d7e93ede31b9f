"""Sharding by longest processing time: groups of equal texts go to the least-loaded shard.

A heap over all groups would sit in one process, so only a bounded number of items meets
it. Groups of at least 1 / ``heavy`` of all bytes are items of their own (``heavy`` of them
at most, by that very rule). All lighter groups are packed by a hash of their key into
``bins`` bundles. Sorted by size, items and bundles go to the least-loaded shard through
a heap: at most ``heavy + bins`` entries on the driver at any corpus size. The plan is
broadcast with that same bound.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window of slots orders, about.
SLOT_ROWS = 500


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """(size, name) items to shards: the largest first, each to the least-loaded; ties by name and shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(df: DataFrame, id_col: str, text_col: str, shards: int = 8, heavy: int = 8000, bins: int = 8192, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, and ``keep``.

    Size is the UTF-8 bytes of the text plus 1; a null text has none and all null texts are
    one group, apart from the empty texts. Slots are gapless from 0 in each shard, and depend on
    the rows alone, not on how they are partitioned. Repeated rows share a group and get slots of
    their own. An empty table gives no rows. Only id, text and ``keep`` are read, so other columns can't clash.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    kept = [f"keep_{c}" for c in keep]
    rows = df.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"keep_{c}") for c in keep],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(text), F.lit("null")).alias("key"),
    ).withColumn("bin", F.concat(F.lit("bin"), F.pmod(F.xxhash64("key"), F.lit(bins)))).persist()
    groups = rows.groupBy("key", "bin").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    n, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    is_heavy = F.col("size") * heavy >= total
    large = [(r[1], r[0]) for r in groups.where(is_heavy).select("key", "size").collect()]  # heavy at most
    light = [(r[1], r[0]) for r in groups.where(~is_heavy).groupBy("bin").agg(F.sum("size")).collect()]  # bins at most
    plan = longest_first(large + light, shards)
    of_group, of_bin = ([(k, plan[k]) for _, k in items] for items in (large, light))
    rows = rows.join(F.broadcast(spark.createDataFrame(of_group, "key string, heavy_shard int")), "key", "left")
    rows = rows.join(F.broadcast(spark.createDataFrame(of_bin, "bin string, bin_shard int")), "bin", "left")
    rows = rows.withColumn("shard", F.coalesce("heavy_shard", "bin_shard"))
    return with_slots(rows, ["id", "key", "size", "text_crc32", *kept], n).select(
        "id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"keep_{c}").alias(c) for c in keep],
    )


def with_slots(rows: DataFrame, names: list[str], n: int) -> DataFrame:
    """``names`` and ``shard`` with a gapless ``slot`` in each shard; ``n`` rows in all.

    Rows are dealt into chunks of a shard by a hash of all of ``names``, so rows that repeat become one row
    with a number of copies and are told apart by their slots alone. Chunks lie in rows of about sqrt(chunks): offsets are
    summed over these, then inside each, so no window holds more than about sqrt(n) rows.
    """
    chunks = max(1, math.ceil(n / SLOT_ROWS))
    side = math.isqrt(chunks - 1) + 1 if chunks > 1 else 1
    chunk = F.pmod(F.xxhash64(*names), F.lit(chunks))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*names, "shard", chunk.alias("chunk")).repartition(parts, "shard", "chunk")
    rows = dealt.groupBy("shard", "chunk", *names).agg(F.count("*").alias("copies"))
    sums = rows.groupBy("shard", "chunk").agg(F.sum("copies").alias("c")).withColumn("line", F.floor(F.col("chunk") / side))
    lines = sums.groupBy("shard", "line").agg(F.sum("c").alias("of_line"))
    lines = lines.withColumn("above", F.sum("of_line").over(Window.partitionBy("shard").orderBy("line")) - F.col("of_line")).drop("of_line")
    inside = F.sum("c").over(Window.partitionBy("shard", "line").orderBy("chunk")) - F.col("c")
    sums = sums.withColumn("inside", inside).join(lines, ["shard", "line"]).select("shard", "chunk", (F.col("above") + F.col("inside")).alias("first"))
    before = F.sum("copies").over(Window.partitionBy("shard", "chunk").orderBy(*names)) - F.col("copies")
    rows = rows.withColumn("before", before).join(sums, ["shard", "chunk"]).withColumn("first", F.col("first") + F.col("before"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(SLOT_ROWS).cast("long")))
    rows = rows.withColumn("block", block).withColumn("last", F.least(F.col("block") + SLOT_ROWS, F.col("copies")) - 1)
    return rows.select(*names, "shard", F.explode(F.sequence(F.col("first") + F.col("block"), F.col("first") + F.col("last"))).alias("slot"))
