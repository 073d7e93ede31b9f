"""Chip windows along a raster, and tiles around what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where windows begin: at each step, without those of under half a window (training); at each step that leaves a whole one, and one at the end
#: (anchored); at each step but the last, whole or not, and one at the end (parity).
MODES = ("training", "anchored", "parity")


def origins(width: Column, size: int, overlap: float, mode: str) -> Column:
    """Array of the origins along one side; a raster smaller than a window has one at 0, in mode ``training`` only if it has half of it. Empty rasters have none."""
    if mode not in MODES or not 0 <= overlap < 1 or size <= 0 or int(size * (1 - overlap)) < 1:
        raise ValueError(f"mode {mode}, size {size}, overlap {overlap}")
    step, width = int(size * (1 - overlap)), width.cast("long")
    none, last = F.array().cast("array<bigint>"), F.array(width - size)
    steps = lambda end: F.when(end >= 0, F.sequence(F.lit(0).cast("long"), end, F.lit(step).cast("long"))).otherwise(none)
    if mode == "training":
        out = F.filter(steps(width - 1), lambda x: F.least(F.lit(size).cast("long"), width - x) >= size // 2)
    elif mode == "anchored":
        whole = steps(width - size)
        out = F.when(width <= size, F.array(F.lit(0).cast("long"))).otherwise(F.when((width - size) % step == 0, whole).otherwise(F.concat(whole, last)))
    else:
        before = steps((F.floor((width - 1) / step) - 1) * step)
        out = F.when(width > size, F.concat(before, last)).when(F.size(before) > 0, before).otherwise(F.array(F.lit(0).cast("long")))
    return F.when(width > 0, out).otherwise(none)


def chip_windows(rasters: DataFrame, size: int, overlap: float, mode: str, width: str = "width", height: str = "height") -> DataFrame:
    """``rasters`` with a row for each window: x, y, w, h, cut at the raster's border; from the top row by row. Null sides have no windows."""
    rows = rasters.withColumn("y", F.explode(origins(F.col(height), size, overlap, mode))).withColumn("x", F.explode(origins(F.col(width), size, overlap, mode)))
    return rows.withColumns({"w": F.least(F.lit(size), F.col(width) - F.col("x")).cast("long"), "h": F.least(F.lit(size), F.col(height) - F.col("y")).cast("long")})


def tile_mask(tiles: DataFrame, keys: list[str], rings: int, columns: int, rows: int) -> DataFrame:
    """keys, i, j, ring, reason: the tiles given (ring 0, ``building``) and those of the grid's columns and rows within so many steps across their sides (``buffer_1``, …), each with its least ring."""
    steps = [(abs(a) + abs(b), a, b) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1) if abs(a) + abs(b) <= rings]
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(a).alias("a"), F.lit(b).alias("b")) for r, a, b in steps]))
    around = tiles.select(*keys, "i", "j").distinct().withColumn("n", near)
    around = around.select(*keys, (F.col("i") + F.col("n.a")).alias("i"), (F.col("j") + F.col("n.b")).alias("j"), "n.r").where(F.col("i").between(0, columns - 1) & F.col("j").between(0, rows - 1))
    ring = F.min("r").alias("ring")
    return around.groupBy(*keys, "i", "j").agg(ring).withColumn("reason", F.when(F.col("ring") == 0, "building").otherwise(F.concat(F.lit("buffer_"), F.col("ring"))))
