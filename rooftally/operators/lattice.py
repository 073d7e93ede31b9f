"""Square lattices over coverage: cells by size and origin, the share of each that is covered, what lies in them, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rooftally.operators import overlay, ranks, rings


def cell_of(x: Column, y: Column, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """Numbers (i, j) of the cell that holds the point, its left and lower edge included."""
    return F.floor((x - origin[0]) / size).cast("long"), F.floor((y - origin[1]) / size).cast("long")


def with_square(df: DataFrame, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``df`` with x0, y0, x1, y1 of the cells i, j."""
    x, y = origin[0] + F.col("i") * float(size), origin[1] + F.col("j") * float(size)
    return df.withColumns({"x0": x, "y0": y, "x1": x + size, "y1": y + size})


def covered(shapes: DataFrame, keys: list[str], size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """keys, i, j, share: how much of each cell the rings of ``shapes`` cover, what lies over each other once; cells that none covers aren't there.

    Null, empty and flat rings cover nothing; null keys are a key.
    """
    at = overlay.bounded(shapes.select(*keys, "ring"))
    (i0, j0), (i1, j1) = cell_of(F.col("x0"), F.col("y0"), size, origin), cell_of(F.col("x1"), F.col("y1"), size, origin)
    cells = at.withColumn("i", F.explode(F.sequence(i0, i1))).withColumn("j", F.explode(F.sequence(j0, j1))).drop(*overlay.BOX)
    cells = with_square(cells, size, origin)
    inside = cells.withColumn("ring", overlay.clipped_to_box(F.col("ring"), *[F.col(c) for c in overlay.BOX])).where(F.size("ring") > 2)
    areas = overlay.ring_union_areas(inside.select(*keys, "i", "j", "ring"), [*keys, "i", "j"], {"area": F.lit(True)}, size=size / 4)
    return areas.where("area > 0").select(*keys, "i", "j", (F.col("area") / (size * size)).alias("share"))


def task_grid(coverage: DataFrame, keys: list[str], size: float, origin: tuple[float, float] = (0.0, 0.0), least: float = 0.25) -> DataFrame:
    """Cells of which ``coverage`` covers ``least`` at least: keys, i, j, x0, y0, x1, y1, share, and ``no`` within the keys, from north to south, then west to east.

    Shares are compared in billionths, so that a cell covered to exactly the limit stays whatever the rounding of its area.
    """
    cells = covered(coverage, keys, size, origin).where(F.round("share", 9) >= least)
    numbered = ranks.places(cells, keys, [F.col("j").desc(), F.col("i")], "no")
    return with_square(numbered, size, origin).select(*keys, "i", "j", *overlay.BOX, "share", "no")


def planned(cells: DataFrame, imagery: DataFrame, buildings: DataFrame, keys: list[str], size: float, origin: tuple[float, float] = (0.0, 0.0), full: float = 0.8, partial: float = 0.3) -> DataFrame:
    """``cells`` (of `task_grid`) with imagery (the share that its rings cover), n_buildings (points in the cell) and plan.

    ``skip`` without a building; ``full`` and ``partial`` from these shares of imagery on; else ``aerial_needed``.
    """
    i, j = cell_of(F.col("x"), F.col("y"), size, origin)
    built = buildings.select(*keys, i.alias("i"), j.alias("j")).groupBy(*keys, "i", "j").agg(F.count("*").alias("n_buildings"))
    shown = covered(imagery, keys, size, origin).withColumnRenamed("share", "imagery")
    rows = cells.join(built, [*keys, "i", "j"], "left").join(shown, [*keys, "i", "j"], "left").na.fill(0, ["n_buildings", "imagery"])
    share = F.round("imagery", 9)
    plan = F.when(F.col("n_buildings") == 0, "skip").when(share >= full, "full").when(share >= partial, "partial").otherwise("aerial_needed")
    return rows.withColumn("plan", plan)


def strata(cells: DataFrame, keys: list[str], density: str, industrial: str, weight: str, dense: float = 0.75, works: float = 0.3) -> DataFrame:
    """``cells`` with core_dist2 (squared steps to the keys' core), score and stratum.

    The core is the cell of most ``weight``, the one of smallest (i, j) among equals. ``industrial`` from the share ``works`` on; ``dense`` from the keys' quantile ``dense`` of
    the density on; else ``residential``. The score is the density over that quantile, null where that is 0.
    """
    first = F.min(F.struct(-F.col(weight), F.col("i"), F.col("j")))
    by = cells.groupBy(*keys).agg(F.percentile(density, F.lit(dense)).alias("_cut"), first.alias("_core"))
    rows = cells.join(by, keys)
    di, dj = F.col("i") - F.col("_core.i"), F.col("j") - F.col("_core.j")
    stratum = F.when(F.col(industrial) >= works, "industrial").when(F.col(density) >= F.col("_cut"), "dense").otherwise("residential")
    return rows.withColumns({"core_dist2": di * di + dj * dj, "score": F.col(density) / F.nullif(F.col("_cut"), F.lit(0.0)), "stratum": stratum}).drop("_cut", "_core")


def boxes_as_rings(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", rings.box_ring())
