"""Spatial joins by grid cells: an equi-join on cells and the exact test after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell with more points than this, and than this part of all, is dealt to blocks.
CROWD, PART = 50_000, 10_000

#: Places of points that a task of the join gets; it may make many pairs of each.
DEALT = 4_000

_BOUNDS = [f"{p}_{k}" for p in ("min", "max") for k in "xyz"]


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _levelled(boxes: DataFrame, reach: tuple[float, float, float], size: float) -> DataFrame:
    finite = None
    for c in _BOUNDS:
        one = F.abs(F.col(c)) < float("inf")
        finite = one if finite is None else finite & one
    rx, _, rz = reach
    wide = F.greatest(F.col("max_x") - F.col("min_x") + 2 * rx, F.col("max_z") - F.col("min_z") + 2 * rz)
    level = F.when(wide <= size, 0).otherwise(F.ceil(F.log2(wide / size)))
    return boxes.where(finite).withColumn("level", level.cast("int"))


def _cell_size(reach: tuple[float, float, float], size: float | None) -> float:
    return size or max(2 * max(reach[0], reach[2]), 1e-6)


def box_cells(boxes: DataFrame, reach: tuple[float, float, float], size: float | None = None) -> DataFrame:
    """``boxes`` with ``level, cx, cz`` of each ground cell that they touch once
    grown by the reach.

    A box is on the first level whose cells, of twice the size from level to level,
    are as wide as the grown box: it touches 4 cells at most, however large it is.
    Boxes that are not finite touch none.
    """
    size = _cell_size(reach, size)
    placed, cell = _levelled(boxes, reach, size), F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    for k, r in (("x", reach[0]), ("z", reach[2])):
        placed = placed.withColumn(f"c{k}", F.explode(_cells(F.col(f"min_{k}") - r, F.col(f"max_{k}") + r, cell)))
    return placed


def box_join(points: DataFrame, boxes: DataFrame, reach: tuple[float, float, float], size: float | None = None, where: Column | None = None) -> DataFrame:
    """Points ``m*`` and the boxes ``min_*``/``max_*`` within ``reach`` of them that
    ``where``, a condition on both, lets meet.

    A box stands in up to 4 cells of its level (:func:`box_cells`), a point in its
    own cell of each level that boxes are on, so a pair meets exactly once.  Points
    are counted by cells; those of a crowded cell, of which there cannot be more
    than ``PART``, are dealt to blocks, each of which meets the cell's boxes.

    Tasks are as many as the points ask for: adaptive execution would put together
    those that read little, whatever number of pairs they make of it.
    """
    levels = sorted(r["level"] for r in _levelled(boxes, reach, _cell_size(reach, size)).select("level").distinct().collect())
    each = F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")
    cell = F.lit(_cell_size(reach, size)) * F.pow(F.lit(2.0), F.col("level"))
    placed = points.withColumn("level", F.explode(each))
    placed = placed.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cz", F.floor(F.col("mz") / cell))
    key = ["level", "cx", "cz"]
    places = points.count() * len(levels)
    most, tasks = max(CROWD, places // PART), 1 + places // DEALT
    crowded = placed.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = placed.join(F.broadcast(crowded), key, "left").withColumn("block", F.pmod(F.xxhash64("mx", "my", "mz"), blocks).cast("int")).drop("blocks")
    grown = box_cells(boxes, reach, size).join(F.broadcast(crowded), key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    hit = where
    for k, r in zip("xyz", reach, strict=True):
        one = (F.col(f"m{k}") >= F.col(f"min_{k}") - r) & (F.col(f"m{k}") <= F.col(f"max_{k}") + r)
        hit = one if hit is None else hit & one
    meet = [*key, "block"]
    dealt = placed.repartition(tasks, *meet).hint("shuffle_merge")
    return dealt.join(grown.repartition(tasks, *meet), meet).where(hit).drop(*meet)


def near_join(one: DataFrame, two: DataFrame, keys: list[str], a: str, b: str, radius: float) -> DataFrame:
    """Pairs that agree in ``keys`` and whose points ``a*`` and ``b*`` may lie
    within ``radius``; the caller tests the distance."""
    size = max(radius, 1e-6)
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = one.withColumn("gx", F.explode(F.transform(around, lambda d: F.floor(F.col(f"{a}x") / F.lit(size)) + d)))
    spread = spread.withColumn("gz", F.explode(F.transform(around, lambda d: F.floor(F.col(f"{a}z") / F.lit(size)) + d)))
    own = two.withColumn("gx", F.floor(F.col(f"{b}x") / F.lit(size))).withColumn("gz", F.floor(F.col(f"{b}z") / F.lit(size)))
    return spread.join(own, [*keys, "gx", "gz"]).drop("gx", "gz")
