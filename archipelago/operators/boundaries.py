"""Border segments of islands: extraction, thinning, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.functions.scalars import direction_bucket, finite, quantize, squared
from archipelago.operators.ranking import running
from archipelago.plans.config import BuildConfig
from archipelago.sources.mesh import Mesh

COLUMNS = ["island", "poly_ref", "edge_no", "ord", *[f"{p}{k}" for p in "sem" for k in "xyz"]]


def extract_boundaries(mesh: Mesh, labels: DataFrame, islands: DataFrame) -> DataFrame:
    """A row for each border edge of islands that are not suppressed, with its
    start, end and midpoint in ``s*``, ``e*`` and ``m*``."""
    alive = labels.join(islands.where("NOT suppressed").select(F.col("id").alias("island")), "island")
    border = mesh.poly_edges.where("neighbor_ref IS NULL").select("poly_ref", "edge_no")
    rows = border.join(alive, "poly_ref").join(mesh.polygons.select("poly_ref", "verts"), "poly_ref")
    ends = {"s": F.get("verts", F.col("edge_no")), "e": F.get("verts", (F.col("edge_no") + 1) % F.size("verts"))}
    rows = rows.select("island", "poly_ref", "edge_no", "ord", *[v[k].cast("double").alias(f"{p}{k}") for p, v in ends.items() for k in "xyz"])
    return rows.select("*", *[((F.col(f"s{k}") + F.col(f"e{k}")) / 2).alias(f"m{k}") for k in "xyz"])


def has_non_finite(boundaries: DataFrame) -> bool:
    bad = F.lit(False)
    for name in COLUMNS[4:]:
        bad = bad | ~finite(name)
    return bool(boundaries.where(bad).head(1))


def _direction(k: str) -> Column:
    return F.col(f"e{k}") - F.col(f"s{k}")


def dedup_boundaries(boundaries: DataFrame, config: BuildConfig) -> DataFrame:
    """The first segment, in scan order, of each voxel of island, midpoint and
    signed direction."""
    if not config.boundaries.dedup.enabled:
        return boundaries
    cell = config.boundaries.dedup.cell(config.gap.horizontal)
    key = {"qx": quantize("mx", cell), "qy": quantize("my", config.vertical_window), "qz": quantize("mz", cell), "qdx": quantize(_direction("x"), cell), "qdz": quantize(_direction("z"), cell)}
    best = boundaries.withColumns(key).groupBy("island", *key).agg(F.min_by(F.struct(*COLUMNS), F.struct("ord", "edge_no")).alias("b"))
    return best.select("b.*")


def outbound_boundaries(boundaries: DataFrame, islands: DataFrame) -> DataFrame:
    return boundaries.join(islands.where("outbound").select(F.col("id").alias("island")), "island", "left_semi")


def _budget(config: BuildConfig) -> Column:
    b = config.boundaries
    if not config.mass.enabled:
        return F.lit(b.most)
    weighted = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mass_score"))), F.lit(b.mass_power))
    if b.budget_scale > 0:
        whole = F.lit(float(b.least)) + F.lit(b.budget_scale) * F.sqrt(F.col("n")) * weighted
    elif b.least < b.most:
        whole = F.lit(float(b.least)) + F.lit(float(b.most - b.least)) * weighted
    else:
        whole = F.lit(float(b.most))
    whole = F.floor(whole)
    return F.least(whole, F.lit(b.most)) if b.most else whole


def select_representatives(boundaries: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """The best segment of each coarse voxel and direction sector, and of those
    an even spread along each island's border within its budget.

    The rank is the squared length, or the caller's where that is finite; the
    earlier of equals wins.  ``boundaries`` are outbound ones.
    """
    b = config.boundaries
    if not b.representatives.enabled:
        return boundaries
    cell = b.representatives.cell(config.gap.horizontal)
    rank = squared("e", "s")
    if b.ranker:
        own = b.ranker()
        rank = F.when(finite(own), own).otherwise(rank)
    key = {"qx": quantize("mx", cell), "qy": quantize("my", config.vertical_window), "qz": quantize("mz", cell), "sector": direction_bucket(_direction("x"), _direction("z"), b.direction_buckets)}
    order = F.struct((-F.col("rank")).alias("r"), "poly_ref", "mx", "my", "mz", "edge_no")
    best = boundaries.withColumn("rank", rank).withColumns(key).groupBy("island", *key).agg(F.min_by(F.struct(*COLUMNS, "rank"), order).alias("b")).select("b.*")
    if not b.budgeted:
        return best.drop("rank")
    n = best.groupBy("island").agg(F.count("*").alias("n")).join(islands.select(F.col("id").alias("island"), "mass_score"), "island")
    dealt = best.join(n.select("island", "n", _budget(config).cast("long").alias("budget")), "island").where("budget > 0")
    # places within an island by range partitions, so that a giant one is no task's own
    dealt = running(dealt, ["island"], [F.col(c) for c in ("mx", "mz", "my", "poly_ref", "edge_no")], place="place")
    part = F.when(F.col("budget") >= F.col("n"), F.col("place") - 1).otherwise(F.expr("(place * budget - 1) div n"))
    return dealt.withColumn("part", part).groupBy("island", "part").agg(F.min_by(F.struct(*COLUMNS), order).alias("b")).select("b.*")
