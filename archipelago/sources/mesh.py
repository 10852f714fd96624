"""Polygon meshes: schema, loading, and the terrace grid made from ``part``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLYGONS = "poly_ref bigint, ord bigint, flags int, is_ground boolean, verts array<struct<x:float,y:float,z:float>>"
POLY_EDGES = "poly_ref bigint, edge_no int, neighbor_ref bigint"

#: The terrace grid: cells in a row, cells of a terrace, height of a step.
ROW, BLOCK, STEP = 40, 10, 4


@dataclass(frozen=True)
class Mesh:
    """``polygons`` in scan order ``ord`` and a row for each of their edges;
    ``neighbor_ref`` is null at the mesh's border."""

    polygons: DataFrame
    poly_edges: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Mesh:
        return cls(spark.read.parquet(f"{path}/polygons"), spark.read.parquet(f"{path}/poly_edges"))

    def resolve(self, refs: DataFrame) -> DataFrame:
        """The polygons that ``refs(poly_ref)`` name; unknown ones are skipped."""
        return self.polygons.join(refs, "poly_ref")


def terrace_grid(part: DataFrame) -> Mesh:
    """Squares of side 2 on terraces: a deterministic mesh from ``part``."""
    key = F.col("p_partkey")
    cells = part.where("p_size % 5 < 3").select(
        (key + 1).alias("poly_ref"),
        key.alias("ord"),
        F.expr("shiftleft(1, p_size % 3)").alias("flags"),
        F.expr(f"p_partkey div {ROW}").alias("r"),
        F.expr(f"p_partkey % {ROW}").alias("c"),
    )
    cells = cells.withColumn("y", F.expr(f"{STEP} * ((r div {BLOCK} + c div {BLOCK}) % 3)"))
    corner = lambda dc, dr: F.struct(
        (2 * F.col("c") + dc).cast("float").alias("x"), F.col("y").cast("float").alias("y"), (2 * F.col("r") + dr).cast("float").alias("z")
    )
    polygons = cells.select(
        "poly_ref", "ord", "flags", F.lit(True).alias("is_ground"), F.array(corner(0, 0), corner(2, 0), corner(2, 2), corner(0, 2)).alias("verts")
    )
    sides = F.array(*[F.struct(F.lit(n).alias("edge_no"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for n, (dr, dc) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1)))])
    each = cells.select("poly_ref", "r", "c", "y", F.explode(sides).alias("s")).select(
        "poly_ref", "s.edge_no", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"), "y"
    )
    other = cells.select(F.col("poly_ref").alias("neighbor_ref"), F.col("r").alias("nr"), F.col("c").alias("nc"), "y")
    # as many rows as polygons, of a file that is small for them: not to be broadcast
    return Mesh(polygons, each.join(other.hint("shuffle_merge"), ["nr", "nc", "y"], "left").select("poly_ref", "edge_no", "neighbor_ref"))
