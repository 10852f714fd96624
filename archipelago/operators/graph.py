"""The island graph: edges, directed traversals, lookups and health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.operators.components import connected_components
from archipelago.operators.strong import strongly_connected
from archipelago.storage import store

EDGE = ["edge_index", "island_a", "island_b", *[f"{p}{k}" for p in "ab" for k in "xyz"], "horizontal", "vertical_delta_ab", "trav_ab", "trav_ba"]


@dataclass(frozen=True)
class Graph:
    """``islands``, ``edges`` and ``polygon_island(poly_ref, island)``."""

    islands: DataFrame
    edges: DataFrame
    polygon_island: DataFrame

    def island(self, ids: DataFrame) -> DataFrame:
        """The islands that ``ids(id)`` name; unknown ids give nothing."""
        return self.islands.join(ids, "id")

    def island_of(self, refs: DataFrame) -> DataFrame:
        """``poly_ref, island`` of known polygons; the first owner counts."""
        owners = self.polygon_island.groupBy("poly_ref").agg(F.min("island").alias("island"))
        return refs.join(owners, "poly_ref")

    def adjacency(self) -> DataFrame:
        """``id, edge_indices``: each island's edges, in order; a loop once."""
        ends = self.edges.select("edge_index", F.explode(F.array_distinct(F.array("island_a", "island_b"))).alias("id"))
        return ends.groupBy("id").agg(F.sort_array(F.collect_list("edge_index")).alias("edge_indices"))


def connects_island(island: Column) -> Column:
    return (F.col("island_a") == island) | (F.col("island_b") == island)


def can_traverse_from(island: Column) -> Column:
    return ((F.col("island_a") == island) & F.col("trav_ab")) | ((F.col("island_b") == island) & F.col("trav_ba"))


def other_island(island: Column) -> Column:
    """The edge's other end, or null if ``island`` is none of its ends."""
    return F.when(F.col("island_a") == island, F.col("island_b")).when(F.col("island_b") == island, F.col("island_a"))


def traversals(edges: DataFrame) -> DataFrame:
    """A directed link for each open direction of each edge."""

    def way(a: str, b: str, sign: int) -> DataFrame:
        return edges.where(f"trav_{a}{b}").select(
            "edge_index", F.col(f"island_{a}").alias("from_island"), F.col(f"island_{b}").alias("to_island"),
            *[F.col(f"{a}{k}").alias(f"s{k}") for k in "xyz"], *[F.col(f"{b}{k}").alias(f"t{k}") for k in "xyz"],
            "horizontal", (F.col("vertical_delta_ab") * sign).alias("vertical"),
        )

    return way("a", "b", 1).unionByName(way("b", "a", -1))


def degrees(graph: Graph) -> DataFrame:
    """``id, polygon_count, mass_score, n_out, n_in`` of every island."""
    links = traversals(graph.edges)
    out = links.groupBy(F.col("from_island").alias("id")).agg(F.count("*").alias("n_out"))
    into = links.groupBy(F.col("to_island").alias("id")).agg(F.count("*").alias("n_in"))
    facts = graph.islands.select("id", "polygon_count", "mass_score")
    return facts.join(out, "id", "left").join(into, "id", "left").fillna(0, ["n_out", "n_in"])


def _p95(rows: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Of n sorted values the one at ((n - 1) * 95) div 100, from 0: its place in
    a histogram of the values, never in a list of them all."""
    counts = rows.groupBy(*by, name).agg(F.count("*").alias("k"))
    order = Window.partitionBy(*by).orderBy(name)
    upto = counts.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy(*by)))
    hit = upto.where(F.expr("upto > ((n - 1) * 95) div 100"))
    return hit.groupBy(*by).agg(F.min(name).alias(f"p95_{name}"))


def degree_stats(rows: DataFrame) -> DataFrame:
    """One row: islands with links out and in, largest and p95 degrees."""
    one = rows.withColumn("all", F.lit(1))
    top = one.groupBy("all").agg(
        F.count_if(F.col("n_out") > 0).alias("with_outgoing"), F.count_if(F.col("n_in") > 0).alias("with_incoming"),
        F.max("n_out").alias("max_n_out"), F.max("n_in").alias("max_n_in"),
    )
    return top.join(_p95(one, "n_out", ["all"]), "all").join(_p95(one, "n_in", ["all"]), "all").drop("all")


def mass_buckets(rows: DataFrame) -> DataFrame:
    """Three rows, by mass score below 1/3, below 2/3 and above."""
    bucket = F.when(F.col("mass_score") < 1 / 3, 0).when(F.col("mass_score") < 2 / 3, 1).otherwise(2)
    placed = rows.withColumn("bucket", bucket)
    lone = (F.col("n_out") == 0) & (F.col("n_in") == 0)
    sums = placed.groupBy("bucket").agg(
        F.count("*").alias("islands"), F.sum("n_out").alias("links_out"), F.sum("n_in").alias("links_in"), F.count_if(lone).alias("isolated"),
        F.max("n_out").alias("max_out"), F.max("n_in").alias("max_in"), F.sum("mass_score").alias("mass"),
    )
    found = sums.join(_p95(placed, "n_out", ["bucket"]), "bucket").join(_p95(placed, "n_in", ["bucket"]), "bucket")
    spine = rows.sparkSession.range(3).select(F.col("id").cast("int").alias("bucket"))
    names = {"p95_n_out": "p95_out", "p95_n_in": "p95_in"}
    out = spine.join(found, "bucket", "left").withColumnsRenamed(names)
    return out.fillna(0).fillna(0.0)


def isolated_islands(rows: DataFrame) -> DataFrame:
    """One row: islands without any link, their polygons and mass."""
    return rows.where("n_out = 0 AND n_in = 0").agg(
        F.count("*").alias("islands"), F.coalesce(F.sum("polygon_count"), F.lit(0)).alias("polygons"), F.coalesce(F.sum("mass_score"), F.lit(0.0)).alias("mass")
    )


def average_link_length(edges: DataFrame) -> DataFrame:
    return edges.agg(F.coalesce(F.avg("horizontal"), F.lit(0.0)).alias("average_length"))


def strong_components(graph: Graph) -> DataFrame:
    """``id, component``: islands that reach each other, named by the least id."""
    found = strongly_connected(traversals(graph.edges).select(F.col("from_island").alias("a"), F.col("to_island").alias("b")))
    return graph.islands.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def weak_components(graph: Graph) -> DataFrame:
    """``id, component`` of every island, directions aside."""
    found = connected_components(graph.edges.select(F.col("island_a").alias("a"), F.col("island_b").alias("b")))
    return graph.islands.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def largest_component(graph: Graph, components: DataFrame) -> DataFrame:
    """One row: the component with most islands; of equals the least id's."""
    sums = graph.islands.join(components, "id").groupBy("component").agg(
        F.count("*").alias("islands"), F.sum("polygon_count").alias("polygons"), F.sum("mass_score").alias("mass")
    )
    return sums.orderBy(F.desc("islands"), "component").limit(1)


def health(graph: Graph) -> dict:
    """All graph statistics, as plain values."""
    rows = store(degrees(graph), "degrees")
    parts = store(strong_components(graph), "components")
    lone, top, most = isolated_islands(rows).first(), degree_stats(rows).first(), largest_component(graph, parts).first()
    whole = graph.islands.agg(F.count("*").alias("n"), F.sum("polygon_count").alias("p"), F.sum("mass_score").alias("m")).first()
    return {
        "island_count": whole["n"], "polygon_count": whole["p"] or 0, "total_mass": whole["m"] or 0.0,
        "with_outgoing": top["with_outgoing"] if top else 0, "with_incoming": top["with_incoming"] if top else 0,
        "max_out": top["max_n_out"] if top else 0, "p95_out": top["p95_n_out"] if top else 0, "max_in": top["max_n_in"] if top else 0, "p95_in": top["p95_n_in"] if top else 0,
        "isolated_islands": lone["islands"], "isolated_polygons": lone["polygons"], "isolated_mass": lone["mass"],
        "components": parts.select("component").distinct().count(),
        "largest_islands": most["islands"] if most else 0, "largest_polygons": most["polygons"] if most else 0, "largest_mass": most["mass"] if most else 0.0,
        "average_link_length": average_link_length(graph.edges).first()[0],
        "mass_buckets": [r.asDict() for r in mass_buckets(rows).orderBy("bucket").collect()],
    }
