"""The engine's queries over the terrace grid of ``part``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago.functions.scalars import millimetres
from archipelago.operators import boundaries as border
from archipelago.operators import candidates as gaps
from archipelago.operators import graph as G
from archipelago.operators import prune as P
from archipelago.operators.islands import adjacency, eligible, label_islands, score_masses, summarize_islands, with_outbound
from archipelago.operators.paths import Limits, best_routes, priced, search_routes
from archipelago.operators.spatial import box_join
from archipelago.plans.build import build, islands_of
from archipelago.plans.config import BuildConfig, Cells, GlobalPrune, MassAware, Query, Reserve, Spanner
from archipelago.sources.graphfile import read_graph, write_graph
from archipelago.sources.mesh import Mesh, terrace_grid
from archipelago.storage import new_path, store

CONFIG = BuildConfig.of(5, 4, 6)
MASSY = replace(CONFIG, mass=MassAware(enabled=True, suppress_small=True, suppressed_percent=0.25))

#: Masses count for the order of links, for radii and for the reserve.
AWARE = replace(CONFIG, mass=MassAware(enabled=True, target_preference_ratio=0.2, low_radius_scale=0.5, high_radius_scale=1.5))
SYMMETRIC = BuildConfig.of(5, 5, 5)


def _with(config: BuildConfig, **changes) -> BuildConfig:
    return replace(config, density=replace(config.density, **changes))


class World:
    """The grid's mesh and, made when first asked for, the stages of its build."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        mesh = terrace_grid(spark.read.parquet(f"{sf_dir}/part.parquet"))
        self.mesh = Mesh(store(mesh.polygons, "polygons"), store(mesh.poly_edges, "poly-edges"))
        self._made: dict[str, DataFrame] = {}

    def _get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = store(make(), name)
        return self._made[name]

    @property
    def labels(self) -> DataFrame:
        return self._get("labels", lambda: label_islands(self.mesh, CONFIG))

    @property
    def islands(self) -> DataFrame:
        return self._get("islands", lambda: islands_of(self.mesh, CONFIG, self.labels))

    @property
    def massy(self) -> DataFrame:
        return self._get("massy", lambda: islands_of(self.mesh, replace(MASSY, mass=replace(MASSY.mass, suppress_small=False)), self.labels))

    @property
    def raw(self) -> DataFrame:
        return self._get("raw", lambda: border.extract_boundaries(self.mesh, self.labels, self.islands))

    @property
    def scanned(self) -> DataFrame:
        return self._get("scanned", lambda: gaps.scan(border.dedup_boundaries(self.raw, CONFIG), self.mesh, self.labels, self.islands, CONFIG, CONFIG.gap.horizontal))

    @property
    def candidates(self) -> DataFrame:
        return self._get("candidates", lambda: gaps.dedup_candidates(self.scanned.where("accepted").select(*gaps.LINK), self.islands, CONFIG))

    @property
    def ranked(self) -> DataFrame:
        return self._get("ranked", lambda: P.rank_links(self.candidates, self.islands, CONFIG))

    @property
    def aware(self) -> DataFrame:
        return self._get("aware", lambda: P.rank_links(self.candidates, self.massy, AWARE))

    @property
    def mirrored(self) -> DataFrame:
        def make() -> DataFrame:
            found = gaps.scan(border.dedup_boundaries(self.raw, SYMMETRIC), self.mesh, self.labels, self.islands, SYMMETRIC, SYMMETRIC.gap.horizontal)
            return P.rank_links(gaps.dedup_candidates(found.where("accepted").select(*gaps.LINK), self.islands, SYMMETRIC), self.islands, SYMMETRIC)

        return self._get("mirrored", make)

    @property
    def local(self) -> DataFrame:
        return self._get("local", lambda: P.prune_local(self.ranked, self.islands, CONFIG))

    @property
    def edges(self) -> DataFrame:
        return self._get("edges", lambda: P.corridor_edges(P.collapse(self.local, CONFIG), self.islands, CONFIG).select(*G.EDGE))

    @property
    def graph(self) -> G.Graph:
        return G.Graph(self.massy, self.edges, self.labels.select("poly_ref", "island"))

    @property
    def degrees(self) -> DataFrame:
        return self._get("degrees", lambda: G.degrees(self.graph))

    @property
    def requests(self) -> DataFrame:
        """From the centre of island 0 to the centre of every island."""
        at = lambda p: [F.col(f"center_{k}").alias(f"{p}{k}") for k in "xyz"]
        start = self.islands.where("id = 0").select(F.col("id").alias("start_island"), *at("a"), F.lit(1).alias("one"))
        ends = self.islands.select(F.col("id").alias("request_id"), F.col("id").alias("end_island"), *at("b"), F.lit(1).alias("one"))
        return ends.join(start, "one").drop("one")


@lru_cache(maxsize=8)
def _world(app: str, spark: SparkSession, sf_dir: str) -> World:
    return World(spark, sf_dir)


def world(spark: SparkSession, sf_dir: str) -> World:
    return _world(spark.sparkContext.applicationId, spark, sf_dir)


def _mm(*names: str) -> list:
    return [millimetres(n).alias(f"{n}_mm") for n in names]


_ENDS = [f"{p}{k}" for p in "st" for k in "xyz"]


def _links(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, "from_island", "to_island", *_mm(*_ENDS, "horizontal", "vertical"))


def mesh_scan_filter(w: World) -> DataFrame:
    config = replace(CONFIG, query=Query(include_flags=3, exclude_flags=2))
    return w.mesh.polygons.where(eligible(config)).select("poly_ref", "ord", "flags")


def polygon_adjacency(w: World) -> DataFrame:
    return adjacency(w.mesh)


def island_labels(w: World) -> DataFrame:
    return w.labels.select("poly_ref", "island")


def island_summary(w: World) -> DataFrame:
    boxes = [F.round(F.col(f"{p}_{k}"), 6).alias(f"{p}_{k}") for p in ("center", "min", "max") for k in "xyz"]
    return summarize_islands(w.mesh, w.labels).select("id", "polygon_count", *boxes, F.round("raw_mass", 6).alias("raw_mass"))


def mass_scores(w: World) -> DataFrame:
    return score_masses(summarize_islands(w.mesh, w.labels), MASSY).select("id", F.round("mass_score", 6).alias("mass_score"))


def small_island_suppression(w: World) -> DataFrame:
    return with_outbound(score_masses(summarize_islands(w.mesh, w.labels), MASSY), MASSY).select("id", "suppressed", "outbound")


def _segments(rows: DataFrame) -> DataFrame:
    return rows.select("island", "poly_ref", "edge_no", *_mm(*[f"{p}{k}" for p in "se" for k in "xyz"]))


def boundary_edges(w: World) -> DataFrame:
    return _segments(border.extract_boundaries(w.mesh, w.labels, w.islands))


def boundary_dedup(w: World) -> DataFrame:
    wide = replace(CONFIG, boundaries=replace(CONFIG.boundaries, dedup=Cells(True, 3.0)))
    return _segments(border.dedup_boundaries(w.raw, wide))


def boundary_representatives(w: World) -> DataFrame:
    config = replace(CONFIG, boundaries=replace(CONFIG.boundaries, representatives=Cells(True, 6.0)))
    return _segments(border.select_representatives(w.raw, w.islands, config))


def representative_budget(w: World) -> DataFrame:
    config = replace(CONFIG, boundaries=replace(CONFIG.boundaries, representatives=Cells(True, 3.0), most=5))
    return _segments(border.select_representatives(w.raw, w.islands, config))


def spatial_candidates(w: World) -> DataFrame:
    found = gaps.scan(w.raw, w.mesh, w.labels, w.islands, CONFIG, CONFIG.gap.horizontal)
    return _links(found.where("accepted"), "poly_ref", "edge_no", "near_ref")


def island_box_probe(w: World) -> DataFrame:
    """How many midpoints of others lie within reach of each island's bounds, which
    are of all sizes."""
    boxes = w.islands.select(F.col("id").alias("to_island"), *[f"{p}_{k}" for p in ("min", "max") for k in "xyz"])
    near = box_join(w.raw, boxes, (2.0, 6.0, 2.0), where=F.col("to_island") != F.col("island"))
    return near.groupBy("to_island", "island").agg(F.count("*").alias("midpoints"))


def spherical_candidates(w: World) -> DataFrame:
    """Equal limits make the envelope a sphere."""
    config = BuildConfig.of(5, 5, 5)
    found = gaps.scan(w.raw, w.mesh, w.labels, w.islands, config, config.gap.horizontal)
    return _links(found.where("accepted"), "poly_ref", "edge_no", "near_ref")


def outbound_policy(w: World) -> DataFrame:
    """Candidates where only two islands of three may be left."""
    config = replace(CONFIG, outbound=lambda: F.col("id") % 3 != 0)
    islands = with_outbound(w.islands.drop("outbound"), config)
    found = gaps.scan(border.outbound_boundaries(w.raw, islands), w.mesh, w.labels, islands, config, config.gap.horizontal)
    return _links(found.where("accepted"), "poly_ref", "edge_no", "near_ref")


def pair_scan_suppression(w: World) -> DataFrame:
    config = _with(CONFIG, pair_scan=Cells(True, 4.0))
    return _links(gaps.suppress_pairs(w.scanned, w.islands, config)[0])


def short_gap_recovery(w: World) -> DataFrame:
    config = _with(CONFIG, recovery=Cells(True, 2.0))
    found = gaps.scan(w.raw, w.mesh, w.labels, w.islands, config, config.recovery_gap, recovery=True)
    return _links(found.where("accepted"), "poly_ref", "edge_no", "near_ref")


def candidate_dedup(w: World) -> DataFrame:
    return _links(gaps.dedup_candidates(w.scanned.where("accepted").select(*gaps.LINK), w.islands, CONFIG))


def link_ranking(w: World) -> DataFrame:
    return _links(P.rank_links(w.candidates, w.islands, CONFIG), "rank")


def local_prune(w: World) -> DataFrame:
    return _links(P.prune_local(w.ranked, w.islands, CONFIG), "rank")


def spanner_prune(w: World) -> DataFrame:
    return _links(P.prune_global_and_spanner(w.local, w.islands, _with(CONFIG, spanner=Spanner(True, 1.5))), "rank")


def global_spanner_prune(w: World) -> DataFrame:
    config = _with(CONFIG, spanner=Spanner(True, 1.5), overall=GlobalPrune(True, 1.0))
    return _links(P.prune_global_and_spanner(w.local, w.islands, config), "rank")


def distinct_target_reserve(w: World) -> DataFrame:
    return _links(P.prune_with_reserve(w.ranked, w.islands, _with(CONFIG, reserve=Reserve(True, 0, 2), spanner=Spanner(True, 1.5))), "rank")


def mass_link_ranking(w: World) -> DataFrame:
    return _links(w.aware, "rank")


def mass_local_prune(w: World) -> DataFrame:
    return _links(P.prune_local(w.aware, w.massy, AWARE), "rank")


def mass_reserve(w: World) -> DataFrame:
    """Radii so wide that the reserve has links to save."""
    config = _with(AWARE, local=Cells(True, 6.0), reserve=Reserve(True, 1, 8))
    return _links(P.prune_with_reserve(w.aware, w.massy, config), "rank")


def symmetric_prune(w: World) -> DataFrame:
    """With equal limits a link also stands in its target's list."""
    return _links(P.prune_local(w.mirrored, w.islands, SYMMETRIC), "rank")


def symmetric_reserve(w: World) -> DataFrame:
    """A link counts for the reserves of both its ends."""
    config = _with(SYMMETRIC, local=Cells(True, 4.0), reserve=Reserve(True, 0, 3))
    return _links(P.prune_with_reserve(w.mirrored, w.islands, config), "rank")


def global_reserve(w: World) -> DataFrame:
    """Global pruning, which heeds no reserve, beside a spanner, which does."""
    config = _with(CONFIG, reserve=Reserve(True, 0, 2), spanner=Spanner(True, 1.5), overall=GlobalPrune(True, 1.0))
    return _links(P.prune_with_reserve(w.ranked, w.islands, config), "rank")


def local_collapse(w: World) -> DataFrame:
    return _links(P.collapse(w.ranked, _with(CONFIG, local=Cells(True, 4.0))), "rank")


def corridor_edges(w: World) -> DataFrame:
    return P.corridor_edges(w.local, w.islands, CONFIG).select("edge_index", "island_a", "island_b", *_mm("horizontal", "vertical_delta_ab"), "trav_ab", "trav_ba")


def traversals(w: World) -> DataFrame:
    return _links(G.traversals(w.edges), "edge_index")


def degree_stats(w: World) -> DataFrame:
    return G.degree_stats(w.degrees)


def mass_buckets(w: World) -> DataFrame:
    return G.mass_buckets(w.degrees).withColumn("mass", F.round("mass", 6))


def isolated_islands(w: World) -> DataFrame:
    return G.isolated_islands(w.degrees).withColumn("mass", F.round("mass", 6))


def average_link_length(w: World) -> DataFrame:
    return G.average_link_length(w.edges).select(F.round("average_length", 6).alias("average_length"))


def strong_components(w: World) -> DataFrame:
    return G.strong_components(w.graph)


def largest_component(w: World) -> DataFrame:
    return G.largest_component(w.graph, store(G.strong_components(w.graph), "components")).withColumn("mass", F.round("mass", 6))


def _costs(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "status", millimetres("cost").alias("cost_mm"))


def shortest_paths(w: World) -> DataFrame:
    return _costs(best_routes(w.requests, priced(G.traversals(w.edges)), edges=False).withColumn("cost", F.coalesce("cost", F.lit(0.0))))


def shortest_path_filtered(w: World) -> DataFrame:
    links = priced(G.traversals(w.edges), keep=F.col("vertical") <= 0)
    return _costs(best_routes(w.requests, links, edges=False).withColumn("cost", F.coalesce("cost", F.lit(0.0))))


def custom_cost_path(w: World) -> DataFrame:
    links = priced(G.traversals(w.edges), cost=F.col("horizontal") * 2 + F.abs("vertical"))
    return _costs(best_routes(w.requests, links, edges=False).withColumn("cost", F.coalesce("cost", F.lit(0.0))))


def context_path(w: World) -> DataFrame:
    """Routes of which only the last link, the one into the goal's island, may climb."""
    links = G.traversals(w.edges)
    routes = best_routes(w.requests, priced(links, keep=F.col("vertical") <= 0), last=priced(links), edges=False)
    return _costs(routes.withColumn("cost", F.coalesce("cost", F.lit(0.0))))


def route_search(w: World) -> DataFrame:
    """Status and cost only, which requests without limits find together."""
    return _costs(search_routes(w.requests, priced(G.traversals(w.edges)), w.islands, Limits(), counters=False))


def graph_roundtrip(w: World) -> DataFrame:
    path = f"{new_path(w.spark, 'graph')}.bin"
    write_graph(path, w.graph.islands, w.graph.edges, w.graph.polygon_island)
    islands, _ = read_graph(w.spark, path)
    return islands.select("id", F.explode("polygons").alias("poly_ref"))


def polygon_lookup(w: World) -> DataFrame:
    wanted = w.mesh.polygons.select("poly_ref")
    return w.graph.island_of(wanted).select("poly_ref", "island")


def island_adjacency(w: World) -> DataFrame:
    return w.graph.adjacency().select("id", F.array_join(F.col("edge_indices").cast("array<string>"), ",").alias("edges"))


def build_stats(w: World) -> DataFrame:
    result = build(w.mesh, _with(CONFIG, spanner=Spanner(True, 1.5)))
    plain = [(k, round(float(v), 6)) for k, v in result.stats.items() if not isinstance(v, list)]
    return w.spark.createDataFrame(plain, "name string, value double")


QUERIES = [
    mesh_scan_filter, polygon_adjacency, island_labels, island_summary, mass_scores, small_island_suppression,
    boundary_edges, boundary_dedup, boundary_representatives, representative_budget, spatial_candidates, island_box_probe, spherical_candidates, outbound_policy,
    pair_scan_suppression, short_gap_recovery, candidate_dedup, link_ranking, local_prune, spanner_prune,
    global_spanner_prune, distinct_target_reserve, mass_link_ranking, mass_local_prune, mass_reserve, symmetric_prune, symmetric_reserve, global_reserve, local_collapse, corridor_edges, traversals, degree_stats,
    mass_buckets, isolated_islands, average_link_length, strong_components, largest_component, shortest_paths,
    shortest_path_filtered, custom_cost_path, context_path, route_search, graph_roundtrip, polygon_lookup, island_adjacency, build_stats,
]


def _query(f: Callable[[World], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(world(spark, sf_dir))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _query(f) for f in QUERIES}
