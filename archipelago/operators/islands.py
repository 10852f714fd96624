"""Islands: eligibility, labelling, shape, mass and suppression."""

from __future__ import annotations

from math import log
from struct import pack, unpack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.operators.components import contracted_components
from archipelago.operators.ranking import numbered
from archipelago.plans.config import BuildConfig
from archipelago.sources.mesh import Mesh
from archipelago.storage import drop, store

#: Islands below which none is suppressed.
SUPPRESSION_FLOOR = 20
MAX_ROUNDS = 10_000


def eligible(config: BuildConfig) -> Column:
    """Flag test, and the caller's test in place of the ground test."""
    q = config.query
    flags = F.col("flags")
    passes = (flags.bitwiseAND(F.lit(q.include_flags)) != 0) & (flags.bitwiseAND(F.lit(q.exclude_flags)) == 0)
    return passes & (config.polygon_filter() if config.polygon_filter else F.col("is_ground"))


def adjacency(mesh: Mesh, symmetrize: bool = False) -> DataFrame:
    """``src, dst``: polygons and the neighbours across their inner edges."""
    pairs = mesh.poly_edges.where("neighbor_ref IS NOT NULL").select(F.col("poly_ref").alias("src"), F.col("neighbor_ref").alias("dst"))
    pairs = pairs.join(mesh.polygons.select(F.col("poly_ref").alias("dst")), "dst").select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct() if symmetrize else pairs.distinct()


def _first_to_reach(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``ord, label``: the least of ``nodes(ord)`` that reaches each along the one-way
    ``links(from, to)``.  A round takes two steps along the links and one jump to the
    label's own label."""
    now, total = store(nodes.select("ord", F.col("ord").alias("label")), "labels"), None
    for _ in range(MAX_ROUNDS):
        step = now
        for _ in range(2):
            met = links.join(step.select(F.col("ord").alias("from"), "label"), "from").groupBy(F.col("to").alias("ord")).agg(F.min("label").alias("met"))
            step = step.join(met, "ord", "left").select("ord", F.least("label", "met").alias("label"))
        jump = step.select(F.col("ord").alias("label"), F.col("label").alias("far"))
        after = store(step.join(jump, "label").select("ord", F.least("label", "far").alias("label")), "labels")
        mark = after.agg(F.sum("label"), F.count("*")).first()
        drop(now)
        now = after
        if tuple(mark) == total:
            return now
        total = tuple(mark)
    raise RuntimeError(f"islands did not settle in {MAX_ROUNDS} rounds")


def label_islands(mesh: Mesh, config: BuildConfig, symmetrize: bool = False) -> DataFrame:
    """``poly_ref, ord, island`` of the eligible polygons.

    A polygon belongs to the first polygon in scan order that reaches it over
    eligible ones; islands are numbered in that order.  Polygons that are each
    other's neighbours are contracted first, which is all there is in most meshes;
    edges that lead one way only are then followed between what is left, where each
    group stands for its first polygon.
    """
    fit = store(mesh.polygons.where(eligible(config)).select("poly_ref", "ord"), "eligible")
    edges = adjacency(mesh, symmetrize)
    own = lambda ref, name: fit.select(F.col("poly_ref").alias(ref), F.col("ord").alias(name))
    edges = edges.join(own("src", "from"), "src").join(own("dst", "to"), "dst").where("from <> to")
    pairs = edges.groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.max(F.col("from") < F.col("to")).alias("up"), F.max(F.col("from") > F.col("to")).alias("down"))
    pairs = store(pairs, "adjacency")
    found = store(contracted_components(pairs.where("up AND down")), "grouped")
    group = lambda name: found.select(F.col("id").alias(name), F.col("component").alias(f"g_{name}"))
    ways = pairs.where("up <> down").select(F.when(F.col("up"), F.col("a")).otherwise(F.col("b")).alias("from"), F.when(F.col("up"), F.col("b")).otherwise(F.col("a")).alias("to"))
    ways = ways.join(group("from"), "from", "left").join(group("to"), "to", "left").select(F.coalesce("g_from", "from").alias("from"), F.coalesce("g_to", "to").alias("to"))
    ways = store(ways.where("from <> to").distinct(), "one-way")
    now = fit.select("poly_ref", "ord").join(found.withColumnRenamed("id", "ord"), "ord", "left").select("poly_ref", "ord", F.coalesce("component", "ord").alias("label"))
    if ways.head(1):
        nodes = ways.select(F.col("from").alias("ord")).unionByName(ways.select(F.col("to").alias("ord"))).distinct()
        reached = _first_to_reach(nodes, ways).select(F.col("ord").alias("label"), F.col("label").alias("first"))
        now = now.join(reached, "label", "left").select("poly_ref", "ord", F.coalesce("first", "label").alias("label"))
    now = store(now, "labels")
    numbers = numbered(now.where("ord = label").select("label"), [F.col("label")], "island", first=0)
    return store(now.join(numbers, "label").select("poly_ref", "ord", "island"), "islands")


def summarize_islands(mesh: Mesh, labels: DataFrame) -> DataFrame:
    """Polygons, centre, bounds and raw mass of each island.

    The centre is the mean of the polygons' own centres; the mass is the number
    of polygons times the longer ground side of the bounds.
    """
    corners = mesh.polygons.join(labels.select("poly_ref", "island"), "poly_ref").select("island", "poly_ref", F.explode("verts").alias("v"))
    axes = "xyz"
    per_polygon = corners.groupBy("island", "poly_ref").agg(
        *[f(F.col(f"v.{k}").cast("double")).alias(f"{n}{k}") for k in axes for n, f in (("c", F.avg), ("lo", F.min), ("hi", F.max))]
    )
    out = per_polygon.groupBy("island").agg(
        F.count("*").alias("polygon_count"),
        *[F.avg(f"c{k}").alias(f"center_{k}") for k in axes],
        *[F.min(f"lo{k}").alias(f"min_{k}") for k in axes],
        *[F.max(f"hi{k}").alias(f"max_{k}") for k in axes],
    )
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_z") - F.col("min_z"))
    return out.withColumn("raw_mass", F.col("polygon_count") * side).withColumnRenamed("island", "id")


def _least_and_percentile(masses: DataFrame, share: float) -> tuple[float | None, float | None]:
    """The least mass and the interpolated percentile, by places in sorted
    ranges: two rows come to the driver, whatever the number of islands."""
    n = masses.count()
    if not n:
        return None, None
    at = share * (n - 1)
    places = numbered(masses, [F.col("raw_mass")], "place", first=0)
    found = {r["place"]: r["raw_mass"] for r in places.where(F.col("place").isin(0, int(at), min(n - 1, int(at) + 1))).collect()}
    low, high = found[int(at)], found[min(n - 1, int(at) + 1)]
    return found[0], low + (high - low) * (at - int(at))


def score_masses(islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Add ``mass_score`` in [0, 1] and ``suppressed``.

    The score is logarithmic between the least positive mass and a percentile
    of the positive ones; it stays 0 unless mass awareness is on.  Suppression
    takes the lightest share of islands, if there are enough of them.
    """
    mass = config.mass
    scored = islands.withColumn("mass_score", F.lit(0.0))
    if mass.enabled:
        low, top = _least_and_percentile(islands.where("raw_mass > 0").select("raw_mass"), mass.percentile)
        raw = F.col("raw_mass")
        if low is None:
            score = F.lit(0.0)
        else:
            span = log(top / low)
            inner = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log(F.greatest(raw, F.lit(low)) / F.lit(low)) / F.lit(span))) if span > 0 else F.lit(1.0)
            score = F.when(raw > 0, inner).otherwise(F.lit(0.0))
        scored = islands.withColumn("mass_score", score)
    n = islands.count() if mass.suppress_small else 0
    if n < SUPPRESSION_FLOOR:
        return scored.withColumn("suppressed", F.lit(False))
    share = unpack("f", pack("f", n * unpack("f", pack("f", mass.suppressed_percent))[0]))[0]
    places = numbered(islands.select("raw_mass", "id"), [F.col("raw_mass"), F.col("id")], "place", first=0)
    least = places.where(F.col("place") < int(share)).select("id", F.lit(True).alias("low"))
    return scored.join(least, "id", "left").withColumn("suppressed", F.coalesce("low", F.lit(False))).drop("low")


def with_outbound(islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Add ``outbound``: may the island be a source of links."""
    policy = config.outbound() if config.outbound else F.lit(True)
    return islands.withColumn("outbound", ~F.col("suppressed") & policy)
