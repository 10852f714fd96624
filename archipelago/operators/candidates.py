"""Gap crossings: the range join of border midpoints with other islands'
polygons, the traversal envelope, pair suppression, recovery and dedup.

A link has ``from_island, to_island``, its ends ``s*`` and ``t*`` and its
``horizontal`` and ``vertical`` distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.functions.scalars import clamp, distance, finite, millimetres, quantize
from archipelago.operators.islands import eligible
from archipelago.operators.ranking import dealt, numbered
from archipelago.operators.spatial import box_join
from archipelago.plans.config import BuildConfig
from archipelago.sources.mesh import Mesh
from archipelago.storage import store

LINK = ["from_island", "to_island", *[f"{p}{k}" for p in "st" for k in "xyz"], "horizontal", "vertical"]


#: What the plan raises at a polygon, or a nearest point of one, that is not finite.
NOT_FINITE = "a polygon within the scan has coordinates that are not finite"


def _or_raise(good: Column, value: Column) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(NOT_FINITE)).cast("double"))


def polygon_boxes(mesh: Mesh, config: BuildConfig) -> DataFrame:
    """Eligible polygons with their bounds.  The scan of one with a vertex that is
    not finite fails where it is read, by an error that says :data:`NOT_FINITE`."""
    rows = mesh.polygons.where(eligible(config))
    good = F.forall("verts", lambda v: finite(v["x"]) & finite(v["y"]) & finite(v["z"]))
    low = {f"min_{k}": F.array_min(F.col(f"verts.{k}")).cast("double") for k in "xyz"}
    high = {f"max_{k}": F.array_max(F.col(f"verts.{k}")).cast("double") for k in "xyz"}
    return rows.withColumns(low | high).withColumn("min_x", _or_raise(good, F.col("min_x")))


def nearest_on_polygon(verts: str = "verts") -> Column:
    """The point ``(x, y, z)`` of a flat convex polygon nearest to ``m*``.

    Straight above or below it is the point of the surface; beside it, the
    nearest point of the border.  Axis-parallel rectangles, the most, are a
    clamp per axis.
    """
    v = F.col(verts)
    box = (F.size(v) == 4) & (F.size(F.array_distinct(F.transform(v, lambda p: p["x"]))) == 2) & (F.size(F.array_distinct(F.transform(v, lambda p: p["z"]))) == 2) & (F.col("min_y") == F.col("max_y"))
    clamped = F.struct(clamp(F.col("mx"), F.col("min_x"), F.col("max_x")).alias("x"), F.col("min_y").alias("y"), clamp(F.col("mz"), F.col("min_z"), F.col("max_z")).alias("z"))

    def at(i: Column) -> Column:
        return F.get(v, (i % F.size(v)).cast("int"))

    every = F.sequence(F.lit(0), F.size(v) - 1)

    def cross(i: Column) -> Column:
        p, q = at(i), at(i + 1)
        return (q["x"].cast("double") - p["x"]) * (F.col("mz") - p["z"]) - (q["z"].cast("double") - p["z"]) * (F.col("mx") - p["x"])

    inside = F.forall(every, lambda i: cross(i) >= 0) | F.forall(every, lambda i: cross(i) <= 0)
    # the plane through the first three corners gives the height inside
    a, b, c = (F.get(v, F.lit(i)) for i in range(3))
    ux, uy, uz = (b[k].cast("double") - a[k] for k in "xyz")
    wx, wy, wz = (c[k].cast("double") - a[k] for k in "xyz")
    nx, ny, nz = uy * wz - uz * wy, uz * wx - ux * wz, ux * wy - uy * wx
    rise = F.when(ny != 0, -(nx * (F.col("mx") - a["x"]) + nz * (F.col("mz") - a["z"])) / ny).otherwise(F.lit(0.0))
    above = F.struct(F.col("mx").alias("x"), (a["y"].cast("double") + rise).alias("y"), F.col("mz").alias("z"))

    def on_edge(i: Column) -> Column:
        p, q = at(i), at(i + 1)
        d = {k: q[k].cast("double") - p[k] for k in "xyz"}
        size = d["x"] * d["x"] + d["z"] * d["z"]
        t = F.when(size > 0, clamp(((F.col("mx") - p["x"]) * d["x"] + (F.col("mz") - p["z"]) * d["z"]) / size, F.lit(0.0), F.lit(1.0))).otherwise(F.lit(0.0))
        spot = {k: p[k].cast("double") + t * d[k] for k in "xyz"}
        far = (spot["x"] - F.col("mx")) * (spot["x"] - F.col("mx")) + (spot["z"] - F.col("mz")) * (spot["z"] - F.col("mz"))
        return F.struct(far.alias("far"), *[spot[k].alias(k) for k in "xyz"])

    edge = F.array_min(F.transform(every, on_edge))
    general = F.when(inside, above).otherwise(F.struct(*[edge[k].alias(k) for k in "xyz"]))
    return F.when(box, clamped).otherwise(general)


def envelope(config: BuildConfig, gap: float) -> Column:
    """Whether a link can be crossed; all limits are inclusive."""
    if config.spherical:
        return distance("s", "t") <= F.lit(config.extent)
    return (F.col("horizontal") <= gap) & (F.col("vertical") <= config.gap.up) & (F.col("vertical") >= -config.gap.down)


def _near_boxes(mesh: Mesh, config: BuildConfig) -> DataFrame:
    return polygon_boxes(mesh, config).select(F.col("poly_ref").alias("near_ref"), "verts", *[f"{p}_{k}" for p in ("min", "max") for k in "xyz"])


def _probe(config: BuildConfig, gap: float, recovery: bool) -> tuple[float, float, float]:
    rise = max(config.gap.up, config.gap.down)
    return gap, min(gap, rise) if recovery else rise, gap


def near_polygons(boundaries: DataFrame, mesh: Mesh, config: BuildConfig, gap: float, recovery: bool = False) -> DataFrame:
    """Border midpoints and the polygons whose bounds lie in their query box."""
    return box_join(boundaries, _near_boxes(mesh, config), _probe(config, gap, recovery))


def scan(boundaries: DataFrame, mesh: Mesh, labels: DataFrame, islands: DataFrame, config: BuildConfig, gap: float, recovery: bool = False) -> DataFrame:
    """Every link from a border midpoint to a polygon of another island, with
    ``accepted`` for those within the envelope.  A nearest point that is not finite
    fails the scan (:data:`NOT_FINITE`)."""
    targets = labels.select(F.col("poly_ref").alias("near_ref"), F.col("island").alias("to_island"))
    alive = islands.where("NOT suppressed").select(F.col("id").alias("to_island"))
    # boxes know their island before they meet midpoints, so none of the own island's are paired
    boxes = _near_boxes(mesh, config).join(targets, "near_ref").join(alive, "to_island", "left_semi")
    near = box_join(boundaries, boxes, _probe(config, gap, recovery), where=F.col("to_island") != F.col("island"))
    # exploded, so that filters on what follows from the spot do not work it out anew for each mention
    spot = near.withColumn("spot", F.explode(F.array(nearest_on_polygon())))
    links = spot.select(
        F.col("island").alias("from_island"), "to_island", F.col("poly_ref"), "edge_no", "ord", "near_ref",
        *[F.col(f"m{k}").alias(f"s{k}") for k in "xyz"], *[F.col(f"spot.{k}").alias(f"t{k}") for k in "xyz"],
    )
    dx, dz = F.col("sx") - F.col("tx"), F.col("sz") - F.col("tz")
    links = links.withColumn("horizontal", F.sqrt(dx * dx + dz * dz)).withColumn("vertical", F.col("ty") - F.col("sy"))
    links = links.withColumn("horizontal", _or_raise(finite("horizontal") & finite("vertical"), F.col("horizontal")))
    return links.withColumn("accepted", envelope(config, gap))


def link_order(config: BuildConfig) -> list[Column]:
    """The order of links from best to worst.

    With mass awareness the importance of the two islands comes first, in steps
    of a thousandth; then the rank and the length in millimetres, then the ends.
    Needs ``from_mass`` and ``to_mass`` with mass awareness.
    """
    length = distance("s", "t")
    rank = length
    first: list[Column] = []
    if config.mass.enabled:
        first = [-F.floor(F.col("from_mass") * F.col("to_mass") / F.lit(0.001))]
        rank = length - F.lit(config.mass.preference(config.gap.horizontal)) * F.col("to_mass")
    if config.link_ranker:
        own = config.link_ranker()
        rank = F.when(finite(own), own).otherwise(rank)
    ends = [F.col(f"{p}{k}") for p in "st" for k in "xyz"]
    return [*first, millimetres(rank), millimetres(length), F.col("from_island"), F.col("to_island"), *ends]


def with_masses(links: DataFrame, islands: DataFrame) -> DataFrame:
    m = lambda end: islands.select(F.col("id").alias(f"{end}_island"), F.col("mass_score").alias(f"{end}_mass"))
    return links.join(m("from"), "from_island").join(m("to"), "to_island")


def rank_links(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Add ``rank``, the place of each link in the order, from 1."""
    return numbered(with_masses(links, islands), link_order(config), "rank", n=links.count())


def _ordered(config: BuildConfig) -> Column:
    return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(link_order(config))])


def suppress_pairs(links: DataFrame, islands: DataFrame, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """The best link per midpoint and target, of which only the first one that
    is accepted counts per island pair and cell of the midpoint.

    Returns the links and, for the counters, a row per midpoint and target with
    ``suppressed``.
    """
    cell = config.density.pair_scan.cell(config.extent)
    swap = F.lit(config.symmetric) & (F.col("to_island") < F.col("from_island"))
    pair = {"pa": F.when(swap, F.col("to_island")).otherwise(F.col("from_island")), "pb": F.when(swap, F.col("from_island")).otherwise(F.col("to_island"))}
    key = pair | {f"q{k}": quantize(f"s{k}", cell) for k in "xyz"}
    turn = F.struct("from_island", "ord", "edge_no", "to_island")
    own = ["from_island", "to_island", "poly_ref", "ord", "edge_no", "sx", "sy", "sz"]
    n = links.count()
    groups = dealt(with_masses(links, islands), n, *own).groupBy(*own).agg(
        F.max("accepted").alias("any"), F.min_by(F.struct(*LINK), F.when(F.col("accepted"), _ordered(config))).alias("best")
    )
    groups = dealt(groups.withColumns(key).withColumn("turn", turn), n, *key)
    commit = F.min(F.when(F.col("any"), F.col("turn"))).over(Window.partitionBy(*key))
    groups = groups.withColumn("commit", commit).withColumn("suppressed", F.coalesce(F.col("turn") > F.col("commit"), F.lit(False)))
    return groups.where("turn = commit").select("best.*"), groups.select("from_island", "to_island", "suppressed", "any")


def dedup_candidates(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """The best link of each voxel pair and island pair; with symmetric limits
    both directions share one."""
    given = links
    links = links.join(islands.where("outbound").select(F.col("id").alias("from_island")), "from_island", "left_semi")
    keep = [c for c in links.columns]
    if not config.density.candidates.enabled:
        return links
    cell = config.density.candidates.cell(config.extent)
    swap = F.lit(config.symmetric) & (F.col("to_island") < F.col("from_island"))
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    key = {"ka": pick(F.col("from_island"), F.col("to_island")), "kb": pick(F.col("to_island"), F.col("from_island"))}
    key |= {f"k{p}{k}": quantize(pick(F.col(f"{p}{k}"), F.col(f"{q}{k}")), cell) for p, q in (("s", "t"), ("t", "s")) for k in "xyz"}
    best = dealt(with_masses(links, islands).withColumns(key), given.count(), *key).groupBy(*key).agg(F.min_by(F.struct(*keep), _ordered(config)).alias("b"))
    return best.select("b.*")


def discover(boundaries: DataFrame, representatives: DataFrame, mesh: Mesh, labels: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """All candidate links, marked with ``recovery``."""
    links = store(scan(representatives, mesh, labels, islands, config, config.gap.horizontal), "scanned")
    if config.density.pair_scan.enabled:
        links = suppress_pairs(links, islands, config)[0]
    else:
        links = links.where("accepted").select(*LINK)
    links = links.withColumn("recovery", F.lit(False))
    if config.density.recovery.enabled:
        short = scan(boundaries, mesh, labels, islands, config, config.recovery_gap, recovery=True)
        links = links.unionByName(short.where("accepted").select(*LINK).withColumn("recovery", F.lit(True)))
    return dedup_candidates(store(links, "found"), islands, config)
