"""Routes over the island graph.

``best_routes`` relaxes many requests at once until no cost falls: in rounds over
regions of the graph, each searched within a task, or, where filters and costs see
the route's ends, over its traversals by joins.
``search_routes`` runs an A* search per request, with its budgets, counters and
statuses.  Requests with like ends are searched together, by a task that has the
regions they were seen to enter.

A route enters by a traversal's start and leaves by its end; walking inside an
island is a straight line.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import dist, inf, isfinite

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.functions.scalars import distance, finite
from archipelago.storage import drop, store, written

RESULT = "request_id long, status string, cost double, edges array<int>, islands array<long>, expanded long, queued long, peak_open long"


def priced(links: DataFrame, cost: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Traversals with their ``cost``; filtered ones and those without a usable
    cost (finite, not negative) are left out."""
    rows = links if keep is None else links.where(keep)
    rows = rows.withColumn("cost", distance("s", "t") if cost is None else cost.cast("double"))
    return rows.where(finite("cost") & (F.col("cost") >= 0))


def best_routes(requests: DataFrame, links: DataFrame, cost: Column | None = None, keep: Column | None = None, last: DataFrame | None = None, edges: bool = True) -> DataFrame:
    """``request_id, status, cost, edges`` for every request; without ``edges`` its
    costs only, whose labels are of one size however long a route is.

    ``requests``: ``request_id, start_island, end_island`` and the points
    ``a*`` and ``b*``; ``links`` are priced traversals.  Requests that start at
    the same point share their labels.  A label is the least cost known to
    arrive through a traversal.  Each round extends the labels that fell in the
    last one, unless all requests of the start already have better routes, or
    another label of the island gets to where they arrive for less on foot.
    Of routes that cost the same and meet at a traversal, the one with the lesser
    edge list goes on.

    ``cost`` and ``keep`` price and filter traversals for each route: they may
    name columns of ``links`` and the route's ``start_island``, ``end_island``
    and points; a traversal without a usable cost is left out.  Only requests with
    the same ends then share their labels.

    ``last``: priced traversals of which one, into the goal's island, is a route's
    last; ``links`` are those before it.  Such routes still share their labels.
    """
    context = cost is not None or keep is not None
    if context and last is not None:
        raise ValueError("last traversals go with links that are priced for all routes")
    best = _by_joins(requests, links, cost, keep) if context else _by_regions(requests, links, last, edges)
    out = requests.select("request_id", "start_island", "end_island").join(best, "request_id", "left")
    same = F.col("start_island") == F.col("end_island")
    out = out.select(
        "request_id",
        F.when(same, "same_island").when(F.col("best").isNotNull(), "success").otherwise("no_path").alias("status"),
        F.when(~same, F.col("best.total")).alias("cost"),
        F.when(~same, F.col("best.edges")).alias("edges"),
    )
    return out if edges else out.drop("edges")


#: Traversals that a region is meant to have; one island's are never parted.
REGION = 100_000

#: As many of them make a region of ``best_routes``, whose rounds cost some jobs each.
SPAN = 4
LABEL = "source long, request_id long, edge_index int, from_island long, to_island long, x double, y double, z double, g double, edges array<int>"


def regions(links: DataFrame, size: int) -> DataFrame:
    """``id, region`` of every island of ``links``: neighbours in a Z-order of their
    links' mean places, cut into ranges of some ``size`` traversals."""
    ends = [links.select(F.col(f"{side}_island").alias("id"), F.col(f"{p}x").alias("x"), F.col(f"{p}z").alias("z")) for side, p in (("from", "s"), ("to", "t"))]
    at = store(ends[0].unionByName(ends[1]).groupBy("id").agg(F.avg("x").alias("x"), F.avg("z").alias("z"), F.count("*").alias("n")), "places")
    low = at.agg(F.min("x"), F.min("z"), F.greatest(F.max("x") - F.min("x"), F.max("z") - F.min("z")), F.sum("n")).first()
    n, unit = (low[3] or 0) // 2, max(low[2] or 0.0, 1e-9) / 65535
    cell = lambda name, least: F.floor((F.col(name) - F.lit(least or 0.0)) / unit).cast("long")
    bits = lambda v, shift: sum((F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1)), 2 * k + shift) for k in range(16)), F.lit(0).cast("long"))
    coded = at.select("id", (bits(cell("x", low[0]), 0) + bits(cell("z", low[1]), 1)).alias("code"))
    return store(coded.repartitionByRange(1 + n // size, "code", "id").select("id", F.spark_partition_id().alias("region")), "regions")


def _by_regions(requests: DataFrame, links: DataFrame, last: DataFrame | None = None, edges: bool = True) -> DataFrame:
    """``request_id, best(total, edges)`` where all requests see the same costs.

    What enters a region through its borders is searched on within it to the end, so
    the number of rounds follows the regions on a route, not its traversals.  Only
    labels that pass a border are kept, and carry their edges, if these are wanted.
    A goal is where a route ends, or where each ``last`` traversal of it begins, with
    the cost from there.  Traversals lie in a folder for each region, and a round
    reads those of the regions that it searches.
    """
    asked = store(requests.where("start_island <> end_island"), "requests")
    starts = asked.select("start_island", "ax", "ay", "az").distinct().withColumn("source", F.monotonically_increasing_id())
    starts = store(starts, "sources")
    ways = ["from_island", "to_island", "sx", "sy", "sz", "tx", "ty", "tz"]
    where = regions(links if last is None else links.select(*ways).unionByName(last.select(*ways)), SPAN * REGION)
    at = lambda name: where.select(F.col("id").alias(name), "region")
    hop = links.select("edge_index", "from_island", "to_island", "sx", "sy", "sz", "tx", "ty", "tz", F.col("cost").cast("double").alias("cost")).join(at("from_island"), "from_island")
    hop = written(hop.repartition("region"), "portals", by="region")
    none, no_list = F.lit(None).cast("long"), F.array().cast("array<int>")
    ends = asked.join(starts, ["start_island", "ax", "ay", "az"])
    if last is None:
        ends = ends.select("source", "request_id", F.col("end_island").alias("to_island"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"), F.lit(0.0).alias("g"), no_list.alias("edges"))
    else:
        into = last.select("edge_index", "from_island", F.col("to_island").alias("end_island"), *ways[2:], F.col("cost").cast("double").alias("cost"))
        ends = ends.join(into, "end_island").select(
            "source", "request_id", F.col("from_island").alias("to_island"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"), (F.col("cost") + distance("t", "b")).alias("g"), (F.array("edge_index") if edges else no_list).alias("edges")
        )
    goal = ends.select("source", "request_id", F.lit(-1).alias("edge_index"), F.lit(-1).cast("long").alias("from_island"), "to_island", "x", "y", "z", "g", "edges")
    goal = store(goal.join(at("to_island"), "to_island"), "goals")
    now = starts.select(
        "source", none.alias("request_id"), F.lit(-1).alias("edge_index"), F.col("start_island").alias("from_island"), F.col("start_island").alias("to_island"), F.col("ax").alias("x"), F.col("ay").alias("y"), F.col("az").alias("z"), F.lit(0.0).alias("g"), no_list.alias("edges")
    )
    now = store(now.join(at("to_island"), "to_island").withColumn("stale", F.lit(False)), "routes")
    want = store(asked.join(starts, ["start_island", "ax", "ay", "az"]).groupBy("source").agg(F.count("*").alias("want")), "wanted")
    found = store(goal.select("source", "request_id", F.struct(F.col("g").alias("total"), "edges").alias("best")).limit(0), "found")
    limits = want.select("source", F.lit(inf).alias("limit"))
    search = lambda held, ground: _searched(held, ground, edges)
    while True:
        todo = now.where("NOT stale").join(limits, "source").where("g < limit").select("source", "region", "limit").distinct()
        todo = store(todo, "open")
        active = [r["region"] for r in todo.select("region").distinct().collect()]
        if not active:
            break
        held = now.select(*goal.columns).unionByName(goal).join(todo, ["source", "region"])
        ground = hop.where(F.col("region").isin(active)).join(todo.select("source", "region"), "region")
        made = store(held.groupBy("source", "region").cogroup(ground.groupBy("source", "region")).applyInPandas(search, LABEL), "passed")
        more = made.where("request_id IS NOT NULL").select("source", "request_id", F.struct(F.col("g").alias("total"), "edges").alias("best"))
        after = store(found.unionByName(more).groupBy("source", "request_id").agg(F.min("best").alias("best")), "found")
        drop(found)
        found = after
        got = found.groupBy("source").agg(F.count("*").alias("got"), F.max("best.total").alias("most"))
        limits = want.join(got, "source", "left").select("source", F.when(F.col("got") == F.col("want"), F.col("most")).otherwise(inf).alias("limit"))
        passed = made.where("request_id IS NULL").join(at("to_island"), "to_island").withColumn("stale", F.lit(False)).select(*now.columns)
        # what stood before comes first among equals, so that it is not searched again
        told = F.struct("g", "edges", (~F.col("stale")).alias("fresh"))
        both = now.withColumn("stale", F.lit(True)).unionByName(passed)
        key = ["source", "region", "edge_index", "from_island", "to_island", "x", "y", "z"]
        after = both.groupBy(*key).agg(F.min(told).alias("least"), none.alias("request_id"))
        after = store(after.select("to_island", "source", "request_id", "edge_index", "from_island", "x", "y", "z", F.col("least.g").alias("g"), F.col("least.edges").alias("edges"), "region", (~F.col("least.fresh")).alias("stale")), "routes")
        for old in (now, made, todo):
            drop(old)
        now = after
    return found.select("request_id", "best")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2])


def _beaten(g: float, at: list[float], by: list[tuple[float, list[float]]]) -> bool:
    """Whether one of ``by`` gets to ``at`` on foot for less than ``g``."""
    for b, p in by:
        if b + 1e-9 + dist(p, at) < g:
            return True
    return False


def _searched(held: pd.DataFrame, ground: pd.DataFrame, with_edges: bool) -> pd.DataFrame:
    """One source's search through one region: its labels that leave the region, and
    its requests that end there."""
    columns = [f.split(" ")[0] for f in LABEL.split(", ")]
    if held.empty:
        return pd.DataFrame(columns=columns)
    entries, goals = held[held["request_id"].isna()], held[held["request_id"].notna()]
    ground = ground.sort_values(["from_island", "edge_index"])
    s, t = ground[["sx", "sy", "sz"]].to_numpy(), ground[["tx", "ty", "tz"]].to_numpy()
    cost, number, to = ground["cost"].to_numpy(), ground["edge_index"].to_numpy(), ground["to_island"].to_numpy()
    own, first, count = np.unique(ground["from_island"].to_numpy(), return_index=True, return_counts=True)
    leaving = {int(i): (int(a), int(a + n)) for i, a, n in zip(own, first, count, strict=True)}
    inner, n = np.isin(to, own), len(ground)
    e_at, e_to, e_g, e_edges = entries[["x", "y", "z"]].to_numpy(), entries["to_island"].to_numpy(), entries["g"].to_numpy(), entries["edges"].to_list()
    best, back = np.full(n, inf), np.full(n, -1)
    limit = held["limit"].iloc[0]

    def edges(k: int) -> list[int]:
        """The edges up to label ``k``: a traversal, or from ``n`` on an entry."""
        if not with_edges:
            return []
        own = []
        while k < n:
            own.append(int(number[k]))
            k = int(back[k])
        return [*map(int, e_edges[k - n]), *own[::-1]]

    open_ = [(float(g), n + k) for k, g in enumerate(e_g)]
    heapq.heapify(open_)
    extended: dict[int, list] = {}
    while open_:
        g, k = heapq.heappop(open_)
        if g >= limit:
            break
        if k < n and g > best[k]:
            continue
        island, at = (int(to[k]), t[k]) if k < n else (int(e_to[k - n]), e_at[k - n])
        if island not in leaving:
            continue
        others, place = extended.setdefault(island, []), at.tolist()
        if _beaten(g, place, others):
            continue
        others.append((g, place))
        a, b = leaving[island]
        reach = g + _far(at, s[a:b]) + cost[a:b]
        for j in (np.flatnonzero((reach == best[a:b]) & (reach < inf)) + a).tolist() if with_edges else ():
            if int(back[j]) != k and edges(k) < edges(int(back[j])):
                back[j] = k
        less = np.flatnonzero(reach < best[a:b])
        best[a + less], back[a + less] = reach[less], k
        for j in less.tolist():
            if inner[a + j]:
                heapq.heappush(open_, (float(reach[j]), a + j))
    out, source = [], int(held["source"].iloc[0])
    reached = np.flatnonzero(best < limit)
    passed: dict[int, list] = {}
    for k in reached[~inner[reached]][np.argsort(best[reached[~inner[reached]]], kind="stable")].tolist():
        others, place = passed.setdefault(int(to[k]), []), t[k].tolist()
        if not _beaten(best[k], place, others):
            others.append((best[k], place))
            out.append((source, None, int(number[k]), int(ground["from_island"].iat[k]), int(to[k]), *place, float(best[k]), edges(k)))
    everywhere = np.concatenate([to, e_to])
    order = np.argsort(everywhere, kind="stable")
    sorted_to, g_all, at_all = everywhere[order], np.concatenate([best, e_g]), np.concatenate([t, e_at])
    ended: dict[int, tuple[float, list]] = {}
    for r in goals.itertuples():
        a, b = np.searchsorted(sorted_to, [r.to_island, r.to_island + 1])
        mine = order[a:b]
        mine = mine[g_all[mine] < inf]
        if len(mine):
            total = g_all[mine] + _far(at_all[mine], np.array([r.x, r.y, r.z])) + r.g
            least = float(total.min())
            before = ended.get(int(r.request_id), (inf, []))
            if least <= before[0]:
                ended[int(r.request_id)] = (least, (before[1] if least == before[0] else []) + [(k, r) for k in mine[total == least].tolist()])
    for request, (total, ways) in ended.items():
        r = ways[0][1]
        out.append((source, request, -1, -1, int(r.to_island), r.x, r.y, r.z, total, min([*edges(k), *map(int, r.edges)] for k, r in ways)))
    return pd.DataFrame(out, columns=columns).astype({"request_id": "Int64"})


def _by_joins(requests: DataFrame, links: DataFrame, cost: Column | None, keep: Column | None) -> DataFrame:
    """``request_id, best(total, edges)`` where filters and costs see the route's ends:
    a round for each traversal of the longest route."""
    if cost is None and "cost" in links.columns:
        cost = F.col("cost")
    asked = store(requests.withColumn("source", F.struct("start_island", "ax", "ay", "az", "end_island", "bx", "by", "bz")), "requests")
    hop = store(links.withColumn("portal", F.struct("edge_index", "from_island")), "portals")

    def for_route(rows: DataFrame) -> DataFrame:
        """``rows`` of a source and a traversal, for which its filter and cost hold."""
        return priced(rows.select("*", "source.*"), cost, keep)

    first = asked.where("start_island <> end_island").select("source", F.col("start_island").alias("from_island")).distinct().join(hop, "from_island")
    first = for_route(first).withColumns({f"a{k}": F.col(f"source.a{k}") for k in "xyz"})
    now = store(first.select("source", "portal", (distance("a", "s") + F.col("cost")).alias("g"), F.array("edge_index").alias("edges"), F.lit(True).alias("fresh")), "routes")
    arrival = hop.select("portal", F.col("to_island").alias("via"), *[F.col(f"t{k}").alias(f"e{k}") for k in "xyz"])

    def goals(labels: DataFrame) -> DataFrame:
        ends = asked.where("start_island <> end_island").select("request_id", "source", F.col("end_island").alias("to_island"), *[f"b{k}" for k in "xyz"])
        at = labels.join(hop.select("portal", "to_island", *[f"t{k}" for k in "xyz"]), "portal").join(ends, ["source", "to_island"])
        return at.groupBy("source", "request_id").agg(F.min(F.struct((F.col("g") + distance("t", "b")).alias("total"), "edges")).alias("best"))

    def leading(labels: DataFrame) -> DataFrame:
        """Labels that fell last and that the best one of their island does not
        beat by walking: no route is better for going on from another."""
        at = labels.join(arrival, "portal")
        top = at.groupBy("source", "via").agg(F.min(F.struct("g", *[F.col(f"e{k}").alias(f"h{k}") for k in "xyz"])).alias("top"))
        near = at.where("fresh").join(top, ["source", "via"]).select(*at.columns, F.col("top.g").alias("least"), "top.hx", "top.hy", "top.hz")
        return near.where(F.col("g") <= F.col("least") + distance("h", "e") + 1e-9).select("source", "via", "g", "edges", "ex", "ey", "ez")

    want = asked.where("start_island <> end_island").groupBy("source").agg(F.count("*").alias("want"))
    while now.where("fresh").head(1):
        limit = goals(now).groupBy("source").agg(F.max("best.total").alias("limit"), F.count("*").alias("got")).join(want, "source")
        grown = leading(now).join(limit, "source", "left").where("got IS NULL OR got < want OR g < limit").withColumnRenamed("g", "before")
        grown = for_route(grown.select("source", F.col("via").alias("from_island"), "before", "edges", "ex", "ey", "ez").join(hop, "from_island")).select(
            "source", "portal", F.struct((F.col("before") + distance("e", "s") + F.col("cost")).alias("g"), F.concat("edges", F.array("edge_index")).alias("edges")).alias("x")
        )
        best = grown.groupBy("source", "portal").agg(F.min("x").alias("x"))
        better = F.coalesce(F.col("x.g") < F.col("g"), F.col("g").isNull())
        after = now.select("source", "portal", "g", "edges").join(best, ["source", "portal"], "full").select(
            "source",
            "portal",
            F.when(better, F.col("x.g")).otherwise(F.col("g")).alias("g"),
            F.when(better, F.col("x.edges")).otherwise(F.col("edges")).alias("edges"),
            better.alias("fresh"),
        )
        after = store(after, "routes")
        drop(now)
        now = after
    return goals(now).select("request_id", "best")


@dataclass(frozen=True)
class Limits:
    """0: no limit."""

    expanded: int = 0
    queued: int = 0


class _Elsewhere(Exception):
    """A search came to an island whose region is not at hand."""

    def __init__(self, region: int):
        super().__init__(region)
        self.region = region


class Router:
    """A* over the portals (traversals) of a graph, or of some of its regions, held
    in memory.

    ``links``: dictionaries, or a frame with ``to_region``: the region of an island
    that can be left, else -1.  ``islands`` are those known, if any may be unknown.
    """

    def __init__(self, links: list[dict] | pd.DataFrame, islands: set[int] | None = None):
        if not isinstance(links, pd.DataFrame):
            flat = [(k["edge_index"], k["from_island"], k["to_island"], *k["s"], *k["t"], k["cost"]) for k in links]
            links = pd.DataFrame(flat, columns=["edge_index", "from_island", "to_island", "sx", "sy", "sz", "tx", "ty", "tz", "cost"])
        rows = links.sort_values(["from_island", "edge_index"])
        self.islands = islands
        self.number, self.to, self.cost = (rows[c].to_numpy() for c in ("edge_index", "to_island", "cost"))
        self.s, self.t = (rows[[f"{p}{k}" for k in "xyz"]].to_numpy(np.float64) for p in "st")
        own, first, count = np.unique(rows["from_island"].to_numpy(), return_index=True, return_counts=True)
        self.leaving = {int(i): (int(a), int(a + n)) for i, a, n in zip(own, first, count, strict=True)}
        self.to_region = rows["to_region"].to_numpy() if "to_region" in rows else np.full(len(rows), -1)

    def route(self, start: int, end: int, a: tuple, b: tuple, limits: Limits = Limits(), heuristic: Callable | None = None, cancelled: Callable | None = None) -> dict:
        """One request: status, cost, edges, islands and the counters."""
        stats = {"expanded": 0, "queued": 0, "peak_open": 0}

        def answer(status: str, cost: float = 0.0, portals: tuple = ()) -> dict:
            seen = [start, *[int(self.to[n]) for n in portals]] if portals else []
            return {"status": status, "cost": cost, "edges": [int(self.number[n]) for n in portals], "islands": seen} | stats

        if self.islands is not None and (start not in self.islands or end not in self.islands):
            return answer("invalid_island")
        if start == end:
            return answer("same_island")
        best, back = np.full(len(self.to), inf), {}
        open_: list[tuple[float, float, int]] = []
        to_goal = np.asarray(b, np.float64)

        def guesses(at: np.ndarray) -> list[float]:
            if heuristic is None:
                return [0.0] * len(at)
            if heuristic is dist:
                return _far(at, to_goal).tolist()
            return [max(0.0, heuristic(tuple(p), b)) for p in at.tolist()]

        def push(g: float, guess: float, n: int) -> None:
            heapq.heappush(open_, (g + guess, g, n))
            stats["queued"] += 1
            stats["peak_open"] = max(stats["peak_open"], len(open_))

        first, after = self.leaving.get(start, (0, 0))
        reach = _far(np.asarray(a, np.float64), self.s[first:after]) + self.cost[first:after]
        best[first:after] = reach
        for n, (g, guess) in enumerate(zip(reach.tolist(), guesses(self.t[first:after]), strict=True), first):
            if limits.queued and stats["queued"] >= limits.queued:
                return answer("budget_exceeded")
            push(g, guess, n)
        goal, last = inf, None
        gone: dict[int, list[tuple[float, list]]] = {}
        while open_:
            if cancelled and cancelled():
                return answer("cancelled")
            if limits.expanded and stats["expanded"] >= limits.expanded:
                return answer("budget_exceeded")
            _, g, n = heapq.heappop(open_)
            if g > best[n]:
                continue
            stats["expanded"] += 1
            at, island = self.t[n].tolist(), int(self.to[n])
            if island == end and g + dist(at, b) < goal:
                goal, last = g + dist(at, b), n
            if g >= goal:
                continue
            # what was extended from nearer by has reached all that this would, for less
            others = gone.setdefault(island, [])
            if any(h + dist(p, at) + 1e-9 < g for h, p in others):
                continue
            if island not in self.leaving:
                if self.to_region[n] >= 0:
                    raise _Elsewhere(int(self.to_region[n]))
                continue
            others.append((g, at))
            first, after = self.leaving[island]
            reach = g + _far(self.t[n], self.s[first:after]) + self.cost[first:after]
            less = np.flatnonzero((reach < best[first:after]) & (reach < goal))
            best[first + less] = reach[less]
            for m, h, guess in zip((first + less).tolist(), reach[less].tolist(), guesses(self.t[first + less]), strict=True):
                back[m] = n
                push(h, guess, m)
                if limits.queued and stats["queued"] > limits.queued:
                    return answer("budget_exceeded")
        if last is None or not isfinite(goal):
            return answer("no_path")
        path = [last]
        while path[-1] in back:
            path.append(back[path[-1]])
        return answer("success", goal, tuple(path[::-1]))


def _searched_together(requests: DataFrame, links: DataFrame, islands: DataFrame) -> DataFrame:
    """``request_id, status, cost`` as the searches give them, islands that are not known told apart."""
    known = islands.select("id").distinct()
    judged = requests
    for side in ("start", "end"):
        judged = judged.join(known.select(F.col("id").alias(f"{side}_island"), F.lit(True).alias(f"{side}_known")), f"{side}_island", "left")
    judged = store(judged.withColumn("known", F.col("start_known").isNotNull() & F.col("end_known").isNotNull()).drop("start_known", "end_known"), "judged")
    routes = best_routes(judged.where("known"), links, edges=False)
    none = F.lit(0.0).alias("cost")
    return routes.select("request_id", "status", F.coalesce("cost", none).alias("cost")).unionByName(judged.where("NOT known").select("request_id", F.lit("invalid_island").alias("status"), none))


#: Requests that a task searches with the same regions at hand.
TOGETHER = 64


def search_routes(
    requests: DataFrame, links: DataFrame, islands: DataFrame, limits: Limits = Limits(), euclid: bool = True, heuristic: Callable | None = None, cancelled: Callable | None = None, counters: bool = True
) -> DataFrame:
    """One A* search per request; ``links`` are priced traversals.  ``euclid``
    guides the search by straight lines, right for the default cost; a custom
    cost needs it off, or a ``heuristic(point, goal)`` of its own.  ``cancelled()``
    is asked in the workers before every expansion; both must be picklable.

    Some ``TOGETHER`` requests whose ends are in the same regions are one task's.  It
    has these regions' traversals; a search that comes to another region is made
    again in the next round, with all regions around those at hand.  So a task
    holds, besides a search's own labels, the regions that its searches come to and
    those next to them, and the driver holds none.

    Without ``counters``, which leaves nothing to tell searches apart, the rows are
    ``request_id, status, cost`` and all requests of a start share their labels, as in
    :func:`best_routes`.  Limits, a ``heuristic`` and ``cancelled`` need a search each.
    """
    if not counters:
        if limits != Limits() or heuristic or cancelled:
            raise ValueError("limits, heuristics and cancellation go with a search for each request")
        return _searched_together(requests, links, islands)
    guess = heuristic or (dist if euclid else None)
    places = [f"{p}{k}" for p in "st" for k in "xyz"]
    names = [f.split(" ")[0] for f in RESULT.split(", ")]
    where = regions(links, REGION)
    hop = written(links.select("edge_index", "from_island", "to_island", *places, F.col("cost").cast("double").alias("cost")).join(where.select(F.col("id").alias("from_island"), "region"), "from_island"), "portals")
    leaving = store(hop.select(F.col("from_island").alias("id"), "region").distinct(), "left")
    region_of = lambda side: leaving.select(F.col("id").alias(f"{side}_island"), F.col("region").alias(f"{side}_region"))
    hop_to = written(hop.join(region_of("to"), "to_island", "left").withColumn("to_region", F.coalesce("to_region", F.lit(-1).cast("long"))), "portals")
    drop(hop)
    asked = store(requests.select("request_id", "start_island", "end_island", *[f"{p}{k}" for p in "ab" for k in "xyz"]).withColumn("n", F.monotonically_increasing_id()), "requests")
    known = islands.select("id").distinct()
    judged = asked
    for side in ("start", "end"):
        judged = judged.join(known.select(F.col("id").alias(f"{side}_island"), F.lit(True).alias(f"{side}_known")), f"{side}_island", "left").join(region_of(side), f"{side}_island", "left")
    status = F.when(F.col("start_known").isNull() | F.col("end_known").isNull(), "invalid_island").when(F.col("start_island") == F.col("end_island"), "same_island").when(F.col("start_region").isNull(), "no_path")
    judged = store(judged.withColumn("status", status), "judged")
    none = {"cost": F.lit(0.0), "edges": F.array().cast("array<int>"), "islands": F.array().cast("array<long>")} | {c: F.lit(0).cast("long") for c in names[5:]}
    found = judged.where("status IS NOT NULL").select("n", "status", *[none[c].alias(c) for c in names[2:]])
    ends = ["start_region", "end_region"]
    alike = judged.where("status IS NULL").groupBy(*ends).agg(F.count("*").alias("many"))
    # ends without a region are alike too; where hashes meet, requests only share more
    part = F.expr(f"pmod(xxhash64(n), 1 + many div {TOGETHER})")
    todo = judged.where("status IS NULL").join(alike.withColumnsRenamed({c: f"{c}_" for c in ends}), F.expr(" AND ".join(f"{c} <=> {c}_" for c in ends)))
    todo = written(todo.select(*asked.columns, *ends, F.xxhash64(*ends, part).alias("batch")), "open")
    needed = written(todo.select("batch", F.explode(F.array(*ends)).alias("region")).where("region IS NOT NULL").distinct(), "needed")

    def run(held: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            router, here = Router(ground), set(ground["region"].tolist())
            around = set(ground["to_region"].unique().tolist()) - here - {-1}
        for r in held.itertuples():
            try:
                got = router.route(r.start_island, r.end_island, (r.ax, r.ay, r.az), (r.bx, r.by, r.bz), limits, guess, cancelled)
                out.append((r.n, r.batch, None, *[got[c] for c in names[1:]]))
            except _Elsewhere as e:
                out.append((r.n, r.batch, sorted(around | {e.region}), *[None] * (len(names) - 1)))
        rows = pd.DataFrame(out, columns=["n", "batch", "need", *names[1:]])
        return rows.astype({"cost": "float64"} | {c: "Int64" for c in names[5:]})

    while todo.head(1):
        tasks = todo.select("batch").distinct().count()
        ground = hop_to.join(needed, "region").repartition(tasks, "batch")
        made = todo.repartition(tasks, "batch").groupBy("batch").cogroup(ground.groupBy("batch")).applyInPandas(run, "n long, batch long, need array<long>, " + RESULT.split(", ", 1)[1])
        made = written(made, "searched")
        found = found.unionByName(made.where("status IS NOT NULL").select(*found.columns))
        unmade = made.where("status IS NULL")
        after = written(todo.join(unmade.select("n"), "n", "left_semi"), "open")
        more = written(needed.unionByName(unmade.select("batch", F.explode("need").alias("region"))).distinct().join(after.select("batch").distinct(), "batch", "left_semi"), "needed")
        for old in (todo, needed):
            drop(old)
        todo, needed = after, more
    return asked.join(found, "n").select(*names)
