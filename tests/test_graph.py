import random
import struct

import pytest
from helpers import graph
from pyspark.sql import functions as F

from archipelago.operators.graph import can_traverse_from, connects_island, health, other_island, traversals, weak_components
from archipelago.operators.paths import Limits, Router, best_routes, priced, search_routes
from archipelago.sources.graphfile import GraphFileError, GraphFileSource, ReadLimits, decode, encode, graph_bytes, read_graph, write_graph


@pytest.fixture(scope="module")
def g1(spark):
    return graph(spark, [10, 10, 10, 2], [0.1, 0.8, 0.9, 0.05], [(0, 1, (0, 0, 0), (1, 0, 0), True, False), (1, 2, (1, 0, 0), (2, 0, 0), True, True)])


def test_health(g1):
    h = health(g1)
    assert (h["components"], h["largest_islands"], h["largest_polygons"], round(h["largest_mass"], 6)) == (3, 2, 20, 1.7)
    assert (h["isolated_islands"], h["isolated_polygons"], round(h["isolated_mass"], 6), round(h["total_mass"], 6)) == (1, 2, 0.05, 1.85)
    low, _, high = h["mass_buckets"]
    assert (low["islands"], low["isolated"], low["links_out"], low["links_in"], low["p95_out"]) == (2, 1, 1, 0, 0)
    assert (high["islands"], high["links_out"], high["links_in"], high["p95_out"]) == (2, 2, 3, 1)
    assert (h["with_outgoing"], h["with_incoming"], h["average_link_length"]) == (3, 2, 1.0)
    assert weak_components(g1).select("component").distinct().count() == 2


def test_edge_predicates(g1):
    rows = g1.edges.orderBy("edge_index").select(connects_island(F.lit(0)), can_traverse_from(F.lit(1)), other_island(F.lit(1)), other_island(F.lit(9))).collect()
    assert [tuple(r) for r in rows] == [(True, False, 0, None), (False, True, 2, None)]
    back = traversals(g1.edges).where("from_island = 2").first()
    assert (back["to_island"], back["sx"], back["tx"]) == (1, 2.0, 1.0)


def test_lookups(spark, g1):
    refs = spark.createDataFrame([(1,), (2,), (31,), (999,)], "poly_ref bigint")
    assert {tuple(r) for r in g1.island_of(refs).collect()} == {(1, 0), (2, 0), (31, 3)}
    assert g1.island(spark.createDataFrame([(2,), (9,)], "id bigint")).count() == 1
    assert {r["id"]: r["edge_indices"] for r in g1.adjacency().collect()} == {0: [0], 1: [0, 1], 2: [1]}


@pytest.fixture(scope="module")
def r1(spark):
    return graph(spark, [1, 1, 1], [0, 0, 0], [(0, 2, (0, 0, 0), (100, 0, 0), True, False), (0, 1, (0, 0, 0), (1, 0, 0), True, False), (1, 2, (2, 0, 0), (3, 0, 0), True, False)])


def asks(spark, rows):
    return spark.createDataFrame([(k, a, b, *map(float, p), *map(float, q)) for k, (a, b, p, q) in enumerate(rows)], "request_id bigint, start_island bigint, end_island bigint, ax double, ay double, az double, bx double, by double, bz double")


def test_routes_both_forms(spark, r1):
    ask = asks(spark, [(0, 2, (0, 0, 0), (3, 0, 0)), (1, 1, (0, 0, 0), (1, 0, 0)), (2, 0, (0, 0, 0), (1, 0, 0))])
    links = priced(traversals(r1.edges))
    one = {r["request_id"]: (r["status"], r["cost"], r["edges"]) for r in best_routes(ask, links).collect()}
    two = {r["request_id"]: (r["status"], r["cost"], r["edges"]) for r in search_routes(ask, links, r1.islands).collect()}
    assert one[0] == two[0] == ("success", 3.0, [1, 2])
    assert one[1][0] == two[1][0] == "same_island" and one[2][0] == two[2][0] == "no_path"
    kept = priced(traversals(r1.edges), keep=F.col("to_island") != 1)
    assert [r["edges"] for r in best_routes(ask.where("request_id = 0"), kept).collect()] == [[0]]
    none = priced(traversals(r1.edges), cost=F.lit(float("nan")))
    assert best_routes(ask.where("request_id = 0"), none).first()["status"] == "no_path"


def test_custom_cost(spark):
    g = graph(spark, [1] * 4, [0] * 4, [(0, 2, (0, 0, 0), (10, 0, 0), True, False), (0, 1, (0, 0, 0), (1, 0, 0), True, False), (1, 2, (1, 0, 0), (2, 0, 0), True, False), (2, 3, (2, 0, 0), (3, 0, 0), True, False)])
    links = priced(traversals(g.edges), cost=F.col("horizontal"))
    ask = asks(spark, [(0, 3, (0, 0, 0), (3, 0, 0))])
    assert tuple(best_routes(ask, links).select("cost", F.size("edges")).first()) == (3.0, 3)
    assert tuple(search_routes(ask, links, g.islands, euclid=False).select("cost", F.size("edges")).first()) == (3.0, 3)


def test_route_context(spark, r1):
    """Filters and costs see the route's ends and the link, at every hop."""
    ask = asks(spark, [(0, 2, (0, 0, 0), (3, 0, 0)), (0, 1, (0, 0, 0), (1, 0, 0)), (1, 2, (1, 0, 0), (3, 0, 0))])
    links = traversals(r1.edges)
    paths = lambda **how: {r["request_id"]: (r["status"], r["edges"]) for r in best_routes(ask, links, **how).collect()}
    ends = F.struct("start_island", "end_island")
    assert paths(keep=ends == F.struct(F.lit(0).alias("start_island"), F.lit(2).alias("end_island"))) == {0: ("success", [1, 2]), 1: ("no_path", None), 2: ("no_path", None)}
    assert paths(keep=F.col("to_island") == F.col("end_island")) == {0: ("success", [0]), 1: ("success", [1]), 2: ("success", [2])}
    dear = F.when((F.col("start_island") == 0) & (F.col("to_island") != F.col("end_island")), 1000.0).otherwise(F.col("horizontal"))
    assert paths(cost=dear) == {0: ("success", [0]), 1: ("success", [1]), 2: ("success", [2])}
    assert paths(cost=F.when(F.col("end_island") == 1, float("nan")).otherwise(1.0))[1] == ("no_path", None)


@pytest.mark.parametrize("seed", range(3))
def test_routes_equal_a_search_of_each(spark, seed):
    """Random links, an island that most of them share, and filters by the ends."""
    rng = random.Random(seed)
    spot = lambda: tuple(float(rng.randrange(40)) for _ in "xyz")
    pairs = [rng.choice([(0, rng.randrange(1, 9)), (rng.randrange(1, 9), 0), tuple(rng.sample(range(9), 2))]) for _ in range(70)]
    g = graph(spark, [1] * 9, [0] * 9, [(a, b, spot(), spot(), True, False) for a, b in pairs])
    links = priced(traversals(g.edges))
    ask = asks(spark, [(a, b, spot(), spot()) for a in range(3) for b in range(9)])
    held = [{"edge_index": r["edge_index"], "from_island": r["from_island"], "to_island": r["to_island"], "cost": r["cost"], "s": (r["sx"], r["sy"], r["sz"]), "t": (r["tx"], r["ty"], r["tz"])} for r in links.collect()]
    for context in (False, True):
        keep = (F.col("edge_index") % 3 != F.col("end_island") % 3) | (F.col("from_island") == F.col("start_island"))
        found = {r["request_id"]: r for r in best_routes(ask, links, keep=keep if context else None).collect()}
        for r in ask.collect():
            mine = [h for h in held if not context or h["edge_index"] % 3 != r["end_island"] % 3 or h["from_island"] == r["start_island"]]
            want = Router(mine, set(range(9))).route(r["start_island"], r["end_island"], (r["ax"], r["ay"], r["az"]), (r["bx"], r["by"], r["bz"]))
            got = found[r["request_id"]]
            assert got["status"] == want["status"]
            if want["status"] == "success":
                assert got["cost"] == pytest.approx(want["cost"]) and got["edges"] == want["edges"]


def test_rounds_read_the_regions_they_search(spark, monkeypatch):
    """Costs alone, along a chain of regions: as with edges, from labels that do not grow
    with their routes, and traversals that lie by regions."""
    from archipelago.operators import paths

    n = 40
    g = graph(spark, [1] * n, [0.5] * n, [(k, k + 1, (3 * k + 1, 0, 0), (3 * k + 2, 0, 0), True, True) for k in range(n - 1)])
    links = priced(traversals(g.edges))
    ask = spark.createDataFrame([(k, 0, k, 0.0, 0.0, 0.0, 3.0 * k, 0.0, 0.0) for k in (0, 1, 25, n - 1)], "request_id long, start_island long, end_island long, ax double, ay double, az double, bx double, by double, bz double")
    monkeypatch.setattr(paths, "REGION", 10)
    seen, kept, put = [], paths.store, paths.written
    monkeypatch.setattr(paths, "written", lambda df, name, **k: seen.append((name, k)) or put(df, name, **k))

    def watched(df, name):
        out = kept(df, name)
        if name == "passed":
            assert out.where("size(edges) > 0").count() == 0
        return out

    full = {r["request_id"]: (r["status"], r["cost"]) for r in best_routes(ask, links).collect()}
    monkeypatch.setattr(paths, "store", watched)
    rows = best_routes(ask, links, edges=False)
    assert rows.columns == ["request_id", "status", "cost"]
    assert {r["request_id"]: (r["status"], r["cost"]) for r in rows.collect()} == full
    assert full[n - 1] == ("success", 3.0 * (n - 1))
    assert ("portals", {"by": "region"}) in seen


def test_rounds_of_routes_follow_regions(spark, monkeypatch):
    """A long chain takes few rounds, and regions of any size give the routes of the search."""
    from archipelago.operators import paths

    n, rnd = 40, random.Random(5)
    spot = lambda k: (float(k), 0.0, rnd.random())
    rows = [(k, k + 1, spot(k), spot(k + 0.5), True, k % 3 == 0) for k in range(n - 1)]
    rows += [(k, (k + 7) % n, spot(k), spot(k), True, True) for k in range(0, n, 5)]
    g = graph(spark, [1] * n, [0] * n, rows)
    links = priced(traversals(g.edges), cost=F.col("horizontal") + F.col("edge_index") % 4)
    ask = asks(spark, [(0, k, (0, 0, 0), (k, 0, 1)) for k in range(1, n)] + [(20, k, (20, 0, 0), (k, 0, 0)) for k in (3, 30)])
    held = [{"edge_index": r["edge_index"], "from_island": r["from_island"], "to_island": r["to_island"], "cost": r["cost"], "s": (r["sx"], r["sy"], r["sz"]), "t": (r["tx"], r["ty"], r["tz"])} for r in links.collect()]
    router, kept = Router(held, set(range(n))), paths.store
    for size, most in ((paths.REGION, 3), (25, 20)):
        stored = []
        monkeypatch.setattr(paths, "REGION", size)
        monkeypatch.setattr(paths, "store", lambda df, name, stored=stored: stored.append(name) or kept(df, name))
        found = {r["request_id"]: r for r in best_routes(ask, links).collect()}
        assert stored.count("routes") <= most
        for r in ask.collect():
            want, got = router.route(r["start_island"], r["end_island"], (r["ax"], r["ay"], r["az"]), (r["bx"], r["by"], r["bz"])), found[r["request_id"]]
            assert got["status"] == want["status"] == "success"
            assert got["cost"] == pytest.approx(want["cost"]) and got["edges"] == want["edges"]


def test_budgets_and_cancel(r1):
    rows = priced(traversals(r1.edges)).collect()
    held = [{"edge_index": r["edge_index"], "from_island": r["from_island"], "to_island": r["to_island"], "cost": r["cost"], "s": (r["sx"], r["sy"], r["sz"]), "t": (r["tx"], r["ty"], r["tz"])} for r in rows]
    router = Router(held, {0, 1, 2})
    go = lambda **k: router.route(0, 2, (0, 0, 0), (3, 0, 0), **k)
    assert router.route(9, 2, (0, 0, 0), (0, 0, 0))["status"] == "invalid_island"
    out = go(limits=Limits(expanded=1))
    assert (out["status"], out["expanded"]) == ("budget_exceeded", 1)
    assert go(limits=Limits(queued=1))["status"] == "budget_exceeded"
    assert go(cancelled=lambda: True)["status"] == "cancelled"
    assert go()["islands"] == [0, 1, 2]


def box(n, refs, edges, mass=0.5):
    return {"id": n, **{f"{p}_{k}": float(v) for p, v in (("center", 1), ("min", 0), ("max", 2)) for k in "xyz"}, "mass_score": mass, "suppressed": False, "polygons": refs, "edge_indices": edges}


def edge(n, a, b, far=1.0, rise=0.0, ab=True, ba=False, end=1.0):
    return {"edge_index": n, "island_a": a, "island_b": b, "ax": 0.0, "ay": 0.0, "az": 0.0, "bx": end, "by": rise, "bz": 0.0, "horizontal": far, "vertical_delta_ab": rise, "trav_ab": ab, "trav_ba": ba}


def sample(**change):
    isl = [box(0, [1, 2], [0]), box(1, [3], [0, 1]), box(2, [4], [1])]
    edges = [edge(0, 0, 1), edge(1, 1, 2)]
    return isl, edges


def test_file_round_trip():
    isl, edges = sample()
    data = encode(isl, edges)
    assert decode(data + b"trailing") == (isl, edges)
    assert struct.unpack_from("<4I", data) == (0x31474944, 4, 3, 2)
    assert len(encode(isl, edges[:1])) == len(data) - 42


@pytest.mark.parametrize(
    "status,change",
    [
        ("malformed_data", lambda d: d[:7]), ("invalid_magic", lambda d: b"\0" + d[1:]),
        ("unsupported_version", lambda d: d[:4] + struct.pack("<I", 5) + d[8:]), ("unsupported_version", lambda d: d[:4] + struct.pack("<I", 2) + d[8:]),
        ("malformed_data", lambda d: d[:56] + b"\2" + d[57:]), ("malformed_data", lambda d: d[:-3]),
    ],
)
def test_broken_bytes(status, change):
    with pytest.raises(GraphFileError) as error:
        decode(change(encode(*sample())))
    assert error.value.status == status


@pytest.mark.parametrize(
    "change",
    [
        lambda i, e: i[1]["polygons"].append(1), lambda i, e: i[0].update(center_x=float("nan")), lambda i, e: e[0].update(bx=float("inf")),
        lambda i, e: e[0].update(horizontal=-1.0), lambda i, e: e[0].update(vertical_delta_ab=10.0), lambda i, e: e[0].update(island_b=0),
        lambda i, e: e[0].update(trav_ab=False), lambda i, e: i[0].update(polygons=[0]), lambda i, e: i[0].update(min_x=3.0), lambda i, e: i[1].update(edge_indices=[]),
        lambda i, e: i[1].update(mass_score=1.5), lambda i, e: i[1].update(id=7),
    ],
)
def test_inconsistent_content(change):
    isl, edges = sample()
    change(isl, edges)
    with pytest.raises(GraphFileError):
        decode(encode(isl, edges))


def test_limits():
    data = encode(*sample())
    for limits in (ReadLimits(islands=2), ReadLimits(elements=1), ReadLimits(allocation=100)):
        with pytest.raises(GraphFileError):
            decode(data, limits)


def test_spark_source_and_sink(spark, r1, tmp_path):
    isl = r1.islands.select("id", *[F.lit(float(v)).alias(f"{p}_{k}") for p, v in (("center", 1), ("min", 0), ("max", 2)) for k in "xyz"], "mass_score", "suppressed")
    path = f"file://{tmp_path}/graph.bin"
    write_graph(path, isl, r1.edges, r1.polygon_island)
    back, edges = read_graph(spark, path)
    assert back.count() == 3 and sorted(map(tuple, edges.collect())) == sorted(map(tuple, r1.edges.select(*edges.columns).collect()))
    spark.dataSource.register(GraphFileSource)
    rows = spark.read.format("islandgraph").option("table", "edges").load(path)
    assert rows.count() == 3 and spark.read.format("islandgraph").load(path).select(F.explode("polygons")).count() == 3
    assert graph_bytes(isl, r1.edges, r1.polygon_island) == open(f"{tmp_path}/graph.bin", "rb").read()


def test_graph_file_never_brings_the_graph_to_the_driver(spark, r1, tmp_path, monkeypatch):
    """Neither writing nor reading collects rows; a file is written chunk by chunk."""
    from pyspark.sql.classic.dataframe import DataFrame

    from archipelago.sources import graphfile

    isl = r1.islands.select("id", *[F.lit(float(v)).alias(f"{p}_{k}") for p, v in (("center", 1), ("min", 0), ("max", 2)) for k in "xyz"], "mass_score", "suppressed")
    whole = graph_bytes(isl, r1.edges, r1.polygon_island)
    monkeypatch.setattr(graphfile, "CHUNK", 64)
    parts = list(graphfile.graph_chunks(isl, r1.edges, r1.polygon_island))
    assert b"".join(parts) == whole and len(parts) > 3
    collected = []
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(self) or [])
    monkeypatch.setattr(DataFrame, "first", lambda self: collected.append(self))
    path = f"file://{tmp_path}/graph.bin"
    write_graph(path, isl, r1.edges, r1.polygon_island)
    back, edges = read_graph(spark, path)
    monkeypatch.undo()
    assert not collected and open(f"{tmp_path}/graph.bin", "rb").read() == whole
    assert (back.count(), edges.count()) == (3, 3)
    with open(f"{tmp_path}/bad.bin", "wb") as file:
        file.write(whole[:-1])
    with pytest.raises(Exception, match="malformed_data"):
        read_graph(spark, f"file://{tmp_path}/bad.bin")[1].collect()


def test_routes_whose_last_link_may_climb_share_their_labels(spark, monkeypatch):
    """As by a filter that sees each route's end, but in rounds over regions for all requests of a start."""
    from archipelago.operators import paths

    rng = random.Random(11)
    spot = lambda: tuple(float(rng.randrange(30)) for _ in "xyz")
    g = graph(spark, [1] * 12, [0] * 12, [(*rng.sample(range(11), 2), spot(), spot(), True, False) for _ in range(60)] + [(0, 11, spot(), spot(), True, False)])
    links = traversals(g.edges)
    # from island 11 only climbing links lead on, if any do
    ask = asks(spark, [(a, b, spot(), spot()) for a in (0, 3, 11) for b in range(12)])
    climb = (F.col("vertical") <= 0) | (F.col("to_island") == F.col("end_island"))
    want = {r["request_id"]: r for r in best_routes(ask, links, keep=climb).collect()}
    monkeypatch.setattr(paths, "_by_joins", None)
    for size in (paths.REGION, 15):
        monkeypatch.setattr(paths, "REGION", size)
        found = {r["request_id"]: r for r in best_routes(ask, priced(links, keep=F.col("vertical") <= 0), last=priced(links)).collect()}
        assert found.keys() == want.keys() and {r["status"] for r in want.values()} == {"success", "no_path", "same_island"}
        for k, r in want.items():
            assert (found[k]["status"], found[k]["edges"]) == (r["status"], r["edges"]) and found[k]["cost"] == pytest.approx(r["cost"])


@pytest.mark.parametrize("limits", [Limits(), Limits(expanded=9), Limits(queued=30)])
def test_search_goes_by_regions_and_not_through_the_driver(spark, monkeypatch, limits):
    """The driver collects no traversals; regions and batches of any size give each search's own result and counters."""
    from pyspark.sql.classic.dataframe import DataFrame

    from archipelago.operators import paths

    rng = random.Random(3)
    spot = lambda k: (float(k) + rng.random(), rng.random(), rng.random())
    g = graph(spark, [1] * 30, [0] * 30, [(k, k + d, spot(k), spot(k + d), True, k % 4 == 0) for k in range(27) for d in (1, 2, 2) if k + d < 28])
    links = priced(traversals(g.edges))
    ask = asks(spark, [(a, b, spot(a), spot(b)) for a, b in [(0, 27), (0, 3), (5, 5), (27, 1), (13, 20), (29, 0), (0, 29), (0, 99)]])
    held = [{"edge_index": r["edge_index"], "from_island": r["from_island"], "to_island": r["to_island"], "cost": r["cost"], "s": (r["sx"], r["sy"], r["sz"]), "t": (r["tx"], r["ty"], r["tz"])} for r in links.collect()]
    router = Router(held, set(range(30)))
    want = [router.route(r["start_island"], r["end_island"], (r["ax"], r["ay"], r["az"]), (r["bx"], r["by"], r["bz"]), limits, paths.dist) | {"request_id": r["request_id"]} for r in ask.orderBy("request_id").collect()]
    monkeypatch.setattr(paths, "REGION", 20)
    monkeypatch.setattr(paths, "TOGETHER", 2)
    collect, rows = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda self: rows.append(collect(self)) or rows[-1])
    found = search_routes(ask, links, g.islands, limits)
    monkeypatch.setattr(DataFrame, "collect", collect)
    assert max(map(len, rows)) <= 1
    got = [r.asDict() for r in found.orderBy("request_id").collect()]
    assert [{k: v for k, v in r.items() if k != "cost"} for r in got] == [{k: v for k, v in r.items() if k != "cost"} for r in want]
    assert [r["cost"] for r in got] == pytest.approx([r["cost"] for r in want])


def test_search_without_counters_shares_labels(spark, monkeypatch):
    """Status and cost of each search, without a search for each."""
    from archipelago.operators import paths

    rng = random.Random(4)
    spot = lambda k: (float(k) + rng.random(), rng.random(), rng.random())
    g = graph(spark, [1] * 14, [0] * 14, [(k, k + d, spot(k), spot(k + d), True, k % 4 == 0) for k in range(11) for d in (1, 2) if k + d < 12])
    links = priced(traversals(g.edges))
    ask = asks(spark, [(a, b, spot(a), spot(b)) for a, b in [(0, 11), (0, 3), (5, 5), (11, 1), (13, 0), (0, 13), (0, 99), (99, 99)]])
    want = {r["request_id"]: (r["status"], pytest.approx(r["cost"])) for r in search_routes(ask, links, g.islands).collect()}
    monkeypatch.setattr(paths.Router, "route", None)
    found = search_routes(ask, links, g.islands, counters=False)
    assert found.columns == ["request_id", "status", "cost"]
    assert {r["request_id"]: (r["status"], r["cost"]) for r in found.collect()} == want
    with pytest.raises(ValueError):
        search_routes(ask, links, g.islands, Limits(expanded=1), counters=False)
