"""Small meshes, link sets and graphs, and the pruning as a plain loop."""

from collections import defaultdict

from archipelago.operators.graph import Graph
from archipelago.sources.mesh import POLY_EDGES, POLYGONS, Mesh

ISLANDS = "id bigint, polygon_count bigint, mass_score double, suppressed boolean, outbound boolean"
LINKS = "from_island bigint, to_island bigint, sx double, sy double, sz double, tx double, ty double, tz double, horizontal double, vertical double"
EDGES = "edge_index int, island_a bigint, island_b bigint, ax double, ay double, az double, bx double, by double, bz double, horizontal double, vertical_delta_ab double, trav_ab boolean, trav_ba boolean"


def square(x, z, y, side=2.0):
    return [(float(x), float(y), float(z)), (x + side, float(y), float(z)), (x + side, float(y), z + side), (float(x), float(y), z + side)]


def mesh(spark, squares, joins=(), flags=None):
    """``joins``: (polygon, edge, neighbour), one direction each."""
    n = len(squares)
    across = {(p, e): q for p, e, q in joins}
    polygons = [(k + 1, k, (flags or [1] * n)[k], True, s) for k, s in enumerate(squares)]
    edges = [(k + 1, e, across[k, e] + 1 if (k, e) in across else None) for k in range(n) for e in range(4)]
    return Mesh(spark.createDataFrame(polygons, POLYGONS), spark.createDataFrame(edges, POLY_EDGES))


def islands(spark, masses, suppressed=(), outbound=None):
    rows = [(k, 1, float(m), k in suppressed, k not in suppressed and (outbound is None or k in outbound)) for k, m in enumerate(masses)]
    return spark.createDataFrame(rows, ISLANDS)


def links(spark, rows):
    """``rows``: (from, to, start, end)."""
    made = []
    for a, b, s, t in rows:
        made.append((a, b, *map(float, s), *map(float, t), ((s[0] - t[0]) ** 2 + (s[2] - t[2]) ** 2) ** 0.5, float(t[1] - s[1])))
    return spark.createDataFrame(made, LINKS)


def graph(spark, counts, masses, rows):
    """``rows``: (a, b, point a, point b, open a->b, open b->a)."""
    made = [(k, a, b, *map(float, p), *map(float, q), ((p[0] - q[0]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5, float(q[1] - p[1]), ab, ba) for k, (a, b, p, q, ab, ba) in enumerate(rows)]
    facts = [(k, n, float(m), False, True) for k, (n, m) in enumerate(zip(counts, masses, strict=True))]
    owners = [(10 * k + j + 1, k) for k, n in enumerate(counts) for j in range(min(n, 2))]
    return Graph(spark.createDataFrame(facts, ISLANDS), spark.createDataFrame(made, EDGES), spark.createDataFrame(owners, "poly_ref bigint, island bigint"))


def greedy(rows, config, outbound: set[int], masses: dict[int, float]) -> tuple[dict[int, str], int]:
    """The one-by-one loop, over links in rank order: what became of each rank
    before the collapse (``kept``, or ``local``, ``global``, ``spanner``), and
    how often the reserve saved one."""
    d = config.density
    links = [(int(r["rank"]), int(r.from_island), int(r.to_island), (r.sx, r.sy, r.sz), (r.tx, r.ty, r.tz)) for _, r in rows.sort_values("rank").iterrows()]
    far2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    mass = lambda i: masses.get(i, 0.0) if config.mass.enabled else 0.0
    scale = lambda low, high, i: low + (high - low) * mass(i) if config.mass.enabled else 1.0
    saved, stay, fate = 0, [], {}
    targets: dict[int, set] = defaultdict(set)

    def wants(a: int, b: int) -> bool:
        return len(targets[a]) < d.reserve.budget(masses.get(a, 0.0), config.mass.enabled) and b not in targets[a]

    def take(a: int, b: int) -> None:
        if wants(a, b):
            targets[a].add(b)

    if d.local.enabled:
        lists: dict[int, list] = defaultdict(list)
        for link in links:
            _, a, b, s, t = link
            r = d.local.cell(config.extent) * scale(config.mass.low_radius_scale, config.mass.high_radius_scale, b)
            if any(far2(s, p) <= r * r and far2(t, q) <= r * r for p, q in lists[a]):
                if not wants(a, b):
                    fate[link[0]] = "local"
                    continue
                saved += 1
            stay.append(link)
            lists[a].append((s, t))
            take(a, b)
            if config.symmetric and b in outbound:
                lists[b].append((t, s))
                take(b, a)
    else:
        stay = links
    targets, hops, ends = defaultdict(set), defaultdict(list), []
    g = d.overall
    for rank, a, b, s, t in stay:
        if g.enabled:
            ra, rb = (g.cell(config.extent) * scale(g.low_radius_scale, g.high_radius_scale, i) for i in (a, b))
            if any(far2(s, p) <= ra * ra or far2(t, p) <= rb * rb for p in ends):
                fate[rank] = "global"
                continue
        if d.spanner.enabled:
            limit = d.spanner.path_ratio * far2(s, t) ** 0.5
            if any(m != b and f + h <= limit for m, f in hops[a] for n, h in hops[m] if n == b):
                if not wants(a, b):
                    fate[rank] = "spanner"
                    continue
                saved += 1
        fate[rank] = "kept"
        length = far2(s, t) ** 0.5
        hops[a].append((b, length))
        take(a, b)
        if config.symmetric and b in outbound:
            hops[b].append((a, length))
            take(b, a)
        ends += [s, t]
    return fate, saved


def loop_fates(ranked, facts, config):
    """What :func:`greedy` makes of ranked links: fates by rank, and links saved."""
    rows, known = ranked.toPandas(), facts.collect()
    return greedy(rows, config, {r["id"] for r in known if r["outbound"]}, {r["id"]: r["mass_score"] for r in known})
