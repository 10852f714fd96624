"""DuckDB SQL for the engine's queries, written from the definitions.

Each statement starts from ``part`` and shares no code with the Spark side.
"""

from __future__ import annotations

GRID = """
grid AS (
  SELECT p_partkey + 1 AS p, p_partkey AS ord, p_partkey // 40 AS r, p_partkey % 40 AS c, 1 << (p_size % 3) AS flags,
         4 * (((p_partkey // 40) // 10 + (p_partkey % 40) // 10) % 3) AS y
  FROM part WHERE p_size % 5 < 3),
side(n, dr, dc, sx, sz, ex, ez) AS (VALUES (0, -1, 0, 0, 0, 2, 0), (1, 0, 1, 2, 0, 2, 2), (2, 1, 0, 2, 2, 0, 2), (3, 0, -1, 0, 2, 0, 0)),
adj AS (SELECT a.p, b.p AS q, n FROM grid a, side JOIN grid b ON b.r = a.r + dr AND b.c = a.c + dc AND b.y = a.y),
reach(p, q) AS (SELECT p, p FROM grid UNION SELECT reach.p, adj.q FROM reach JOIN adj ON adj.p = reach.q),
isl AS (SELECT p, dense_rank() OVER (ORDER BY m) - 1 AS island FROM (SELECT p, min(q) AS m FROM reach GROUP BY p)),
islands AS (
  SELECT island AS id, count(*) AS polygon_count, avg(2e0 * c + 1) AS center_x, avg(y) AS center_y, avg(2e0 * r + 1) AS center_z,
         min(2e0 * c) AS min_x, min(1e0 * y) AS min_y, min(2e0 * r) AS min_z, max(2e0 * c + 2) AS max_x, max(1e0 * y) AS max_y, max(2e0 * r + 2) AS max_z,
         count(*) * greatest(max(2e0 * c + 2) - min(2e0 * c), max(2e0 * r + 2) - min(2e0 * r)) AS raw_mass
  FROM grid JOIN isl USING (p) GROUP BY island),
span AS (SELECT min(raw_mass) AS lo, quantile_cont(raw_mass, 0.99) AS hi FROM islands WHERE raw_mass > 0),
massy AS (SELECT islands.*, CASE WHEN ln(hi / lo) <= 0 THEN 1 ELSE least(1, greatest(0, ln(raw_mass / lo) / ln(hi / lo))) END AS mass_score FROM islands, span),
raw AS (
  SELECT island, p AS poly_ref, n AS edge_no, ord, 2e0 * c + sx AS sx, 1e0 * y AS sy, 2e0 * r + sz AS sz, 2e0 * c + ex AS ex, 1e0 * y AS ey, 2e0 * r + ez AS ez,
         2e0 * c + (sx + ex) / 2 AS mx, 1e0 * y AS my, 2e0 * r + (sz + ez) / 2 AS mz
  FROM grid JOIN isl USING (p), side WHERE NOT EXISTS (FROM adj WHERE adj.p = grid.p AND adj.n = side.n))"""

SEGMENT = ", ".join(f"CAST(round({p}{k} * 1000) AS BIGINT) AS {p}{k}_mm" for p in "se" for k in "xyz")
LINK_MM = ", ".join(f"CAST(round({x} * 1000) AS BIGINT) AS {x}_mm" for x in [*(f"{p}{k}" for p in "st" for k in "xyz"), "horizontal", "vertical"])
LINK = "from_island, to_island, sx, sy, sz, tx, ty, tz, horizontal, vertical"
LENGTH = "sqrt((sx-tx)*(sx-tx) + (sy-ty)*(sy-ty) + (sz-tz)*(sz-tz))"
ORDER = f"round({LENGTH} * 1000), from_island, to_island, sx, sy, sz, tx, ty, tz"


def voxels(names: str, cell: float) -> str:
    return ", ".join(f"floor(({n}) / {cell})" for n in names.split())


def scan(source: str, gap: float, rise: float, within: str = "vertical <= 4 AND vertical >= -6") -> str:
    """Links from the midpoints of ``source`` within the envelope."""
    return f"""
    SELECT poly_ref, edge_no, ord, near_ref, {LINK} FROM (
      SELECT *, sqrt((sx - tx) * (sx - tx) + (sz - tz) * (sz - tz)) AS horizontal, ty - sy AS vertical FROM (
        SELECT b.poly_ref, b.edge_no, b.ord, g.p AS near_ref, b.island AS from_island, t.island AS to_island, b.mx AS sx, b.my AS sy, b.mz AS sz,
               greatest(2e0 * g.c, least(2e0 * g.c + 2, b.mx)) AS tx, 1e0 * g.y AS ty, greatest(2e0 * g.r, least(2e0 * g.r + 2, b.mz)) AS tz
        FROM {source} b JOIN grid g ON b.mx BETWEEN 2 * g.c - {gap} AND 2 * g.c + 2 + {gap} AND b.mz BETWEEN 2 * g.r - {gap} AND 2 * g.r + 2 + {gap}
             AND abs(b.my - g.y) <= {rise} JOIN isl t ON t.p = g.p WHERE t.island <> b.island))
    WHERE horizontal <= {gap} AND {within}"""


# the default voxel of borders is 5 / 8, the window 0.25 * min(5, 6); of links 0.25 * 6
THIN = f"thin AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY island, {voxels('mx mz ex-sx ez-sz', 0.625)}, {voxels('my', 1.25)} ORDER BY ord, edge_no) = 1)"
SCANNED = f"scanned AS ({scan('thin', 5, 6)})"
RANKED = f"""cand AS (SELECT {LINK} FROM scanned QUALIFY row_number() OVER (PARTITION BY from_island, to_island, {voxels('sx sy sz tx ty tz', 1.5)} ORDER BY {ORDER}) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM cand)"""


def rounds(name: str, links: str, conflicts: str) -> str:
    """Greedy choice in rounds: state 1 stays, 2 goes; a conflict (rank, e1, e2)
    removes rank if e1 and e2 stay."""
    return f"""
{name}_c AS MATERIALIZED ({conflicts}),
{name}_s(round, rank, state) AS (
  SELECT 0, rank, 0 FROM {links}
  UNION ALL
  SELECT s.round + 1, s.rank, CASE WHEN any_value(s.state) <> 0 THEN any_value(s.state) WHEN coalesce(bool_or(a.state = 1 AND b.state = 1), false) THEN 2
         WHEN coalesce(bool_and(a.state = 2 OR b.state = 2), true) THEN 1 ELSE 0 END
  FROM {name}_s s LEFT JOIN {name}_c c ON c.rank = s.rank LEFT JOIN {name}_s a ON a.rank = c.e1 LEFT JOIN {name}_s b ON b.rank = c.e2
  WHERE EXISTS (FROM {name}_s u WHERE u.state = 0) GROUP BY s.round, s.rank),
{name} AS (SELECT l.* FROM {links} l JOIN {name}_s s ON s.rank = l.rank WHERE s.state = 1 AND s.round = (SELECT max(round) FROM {name}_s))"""


def near(a: str, p: str, b: str, q: str, radius: float) -> str:
    return " + ".join(f"({a}.{p}{k} - {b}.{q}{k}) * ({a}.{p}{k} - {b}.{q}{k})" for k in "xyz") + f" <= {radius * radius}"


def same(links: str, radius: float, target: bool = False) -> str:
    extra = "AND c.to_island = e.to_island" if target else ""
    return f"SELECT c.rank, e.rank AS e1, e.rank AS e2 FROM {links} c JOIN {links} e ON c.from_island = e.from_island AND e.rank < c.rank {extra} AND {near('c', 's', 'e', 's', radius)} AND {near('c', 't', 'e', 't', radius)}"


LOCAL = rounds("kept", "ranked", same("ranked", 1.5))
HOPS = f"hops AS (SELECT rank, from_island, to_island, {LENGTH} AS far FROM kept)"
TWO_HOPS = "SELECT c.rank, x.rank AS e1, y.rank AS e2 FROM hops c JOIN hops x ON x.from_island = c.from_island AND x.rank < c.rank AND x.to_island <> c.to_island JOIN hops y ON y.from_island = x.to_island AND y.to_island = c.to_island AND y.rank < c.rank AND x.far + y.far <= 1.5 * c.far"

# with masses: a preference of 0.2 * 5 for heavy targets, radii of 0.5 to 1.5 times the plain one
AWARE = f"""aware AS (SELECT cand.*, f.mass_score AS fm, t.mass_score AS tm,
  row_number() OVER (ORDER BY -floor(f.mass_score * t.mass_score / 0.001), round(({LENGTH} - 1.0 * t.mass_score) * 1000), {ORDER}) AS rank
  FROM cand JOIN massy f ON f.id = from_island JOIN massy t ON t.id = to_island)"""


def aware_same(radius: float) -> str:
    close = " AND ".join(near("c", p, "e", p, 1).removesuffix("1") + f"power({radius} * (0.5 + c.tm), 2)" for p in "st")
    return f"SELECT c.rank, e.rank AS e1, e.rank AS e2 FROM aware c JOIN aware e ON c.from_island = e.from_island AND e.rank < c.rank AND {close}"


AWARE_HELD = "held AS (SELECT rank FROM (SELECT from_island, min(rank) AS rank, any_value(fm) AS fm FROM aware GROUP BY from_island, to_island) QUALIFY row_number() OVER (PARTITION BY from_island ORDER BY rank) <= least(8, floor(1 + 7 * fm)))"
_TURNED = " ".join(f"(CASE WHEN to_island < from_island THEN {q}{k} ELSE {p}{k} END)".replace(" ", "~") for p, q in ("st", "ts") for k in "xyz")
MIRRORED = f"""seen AS ({scan("thin", 5, 5, LENGTH + " <= 5")}),
both_ AS (SELECT {LINK} FROM seen QUALIFY row_number() OVER (PARTITION BY least(from_island, to_island), greatest(from_island, to_island), {voxels(_TURNED, 1.25).replace("~", " ")} ORDER BY {ORDER}) = 1),
mirror AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM both_),
lists AS (SELECT from_island AS owner, rank, sx, sy, sz, tx, ty, tz FROM mirror UNION ALL SELECT to_island, rank, tx, ty, tz, sx, sy, sz FROM mirror)"""
MIRROR_SAME = f"SELECT c.rank, e.rank AS e1, e.rank AS e2 FROM mirror c JOIN lists e ON c.from_island = e.owner AND e.rank < c.rank AND {near('c', 's', 'e', 's', 1.25)} AND {near('c', 't', 'e', 't', 1.25)}"


def held(links: str, most: int) -> str:
    """Ranks that the reserve of ``most`` targets keeps in any case."""
    return f"SELECT rank FROM (SELECT from_island, min(rank) AS rank FROM {links} GROUP BY from_island, to_island) QUALIFY row_number() OVER (PARTITION BY from_island ORDER BY rank) <= {most}"


SAVING = (
    f"first_ AS ({held('ranked', 2)})",
    rounds("kept", "ranked", same("ranked", 1.5) + " AND c.rank NOT IN (SELECT rank FROM first_)"),
    HOPS,
    f"again_ AS ({held('kept', 2)})",
    rounds("saved", "kept", TWO_HOPS + " WHERE c.rank NOT IN (SELECT rank FROM again_)"),
)
CROWD = " UNION ".join(f"SELECT c.rank, e.rank, e.rank FROM kept c JOIN kept e ON e.rank < c.rank AND {near('c', p, 'e', q, 1.0)}" for p in "st" for q in "st")


def in_turn(name: str, links: str, most: int, soft: str, hard: str = "", lists: str = "") -> str:
    """The choice link by link, with a reserve of ``most`` targets: a list of the
    ranks that stay grows from one turn to the next."""
    own = lists or f"SELECT from_island AS owner, to_island AS goal, rank AS e FROM {links}"
    return f"""
{name}_own AS ({own}),
{name}_soft AS (SELECT rank, list({{'a': e1, 'b': e2}}) AS soft FROM ({soft}) c(rank, e1, e2) GROUP BY rank),
{name}_hard AS (SELECT rank, list(e1) AS hard FROM ({hard or "SELECT 0, 0, 0 WHERE false"}) c(rank, e1, e2) GROUP BY rank),
{name}_mine AS (SELECT l.rank, list({{'e': o.e, 'goal': o.goal}}) AS mine FROM {links} l JOIN {name}_own o ON o.owner = l.from_island AND o.e < l.rank GROUP BY l.rank),
{name}_turn AS MATERIALIZED (
  SELECT rank, row_number() OVER (ORDER BY rank) AS nth, to_island, coalesce(soft, []) AS soft, coalesce(hard, []) AS hard, coalesce(mine, []) AS mine
  FROM {links} LEFT JOIN {name}_soft USING (rank) LEFT JOIN {name}_hard USING (rank) LEFT JOIN {name}_mine USING (rank)),
{name}_walk(nth, stays) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT nth, CASE WHEN NOT list_has_any(hard, stays) AND (NOT near OR (len(met) < {most} AND NOT list_contains(met, to_island))) THEN list_append(stays, rank) ELSE stays END FROM (
    SELECT t.*, w.stays, len(list_filter(soft, lambda c: list_contains(w.stays, c.a) AND list_contains(w.stays, c.b))) > 0 AS near,
           list_distinct(list_transform(list_filter(mine, lambda o: list_contains(w.stays, o.e)), lambda o: o.goal)) AS met
    FROM {name}_walk w JOIN {name}_turn t ON t.nth = w.nth + 1)),
{name} AS (SELECT l.* FROM {links} l WHERE rank IN (SELECT unnest(stays) FROM {name}_walk WHERE nth = (SELECT max(nth) FROM {name}_walk)))"""


def corridors(links: str) -> str:
    """Edges of ``links``: one per voxel pair of the islands in order."""
    pick = ", ".join(f"CASE WHEN f THEN {a} ELSE {b} END AS {n}" for n, a, b in (("island_a", "from_island", "to_island"), ("island_b", "to_island", "from_island"), *((f"u{k}", f"s{k}", f"t{k}") for k in "xyz"), *((f"v{k}", f"t{k}", f"s{k}") for k in "xyz")))
    part = f"PARTITION BY island_a, island_b, {voxels('ux uy uz vx vy vz', 1.5)}"
    return f"""
way AS (SELECT {pick}, horizontal, f, from_island, rank FROM (SELECT *, from_island <= to_island AS f FROM {links})),
turned AS (SELECT *, bool_or(f) OVER w AS trav_ab, bool_or(NOT f) OVER w AS trav_ba, row_number() OVER (w ORDER BY from_island, rank) AS nth FROM way WINDOW w AS ({part})),
edges AS (SELECT row_number() OVER (ORDER BY from_island, rank) - 1 AS edge_index, island_a, island_b, ux, uy, uz, vx, vy, vz, horizontal, vy - uy AS vertical_delta_ab, trav_ab, trav_ba FROM turned WHERE nth = 1),
trav AS (
  SELECT edge_index, island_a AS from_island, island_b AS to_island, ux AS sx, uy AS sy, uz AS sz, vx AS tx, vy AS ty, vz AS tz, horizontal, vertical_delta_ab AS vertical FROM edges WHERE trav_ab
  UNION ALL SELECT edge_index, island_b, island_a, vx, vy, vz, ux, uy, uz, horizontal, -vertical_delta_ab FROM edges WHERE trav_ba)"""


COLLAPSED = rounds("merged", "kept", same("kept", 1.5, target=True)) + "," + corridors("merged")
DEGREES = """deg AS (
  SELECT id, polygon_count, mass_score, (SELECT count(*) FROM trav WHERE from_island = id) AS n_out, (SELECT count(*) FROM trav WHERE to_island = id) AS n_in FROM massy)"""
P95 = "list_sort(list({0}))[((count(*) - 1) * 95) // 100 + 1]"
STRONG = """walk(a, b) AS (SELECT id, id FROM islands UNION SELECT walk.a, trav.to_island FROM walk JOIN trav ON trav.from_island = walk.b),
strong AS (SELECT x.a AS id, min(x.b) AS component FROM walk x JOIN walk y ON y.a = x.b AND y.b = x.a GROUP BY x.a)"""


def routes(cost: str, keep: str = "true") -> str:
    """Least costs from island 0's centre, relaxed until nothing falls."""
    return f"""
portal AS (SELECT row_number() OVER () AS n, *, {cost} AS cost FROM trav WHERE {keep}),
home AS (SELECT center_x AS x, center_y AS y, center_z AS z FROM islands WHERE id = 0),
hop AS MATERIALIZED (SELECT a.n AS a, b.n AS b, sqrt((a.tx-b.sx)*(a.tx-b.sx) + (a.ty-b.sy)*(a.ty-b.sy) + (a.tz-b.sz)*(a.tz-b.sz)) + b.cost AS more FROM portal a JOIN portal b ON b.from_island = a.to_island),
best(round, n, g, fell) AS (
  SELECT 0, n, CASE WHEN from_island = 0 THEN sqrt((x-sx)*(x-sx) + (y-sy)*(y-sy) + (z-sz)*(z-sz)) + cost ELSE 1e300 END, true FROM portal, home
  UNION ALL
  SELECT d.round + 1, d.n, least(any_value(d.g), coalesce(min(e.g + h.more), 1e300)), coalesce(min(e.g + h.more) < any_value(d.g), false)
  FROM best d LEFT JOIN hop h ON h.b = d.n LEFT JOIN best e ON e.n = h.a WHERE EXISTS (FROM best f WHERE f.fell) GROUP BY d.round, d.n),
goal AS (
  SELECT i.id, min(g + sqrt((tx-center_x)*(tx-center_x) + (ty-center_y)*(ty-center_y) + (tz-center_z)*(tz-center_z))) AS cost
  FROM best JOIN portal USING (n) JOIN islands i ON i.id = to_island WHERE round = (SELECT max(round) FROM best) AND g < 1e299 GROUP BY i.id)"""


#: Least costs where the last link may climb: any link after a route of level or
#: falling ones.  A link is no shorter than its straight line, so that going on
#: from the goal's island and coming back does not pay.
LAST_CLIMB = f"""
level_ AS (SELECT to_island AS via, tx AS ex, ty AS ey, tz AS ez, g FROM best JOIN portal USING (n) WHERE round = (SELECT max(round) FROM best) AND g < 1e299
  UNION ALL SELECT 0, x, y, z, 0 FROM home),
last_ AS (
  SELECT i.id, min(g + sqrt((ex-sx)*(ex-sx) + (ey-sy)*(ey-sy) + (ez-sz)*(ez-sz)) + {LENGTH} + sqrt((tx-center_x)*(tx-center_x) + (ty-center_y)*(ty-center_y) + (tz-center_z)*(tz-center_z))) AS cost
  FROM level_ JOIN trav ON trav.from_island = via JOIN islands i ON i.id = trav.to_island GROUP BY i.id)"""

#: The counters of a build with a spanner, and how each follows from the tables.
BOXES = """boxes AS (
  SELECT b.island, t.island AS other FROM thin b JOIN grid g ON b.mx BETWEEN 2 * g.c - 5 AND 2 * g.c + 7 AND b.mz BETWEEN 2 * g.r - 5 AND 2 * g.r + 7 AND abs(b.my - g.y) <= 6
  JOIN isl t ON t.p = g.p)"""
STATS = {
    "boundaries_raw": "count(*) FROM raw", "boundaries_deduplicated": "count(*) FROM thin", "boundaries_representative": "count(*) FROM thin", "queries": "count(*) FROM thin",
    "nearby_polygons": "count(*) FROM boxes", "pair_scan_candidates": "count(*) FILTER (island <> other) FROM boxes", "closest_point_queries": "count(*) FILTER (island <> other) FROM boxes",
    "projected": "count(*) FILTER (island <> other) FROM boxes", "deduplicated": "count(*) FROM ranked",
    "local_pruning_rejects": "count(*) - (SELECT count(*) FROM kept) FROM ranked", "spanner_pruning_rejects": "count(*) - (SELECT count(*) FROM sparse) FROM kept",
    "pruned_links": "count(*) FROM merged", "rejected": "count(*) - (SELECT count(*) FROM merged) FROM ranked", "accepted_links": "count(*) FROM edges",
    "island_count": "count(*) FROM islands", "polygon_count": "sum(polygon_count) FROM islands",
    "with_outgoing": "count(*) FILTER (n_out > 0) FROM deg", "with_incoming": "count(*) FILTER (n_in > 0) FROM deg", "max_out": "max(n_out) FROM deg", "max_in": "max(n_in) FROM deg",
    "p95_out": P95.format("n_out") + " FROM deg", "p95_in": P95.format("n_in") + " FROM deg",
    "isolated_islands": "count(*) FILTER (n_out = 0 AND n_in = 0) FROM deg", "isolated_polygons": "coalesce(sum(polygon_count) FILTER (n_out = 0 AND n_in = 0), 0) FROM deg",
    "components": "count(DISTINCT component) FROM strong", "largest_islands": "count(*) FROM big", "largest_polygons": "sum(polygon_count) FROM big", "average_link_length": "coalesce(avg(horizontal), 0) FROM edges",
    # masses are off; nothing is thinned by outbound policy or representatives, recovered, reversed, saved or rejected otherwise
    **dict.fromkeys(("boundaries_outbound_filtered", "boundaries_trimmed", "pair_scan_suppressed", "recovery_queries", "recovered", "reverse_links_synthesized", "reverse_links_rejected", "closest_point_failures",
                     "global_pruning_rejects", "distinct_target_reserve", "small_islands_suppressed", "total_mass", "isolated_mass", "largest_mass"), "0"),
}
BIG = "big AS (SELECT * FROM strong JOIN islands USING (id) WHERE component = (SELECT component FROM strong GROUP BY component ORDER BY count(*) DESC, component LIMIT 1))"
ROUTE_ROWS = """SELECT i.id AS request_id, CASE WHEN i.id = 0 THEN 'same_island' WHEN cost IS NULL THEN 'no_path' ELSE 'success' END AS status,
  CASE WHEN i.id = 0 THEN 0 ELSE coalesce(CAST(round(cost * 1000) AS BIGINT), 0) END AS cost_mm FROM islands i LEFT JOIN goal ON goal.id = i.id"""


def _sql(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def oracle_sql() -> dict[str, str]:
    to_ranked = (GRID, THIN, SCANNED, RANKED)
    to_kept = (*to_ranked, LOCAL)
    to_graph = (*to_kept, COLLAPSED)
    links = f"SELECT rank, from_island, to_island, {LINK_MM} FROM "
    coarse = f"best AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY island, {voxels('mx mz', '{0}')}, {voxels('my', 1.25)}, edge_no ORDER BY -((ex-sx)*(ex-sx)+(ey-sy)*(ey-sy)+(ez-sz)*(ez-sz)), poly_ref, mx, my, mz) = 1)"
    segment = f"SELECT island, poly_ref, edge_no, {SEGMENT} FROM "
    pair = f"island, to_island, {voxels('sx sy sz', 4)}".replace("island, to", "from_island, to", 1)
    return {
        "mesh_scan_filter": _sql(GRID, "SELECT p AS poly_ref, ord, flags FROM grid WHERE flags & 3 <> 0 AND flags & 2 = 0"),
        "polygon_adjacency": _sql(GRID, "SELECT p AS src, q AS dst FROM adj"),
        "island_labels": _sql(GRID, "SELECT p AS poly_ref, island FROM isl"),
        "island_summary": _sql(GRID, "SELECT id, polygon_count, " + ", ".join(f"round({p}_{k}, 6) AS {p}_{k}" for p in ("center", "min", "max") for k in "xyz") + ", round(raw_mass, 6) AS raw_mass FROM islands"),
        "mass_scores": _sql(GRID, "SELECT id, round(mass_score, 6) AS mass_score FROM massy"),
        "small_island_suppression": _sql(GRID, "SELECT id, low AS suppressed, NOT low AS outbound FROM (SELECT id, n >= 20 AND row_number() OVER (ORDER BY raw_mass, id) <= CAST(floor(n * 0.25) AS BIGINT) AS low FROM (SELECT id, raw_mass, count(*) OVER () AS n FROM islands))"),
        "boundary_edges": _sql(GRID, segment + "raw"),
        "boundary_dedup": _sql(GRID, segment + f"raw QUALIFY row_number() OVER (PARTITION BY island, {voxels('mx mz ex-sx ez-sz', 3)}, {voxels('my', 1.25)} ORDER BY ord, edge_no) = 1"),
        "boundary_representatives": _sql(GRID, coarse.format(6), segment + "best"),
        "representative_budget": _sql(GRID, coarse.format(3), "spread AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY mx, mz, my, poly_ref, edge_no) - 1 AS i, count(*) OVER (PARTITION BY island) AS k FROM best)", "part_ AS (SELECT *, CASE WHEN k <= 5 THEN i ELSE ((i + 1) * 5 - 1) // k END AS s FROM spread)", segment + "part_ QUALIFY row_number() OVER (PARTITION BY island, s ORDER BY -((ex-sx)*(ex-sx)+(ez-sz)*(ez-sz)), poly_ref, mx, my, mz, edge_no) = 1"),
        "spatial_candidates": _sql(GRID, f"found AS ({scan('raw', 5, 6)})", f"SELECT poly_ref, edge_no, near_ref, from_island, to_island, {LINK_MM} FROM found"),
        "island_box_probe": _sql(GRID, "SELECT i.id AS to_island, b.island, count(*) AS midpoints FROM raw b JOIN islands i ON i.id <> b.island AND b.mx BETWEEN min_x - 2 AND max_x + 2 AND b.my BETWEEN min_y - 6 AND max_y + 6 AND b.mz BETWEEN min_z - 2 AND max_z + 2 GROUP BY ALL"),
        "spherical_candidates": _sql(GRID, f"found AS ({scan('raw', 5, 5, LENGTH + ' <= 5')})", f"SELECT poly_ref, edge_no, near_ref, from_island, to_island, {LINK_MM} FROM found"),
        "outbound_policy": _sql(GRID, "allowed AS (SELECT * FROM raw WHERE island % 3 <> 0)", f"found AS ({scan('allowed', 5, 6)})", f"SELECT poly_ref, edge_no, near_ref, from_island, to_island, {LINK_MM} FROM found"),
        "pair_scan_suppression": _sql(GRID, THIN, SCANNED, f"top AS (SELECT * FROM scanned QUALIFY row_number() OVER (PARTITION BY ord, edge_no, to_island ORDER BY {ORDER}) = 1)", f"SELECT from_island, to_island, {LINK_MM} FROM top QUALIFY row_number() OVER (PARTITION BY {pair} ORDER BY from_island, ord, edge_no, to_island) = 1"),
        "short_gap_recovery": _sql(GRID, f"found AS ({scan('raw', 2, 2)})", f"SELECT poly_ref, edge_no, near_ref, from_island, to_island, {LINK_MM} FROM found"),
        "candidate_dedup": _sql(*to_ranked, f"SELECT from_island, to_island, {LINK_MM} FROM cand"),
        "link_ranking": _sql(*to_ranked, links + "ranked"),
        "local_prune": _sql(*to_kept, links + "kept"),
        "spanner_prune": _sql(*to_kept, HOPS, rounds("sparse", "kept", TWO_HOPS), links + "sparse"),
        "global_spanner_prune": _sql(*to_kept, HOPS, rounds("sparse", "kept", f"{TWO_HOPS} UNION {CROWD}"), links + "sparse"),
        "distinct_target_reserve": _sql(*to_ranked, *SAVING, links + "saved"),
        "global_reserve": _sql(*to_ranked, *SAVING[:3], in_turn("saved", "kept", 2, TWO_HOPS, CROWD), links + "saved"),
        "symmetric_reserve": _sql(GRID, THIN, MIRRORED, in_turn("fair", "mirror", 3, MIRROR_SAME.replace("<= 1.5625", "<= 16.0"), lists="SELECT from_island AS owner, to_island AS goal, rank AS e FROM mirror UNION ALL SELECT to_island, from_island, rank FROM mirror"), links + "fair"),
        "mass_link_ranking": _sql(*to_ranked, AWARE, links + "aware"),
        "mass_local_prune": _sql(*to_ranked, AWARE, rounds("heavy", "aware", aware_same(1.5)), links + "heavy"),
        "mass_reserve": _sql(*to_ranked, AWARE, AWARE_HELD, rounds("heavy", "aware", aware_same(6.0) + " AND c.rank NOT IN (SELECT rank FROM held)"), links + "heavy"),
        "symmetric_prune": _sql(GRID, THIN, MIRRORED, rounds("fair", "mirror", MIRROR_SAME), links + "fair"),
        "local_collapse": _sql(*to_ranked, rounds("merged", "ranked", same("ranked", 4.0, target=True)), links + "merged"),
        "corridor_edges": _sql(*to_kept, corridors("kept"), "SELECT edge_index, island_a, island_b, CAST(round(horizontal * 1000) AS BIGINT) AS horizontal_mm, CAST(round(vertical_delta_ab * 1000) AS BIGINT) AS vertical_delta_ab_mm, trav_ab, trav_ba FROM edges"),
        "traversals": _sql(*to_graph, f"SELECT edge_index, from_island, to_island, {LINK_MM} FROM trav"),
        "degree_stats": _sql(*to_graph, DEGREES, f"SELECT count(*) FILTER (n_out > 0) AS with_outgoing, count(*) FILTER (n_in > 0) AS with_incoming, max(n_out) AS max_n_out, max(n_in) AS max_n_in, {P95.format('n_out')} AS p95_n_out, {P95.format('n_in')} AS p95_n_in FROM deg"),
        "mass_buckets": _sql(*to_graph, DEGREES, f"SELECT bucket, coalesce(islands, 0) AS islands, coalesce(links_out, 0) AS links_out, coalesce(links_in, 0) AS links_in, coalesce(isolated, 0) AS isolated, coalesce(max_out, 0) AS max_out, coalesce(max_in, 0) AS max_in, round(coalesce(mass, 0), 6) AS mass, coalesce(p95_out, 0) AS p95_out, coalesce(p95_in, 0) AS p95_in FROM (VALUES (0), (1), (2)) b(bucket) LEFT JOIN (SELECT CASE WHEN mass_score < 1e0 / 3 THEN 0 WHEN mass_score < 2e0 / 3 THEN 1 ELSE 2 END AS bucket, count(*) AS islands, sum(n_out) AS links_out, sum(n_in) AS links_in, count(*) FILTER (n_out = 0 AND n_in = 0) AS isolated, max(n_out) AS max_out, max(n_in) AS max_in, sum(mass_score) AS mass, {P95.format('n_out')} AS p95_out, {P95.format('n_in')} AS p95_in FROM deg GROUP BY 1) USING (bucket)"),
        "isolated_islands": _sql(*to_graph, DEGREES, "SELECT count(*) AS islands, coalesce(sum(polygon_count), 0) AS polygons, round(coalesce(sum(mass_score), 0), 6) AS mass FROM deg WHERE n_out = 0 AND n_in = 0"),
        "average_link_length": _sql(*to_graph, "SELECT round(coalesce(avg(horizontal), 0), 6) AS average_length FROM edges"),
        "strong_components": _sql(*to_graph, STRONG, "SELECT id, component FROM strong"),
        "largest_component": _sql(*to_graph, STRONG, "SELECT component, count(*) AS islands, sum(polygon_count) AS polygons, round(sum(mass_score), 6) AS mass FROM strong JOIN massy USING (id) GROUP BY component ORDER BY islands DESC, component LIMIT 1"),
        "shortest_paths": _sql(*to_graph, routes(LENGTH), ROUTE_ROWS),
        "shortest_path_filtered": _sql(*to_graph, routes(LENGTH, "vertical <= 0"), ROUTE_ROWS),
        "custom_cost_path": _sql(*to_graph, routes("horizontal * 2 + abs(vertical)"), ROUTE_ROWS),
        "context_path": _sql(*to_graph, routes(LENGTH, "vertical <= 0"), LAST_CLIMB, ROUTE_ROWS.replace("goal", "last_")),
        "route_search": _sql(*to_graph, routes(LENGTH), ROUTE_ROWS),
        "graph_roundtrip": _sql(GRID, "SELECT island AS id, p AS poly_ref FROM isl"),
        "polygon_lookup": _sql(GRID, "SELECT p AS poly_ref, island FROM isl"),
        "build_stats": _sql(
            *to_kept, HOPS, rounds("sparse", "kept", TWO_HOPS), rounds("merged", "sparse", same("sparse", 1.5, target=True)), corridors("merged"), DEGREES, STRONG, BIG, BOXES,
            " UNION ALL ".join(f"SELECT '{name}' AS name, round(CAST((SELECT {sql}) AS DOUBLE), 6) AS value" for name, sql in STATS.items()),
        ),
        "island_adjacency": _sql(*to_graph, "SELECT id, string_agg(edge_index, ',' ORDER BY edge_index) AS edges FROM (SELECT island_a AS id, edge_index FROM edges UNION SELECT island_b, edge_index FROM edges) GROUP BY id"),
    }
