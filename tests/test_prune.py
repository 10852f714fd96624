from dataclasses import replace

import pytest
from helpers import islands, links, loop_fates

from archipelago.operators.prune import corridor_edges, prune, prune_with_reserve, rank_links
from archipelago.plans.config import BuildConfig, Cells, GlobalPrune, MassAware, Reserve, Spanner


def run(spark, rows, masses, h=30, up=30, down=30, aware=None, **density):
    config = BuildConfig.of(h, up, down)
    off = {"local": Cells(False), "candidates": Cells(True)}
    config = replace(config, density=replace(config.density, **(off | density)), mass=aware or MassAware())
    facts = islands(spark, masses)
    kept = prune(links(spark, rows), facts, config)
    edges = corridor_edges(kept, facts, config).orderBy("edge_index").collect()
    return [(e["island_a"], e["island_b"], e["trav_ab"], e["trav_ba"]) for e in edges]


AWARE = MassAware(enabled=True)


def test_local_prune_looks_at_the_source_only(spark):
    rows = [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 2, (0, 5, 0), (5, 5, 0)), (0, 2, (0, 6, 0), (5, 6, 0)), (0, 1, (0, 0, 5), (5, 0, 5))]
    edges = run(spark, rows, [1, 1, 0.1], 8, 8, 8, AWARE, local=Cells(True, 3.0))
    assert len(edges) == 3


def test_reserve_saves_distinct_targets(spark):
    rows = [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 2, (0.2, 0, 0), (5.2, 0, 0)), (0, 2, (0.3, 0, 0), (5.3, 0, 0))]
    assert [e[:2] for e in run(spark, rows, [1, 0.8, 0.8], aware=AWARE, local=Cells(True, 10.0), reserve=Reserve(True, 0, 2))] == [(0, 1), (0, 2)]
    assert [e[:2] for e in run(spark, rows, [1, 0.8, 0.8], aware=AWARE, local=Cells(True, 10.0))] == [(0, 1)]


@pytest.mark.parametrize("second", [((0, 0, 50), (5, 0, 50)), ((0, 20, 0), (5, 20, 0)), ((0, 480, 0), (5, 480, 0))])
def test_far_corridors_stay(spark, second):
    assert len(run(spark, [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 1, *second)], [0, 0], local=Cells(True, 1.0))) == 2


def test_spanner(spark):
    rows = [(1, 0, (5, 0, 0), (0, 0, 0)), (1, 2, (5, 0, 0), (10, 0, 0)), (0, 2, (0, 0, 0), (10, 0, 0))]
    edges = run(spark, rows, [0, 0, 0], spanner=Spanner(True, 2.0))
    assert sorted(edges) == [(0, 1, True, True), (1, 2, True, True)]
    rows = [(0, 1, (0, 0, 0), (5, 0, 0)), (1, 2, (5, 0, 0), (10, 0, 0)), (0, 2, (0, 0, 0), (10, 0, 0))]
    assert len(run(spark, rows, [1, 1, 1], aware=AWARE, spanner=Spanner(True, 2.0), reserve=Reserve(True, 0, 2))) == 3


def test_mirror(spark):
    rows = [(0, 1, (0, 10, 0), (5, 12, 0)), (1, 0, (5, 12.1, 0), (0, 10.1, 0))]
    assert run(spark, rows, [0, 0], local=Cells(True, 1.0)) == [(0, 1, True, True)]


@pytest.mark.parametrize("down,both", [(4, True), (15, False)])
def test_directions_of_an_edge(spark, down, both):
    assert run(spark, [(0, 1, (0, 0, 0), (5, 2, 0))], [0, 0], 30, 4, down) == [(0, 1, True, both)]


def test_global_prune(spark):
    near = [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 1, (0.1, 0, 0), (5.1, 0, 0))]
    assert len(run(spark, near, [0, 0], local=Cells(True, 3.0), overall=GlobalPrune(True, 5.0))) == 1
    rows = [(0, 1, (0, 0, 0), (10, 0, 0)), (2, 3, (2, 0, 0), (20, 0, 0))]
    edges = run(spark, rows, [1, 1, 0, 0], 10, 10, 10, AWARE, overall=GlobalPrune(True, 1.0, low_radius_scale=3.0, high_radius_scale=0.5))
    assert [e[:2] for e in edges] == [(0, 1)]


def test_reverse_duplicates_make_one_edge(spark):
    rows = [(0, 1, (0, 0, 0), (5, 0, 0)), (1, 0, (5, 0, 0), (0, 0, 0))]
    assert run(spark, rows, [0, 0], candidates=Cells(True, 2.0)) == [(0, 1, True, True)]


def test_suppressed_targets_and_unknown_islands_go(spark):
    rows = [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 7, (0, 0, 0), (5, 0, 0))]
    config = BuildConfig.of(8, 8, 8)
    assert prune(links(spark, rows), islands(spark, [0, 0], suppressed={1}), config).count() == 0


def test_rounds_equal_the_loop(spark):
    """The set-based rounds keep what the one-by-one loop keeps."""
    import random

    rnd = random.Random(3)
    spot = lambda: tuple(rnd.randint(0, 12) / 2 for _ in range(3))
    rows = list({(a, b, spot(), spot()) for a in range(4) for b in range(4) if a != b for _ in range(8)})
    config = BuildConfig.of(9, 9, 9)
    config = replace(config, density=replace(config.density, local=Cells(True, 2.0), spanner=Spanner(True, 1.5), overall=GlobalPrune(True, 1.0)))
    facts = islands(spark, [0, 0, 0, 0])
    from archipelago.operators.prune import prune_global_and_spanner, prune_local

    ranked = rank_links(links(spark, rows), facts, config).cache()
    one = {r["rank"] for r in prune_global_and_spanner(prune_local(ranked, facts, config), facts, config).collect()}
    two = {r["rank"] for r in prune_with_reserve(ranked, facts, config).collect()}
    assert one == two and 0 < len(one) < len(rows)


def test_rejects_are_counted_by_reason(spark):
    from archipelago.operators.prune import pruning_counts, reserve_fates

    near = links(spark, [(0, 1, (0, 0, 0), (5, 0, 0)), (0, 2, (0.2, 0, 0), (5.2, 0, 0)), (0, 2, (0.3, 0, 0), (5.3, 0, 0))])
    facts, config = islands(spark, [1, 0.8, 0.8]), BuildConfig.of(30, 30, 30)
    config = replace(config, mass=AWARE, density=replace(config.density, local=Cells(True, 10.0)))
    assert pruning_counts(near, facts, config) == {"local": 2, "global": 0, "spanner": 0, "saved": 0}
    config = replace(config, density=replace(config.density, reserve=Reserve(True, 0, 2)))
    assert pruning_counts(near, facts, config) == {"local": 1, "global": 0, "spanner": 0, "saved": 1}
    assert reserve_fates(rank_links(near, facts, config), facts, config).where("fate = 'kept'").count() == 2


def test_counts_of_the_second_pass_agree_with_the_loop(spark):
    import random

    from archipelago.operators.prune import pruning_counts

    rnd = random.Random(5)
    spot = lambda: tuple(rnd.randint(0, 12) / 2 for _ in range(3))
    rows = links(spark, list({(a, b, spot(), spot()) for a in range(4) for b in range(4) if a != b for _ in range(8)}))
    config = BuildConfig.of(9, 9, 8)
    config = replace(config, density=replace(config.density, local=Cells(True, 2.0), spanner=Spanner(True, 1.5), overall=GlobalPrune(True, 1.0)))
    facts = islands(spark, [0, 0, 0, 0])
    # a reserve of no targets is the loop without one
    loop = replace(config, density=replace(config.density, reserve=Reserve(True, 0, 0)))
    found = pruning_counts(rows, facts, config)
    assert found == pruning_counts(rows, facts, loop) and found["local"] and found["global"]


CASES = [
    (1, 0, 4, False, 8, False, None), (2, 0, 2, False, 8, False, None), (3, 2, 4, True, 8, False, None), (4, 0, 5, True, 8, False, None),
    (5, 0, 3, False, 9, False, None), (6, 1, 4, True, 9, False, None), (7, 0, 3, False, 8, True, None), (8, 1, 5, True, 9, True, None), (9, 0, 4, False, 9, True, (0, 1, 4)),
]


@pytest.mark.parametrize(("seed", "least", "most", "aware", "down", "overall", "outbound"), CASES)
def test_reserve_by_rounds_equals_the_loop(spark, seed, least, most, aware, down, overall, outbound):
    """Limits of 9, 9 and 9 are symmetric."""
    import random

    from archipelago.operators.prune import admit, reserve_fates

    rnd = random.Random(seed)
    spot = lambda: tuple(rnd.randint(0, 12) / 2 for _ in range(3))
    rows = list({(a, b, spot(), spot()) for a in range(6) for b in range(6) if a != b for _ in range(5)})
    config = BuildConfig.of(9, 9, down)
    assert config.symmetric == (down == 9)
    config = replace(config, mass=replace(AWARE, enabled=aware), density=replace(config.density, local=Cells(True, 3.0), spanner=Spanner(True, 1.5), reserve=Reserve(True, least, most), overall=GlobalPrune(overall, 0.6)))
    facts = islands(spark, [0, 0.1, 0.4, 0.6, 0.9, 1], outbound=outbound)
    ranked = rank_links(admit(links(spark, rows), facts), facts, config).cache()
    found = reserve_fates(ranked, facts, config).collect()
    one = {r["rank"]: r["fate"] for r in found if r["fate"] != "saved"}, sum(r["rank"] for r in found if r["fate"] == "saved")
    two = loop_fates(ranked, facts, config)
    assert one == two and one[1]
    assert {"local", "kept"} < set(one[0].values()) and ("global" in one[0].values()) == overall


def test_reserve_without_local_pruning(spark):
    import random

    from archipelago.operators.prune import reserve_fates

    rnd = random.Random(2)
    spot = lambda: tuple(rnd.randint(0, 12) / 2 for _ in range(3))
    rows = list({(a, b, spot(), spot()) for a in range(5) for b in range(5) if a != b for _ in range(4)})
    config = BuildConfig.of(9, 9, 9)
    config = replace(config, density=replace(config.density, local=Cells(False), overall=GlobalPrune(True, 1.0), reserve=Reserve(True, 0, 2)))
    facts = islands(spark, [0, 0.1, 0.4, 0.6, 0.9])
    ranked = rank_links(links(spark, rows), facts, config).cache()
    found = reserve_fates(ranked, facts, config).collect()
    assert ({r["rank"]: r["fate"] for r in found if r["fate"] != "saved"}, 0) == loop_fates(ranked, facts, config)


def test_rounds_keep_open_conflicts_only(spark, monkeypatch):
    """A chain of links, each beaten by the one before, and one with many conflicts
    that the first round decides: later rounds must not carry those along."""
    from archipelago.operators import prune as P

    sizes, plain = [], P.store

    def counted(df, name):
        out = plain(df, name)
        if name == "conflicts":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(P, "store", counted)
    chain = [(k, k - 1, k - 1) for k in range(2, 7)]
    wide = [(100 + k, 1, 1) for k in range(50)]
    pair = [(200, 1, 2), (201, 1, 3)]  # 2 goes, so 200 stays; 1 and 3 stay, so 201 goes
    ranks = spark.createDataFrame([(k,) for k in [*range(1, 7), *range(100, 150), 200, 201]], "rank long")
    kept = P.decide(ranks, spark.createDataFrame(chain + wide + pair, "rank long, e1 long, e2 long"))
    assert sorted(r["rank"] for r in kept.collect()) == [1, 3, 5, 200]
    assert sizes[0] == 57 and sizes[-1] <= 2 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("reserve", [None, Reserve(True, 0, 1)])
@pytest.mark.parametrize("overall", [False, True])
def test_parallel_links_make_ways_not_triples(spark, monkeypatch, reserve, overall):
    """Every link of one corridor beside every link of the next would be a row; a way is one."""
    import random

    from archipelago.operators import prune as P

    rnd = random.Random(9)
    spot = lambda x: (x + rnd.randint(0, 8) / 4, 0.0, rnd.randint(0, 30) / 2)
    rows = [(a, b, spot(5 * a), spot(5 * b)) for a, b in ((0, 1), (1, 2), (0, 2)) for _ in range(12)]
    config = BuildConfig.of(30, 30, 20)
    config = replace(config, density=replace(config.density, local=Cells(False, 1.0), spanner=Spanner(True, 1.3), overall=GlobalPrune(overall, 0.5), reserve=reserve or config.density.reserve))
    facts = islands(spark, [0, 0, 0])
    ranked = rank_links(links(spark, rows), facts, config).cache()
    most, kept = [0], P.store

    def watched(df, name):
        out = kept(df, name)
        if name in ("conflicts", "ways"):
            most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(P, "store", watched)
    if reserve is None:
        got = {r["rank"] for r in P.prune_global_and_spanner(ranked, facts, config).collect()}
    else:
        got = {r["rank"] for r in P.prune_with_reserve(ranked, facts, config).collect()}
    want, _ = loop_fates(ranked, facts, config)
    assert got == {rank for rank, fate in want.items() if fate == "kept"} and 0 < len(got) < len(rows)
    assert "spanner" in want.values() and most[0] <= 40
