from dataclasses import replace

import pytest
from helpers import mesh, square
from pyspark.sql import functions as F

from archipelago.operators.graph import traversals
from archipelago.operators.islands import label_islands, score_masses, summarize_islands
from archipelago.plans.build import build
from archipelago.plans.config import Boundaries, BuildConfig, BuildProfile, BuildStatus, Cells, Density, Gap, GlobalPrune, MassAware, Query, Reserve, Spanner


def apart(spark):
    return mesh(spark, [square(0, 0, 0), square(4, 0, 0), square(8, 0, 3)])


def fine(h, up, down):
    config = BuildConfig.of(h, up, down)
    return replace(config, boundaries=replace(config.boundaries, dedup=Cells(True, 0.5)), density=replace(config.density, local=Cells(True, 0.5)))


def ways(result):
    return {(r[0], r[1]) for r in traversals(result.graph.edges).select("from_island", "to_island").collect()}


def test_directional_limits(spark):
    result = build(apart(spark), fine(3, 2, 4))
    assert result and result.graph.islands.count() == 3
    assert {(0, 1), (1, 0), (2, 1)} <= ways(result) and (1, 2) not in ways(result)
    assert result.stats["accepted_links"] == result.graph.edges.count()


def test_wide_limits_link_both_ways(spark):
    result = build(apart(spark), fine(30, 30, 30), statistics=False)
    assert {(0, 1), (1, 0), (1, 2), (2, 1)} <= ways(result)


def test_outbound_policy(spark):
    config = replace(fine(3, 2, 4), outbound=lambda: F.col("id") != 0)
    found = ways(build(apart(spark), config, statistics=False))
    assert (0, 1) not in found and (1, 0) in found


def test_flags_and_predicate_can_leave_nothing(spark):
    for config in (replace(fine(3, 2, 4), query=Query(include_flags=2)), replace(fine(3, 2, 4), polygon_filter=lambda: F.lit(False))):
        result = build(apart(spark), config, statistics=False)
        assert result and result.graph.islands.count() == 0 and result.graph.edges.count() == 0


def test_non_finite_border(spark):
    bad = square(0, 0, 0)
    bad[0] = (float("nan"), 0.0, 0.0)
    result = build(mesh(spark, [bad, square(4, 0, 0)]), fine(3, 2, 4))
    assert result.status is BuildStatus.INVALID_MESH and result.graph is None


def test_non_finite_inner_vertex_and_nearest_point(spark):
    # polygons 1 to 3 lie in a row; the corner that only inner edges have is not a number
    bad = [(8.0, 0.0, 0.0), (10.0, 0.0, 0.0), (float("nan"), 0.0, 1.0), (10.0, 0.0, 2.0), (8.0, 0.0, 2.0)]
    m = mesh(spark, [square(0, 0, 0), square(4, 0, 0), bad], [(2, 1, 1), (2, 2, 1), (1, 3, 2)])
    for statistics in (False, True):
        result = build(m, fine(3, 2, 4), statistics=statistics)
        assert result.status is BuildStatus.INVALID_MESH and result.graph is None and "not finite" in result.message
        assert "flood_fill" in result.timings and "pruning" not in result.timings


def test_cancellation_within_a_stage(spark):
    import time

    from pyspark.sql.functions import udf

    @udf("boolean")
    def slow(ref):
        import time

        time.sleep(20)
        return True

    began = time.time()
    result = build(apart(spark), replace(fine(3, 2, 4), polygon_filter=lambda: slow("poly_ref")), cancelled=lambda: time.time() - began > 4)
    assert result.status is BuildStatus.CANCELLED and result.graph is None
    assert time.time() - began < 18  # a single call sleeps 20 s
    assert build(apart(spark), fine(3, 2, 4), cancelled=lambda: False, statistics=False).status is BuildStatus.SUCCESS


def test_cancellation(spark):
    calls = []
    result = build(apart(spark), fine(3, 2, 4), cancelled=lambda: calls.append(1) or len(calls) > 2)
    assert result.status is BuildStatus.CANCELLED and result.graph is None


def test_masses(spark):
    joins = [(0, 1, 1), (1, 3, 0)]
    for k in (1, 10):
        m = mesh(spark, [square(0, 0, 0, 2.0 * k), square(2 * k, 0, 0, 2.0 * k), square(8 * k, 0, 0, 2.0 * k)], joins)
        config = replace(BuildConfig.of(3, 2, 4), mass=MassAware(enabled=True))
        labels = label_islands(m, config)
        scores = [r[0] for r in score_masses(summarize_islands(m, labels), config).orderBy("id").select("mass_score").collect()]
        assert len(scores) == 2 and scores[0] == pytest.approx(1.0) and 0 <= scores[1] < scores[0]
        off = score_masses(summarize_islands(m, labels), BuildConfig.of(3, 2, 4)).agg(F.max("mass_score")).first()[0]
        assert off == 0


@pytest.mark.parametrize("n,gone", [(20, {0}), (19, set())])
def test_suppression_needs_twenty_islands(spark, n, gone):
    m = mesh(spark, [square(100 * k, 0, 0, float(k + 1)) for k in range(n)])
    config = replace(BuildConfig.of(3, 2, 4), mass=MassAware(suppress_small=True, suppressed_percent=0.05))
    rows = score_masses(summarize_islands(m, label_islands(m, config)), config).where("suppressed").collect()
    assert {r["id"] for r in rows} == gone


def test_one_way_neighbours_label_like_a_flood_fill(spark):
    m = mesh(spark, [square(0, 0, 0), square(2, 0, 0), square(4, 0, 0)], [(2, 3, 1), (1, 3, 0)])
    found = {r["poly_ref"]: r["island"] for r in label_islands(m, BuildConfig.of(3, 2, 4)).collect()}
    assert found == {1: 0, 2: 1, 3: 2}
    found = {r["poly_ref"]: r["island"] for r in label_islands(m, BuildConfig.of(3, 2, 4), symmetrize=True).collect()}
    assert set(found.values()) == {0}


def test_sparse_profile_builds(spark):
    result = build(apart(spark), BuildConfig.of(5, 4, 6, BuildProfile.SPARSE))
    assert result and result.stats["boundaries_representative"] <= result.stats["boundaries_deduplicated"]
    assert result.stats["recovery_queries"] == result.stats["boundaries_deduplicated"]


def test_derived_sizes():
    config = BuildConfig.of(20, 4, 15)
    assert config.extent == 20 and config.boundaries.dedup.cell(20) == 2.5 and config.vertical_window == 3.75
    assert config.density.local.cell(20) == 5 and config.density.overall.cell(20) == 10 and config.recovery_gap == 4
    assert not config.symmetric and BuildConfig.of(5, 5, 5).spherical


def test_budgets():
    b = Boundaries(representatives=Cells(True), least=0, most=8, mass_power=2)
    assert [b.budget(m, True, 9) for m in (0.25, 0.5, 0.75, 1)] == [0, 2, 4, 8]
    b = Boundaries(budget_scale=2)
    assert [b.budget(m, True, 100) for m in (0.25, 0.5, 1)] == [5, 10, 20]
    assert Reserve(True, 1, 5).budget(0.5, True) == 3 and Reserve(True, 1, 5).budget(0.5, False) == 5


GOOD = BuildConfig.of(3, 2, 4)
D = GOOD.density


@pytest.mark.parametrize(
    "bad",
    [
        replace(GOOD, gap=Gap(0, 2, 4)), replace(GOOD, gap=Gap(3, -1, 4)), replace(GOOD, gap=Gap(3, 2, float("nan"))),
        replace(GOOD, query=Query(max_nodes=0)), replace(GOOD, mass=MassAware(percentile=0)), replace(GOOD, mass=MassAware(suppressed_percent=1.0)),
        replace(GOOD, boundaries=replace(GOOD.boundaries, representatives=Cells(True), direction_buckets=0)),
        replace(GOOD, density=replace(D, vertical_ratio=1.01)), replace(GOOD, density=replace(D, vertical_ratio=0)),
        replace(GOOD, density=replace(D, pair_scan=Cells(True, -1.0))), replace(GOOD, density=replace(D, candidates=Cells(True, 0.0, 0.0))),
        replace(GOOD, density=replace(D, recovery=Cells(True, 0.0, 1.5))), replace(GOOD, density=replace(D, spanner=Spanner(True, 0.99))),
        replace(GOOD, density=replace(D, overall=GlobalPrune(True, low_radius_scale=0))), replace(GOOD, density=replace(D, reserve=Reserve(True, 3, 2))),
    ],
)
def test_bad_settings(bad):
    assert bad.problem() and GOOD.problem() is None and isinstance(D, Density)
