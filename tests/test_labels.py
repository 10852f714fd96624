"""Labels and components against plain searches."""

import random

import pytest
from helpers import mesh, square

from archipelago.operators import components as C
from archipelago.operators.islands import label_islands
from archipelago.plans.config import BuildConfig


def flood(n, joins, fit, symmetrize):
    step = {k: set() for k in range(n)}
    for p, _, q in joins:
        if p in fit and q in fit:
            step[p].add(q)
            if symmetrize:
                step[q].add(p)
    island, count = {}, 0
    for k in range(n):
        if k in fit and k not in island:
            left = [k]
            island[k] = count
            while left:
                for m in step[left.pop()] - island.keys():
                    island[m] = count
                    left.append(m)
            count += 1
    return {k + 1: v for k, v in island.items()}


@pytest.mark.parametrize("seed", range(4))
def test_one_way_and_two_way_neighbours(spark, seed):
    rnd = random.Random(seed)
    n = 40
    joins = {}
    for _ in range(rnd.choice([15, 30, 45])):
        a, b = rnd.sample(range(n), 2)
        joins[a, rnd.randrange(4)] = b
        if rnd.random() < 0.5:
            joins[b, rnd.randrange(4)] = a
    rows = [(p, e, q) for (p, e), q in joins.items()]
    flags = [rnd.choice([1, 1, 1, 2]) for _ in range(n)]
    m = mesh(spark, [square(3 * k, 0, 0) for k in range(n)], rows, flags)
    config = BuildConfig.of(3, 2, 4)
    fit = {k for k in range(n) if flags[k] & config.query.include_flags and not flags[k] & config.query.exclude_flags}
    for symmetrize in (False, True):
        assert {r["poly_ref"]: r["island"] for r in label_islands(m, config, symmetrize).collect()} == flood(n, rows, fit, symmetrize)


def test_contraction_equals_alternating_stars_and_links_fall(spark, monkeypatch):
    rnd = random.Random(7)
    side = 40
    name = rnd.sample(range(10 * side * side), side * side)
    at = lambda r, c: name[r * side + c]
    pairs = [(at(r, c), at(*o)) for r in range(side) for c in range(side) for o in ((r, c + 1), (r + 1, c)) if o[0] < side and o[1] < side and rnd.random() < 0.7]
    table = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    sizes, real = [], C.store
    monkeypatch.setattr(C, "store", lambda df, name: sizes.append(real(df, name)) or sizes[-1] if name == "pairs" else real(df, name))
    found = sorted(map(tuple, C.contracted_components(table).collect()))
    assert found == sorted(map(tuple, C.connected_components(table).collect()))
    assert C.contracted_components(table.limit(0)).collect() == []
    assert len(sizes) < 10


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], C.store
    monkeypatch.setattr(C, "store", lambda df, name: rounds.append(name) or real(df, name))
    for order in (list(range(4000)), random.Random(1).sample(range(4000), 4000)):
        rounds.clear()
        table = spark.createDataFrame([(min(p), max(p)) for p in zip(order, order[1:], strict=False)], "a long, b long")
        assert {r["component"] for r in C.contracted_components(table).collect()} == {0}
        assert len(rounds) < 60  # rounds of contraction, each with its doubling
