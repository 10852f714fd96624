"""Strong components against a plain depth-first version."""

import random

import pytest

from archipelago.operators import strong


def plain(links):
    out, nodes = {}, {n for e in links for n in e}
    step = {n: {b for a, b in links if a == n} for n in nodes}

    def reach(n):
        seen, left = set(), [n]
        while left:
            for m in step[left.pop()]:
                if m not in seen:
                    seen.add(m)
                    left.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    for n in nodes:
        own = {m for m in far[n] if n in far[m]} | {n}
        if len(own) > 1:
            out[n] = min(own)
    return out


def found(spark, links):
    rows = strong.strongly_connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["component"] for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([8, 14, 25])
    links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(int(n * rnd.choice([0.9, 1.2, 1.6, 2.4])))]
    for k in range(rnd.randint(0, 3)):  # rings with tails and trees, one way and both
        ring = [100 * (k + 1) + j for j in rnd.sample(range(20), rnd.randint(2, 7))]
        links += list(zip(ring, ring[1:] + ring[:1], strict=True)) + [(rnd.choice(ring), rnd.randrange(n)), (rnd.randrange(n), rnd.choice(ring))][: rnd.randint(0, 2)]
        tail = [ring[0], *range(1000 * (k + 1), 1000 * (k + 1) + 4)]
        links += list(zip(tail, tail[1:], strict=False)) + ([(tail[2], ring[-1])] if rnd.random() < 0.5 else [])
    assert found(spark, links) == plain(links)


def test_a_core_that_nothing_folds_is_coloured(spark):
    # every node has several links in and out, none both ways
    links = [(k, (k + d) % 9) for k in range(9) for d in (1, 2)] + [(20 + k, 20 + (k + d) % 7) for k in range(7) for d in (1, 3)] + [(3, 20), (4, 25), (5, 22)]
    assert found(spark, links) == plain(links)


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    real = strong.store
    monkeypatch.setattr(strong, "store", lambda df, name: rounds.append(name) or real(df, name))
    order = random.Random(1).sample(range(n), n)
    chain = list(zip(order, order[1:], strict=False))
    assert found(spark, chain) == {}
    assert len(rounds) < 40
    rounds.clear()
    assert found(spark, [*chain, (order[-1], order[0])]) == dict.fromkeys(range(n), 0)
    assert len(rounds) < 40


def test_odd_links(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 1), (None, 2), (2, None), (3, 4), (3, 4)]) == {}
    assert found(spark, [(5, 4), (4, 5), (4, 5)]) == {4: 4, 5: 4}
