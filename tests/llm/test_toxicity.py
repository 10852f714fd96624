"""Positive-unlabelled learning against a plain version and held-out labels."""

import math
import random
import zlib

import numpy as np

from archipelago.llm import toxicity as tox

CLEAN = "alpha beta gamma delta river stone cloud apple chair table green north".split()
BAD = ["vile", "nasty", "böse", "rotten"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        bad = rnd.random() < 0.12
        w = [rnd.choice(CLEAN) for _ in range(rnd.randint(5, 60))]
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(BAD).capitalize() + rnd.choice(["", ",", "!"])
        out.append((d, " ".join(w), int(bad)))
    return out


def plain(rows, labels, prior, steps):
    """The whole of it with dense matrices and risks by name."""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in rows}
    sets = {d: tox.words(t) for d, t in rows}
    good = [d for d, y in labels if y == 1 and not held[d]]
    count = {w: sum(w in sets[d] for d in good) for w in set().union(*(sets[d] for d in good))}
    names = sorted((w for w in count if count[w] >= 2), key=lambda w: (-count[w], w))
    every = np.array([sum(w in s for s in sets.values()) for w in names], float)
    keep = [names[k] for k in tox.telling(np.array([count[w] for w in names], float), len(good), every, len(rows))]
    x = {d: np.array([float(w in sets[d]) for w in keep] + [1.0]) for d, _ in rows}
    p, u = np.array([x[d] for d in good]), np.array([x[d] for d, _ in rows if not held[d]])
    w = np.append(np.zeros(len(keep)), -2.0)
    m = v = np.zeros(len(w))
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        risk_unl, risk_neg = np.log1p(np.exp(u @ w)).mean(), prior * np.log1p(np.exp(p @ w)).mean()
        below = (u * su[:, None]).mean(0) - prior * (p * sp[:, None]).mean(0)
        g = prior * (p * (sp - 1)[:, None]).mean(0) + below if risk_unl >= risk_neg else -below
        g = g + tox.L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - tox.RATE * (0.5 + 0.5 * math.cos(math.pi * t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {d: (held[d], float(1 / (1 + np.exp(-x[d] @ w)))) for d, _ in rows}


def test_one_shard_equals_the_plain_version(spark):
    made = texts(600)
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string").repartition(3)
    labels = [(d, y) for d, _, y in made if d % 2 == 0]
    got = {r["doc_id"]: (r["held_out"], r["score"]) for r in tox.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), prior=0.12, steps=40, rounds=1).collect()}
    want = plain([(d, t) for d, t, _ in made], labels, 0.12, 40)
    assert got.keys() == want.keys()
    for d, (held, score) in want.items():
        assert got[d][0] == held and abs(got[d][1] - score) < 1e-4


def test_held_out_labels_over_shards(spark):
    made = texts(3000, seed=2)
    docs = spark.createDataFrame([(d, t) for d, t, _ in made], "doc_id long, text string")
    # labels of held-out documents are wrong: they may not be read
    labels = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in made if d % 2 == 0]
    truth = {d: y for d, _, y in made}
    rows = tox.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), shard=700).collect()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"]]
    assert len(rows) == 3000 and 450 < len(held) < 750
    assert np.mean([p for p, y in held if y]) > 0.95 and np.mean([p for p, y in held if not y]) < 0.02


def test_the_risk_never_pays_for_going_below_nought():
    sets = [np.array([k % 40]) for k in range(40)]  # every example has a word of its own
    unlabelled = tox.Rows.of([np.array([k]) for k in range(40)] + [np.empty(0, int)], [1] * 40 + [60])
    w = tox.fit_nnpu(tox.Rows.of(sets, np.ones(40)), unlabelled, 40, prior=0.6, steps=300)
    f = unlabelled.scores(w)
    assert np.isfinite(w).all() and np.abs(f).max() < 40


def test_odd_rows(spark):
    rows = [(1, "vile vile", "x"), (1, "vile", "x"), (2, None, None), (3, "", "y"), (None, "vile stone", "z"), (4, "stone " * 200_000 + "vile", "x"), (6, "x" * 3_000_000, "x"), *[(10 + k, "vile stone" if k % 3 == 0 else "stone river", "s") for k in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 0, "b"), (2, None, "c"), (None, 1, "d"), (999, 1, "e"), *[(10 + k, int(k % 3 == 0), "t") for k in range(60)]], "doc_id long, toxic int, text string")
    out = tox.toxicity(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [True]
    base = {round(r["score"], 12) for r in out if r["doc_id"] in (2, 3)}
    assert len(base) == 1
    assert all(r["predicted"] == 1 for r in out if r["doc_id"] in (1, 4, None))
    none = tox.toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert tox.toxicity(docs.limit(0), labels).collect() == [] and len(tox.toxicity(docs, labels.limit(0)).collect()) == len(rows)


def test_an_example_of_many_rows_counts_once(spark):
    made = [(d, t) for d, t, _ in texts(200)]
    many = spark.createDataFrame(made, "doc_id long, text string").unionByName(spark.range(20_000).selectExpr("0L AS doc_id", "concat('vile ', id) AS text"))
    labels = spark.createDataFrame([(d, y) for d, _, y in texts(200)] + [(0, 1)], "doc_id long, toxic int")
    assert tox.toxicity(many, labels, shard=3000).count() == 20_200
