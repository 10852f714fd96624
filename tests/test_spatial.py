import random

import pytest
from pyspark.sql import functions as F

from archipelago.operators import spatial
from archipelago.operators.spatial import box_cells, box_join

BOX = "box long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"


def made(seed, boxes=120, points=700):
    rnd = random.Random(seed)
    out = []
    for k in range(boxes):
        w, d = (rnd.choice([0, 1, 3, 40, 600, 10_000]) * rnd.random() for _ in "xz")
        x, y, z = rnd.uniform(-9000, 9000), rnd.uniform(-20, 20), rnd.uniform(-9000, 9000)
        if k % 3 == 0:
            x, z = rnd.uniform(-30, 30), rnd.uniform(-30, 30)
        out.append((k, x, y, z, x + w, y + rnd.uniform(0, 3), z + d))
    out += [(1000, 0.0, 0.0, 0.0, 10_000.0, 1.0, 10_000.0), (1001, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    spots = [(k, *(rnd.choice([rnd.uniform(-30, 30), rnd.uniform(-9000, 9000), float(rnd.randint(-3, 3))]) for _ in "xyz")) for k in range(points)]
    return out, spots


def near(p, b, reach):
    return all(b[1 + k] - reach[k] <= p[1 + k] <= b[4 + k] + reach[k] for k in range(3))


@pytest.mark.parametrize("seed,reach,crowd", [(1, (2.0, 30.0, 2.0), 50_000), (2, (0.0, 9000.0, 0.0), 20), (3, (5.0, 5.0, 1.0), 7)])
def test_boxes_of_all_sizes_equal_brute_force(spark, monkeypatch, seed, reach, crowd):
    monkeypatch.setattr(spatial, "CROWD", crowd)
    boxes, spots = made(seed)
    b, p = spark.createDataFrame(boxes, BOX), spark.createDataFrame(spots, "spot long, mx double, my double, mz double")
    got = [(r["spot"], r["box"]) for r in box_join(p, b, reach).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(s[0], x[0]) for s in spots for x in boxes if near(s, x, reach)}
    odd = box_join(p, b, reach, where=(F.col("spot") + F.col("box")) % 2 == 1)
    assert {(r["spot"], r["box"]) for r in odd.collect()} == {g for g in set(got) if sum(g) % 2}


def test_a_box_touches_four_cells_at_most(spark):
    boxes, _ = made(4, boxes=400)
    cells = box_cells(spark.createDataFrame(boxes, BOX), (3.0, 1.0, 3.0)).groupBy("box").agg(F.count("*").alias("n"), F.min("level").alias("level"))
    rows = {r["box"]: (r["n"], r["level"]) for r in cells.collect()}
    assert len(rows) == len(boxes) and max(n for n, _ in rows.values()) <= 4
    assert rows[1001][1] == 0 and rows[1000][1] >= 10


def test_boxes_and_points_that_are_not_finite_meet_nothing(spark):
    nan, inf = float("nan"), float("inf")
    boxes = [(1, 0.0, 0.0, 0.0, nan, 1.0, 1.0), (2, -inf, 0.0, 0.0, 1.0, 1.0, 1.0), (3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    b, p = spark.createDataFrame(boxes, BOX), spark.createDataFrame([(1, 0.5, 0.5, 0.5)], "spot long, mx double, my double, mz double")
    assert [r["box"] for r in box_join(p, b, (1.0, 1.0, 1.0)).collect()] == [3]
    assert box_join(p, b.limit(0), (1.0, 1.0, 1.0)).collect() == [] and box_join(p.limit(0), b, (1.0, 1.0, 1.0)).collect() == []
