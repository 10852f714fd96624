from dataclasses import replace

import pytest
from helpers import islands

from archipelago.functions.scalars import direction_bucket, millimetres, quantize
from archipelago.operators.boundaries import COLUMNS, select_representatives
from archipelago.plans.config import BuildConfig, Cells, MassAware
from pyspark.sql import functions as F


def segments(spark, rows):
    """``rows``: (island, polygon, length, midpoint), along x."""
    made = [(i, p, 0, p, m[0] - n / 2, m[1], m[2], m[0] + n / 2, m[1], m[2], *m) for i, p, n, m in rows]
    kinds = ["bigint", "bigint", "int", "bigint"] + ["double"] * 9
    return spark.createDataFrame([tuple(float(v) if k > 3 else v for k, v in enumerate(r)) for r in made], ", ".join(f"{c} {k}" for c, k in zip(COLUMNS, kinds, strict=True)))


def config(cell, most=0, least=0, aware=False):
    base = BuildConfig.of(8, 8, 8)
    return replace(base, boundaries=replace(base.boundaries, representatives=Cells(True, float(cell)), most=most, least=least), mass=MassAware(enabled=aware))


def test_layers_stay_apart(spark):
    rows = segments(spark, [(0, 1, 4, (2, 0, 0)), (0, 2, 4, (2, 6, 0)), (0, 3, 4, (2, 0, 6))])
    assert select_representatives(rows, islands(spark, [0]), config(4)).count() == 3


def test_budget_keeps_an_even_spread(spark):
    rows = segments(spark, [(0, 1, 2, (1, 0, 0)), (0, 2, 4, (6, 0, 0)), (0, 3, 6, (13, 0, 0)), (1, 4, 2, (1, 0, 0))])
    kept = {r["poly_ref"] for r in select_representatives(rows, islands(spark, [0, 0]), config(1, most=2)).collect()}
    assert kept == {1, 3, 4}


def test_budget_by_mass(spark):
    rows = segments(spark, [(i, 10 * i + k, 2, (5 * k, 0, 0)) for i in range(3) for k in range(4)])
    kept = select_representatives(rows, islands(spark, [0, 0.5, 1]), config(1, most=4, least=1, aware=True)).groupBy("island").count()
    assert {r["island"]: r["count"] for r in kept.collect()} == {0: 1, 1: 2, 2: 4}


@pytest.mark.parametrize("dx,dz,want", [(1, 0, 0), (0, 1, 2), (-1, 0, 4), (0, -1, 6), (9, 0, 0)])
def test_directions(spark, dx, dz, want):
    assert spark.range(1).select(direction_bucket(F.lit(float(dx)), F.lit(float(dz)), 8)).first()[0] == want


def test_scalars(spark):
    row = spark.range(1).select(
        quantize(F.lit(-0.1), 1), quantize(F.lit(float("inf")), 1), quantize(F.lit(float("nan")), 1), millimetres(F.lit(0.0025)), millimetres(F.lit(-0.0025)), millimetres(F.lit(float("nan")))
    ).first()
    assert tuple(row) == (-1, 0, 0, 3, -3, 0)
