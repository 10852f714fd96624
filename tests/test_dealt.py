from dataclasses import replace

from pyspark.sql import functions as F

from archipelago.operators import ranking, spatial
from archipelago.operators.candidates import LINK, dedup_candidates, suppress_pairs
from archipelago.operators.ranking import numbered
from archipelago.operators.spatial import box_join
from archipelago.plans.config import BuildConfig, Cells


def parts(df):
    return df.rdd.getNumPartitions()


def made(spark, n):
    at = F.col("id").cast("double")
    rows = spark.range(n).select((F.col("id") % 7).alias("from_island"), (F.col("id") % 7 + 1).alias("to_island"), *[at.alias(f"{p}{k}") for p in "st" for k in "xyz"])
    rows = rows.withColumns({"horizontal": F.lit(1.0), "vertical": F.lit(0.0), "poly_ref": F.col("sx").cast("long"), "ord": F.col("sx").cast("long"), "edge_no": F.lit(0), "accepted": F.lit(True)})
    islands = spark.range(9).select("id", F.lit(0.0).alias("mass_score"), F.lit(True).alias("outbound"))
    return rows, islands


def test_tasks_of_links_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 100)
    config = BuildConfig.of(5, 4, 6)
    config = replace(config, density=replace(config.density, candidates=Cells(True, 0.5), pair_scan=Cells(True, 0.5)))
    for n in (300, 3000):
        rows, islands = made(spark, n)
        best = dedup_candidates(rows.select(*LINK), islands, config)
        kept, _ = suppress_pairs(rows, islands, config)
        placed = numbered(rows, [F.col("sx")], "place", n=n)
        assert best.count() == kept.count() == n and [r["place"] for r in placed.orderBy("sx").collect()] == list(range(1, n + 1))
        assert parts(best) == parts(kept) == 1 + n // 100
        assert n // 100 <= parts(placed) <= 1 + n // 100


def test_tasks_of_the_box_join_follow_the_points(spark, monkeypatch):
    monkeypatch.setattr(spatial, "DEALT", 100)
    at = F.col("id").cast("double")
    boxes = spark.range(500).select(F.col("id").alias("box"), *[at.alias(f"{p}_{k}") for p in ("min", "max") for k in "xyz"])
    for n in (500, 5000):
        points = spark.range(n).select(F.col("id").alias("spot"), *[(at % 500).alias(f"m{k}") for k in "xyz"])
        met = box_join(points, boxes, (0.25, 0.25, 0.25))
        assert met.count() == n and parts(met) == 1 + n // 100
