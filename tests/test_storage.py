from pyspark.sql import functions as F

from archipelago import storage
from archipelago.llm import storage as text_storage
from archipelago.sources.mesh import terrace_grid


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_in_a_small_file_are_not_broadcast(spark):
    rows = storage.store(spark.range(300_000).select(F.col("id").alias("rank"), F.lit(0).alias("state")), "state")
    assert storage.SMALL < storage._size(spark, rows._stored_at) < 10 << 20
    todo, met = rows.where("state = 0").select("rank"), rows.groupBy("rank").agg(F.max("state").alias("out"))
    links = spark.range(400_000).withColumnRenamed("id", "rank")
    for other, how in ((todo, "left_semi"), (met, "left")):
        assert "Broadcast" not in plan(links.join(other, "rank", how)) and "SortMergeJoin" in plan(links.join(other, "rank", how))
    assert links.join(todo, "rank", "left_semi").count() == 300_000


def test_small_tables_and_those_of_the_text_operators_are_left_to_the_optimizer(spark):
    few, many = storage.store(spark.range(100), "few"), text_storage.store(spark.range(300_000), "many")
    for df in (few, many):
        assert "hint" not in df._jdf.queryExecution().analyzed().toString().lower()
    storage.drop(few)
    assert not spark.sparkContext._jvm.java.io.File(few._stored_at.removeprefix("file:")).exists()


def test_cells_of_a_large_grid_are_not_broadcast_to_find_neighbours(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part"))
    assert "Broadcast" not in plan(terrace_grid(spark.read.parquet(str(tmp_path / "part"))).poly_edges)
