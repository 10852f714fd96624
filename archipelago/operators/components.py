"""Connected components.

:func:`connected_components` alternates large-star and small-star (Kiveris et al.,
"Connected Components in MapReduce and Beyond", SoCC 2014).
:func:`contracted_components` hooks and contracts, so that links get few soon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.storage import drop, store

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("m").alias("a"), "b")
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour below a node, and itself, to the least of them.

    ``edges`` point upwards (a < b), so a node's lower neighbours are the rows
    that end in it.
    """
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return (
        joined.select(F.col("m").alias("x"), F.col("a").alias("y"))
        .unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        .where("x <> y")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A digest of the edge set; equal digests mean that nothing moved."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(pmod(xxhash64(b, a), 1073741824) as bigint))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``edges(a, b)``.

    ``component`` is the least id that the node reaches, itself included.  Ids
    may be of any type that Spark can order.  Rows with a null end and self
    links carry no link and are ignored; a graph without links gives no rows.
    Hub nodes are only ever met by joins on their key, which adaptive execution
    can split, and by minima, which are combined before the shuffle.
    """
    now = store(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = _mark(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        large = store(_large_star(now), "large-star")
        after = store(_small_star(large), "small-star")
        drop(now)
        drop(large)
        now, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    )


def _to_roots(hung: DataFrame) -> DataFrame:
    """``hung(id, up)`` with ``up`` at the end of the way up, by pointer doubling."""
    for _ in range(MAX_ROUNDS):
        above = hung.select(F.col("id").alias("up"), F.col("up").alias("over"))
        after = store(hung.select("id", "up").join(above, "up", "left").select("id", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")), "hung")
        drop(hung)
        hung = after
        if not hung.where("moved").head(1):
            return hung
    raise RuntimeError(f"ways up did not end in {MAX_ROUNDS} rounds")


def contracted_components(pairs: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``pairs(a, b)``, each with ``a < b`` and
    there once; ``component`` is the least id of the node's component.

    Every node hangs itself below its least neighbour if that is less, so only nodes
    less than all around them stay; ways up are shortened by doubling.  Links are
    then moved to the ends' roots, and those inside a tree go, so a round leaves
    those between trees: at most half the nodes stay, on meshes far fewer.  Only
    nodes are shuffled in the doubling.
    """
    left, forest = store(pairs.select("a", "b"), "pairs"), None
    for _ in range(MAX_ROUNDS):
        if not left.head(1):
            break
        hung = _to_roots(store(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "hung"))
        top = hung.select("id", F.col("up").alias("root"))
        ends = left.join(top.withColumnRenamed("id", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        ends = ends.join(top.withColumnRenamed("id", "b"), "b").select("a", F.col("root").alias("b")).where("a <> b")
        after = store(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        drop(left)
        left = after
        if forest is not None:
            moved = forest.join(top.withColumnRenamed("id", "up"), "up", "left").select("id", F.coalesce("root", "up").alias("up"))
            hung = store(moved.unionByName(hung.select("id", "up")), "forest")
        forest = hung.select("id", "up")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    if forest is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return forest.select("id", F.col("up").alias("component")).unionByName(forest.select(F.col("up").alias("id"), F.col("up").alias("component")).distinct())
