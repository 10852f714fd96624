"""Connected components for the text operators.

:func:`connected_components` (alternating stars) comes from the engine.
:func:`union_find` is the distributed union-find of the line operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store
from archipelago.operators.components import connected_components

__all__ = ["connected_components", "union_find"]

MAX_ROUNDS = 60


def _compressed(parent: DataFrame) -> DataFrame:
    """Find: every node of ``parent(id, up)`` points to its root.

    Paths halve in each round.  A node that is nobody's child is a root.
    """
    for _ in range(MAX_ROUNDS):
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        after = store(parent.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "parents")
        moved = after.where("moved").head(1)
        drop(parent)
        parent = after.select("id", "up")
        parent._stored_at = after._stored_at
        if not moved:
            return parent
    raise RuntimeError(f"paths did not end in {MAX_ROUNDS} rounds")


def union_find(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node of ``edges(a, b)``, by least id.

    Union: each root that an edge joins to lesser roots hangs itself below the
    least of them, so no cycle can arise; all roots do so at once.  Find: the
    paths that this makes are compressed by pointer jumping.  Then edges are
    rewritten to the roots of their ends, those inside a tree go, and the rest
    are united in the next round.  Every root but the locally least ones goes in
    a round.  Minima are combined before they are shuffled, so a root that a
    third of all edges meet costs each task one row.

    Rows with a null end and self links are ignored.
    """
    left = store(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "unions"
    )
    forest = None
    for _ in range(MAX_ROUNDS):
        if not left.head(1):
            break
        hung = _compressed(store(left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), "hung"))
        root = hung.withColumnRenamed("up", "root")
        ends = left.join(root.withColumnRenamed("id", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        ends = ends.join(root.withColumnRenamed("id", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b")).where("a <> b")
        after = store(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "unions")
        if forest is None:
            forest = hung
        else:
            # nodes whose root was hung follow it
            moved = forest.join(root.select(F.col("id").alias("up"), "root"), "up", "left").select("id", F.coalesce("root", "up").alias("up"))
            grown = store(moved.unionByName(hung), "forest")
            drop(forest)
            drop(hung)
            forest = grown
        drop(left)
        left = after
    else:
        raise RuntimeError(f"unions did not settle in {MAX_ROUNDS} rounds")
    if forest is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = forest.select("id", F.col("up").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())
