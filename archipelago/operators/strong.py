"""Strong components in few rounds: contraction first, colouring of what is left.

Three steps take turns, as long as they make the graph much smaller:

* nodes with links both ways are one component; connected components over such
  links are found and merged;
* a node that no link enters, or none leaves, is a component of its own and goes;
* a node that a single link enters can only be in a cycle with that link's source.
  So trees of such nodes are folded into their root by pointer doubling, a ring
  into its least node; then the same against the links' direction.

Each is a number of rounds that grows with the logarithm of paths, trees and rings,
not with their length.  What has neither (every node with several links in and
out, none both ways) is coloured: every node gets the least id that reaches it, and
those that the owner of a colour can be reached from inside the colour are its
component.

The folded come back in reverse order: a node of a tree is in its root's component
if it or one below it has a link into that component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.operators.components import connected_components
from archipelago.storage import drop, store

#: Contraction goes on while a turn leaves less than this share of the links.
WORTH = 0.8


def _mapped(rows: DataFrame, name: str, to: DataFrame) -> DataFrame:
    """``rows`` with ids in the column ``name`` replaced as ``to(id, new)`` says."""
    found = rows.join(to.select(F.col("id").alias(name), "new"), name, "left")
    return found.withColumn(name, F.coalesce("new", name)).drop("new")


def _turned(links: DataFrame) -> DataFrame:
    return links.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _both_ways(links: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Links between the components of links that go both ways, and those."""
    both = store(links.join(_turned(links), ["a", "b"], "left_semi"), "both-ways")
    if not both.head(1):
        return None
    found = store(connected_components(both).withColumnRenamed("component", "new"), "merged")
    drop(both)
    left = _mapped(_mapped(links, "a", found), "b", found).where("a <> b").select("a", "b").distinct()
    return store(left, "links"), found


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose ends both have a link in and one out."""
    inner = store(links.select(F.col("a").alias("id")).intersect(links.select(F.col("b").alias("id"))), "inner")
    return store(links.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "links")


def _folded(links: DataFrame) -> tuple[DataFrame, tuple] | None:
    """Links with the trees of nodes of one link in folded into their roots, and
    what is needed to unfold them: jumps of doubling length, ``id, root`` and the
    links ``id, root, goal`` that leave a tree."""
    sole = links.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("up")).where("n = 1")
    now = store(sole.select(F.col("b").alias("id"), F.col("up").alias("to"), F.col("b").alias("low"), F.lit(True).alias("moved")), "jumps")
    n = now.count()
    if not n:
        return None
    jumps = [now]
    while len(jumps) <= n.bit_length():
        above = now.select(F.col("id").alias("to"), F.col("to").alias("over"), F.col("low").alias("under"))
        now = now.drop("moved").join(above, "to", "left")
        now = store(now.select("id", F.coalesce("over", "to").alias("to"), F.least("low", "under").alias("low"), F.col("over").isNotNull().alias("moved")), "jumps")
        if not now.where("moved").head(1):
            break
        jumps.append(now)
    # still in the air: on a ring or below one, whose least node is its root
    ring = now.select(F.col("id").alias("to"), F.col("low").alias("ring"))
    tree = store(now.join(ring, "to", "left").select("id", F.coalesce("ring", "to").alias("root")).where("id <> root"), "trees")
    out = links.join(tree.select(F.col("id").alias("b")), "b", "left_anti").join(tree.select(F.col("id").alias("a"), "root"), "a", "left")
    out = store(out.select(F.col("a").alias("id"), F.coalesce("root", "a").alias("root"), F.col("b").alias("goal")), "leaving")
    left = out.select(F.col("root").alias("a"), F.col("goal").alias("b")).where("a <> b").distinct()
    return store(left, "links"), (jumps, tree, out.where("id <> root"))


def _unfolded(found: DataFrame, jumps: list[DataFrame], tree: DataFrame, leaving: DataFrame) -> DataFrame | None:
    """The nodes of trees that are in their root's component."""
    ends = _mapped(_mapped(leaving, "root", found), "goal", found).where("root = goal")
    marked = store(ends.select("id").distinct(), "marked")
    if not marked.head(1):
        return None
    for k, jump in enumerate(jumps):
        marked = marked.unionByName(marked.join(jump, "id").select(F.col("to").alias("id"))).distinct()
        if k % 4 == 3:
            marked = store(marked, "marked")
    back = tree.join(marked, "id", "left_semi").select("id", F.col("root").alias("new"))
    return store(_renamed(back, found), "unfolded")


def _renamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows(id, new)`` with ``new`` replaced as ``found(id, new)`` says."""
    top = found.select(F.col("id").alias("new"), F.col("new").alias("top"))
    return rows.join(top, "new", "left").select("id", F.coalesce("top", "new").alias("new"))


def _spread(marks: DataFrame, links: DataFrame) -> DataFrame:
    """The least mark that reaches each node along the links."""
    now, total = store(marks, "marks"), None
    while True:
        met = links.join(now.select(F.col("id").alias("a"), "mark"), "a").groupBy(F.col("b").alias("id")).agg(F.min("mark").alias("met"))
        after = store(now.join(met, "id", "left").select("id", F.least("mark", "met").alias("mark")), "marks")
        mark = tuple(after.agg(F.sum("mark"), F.count("mark")).first())
        drop(now)
        now = after
        if mark == total:
            return now
        total = mark


def _coloured(links: DataFrame) -> list[DataFrame]:
    """``id, new`` of the nodes of components that colours find, a table a round."""
    done = []
    while links.head(1):
        nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        colour = _spread(nodes.select("id", F.col("id").alias("mark")), links)
        of = lambda n: colour.select(F.col("id").alias(n), F.col("mark").alias(f"c_{n}"))
        same = links.join(of("a"), "a").join(of("b"), "b").where("c_a = c_b")
        back = store(_turned(same), "backward")
        start = colour.select("id", F.when(F.col("id") == F.col("mark"), F.col("mark")).alias("mark"))
        part = store(_spread(start, back).where("mark IS NOT NULL").select("id", F.col("mark").alias("new")), "strong")
        done.append(part)
        rest = links.join(part.select(F.col("id").alias("a")), "a", "left_anti").join(part.select(F.col("id").alias("b")), "b", "left_anti")
        links = _trimmed(store(rest.select("a", "b"), "links"))
    return done


def strongly_connected(links: DataFrame) -> DataFrame:
    """``id, component`` of the nodes of ``links(a, b)`` that are in a component of
    two nodes or more, named by its least id.  Rows with a null end are ignored."""
    links = store(links.where("a <> b").select("a", "b").distinct(), "links")
    folds, size = [], links.count()
    while size:
        merged = _both_ways(links)
        if merged:
            links, found = merged
            folds.append((found,))
        links = _trimmed(links)
        for turn in (False, True):
            fold = _folded(_turned(links) if turn else links)
            if fold:
                links = _turned(fold[0]) if turn else fold[0]
                folds.append(fold[1])
        before, size = size, links.count()
        if size > WORTH * before:
            break
    parts = _coloured(links) if size else []
    found = links.select(F.col("a").alias("id"), F.col("b").alias("new")).limit(0)
    for part in parts:
        found = found.unionByName(part)
    for fold in reversed(folds):
        more = _renamed(fold[0], found) if len(fold) == 1 else _unfolded(found, *fold)
        if more is not None:
            found = store(found.unionByName(more).distinct(), "found")
    least = found.groupBy("new").agg(F.min("id").alias("least"))
    named = found.unionByName(found.select(F.col("new").alias("id"), "new")).distinct().join(least, "new")
    return named.select("id", F.least("least", "new").alias("component"))
