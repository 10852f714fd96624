"""Numbering and running totals in an order, without bringing rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.storage import store


#: Rows that a task of :func:`dealt` gets, and one of a numbering whose rows are counted.
ROWS = 100_000


def tasks_for(n: int) -> int:
    return 1 + n // ROWS


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, ``n`` in number, partitioned by ``keys`` for a grouping by them in as
    many tasks as that number asks for.

    Rows picked by ``min_by`` of a struct are sorted by their group, on both sides
    of a shuffle, and adaptive execution sizes tasks by compressed bytes.  Here there
    is one sort, of some ``ROWS`` rows; a larger group is sorted as a whole.
    """
    return rows.repartition(tasks_for(n), *keys)


def numbered(rows: DataFrame, order: list[Column], name: str, first: int = 1, n: int | None = None) -> DataFrame:
    """``rows`` with their place in ``order`` in the column ``name``.

    Rows are range partitioned and written, so that the partitions stay as they
    are; each is numbered on its own, and one count per partition tells where
    it begins.  ``n``, the number of rows where it is known, sets the number of ranges.
    """
    ranges = rows.repartitionByRange(*order) if n is None else rows.repartitionByRange(tasks_for(n), *order)
    parts = store(ranges.withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    begins, total = [], first
    for part in sorted(counts):
        begins.append((part, total))
        total += counts[part]
    begins = rows.sparkSession.createDataFrame(begins, "_part int, _begin long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    parts = parts.repartition(max(1, len(counts)), "_part")
    return parts.withColumn("_place", place).join(F.broadcast(begins), "_part").withColumn(name, F.col("_begin") + F.col("_place")).drop("_part", "_place", "_begin")


def running(rows: DataFrame, group: list[str], order: list[Column], place: str | None = None, sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with totals from the first row of their group up to themselves.

    ``place`` names the row's place in its group, from 1; ``sums`` and ``xors``
    name running sums and exclusive ors of columns.  ``order`` has to tell rows
    of a group apart, or those that it does not must be alike.

    Rows are range partitioned by group and order, so a group of any size lies in
    as many partitions as it needs.  Each partition adds up its own part of a
    group; only the last group of a partition can go on in the next one, so what
    it brings along is a row per partition, added up on the driver.
    """
    sums, xors = sums or {}, xors or {}
    parts = store(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    key = F.struct(*group)
    per_group = parts.groupBy("_part", *group).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{n}") for n, c in sums.items()], *[F.bit_xor(c).alias(f"_{n}") for n, c in xors.items()])
    names = ["_n", *[f"_{n}" for n in (*sums, *xors)]]
    ends = per_group.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(F.struct(*names), key).alias("total"))
    brought, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        now = dict.fromkeys(names, 0)
        if before is not None and before[0] == r["first"]:
            now = before[1]
            brought.append((r["_part"], *r["first"], *[now[n] for n in names]))
        if r["first"] != r["last"]:
            now = dict.fromkeys(names, 0)
        add = {n: r["total"][n] or 0 for n in names}
        before = r["last"], {n: now[n] ^ add[n] if n[1:] in xors else now[n] + add[n] for n in names}
    types = dict(per_group.dtypes)
    begins = rows.sparkSession.createDataFrame(brought, ", ".join(["_to int", *[f"`_g_{g}` {types[g]}" for g in group], *[f"`_b{n}` {types[n]}" for n in names]]))
    upto = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumns({"_n": F.row_number().over(upto).cast("long")} | {f"_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"_{n}": F.bit_xor(c).over(upto) for n, c in xors.items()})
    same = F.col("_part") == F.col("_to")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(F.broadcast(begins), same, "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    out = {n: zero(f"_{n}") + zero(f"_b_{n}") for n in sums} | {n: zero(f"_{n}").bitwiseXOR(zero(f"_b_{n}")) for n in xors}
    if place:
        out[place] = F.col("_n") + zero("_b_n")
    return joined.select(*rows.columns, *[c.alias(n) for n, c in out.items()])
