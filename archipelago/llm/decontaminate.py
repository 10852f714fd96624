"""Benchmark decontamination with a distributed positional index (operator 9).

The index keeps, for every pair of neighbouring words that a benchmark item
has, the positions of the pair in every whole training text (a next-word index;
pairs that no item has cannot take part in a match).  It is written once to the
shared folder, in the order of the texts, without a shuffle.

A query starts from the rarest pair of each window of an item: its postings,
moved back by the pair's offset, say where in which text the item would have to
lie.  The other pairs' postings are intersected with those places only, from
the stored index.  A run of matching pairs as long as a window is a phrase
match; enough matching pairs within a distance are a proximity match.

The benchmark's pairs, anchors and texts are sent to all executors only while
its items have at most ``BROADCAST_PAIRS`` pairs, each place counted; beyond
that the joins shuffle.

Defined results.  A null or empty text has no words and matches nothing.  An
item without words, or with a null id, is no item; items that share an id are
one item with several texts.  Repeated rows and repeated or null ``doc_id`` are
judged row by row.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.llm.storage import store

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_PAIRS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased and nothing else."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, GAP), "")


@dataclass(frozen=True)
class Index:
    """``postings(row, pos, pair)``, ``docs(row, doc_id, n_words)`` and the
    items' pairs ``item_pairs(item, text, n, p, pair, df)``."""

    postings: DataFrame
    docs: DataFrame
    item_pairs: DataFrame
    small: bool

    def to_all(self, df: DataFrame) -> DataFrame:
        """``df``, no longer than the items' pairs, for a join with postings."""
        return F.broadcast(df) if self.small else df


def build_index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """Write the index of ``docs`` for the pairs that ``benchmark`` has.

    An item of one word is looked up as that word, with no next word.
    """
    items = (
        benchmark.where("item_id IS NOT NULL")
        .select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .distinct()
        .select("item", F.monotonically_increasing_id().alias("text"), F.size("w").alias("n"), "w")
    )
    items = store(items, "items")
    last = F.greatest(F.size("w") - 2, F.lit(0))
    pairs = store(
        items.select("item", "text", "n", "w", F.explode(F.sequence(F.lit(0), last)).alias("p")).select(
            "item", "text", "n", "p", F.get("w", F.col("p")).alias("one"), F.get("w", F.col("p") + 1).alias("two")
        ),
        "item-pairs",
    )
    known = store(pairs.select("one", "two").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    # what is sent is the pairs at all their places in items, not each once
    small = pairs.count() <= BROADCAST_PAIRS
    alone = known.where("two IS NULL")
    # the row after the last word says how many words there are: pair -1
    two = known.where("two IS NOT NULL").unionByName(docs.sparkSession.range(1).select(F.lit("").alias("one"), F.lit("").alias("two"), F.lit(-1).cast("long").alias("pair")))

    tokens = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    ended = tokens.select("row", "doc_id", F.size("w").alias("n_words"), F.concat("w", F.array(F.lit(""))).alias("w"))
    both = F.arrays_zip(F.col("w").alias("one"), F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit(""))).alias("two"))
    each = ended.select("row", "doc_id", "n_words", F.posexplode(both).alias("pos", "x")).select(
        "row", "doc_id", "n_words", "pos", F.col("x.one").alias("one"), F.col("x.two").alias("two")
    )
    found = each.join(F.broadcast(two) if small else two, ["one", "two"])
    if alone.head(1):
        single = alone.select("one", F.col("pair").alias("pair_of_one"))
        found = each.join(F.broadcast(two) if small else two, ["one", "two"], "left").join(F.broadcast(single) if small else single, "one", "left")
        found = found.withColumn("pair", F.explode(F.array_compact(F.array("pair", "pair_of_one"))))
    stored = store(found.select("row", "doc_id", "n_words", "pos", "pair"), "postings")
    postings = stored.where("pair >= 0").select("row", "pos", "pair")
    df = postings.groupBy("pair").agg(F.count("*").alias("df"))
    placed = pairs.join(known, pairs["one"].eqNullSafe(known["one"]) & pairs["two"].eqNullSafe(known["two"])).select("item", "text", "n", "p", "pair")
    placed = store(placed.join(df, "pair", "left").select("item", "text", "n", "p", "pair", F.coalesce("df", F.lit(0)).alias("df")), "item-postings")
    return Index(postings, stored.where("pair = -1").select("row", "doc_id", "n_words"), placed, small)


def _anchors(index: Index, window: int) -> DataFrame:
    """The rarest pair of every window of every item's text."""
    long = F.lit(window - 1)
    first = F.greatest(F.lit(0), F.col("p") - long + 1)
    last = F.least(F.col("p"), F.greatest(F.lit(0), F.col("n") - F.lit(window)))
    rarest = (
        index.item_pairs.select("item", "text", "p", "pair", "df", F.explode(F.sequence(first, last)).alias("start"))
        .groupBy("text", "start")
        .agg(F.min(F.struct("df", "p", "pair")).alias("x"))
    )
    return rarest.where("x.df > 0").select("text", F.col("x.p").alias("p"), F.col("x.pair").alias("pair")).distinct()


def _places(index: Index, window: int) -> DataFrame:
    """``row, text, shift``: where the rarest pairs say that an item may lie."""
    anchors = index.to_all(store(_anchors(index, window), "anchors"))
    return index.postings.join(anchors, "pair").select("row", "text", (F.col("pos") - F.col("p")).alias("shift")).distinct()


def _matches(index: Index, places: DataFrame) -> DataFrame:
    """``row, text, shift, p``: the pairs that match at the given places."""
    pairs = index.item_pairs.where("df > 0").select("text", "p", "pair")
    wanted = places.join(index.to_all(pairs), "text").select("row", "text", "shift", "p", "pair", (F.col("shift") + F.col("p")).alias("pos"))
    return wanted.join(index.postings, ["row", "pos", "pair"]).select("row", "text", "shift", "p")


def phrase_matches(index: Index, window: int = 13) -> DataFrame:
    """``row, item, first, last``: word spans in which windows of an item occur.

    A window is ``window`` consecutive words of an item, or a shorter item.
    """
    found = _matches(index, store(_places(index, window), "places"))
    order = Window.partitionBy("row", "text", "shift").orderBy("p")
    runs = (
        found.withColumn("run", F.col("p") - F.row_number().over(order))
        .groupBy("row", "text", "shift", "run")
        .agg(F.min("p").alias("p"), F.count("*").alias("pairs"))
    )
    texts = index.to_all(index.item_pairs.select("text", "item", "n").distinct())
    return (
        runs.join(texts, "text")
        .where((F.col("pairs") >= F.lit(window - 1)) | (F.col("pairs") >= F.greatest(F.col("n") - 1, F.lit(1))))
        .select("row", "item", (F.col("shift") + F.col("p")).alias("first"), (F.col("shift") + F.col("p") + F.col("pairs") - F.when(F.col("n") == 1, 1).otherwise(0)).alias("last"))
    )


def proximity_matches(index: Index, slop: int = 5, share: float = 0.5) -> DataFrame:
    """``row, item, first, matched``: places where at least ``share`` of an
    item's pairs occur, none more than ``slop`` words off its place beside the
    rarest pair of some ``slop + 1`` words of the item."""
    places = store(_places(index, max(2, slop + 1)), "places")
    near = places.select("row", "text", F.col("shift").alias("at"), F.explode(F.sequence(F.col("shift") - slop, F.col("shift") + slop)).alias("shift"))
    found = _matches(index, near.select("row", "text", "shift").distinct())
    total = index.item_pairs.groupBy("text", "item").agg(F.count("*").alias("total"))
    return (
        near.join(found, ["row", "text", "shift"])
        .groupBy("row", "text", "at")
        .agg(F.count_distinct("p").alias("matched"))
        .join(index.to_all(total), "text")
        .where(F.col("matched") >= F.col("total") * share)
        .select("row", "item", F.col("at").alias("first"), "matched")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """One row per row of ``docs`` with its hit words and items."""
    index = build_index(docs, benchmark)
    spans = store(phrase_matches(index, window), "spans")
    order = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("last") + 1 - F.greatest(F.col("first"), F.coalesce(before + 1, F.col("first"))))
    hit = spans.select("row", "first", "last").distinct().withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = spans.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = index.docs.join(hit, "row", "left").join(items, "row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(100) * n_hit >= F.lit(percent) * F.col("n_words"))).alias("contaminated"),
    )
