"""The prefix trie of conversations (operator 11).

A node is a distinct sequence of first turns (role and text).  The conversation
with the least id among those that begin with it owns it; since fewer
conversations share a longer beginning, the depths that a conversation owns are
a suffix of its depths: its chain.  So the trie is its chains, each hung below a
node of a chain of a lesser id.

1. Every beginning has a digest: the exclusive or of hashes of its turns with
   their places, as running totals over range partitions
   (:func:`~archipelago.operators.ranking.running`), so that a conversation of
   any length is spread over partitions.
2. The least id for each digest and depth.
3. Each conversation finds its first owned depth by binary search: in every round
   all of them probe the minima at their middle depth, in one join.  A search
   runs within blocks of ``BLOCK`` depths, all at once, so rounds are at most
   ``log2(BLOCK) + 1`` whatever the longest conversation.  The join key has the
   asking id, so no beginning that many share is a hot key.
4. A chain hangs where the beginning before its first owned depth is owned.
5. Totals go up the tree of chains by doubling: in round r a chain adds what its
   descendants at distance ``2^r`` have gathered.  Running totals down each chain
   then give every node its subtree's.

Digests have 128 bits of hashes of a SHA-256 of role and text; nothing of a text
is shuffled.

Defined results.  Turns are in the order of ``turn`` (null first), those of equal
``turn`` in that of their SHA-256.  A null role or text is empty; a role and a
text are told apart by the role's length.  Rows without ``conv_id`` belong to no
conversation and are ignored.  Repeated rows are turns of their own.  An empty
table has no trie.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store
from archipelago.operators.ranking import running

#: Depths of one search.
BLOCK = 1024
#: A key that more than one in so many rows ask for is looked up by broadcast.
HEAVY = 1000
#: Bytes of ids hashed in one step.
PACK = 1 << 16

_WORD = r"[^\x20\x09-\x0D]+"


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left joined to ``table``, which has every key once at most.

    A key that a thousandth of all rows has, of which there cannot be more than
    ``HEAVY``, is answered by broadcast; the others by a shuffle in which none of
    them is more than a thousandth.
    """
    total = rows.count()
    heavy = rows.groupBy(*keys).agg(F.count("*").alias("_k")).where(F.col("_k") * HEAVY >= F.lit(max(total, HEAVY))).drop("_k")
    found = table.join(F.broadcast(heavy), keys, "left_semi").withColumn("_hit", F.lit(True))
    asked = rows.join(F.broadcast(found), keys, "left")
    rest = asked.where("_hit IS NULL").select(*rows.columns).join(table, keys, "left")
    return asked.where("_hit").drop("_hit").unionByName(rest)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, t1, t2, words``: every turn with its place from 1, the
    digest of its role and text and the number of words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", named.alias("t"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    bits = lambda at: F.conv(F.substring("t", at, 15), 16, 10).cast("long")
    rows = running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("t"), F.col("tie")], place="place")
    return store(rows.select("conv_id", "place", bits(1).alias("t1"), bits(16).alias("t2"), "words"), "turns")


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like others: the first h turns of ``c`` are those
    of conversation ``c - c % every``, and its own follow after its first h; h is
    the CRC of ``c`` modulo ``most``.

    Returns ``conv_id, place, t1, t2, words`` and ``conv_id`` of all of them.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    ids = store(turns.select("conv_id").distinct(), "conversations")
    own = turns.withColumn("h", h).where("place > h")
    stems = turns.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "stem")
    asked = ids.select("conv_id", h, (F.col("conv_id") - F.col("conv_id") % every).alias("stem"))
    begun = store(asked.join(stems, "stem").where("place <= h").select("conv_id", "h", "place", "t1", "t2", "words"), "stems")
    short = asked.join(begun.groupBy("conv_id").agg(F.max("place").alias("got")), "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("got", F.lit(0))).alias("short")).where("short > 0")
    rest = _looked_up(own, short, ["conv_id"]).withColumn("place", F.col("place") - F.coalesce("short", F.lit(0)))
    cols = ["conv_id", "place", "t1", "t2", "words"]
    return begun.select(*cols).unionByName(rest.select(*cols)), ids


def _beginnings(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, words``: the digest of each beginning and
    of the one before it."""
    mark = lambda k: F.xxhash64(F.lit(k), "place", "t1", "t2").alias(f"g{k}")
    rows = turns.select("conv_id", F.col("place").alias("depth"), mark(1), mark(2), "words")
    rows = running(rows, ["conv_id"], [F.col("depth")], xors={"p1": "g1", "p2": "g2"})
    rows = rows.select("conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("q2"), "words")
    zero = F.lit(0).cast("long")
    return store(rows.unionByName(ids.select("conv_id", *[zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "words")])), "beginnings")


def first_owned(beginnings: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conv_id, first, depth, p1, p2``: each conversation's first owned depth
    (null: none) and the depth and digest of its whole, by binary search."""
    rows = beginnings.groupBy("conv_id", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("depth", "p1", "p2"))).alias("at"))
    rows = store(rows, "blocks")
    longest = rows.agg(F.max(F.size("at"))).first()[0] or 0
    mine = nodes.select("conv_id", F.col("depth").alias("_d"), F.col("p1").alias("_1"), F.col("p2").alias("_2"), F.lit(True).alias("mine"))
    rows = rows.withColumns({"low": F.lit(0), "high": F.size("at")})
    for _ in range(int(longest).bit_length()):
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        probe = F.when(F.col("low") < F.col("high"), F.get("at", mid))
        rows = rows.withColumns({"mid": mid, "_d": probe["depth"], "_1": probe["p1"], "_2": probe["p2"]}).join(mine, ["conv_id", "_d", "_1", "_2"], "left")
        open_, hit = F.col("low") < F.col("high"), F.col("mine").isNotNull()
        rows = rows.select(
            "conv_id", "at", F.when(open_ & ~hit, F.col("mid") + 1).otherwise(F.col("low")).alias("low"), F.when(open_ & hit, F.col("mid")).otherwise(F.col("high")).alias("high")
        )
    found = rows.groupBy("conv_id").agg(F.min(F.get("at", F.col("low"))["depth"]).alias("first"), F.max(F.element_at("at", -1)).alias("end"))
    return store(found.select("conv_id", "first", "end.*"), "chains")


def _runs(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """The runs of equal first ``keys`` columns: key, start, end."""
    columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for a, b in pairwise(edges):
        if b > a:
            yield tuple(int(c[a]) for c in columns), a, b


_KEY = ["depth", "p1", "p2"]
_KEY_SQL = "depth long, p1 long, p2 long"


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = [], batch.column(3).to_pylist()
        for key, a, b in _runs(batch, 3):
            step = PACK // 20
            rows += [(*key, ids[k], ",".join(map(str, ids[k : min(k + step, b)])), min(step, b - k)) for k in range(a, b, step)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], [*_KEY, "first", "ids", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out = None, []

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if len(out) > least:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*_KEY, "first_end", "n_ends", "ends_sha256"])
            out.clear()

    for batch in batches:
        for *key, first, ids, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != key:
                if now:
                    out.append((*now[0], now[1], now[2], now[3].hexdigest()))
                now = [key, first, 0, hashlib.sha256()]
            now[3].update(("," if now[2] else "").encode() + ids.encode())
            now[2] += n
        yield from flush(4096)
    if now:
        out.append((*now[0], now[1], now[2], now[3].hexdigest()))
    yield from flush(0)


def id_digests(rows: DataFrame) -> DataFrame:
    """``depth, p1, p2, first_end, n_ends, ends_sha256`` for ``depth, p1, p2,
    conv_id``: the SHA-256 of each key's ids, ascending, joined by commas.

    Ids are sorted and joined to packs by range partitions; a key's packs are then
    hashed one after the other as a stream, of which a task holds one batch.
    """
    packs = rows.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    packs = packs.mapInArrow(_packs, f"{_KEY_SQL}, first long, ids string, n long")
    return packs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, f"{_KEY_SQL}, first_end long, n_ends long, ends_sha256 string")


def _gathered(chains: DataFrame) -> DataFrame:
    """``conv_id, leaves, saved`` summed over each chain and all below it, for
    ``conv_id, up, leaves, saved``; ``up`` is the chain that it hangs from."""
    now = store(chains, "climbing")
    while now.where("up IS NOT NULL").head(1):
        below = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        grown = now.join(below, "conv_id", "left").select("conv_id", "up", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
        above = now.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        moved = _looked_up(grown.where("up IS NOT NULL"), above, ["up"]).select("conv_id", F.col("_up").alias("up"), "leaves", "saved")
        after = store(moved.unionByName(grown.where("up IS NULL")), "climbing")
        drop(now)
        now = after
    return now


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, place, t1, t2, words)``, places
    from 1 without gaps, of the conversations ``ids(conv_id)``.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, n_ends``: the owner, the parent's owner, members, children,
    childless nodes of the subtree, the sum over the subtree of (members - 1) x
    words of the last text, and the digest and number of members that end here.
    """
    beginnings = _beginnings(turns, ids)
    nodes = beginnings.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("words").alias("words"))
    nodes = store(nodes, "nodes")
    chains = first_owned(beginnings, nodes)
    drop(beginnings)
    # where the first node of a chain hangs
    tops = nodes.join(chains.select("conv_id", F.col("first").alias("depth")), ["conv_id", "depth"]).where("depth > 0")
    tops = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    hung = store(_looked_up(tops, nodes.select(*_KEY, F.col("conv_id").alias("up")), _KEY).select("conv_id", "up", "depth"), "hung")
    branches = hung.groupBy(F.col("up").alias("conv_id"), "depth").agg(F.count("*").alias("branches"))
    ends = id_digests(chains.where("depth IS NOT NULL"))
    rows = nodes.join(branches, ["conv_id", "depth"], "left").join(ends, _KEY, "left")
    goes_on = F.when(F.col("first_end") == F.col("conv_id"), 0).otherwise(1)
    rows = rows.select(
        "conv_id", "depth", "n_convs", (F.coalesce("branches", F.lit(0)) + goes_on).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"),
    ).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    rows = store(rows, "nodes")
    own = rows.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    totals = _gathered(own.join(hung.select("conv_id", "up"), "conv_id", "left").select("conv_id", "up", "leaves", "saved"))
    brought = hung.join(totals.select("conv_id", "leaves", F.col("saved").alias("more")), "conv_id").groupBy(F.col("up").alias("conv_id"), "depth").agg(F.sum("leaves").alias("leaves"), F.sum("more").alias("more"))
    rows = rows.join(brought, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more", F.lit(0))}).drop("leaves", "more")
    rows = running(rows, ["conv_id"], [F.col("depth").desc()], sums={"n_leaves": "leaf", "saved_tokens": "saved"})
    parents = hung.select("conv_id", (F.col("depth") + 1).alias("depth"), "up")
    rows = rows.join(parents, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("up", "conv_id"))
    return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends")
