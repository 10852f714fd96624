"""Near-duplicate documents by MinHash (operator 3).

1. One narrow pass: word shingles of each whole text, ``BANDS * ROWS`` minima
   of universal hash functions, a key for each band.
2. Texts with the same shingle set are one class; only classes go on.
3. Banding: in each bucket every class is paired with the bucket's least class,
   its hub.  A group of copies so gives pairs in proportion to its size.
4. Each hub is compared with its partners: sizes, signatures, then the full
   shingle sets.  Confirmed links make components.
5. Two partners of one hub may be linked although neither is linked to the
   hub.  So the partners that are outside the largest component around a hub
   are compared with all its partners in other components, in blocks of bounded
   size; only links leave a block.  Any two classes that share a bucket share
   its hub, so no candidate is lost.
6. Components by alternating large-star and small-star.

Defined results.  Null and word-less texts have an empty set, link with nothing
and are kept.  A null ``doc_id`` cannot be linked to: the row comes back with a
null component and is kept.  Rows that share a ``doc_id`` are one document, for
which one of its texts is compared.  Columns of the input beyond ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.components import connected_components
from archipelago.llm.storage import store
from archipelago.llm.textkit import mix, rows_of, shingle_hashes, word_hashes

#: A pair at the threshold 0.8 misses all bands with probability 1.2e-8.
BANDS, ROWS = 60, 6
_HASHES = BANDS * ROWS
_RNG = np.random.default_rng(7919)
_A = (_RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, _HASHES, dtype=np.uint64).astype(np.uint32)
_BAND_KEY = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BLOCK = 1024

#: Shingles on either side of a block of comparisons.
BLOCK_SHINGLES = 400_000

FEATURES = "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"
SETS = "id long, sig binary, shingles array<long>"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(_HASHES, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), _BLOCK):
        part = np.multiply.outer(_A, x[at : at + _BLOCK])
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles."""
    one = mix(shingles ^ np.uint64(0x243F6A8885A308D3))
    two = mix(shingles + np.uint64(0x13198A2E03707344))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc_id, text in rows_of(batches):
            shingles = shingle_hashes(word_hashes(text)[0], size) if text else np.empty(0, np.uint64)
            if len(shingles):
                least = minima(shingles)
                bands = mix((least.astype(np.uint64).reshape(BANDS, ROWS) * _BAND_KEY).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                rows.append((doc_id, len(shingles), *_set_key(shingles), bands.view(np.int64)))
            else:
                rows.append((doc_id, 0, None, None, None))
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    names = ("doc_id", "n_shingles", "set_hi", "set_lo", "bands")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _sets(size: int):
    """The signature (a byte of each minimum) and the full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs, sets = [], [], []
            for key, text in rows_of([batch]):
                shingles = shingle_hashes(word_hashes(text)[0], size)
                ids.append(key)
                sigs.append(mix(minima(shingles).astype(np.uint64)).astype(np.uint8).tobytes())
                sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["id", "sig", "shingles"])

    return run


def _compare(percent: int):
    """The links between the two sides of a block.

    A pair goes on if the set sizes allow a link and if its signatures agree in
    no fewer places than eight standard deviations below the threshold; then
    the full sets are intersected.
    """
    p = percent / 100
    least = _HASHES * p - 8 * np.sqrt(_HASHES * p * (1 - p))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one = table.filter(pa.compute.equal(table["side"], 0))
        two = table.filter(pa.compute.equal(table["side"], 1))
        found: list[tuple[int, int]] = []
        if one.num_rows and two.num_rows:
            ids, comps = (np.asarray(two[c]) for c in ("id", "comp"))
            sigs = np.frombuffer(b"".join(two["sig"].to_pylist()), np.uint8).reshape(-1, _HASHES)
            sets = two["shingles"].combine_chunks()
            flat, offsets = np.asarray(sets.flatten()), np.asarray(sets.offsets) - sets.offsets[0].as_py()
            sizes = np.diff(offsets)
            for key, comp, sig, own in zip(one["id"].to_pylist(), one["comp"].to_pylist(), one["sig"], one["shingles"], strict=True):
                mine = np.asarray(own.values)
                n = len(mine)
                may = (comps != comp) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                at = np.flatnonzero(may)
                at = at[(sigs[at] == np.frombuffer(sig.as_py(), np.uint8)).sum(axis=1) >= least]
                for k in at:
                    other = flat[offsets[k] : offsets[k + 1]]
                    where = np.minimum(np.searchsorted(mine.view(np.uint64), other.view(np.uint64)), n - 1)
                    both = int((mine[where] == other).sum())
                    if 100 * both >= percent * (n + sizes[k] - both):
                        found.append((min(key, int(ids[k])), max(key, int(ids[k]))))
        a, b = zip(*set(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between side 0 and side 1 of each group, from different comps.

    ``rows(hub, side, id, comp, n)``.  Both sides are dealt into blocks of about
    ``BLOCK_SHINGLES`` shingles; every block of one side meets every one of the
    other, so a group of any size is spread and nothing is left out.
    """
    load = rows.groupBy("hub").agg(*[F.sum(F.when(F.col("side") == k, F.col("n"))).alias(f"load{k}") for k in (0, 1)])
    parts = load.select("hub", *[F.ceil(F.col(f"load{k}") / F.lit(BLOCK_SHINGLES)).cast("int").alias(f"parts{k}") for k in (0, 1)])
    # only groups of several blocks are looked up, so rows need not meet by hub
    large = store(parts.where("parts0 > 1 OR parts1 > 1"), "large-groups")
    one = F.lit(1)
    placed = rows.join(large, "hub", "left").select(*rows.columns, F.coalesce("parts0", one).alias("parts0"), F.coalesce("parts1", one).alias("parts1"))
    own = F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1"))
    mine = F.pmod(F.xxhash64("id"), own).cast("int")
    there = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1))
    dealt = placed.select("hub", "side", "id", "comp", mine.alias("mine"), there.alias("there"))
    block = [F.when(F.col("side") == 0, F.col(x)).otherwise(F.col(y)) for x, y in (("mine", "there"), ("there", "mine"))]
    full = dealt.join(sets.hint("shuffle_merge"), "id").select("hub", block[0].alias("block0"), block[1].alias("block1"), "side", "id", "comp", "sig", "shingles")
    return full.groupBy("hub", "block0", "block1").applyInArrow(_compare(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, links``.

    Two texts are linked if ``100 * |intersection| >= percent * |union|`` of
    their sets of ``shingle_words``-word shingles (A-Z lower-cased).
    ``component_id`` is the least ``doc_id`` reachable; ``kept`` marks it;
    ``links`` counts the links of the row's class that
    were confirmed; those inside a component are only sought as far as needed.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = store(base.mapInArrow(_features(shingle_words), FEATURES), "minhash")
    real = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    members = store(
        real.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")),
        "classes",
    )
    # the least document of a class stands for it
    heads = real.join(members.select("set_hi", "set_lo", F.col("id").alias("doc_id")), ["set_hi", "set_lo", "doc_id"], "left_semi")
    keys = heads.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    pairs = store(keys.join(shared, "key").where("id <> hub").select("hub", "id").distinct(), "candidates")

    met = pairs.select("id").unionByName(pairs.select(F.col("hub").alias("id"))).distinct()
    texts = base.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    # the ids grow with the corpus, so neither they nor the sets are ever broadcast
    texts = texts.join(met.hint("shuffle_merge"), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    sets = store(texts.mapInArrow(_sets(shingle_words), SETS), "sets").where("size(shingles) > 0")
    sized = sets.select("id", F.size("shingles").alias("n"))
    around = store(pairs.unionByName(pairs.select("hub", F.col("hub").alias("id")).distinct()).join(sized, "id"), "around")
    side = (F.col("id") != F.col("hub")).cast("int").alias("side")
    links = store(_links(around.select("hub", side, "id", F.col("id").alias("comp"), "n"), sets, percent), "links")

    again = real.groupBy("doc_id").agg(F.min(F.struct("set_hi", "set_lo")).alias("lo"), F.max(F.struct("set_hi", "set_lo")).alias("hi")).where("lo <> hi").select("doc_id")
    split = real.join(again, "doc_id", "left_semi").join(members, ["set_hi", "set_lo"]).select("doc_id", "id").distinct()
    one_doc = split.join(split.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    one_doc = store(one_doc, "one-document")
    comp = store(connected_components(links.unionByName(one_doc)), "components")

    placed = around.join(comp, "id", "left").select("hub", "id", "n", F.coalesce("component", "id").alias("comp"))
    main = placed.groupBy("hub", "comp").agg(F.count("*").alias("k")).groupBy("hub").agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("comps"))
    main = store(main.where("comps > 1").select("hub", F.col("x.comp").alias("main")), "main-components")
    open_ = store(placed.join(main, "hub"), "open")
    rest = open_.select("hub", F.lit(1).alias("side"), "id", "comp", "n").unionByName(
        open_.where("comp <> main").select("hub", F.lit(0).alias("side"), "id", "comp", "n")
    )
    more = store(_links(rest, sets, percent), "links")
    every = links.unionByName(more).distinct()
    if more.head(1):
        comp = store(connected_components(every.unionByName(one_doc)), "components")

    degree = every.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    cls = (
        members.join(comp, "id", "left")
        .join(degree, "id", "left")
        .select("set_hi", "set_lo", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return feats.select("doc_id", "n_shingles", "set_hi", "set_lo").join(cls, ["set_hi", "set_lo"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("links", F.lit(0).cast("long")).alias("links"),
    )
