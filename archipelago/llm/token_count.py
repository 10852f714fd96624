"""Token counts by a compiled transducer (operator 6).

Texts are cut into chunks of ``CHUNK`` characters.  A chunk's state map says, for
the states in which the chunk may be entered, in which state it is left and how
many tokens that adds (see :mod:`archipelago.llm.transducer`).  Maps compose:

1. One narrow pass enters every chunk in the state that the ``BACK`` characters
   before it lead to.  Where a blank follows another character there, that is
   the state whatever came before.
2. Elsewhere (a long text without blanks) the state is a guess, nearly always
   right.  Where a chunk is left in a state in which the next one was not
   entered, the next one is read from that state too, until every exit is an
   entry.  Only such chunks keep their characters until then.
3. The maps of neighbours are composed, ``FAN`` at a time, by rounds.

A text is cut once, from left to right, by the task that reads its row, in time
linear in its length; beside the row's text it holds at most ``HELD`` characters of
chunks.  Composing holds ``FAN`` maps.  A text read in rounds whose chunks never
settle costs a round a chunk.

Defined results.  A null or empty text has no bytes and no tokens.  Repeated
rows and repeated or null ids are counted row by row.  Columns beyond
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import store
from archipelago.llm.transducer import START, Transducer, read, written

CHUNK = 32_768
BACK = 256
#: More than any special string of a vocabulary is long.
AHEAD = 64
FAN = 64
#: Characters of chunks cut before their maps are made.
HELD = 1 << 22

_CHUNK = "row long, doc_id long, n_bytes long, chunk long, chunks long"
#: A chunk's map for one entry.  ``piece`` is kept where the entry is a guess.
_MAPS = f"{_CHUNK}, piece string, lead int, entry string, exit string, n long"


@lru_cache(maxsize=2)
def _compiled(path: str) -> Transducer:
    made = Transducer(path)
    if made.reach > AHEAD:
        raise ValueError(f"special strings longer than {AHEAD} characters are not supported")
    return made


def _map_chunks(path: str, size: int):
    """State maps of pieces: ``lead`` characters before the chunk, the chunk, and
    what follows.  An entry that is given is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(path)
        begin = written(START)
        for batch in batches:
            kept, entries, exits, counts = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("chunk", "chunks", "lead", "entry"))
            for text, chunk, chunks, lead, entry in zip(batch.column("piece"), *columns, strict=True):
                piece = text.as_py()
                if chunks <= 1:
                    for column, value in ((kept, None), (entries, begin), (exits, None), (counts, machine.count(piece))):
                        column.append(value)
                    continue
                before, inside, after = piece[:lead], piece[lead : lead + size], piece[lead + size :]
                sure = entry is None and (chunk == 0 or machine.settles(before))
                key = read(entry) if entry else machine.advance(START, before, inside + after)[0]
                left, n = machine.advance(key, inside, after)
                last = chunk == chunks - 1
                kept.append(None if sure or entry else piece)
                entries.append(written(key))
                exits.append(None if last else written(left))
                counts.append(n + machine.owed(left) if last else n)
            made = {"piece": pa.array(kept, pa.string()), "entry": pa.array(entries, pa.string()), "exit": pa.array(exits, pa.string()), "n": pa.array(counts, pa.int64())}
            order = ["row", "doc_id", "n_bytes", "chunk", "chunks", "piece", "lead", "entry", "exit", "n"]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in order], order)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of ``row, doc_id, n_bytes, text``, for :func:`_map_chunks`."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "n_bytes": pa.int64(), "chunk": pa.int64(), "chunks": pa.int64(), "piece": pa.string(), "lead": pa.int32(), "entry": pa.string()}

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        rows, held = [], 0
        *keys, texts = (batch.column(c) for c in ("row", "doc_id", "n_bytes", "text"))
        for *key, scalar in zip(*(k.to_pylist() for k in keys), texts, strict=True):
            text = scalar.as_py()
            chunks = max(1, -(-len(text) // CHUNK))
            for chunk in range(chunks):
                at = chunk * CHUNK
                begin = max(0, at - BACK)
                piece = text if chunks == 1 else text[begin : at + CHUNK + AHEAD]
                rows.append((*key, chunk, chunks, piece, at - begin, None))
                held += len(piece)
                if held >= HELD:
                    yield made(rows)
                    rows, held = [], 0
        yield made(rows)


def _closed(maps: DataFrame, path: str) -> DataFrame:
    """``maps`` and those of every other state in which a chunk is entered."""
    pieces = maps.where("piece IS NOT NULL").drop("entry", "exit", "n")
    known, new = maps.drop("piece", "lead"), maps
    while True:
        asked = new.where("exit IS NOT NULL").select("row", (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry")).distinct()
        asked = store(asked.join(known, ["row", "chunk", "entry"], "left_anti"), "asked")
        if asked.isEmpty():
            return known
        again = pieces.join(asked, ["row", "chunk"])
        new = store(again.select("row", "doc_id", "n_bytes", "chunk", "chunks", "piece", "lead", "entry").mapInArrow(_map_chunks(path, CHUNK), _MAPS), "state-maps")
        known = known.unionByName(new.drop("piece", "lead"))


def _after(maps: Column) -> Column:
    """The map of several chunks: each one's exit is the next one's entry."""
    chain = lambda acc, m: F.transform_values(
        acc,
        lambda _, v: F.struct(F.element_at(m, v["exit"])["exit"].alias("exit"), (v["n"] + F.element_at(m, v["exit"])["n"]).alias("n")),
    )
    return F.aggregate(F.slice(maps, 2, FAN), F.get(maps, 0), chain)


def _totals(maps: DataFrame) -> DataFrame:
    """The counts of the texts of several chunks, from their chunks' maps."""
    whole = ["row", "doc_id", "n_bytes"]
    value = F.struct("exit", "n")
    left = maps.groupBy(*whole, "chunk", "chunks").agg(F.map_from_entries(F.collect_list(F.struct("entry", value))).alias("map"))
    done, most = None, maps.agg(F.max("chunks")).first()[0] or 1
    while most > 1:
        part = F.floor(F.col("chunk") / FAN).alias("chunk")
        listed = F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("at"), F.col("map").alias("map"))), lambda a, b: (a["at"] - b["at"]).cast("int"))
        left = left.groupBy(*whole, part, F.ceil(F.col("chunks") / FAN).alias("chunks")).agg(listed.alias("maps"))
        left = left.select(*whole, "chunk", "chunks", _after(F.transform("maps", lambda x: x["map"])).alias("map"))
        most = -(-most // FAN)
        if most > 1:
            left = store(left, "composed")
        ended = left.where("chunks = 1").select(*whole, F.element_at("map", F.lit(written(START)))["n"].alias("n"))
        done = ended if done is None else done.unionByName(ended)
        left = left.where("chunks > 1")
    return done


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    mapped = _map_chunks(path, CHUNK)
    maps = store(rows.mapInArrow(lambda batches: mapped(_cut(batches)), _MAPS), "state-maps")
    counted = maps.where("chunks = 1").select("doc_id", "n_bytes", "n")
    parts = maps.where("chunks > 1")
    if not parts.isEmpty():
        counted = counted.unionByName(_totals(_closed(parts, path)).select("doc_id", "n_bytes", "n"))
    return counted.select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
