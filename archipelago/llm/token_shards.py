"""Token-ID output in training order (operator 2).

The token stream of the documents, each followed by an end mark, is cut into
sequences of ``length`` tokens.  A keyed Feistel permutation with cycle-walking
gives every sequence its slot in training order.  Slots are dealt out by range,
``shard_rows`` to a shard, and each sequence takes the same number of bytes:
slot ``s`` is at byte ``(s % shard_rows) * stride`` of shard ``s // shard_rows``,
so a run resumes anywhere with one seek.

The texts are tokenised once, where they are read, and the ids written to the
shared folder.  The stream runs in the order of ``doc_id`` (null first), then of
the ids' hash, so the same documents and key give the same sequences and slots
on any cluster.  Only ids, hashes and token counts are sorted, by range; prefix
sums within the ranges, and of the ranges' totals, make each document's place.
Then each piece goes to its slot's range.

Defined results.  Null and empty texts give only their end mark.  Repeated rows
and repeated or null ids are documents like any other.  The last sequence is
filled up with ``pad``.  An empty table gives no sequences.  Special strings
inside texts are ordinary text.  Columns beyond ``doc_id`` and ``text`` are
ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store
from archipelago.llm.textkit import mix

LENGTH = 1024
SHARD_ROWS = 2048
ROUNDS = 6


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    if len(ranks) >= 1 << 16:
        raise ValueError("ids must fit two bytes")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str, pattern: str) -> bytes:
    """The little-endian two-byte ids of a whole text."""
    return np.asarray(_coder(path, pattern).encode_ordinary(text), "<u2").tobytes()


def _tokens(path: str, pattern: str, end: int):
    """Ids of every text; ``row`` tells the rows apart."""
    names, mark = ["row", "n", "doc_id", "ids"], end.to_bytes(2, "little")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py(), path, pattern) + mark
                rows.append((row, len(ids) // 2, doc, ids))
                row, size = row + 1, size + len(ids)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places within a range's part of the stream."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = np.asarray(batch.column("n"))
        places = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(places), batch.column("n")], ["row", "part", "at", "n"])


def _pieces(length: int, n_seqs: int, key: int):
    """Each document's ids cut at the ends of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, at, data in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("ids"), strict=True):
                ids = data.as_py()
                n, p = len(ids) // 2, 0
                while p < n:
                    take = min(n - p, length - (at + p) % length)
                    rows.append(((at + p) // length, (at + p) % length, doc, ids[2 * p : 2 * (p + take)]))
                    p += take
                size += len(ids)
                if size > 1 << 23:
                    yield _made(rows, n_seqs, key)
                    rows, size = [], 0
            yield _made(rows, n_seqs, key)

    return run


def _made(rows: list[tuple], n_seqs: int, key: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    slots = slots_of(np.array(columns[0], np.int64), n_seqs, key)
    return pa.RecordBatch.from_arrays([pa.array(slots), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["slot", "seq", "pos", "doc_id", "ids"])


def _placed(tokens: DataFrame) -> tuple[DataFrame, int]:
    """``tokens`` with ``at`` in the whole stream, and the stream's length.

    One total per range is all that meets in one place.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    keys = tokens.select("row", "n", "doc_id", F.xxhash64("ids").alias("mark")).repartitionByRange(*order).sortWithinPartitions(*order)
    places = store(keys.mapInArrow(_summed, "row long, part int, at long, n long"), "places")
    totals = {r["part"]: r["n"] for r in places.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(totals):
        base[part], total = total, total + totals[part]
    bases = tokens.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    placed = places.join(F.broadcast(bases), "part").select("row", (F.col("at") + F.col("base")).alias("at"))
    return tokens.join(placed.hint("shuffle_merge"), "row").select("doc_id", "at", "ids"), total


def _half_bits(n: int) -> int:
    """Half the bits of the least domain 4 ** k that holds ``n`` values."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))


def _feistel(values: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = values >> shift, values & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return left << shift | right


def slots_of(seqs: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequences: a bijection of [0, n).

    Cycle-walking: a value that the permutation sends outside of [0, n) is sent
    on until it is inside.
    """
    bits, keys = _half_bits(n), _keys(key)
    out = _feistel(seqs.astype(np.uint64), bits, keys)
    while len(far := np.flatnonzero(out >= n)):
        out[far] = _feistel(out[far], bits, keys)
    return out.astype(np.int64)


def sequences_at(slots: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of :func:`slots_of`: which sequences lie in the slots."""
    bits, keys = _half_bits(n), _keys(key)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)

    def back(values: np.ndarray) -> np.ndarray:
        left, right = values >> shift, values & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left + k) & mask), left
        return left << shift | right

    out = back(slots.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = back(out[far])
    return out.astype(np.int64)


def _assemble(length: int, shard_rows: int, pad: int):
    """Join the pieces of each sequence; they come sorted by slot and position."""
    names = ["slot", "shard", "offset", "seq", "n_tokens", "doc_ids", "tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    fill = pad.to_bytes(2, "little")

    def record(slot: int, seq: int, docs: list, ids: list) -> tuple:
        tokens = b"".join(ids)
        n = len(tokens) // 2
        return slot, slot // shard_rows, slot % shard_rows * 2 * length, seq, n, docs, tokens + fill * (length - n)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, docs, ids, rows = None, None, [], [], []
        for batch in batches:
            for slot, seq_, doc, piece in zip(*(batch.column(c).to_pylist() for c in ("slot", "seq", "doc_id", "ids")), strict=True):
                if slot != now:
                    if now is not None:
                        rows.append(record(now, seq, docs, ids))
                    now, seq, docs, ids = slot, seq_, [], []
                docs.append(doc)
                ids.append(piece)
            if len(rows) * length > 1 << 22:
                yield made(rows)
                rows = []
        if now is not None:
            rows.append(record(now, seq, docs, ids))
        yield made(rows)

    return run


SEQUENCES = "slot long, shard long, offset long, seq long, n_tokens int, doc_ids array<long>, tokens binary"


def token_sequences(
    docs: DataFrame, path: str, pattern: str, length: int = LENGTH, shard_rows: int = SHARD_ROWS, key: int = 20_240_229, end: int = 50_256, pad: int = 50_256
) -> DataFrame:
    """``slot, shard, offset, seq, n_tokens, doc_ids, tokens`` in slot order.

    ``tokens`` is the sequence's record: ``length`` little-endian two-byte ids.
    ``doc_ids`` lists the documents in it, in order.  Each partition holds whole
    shards, in order; ``path`` and ``pattern`` are a rank file and its pattern.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = store(rows.mapInArrow(_tokens(path, pattern, end), "row long, n long, doc_id long, ids binary"), "tokens")
    placed, total = _placed(tokens)
    # one shuffle of the ids at a time is on disk
    placed = store(placed, "placed-tokens")
    drop(tokens)
    n = -(-total // length)
    pieces = placed.mapInArrow(_pieces(length, n, key), "slot long, seq long, pos int, doc_id long, ids binary")
    shards = max(1, -(-n // shard_rows))
    parts = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.expr(f"cast((slot div {shard_rows}) * {parts} div {shards} as int)")
    dealt = pieces.repartitionById(parts, part).sortWithinPartitions("slot", "pos")
    return dealt.mapInArrow(_assemble(length, shard_rows, pad), SEQUENCES)


def write_shards(sequences: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Write raw shards to ``path``, a URI that pyarrow can open, and list them.

    A shard is written under a temporary name and renamed when whole, and one
    that is there with the same bytes is left alone: a task that is run again, or
    a job that is started again, goes on where it stopped.  Shards that another
    stream, key or length left at the path are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store_, root = fs.FileSystem.from_uri(path)
        done: list[tuple[int, int]] = []
        now, rows = None, []

        def close() -> None:
            if now is None:
                return
            name, data = f"{root}/shard-{now:08d}.bin", b"".join(rows)
            size, there = len(data), store_.get_file_info(name)
            if there.type != fs.FileType.File or there.size != size or store_.open_input_stream(name).read() != data:
                store_.create_dir(root, recursive=True)
                half = f"{name}.{uuid.uuid4().hex}"
                with store_.open_output_stream(half) as out:
                    out.write(data)
                store_.move(half, name)
            done.append((now, size))

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, rows = shard, []
                rows.append(tokens)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64())], ["shard", "bytes"])

    return sequences.select("shard", "tokens").mapInArrow(run, "shard long, bytes long")


def read_slots(path: str, first: int, n: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS) -> Iterator[np.ndarray]:
    """Read ``n`` sequences from slot ``first`` on, one seek per shard."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    stride = 2 * length
    while n > 0:
        take = min(n, shard_rows - first % shard_rows)
        with where.open_input_file(f"{root}/shard-{first // shard_rows:08d}.bin") as file:
            file.seek(first % shard_rows * stride)
            data = file.read(take * stride)
        if len(data) < stride:
            return
        yield from np.frombuffer(data, "<u2").reshape(-1, length)
        first, n = first + take, n - take
