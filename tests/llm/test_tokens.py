"""Token counts and shards against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from archipelago.llm import token_count
from archipelago.llm.token_count import token_counts
from archipelago.llm.token_shards import read_slots, sequences_at, slots_of, token_sequences, write_shards
from archipelago.llm.transducer import START, Transducer, read, written

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = [*"abcdefst'rvlmTHE  \n\t 0123!?.é¿ñ我🎉\xa0\x1c\u3000", "'re", "'ll", "'ve", "'s", " the", "ing", "<|endoftext|>", "<|endof"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(JSON)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machine():
    return Transducer(JSON)


def scraps(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_transducer_equals_library(library, machine):
    for text in [*scraps(1, 4000, 30), "a" * 700, "'" * 40, " " * 90 + "x", "\n" * 50, "9" * 300]:
        assert machine.count(text) == library(text), repr(text)


def test_chunks_lead_from_state_to_state(library, machine):
    rnd = random.Random(2)
    for text in scraps(3, 1500, 40):
        size, key, n = rnd.randint(1, 9), START, 0
        for k in range(0, len(text), size):
            key, more = machine.advance(read(written(key)), text[k : k + size], text[k + size : k + size + machine.reach])
            n += more
        assert n + machine.owed(key) == library(text), repr(text)


def test_a_text_that_settles_leads_to_one_state(machine):
    rnd = random.Random(5)
    settled = 0
    for text in scraps(6, 600, 12):
        if machine.settles(text):
            settled += 1
            ends = {machine.advance(machine.advance(START, before)[0], text)[0] for before in ("", "a", " ", "'", "th\n", "9", rnd.choice(BITS))}
            assert len(ends) == 1, repr(text)
    assert settled > 100


def test_follows_is_what_encoding_two_tokens_gives(machine):
    rnd, vocab = random.Random(4), machine.vocab
    names = list(vocab.id)
    for _ in range(20_000):
        a, b = rnd.choice(names), rnd.choice(names)
        assert vocab.follows(vocab.id[a], vocab.id[b]) == (vocab.encode(a + b) == [a, b])


@pytest.mark.parametrize("back", [0, 3, 256])  # with less, more entries are wrong at first
def test_counts_of_rows(spark, library, monkeypatch, back):
    monkeypatch.setattr(token_count, "CHUNK", 64)
    monkeypatch.setattr(token_count, "BACK", back)
    monkeypatch.setattr(token_count, "FAN", 8)
    texts = [None, "", " ", *scraps(7, 60, 60), "word " * 2000, "x" * 5000, "<|endoftext|>" * 300, "".join(random.Random(8).choices("abcXYZ019+/", k=3000)), "的一是不了人我在" * 200]
    rows = [(k if k % 5 else None, t, "extra") for k, t in enumerate(texts)] + [(1, texts[1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    found = token_counts(docs, JSON, limit=40).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), library(t or ""), library(t or "") > 40) for i, t, _ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want
    assert token_counts(docs.limit(0), JSON).count() == 0


def test_texts_are_cut_in_pieces_of_bounded_size():
    """Chunks with what is before and after them, whatever characters are made of."""
    texts = ["", "short", "é🎉 a" * 40_000, "x" * (1 << 23)]
    rows = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array([1, None, 2, 2]), pa.array([len(t.encode()) for t in texts]), pa.array(texts)], ["row", "doc_id", "n_bytes", "text"])
    batches = list(token_count._cut(iter([rows])))
    size, before, after = token_count.CHUNK, token_count.BACK, token_count.AHEAD
    assert len(batches) > 2
    found = {7: "", 8: "", 9: "", 10: ""}
    for batch in batches:
        pieces = batch.column("piece").to_pylist()
        assert sum(map(len, pieces)) <= token_count.HELD + size + before + after
        for row, chunk, chunks, piece, lead in zip(*(batch.column(c).to_pylist() for c in ("row", "chunk", "chunks")), pieces, batch.column("lead").to_pylist(), strict=True):
            text = texts[row - 7]
            assert lead == (before if chunk else 0) and chunks == max(1, -(-len(text) // size))
            assert piece == text[chunk * size - lead : chunk * size + size + after]
            found[row] += piece[lead : lead + size]
    assert [found[k] for k in sorted(found)] == texts


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 64, 65, 1000, 70_000])
def test_slots_are_a_permutation(n):
    slots = slots_of(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert (sequences_at(slots, n, 5) == np.arange(n)).all()
    if n > 100:
        assert (slots_of(np.arange(n), n, 6) != slots).mean() > 0.9 and abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def test_shards_hold_the_stream(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "of", "and", "thing", "é"]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, None, 1), (70, "", 1), (3, texts[3], 1), (71, "<|endoftext|> in text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seq int").repartition(3)
    made = token_sequences(docs, RANKS, public_tokenizers.PATTERN, length=64, shard_rows=8)
    listed = sorted(made.collect(), key=lambda r: r["slot"])
    n = len(listed)
    assert [r["slot"] for r in listed] == list(range(n)) and all(r["shard"] == r["slot"] // 8 and r["offset"] == r["slot"] % 8 * 128 for r in listed)
    assert all(len(r["tokens"]) == 128 for r in listed) and sum(r["n_tokens"] < 64 for r in listed) <= 1
    stream = np.frombuffer(b"".join(r["tokens"] for r in sorted(listed, key=lambda r: r["seq"])), "<u2")
    total = sum(r["n_tokens"] for r in listed)
    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    want = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    ends = np.flatnonzero(stream[:total] == 50256)
    got = [tuple(x.tolist()) for x in np.split(stream[:total], ends + 1)][:-1]
    assert sorted(x[:-1] for x in got) == want
    path = f"file://{tmp_path}/shards"
    sizes = {r["shard"]: r["bytes"] for r in write_shards(made, path, 64).collect()}
    assert sum(sizes.values()) == n * 128
    assert {r["shard"]: r["bytes"] for r in write_shards(made, path, 64).collect()} == sizes
    back = list(read_slots(path, 5, 9, length=64, shard_rows=8))
    assert [x.tobytes() for x in back] == [r["tokens"] for r in listed[5:14]]
    assert token_sequences(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_the_stream_is_the_same_on_any_cluster(spark, tmp_path):
    """Partitions do not matter, and shards of another stream are not kept."""
    rows = [(k // 2 if k % 7 else None, f"text {k * k} of the thing", 1) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seq int")
    make = lambda d, **more: token_sequences(d, RANKS, public_tokenizers.PATTERN, length=16, shard_rows=4, **more)
    one = {r["slot"]: r["tokens"] for r in make(docs.repartition(1)).collect()}
    two = {r["slot"]: r["tokens"] for r in make(docs.repartition(7)).collect()}
    assert one == two and len(one) > 20
    path = f"file://{tmp_path}/shards"
    write_shards(make(docs, key=3), path, 16).collect()
    write_shards(make(docs), path, 16).collect()
    assert [x.tobytes() for x in read_slots(path, 0, len(one), length=16, shard_rows=4)] == [one[k] for k in range(len(one))]
