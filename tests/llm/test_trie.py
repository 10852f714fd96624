"""The conversation trie against brute force over all beginnings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from archipelago.llm import conversation_trie as trie
from archipelago.operators.ranking import running

SETTINGS = {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Small tables, too, are spread over range partitions here."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = {}
    for node, ms in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        ends = sorted(c for c in ms if len(convs[c]) == len(node))
        out[min(ms), len(node)] = (
            min(members[node[:-1]]) if node else None, len(ms), len(kids), sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below),
            sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(), len(ends),
        )
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth long, place string"


def found(spark, rows, extra=(7, "x")):
    table = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)
    got = trie.prefix_trie(*trie.grafted(trie.numbered_turns(table))).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def scraps(seed, n, most=7):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(90), n):
        size = rnd.randint(1, most)
        rows += [(c, t if rnd.random() < 0.9 or t else None, rnd.choice(["user", "user", None]), rnd.choice(["a b", "a b", "c", "", None, "d e f"])) for t in range(size)]
    rnd.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, monkeypatch):
    for seed, block, heavy in ((1, 1024, 1000), (2, 3, 4)):
        monkeypatch.setattr(trie, "BLOCK", block)
        monkeypatch.setattr(trie, "HEAVY", heavy)
        rows = scraps(seed, 60)
        assert found(spark, rows) == brute(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "a"), (40, None, None, None), (41, None, None, None), (41, None, None, None), (42, 3, "r", "x " * 400_000), (43, 3, "r", "x " * 400_000), (43, 3, "q", ""),
        (61, 1, "u", "t"), (61, 1, "u", "t"), (62, 0, "ab", "c"), (63, 0, "a", "bc"), *[(80, t, "user", "again") for t in range(300)], *[(81, t, "user", "again") for t in range(300)],
    ]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert found(spark, []) == {}


def test_nested_chains_are_gathered_by_doubling(spark):
    # each conversation leaves the one before it one turn later; none is grafted
    rows = [(20 * c, t, "u", "s" if t < c else f"{c} {t}") for c in range(20) for t in range(c + 2)]
    turns = trie.numbered_turns(spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA))
    got = trie.prefix_trie(turns, turns.select("conv_id").distinct())
    convs = {20 * c: [("u", "s" if t < c else f"{c} {t}") for t in range(c + 2)] for c in range(20)}
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got.collect()} == brute(convs)


def test_running_totals_cross_partitions(spark):
    rnd = random.Random(4)
    rows = [(1 if k % 3 else rnd.randint(0, 9), k, rnd.randint(-9, 9), rnd.getrandbits(60)) for k in range(3000)]
    table = spark.createDataFrame(rows, "g long, k long, v long, x long")
    assert table.repartitionByRange("g", F.col("k").desc()).where("g = 1").select(F.spark_partition_id()).distinct().count() > 1
    got = running(table, ["g"], [F.col("k").desc()], place="n", sums={"s": "v"}, xors={"y": "x"})
    want, state = {}, {}
    for g, k, v, x in sorted(rows, key=lambda r: -r[1]):
        n, s, y = state.get(g, (0, 0, 0))
        state[g] = want[k] = n + 1, s + v, y ^ x
    assert {r["k"]: (r["n"], r["s"], r["y"]) for r in got.collect()} == want
