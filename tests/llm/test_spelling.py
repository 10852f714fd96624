"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from archipelago.llm.spelling import LAST, counted_words, near_pairs, routes, spelling_variants
from archipelago.llm.wavelet import Wavelet


def near(v, w):
    if v == w or abs(len(v) - len(w)) > 1:
        return False
    if len(v) == len(w):
        return sum(x != y for x, y in zip(v, w, strict=True)) == 1
    v, w = sorted((v, w), key=len)
    return any(w[:k] + w[k + 1 :] == v for k in range(len(w)))


def some_words(seed, n=400):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 8))) for _ in range(25)]
    found = set()
    while len(found) < n:
        w = rnd.choice(stems) + "".join(rnd.choice("abé") for _ in range(rnd.randint(2, 3)))
        k = rnd.randrange(len(w))
        found.add(rnd.choice([w, w[:k] + rnd.choice("abéz") + w[k:], w[:k] + w[k + 1 :], "aaaaa" + w, "b" * rnd.randint(7, 20)]))
    return {w: rnd.choice([2, 3, 20, 45, 300, 4000]) for w in found if len(w) >= 7}


def brute(words):
    out = {}
    for w, n in words.items():
        around = [v for v in words if near(v, w)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        ok = best is not None and words[best] >= 10 * n
        out[w] = (best if ok else None, n, len(around), words[best] if ok else None)
    full = {}
    for w, (form, *rest) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        full[w] = (form, root, *rest)
    return full


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 37, 64):
        ys = rng.permutation(n)
        box = rng.integers(0, n + 1, size=(4, 50))
        who, y = Wavelet(ys).report(*box)
        want = {(k, int(v)) for k in range(50) for v in ys[box[0][k] : max(box[0][k], box[1][k])] if box[2][k] <= v < box[3][k]}
        assert set(zip(who.tolist(), y.tolist(), strict=True)) == want and len(who) == len(want)


def test_every_place_is_asked_once_of_all_shards_that_can_answer():
    words = sorted(some_words(5))
    back = sorted(w[::-1] for w in words)
    forward, backward = words[::40], back[::40]
    for w in words:
        asked = routes(w, forward, backward)
        for i in range(len(w) + 1):
            sides = {s: [shard for s2, shard, a, b in asked if s2 == s and a <= (i if s == 0 else len(w) - i) <= b] for s in (0, 1)}
            assert sum(bool(v) for v in sides.values()) == 1, (w, i)
            for s, begin in ((0, w[:i]), (1, w[::-1][: max(0, len(w) - i - 1)])):
                if sides[s]:
                    order, bounds = ((words, forward), (back, backward))[s]
                    home = {k for k in range(len(bounds)) for v in order[k * 40 : k * 40 + 40] if begin <= v < begin + LAST}
                    assert home <= set(sides[s]) and len(sides[s]) == len(set(sides[s]))


def test_pairs_and_forms_equal_brute_force_over_many_shards(spark):
    for seed, shard, asked in ((1, 30, 25), (2, 1000, 1000), (3, 7, 11)):
        words = some_words(seed)
        table = spark.createDataFrame(list(words.items()), "word string, n long")
        found = [(r["word"], r["near"]) for r in near_pairs(table, shard, asked).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(v, w) for v in words for w in words if near(v, w)}
        if seed == 1:
            rows = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(table).collect()}
            assert rows == brute(words)


def test_counted_words_odd_rows(spark):
    giant = "x" * 1_200_000
    rows = [
        (1, "Haltung haltung HALTUNG Überzug überzug kurz"), (1, "Haltung haltung HALTUNG Überzug überzug kurz"), (2, None), (3, ""), (None, "haltung überaus überaus"),
        (4, giant + " " + giant), (5, "ein " * 300_000 + "wortlang wortlang"), (6, "straße7straßenbau straßenbau × ÷ straßen÷bau"), (7, "einmalig"),
    ]
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    for every in (0, 3):
        want = Counter()
        for d, t in rows:
            for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
                if every and h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                want[w] += 1
        got = {r["word"]: r["n"] for r in counted_words(table, every=every).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_empty_and_single_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).collect() == []
    one = spark.createDataFrame([("einzeln", 5), ("y" * 100_000, 2)], "word string, n long")
    assert sorted((r["word"][:7], r["root"] == r["word"], r["n_near"]) for r in spelling_variants(one).collect()) == [("einzeln", True, 0), ("y" * 7, True, 0)]
