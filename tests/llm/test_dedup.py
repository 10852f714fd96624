"""Near duplicates, lines, passages: against brute force, and odd tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archipelago.llm.components import connected_components, union_find
from archipelago.llm import line_dedup as lines_module
from archipelago.llm import textkit
from archipelago.llm.line_dedup import SHINGLE, duplicate_lines, line_dedup, without_lines
from archipelago.llm.minhash_dedup import near_duplicates
from archipelago.llm.substring import _dealt, _Flat, align, chains, repeated_passages, single_runs
from archipelago.llm.textkit import STEP, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hub string, key long"
WORDS = [f"w{k}" for k in range(400)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], DOCS)


def shingle_set(text, size):
    words = text.encode().lower().split()
    size = min(size, len(words))
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if size else set()


def prose(rnd, n):
    return [rnd.choice(WORDS) for _ in range(n)]


def edited(rnd, words, share):
    return [w if rnd.random() > share else rnd.choice(WORDS) for w in words]


def corpus(seed=1):
    rnd = random.Random(seed)
    rows, n = [], 0
    for _ in range(6):
        base = prose(rnd, rnd.randint(30, 120))
        for _ in range(rnd.randint(2, 9)):
            rows.append((n, " ".join(edited(rnd, base, rnd.choice([0, 0.02, 0.05, 0.1])))))
            n += 1
    rows += [(n + k, " ".join(prose(rnd, rnd.randint(1, 60)))) for k in range(15)]
    rnd.shuffle(rows)
    return rows


def components(ids, links):
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        head[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,percent", [(2, 80), (5, 80), (1, 60)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rows = corpus()
    sets = {i: shingle_set(t, size) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, near)
    found = near_duplicates(table(spark, rows), size, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in found)
    assert len(near) > 5


def test_near_duplicates_odd_rows(spark):
    long_ = "a" * 50_000 + " " + " ".join(WORDS * 300)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x y z"), (None, "x y z"), (4, "x y z"), (5, "X Y\tZ"), (6, "one"), (7, "ONE"), (7, "ONE"), (8, long_), (9, long_), (10, "É é"), (11, "é é")]
    found = sorted(near_duplicates(table(spark, rows), 2).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(found) == len(rows)
    ids = {r["doc_id"]: r["component_id"] for r in found}
    assert ids == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 11, None: None}
    assert all(r["kept"] for r in found if r["doc_id"] in (1, 2, 3, None)) and {r["n_shingles"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert near_duplicates(table(spark, rows).limit(0), 2).count() == 0


def test_partners_of_a_hub_are_compared(spark):
    """A chain of copies, each near the next only, is one component."""
    rnd = random.Random(5)
    words, rows = prose(rnd, 60), []
    for k in range(12):
        rows.append((k if k % 2 else 100 - k, " ".join(words)))
        words = words[2:] + prose(rnd, 2)
    found = {r["component_id"] for r in near_duplicates(table(spark, rows), 2).collect()}
    assert found == {1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(0, None), (5, 5), *[(k, k + 1) for k in range(200, 240)]]
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    assert found == components({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_over_step_ends():
    rnd = random.Random(2)
    text = b" ".join(rnd.choice(WORDS).encode() for _ in range(400_000))
    assert len(text) > STEP
    hashes, starts = word_hashes(text)
    words = text.split()
    one = {w: word_hashes(w)[0][0] for w in set(words)}
    assert len(hashes) == len(words) and all(h == one[w] for h, w in zip(hashes, words, strict=True))
    assert all(text[s : s + 1] == b"w" for s in starts)
    assert len(word_hashes(b"z" * (2 * STEP + 5))[0]) == 1 and len(word_hashes(b"")[0]) == 0
    assert word_hashes(b"ABC")[0] == word_hashes(b"abc")[0] and word_hashes(b"ABC", fold=False)[0] != word_hashes(b"abc", fold=False)[0]


def test_words_made_to_break_a_hash_stay_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, word[:1024], other[:1024], word[:1024] + other[:1024], "a" * 2048, "b" * 2048, "\0", "\0\0"]
    assert len({int(word_hashes(t.encode())[0][0]) for t in texts}) == len(set(texts))
    rows = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(list(enumerate([word, other, word])), "doc_id long, text string"), 2, 80).collect()}
    assert [rows[k]["component_id"] for k in range(3)] == [0, 1, 0]


def test_word_hash_sums_a_value_for_each_place():
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abzZ\u00e9") for _ in range(rnd.choice([1, 5, 63, 64, 65, 300]))) for _ in range(500)).encode()
    for fold in (True, False):
        words = [w.lower() if fold else w for w in text.split()]
        by_hand = [sum(int(v) for v in textkit._values(np.array([256 * k + c for k, c in enumerate(w)]))) % (1 << 64) for w in words]
        assert word_hashes(text, fold)[0].tolist() == textkit.mix(np.array(by_hand, np.uint64)).tolist()


def lines_by_hand(rows, percent=80):
    lines = [(i, k, x.strip(" ").lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    sets = {x: {x[j : j + SHINGLE] for j in range(max(1, len(x) - SHINGLE + 1))} for _, _, x in lines}
    names = list(sets)
    near = [(a, b) for a, b in itertools.combinations(range(len(names)), 2) if 100 * len(sets[names[a]] & sets[names[b]]) >= percent * len(sets[names[a]] | sets[names[b]])]
    group = components(range(len(names)), near)
    place = {x: n for n, x in enumerate(names)}
    first = {}
    for i, k, x in sorted(lines):
        first.setdefault(group[place[x]], (i, k))
    gone = defaultdict(list)
    for i, k, x in lines:
        if first[group[place[x]]] != (i, k):
            gone[i].append(k)
    return lines, gone


def test_lines_equal_brute_force(spark):
    rnd = random.Random(4)
    bases = ["".join(rnd.choice("abcdefgh éü") for _ in range(rnd.randint(9, 90))) for _ in range(25)]
    rows = []
    for i in range(30):
        text = []
        for _ in range(rnd.randint(1, 6)):
            x = list(rnd.choice(bases))
            if rnd.random() < 0.4:
                x[rnd.randrange(len(x))] = rnd.choice("xyz")
            text.append("".join(x))
        rows.append((i, "\n".join(text)))
    lines, gone = lines_by_hand(rows)
    found = {r["doc_id"]: r for r in line_dedup(table(spark, rows)).collect()}
    counts = Counter(i for i, _, _ in lines)
    assert {i: r["n_lines"] for i, r in found.items()} == dict(counts)
    assert {i: r["removed_lines"] for i, r in found.items()} == {i: ",".join(map(str, sorted(gone[i]))) for i in counts}
    assert sum(map(len, gone.values())) > 20


def test_lines_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (None, "same line here"), (4, "same line here\n\nx"), (4, "Same line here "), (5, "x\nxy\n" + "q" * 30_000), (6, "q" * 30_000)]
    found = line_dedup(table(spark, rows)).collect()
    by = [(r["doc_id"], r["n_lines"], r["n_kept"], r["removed_lines"]) for r in found]
    assert sorted(by, key=str) == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (None, 1, 1, ""), (4, 2, 1, "0"), (4, 1, 0, "0"), (5, 3, 2, "0"), (6, 1, 0, "0")], key=str)
    clean = {(r["doc_id"], r["text"]) for r in without_lines(table(spark, rows)).collect()}
    assert (4, "\nx") in clean and (4, "") in clean and (2, "") in clean
    assert duplicate_lines(table(spark, rows).limit(0)).count() == 0


def test_lines_with_one_changed_character(spark):
    """One character inside a line of 60 to 80 characters is a near copy."""
    rnd = random.Random(12)
    rows = []
    for k in range(150):
        x = [rnd.choice("abcdefghijklmnop rstuvwxyz") for _ in range(rnd.randint(60, 80))]
        y = list(x)
        at = rnd.randrange(10, len(x) - 10)
        y[at] = "Q" if x[at] != "q" else "Z"
        rows.append((k, "x" + "".join(x) + "x\nz" + "".join(y) + "z" if k % 2 else "x" + "".join(x) + "x\nx" + "".join(y) + "x"))
    lines, gone = lines_by_hand(rows)
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup(table(spark, rows)).collect()}
    want = {i: ",".join(map(str, sorted(gone[i]))) for i in range(150)}
    missed = sum(found[i] != want[i] for i in want)
    assert sum(map(bool, want.values())) >= 75 and missed <= 2


def test_every_shingle_of_a_line_counts(spark):
    """Of short lines at the share few are lost, as all their shingles make the minima."""
    rnd, rows = random.Random(21), []
    for k in range(4000):
        x = [chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(53)]
        rows.append((k, "".join(x) + "\n" + "".join([*x[:26], "q", *x[27:]])))
    found = line_dedup(table(spark, rows)).collect()
    assert sum(r["removed_lines"] != "1" for r in found) <= 8


def test_partly_alike_lines_are_no_candidates(spark, monkeypatch):
    """Lines that share most of a template, but not enough, are told apart by their
    sketches: pairs of a bucket that are no links do not become rows."""
    rnd, letters, sizes = random.Random(31), "abcdefghijklmnopqrstuvwxyz", []
    template = "".join(rnd.choice(letters) for _ in range(150))
    many = [template + "".join(rnd.choice(letters) for _ in range(50)) for _ in range(120)]
    rows = list(enumerate([*many, *(x[:100] + "#" + x[101:] for x in many[:20])]))
    confirmed = lines_module._confirmed

    def counted(pairs, texts, percent):
        sizes.append(pairs.count())
        return confirmed(pairs, texts, percent)

    monkeypatch.setattr(lines_module, "_confirmed", counted)
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup(table(spark, rows)).collect()}
    _, gone = lines_by_hand(rows)
    assert {i for i, x in found.items() if x} == set(gone) and len(gone) == 20
    # first come the pairs with hubs, then those within buckets
    assert sum(sizes[1:]) <= 60


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_sketches_rule_out_no_link(spark, percent):
    rnd = random.Random(percent)
    rows = []
    for k in range(400):
        x = [rnd.choice("abcd") for _ in range(rnd.choice([3, 20, 80, 700]))]
        y = [c if rnd.random() > rnd.choice([0, 0.01, 0.04]) else "z" for c in x] + ["q"] * rnd.choice([0, 1, 5])
        rows.append((k, "".join(x), "".join(y)))
    sets = [[{t[j : j + SHINGLE] for j in range(max(1, len(t) - SHINGLE + 1))} for t in r[1:]] for r in rows]
    linked = {k for k, (a, b) in enumerate(sets) if 100 * len(a & b) >= percent * len(a | b)}
    both = spark.createDataFrame(rows, "id long, a string, b string").cache()
    one, two = (lines_module._sketched(both.select("id", F.col(c).alias("line"))).select("id", F.struct("n", *lines_module._SKETCH).alias(f"s{c}")) for c in "ab")
    left = {r["id"] for r in one.join(two, "id").where(lines_module._possible("sa", "sb", percent)).select("id").collect()}
    assert linked <= left and len(left) < 400 and len(linked) > 50


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_union_find(spark, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(0, None), (5, 5), *[(k, k + 1) for k in range(200, 230)], *[(300, k) for k in range(301, 330)], *[(499, k) for k in range(400, 420)]]
    found = {r["id"]: r["component"] for r in union_find(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if b is not None and a != b]
    assert found == components({x for p in real for x in p}, real)
    assert union_find(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_follow_order():
    x = np.array([0, 10, 20, 30, 40, 200])
    y = np.array([5, 15, 25, 90, 45, 1])
    best = chains(x, y)[0]
    assert x[best].tolist() == [0, 10, 20, 40] and y[best].tolist() == [5, 15, 25, 45]
    assert sorted(np.concatenate(chains(x, y)).tolist()) == list(range(6))


def test_alignment():
    a = np.arange(100)
    b = np.concatenate([[-1, -2, -3], a[10:40], [-9], a[41:80], [-4]])
    assert align([20, 50], [13, 43], a, b, 0, 0) == (10, 80, 3, 73, 69)


def test_runs_are_aligned_alike_at_once():
    rnd = np.random.default_rng(3)
    made = []
    for _ in range(300):
        a, b = rnd.integers(0, 3, rnd.integers(20, 90)), rnd.integers(0, 3, rnd.integers(20, 90))
        size = int(rnd.integers(4, 15))
        x, y = int(rnd.integers(0, len(a) - size)), int(rnd.integers(0, len(b) - size))
        b[y : y + size] = a[x : x + size]
        made.append((x, y, size, a, b, int(rnd.integers(0, 9)), int(rnd.integers(0, 9))))
    x, y, size = (np.array([m[k] for m in made]) for k in range(3))
    flat = [_Flat(pa.array([m[k].astype("<u4").tobytes() for m in made], pa.binary())) for k in (3, 4)]
    before, after, more = single_runs(x, y, size, *flat, np.arange(len(made)))
    found = list(zip(x - before, x + size + after, y - before, y + size + after, size + more, strict=True))
    assert found == [align([x, x + n - 4], [y, y + n - 4], a, b, 0, 0) for x, y, n, a, b, _, _ in made]


def test_passages(spark):
    rnd = random.Random(9)
    words = [f"v{k}" for k in range(5000)]
    fresh = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, short = fresh(70), fresh(30)
    fuzzy = [w if k % 20 else "changed" for k, w in enumerate(passage, 1)]
    texts = {
        1: fresh(40) + passage + fresh(50), 2: fresh(90) + passage + fresh(10), 3: fuzzy + fresh(80), 4: short + fresh(60), 5: fresh(60) + short, 6: fresh(300),
    }
    rows = [(k, " ".join(v)) for k, v in texts.items()]
    rows += [(7, rows[5][1]), (8, rows[5][1].replace(" ", "  ")), (9, None), (10, ""), (None, rows[0][1]), (11, "few words"), (12, "few words")]
    found = repeated_passages(table(spark, rows)).collect()
    spans = {(r["doc_id"], r["other_id"]): (r["start"], r["end"], r["other_start"], r["other_end"], r["matched"]) for r in found}
    assert spans[2, 1] == (90, 160, 40, 110, 70)
    s = spans[3, 1]
    assert s[0] <= 1 and 65 <= s[1] <= 71 and s[4] >= 60
    assert spans[7, 6] == spans[8, 6] == (0, 300, 0, 300, 300)
    assert set(spans) == {(2, 1), (3, 1), (7, 6), (8, 6)}
    assert repeated_passages(table(spark, rows).limit(0)).count() == 0


def spread_changes(rnd, words, every):
    return [w if k % every else f"new{rnd.randrange(10**9)}" for k, w in enumerate(words, 1)]


@pytest.mark.parametrize("n,every", [(50, 5), (60, 5), (60, 8), (60, 9), (60, 10), (100, 6), (100, 9), (60, 12)])
def test_fuzzy_passages_down_to_the_share(spark, n, every):
    """Passages changed evenly have few words in a row; all are found."""
    rnd = random.Random(n * every)
    fresh = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 60, 2):
        passage = fresh(n)
        rows += [(k, " ".join(fresh(20) + passage + fresh(9))), (k + 1, " ".join(fresh(7) + spread_changes(rnd, passage, every) + fresh(30)))]
    found = {(r["doc_id"], r["other_id"]) for r in repeated_passages(table(spark, rows), min_words=50 - 1, percent=80).collect()}
    assert found == {(k + 1, k) for k in range(0, 60, 2)}


def test_passages_beyond_the_first_partner(spark):
    """Partners are compared though each seed's first document holds too little."""
    rnd = random.Random(3)
    fresh = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    whole, twice = fresh(60), fresh(60)
    rows = [(1, fresh(30) + whole[:40] + fresh(30)), (2, fresh(30) + whole[20:] + fresh(30)), (3, fresh(30) + whole + fresh(20)), (4, fresh(10) + whole + fresh(30))]
    rows += [(5, fresh(20) + twice), (6, fresh(15) + twice + fresh(200) + twice + fresh(5))]
    found = repeated_passages(table(spark, [(k, " ".join(v)) for k, v in rows])).collect()
    spans = sorted((r["doc_id"], r["other_id"], r["start"], r["end"]) for r in found)
    assert spans == [(4, 3, 10, 70), (6, 5, 15, 75), (6, 5, 275, 335)]


def covered_by_hand(texts, least=50):
    """Words of each text in a run of ``least`` words that an earlier text has."""
    seen, out = set(), {}
    for k in sorted(texts):
        w = texts[k]
        mine = [tuple(w[p : p + least]) for p in range(len(w) - least + 1)]
        out[k] = {q for p, run in enumerate(mine) if run in seen for q in range(p, p + least)}
        seen |= set(mine)
    return out


@pytest.mark.parametrize("seed,n", [(1, 40), (2, 220)])
def test_equal_runs_are_all_found(spark, seed, n):
    """Texts put together from few sentences, which most texts hold: every run of
    50 words that an earlier text has is listed, also where seeds are frequent."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    sentences = [fresh(rnd.randint(8, 45)) for _ in range(14)]
    texts = {}
    for k in range(n):
        at, parts = rnd.randrange(14), []
        for _ in range(rnd.randint(1, 9)):
            at = (at + 1) % 14 if rnd.random() < 0.7 else rnd.randrange(14)
            parts.append(fresh(rnd.randint(1, 20)) if rnd.random() < 0.2 else sentences[at])
        texts[k] = [w for p in parts for w in p]
    found = defaultdict(set)
    for r in repeated_passages(table(spark, [(k, " ".join(t)) for k, t in texts.items()])).collect():
        assert r["other_id"] < r["doc_id"]
        found[r["doc_id"]] |= set(range(r["start"], r["end"]))
    want = covered_by_hand(texts)
    assert sum(map(len, want.values())) > 1500
    assert all(want[k] <= found[k] for k in texts)


def test_pieces_of_a_passage_do_not_hide_it(spark):
    rnd = random.Random(11)
    fresh = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    whole, twice = fresh(120), fresh(80)
    texts = {k: fresh(20) + whole[24 * (k - 1) : 24 * k] + fresh(30) for k in range(1, 6)}
    texts |= {10: fresh(9) + whole + fresh(40), 11: fresh(50) + whole + fresh(3)}
    texts |= {20: fresh(5) + twice + fresh(9), 21: twice + fresh(40) + twice}
    found = {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in repeated_passages(table(spark, [(k, " ".join(t)) for k, t in texts.items()])).collect()}
    assert found == {(11, 10, 50, 170), (21, 20, 0, 80), (21, 20, 120, 200)}


def on_diagonals(a, b, least=50, percent=80):
    """Whether ``least`` words or more of two texts agree in ``percent`` % of their places."""
    for d in range(least - len(b), len(a) - least + 1):
        same = np.array([u == v for u, v in zip(a[max(0, d) :], b[max(0, -d) :], strict=False)])
        gain = np.append(0, np.cumsum(np.where(same, 100 - percent, -percent)))
        if len(same) >= least and (gain[least:] >= np.minimum.accumulate(gain)[: len(gain) - least]).any():
            return True
    return False


def test_fuzzy_passages_of_frequent_seeds(spark):
    """Passages all of whose seeds are frequent are found, though they agree with
    none of the first documents that have the seeds."""
    rnd = random.Random(17)
    fresh = lambda n: [f"v{rnd.randrange(10**9)}" for _ in range(n)]
    pieces = [fresh(8) for _ in range(12)]
    join = lambda order: [w for k in order for w in pieces[k] + fresh(1)]
    texts = {k: [w for p in rnd.sample(pieces, 12) for w in fresh(6) + p] for k in range(80)}
    for k in range(100, 116, 2):
        order = rnd.sample(range(12), 7)
        texts |= {k: fresh(15) + join(order) + fresh(9), k + 1: fresh(rnd.randint(0, 40)) + join(order) + fresh(20)}
    texts[120] = fresh(8) + join(range(12)) + fresh(4)
    texts[121] = join(range(6)) + fresh(30) + join(range(6, 12))
    found = {(r["doc_id"], r["other_id"]) for r in repeated_passages(table(spark, [(k, " ".join(t)) for k, t in texts.items()])).collect()}
    want = {(b, a) for b in texts for a in texts if 100 <= a < b and on_diagonals(texts[a], texts[b])}
    assert {(k + 1, k) for k in range(100, 116, 2)} | {(121, 120)} <= want
    assert found == want


def test_parts_of_a_seed_go_to_different_tasks(spark):
    """Every two places of a seed meet once, and not all of them in one task."""
    rows = [(7, 0, -1, b"", doc, doc % 5) for doc in range(60)] + [(8, 0, -1, b"", 1, 1)]
    same = spark.createDataFrame(rows, "seed long, kind int, side int, around binary, doc long, pos int")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(keep, ("8", "false"), strict=True):
            spark.conf.set(k, v)
        found = _dealt(same, 10).select("*", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r["seed"] for r in found} == {7}
    tasks, groups = defaultdict(set), defaultdict(list)
    for r in found:
        tasks[r["i"], r["j"]].add(r["task"])
        groups[r["i"], r["j"]].append((r["doc"], r["part"]))
    met = Counter(frozenset((a, b)) for (i, j), g in groups.items() for (a, p), (b, q) in itertools.combinations(g, 2) if {p, q} == {i, j})
    assert met == Counter(frozenset(x) for x in itertools.combinations(range(60), 2))
    assert all(len(t) == 1 for t in tasks.values()) and len(set().union(*tasks.values())) >= 4


def test_passages_of_repeated_words(spark):
    rows = [(1, "buy " * 3000 + "now"), (2, "stop " + "buy " * 2000 + "here")]
    found = repeated_passages(table(spark, rows)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(2, 1)} and max(r["matched"] for r in found) == 2000


def test_copies_of_one_line_meet_it_first(spark, monkeypatch):
    """Copies near their pattern, but not each other, are linked through the pattern:
    the pairs compared exactly do not grow with the square of the group."""
    rnd, letters, sizes = random.Random(41), "abcdefghijklmnopqrstuvwxyz", []
    base = [rnd.choice(letters) for _ in range(400)]
    rows = [(0, "".join(base))]
    for k in range(1, 151):
        x = list(base)
        for at in rnd.sample(range(5, 395), 5):
            x[at] = rnd.choice("0123456789")
        rows.append((k, "".join(x)))
    confirmed = lines_module._confirmed

    def counted(pairs, texts, percent):
        sizes.append(pairs.count())
        return confirmed(pairs, texts, percent)

    monkeypatch.setattr(lines_module, "_confirmed", counted)
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup(table(spark, rows)).collect()}
    _, gone = lines_by_hand(rows)
    assert {i for i, x in found.items() if x} == set(gone) and len(gone) == 150
    assert sum(sizes) <= 4 * len(rows)


def test_minima_and_sketches_do_not_depend_on_the_step(spark, monkeypatch):
    rnd = random.Random(43)
    lines = spark.createDataFrame([(k, "".join(rnd.choice("ab é") for _ in range(k % 60 + 1))) for k in range(300)], "id long, line string").cache()
    found = []
    for step in (2, lines_module.STEP):
        monkeypatch.setattr(lines_module, "STEP", step)
        found.append([sorted(map(tuple, f(lines).collect())) for f in (lines_module._minima, lines_module._sketched)])
    assert found[0] == found[1] and len(found[0][0]) == len(found[0][1]) == 300
