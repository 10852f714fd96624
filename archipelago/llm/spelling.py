"""Spelling variants grouped (operator 13).

The dictionary of a corpus (words of 7 letters or more that occur twice or more)
is joined with itself at one inserted, deleted or replaced letter.

1. Words are counted where texts are read, a batch at a time, and summed.
2. A word with a letter replaced at i has the first i letters of the word and
   those after i; with a letter inserted at i it has the first i and those from i
   on.  So its place in alphabetical order lies in the interval of a prefix, its
   place in the order of reversed words in the interval of a suffix.  A wavelet
   tree for each length of word reports the points in that rectangle, for all
   words and all places i.
3. The dictionary is cut into shards of some ``SHARD`` words twice, in
   alphabetical order and in that of reversed words, each shard with trees of its
   own.  A place i is asked in the order in which its interval lies in one shard;
   only where both go over several is it asked in each of those of the order with
   fewer.  Long prefixes and long suffixes are narrow, so most words ask one shard
   of each order.  Shards that many ask are copied, ``ASKED`` words to a copy.
4. An insertion is reported by the shorter word, for the foremost of places that
   give the same word, so every pair is found once; the longer one learns of it in
   the sum.  Neighbours are summed for each word; forms are followed to the last
   by doubling, as each is at least ``ratio`` times as frequent as the one before.

Defined results.  A null or empty text has no words.  A null ``doc_id`` is taken
as an empty one.  Rows with the same id and text count each.  Letters are
code points; only A-Z are lower-cased.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store
from archipelago.llm.wavelet import Wavelet

#: Words of a shard, words that ask one copy of it, and rectangles of one step.
SHARD, ASKED, STEP = 100_000, 300_000, 200_000
#: Bytes of a text in one step.
PIECE = 1 << 20
#: Beyond every letter of a word.
LAST = "Ā"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _pieces(text: bytes, run: re.Pattern) -> Iterator[tuple[int, int]]:
    """Cuts of a text between runs."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end] & 0xC0 == 0x80:
            end -= 1
        more = run.match(text, end)
        end = more.end() if more else end
        yield at, end
        at = end


def _counts(least: int, every: int):
    letter = rb"(?:[a-z]|\xc3[\x80-\xbf])"
    run, word = re.compile(letter + b"+"), re.compile(letter + b"{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[bytes] = Counter()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").encode().translate(_LOWER)
                begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                for a, b in _pieces(text, run):
                    for w, n in Counter(word.findall(text, a, b)).items():
                        h = zlib.crc32(w, begun)
                        if every and h % every == 0:
                            letters = w.decode()
                            k = h % len(letters)
                            w = (letters[:k] + letters[k + 1 :]).encode()
                            if len(letters) == least:
                                continue
                        total[w] += n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total]), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return count


def counted_words(docs: DataFrame, least: int = 7, occurrences: int = 2, every: int = 0) -> DataFrame:
    """``word, n`` of the words of at least ``least`` letters and ``occurrences``
    occurrences.  With ``every``, a letter is left out of one in so many of the
    words of each document, chosen by the CRC of id and word."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(least, every), "word string, n long")
    return store(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences), "words")


def _first_alone(word: str, bounds: list[str], sizes: range) -> tuple[int, int]:
    """The shortest beginning whose words all lie in one shard, and that shard."""
    low, high = sizes.start, sizes.stop
    while low < high:
        mid = (low + high) // 2
        a, b = _span(word[:mid], bounds)
        low, high = (low, mid) if a == b else (mid + 1, high)
    return low, (_span(word[:low], bounds)[0] if low < sizes.stop else -1)


def _span(beginning: str, bounds: list[str]) -> tuple[int, int]:
    """The first and the last shard that can have words with a beginning."""
    return max(0, bisect_right(bounds, beginning) - 1), max(0, bisect_right(bounds, beginning + LAST) - 1)


def routes(word: str, forward: list[str], backward: list[str]) -> list[tuple[int, int, int, int]]:
    """``side, shard, from, to``: where to ask for the places ``from..to`` of a
    word, counted in the order of that side (0: from the front, 1: from the back).
    A place stands for a letter replaced there and one inserted before it."""
    n, back = len(word), word[::-1]
    i, own = _first_alone(word, forward, range(n + 1))
    out = [(0, own, i, n)] if i <= n else []
    # place p from the back leaves p letters there unless replaced: then the letter at p - 1 goes too
    j, away = _first_alone(back, backward, range(n + 1))
    last = min(i, n + 1) - 1  # places 0..last are still to be asked
    most = min(last, n - j - 1)  # for those up to here the letters behind lie in one shard
    if most >= 0:
        out.append((1, away, n - most, n))
    for k in range(max(0, most + 1), last + 1):
        a, b = _span(word[:k], forward)
        c, d = _span(back[: max(0, n - k - 1)], backward)
        if b - a <= d - c:
            out += [(0, s, k, k) for s in range(a, b + 1)]
        else:
            out += [(1, s, n - k, n - k) for s in range(c, d + 1)]
    return out


def _routed(forward: list[tuple[str, int]], backward: list[tuple[str, int]]):
    sides = [[b for b, _ in forward], [b for b, _ in backward]]
    parts = [[p for _, p in forward], [p for _, p in backward]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, parts[s][shard], w if s == 0 else w[::-1], n, a, b) for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s, shard, a, b in routes(w, *sides)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["side", "shard", "asking", "m", "a", "b"])

    return run


def _letters(words: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(words.astype(f"<U{size}")).view(np.uint32).reshape(len(words), size)


def _narrowed(points: np.ndarray, asked: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of beginning: the words that ask, by number, and the interval
    of the sorted ``points`` that begin like them; words drop out once only they
    themselves (``own``: they are among the points) are left."""
    who, low, high = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.full(len(asked), len(points), np.int64)
    group = np.zeros(len(points), np.int64)
    for size in range(asked.shape[1] + 1):
        keep = high - low > own[who]
        who, low, high = who[keep], low[keep], high[keep]
        if not len(who):
            return
        yield size, who, low, high
        if size == asked.shape[1] or size == points.shape[1]:
            return
        key = (group << 21) | points[:, size]
        ask = (group[low] << 21) | asked[who, size]
        low, high = np.searchsorted(key, ask, "left"), np.searchsorted(key, ask, "right")
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])


def near_words(points: np.ndarray, asking: np.ndarray, a: np.ndarray, b: np.ndarray, mirrored: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs (number of the asking word, number of the point) with a letter replaced
    or, last of the three, inserted at one of the places ``a..b`` of the word.

    ``mirrored`` tells that all words are written from the back."""
    sizes, asks = np.char.str_len(points), np.char.str_len(asking)
    trees: dict[int, tuple] = {}

    def tree(size: int) -> tuple | None:
        if size not in trees:
            at = np.flatnonzero(sizes == size)
            if not len(at):
                return None
            at = at[np.argsort(points[at])]
            front = _letters(points[at], size)
            turned = np.ascontiguousarray(front[:, ::-1])
            order = np.argsort(turned.view(f"<U{size}").ravel(), kind="stable")
            place = np.empty(len(at), np.int64)
            place[order] = np.arange(len(at))
            trees[size] = at, front, turned[order], order, Wavelet(place)
        return trees[size]

    for size in np.unique(asks).tolist():
        asked = np.flatnonzero(asks == size)
        words = _letters(asking[asked], size)
        turned = np.ascontiguousarray(words[:, ::-1])
        for more in (0, 1):
            found = tree(size + more)
            if found is None:
                continue
            at, front, back, order, wavelet = found
            own = np.isin(asking[asked], points[at]).astype(np.int64) if not more else np.zeros(len(asked), np.int64)
            begins = {s: rest for s, *rest in _narrowed(front, words, own)}
            rects: list[tuple] = []
            waiting = 0

            def answers() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
                who, place, xlo, xhi, ylo, yhi = (np.concatenate(c) for c in zip(*rects, strict=True))
                hit, y = wavelet.report(xlo, xhi, ylo, yhi)
                who, place, point = who[hit], place[hit], order[y]
                letter = front[point, place]
                if more and mirrored:  # foremost from the front: the letter after it, from the back, differs
                    good = (place == size) | (words[who, np.minimum(place, size - 1)] != letter)
                elif more:
                    good = (place == 0) | (words[who, np.maximum(place, 1) - 1] != letter)
                else:
                    good = words[who, place] != letter
                yield asked[who[good]], at[point[good]], bool(more)

            for left, who, ylo, yhi in _narrowed(back, turned, own):
                place = size - left - (0 if more else 1)
                if place < 0 or place not in begins:
                    continue
                first, xlo, xhi = begins[place]
                both, i, j = np.intersect1d(first, who, assume_unique=True, return_indices=True)
                # from the back, the letter replaced at a place is the one before it
                stands = place + (1 if mirrored and not more else 0)
                want = (a[asked[both]] <= stands) & (stands <= b[asked[both]])
                both, i, j = both[want], i[want], j[want]
                for k in range(0, len(both), STEP):
                    cut = slice(k, k + STEP)
                    rects.append((both[cut], np.full(len(both[cut]), place), xlo[i[cut]], xhi[i[cut]], ylo[j[cut]], yhi[j[cut]]))
                    waiting += len(both[cut])
                    if waiting >= STEP:
                        yield from answers()
                        rects.clear()
                        waiting = 0
            if rects:
                yield from answers()


def _text(column: pa.ChunkedArray) -> np.ndarray:
    found = column.to_pylist()
    return np.array(found, dtype=np.str_) if found else np.empty(0, "<U1")


def _pairs(key: tuple, points: pa.Table, asking: pa.Table) -> pa.Table:
    mirrored = key[0].as_py() == 1
    words, ask = _text(points.column("word")), _text(asking.column("asking"))
    n, m = points.column("n").to_numpy(), asking.column("m").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    if len(words) and len(ask):
        for one, two, inserted in near_words(words, ask, asking.column("a").to_numpy(), asking.column("b").to_numpy(), mirrored):
            out.append((ask[one], words[two], n[two]))
            if inserted:
                out.append((words[two], ask[one], m[one]))
    whole = [np.concatenate([o[k] for o in out]) if out else [] for k in range(3)]
    texts = [[w[::-1] for w in c.tolist()] if mirrored else c.tolist() for c in whole[:2]] if out else [[], []]
    return pa.table({"word": pa.array(texts[0], pa.string()), "near": pa.array(texts[1], pa.string()), "near_n": pa.array(whole[2], pa.int64())})


def near_pairs(words: DataFrame, shard: int = SHARD, asked: int = ASKED) -> DataFrame:
    """``word, near, near_n``: every ordered pair of ``words(word, n)`` that differ
    by one letter."""
    size = max(1, -(-words.count() // shard))
    sides, bounds = [], []
    for side, turned in ((0, F.col("word")), (1, F.reverse("word"))):
        cut = words.select(turned.alias("word"), "n").repartitionByRange(size, "word").select(F.lit(side).alias("side"), F.spark_partition_id().alias("shard"), "word", "n")
        cut = store(cut, "shards")
        sides.append(cut)
        bounds.append(sorted((r["first"], r["shard"]) for r in cut.groupBy("shard").agg(F.min("word").alias("first")).collect()))
    asking = store(words.select("word", "n").mapInArrow(_routed(*bounds), "side int, shard int, asking string, m long, a int, b int"), "asking")
    copies = asking.groupBy("side", "shard").agg(F.ceil(F.count("*") / asked).cast("int").alias("copies"))
    points = sides[0].unionByName(sides[1]).join(F.broadcast(copies), ["side", "shard"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asking = asking.join(F.broadcast(copies), ["side", "shard"]).withColumn("copy", F.pmod(F.xxhash64("asking"), "copies").cast("int")).drop("copies")
    key = ["side", "shard", "copy"]
    return points.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_pairs, "word string, near string, near_n long")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``, each word once.

    The form is the near word of largest ``n`` (ties: the first in code-point
    order) if it is ``ratio`` times as frequent; the root is where forms end."""
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    form = F.when(-F.col("best.k") >= ratio * F.col("n"), F.col("best.near"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), -F.col("best.k")).alias("form_n"))
    rows = store(rows, "forms")
    up = store(rows.where("form IS NOT NULL").select("word", F.col("form").alias("top")), "roots")
    while True:
        above = up.select(F.col("word").alias("top"), F.col("top").alias("over"))
        after = store(up.join(above, "top", "left").select("word", F.coalesce("over", "top").alias("top"), F.col("over").isNotNull().alias("moved")), "roots")
        more = after.where("moved").head(1)
        drop(up)
        up = after.select("word", "top")
        up._stored_at = after._stored_at
        if not more:
            break
    return rows.join(up, "word", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
