"""Toxicity by non-negative positive-unlabelled learning (operator 12).

Toxic examples are confirmed; of all other texts nothing is known.  A logistic
model f is fitted so that the risk ``prior * E_pos[l(f)] + max(0, E_unl[l(-f)] -
prior * E_pos[l(-f)])`` is least: what toxic texts among the unlabelled ones add to
the second part is taken off by the prior, and where that goes below nought, as it
does once the model learns its examples by heart, steps go the other way.

1. The words of the confirmed examples that two of them share are candidates.
2. One pass over all texts finds each text's candidates; they are counted over
   the whole corpus.
3. Features are the candidates that toxic texts have ``LIFT`` times as often as
   the corpus, by a likelihood-ratio test with Bonferroni's correction.
4. The corpus is dealt at random to shards of some ``SHARD`` texts, equal sets of
   features of a shard are one row with a count.  Each task fits a model to one
   shard and all examples with numpy; the mean of the models is where the next
   round begins.  Sums are of whole numbers, so no order of tasks changes them.
5. Every text is scored from what step 2 stored.

Bounds: ``POSITIVES`` examples, chosen by a hash of their id, ``CANDIDATES`` words,
the most frequent in examples, and ``FEATURES``, the most telling.  All texts are
counted, learnt from as unlabelled ones (but those held out) and scored.

Nothing but the text goes into a score.  A text is held out if the CRC of its id
modulo 5 is 0; labels of such are not read.  The prior is the toxic share of the
other labels; ``PRIOR`` if they have one class only.

Defined results.  A null or empty text has no words and the score of one without
features.  A null id is held out.  Rows of equal id are scored each; the example of
an id is the one whose text has the least hash.  Of labels of one id the largest
counts.  Without examples every score is 0.  Words are runs of ASCII letters and
all other characters beyond ASCII, A-Z lower-cased; those of more than 64 bytes are
no candidates.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store

POSITIVES, CANDIDATES, FEATURES = 5_000, 65_000, 4_096
LIFT, PRIOR = 1.5, 0.1
#: Texts of a shard; rounds of fitting, and a fit's steps, step size and penalty.
SHARD, ROUNDS, STEPS, RATE, L2 = 200_000, 2, 200, 0.2, 1e-5
#: Weights are summed in steps of this size.
UNIT = 1 << 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(_WORDS).split())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Rows:
    """Sets of features, one after the other, and how many texts have each."""

    slots: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(sets: list[np.ndarray], counts: list[int] | np.ndarray) -> Rows:
        return Rows(np.concatenate(sets or [np.empty(0)]).astype(np.int64), np.cumsum([len(s) for s in sets]), np.asarray(counts, float))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The last weight is that of every text."""
        upto = np.concatenate([[0.0], np.cumsum(weights[self.slots])])
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        return upto[self.ends] - upto[starts] + weights[-1]

    def pulled(self, pull: np.ndarray, size: int) -> np.ndarray:
        """The gradient of scores by weights, each row's times ``pull``."""
        each = np.repeat(pull, np.diff(np.concatenate([[0], self.ends]).astype(np.int64)))
        return np.append(np.bincount(self.slots, each, size), pull.sum())


def fit_nnpu(positive: Rows, unlabelled: Rows, size: int, prior: float, start: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """Weights of ``size`` features and of every text, by Adam over all rows."""
    w = np.append(np.zeros(size), -2.0) if start is None else start.copy()
    a, b = positive.counts / positive.counts.sum(), unlabelled.counts / unlabelled.counts.sum()
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        fp, fu = positive.scores(w), unlabelled.scores(w)
        negative = (b * np.logaddexp(0, fu)).sum() - prior * (a * np.logaddexp(0, fp)).sum()
        taken = unlabelled.pulled(b * _sigmoid(fu), size) - positive.pulled(prior * a * _sigmoid(fp), size)
        gradient = positive.pulled(-prior * a * _sigmoid(-fp), size) + taken if negative >= 0 else -taken
        gradient[:size] += L2 * w[:size]
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
        rate = RATE * (0.5 + 0.5 * math.cos(math.pi * t / steps))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def telling(toxic: np.ndarray, among: int, everywhere: np.ndarray, total: int) -> np.ndarray:
    """The candidates that are features, most telling first: ``toxic`` of ``among``
    examples have it and ``everywhere`` of ``total`` texts."""
    share, rate = toxic / max(among, 1), np.clip(everywhere / max(total, 1), 1e-12, 1 - 1e-12)
    some = np.clip(share, 1e-12, 1 - 1e-12)
    ratio = 2 * among * (share * np.log(some / rate) + (1 - share) * np.log((1 - some) / (1 - rate)))
    good = np.flatnonzero((share >= LIFT * rate) & (ratio >= 2 * math.log(max(2, len(toxic)))))
    return good[np.argsort(-ratio[good], kind="stable")][:FEATURES]


def held_out() -> Column:
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5) == 0


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter[bytes] = Counter()
        for text in batch.column(0):
            found.update(w for w in words(text.as_py()) if len(w) <= 64)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "k"])


def _found(places: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.array(sorted(places[w] for w in words(t.as_py()) if w in places), np.uint16).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(sets, pa.binary())], ["doc_id", "held_out", "found"])

    return run


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(size, np.int64), 0
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=size)
            rows += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, size), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["slot", "n"])

    return run


def _narrowed(slot_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for raw in batch.column("found").to_pylist():
                mine = slot_of[np.frombuffer(raw, np.uint16)]
                sets.append(np.sort(mine[mine >= 0]).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(sets, pa.binary())], ["shard", "slots"])

    return run


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint16) for r in raw]


def _shard_fit(positive: Rows, size: int, prior: float, start: np.ndarray | None, steps: int):
    def run(rows: pa.Table) -> pa.Table:
        counts = rows.column("n").to_numpy()
        order = np.argsort(np.array([r.hex() for r in rows.column("slots").to_pylist()]), kind="stable")
        sets = _sets(rows.column("slots").to_pylist())
        w = fit_nnpu(positive, Rows.of([sets[k] for k in order], counts[order]), size, prior, start, steps)
        return pa.table({"slot": pa.array(range(size + 1), pa.int32()), "w": pa.array(np.round(w * UNIT).astype(np.int64) * int(counts.sum())), "n": pa.array([int(counts.sum())] * (size + 1), pa.int64())})

    return run


def _scored(weights: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if weights is None:
                score = np.zeros(batch.num_rows)
            else:
                score = _sigmoid(Rows.of(_sets(batch.column("found").to_pylist()), np.ones(batch.num_rows)).scores(weights))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, shard: int = SHARD, steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = prior if prior is not None else share if share and share < 1 else PRIOR
    chosen = known.where("toxic = 1").join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")
    chosen = store(chosen, "examples")
    examples = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    examples = store(examples, "examples")
    among = examples.count()
    counts = examples.select("text").mapInArrow(_example_words, "word binary, k long").groupBy("word").agg(F.sum("k").alias("k")).where("k >= 2")
    best = [(bytes(r["word"]), r["k"]) for r in counts.orderBy(F.desc("k"), "word").limit(CANDIDATES).collect()]
    places = {w: k for k, (w, _) in enumerate(best)}
    found = store(rows.mapInArrow(_found(places), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, found binary"), "found")
    weights = None
    if among:
        everywhere = np.zeros(len(best) + 1, np.int64)
        for r in found.select("found").mapInArrow(_counted(len(best)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            everywhere[r["slot"]] = r["n"]
        total = int(everywhere[-1])
        features = telling(np.array([k for _, k in best], float), among, everywhere[:-1].astype(float), total)
        slot_of = np.full(len(best), -1, np.int64)
        slot_of[features] = np.arange(len(features))
        mine = [slot_of[[places[w] for w in words(r["text"]) if w in places]] for r in examples.orderBy("doc_id").toLocalIterator()]
        positive = Rows.of([np.sort(s[s >= 0]) for s in mine], np.ones(len(mine)))
        shards = max(1, -(-total // shard))
        dealt = found.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
        sets = dealt.where("NOT held_out").select("shard", "found").mapInArrow(_narrowed(slot_of), "shard int, slots binary").groupBy("shard", "slots").agg(F.count("*").alias("n"))
        sets = store(sets, "sets")
        model = None
        for _ in range(rounds):
            fitted = sets.groupBy("shard").applyInArrow(_shard_fit(positive, len(features), prior, model, steps), "slot int, w long, n long")
            model = np.append(np.zeros(len(features)), -2.0) if model is None else model
            for r in fitted.groupBy("slot").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():
                model[r["slot"]] = r["w"] / UNIT / r["n"]
        drop(sets)
        weights = np.append(np.zeros(len(best)), model[-1])
        weights[features] = model[:-1]
    return found.mapInArrow(_scored(weights), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
