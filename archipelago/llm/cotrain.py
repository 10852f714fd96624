"""Quality classification by co-training (operator 5).

Two views of a document: its text's content (hashed words, word pairs and
character statistics) and its metadata (source, language, length, shape of
lines).  A logistic regression on each view is fitted to a bounded sample of
labelled documents.  In every round each view scores all unlabelled documents
of the corpus; per source and class the share that it is surest about teaches
the other view, a document once for each view.  Both views are calibrated on
held-out labels (a logistic curve over each score), and the sum of the
calibrated log-odds, weighted by a third fit on the same labels, scores every
document of the corpus in one narrow pass.  Texts are read once, into a table of
packed features; rounds and scores read that.

Bounds: the rows with labels that models are fitted on, ``labelled`` given ones
and ``taught`` pseudo-labelled ones a round and view, chosen by a hash of the id
among all that qualify.  What qualifies is settled over the whole corpus.

Defined results.  A null or empty text has no content features and is judged by
the intercepts and the metadata.  Null metadata are values of their own.  A null
id is scored like any other; of rows of one id each is scored, and one is learnt
from.  Without labels of both classes the score is the
share of good labels (0.5 without any) for all.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store
from archipelago.llm.textkit import mix, word_hashes

#: Rows fitted on at most: with given labels, and with pseudo-labels a round and view.
LABELLED, TAUGHT = 6000, 600
TEXT_BITS, META_BITS = 14, 10
#: Rounds of teaching, and the share of a source's unlabelled rows that a view is
#: surest about.
ROUNDS, SURE = 2, 0.3
EPOCHS, MORE_EPOCHS = 300, 100

_MARKS = np.zeros(256, np.int64)
for _k, _group in enumerate((b"#*$%&|<>!", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:?", b"\n")):
    _MARKS[list(_group)] = _k + 1


def text_counts(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the content view's words and pairs, ascending, how often each is
    met, and the text's statistics; all are empty for a text without words."""
    words = word_hashes(text, exact=False)[0]
    n = len(words)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    slot, count = np.unique((np.concatenate([words, pairs]) >> np.uint64(64 - TEXT_BITS)).astype(np.int64), return_counts=True)
    shape = np.bincount(_MARKS[np.frombuffer(text, np.uint8)], minlength=6)[1:] / len(text)
    repeats = 1 - len(np.unique(words)) / n
    again = 1 - len(np.unique(pairs)) / max(1, len(pairs))
    return slot, count, np.array([*np.sqrt(shape), repeats, again, np.log1p(n) / 10, len(text) / n / 20])


#: Statistics of a text.
EXTRA = 9


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the content view; the counts' values have length one."""
    slot, count, extra = text_counts(text)
    value = np.log1p(count)
    value = value / np.sqrt((value**2).sum()) if len(value) else value
    return np.concatenate([slot, (1 << TEXT_BITS) + np.arange(len(extra))]), np.concatenate([value, extra])


TEXT_SIZE = (1 << TEXT_BITS) + EXTRA


@lru_cache(maxsize=1 << 16)
def _meta_slot(name: str) -> int:
    return int(word_hashes(name.encode().replace(b" ", b"_"), exact=False)[0][0] >> np.uint64(64 - META_BITS))


def meta_features(source, lang, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the metadata view."""
    lines = text.count(b"\n") + 1
    size = int(np.log2(len(text) + 1))
    names = [f"source={source}", f"lang={lang}", f"size={size}", f"lines={int(np.log2(lines))}", f"line={int(np.log2(len(text) / lines + 1))}", f"lang={lang},size={size}"]
    return np.array([_meta_slot(n) for n in names], np.int64), np.ones(len(names))


META_SIZE = 1 << META_BITS


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(r[0]) for r in rows])
    return np.concatenate([r[0] for r in rows] or [np.empty(0, np.int64)]), np.concatenate([r[1] for r in rows] or [np.empty(0)]), ends


def _rows(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _scores(data: tuple, weights: np.ndarray, bias: float, row: np.ndarray | None = None) -> np.ndarray:
    """The score of each row, added up by itself: the same whatever rows it comes
    with, so that equal rows tie."""
    slots, values, ends = data
    return np.bincount(_rows(ends) if row is None else row, values * weights[slots], len(ends)) + bias


def fit_logistic(data: tuple, y: np.ndarray, size: int, weight: np.ndarray, l2: float = 1e-4, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam, classes weighted evenly; from
    ``start``, weights fitted to most of the rows, fewer steps are enough."""
    slots, values, ends = data
    row = _rows(ends)
    share = np.array([max(1e-9, weight[y == k].sum()) for k in (0, 1)])
    weight = weight / share[y.astype(int)] / 2
    w = np.zeros(size + 1) if start is None else np.append(*start)
    b = float(w[size])
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, (EPOCHS if start is None else MORE_EPOCHS) + 1):
        p = 1 / (1 + np.exp(-np.clip(_scores(data, w[:size], b, row), -30, 30)))
        error = (p - y) * weight
        g = np.append(np.bincount(slots, values * error[row], size) + l2 * w[:size], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w = w - step
        b = w[size]
    return w[:size], float(b)


def _calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over a score (Platt's smoothing)."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        d = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * score).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(d * score * score).sum() + 1e-3, (d * score).sum()], [(d * score).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


@dataclass(frozen=True)
class Model:
    text: tuple[np.ndarray, float] | None
    meta: tuple[np.ndarray, float] | None
    curves: tuple[tuple[float, float], ...]
    mixed: tuple[float, float, float]
    prior: float
    added: tuple[int, ...]

    def score(self, text: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality by content, by metadata and by both."""
        n = len(text[2])
        if self.text is None:
            return (np.full(n, self.prior),) * 3
        odds = [a * _scores(data, *view) + b for data, view, (a, b) in zip((text, meta), (self.text, self.meta), self.curves, strict=True)]
        both = self.mixed[0] * odds[0] + self.mixed[1] * odds[1] + self.mixed[2]
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*odds, both))


Rows = list[tuple]


def _parts(rows: Rows, v: int) -> tuple:
    return _matrix([r[v] for r in rows])


def _fitted(v: int, train: Rows, taught: Rows, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """A view's regression on labelled rows and, at half weight, taught ones."""
    labels = np.array([float(r[2]) for r in train + taught])
    weight = np.concatenate([np.ones(len(train)), np.full(len(taught), 0.5)])
    return fit_logistic(_parts(train + taught, v), labels, (TEXT_SIZE, META_SIZE)[v], weight, start=start)


def split(rows: Rows) -> tuple[Rows, Rows]:
    """Rows to fit on and rows held out to calibrate: every third."""
    held, train = rows[::3], [r for k, r in enumerate(rows) if k % 3]
    if len({r[2] for r in held}) < 2 or len({r[2] for r in train}) < 2:
        return rows, rows
    return train, held


def co_train(rows: Rows, teach=None, rounds: int = ROUNDS) -> Model:
    """``rows``: (content features, metadata features, label) of the labelled
    sample; ``teach(views, base)`` gives the rows that each view is taught by
    the other after a round, with their pseudo-labels."""
    labels = [r[2] for r in rows]
    if len(set(labels)) < 2:
        return Model(None, None, (), (0, 0, 0), float(np.mean(labels)) if rows else 0.5, ())
    train, held = split(rows)
    taught: list[Rows] = [[], []]
    base, added = float(np.mean([r[2] for r in train])), []
    views = [_fitted(v, train, []) for v in (0, 1)]
    for _ in range(rounds if teach else 0):
        for v, more in enumerate(teach(views, base)):
            taught[v] = taught[v] + more
        added.append(sum(map(len, taught)))
        views = [_fitted(v, train, taught[v], views[v]) for v in (0, 1)]
    y = np.array([r[2] for r in held])
    scores = [_scores(_parts(held, v), *views[v]) for v in (0, 1)]
    curves = tuple(_calibrated(s, y) for s in scores)
    odds = [a * s + b for s, (a, b) in zip(scores, curves, strict=True)]
    both = (np.tile([0, 1], len(held)), np.column_stack([np.clip(o, -8, 8) for o in odds]).ravel(), np.arange(1, len(held) + 1) * 2)
    w, b = fit_logistic(both, y.astype(float), 2, np.ones(len(held)), l2=1e-3)
    prior = np.log((y.sum() + 1) / ((1 - y).sum() + 1))
    return Model(views[0], views[1], curves, (max(0.0, w[0]), max(0.0, w[1]), b + prior), base, tuple(added))


_PACKED = {"low": np.uint8, "high": np.uint8, "counts": np.uint8, "more": np.uint32, "extra": np.float64, "meta": np.uint16}
FEATURES = "doc_id long, source string, lang string, hash long, " + ", ".join(f"{name} binary" for name in _PACKED)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both views of each document, packed.

    ``low`` and ``high`` are the bytes of the steps between a text's slots, so that
    the second column is nearly all zeros; counts of 255 and above are in ``more``.
    """
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            columns: dict[str, list[bytes]] = {name: [] for name in _PACKED}
            for text, source, lang in zip(batch["text"], batch["source"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                text = (text.as_py() or "").encode()
                slot, count, extra = text_counts(text)
                step = np.diff(slot, prepend=0)
                values = step & 255, step >> 8, np.minimum(count, 255), count[count >= 255], extra, meta_features(source, lang, text)[0]
                for (name, kind), value in zip(_PACKED.items(), values, strict=True):
                    columns[name].append(value.astype(kind).tobytes())
            kept = {name: batch[name] for name in ("doc_id", "source", "lang", "hash")}
            yield pa.RecordBatch.from_pydict(kept | {name: pa.array(c, pa.binary()) for name, c in columns.items()})


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, one after another, and how many each row has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(ends) // np.dtype(kind).itemsize


def _unpacked(batch: pa.RecordBatch) -> tuple[tuple, tuple]:
    """The matrices of both views, as :func:`_matrix` makes them, of packed rows."""
    flat = {name: _flat(batch[name], kind) for name, kind in _PACKED.items()}
    (low, n), (high, _), (count, _), (extra, extras) = (flat[name] for name in ("low", "high", "counts", "extra"))
    slots = np.cumsum(low + high.astype(np.int64) * 256)
    first = np.cumsum(n) - n
    slots = slots - np.repeat(np.append(0, slots)[first], n)
    count = count.astype(np.float64)
    count[count == 255] = flat["more"][0]
    value, row = np.log1p(count), np.repeat(np.arange(len(n)), n)
    value = value / np.sqrt(np.bincount(row, value**2, len(n)))[row]
    # a row's statistics follow its slots
    counted = np.repeat(np.tile([True, False], len(n)), np.column_stack([n, extras]).ravel())
    places, values = np.empty(len(counted), np.int64), np.empty(len(counted))
    places[counted], values[counted] = slots, value
    places[~counted] = (1 << TEXT_BITS) + np.tile(np.arange(EXTRA), len(extra) // EXTRA)
    values[~counted] = extra
    meta, names = flat["meta"]
    return (places, values, np.cumsum(n + extras)), (meta.astype(np.int64), np.ones(len(meta)), np.cumsum(names))


def _featured(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``; every text is cut and hashed here and nowhere else."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")])
    return rows.withColumn("hash", F.xxhash64("text")).mapInArrow(_features, FEATURES)


def _brought(features: DataFrame, chosen: DataFrame) -> list[tuple]:
    """The features of ``chosen(doc_id, quality, learner)``, a bounded number of
    rows, each with its learner; of a text of any length no more than
    ``TEXT_SIZE`` numbers come to the driver, and none for the metadata view.  Of
    rows of one id the one whose text has the least hash is brought."""
    rows = features.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "learner", F.col("quality").cast("int").alias("quality"))
    rows = rows.agg(F.min_by(F.struct(*_PACKED), F.struct("hash", "source", "lang")).alias("one")).select("doc_id", "quality", "one.*", "learner")
    rows = rows.withColumns({c: F.when(F.col("learner") == 1, F.lit(b"")).otherwise(F.col(c)) for c in _PACKED if c != "meta"})
    out = []
    for batch in rows.orderBy("doc_id", "learner").toArrow().to_batches(500):
        views = _unpacked(batch)
        for k, (learner, quality) in enumerate(zip(batch["learner"].to_pylist(), batch["quality"].to_pylist(), strict=True)):
            parts = [(s[a:b].astype(np.int32), v[a:b].astype(np.float32)) for s, v, ends in views for a, b in ((ends[k - 1] if k else 0, ends[k]),)]
            out.append((learner, (*parts, quality)))
    return out


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))


def _bounded(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """At most ``most`` rows, by a hash of their id."""
    return rows.distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def _apart(ids: np.ndarray, view: int) -> np.ndarray:
    """What is added to a view's scores, so that the share taken of rows that tie,
    as metadata often do, is chosen by a hash of their ids."""
    return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(2) + np.uint64(view)) / 2.0**64 * 1e-9


def _view_scores(views: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = np.asarray(part["doc_id"])
                one, two = (_scores(data, *view) + _apart(ids, v) for v, (data, view) in enumerate(zip(_unpacked(part), views, strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(one, pa.float64()), pa.array(two, pa.float64())], ["doc_id", "source", "s0", "s1"])

    return run


def _teacher(features: DataFrame, labels: DataFrame, taught: int, sure: float):
    """The teaching step of :func:`co_train` over the whole corpus.

    A view is sure of the lowest and the highest scores of each source: of
    ``sure`` of its rows, split between the classes as the labels are, and only
    beyond log-odds of 1.  Ties are broken by a hash of the id.  Cutoffs are quantile sketches of all unlabelled rows
    of the source.
    """
    known = _marks(labels).select("doc_id").hint("shuffle_merge")
    done: list[DataFrame | None] = [None, None]
    turn = [0]

    def teach(views: list, base: float) -> list[Rows]:
        turn[0] += 1
        # features are scored where they are read; only scores meet the labels
        scored = features.where("doc_id IS NOT NULL").mapInArrow(_view_scores(views), "doc_id long, source string, s0 double, s1 double")
        scored = store(scored.join(known, "doc_id", "left_anti"), "view-scores")
        shares = [sure * (1 - base), 1 - sure * base]
        cuts = scored.groupBy("source").agg(*[F.percentile_approx(f"s{v}", shares, 10_000).alias(f"c{v}") for v in (0, 1)])
        placed = scored.join(cuts, scored["source"].eqNullSafe(cuts["source"]))
        every = None
        for v in (0, 1):  # what a view is surest about teaches the other
            score, cut, learner = F.col(f"s{v}"), F.col(f"c{v}"), 1 - v
            label = F.when((score <= cut[0]) & (score < -1), 0).when((score >= cut[1]) & (score > 1), 1)
            picked = placed.select("doc_id", label.alias("quality")).where("quality IS NOT NULL")
            if done[learner] is not None:
                picked = picked.join(F.broadcast(done[learner]), "doc_id", "left_anti")
            halves = [_bounded(picked.where(F.col("quality") == k), 7 * turn[0] + v, max(1, round(taught * share))) for k, share in ((0, 1 - base), (1, base))]
            chosen = store(halves[0].unionByName(halves[1]).groupBy("doc_id").agg(F.min("quality").alias("quality")), "taught")
            ids = chosen.select("doc_id")
            done[learner] = ids if done[learner] is None else done[learner].unionByName(ids)
            mine = chosen.withColumn("learner", F.lit(learner))
            every = mine if every is None else every.unionByName(mine)
        drop(scored)
        found = _brought(features, every)
        return [[row for learner, row in found if learner == v] for v in (0, 1)]

    return teach


def _score(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                one, two, both = model.score(*_unpacked(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x, pa.float64()) for x in (one, two, both)), pa.array(both >= threshold)],
                    ["doc_id", "text_score", "meta_score", "score", "kept"],
                )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = LABELLED, taught: int = TAUGHT, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every row of ``docs``."""
    features = store(_featured(docs), "features")
    ids = features.where("doc_id IS NOT NULL").select("doc_id")
    sample = store(_bounded(ids.join(_marks(labels), "doc_id"), 5, labelled), "labelled")
    rows = [row for _, row in _brought(features, sample.withColumn("learner", F.lit(-1)))]
    model = co_train(rows, _teacher(features, labels, taught, sure) if len({r[2] for r in rows}) > 1 else None, rounds)
    return features.mapInArrow(_score(model, threshold), "doc_id long, text_score double, meta_score double, score double, kept boolean")
