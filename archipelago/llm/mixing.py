"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Documents fall into cells of (source, language, topic).  Their token weights
are summed per cell, and the sums are raked: in turn each dimension's
categories are scaled to their target shares, until all hold.  A cell's ratio of
raked to present weight is the relative chance of its documents.  Chances are
scaled so that the largest is one.  If a token budget asks for more, weights
are raked anew with no cell above its present weight, to the largest total
within the budget that keeps the shares.  A document stays if a hash of its id
and the seed is below its cell's chance: the draw is the same on any cluster,
at any partitioning.

Size: every category of the corpus counts; none are lumped together.  Only
cells that documents have exist.  While they are at most ``LOCAL_CELLS``, which
is counted first, the sums are raked on the driver; beyond that by grouped
aggregation, one factor for each category, joined to the cells.  Both stop by the
same rule (``Progress``) and give the same chances.  Where targets contradict each
other (an empty cell can make them), raking does not settle: the result says so in
``settled`` and a warning names the largest deviation.

A weight is a count of white-space words, a topic the form of the text, unless
the caller brings columns of its own.

Defined results.  A null source, language or topic is the category ``OTHER``.
A null or empty text weighs nothing and stays if its cell's chance allows.  A
target for a category that no document has, or with share 0, is left out and
the rest is scaled up; a category with share 0, or without a target where
shares are given, loses all its documents.  A null ``doc_id`` is drawn by its
text.  Rows are drawn one by one; copies of a row share their fate.  Columns of
the input may have any names.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import drop, store

OTHER = "(other)"
#: Cells, a row each, that may be raked on the driver.
LOCAL_CELLS = 200_000
ROUNDS = 200
#: Totals tried for the largest that keeps the shares.
HALVINGS = 16


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, symbols, shouting, short or prose.

    The caller may bring a topic column instead.
    """
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.regexp_count(text, F.lit(r"[#*$%&!]"))
    return (
        F.when(bars * 40 > size, "table")
        .when(marks * 40 > size, "symbols")
        .when(size < 400, "short")
        .when(size < 4000, "prose")
        .otherwise("long")
    )


TOPICS = ("table", "symbols", "short", "prose", "long")


def token_weight(text: Column) -> Column:
    """White-space words of the whole text."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Target:
    """The shares of the weight that a dimension's categories shall have.

    Without ``shares`` they are the corpus's own, drawn towards each other:
    raised to ``power`` and rescaled (1 leaves them, 0 makes them equal).
    """

    shares: dict[str, float] | None = None
    power: float = 1.0

    def wanted(self, present: Column, category: Column) -> Column:
        """A category's unscaled share, from its part of the present weight."""
        if self.shares is None:
            return F.when(present > 0, F.pow(present, F.lit(self.power))).otherwise(F.lit(0.0))
        given = F.lit(0.0)
        for name, share in self.shares.items():
            given = F.when(category == name, F.lit(float(share))).otherwise(given)
        return F.when(present > 0, given).otherwise(F.lit(0.0))

    def wanted_here(self, names: list[str], present: np.ndarray) -> np.ndarray:
        """The same on the driver."""
        if self.shares is None:
            return np.where(present > 0, np.power(np.maximum(present, 0), self.power), 0)
        return np.array([float(self.shares.get(n, 0.0)) for n in names]) * (present > 0)


@dataclass(frozen=True)
class Raked:
    """Cells (a tuple of categories each), their chances and raked weights."""

    cells: list[tuple]
    present: np.ndarray
    raked: np.ndarray
    chance: np.ndarray
    rounds: int
    off: float

    @property
    def settled(self) -> bool:
        return self.off < TOLERANCE


#: Relative deviation from a marginal at which raking has settled.
TOLERANCE = 1e-6
#: Rounds after which raking within limits must have come closer, and the most.
STALL, MOST_ROUNDS = 50, 3000


Marginals = list[tuple[np.ndarray, np.ndarray]]


def rake(present: np.ndarray, dims: Marginals, rounds: int = ROUNDS, tolerance: float = 1e-9) -> tuple[np.ndarray, int, float]:
    """Scale ``present`` until each dimension's sums are as wanted.

    Returns the weights, the rounds and the largest relative deviation left.
    """
    now, done, worst = present.astype(float).copy(), 0, np.inf
    for done in range(1, rounds + 1):
        worst = 0.0
        for where, want in dims:
            have = np.bincount(where, now, len(want))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            if done > 1:
                worst = max(worst, float(np.abs(scale[want > 0] - 1).max(initial=0)))
            now *= scale[where]
        if done > 1 and worst < tolerance:
            break
    return now, done, worst


def marginals(cells: list[tuple], present: np.ndarray, targets: list[Target], total: float) -> Marginals:
    """Per dimension each cell's category and the weights that categories shall have."""
    dims = []
    for d, target in enumerate(targets):
        names, where = np.unique(np.array([c[d] for c in cells], object).astype(str), return_inverse=True)
        share = target.wanted_here(names.tolist(), np.bincount(where, present, len(names)) / present.sum())
        dims.append((where, share / share.sum() * total if share.sum() else np.bincount(where, present, len(names))))
    return dims


class Progress:
    """When raking within limits ends, the same on the driver and on executors:
    ``settled`` once a round changes nothing by more than the tolerance, given up
    where ``STALL`` rounds have not brought the deviation down by a tenth."""

    def __init__(self) -> None:
        self.done, self.mark, self.settled = 0, np.inf, False

    def ended(self, off: float) -> bool:
        self.done += 1
        self.settled = off < TOLERANCE
        stalled = False
        if self.done % STALL == 0:
            stalled, self.mark = off > 0.9 * self.mark, off
        return self.settled or stalled or self.done >= MOST_ROUNDS


def rake_within(present: np.ndarray, dims: Marginals, total: float) -> np.ndarray | None:
    """Chances, none above 1, at which the weights kept are ``total`` and have the
    target shares; None if there are none."""
    factor, progress, off = np.ones(len(present)), Progress(), np.inf
    dims = [(where, want / want.sum() * total) for where, want in dims]
    while not progress.ended(off):
        off = 0.0
        for where, want in dims:
            have = np.bincount(where, np.minimum(1, factor) * present, len(want))
            scale = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            off = max(off, float(np.abs(scale[want > 0] - 1).max(initial=0)))
            factor *= scale[where]
    return np.where(present > 0, np.minimum(1, factor), 0) if progress.settled else None


def _scaled(present: np.ndarray, raked: np.ndarray, dims: Marginals, budget: float | None) -> np.ndarray:
    """Chances in [0, 1] that keep the shares and at most ``budget``.

    Proportional to raked / present where that gives the budget; else the
    largest total found by halving that :func:`rake_within` can meet.
    """
    ratio = np.divide(raked, present, out=np.zeros(len(present)), where=present > 0)
    if not ratio.any():
        return np.ones(len(present))
    best = ratio / ratio.max()
    low = float((best * present).sum())
    if budget is None:
        return best
    if low >= budget:
        return best * (budget / low)
    # no category can give more than it has
    high = budget
    for where, want in dims:
        have = np.bincount(where, present, len(want))
        high = min(high, float((have[want > 0] / (want[want > 0] / want.sum())).min()))
    total = high
    for _ in range(HALVINGS):
        found = rake_within(present, dims, total)
        if found is None:
            high = total
        else:
            best, low = found, total
        if high - low <= 1e-3 * high:
            break
        total = (low + high) / 2
    return best


def fit(rows: list[tuple], targets: list[Target], budget_share: float | None = None) -> Raked:
    """Rake cells ``(category, ..., weight)`` on the driver."""
    cells, present = [tuple(r[:-1]) for r in rows], np.array([float(r[-1] or 0) for r in rows])
    if not present.sum():
        return Raked(cells, present, present, np.ones(len(cells)), 0, 0.0)
    dims = marginals(cells, present, targets, present.sum())
    raked, rounds, off = rake(present, dims)
    if off >= TOLERANCE:
        warnings.warn(f"the targets contradict each other: after {rounds} rounds a marginal is off by {off:.2g}", stacklevel=2)
    budget = None if budget_share is None else budget_share * present.sum()
    return Raked(cells, present, raked, _scaled(present, raked, dims, budget), rounds, off)


def fit_spread(cells: DataFrame, dims: list[str], targets: list[Target], budget_share: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells(*dims, weight)`` with ``chance`` and ``settled``, raked by grouped
    aggregation: nothing but a few numbers comes to the driver.

    Weights are never scaled above what a cell has if the budget asks for more
    than proportional chances give.
    """
    total = float(cells.agg(F.sum("weight")).first()[0] or 0)
    if not total:
        return cells.select("*", F.lit(1.0).alias("chance"), F.lit(True).alias("settled"))
    wants, high = [], budget_share * total if budget_share is not None else total
    for d, target in zip(dims, targets, strict=True):
        sums = cells.groupBy(d).agg((F.sum("weight") / total).alias("part")).select(d, "part", target.wanted(F.col("part"), F.col(d)).alias("share"))
        sums = store(sums, "marginal")
        whole = float(sums.agg(F.sum("share")).first()[0] or 0)
        want = store(sums.select(d, (F.col("share") / whole if whole else F.col("part")).alias("want")), "marginal")
        wants.append(want)
        most = sums.join(want, d).where("want > 0").agg(F.min(F.col("part") / F.col("want"))).first()[0]
        high = min(high, total * float(most))

    def settle(goal: float, capped: bool) -> tuple[DataFrame, float]:
        """Cells with their ``factor``, and the deviation left.  A cell's factor is the
        product of its categories', and only those are written."""
        factors = [store(want.select("*", F.lit(1.0).alias("factor"), F.lit(0.0).alias("off")), "raked") for want in wants]

        def scaled() -> DataFrame:
            now, product = cells, F.lit(1.0)
            for k, (d, f) in enumerate(zip(dims, factors, strict=True)):
                now, product = now.join(f.select(d, F.col("factor").alias(f"factor_{k}")), d), product * F.col(f"factor_{k}")
            return now.select(*cells.columns, product.alias("factor"))

        progress, off, done = Progress(), float("inf"), 0
        while not (progress.ended(off) if capped else done >= rounds or off < 1e-9):
            worst = 0.0
            for k, (d, old) in enumerate(zip(dims, factors, strict=True)):
                held = F.least(F.lit(1.0), F.col("factor")) if capped else F.col("factor")
                have = scaled().groupBy(d).agg(F.sum(held * F.col("weight")).alias("have"))
                scale = F.when(F.col("have") > 0, F.col("want") * goal / F.col("have")).otherwise(F.lit(0.0))
                factors[k] = store(old.join(have, d).select(d, "want", (F.col("factor") * scale).alias("factor"), F.when(F.col("want") > 0, F.abs(scale - 1)).alias("off")), "raked")
                drop(old)
                worst = max(worst, float(factors[k].agg(F.max("off")).first()[0] or 0))
            done += 1
            # the first round only starts the proportional form
            off = worst if done > 1 or capped else off
        return scaled(), off

    raked, off = settle(total, False)
    top = float(raked.where("weight > 0").agg(F.max("factor")).first()[0] or 0)
    if off >= TOLERANCE:
        warnings.warn(f"the targets contradict each other: a marginal is off by {off:.2g}", stacklevel=2)
    best = raked.withColumn("chance", F.when(F.col("weight") > 0, F.col("factor") / top).otherwise(F.lit(0.0)))
    low = float(best.agg(F.sum(F.col("chance") * F.col("weight"))).first()[0])
    if budget_share is not None and low >= budget_share * total:
        best = best.withColumn("chance", F.col("chance") * (budget_share * total / low))
    elif budget_share is not None:
        goal = high
        for _ in range(HALVINGS):
            found, worst = settle(goal, True)
            if worst < TOLERANCE:
                best, low = found.withColumn("chance", F.when(F.col("weight") > 0, F.least(F.lit(1.0), "factor")).otherwise(F.lit(0.0))), goal
            else:
                high = goal
            if high - low <= 1e-3 * high:
                break
            goal = (low + high) / 2
    return best.select(*cells.columns, "chance", F.lit(off < TOLERANCE).alias("settled"))


def shares(fitted: Raked) -> list[tuple[int, str, float, float, float]]:
    """Per dimension and category its share of the weight at present, its target
    and the share that the chances give."""
    out = []
    kept = fitted.chance * fitted.present
    for d in range(len(fitted.cells[0]) if fitted.cells else 0):
        for name in sorted({c[d] for c in fitted.cells}):
            mine = np.array([c[d] == name for c in fitted.cells])
            out.append((d, name, *(float(w[mine].sum() / (w.sum() or 1)) for w in (fitted.present, fitted.raked, kept))))
    return out


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from the document's id, or its text where that is null."""
    key = F.when(doc_id.isNotNull(), F.xxhash64(F.lit(seed), doc_id)).otherwise(F.xxhash64(F.lit(seed), text))
    return F.shiftrightunsigned(key, 11) / F.lit(float(1 << 53))


DIMS = ["source", "lang", "topic"]


def _placed(docs: DataFrame, dims: list[str], topic: Column | None, *also: Column) -> DataFrame:
    """``doc, key, source, lang, topic`` of every row and the columns ``also``:
    ``key`` is the text's hash; a dimension that is not named is one category."""
    columns = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text")) if topic is None else topic}
    cells = [F.coalesce(c.cast("string"), F.lit(OTHER)) if n in dims else F.lit(OTHER) for n, c in columns.items()]
    return docs.select(*also, F.col("doc_id").alias("doc"), F.xxhash64("text").alias("key"), *[c.alias(n) for n, c in zip(DIMS, cells, strict=True)])


def chances(rows: DataFrame, targets: dict[str, Target], budget_share: float | None, local_cells: int = LOCAL_CELLS) -> DataFrame:
    """``source, lang, topic, chance, settled`` of every cell of ``rows``."""
    wanted = [targets.get(n, Target()) for n in DIMS]
    cells = store(rows.groupBy(*DIMS).agg(F.sum("weight").cast("double").alias("weight")), "cells")
    if cells.count() > local_cells:
        return store(fit_spread(cells, DIMS, wanted, budget_share).drop("weight"), "chances")
    # no more than local_cells rows, as counted
    found = fit([tuple(r) for r in cells.orderBy(*DIMS).collect()], wanted, budget_share)
    made = [(*c, float(p), found.settled) for c, p in zip(found.cells, found.chance, strict=True)]
    return store(cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, chance double, settled boolean"), "chances")


def sample(docs: DataFrame, targets: dict[str, Target], budget_share: float | None = None, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with their own columns.

    Only rows' cells are joined with the chances; documents are read twice, and
    shuffled only if the cells are too many to be sent to all.
    """
    weights = _placed(docs, list(targets), topic, token_weight(F.col("text")).alias("weight"))
    table = chances(weights, targets, budget_share)
    whole = _placed(docs, list(targets), topic, F.struct("*").alias("whole"))
    return whole.join(table, DIMS).where(draw(seed, F.col("doc"), F.col("key")) < F.col("chance")).select("whole.*")


def tempered_targets(power: float) -> dict[str, Target]:
    """Targets that draw source, language and topic shares towards each other."""
    return {n: Target(power=power) for n in DIMS}


def mix_report(docs: DataFrame, targets: dict[str, Target], budget_share: float | None = None, seed: int = 11, topic: Column | None = None) -> DataFrame:
    """One row per document: its cell, weight, chance and whether it stays."""
    # a null id is drawn by its text's hash, so texts need not be kept
    mine = store(_placed(docs, list(targets), topic, token_weight(F.col("text")).alias("weight")), "weighed")
    return mine.join(chances(mine, targets, budget_share), DIMS).select(
        F.col("doc").alias("doc_id"),
        *DIMS,
        F.col("weight").alias("tokens"),
        F.round("chance", 9).alias("chance"),
        (draw(seed, F.col("doc"), F.col("key")) < F.col("chance")).alias("kept"),
    )
