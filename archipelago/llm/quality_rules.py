"""Quality rules with risk-controlled thresholds (operator 7).

Each text gets a few measures.  A rule rejects a text whose measure is at or
above the rule's cutoff.  A *setting* is a set of rules and a step of their grids
of cutoffs; it rejects what any of its rules rejects.  For every stratum the
labelled holdout certifies settings: the exact binomial test of "the setting
rejects more than ``alpha`` of the stratum's good documents" must fail at level
``delta / (strata x sets of rules)``.  The steps of one set are nested, from lax to
strict, so they are a fixed sequence, which is tested without further correction: a
step that fails makes all stricter ones fail.  Over strata and sets the correction
is Bonferroni's.  So with probability ``1 - delta`` in no stratum do the chosen
rules *together* falsely reject more than ``alpha``.

Of a stratum's certified settings that one is chosen which rejects most of its
documents labelled as bad; then fewest good ones, then the laxest, then the first
set.  A stratum with too few good labels to certify anything, or whose certified
settings reject no bad one, gets no cutoffs.

All of it is DataFrame functions.  The holdout is aggregated to a row for each
combination of steps that a document's measures reach, in its stratum, before the
test, and the chosen settings, a row for each stratum, join back on the stratum.

Defined results.  A null or empty text has no words and fails the base rules.  A
null stratum is a stratum of its own.  Labels of unknown documents, and null
labels, are ignored; of a document labelled more than once the least label
counts, and any but 1 is bad.  Without labels no learned rule rejects anything.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archipelago.llm.storage import store

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5

ALPHA, DELTA = 0.005, 0.05
#: The cutoffs tried for every rule, ascending, in the measure's unit.
GRID = {
    "symbols_per_word": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "dup_line_share": (0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9),
    "repeat_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18),
    "shout_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9),
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated(words: Column) -> Column:
    """How many words lie in a run of WINDOW words that occurs twice or more.

    Runs are compared by hash; a sort brings equal ones together.  Texts
    without any repeat, the most, stop after one distinct.
    """
    at = F.sequence(F.lit(0), F.size(words) - F.lit(WINDOW))
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(words, (i + k).cast("int")) for k in range(WINDOW)]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(rows: Column) -> Column:
            again = F.filter(
                F.transform(
                    rows,
                    lambda x, k: F.when(
                        (F.get(rows, k - 1)["h"] == x["h"]) | F.coalesce(F.get(rows, k + 1)["h"] == x["h"], F.lit(False)),
                        x["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                F.sort_array(again),
                start,
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).cast("int").alias("n"), i.cast("int").alias("last")
                ),
                lambda acc: acc["n"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ordered, flagged))

    return F.when(F.size(words) > WINDOW, _let(runs, count)).otherwise(F.lit(0))


def measures(docs: DataFrame, stratum: str = "lang", *also: str) -> DataFrame:
    """``doc_id, stratum``, the columns ``also`` and the counts of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        *also,
        "doc_id",
        F.col(stratum).cast("string").alias("stratum"),
        text.alias("text"),
        F.filter(F.split(text, WORD_GAP), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    joined = F.array_join("words", "")
    return found.select(
        *also,
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}{2,}[^\x20\x09-\x0D]*")).cast("long").alias("n_shouted"),
    )


def _rates() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "shout_share": F.col("n_shouted") / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed exactly term by term from i = 0.

    Only asked for k <= n * p, so the sum has at most n * p + 1 terms.
    """
    start = F.struct((n * F.lit(log(1 - p))).alias("term"), (n * F.lit(log(1 - p))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(log(p / (1 - p)))
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, step, lambda acc: acc["total"])


def settings(grid: dict | None = None) -> list[tuple[int, int, dict]]:
    """All ``(set, step, cutoffs)``: bit ``k`` of ``set`` stands for the grid's rule
    ``k``, step 0 is the strictest.  A rule with fewer cutoffs stays at its strictest."""
    grid = grid or GRID
    steps = max(map(len, grid.values()))
    return [
        (which, step, {rule: cuts[max(0, len(cuts) - steps + step)] for k, (rule, cuts) in enumerate(grid.items()) if which >> k & 1})
        for which in range(1, 1 << len(grid))
        for step in range(steps)
    ]


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, grid: dict | None = None) -> DataFrame:
    """``stratum`` and a map ``cutoffs`` from the chosen rules to their cutoffs."""
    tried = settings(grid)
    rules = list(grid or GRID)
    sets = (1 << len(rules)) - 1
    steps = len(tried) // sets
    # how many of a rule's cutoffs, which ascend, a measure reaches
    reached = {}
    for k, rule in enumerate(rules):
        cuts = [cut[rule] for which, _, cut in tried if which == 1 << k]
        reached[rule] = sum((_rates()[rule] >= F.lit(cut)).cast("int") for cut in cuts)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = measured.where(~base_failed()).join(known, "doc_id").select("stratum", "good", *[v.alias(k) for k, v in reached.items()])
    cells = held.groupBy("stratum", *rules).agg(F.count_if("good").alias("n"), F.count_if(~F.col("good")).alias("bad"))
    cells = store(cells, "holdout")
    level = log(delta / (sets * max(1, cells.where("n > 0").select("stratum").distinct().count())))
    tops = [F.greatest(F.lit(0), *[F.col(r) for k, r in enumerate(rules) if which >> k & 1]) for which in range(1, sets + 1)]
    each = cells.select("stratum", "n", "bad", F.posexplode(F.array(*tops)).alias("set", "top"))
    each = each.groupBy("stratum", "set", "top").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    hit = F.col("top") > F.col("step")
    counts = each.groupBy("stratum", "set", "step").agg(
        F.sum("n").alias("n"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("k"), F.sum(F.when(hit, F.col("bad")).otherwise(0)).alias("caught")
    )
    sure = counts.where("caught > 0").where(
        F.when(F.col("k") <= F.col("n") * F.lit(alpha), log_binomial_tail(F.col("n"), F.col("k"), alpha) <= F.lit(level)).otherwise(F.lit(False))
    )
    best = sure.groupBy("stratum").agg(F.max_by(F.struct("set", "step"), F.struct("caught", -F.col("k"), "step", -F.col("set"))).alias("x"))
    maps = F.array(*[F.create_map(*[F.lit(v) for pair in cut.items() for v in pair]) for _, _, cut in tried])
    return best.select("stratum", F.get(maps, (F.col("x.set") * steps + F.col("x.step")).cast("int")).alias("cutoffs"))


def judged(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed``, ``rejected_by`` and ``kept``.

    ``cutoffs`` has a row for each stratum, such as a language.
    """
    rates = _rates()
    rejected = F.lit(None).cast("string")
    for rule in reversed(list(GRID)):
        rejected = F.when(rates[rule] >= F.element_at("cutoffs", rule), F.lit(rule)).otherwise(rejected)
    out = measured.join(cutoffs.withColumnRenamed("stratum", "certified"), measured["stratum"].eqNullSafe(F.col("certified")), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.when(~F.col("base_failed"), rejected))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, ``base_failed``, the learned rule that rejects (or null) and ``kept``."""
    measured = store(measures(docs, stratum), "measures")
    out = judged(measured, certified_cutoffs(measured, labels, alpha, delta))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "rejected_by")


def rule_verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, with their columns, and ``kept``, row by row.

    The labelled rows are measured to set the cutoffs; then all rows are
    measured and judged where they are read, so no text is shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    held = store(measures(docs.join(known, "doc_id", "left_semi"), stratum), "measures")
    cutoffs = store(certified_cutoffs(held, labels, alpha, delta), "cutoffs")
    whole = docs.select(F.struct("*").alias("whole"), "doc_id", "text", stratum)
    # one comparison over both sides of the join stays above it as a filter, so
    # the measures are not made a second time below
    kept = F.expr("int(base_failed) + int(rejected_by IS NOT NULL) = 0")
    return judged(measures(whole, stratum, "whole"), cutoffs).select("whole.*", kept.alias("kept"))
