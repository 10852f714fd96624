"""Ranked greedy pruning of links, and corridors made of what is left.

A rule rejects a link because of better links that were kept.  Without the
distinct-target reserve, who can reject whom is known beforehand, so the greedy
result is found in rounds: a link is rejected once all members of one of its
conflicts are kept, and kept once every conflict has a rejected member.  The
best undecided link is always decided, and the result is that of the one-by-one
loop.

The distinct-target reserve saves a link to a target that its source has not
reached while the source has fewer targets than its budget.  The best link to
each of the first targets is thus kept in any case, so which links these are is
known beforehand, too, and the rounds leave them out.  Only where links also
count for their targets (symmetric limits) or the global pruning, which heeds
no reserve, comes between, does the loop itself run for each group of islands
that links connect.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archipelago.functions.scalars import distance, lerp, quantize, squared
from archipelago.operators.candidates import LINK, rank_links
from archipelago.operators.ranking import numbered
from archipelago.operators.spatial import near_join
from archipelago.plans.config import BuildConfig
from archipelago.storage import drop, store


def admit(links: DataFrame, islands: DataFrame) -> DataFrame:
    """Links from outbound islands to islands that are not suppressed."""
    return links.join(islands.where("outbound").select(F.col("id").alias("from_island")), "from_island", "left_semi").join(
        islands.where("NOT suppressed").select(F.col("id").alias("to_island")), "to_island", "left_semi"
    )


def local_radius(config: BuildConfig) -> Column:
    radius = config.density.local.cell(config.extent)
    if not config.mass.enabled:
        return F.lit(radius)
    return F.lit(radius) * lerp(config.mass.low_radius_scale, config.mass.high_radius_scale, F.col("to_mass"))


def global_radius(config: BuildConfig, mass: str) -> Column:
    g = config.density.overall
    radius = F.lit(g.cell(config.extent))
    return radius * lerp(g.low_radius_scale, g.high_radius_scale, F.col(mass)) if config.mass.enabled else radius


def _most_scale(config: BuildConfig, low: float, high: float) -> float:
    return max(low, high) if config.mass.enabled else 1.0


@dataclass(frozen=True)
class Detours:
    """The spanner's conflicts, not spelt out: ``ways(rank, from_island, via, to_island,
    limit)`` and the hops ``owner, goal, e, far`` that they are made of."""

    ways: DataFrame
    hop: DataFrame

    def met(self, state: DataFrame) -> DataFrame:
        """Ways of which a hop by a better link of each half, not rejected, is within the
        limit, with ``out``: whether hops by links that stay are.

        Which link makes a half does not matter for the other one, so the shortest hop
        among those better than the candidate decides, and of a half's hops only those
        shorter than all better ones are ever it.
        """
        now = self.hop.join(state.where("state <> 2").select(F.col("rank").alias("e"), (F.col("state") == 1).alias("stays")), "e")
        before = Window.partitionBy("owner", "goal").orderBy("e").rowsBetween(Window.unboundedPreceding, -1)
        least = F.coalesce(F.min("far").over(before), F.lit(inf))
        least_kept = F.coalesce(F.min(F.when(F.col("stays"), F.col("far"))).over(before), F.lit(inf))
        now = now.withColumns({"least": least, "least_kept": least_kept}).where("far < least OR (stays AND far < least_kept)")
        steps = store(now.groupBy("owner", "goal").agg(F.collect_list(F.struct("e", "far", "stays")).alias("hops")), "steps")

        def half(name: str, a: str, b: str) -> DataFrame:
            return steps.select(F.col("owner").alias(a), F.col("goal").alias(b), F.col("hops").alias(name))

        def shortest(name: str, kept: bool) -> Column:
            better = F.filter(name, lambda h: (h["e"] < F.col("rank")) & h["stays"] if kept else h["e"] < F.col("rank"))
            return F.coalesce(F.array_min(F.transform(better, lambda h: h["far"])), F.lit(inf))

        rows = self.ways.join(half("one", "from_island", "via"), ["from_island", "via"]).join(half("two", "via", "to_island"), ["via", "to_island"])
        rows = rows.where(shortest("one", False) + shortest("two", False) <= F.col("limit"))
        out = shortest("one", True) + shortest("two", True) <= F.col("limit")
        found = store(rows.select(*self.ways.columns, out.alias("out")), "ways")
        drop(steps)
        return found

    def of(self, ranks: DataFrame, how: str = "left_semi") -> Detours:
        return Detours(self.ways.join(ranks, "rank", how), self.hop)

    def left(self, met: DataFrame) -> Detours:
        """What :meth:`met` leaves for the next round."""
        return Detours(met.select(*self.ways.columns), self.hop)


def decide(links: DataFrame, conflicts: DataFrame | None, detours: Detours | None = None) -> DataFrame:
    """``links`` that stay, given ``conflicts(rank, e1, e2)``: a link goes if
    ``e1`` and ``e2``, better ones, both stay; or those of a detour.

    Links without a conflict stay at once.  Each round reads, and leaves for the
    next, only conflicts of undecided links none of whose members is rejected.
    """
    if detours is not None:
        return _decide_beside(links, conflicts, detours)
    open_ = store(conflicts, "conflicts")
    state = store(_met_or_kept(links, open_), "state")
    while state.where("state = 0").head(1):
        e = lambda n: state.select(F.col("rank").alias(n), F.col("state").alias(f"s_{n}"))
        met = open_.join(state.where("state = 0").select("rank"), "rank", "left_semi").join(e("e1"), "e1").join(e("e2"), "e2").where("s_e1 <> 2 AND s_e2 <> 2")
        met = store(met.select("rank", "e1", "e2", ((F.col("s_e1") == 1) & (F.col("s_e2") == 1)).alias("out")), "conflicts")
        verdict = met.groupBy("rank").agg(F.max("out").alias("out"))
        fresh = state.join(verdict, "rank", "left").select(
            "rank", F.when(F.col("state") != 0, F.col("state")).when(F.col("out"), 2).when(F.col("out").isNull(), 1).otherwise(0).alias("state")
        )
        after = store(fresh, "state")
        drop(state)
        drop(open_)
        state, open_ = after, met.select("rank", "e1", "e2")
        open_._stored_at = met._stored_at
    return links.join(state.where("state = 1").select("rank"), "rank", "left_semi")


def _decide_beside(links: DataFrame, conflicts: DataFrame | None, detours: Detours) -> DataFrame:
    """:func:`decide` with detours among the conflicts."""
    open_ = None if conflicts is None else store(conflicts, "conflicts")
    state = store(links.select("rank", F.lit(0).alias("state")), "state")
    ways = None
    while state.where("state = 0").head(1):
        todo = state.where("state = 0").select("rank")
        met = detours.of(todo).met(state)
        verdict, left = met.select("rank", "out"), detours.left(met)
        if open_ is not None:
            e = lambda n: state.select(F.col("rank").alias(n), F.col("state").alias(f"s_{n}"))
            more = open_.join(todo, "rank", "left_semi").join(e("e1"), "e1").join(e("e2"), "e2").where("s_e1 <> 2 AND s_e2 <> 2")
            more = store(more.select("rank", "e1", "e2", ((F.col("s_e1") == 1) & (F.col("s_e2") == 1)).alias("out")), "conflicts")
            verdict = verdict.unionByName(more.select("rank", "out"))
        verdict = verdict.groupBy("rank").agg(F.max("out").alias("out"))
        fresh = state.join(verdict, "rank", "left").select(
            "rank", F.when(F.col("state") != 0, F.col("state")).when(F.col("out"), 2).when(F.col("out").isNull(), 1).otherwise(0).alias("state")
        )
        after = store(fresh, "state")
        drop(state)
        if ways is not None:
            drop(ways)
        if open_ is not None:
            drop(open_)
            open_ = more.select("rank", "e1", "e2")
            open_._stored_at = more._stored_at
        state, detours, ways = after, left, met
    return links.join(state.where("state = 1").select("rank"), "rank", "left_semi")


def _met_or_kept(links: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``rank, state`` before the first round: 0 with a conflict, else 1."""
    met = conflicts.select("rank").distinct().withColumn("met", F.lit(True))
    return links.select("rank").join(met, "rank", "left").select("rank", F.when(F.col("met"), 0).otherwise(1).alias("state"))


def _placed(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Links as they occupy their source's list: ``owner, e, p*, q*``; with
    symmetric limits also turned round in an outbound target's."""
    own = links.select(F.col("from_island").alias("owner"), F.col("to_island").alias("goal"), F.col("rank").alias("e"), *[F.col(f"s{k}").alias(f"p{k}") for k in "xyz"], *[F.col(f"t{k}").alias(f"q{k}") for k in "xyz"])
    if not config.symmetric:
        return own
    back = links.join(islands.where("outbound").select(F.col("id").alias("to_island")), "to_island", "left_semi")
    return own.unionByName(
        back.select(F.col("to_island").alias("owner"), F.col("from_island").alias("goal"), F.col("rank").alias("e"), *[F.col(f"t{k}").alias(f"p{k}") for k in "xyz"], *[F.col(f"s{k}").alias(f"q{k}") for k in "xyz"])
    )


def local_conflicts(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """A better link of the same source, whatever its target, with both ends
    within the candidate's radius."""
    most = config.density.local.cell(config.extent) * _most_scale(config, config.mass.low_radius_scale, config.mass.high_radius_scale)
    mine = links.withColumn("owner", F.col("from_island")).withColumn("radius", local_radius(config))
    pairs = near_join(mine, _placed(links, islands, config), ["owner"], "s", "p", most)
    near = (squared("s", "p") <= F.col("radius") * F.col("radius")) & (squared("t", "q") <= F.col("radius") * F.col("radius"))
    return pairs.where((F.col("e") < F.col("rank")) & near).select("rank", F.col("e").alias("e1"), F.col("e").alias("e2"))


def global_conflicts(links: DataFrame, config: BuildConfig) -> DataFrame:
    """A better link, of any island, with an end near one of the candidate's."""
    g = config.density.overall
    most = g.cell(config.extent) * _most_scale(config, g.low_radius_scale, g.high_radius_scale)
    ends = links.select(F.col("rank").alias("e"), F.explode(F.array(*[F.struct(*[F.col(f"{p}{k}").alias(f"p{k}") for k in "xyz"]) for p in "st"])).alias("at")).select("e", "at.*")
    own = [
        links.select("rank", global_radius(config, f"{side}_mass").alias("radius"), *[F.col(f"{p}{k}").alias(f"c{k}") for k in "xyz"]) for p, side in (("s", "from"), ("t", "to"))
    ]
    pairs = near_join(own[0].unionByName(own[1]), ends, [], "c", "p", most)
    near = squared("c", "p") <= F.col("radius") * F.col("radius")
    # two of its ends may be near, so a pair can be met more than once
    return pairs.where((F.col("e") < F.col("rank")) & near).select("rank", F.col("e").alias("e1"), F.col("e").alias("e2")).distinct()


def spanner_detours(links: DataFrame, islands: DataFrame, config: BuildConfig) -> Detours:
    """Two better links that lead round by another island, no longer than
    the path ratio times the candidate: a way for each such island, not for each
    two links."""
    hop = store(_placed(links, islands, config).select("owner", "goal", "e", distance("p", "q").alias("far")), "hops")
    step = store(hop.groupBy("owner", "goal").agg(F.min("far").alias("far")), "steps")
    one = step.select(F.col("owner").alias("from_island"), F.col("goal").alias("via"), F.col("far").alias("far1"))
    two = step.select(F.col("owner").alias("via"), F.col("goal").alias("to_island"), F.col("far").alias("far2"))
    mine = links.select("rank", "from_island", "to_island", (F.lit(config.density.spanner.path_ratio) * distance("s", "t")).alias("limit"))
    most = mine.groupBy("from_island", "to_island").agg(F.max("limit").alias("most"))
    # a first hop beyond the limit leads nowhere, whatever the second is
    round_ = most.join(one, "from_island").where("via <> to_island AND far1 <= most").join(two, ["via", "to_island"]).where("far1 + far2 <= most")
    ways = mine.join(round_, ["from_island", "to_island"]).where("far1 + far2 <= limit")
    return Detours(store(ways.select("rank", "from_island", "via", "to_island", "limit"), "ways"), hop)


def prune_local(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    return decide(links, local_conflicts(links, islands, config)) if config.density.local.enabled else links


def prune_global_and_spanner(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    near = global_conflicts(links, config) if config.density.overall.enabled else None
    round_ = spanner_detours(links, islands, config) if config.density.spanner.enabled else None
    return links if near is None and round_ is None else decide(links, near, round_)


def collapse(links: DataFrame, config: BuildConfig) -> DataFrame:
    """Drop a kept link beside a better one of the same source and target;
    the radius is not scaled by mass."""
    if not config.density.local.enabled:
        return links
    radius = config.density.local.cell(config.extent)
    other = links.select("from_island", "to_island", F.col("rank").alias("e"), *[F.col(f"s{k}").alias(f"p{k}") for k in "xyz"], *[F.col(f"t{k}").alias(f"q{k}") for k in "xyz"])
    pairs = near_join(links, other, ["from_island", "to_island"], "s", "p", radius)
    near = (squared("s", "p") <= radius * radius) & (squared("t", "q") <= radius * radius)
    return decide(links, pairs.where((F.col("e") < F.col("rank")) & near).select("rank", F.col("e").alias("e1"), F.col("e").alias("e2")))


def reserved(links: DataFrame, config: BuildConfig) -> DataFrame:
    """The ranks that the reserve keeps: of each source the best link to each of
    its first distinct targets, as many as its budget."""
    d = config.density.reserve
    first = links.groupBy("from_island", "to_island").agg(F.min("rank").alias("rank"), F.max("from_mass").alias("from_mass"))
    nth = F.row_number().over(Window.partitionBy("from_island").orderBy("rank"))
    first = first.withColumn("nth", nth).where(F.col("nth") <= d.most)
    return first.where(F.col("nth") <= d.budget_of(F.col("from_mass"), config.mass.enabled)).select("rank")


def _pass_with_reserve(links: DataFrame, conflicts: DataFrame | Detours, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """The links that stay, and the ranks among them that the reserve saved."""
    held = store(reserved(links, config), "reserved")
    if isinstance(conflicts, Detours):
        kept = store(decide(links, None, conflicts.of(held, "left_anti")), "kept")
        return kept, conflicts.of(held).met(kept.select("rank", F.lit(1).alias("state"))).where("out").select("rank").distinct()
    conflicts = store(conflicts, "conflicts")
    kept = store(decide(links, conflicts.join(held, "rank", "left_anti")), "kept")
    stays = lambda e: kept.select(F.col("rank").alias(e))
    met = conflicts.join(held, "rank", "left_semi").join(stays("e1"), "e1", "left_semi").join(stays("e2"), "e2", "left_semi")
    return kept, met.select("rank").distinct()


def _fates_by_rounds(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    left, out = links, []
    saved = links.select("rank").limit(0)
    for reason, on, conflicts in (("local", config.density.local.enabled, local_conflicts), ("spanner", config.density.spanner.enabled, spanner_detours)):
        if on:
            kept, more = _pass_with_reserve(left, conflicts(left, islands, config), config)
            out.append(left.join(kept.select("rank"), "rank", "left_anti").select("rank", F.lit(reason).alias("fate")))
            left, saved = kept, saved.unionByName(more)
    fates = left.select("rank", F.lit("kept").alias("fate")).unionByName(saved.agg(F.count("*").alias("rank")).select("rank", F.lit("saved").alias("fate")))
    for rows in out:
        fates = fates.unionByName(rows)
    return store(fates, "fates")


def _targets_met(links: DataFrame, placed: DataFrame, state: DataFrame, config: BuildConfig) -> DataFrame:
    """``rank, sated, wanting`` of undecided links: whether the source surely has its
    budget of targets, or this one, before the link's turn; and whether it surely
    has neither.

    A source's targets before a turn are those of kept links at least, and those of
    links that are not rejected at most.  It has ``budget`` of them if the target
    that is met ``budget``-th, in the order of their first links, comes earlier.
    """
    d = config.density.reserve
    now = placed.join(state.where("state <> 2").withColumnRenamed("rank", "e"), "e")
    firsts = now.groupBy("owner", "goal").agg(F.min(F.when(F.col("state") == 1, F.col("e"))).alias("kept_at"), F.min("e").alias("maybe_at"))
    budgets = links.groupBy(F.col("from_island").alias("owner")).agg(F.max("from_mass").alias("mass")).select("owner", d.budget_of(F.col("mass"), config.mass.enabled).alias("budget"))
    rows = links.join(state.where("state = 0").select("rank"), "rank", "left_semi").select("rank", F.col("from_island").alias("owner"), F.col("to_island").alias("goal"))
    rows = rows.join(budgets, "owner").join(firsts, ["owner", "goal"], "left")
    for at, full in (("kept_at", "full"), ("maybe_at", "maybe_full")):
        nth = F.row_number().over(Window.partitionBy("owner").orderBy(at))
        met = firsts.where(f"{at} IS NOT NULL").select("owner", at).withColumn("nth", nth).where(F.col("nth") <= d.most)
        last = met.join(budgets, "owner").where("nth = budget").select("owner", F.col(at).alias(full))
        rows = rows.join(last, "owner", "left")
    before = lambda c: F.coalesce(F.col(c) < F.col("rank"), F.lit(False))
    none = F.col("budget") <= 0
    return rows.select("rank", (none | before("full") | before("kept_at")).alias("sated"), (~none & ~before("maybe_full") & ~before("maybe_at")).alias("wanting"))


def decide_reserving(links: DataFrame, placed: DataFrame, hard: DataFrame | None, soft: DataFrame | Detours | None, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """``rank, fate`` (1 stays, 2 goes by a soft conflict, 3 by a hard one) of the
    one-by-one choice, and the ranks that the reserve saved.

    A link goes if both better links of a hard conflict stay; if those of a soft one
    do, it goes unless its source wants the target for its reserve, of which links in
    ``placed(owner, goal, e)`` count.  In each round every link is decided whose
    conflicts and reserve are certain whatever becomes of the undecided ones; the
    best of these always is.
    """
    detours = all_detours = soft if isinstance(soft, Detours) else None
    parts = [c.select("rank", "e1", "e2", F.lit(name).alias("hard")) for c, name in ((hard, True), (soft, False)) if isinstance(c, DataFrame)]
    none = links.select("rank", F.col("rank").alias("e1"), F.col("rank").alias("e2"), F.lit(False).alias("hard")).limit(0)
    every = store(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else none, "conflicts")
    placed, open_ = store(placed, "placed"), every
    # links without a conflict stay, whatever their sources want
    met_or_kept = _met_or_kept(links, every) if detours is None else links.select("rank", F.lit(0).alias("state"))
    state = store(met_or_kept.withColumn("fate", F.lit(1)), "state")
    ways = None
    while state.where("state = 0").head(1):
        e = lambda n: state.select(F.col("rank").alias(n), F.col("state").alias(f"s_{n}"))
        todo = state.where("state = 0").select("rank")
        met = open_.join(todo, "rank", "left_semi").join(e("e1"), "e1").join(e("e2"), "e2").where("s_e1 <> 2 AND s_e2 <> 2")
        met = store(met.select("rank", "e1", "e2", "hard", ((F.col("s_e1") == 1) & (F.col("s_e2") == 1)).alias("out")), "conflicts")
        yes = lambda c: F.coalesce(F.max(c), F.lit(False))
        is_hard, out = F.col("hard"), F.col("out")
        told = met.select("rank", "hard", "out")
        if detours is not None:
            round_ = detours.of(todo).met(state)
            told = told.unionByName(round_.select("rank", F.lit(False).alias("hard"), "out"))
        verdict = told.groupBy("rank").agg(yes(is_hard & out).alias("hard_out"), yes(is_hard & ~out).alias("hard_open"), yes(~is_hard & out).alias("soft_out"), yes(~is_hard & ~out).alias("soft_open"))
        wants = _targets_met(links, placed, state.select("rank", "state"), config)
        rows = state.where("state = 0").select("rank").join(verdict, "rank", "left").join(wants, "rank").na.fill(False)
        free = ~F.col("hard_open") & ((~F.col("soft_out") & ~F.col("soft_open")) | F.col("wanting"))
        fate = F.when(F.col("hard_out"), 3).when(free, 1).when(~F.col("hard_open") & F.col("soft_out") & F.col("sated"), 2)
        fresh = rows.select("rank", fate.alias("now"))
        state_, known = state, F.col("now").isNotNull()
        state = store(
            state_.join(fresh, "rank", "left").select("rank", F.when(known, F.when(F.col("now") == 1, 1).otherwise(2)).otherwise(F.col("state")).alias("state"), F.coalesce("now", "fate").alias("fate")), "state"
        )
        drop(state_)
        if open_ is not every:
            drop(open_)
        open_ = met.select("rank", "e1", "e2", "hard")
        open_._stored_at = met._stored_at
        if detours is not None:
            if ways is not None:
                drop(ways)
            detours, ways = detours.left(round_), round_
    stays = lambda e: state.where("state = 1").select(F.col("rank").alias(e))
    if all_detours is not None:
        kept = state.where("state = 1").select("rank", "state")
        return state.select("rank", "fate"), all_detours.of(kept.select("rank")).met(kept).where("out").select("rank").distinct()
    saved = every.where("NOT hard").join(stays("rank"), "rank", "left_semi").join(stays("e1"), "e1", "left_semi").join(stays("e2"), "e2", "left_semi").select("rank").distinct()
    return state.select("rank", "fate"), saved


def _fates_with_targets(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Fates where links count for their targets' reserves, too, or where a pruning
    that heeds no reserve comes between."""
    d, left, out = config.density, links, []
    saved = links.select("rank").limit(0)
    for reason in ("local", "spanner"):
        hard = global_conflicts(left, config) if reason == "spanner" and d.overall.enabled else None
        soft = local_conflicts if reason == "local" else spanner_detours
        soft = soft(left, islands, config) if (d.local if reason == "local" else d.spanner).enabled else None
        if hard is None and soft is None:
            continue
        fates, more = decide_reserving(left, _placed(left, islands, config).select("owner", "goal", "e"), hard, soft, config)
        out.append(fates.where("fate > 1").select("rank", F.when(F.col("fate") == 3, "global").otherwise(reason).alias("fate")))
        left, saved = store(left.join(fates.where("fate = 1").select("rank"), "rank", "left_semi"), "kept"), saved.unionByName(more)
    fates = left.select("rank", F.lit("kept").alias("fate")).unionByName(saved.agg(F.count("*").alias("rank")).select("rank", F.lit("saved").alias("fate")))
    for rows in out:
        fates = fates.unionByName(rows)
    return store(fates, "fates")


def reserve_fates(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """``rank, fate`` of every link, and rows ``fate = 'saved'`` with the number
    that the reserve saved in place of a rank."""
    if config.symmetric or config.density.overall.enabled:
        return _fates_with_targets(links, islands, config)
    return _fates_by_rounds(links, islands, config)


def prune_with_reserve(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """The links that stay where each island has a reserve of targets."""
    return links.join(reserve_fates(links, islands, config).where("fate = 'kept'"), "rank", "left_semi").select(*links.columns)


def pruning_counts(links: DataFrame, islands: DataFrame, config: BuildConfig) -> dict[str, int]:
    """How many links each pruning rejects, and how many the reserve saves.

    A link that both prunings of the second pass reject counts for the global one.
    """
    ranked = store(rank_links(admit(links.select(*LINK), islands), islands, config), "ranked")
    out = dict.fromkeys(("local", "global", "spanner", "saved"), 0)
    if config.density.reserve.enabled:
        fates = reserve_fates(ranked, islands, config)
        found = fates.groupBy("fate").agg(F.count("*").alias("n"), F.sum("rank").alias("sum")).collect()
        return out | {r["fate"]: int(r["sum"] if r["fate"] == "saved" else r["n"]) for r in found if r["fate"] != "kept"}
    local = store(prune_local(ranked, islands, config), "local")
    kept = store(prune_global_and_spanner(local, islands, config), "kept")
    gone = local.join(kept.select("rank"), "rank", "left_anti").select("rank")
    out["local"], n = ranked.count() - local.count(), gone.count()
    if config.density.overall.enabled and n:
        stays = lambda e: kept.select(F.col("rank").alias(e))
        met = global_conflicts(local, config).join(stays("e1"), "e1", "left_semi").join(stays("e2"), "e2", "left_semi")
        out["global"] = gone.join(met.select("rank"), "rank", "left_semi").count()
    out["spanner"] = n - out["global"]
    return out


def corridor_edges(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """One edge per corridor: links between the same islands whose ends share
    voxels.  The first, by source and rank, gives the geometry; directions add
    up, and symmetric limits open both ways between outbound islands."""
    cell = max(config.density.candidates.cell(config.extent), 0.001)
    forward = F.col("from_island") <= F.col("to_island")
    pick = lambda a, b: F.when(forward, a).otherwise(b)
    rows = links.select(
        pick(F.col("from_island"), F.col("to_island")).alias("island_a"), pick(F.col("to_island"), F.col("from_island")).alias("island_b"),
        *[pick(F.col(f"s{k}"), F.col(f"t{k}")).alias(f"a{k}") for k in "xyz"], *[pick(F.col(f"t{k}"), F.col(f"s{k}")).alias(f"b{k}") for k in "xyz"],
        "horizontal", forward.alias("forward"), F.struct("from_island", "rank").alias("turn"),
    )
    key = {f"k{p}{k}": quantize(f"{p}{k}", cell) for p in "ab" for k in "xyz"}
    geometry = F.struct(*[f"{p}{k}" for p in "ab" for k in "xyz"], "horizontal")
    edges = rows.withColumns(key).groupBy("island_a", "island_b", *key).agg(
        F.min("turn").alias("turn"), F.min_by(geometry, "turn").alias("g"), F.max("forward").alias("ab"), F.max(~F.col("forward")).alias("ba")
    )
    out = lambda side: islands.select(F.col("id").alias(f"island_{side}"), F.col("outbound").alias(f"out_{side}"))
    edges = edges.join(out("a"), "island_a").join(out("b"), "island_b")
    both = F.lit(config.symmetric)
    edges = numbered(edges, [F.col("turn.from_island"), F.col("turn.rank")], "edge_index", first=0)
    return edges.select(
        F.col("edge_index").cast("int").alias("edge_index"), "island_a", "island_b", "g.*",
        (F.col("g.by") - F.col("g.ay")).alias("vertical_delta_ab"),
        (F.col("ab") | (both & F.col("out_a"))).alias("trav_ab"), (F.col("ba") | (both & F.col("out_b"))).alias("trav_ba"),
    )


def prune(links: DataFrame, islands: DataFrame, config: BuildConfig) -> DataFrame:
    """Ranked links after all pruning stages."""
    ranked = store(rank_links(admit(links.select(*LINK), islands), islands, config), "ranked")
    if config.density.reserve.enabled:
        kept = prune_with_reserve(ranked, islands, config)
    else:
        kept = prune_global_and_spanner(store(prune_local(ranked, islands, config), "local"), islands, config)
    return store(collapse(kept, config), "pruned")
