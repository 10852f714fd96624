"""The build: mesh to island graph, with statuses, counters and timings."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from archipelago.operators import boundaries as border
from archipelago.operators import candidates as gaps
from archipelago.operators.graph import EDGE, Graph, health
from archipelago.operators.islands import label_islands, score_masses, summarize_islands, with_outbound
from archipelago.operators.prune import corridor_edges, prune, pruning_counts
from archipelago.plans.config import BuildConfig, BuildStatus
from archipelago.sources.mesh import Mesh
from archipelago.storage import store


@dataclass
class BuildResult:
    status: BuildStatus = BuildStatus.SUCCESS
    message: str = ""
    graph: Graph | None = None
    stats: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.status is BuildStatus.SUCCESS


class _Stop(Exception):
    def __init__(self, status: BuildStatus, message: str = ""):
        self.status, self.message = status, message


#: Seconds between two questions whether a running stage is cancelled.
POLL = 0.5


@contextmanager
def _watched(sc: SparkContext, cancelled: Callable[[], bool] | None) -> Iterator[None]:
    """Run what is inside under a job tag; once ``cancelled()``, its jobs are cancelled
    from a second thread, and what they raise becomes the status."""
    if cancelled is None:
        yield
        return
    tag, over, stopped = f"build-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(POLL):
            if stopped.is_set() or cancelled():
                stopped.set()
                sc.cancelJobsWithTag(tag)  # again each time, as a stage goes on to its next job

    poll = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    poll.start()
    try:
        yield
    except (Py4JError, PySparkException):
        if stopped.is_set():
            raise _Stop(BuildStatus.CANCELLED) from None
        raise
    finally:
        over.set()
        poll.join()
        sc.removeJobTag(tag)
    if stopped.is_set():
        raise _Stop(BuildStatus.CANCELLED)


def islands_of(mesh: Mesh, config: BuildConfig, labels: DataFrame) -> DataFrame:
    """Islands with shape, mass and policy columns, written once."""
    return store(with_outbound(score_masses(store(summarize_islands(mesh, labels), "shapes"), config), config), "islands")


def build(mesh: Mesh, config: BuildConfig, cancelled: Callable[[], bool] | None = None, statistics: bool = True) -> BuildResult:
    """Run all stages.  ``cancelled`` is asked between them and, from a second thread,
    every ``POLL`` seconds while one runs, whose jobs are then cancelled.  A build
    that does not succeed has no graph, but the timings of the stages it finished."""
    result, began = BuildResult(), time.perf_counter()
    sc = mesh.polygons.sparkSession.sparkContext

    def stage(name: str, make):
        if cancelled and cancelled():
            raise _Stop(BuildStatus.CANCELLED)
        t = time.perf_counter()
        with _watched(sc, cancelled):
            out = make()
        result.timings[name] = result.timings.get(name, 0.0) + time.perf_counter() - t
        return out

    try:
        if problem := config.problem():
            raise _Stop(BuildStatus.INVALID_CONFIGURATION, problem)
        labels = stage("flood_fill", lambda: label_islands(mesh, config))
        islands = stage("mass_scoring", lambda: islands_of(mesh, config, labels))
        raw = stage("boundary_extraction", lambda: store(border.extract_boundaries(mesh, labels, islands), "borders"))
        if border.has_non_finite(raw):
            raise _Stop(BuildStatus.INVALID_MESH, "a border has coordinates that are not finite")
        thin = stage("boundary_extraction", lambda: store(border.dedup_boundaries(raw, config), "thinned"))
        out = stage("boundary_extraction", lambda: store(border.outbound_boundaries(thin, islands), "outbound"))
        chosen = stage("boundary_extraction", lambda: store(border.select_representatives(out, islands, config), "representatives"))
        links = stage("link_discovery", lambda: store(gaps.discover(thin, chosen, mesh, labels, islands, config), "candidates"))
        kept = stage("pruning", lambda: prune(links, islands, config))
        edges = stage("pruning", lambda: store(corridor_edges(kept, islands, config).select(*EDGE), "edges"))
        result.graph = Graph(islands, edges, labels.select("poly_ref", "island"))
        if statistics:
            counted = stage("counters", lambda: counters(mesh, config, labels, islands, raw, thin, out, chosen, links, kept, edges))
            result.stats = counted | stage("health", lambda: health(result.graph))
        if cancelled and cancelled():
            raise _Stop(BuildStatus.CANCELLED)
    except _Stop as stop:
        result.status, result.message, result.graph = stop.status, stop.message, None
    except (Py4JError, PySparkException) as error:  # what the scan raises at coordinates that are not finite
        if gaps.NOT_FINITE not in str(error):
            raise
        result.status, result.message, result.graph = BuildStatus.INVALID_MESH, gaps.NOT_FINITE, None
    result.timings["total"] = time.perf_counter() - began
    return result


def counters(mesh: Mesh, config: BuildConfig, labels, islands, raw, thin, out, chosen, links, kept, edges) -> dict:
    """Rows in and out of each stage."""
    n = {k: v.count() for k, v in {"raw": raw, "thin": thin, "out": out, "chosen": chosen, "links": links, "kept": kept, "edges": edges}.items()}
    near = gaps.near_polygons(chosen, mesh, config, config.gap.horizontal)
    scanned = store(gaps.scan(chosen, mesh, labels, islands, config, config.gap.horizontal), "scanned")
    reduced = config.boundaries.representatives.enabled
    tried, held = scanned.count(), 0
    if config.density.pair_scan.enabled:
        pairs = gaps.suppress_pairs(scanned, islands, config)[1]
        tried, held = pairs.where("NOT suppressed").count(), pairs.where("suppressed").count()
    recovered = links.where("recovery").count()
    gone = pruning_counts(links, islands, config)
    return {
        "boundaries_raw": n["raw"], "boundaries_deduplicated": n["thin"], "boundaries_outbound_filtered": n["thin"] - n["out"],
        "boundaries_representative": n["chosen"], "boundaries_trimmed": n["out"] - n["chosen"] if reduced else 0,
        "queries": n["chosen"] + (n["thin"] if config.density.recovery.enabled else 0), "nearby_polygons": near.count(),
        "pair_scan_candidates": tried, "pair_scan_suppressed": held,
        "recovery_queries": n["thin"] if config.density.recovery.enabled else 0, "recovered": recovered,
        "reverse_links_synthesized": 0, "reverse_links_rejected": 0,
        "closest_point_queries": scanned.count(), "closest_point_failures": 0,
        "local_pruning_rejects": gone["local"], "global_pruning_rejects": gone["global"], "spanner_pruning_rejects": gone["spanner"],
        "distinct_target_reserve": gone["saved"],
        "projected": tried, "deduplicated": n["links"], "pruned_links": n["kept"], "rejected": n["links"] - n["kept"], "accepted_links": n["edges"],
        "small_islands_suppressed": islands.where("suppressed").count(),
    }
