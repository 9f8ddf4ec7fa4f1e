"""The hierarchy from streets to labelled edges, in the order of its stages."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from graphloom.operators import checks
from graphloom.operators.betweenness import edge_betweenness
from graphloom.operators.fixpoint import cut, forget
from graphloom.operators.label import label
from graphloom.operators.levels import with_levels
from graphloom.operators.preprocess import clean
from graphloom.operators.promote import promote
from graphloom.operators.update import load_results

log = logging.getLogger(__name__)


@dataclass
class Hierarchy:
    edges: DataFrame
    vertices: DataFrame
    num_levels: int
    #: What the stages said, in order.
    notices: list[str] = field(default_factory=list)


def ranked_edges(ways: DataFrame, num_levels: int = 10, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned edges with betweenness and levels, and cleaned vertices; betweenness is rounded to 9 decimals, so that levels do not hang on the order of sums."""
    from pyspark.sql import functions as F

    ways = cut(ways)  # streets are read twice, once for components
    edges, vertices = clean(ways)
    edges, vertices = cut(edges), cut(vertices)
    forget(ways)
    scored = cut(edge_betweenness(edges, sources).withColumn("betweenness", F.round("betweenness", 9)))
    levelled = with_levels(scored, num_levels).withColumn("component", F.array_repeat(F.lit(1), num_levels))
    new_edges, new_vertices = load_results(edges, vertices, levelled.select("id", "source", "target", "betweenness", "level", "component"))
    return cut(new_edges), cut(new_vertices)


def build_hierarchy(ways: DataFrame, num_levels: int = 10, verify: bool = True, sources: DataFrame | None = None) -> Hierarchy:
    """Cleaning, betweenness, levels, promotion and labels; with verify, broken invariants raise."""
    began, notices = time.perf_counter(), []

    def notice(stage: str) -> None:
        notices.append(stage)
        log.info("%s after %.1f s", stage, time.perf_counter() - began)

    edges, vertices = ranked_edges(ways, num_levels, sources)
    notice("levels")
    edges = promote(edges, num_levels)
    notice("promotion")
    edges, vertices = (cut(df) for df in label(edges, vertices, num_levels))
    notice("labels")
    if verify:
        checks.require(checks.skeleton_strongly_connected(edges, num_levels), checks.skeleton_comp_id(edges, num_levels), checks.edge_count(edges, num_levels), checks.vertex_count(vertices, num_levels))
        notice("checks")
    return Hierarchy(edges, vertices, num_levels, notices)
