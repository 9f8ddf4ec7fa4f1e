"""Promotion: shortest paths tie each level's skeleton into one strong component."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import STRONG_TASK_EDGES, strong_components, strong_parts, tarjan
from graphloom.operators.csr import BROADCAST_EDGES
from graphloom.operators.fixpoint import cut, forget, numbered
from graphloom.operators.paths import path_edges, shared_graph

log = logging.getLogger(__name__)


def skeleton(edges: DataFrame, level: int) -> DataFrame:
    return edges.where(F.col("promoted_level") <= level)


def residue(edges: DataFrame, level: int) -> DataFrame:
    return edges.where(F.col("promoted_level") > level)


def _circle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target) of a whole skeleton to its connections."""
    for found in tarjan(batches):
        reps = np.unique(found.column(1).to_numpy())
        if len(reps) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.roll(reps, -1).reshape(-1, 1).tolist(), pa.list_(pa.int64()))], names=["source", "targets"])


def connections(edges: DataFrame, level: int, one_task: int = STRONG_TASK_EDGES, count: int | None = None) -> DataFrame:
    """(source, targets): from the least vertex of each strong component of the skeleton to that of the next, in a circle.

    k components give k connections, one gives none. If paths join every pair, the skeleton is one
    component. ``count`` spares the count of edges where it is known.
    """
    ends = skeleton(edges, level).select("source", "target")
    if (edges.count() if count is None else count) <= one_task:
        return ends.coalesce(1).mapInArrow(_circle, "source long, targets array<long>")
    reps = cut(strong_components(ends).select("component").distinct())
    placed = cut(numbered(reps, [F.col("component").asc()]))
    follow = placed.select((F.col("place") - 1).alias("place"), F.col("component").alias("next"))
    least = reps.agg(F.min("component").alias("first"))
    circle = placed.join(follow, "place", "left").crossJoin(F.broadcast(least))  # one row
    pairs = circle.select(F.col("component").alias("source"), F.coalesce("next", "first").alias("target")).where("source <> target")
    return pairs.select("source", F.array("target").alias("targets"))


def promote_level(edges: DataFrame, level: int, broadcast_edges: int = BROADCAST_EDGES, graph: Broadcast | None = None, count: int | None = None) -> DataFrame:
    """edges whose ids lie on the connecting paths, both directions of a street, get promoted_level = level if theirs is higher."""
    links = connections(edges, level, count=count)
    if graph is None:
        links = cut(links)
        if links.isEmpty():
            return edges
    found = path_edges(edges, links.repartition("source"), broadcast_edges, graph).select("id").distinct().withColumn("_hit", F.lit(True))
    raised = F.when(F.col("_hit") & (F.col("promoted_level") > level), level).otherwise(F.col("promoted_level")).cast("int")
    out = cut(edges.join(found, "id", "left").withColumn("promoted_level", raised).select(*edges.columns))
    log.info("level %d is connected", level)
    return out


def _raised(edges: DataFrame, num_levels: int, graph: Broadcast) -> DataFrame:
    """(id, raised): the first level at which the street is on a connecting path, for graphs of few hubs, whose paths come from tables; one task goes from level to level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if not parts:
            return
        edge_id, source, target, own = (np.concatenate(side) for side in zip(*parts, strict=True))
        tail, head = np.searchsorted(g.ids, source), np.searchsorted(g.ids, target)
        for level in range(1, num_levels + 1):
            on = own <= level
            labels = strong_parts(len(g.ids), tail[on], head[on])
            reps = np.unique(labels[np.concatenate([tail[on], head[on]])])
            if len(reps) < 2:
                continue
            streets = np.unique(g.edge_id[g.hubs.paths(reps, np.roll(reps, -1))[2]])
            hit = (own > level) & np.isin(edge_id, streets)
            own[hit] = level
            some = np.unique(edge_id[hit])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), level, np.int32))], names=["id", "raised"])

    never = F.coalesce("promoted_level", F.lit(num_levels + 1)).cast("int")
    found = edges.select("id", "source", "target", never).coalesce(1).mapInArrow(run, "id long, raised int")
    return found.groupBy("id").agg(F.min("raised").alias("raised"))


def promote(edges: DataFrame, num_levels: int = 10, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """All levels from the highest on, as each starts from what the last promoted; one task's work on graphs of few hubs."""
    edges = cut(edges)
    count = edges.count()
    graph = shared_graph(edges, broadcast_edges)  # paths run on all edges, which no level changes
    if graph is not None and graph.value.hubs is not None and count <= STRONG_TASK_EDGES:
        found = edges.join(_raised(edges, num_levels, graph), "id", "left")
        raised = F.when(F.col("raised") < F.col("promoted_level"), F.col("raised")).otherwise(F.col("promoted_level")).cast("int")
        out = cut(found.withColumn("promoted_level", raised).select(*edges.columns))
        graph.destroy()
        forget(edges)
        return out
    for level in range(1, num_levels + 1):
        before, edges = edges, promote_level(edges, level, broadcast_edges, graph, count)
        if before is not edges:
            forget(before)
    return edges


def promotion_summary(edges: DataFrame) -> DataFrame:
    """(level, rows, promoted): rows by final level, and how many of these came from a lower one."""
    return edges.groupBy(F.col("promoted_level").alias("level")).agg(F.count("*").alias("rows"), F.count_if(F.col("level") > F.col("promoted_level")).alias("promoted"))
