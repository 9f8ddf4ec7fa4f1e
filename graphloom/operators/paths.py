"""Shortest paths from one vertex to many, and distances by relaxation joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.csr import BROADCAST_EDGES, Graph, shortest_tree
from graphloom.operators.fixpoint import cut
from graphloom.operators.hubs import Hubs


def distances_by_joins(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, distance) by frontier rounds; only vertices that came nearer in a round relax their edges in the next."""
    links = edges.groupBy("source", "target").agg(F.min("cost").alias("cost"))
    links = cut(links)
    best = front = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0.0).alias("distance")))
    while True:
        step = front.join(links, front["node"] == links["source"]).select("start", F.col("target").alias("node"), (F.col("distance") + F.col("cost")).alias("distance"))
        near = step.groupBy("start", "node").agg(F.min("distance").alias("distance"))
        old = best.select("start", "node", F.col("distance").alias("old"))
        front = cut(near.join(old, ["start", "node"], "left").where("old is null or distance < old").select("start", "node", "distance"))
        if front.isEmpty():
            return best
        best = cut(best.union(front).groupBy("start", "node").agg(F.min("distance").alias("distance")))


def distances(edges: DataFrame, starts: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(start, node, distance) from each start (id) that is a vertex to all it reaches, itself included."""
    edges = cut(edges.select("id", "source", "target", "cost"))
    starts = starts.select("id").distinct()
    known = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    starts = starts.join(known, "id", "left_semi")
    shared = shared_graph(edges, broadcast_edges)
    if shared is None:
        return distances_by_joins(edges, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        lists = g.lists() if g.hubs is None else None
        for batch in batches:
            for start in batch.column(0).to_pylist():
                if g.hubs is not None:
                    near = g.hubs.distances(g.code(start))
                    met = np.flatnonzero(np.isfinite(near))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), start)), pa.array(g.ids[met]), pa.array(near[met])], names=["start", "node", "distance"])
                    continue
                dist, _ = shortest_tree(lists, g.code(start))
                yield pa.RecordBatch.from_arrays([pa.array([start] * len(dist), pa.int64()), pa.array(g.ids[list(dist)]), pa.array(list(dist.values()), pa.float64())], names=["start", "node", "distance"])

    return starts.mapInArrow(run, "start long, node long, distance double")


def shared_graph(edges: DataFrame, broadcast_edges: int = BROADCAST_EDGES) -> Broadcast | None:
    """The graph as broadcast arrays, or None if it has more edges than that, or than twice that where all touch few vertices."""
    edges = cut(edges.select("id", "source", "target", "cost"))
    count = edges.count()
    if count > 2 * broadcast_edges:
        return None
    g = Graph.collect(edges)
    g.hubs = Hubs.of(g)
    if g.hubs is None and count > broadcast_edges:
        return None
    return edges.sparkSession.sparkContext.broadcast(g)


def path_edges(edges: DataFrame, connections: DataFrame, broadcast_edges: int = BROADCAST_EDGES, graph: Broadcast | None = None) -> DataFrame:
    """(start, end, seq, id, source, target, cost): the edges of one shortest path for each target of connections (source, targets).

    Among shortest paths, each vertex is entered from the predecessor of least id, by the edge of
    least id. A path of no edges has no rows, and there is no row for an unreachable target. ``graph``
    spares the edges' collection where many calls share them.
    """
    shared = graph or shared_graph(edges, broadcast_edges)
    if shared is None:
        return _paths_by_joins(cut(edges.select("id", "source", "target", "cost")), connections)
    shape = "start long, end long, seq int, id long, source long, target long, cost double"

    def by_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            asked = [(start, end) for start, targets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for end in dict.fromkeys(targets)]
            codes = [(s, e, g.code(s), g.code(e)) for s, e in asked]
            known = np.array([c for c in codes if c[2] >= 0 and c[3] >= 0], np.int64).reshape(-1, 4)
            pair, before, edge = g.hubs.paths(known[:, 2], known[:, 3])
            columns = (known[pair, 0], known[pair, 1], (before + 1).astype(np.int32), g.edge_id[edge], g.ids[g.tail[edge]], g.ids[g.head[edge]], g.cost[edge])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in shape.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        lists = g.lists()
        ids, tail, cost = g.ids, g.tail, g.cost
        for batch in batches:
            rows = []
            for start, targets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = g.code(start)
                codes = [(t, g.code(t)) for t in dict.fromkeys(targets)]
                if u < 0:
                    continue
                _, into = shortest_tree(lists, u, {c for _, c in codes if c >= 0})
                for end, c in codes:
                    back = []
                    while c in into and c != u:
                        back.append(into[c])
                        c = int(tail[into[c]])
                    rows += [(start, end, k, int(g.edge_id[e]), int(ids[tail[e]]), int(ids[g.head[e]]), float(cost[e])) for k, e in enumerate(reversed(back), 1)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["start", "end", "seq", "id", "source", "target", "cost"])

    return connections.select("source", "targets").mapInArrow(run if shared.value.hubs is None else by_hubs, shape)


def _paths_by_joins(edges: DataFrame, connections: DataFrame) -> DataFrame:
    dist = cut(distances_by_joins(edges, connections.select(F.col("source").alias("id")).distinct()))
    a, b, e = dist.alias("a"), dist.alias("b"), edges.alias("e")
    tight = e.join(a, F.col("e.source") == F.col("a.node")).join(b, (F.col("e.target") == F.col("b.node")) & (F.col("a.start") == F.col("b.start")))
    tight = tight.where((F.col("a.distance") + F.col("e.cost") == F.col("b.distance")) & (F.col("e.target") != F.col("a.start")))
    into = cut(tight.groupBy(F.col("a.start").alias("start"), F.col("e.target").alias("target")).agg(F.min(F.struct(F.col("e.source").alias("source"), F.col("e.id").alias("id"), F.col("e.cost").alias("cost"))).alias("via")))
    walk = cut(connections.select(F.col("source").alias("start"), F.explode("targets").alias("end")).distinct().withColumns({"at": F.col("end"), "back": F.lit(0)}))
    found = None
    while True:
        step = cut(walk.join(into, (walk["start"] == into["start"]) & (walk["at"] == into["target"])).select(walk["start"], "end", "back", "via.id", "via.source", "target", "via.cost"))
        if step.isEmpty():
            break
        found = step if found is None else cut(found.union(step))
        walk = step.select("start", "end", F.col("source").alias("at"), (F.col("back") + 1).alias("back"))
    if found is None:
        found = step
    seq = (F.max("back").over(Window.partitionBy("start", "end")) - F.col("back") + 1).cast("int")
    return found.select("start", "end", seq.alias("seq"), "id", "source", "target", "cost")
