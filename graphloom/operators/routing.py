"""Routing on the skeleton and the components of both ends, and its quality against exact paths."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.csr import BROADCAST_EDGES, Graph, shortest_tree
from graphloom.operators.fixpoint import cut
from graphloom.operators.update import zip_pairs


class TooLarge(ValueError):
    """The graph has more edges than are sent to tasks."""


def random_pairs(vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(source, target): two random samples of n vertices each, paired by place; pairs of one vertex are dropped."""
    draw = lambda k: vertices.select("id", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(k)))).alias("_h")).orderBy("_h", "id").limit(n)
    return zip_pairs(draw(0), draw(1), ("_h", "id")).where("source <> target").select("source", "target")


def routed_edges(edges: DataFrame, level: int, source_component: int, target_component: int) -> DataFrame:
    """The edges that a route may use: the skeleton, and those labelled as either end's component."""
    return edges.where((F.col("promoted_level") <= level) | F.get("component", F.lit(level - 1)).isin(source_component, target_component))


_SHAPE = "source long, target long, level int, num_edges int, num_vertices int, path_len double, graph_build_time double, avg_computation_time double"


#: Passes over a route's edges before its search goes vertex by vertex.
PASSES = 64


def _distance(source: int, target: int, n: int, passes: int, tail: np.ndarray, head: np.ndarray, cost: np.ndarray) -> tuple[bool, float | None]:
    """Whether so many passes over edges in order of head settled all distances, and target's, None without a path."""
    far = np.full(n, np.inf)
    far[source] = 0.0
    first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    ends = head[first]
    for _ in range(passes):
        near = np.minimum.reduceat(far[tail] + cost, first)
        if not (near < far[ends]).any():
            return True, float(far[target]) if np.isfinite(far[target]) else None
        far[ends] = np.minimum(far[ends], near)
    return False, None


def routes(edges: DataFrame, vertices: DataFrame, pairs: DataFrame, levels: list[int], num_levels: int = 10, iterations: int = 1, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """A row for each pair and level: source, target, level, num_edges and num_vertices of the routed subgraph, path_len, and seconds to build it and, on average of iterations, to search it.

    At level num_levels the whole graph is routed. path_len is null without a path. The graph is one
    set of arrays, and a route's subgraph a mark on each of its edges. Graphs beyond broadcast_edges
    take ``routes_by_joins``.
    """
    edges = cut(edges.select("id", "source", "target", "cost", "promoted_level", "component"))
    if edges.count() > broadcast_edges:
        return routes_by_joins(edges, vertices, pairs, levels, num_levels)
    t = edges.toArrow().combine_chunks()
    g = Graph.of(*(t.column(i).to_numpy() for i in range(4)))
    promoted = t.column(4).to_numpy()[g.order]
    flat = [np.asarray(c.flatten()) for c in t.column(5).chunks]
    parts = np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int32).reshape(-1, num_levels)[g.order]
    shared = edges.sparkSession.sparkContext.broadcast((g, promoted, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, promoted, parts = shared.value
        lists, by_head = None, np.argsort(g.head, kind="stable")
        for batch in batches:
            rows = []
            for s, e, level, cs, ct in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                began = time.perf_counter()
                some = np.ones(len(g.cost), bool)
                if level != num_levels:
                    some = (promoted <= level) | (parts[:, level - 1] == cs) | (parts[:, level - 1] == ct)
                met = np.zeros(len(g.ids), bool)
                met[g.tail[some]] = met[g.head[some]] = True
                u, v = g.code(s), g.code(e)
                taken = by_head[some[by_head]]
                ends = g.tail[taken], g.head[taken], g.cost[taken]
                built = time.perf_counter()
                found = None
                for _ in range(iterations):
                    if u >= 0 and v >= 0 and met[u] and met[v]:
                        settled, found = _distance(u, v, len(g.ids), PASSES, *ends)
                        if not settled:
                            lists = lists or g.lists()
                            found = shortest_tree(lists, u, {v}, some.tobytes())[0].get(v)
                rows.append((s, e, level, int(some.sum()), int(met.sum()), found, built - began, (time.perf_counter() - built) / iterations))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in _SHAPE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return _asked(vertices, pairs, levels).repartition("source", "target", "level").mapInArrow(run, _SHAPE)


def _asked(vertices: DataFrame, pairs: DataFrame, levels: list[int]) -> DataFrame:
    """(source, target, level, cs, ct): a row for each pair and level, with the labels of both ends at that level."""
    ends = vertices.select("id", "component")
    asked = pairs.join(ends.select(F.col("id").alias("source"), F.col("component").alias("cs")), "source").join(ends.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target")
    asked = asked.select("source", "target", F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"), "cs", "ct")
    return asked.select("source", "target", "level", *[F.get(c, F.col("level") - 1).alias(c) for c in ("cs", "ct")])


def routes_by_joins(edges: DataFrame, vertices: DataFrame, pairs: DataFrame, levels: list[int], num_levels: int = 10) -> DataFrame:
    """The same for graphs that no task can hold: one relaxation runs for all pairs and levels, on vertices tagged by their route.

    The times are those of the whole, shared out among the routes.
    """
    began = time.perf_counter()
    asks = cut(_asked(vertices, pairs, levels).withColumn("ask", F.monotonically_increasing_id()))
    allowed = (F.col("level") == num_levels) | (F.col("promoted_level") <= F.col("level")) | F.get("component", F.col("level") - 1).isin(F.col("cs"), F.col("ct"))
    edges = edges.select("source", "target", "cost", "promoted_level", "component")
    terms = F.broadcast(asks.select("ask", "level", "cs", "ct"))
    routed = edges.crossJoin(terms).where(allowed)  # the stated routes against all edges
    counts = cut(routed.groupBy("ask").agg(F.count("*").cast("int").alias("num_edges")))
    met = cut(routed.select("ask", F.explode(F.array("source", "target")).alias("node")).distinct().groupBy("ask").agg(F.count("*").cast("int").alias("num_vertices")))
    built = time.perf_counter()
    best = front = cut(asks.select("ask", F.col("source").alias("node"), F.lit(0.0).alias("distance")))
    while True:
        step = front.join(terms, "ask").join(edges, F.col("node") == edges["source"]).where(allowed)
        near = step.groupBy("ask", edges["target"].alias("node")).agg(F.min(F.col("distance") + F.col("cost")).alias("distance"))
        old = best.select("ask", "node", F.col("distance").alias("old"))
        front = cut(near.join(old, ["ask", "node"], "left").where("old is null or distance < old").select("ask", "node", "distance"))
        if front.isEmpty():
            break
        best = cut(best.union(front).groupBy("ask", "node").agg(F.min("distance").alias("distance")))
    done = time.perf_counter()
    n = max(1, asks.count())
    far = best.select("ask", F.col("node").alias("target"), F.col("distance").alias("path_len"))
    out = asks.join(counts, "ask", "left").join(met, "ask", "left").join(far, ["ask", "target"], "left")
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("num_edges", "num_vertices")]
    return out.select("source", "target", "level", *none, "path_len", F.lit((built - began) / n).alias("graph_build_time"), F.lit((done - built) / n).alias("avg_computation_time"))


def route_quality(found: DataFrame, num_levels: int = 10, total_edges: int | None = None) -> DataFrame:
    """(level, pairs, exact_pairs, edge_share, stretch): how much of the graph a level's routes search, and how much longer they are than on the whole graph."""
    exact = found.where(F.col("level") == num_levels).select("source", "target", F.col("path_len").alias("exact"), F.col("num_edges").alias("all_edges"))
    both = found.join(exact, ["source", "target"])
    return both.groupBy("level").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("path_len") == F.col("exact")).alias("exact_pairs"),
        F.round(F.avg(F.col("num_edges") / F.col("all_edges")), 6).alias("edge_share"),
        F.round(F.avg(F.col("path_len") / F.col("exact")), 6).alias("stretch"),
    )
