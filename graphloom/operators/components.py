"""Strong components of directed edges; weak ones are in fixpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.csr import strong_labels
from graphloom.operators.fixpoint import cut


#: Strong components of at most so many edges are one task's work: 16 bytes an edge, and some 60 while its ends are coded.
STRONG_TASK_EDGES = 1 << 22
#: Passes over all edges that a task tries before it searches vertex by vertex.
PASSES = 64


def _reach(n: int, start: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray | None:
    """A mark on each vertex that start reaches; None if paths are longer than PASSES."""
    met = np.zeros(n, bool)
    met[start] = True
    for _ in range(PASSES):
        new = head[met[tail] & ~met[head]]
        if not len(new):
            return met
        met[new] = True
    return None


def strong_parts(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """For each vertex the least of its strong component: vertices without edges in or out are trimmed, the component of
    the vertex with most edges is met by passes from it and to it, and what is left is searched vertex by vertex."""
    label = np.arange(n)
    live = tail != head
    tail, head = tail[live], head[live]
    for _ in range(PASSES):
        on = (np.bincount(tail, minlength=n) > 0) & (np.bincount(head, minlength=n) > 0)
        live = on[tail] & on[head]
        if live.all():
            break
        tail, head = tail[live], head[live]
    if not len(tail):
        return label
    most = int(np.argmax(np.bincount(tail, minlength=n) + np.bincount(head, minlength=n)))
    ahead = _reach(n, most, tail, head)
    behind = None if ahead is None else _reach(n, most, head, tail)
    if behind is not None:
        both = np.flatnonzero(ahead & behind)
        label[both] = both[0]
        # no other component has vertices on both sides of these marks
        live = (ahead[tail] == ahead[head]) & (behind[tail] == behind[head]) & ~(ahead & behind)[tail]
        tail, head = tail[live], head[live]
    nodes, code = np.unique(np.concatenate([tail, head]), return_inverse=True)
    tail, head = code[: len(tail)], code[len(tail) :]
    order = np.argsort(tail, kind="stable")
    first = np.searchsorted(tail[order], np.arange(len(nodes) + 1))
    label[nodes] = nodes[np.array(strong_labels(len(nodes), first.tolist(), head[order].tolist()), np.int64)]
    return label


def tarjan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, target) of a whole graph to (node, component)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ids, code = np.unique(np.concatenate([np.concatenate(side) for side in zip(*parts, strict=True)]), return_inverse=True)
    half = len(code) // 2
    labels = strong_parts(len(ids), code[:half], code[half:])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[labels])], names=["node", "component"])


def _spread(reach: DataFrame, links: DataFrame, pick) -> DataFrame:
    """Lets marks run along links (u, v) until none changes: each vertex takes pick over its own mark and its predecessors'."""
    while True:
        came = links.join(reach, links["u"] == reach["node"]).groupBy("v").agg(pick("mark").alias("came"))
        both = reach.join(came, reach["node"] == came["v"], "left")
        better = F.col("came").isNotNull() & F.when(F.col("mark").isNull(), True).otherwise(F.col("came") < F.col("mark"))
        step = cut(both.select("node", F.when(better, F.col("came")).otherwise(F.col("mark")).alias("mark"), better.alias("new")))
        reach = step.select("node", "mark")
        if step.where("new").isEmpty():
            return reach


def strong_components(edges: DataFrame, one_task: int = STRONG_TASK_EDGES) -> DataFrame:
    """(node, component) for every end of an edge; component is the least node of the strong component.

    Vertices without edges in or out of them are trimmed as components of their own. While more than
    one_task edges are left, rounds colour each vertex with the least vertex that reaches it; the
    vertices that reach their colour back, within it, are its component and leave the graph. What is
    left then, or from the start, is searched in one task of bounded size.
    """
    ends = cut(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    if ends.count() <= one_task:
        return ends.coalesce(1).mapInArrow(tarjan, "node long, component long")
    live = cut(ends.where("u <> v").distinct())
    found = cut(ends.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    done = None
    while live.count() > one_task:
        inner = live.join(live.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", "v")
        inner = cut(inner.join(live.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        if inner.count() < live.count():
            live = inner
            continue
        nodes = live.select("u").union(live.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("mark"))
        colour = cut(_spread(cut(nodes), live, F.min))
        tinted = live.join(colour.select(F.col("node").alias("u"), F.col("mark").alias("cu")), "u").join(colour.select(F.col("node").alias("v"), F.col("mark").alias("cv")), "v")
        inside = cut(tinted.where("cu = cv").select(F.col("v").alias("u"), F.col("u").alias("v")))
        seeds = colour.select("node", F.when(F.col("node") == F.col("mark"), F.col("node")).alias("mark"))
        back = _spread(cut(seeds), inside, F.min).where("mark is not null")
        done = back if done is None else cut(done.union(back))
        gone = back.select(F.col("node").alias("u"))
        live = cut(live.join(gone, "u", "left_anti").join(gone.select(F.col("u").alias("v")), "v", "left_anti").select("u", "v"))
    last = live.select("u", "v").coalesce(1).mapInArrow(tarjan, "node long, component long")
    marks = last if done is None else done.select("node", F.col("mark").alias("component")).union(last)
    return found.join(marks, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("num_nodes"))


def largest_component(components: DataFrame) -> DataFrame:
    """(id): the vertices of the component with most of them, of those the one with the least id."""
    kept = cut(components)
    best = component_sizes(kept).orderBy(F.desc("num_nodes"), "component").limit(1).select("component")
    return kept.join(F.broadcast(best), "component", "left_semi").select(F.col("node").alias("id"))
