"""A directed multigraph as arrays, and its per-source kernels.

The arrays are broadcast only after the edges have been counted: BROADCAST_EDGES bounds them to
some 100 MB. Beyond that, callers take the join-based forms of the same operators.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

BROADCAST_EDGES = 2_000_000


@dataclass
class Graph:
    """Edges in order of (source, target, id, cost): ends as codes into ids, and where each vertex's edges begin."""

    ids: np.ndarray
    edge_id: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    cost: np.ndarray
    first: np.ndarray
    #: The place that each edge had in the input.
    order: np.ndarray
    #: ``hubs.Hubs`` of the graph, where it has them and they were looked for.
    hubs: object = None

    @staticmethod
    def of(edge_id: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray) -> Graph:
        order = np.lexsort((cost, edge_id, target, source))
        ids, code = np.unique(np.concatenate([source, target]), return_inverse=True)
        tail, head = code[: len(source)][order], code[len(source) :][order]
        return Graph(ids, edge_id[order], tail, head, cost[order], np.searchsorted(tail, np.arange(len(ids) + 1)), order)

    @staticmethod
    def collect(edges: DataFrame) -> Graph:
        """The caller has counted the edges."""
        t = edges.select("id", "source", "target", "cost").toArrow()
        return Graph.of(*(t.column(i).to_numpy() for i in range(4)))

    def code(self, vertex: int) -> int:
        """The vertex's place in ids, or -1."""
        k = int(np.searchsorted(self.ids, vertex))
        return k if k < len(self.ids) and self.ids[k] == vertex else -1

    def lists(self) -> tuple[list, list, list]:
        """Plain lists for loops: where edges begin, heads, costs."""
        return self.first.tolist(), self.head.tolist(), self.cost.tolist()


def shortest_tree(lists: tuple[list, list, list], source: int, targets: set[int] | None = None, only: bytes | None = None) -> tuple[dict[int, float], dict[int, int]]:
    """Distances and the edge into each settled vertex; stops when all targets are settled. ``only`` marks the edges that may be taken, a byte each.

    Among equal distances the predecessor of least code wins, then the first edge.
    """
    first, head, cost = lists
    dist: dict[int, float] = {source: 0.0}
    into: dict[int, int] = {}
    settled: set[int] = set()
    left = None if targets is None else set(targets)
    queue = [(0.0, source)]
    tails: dict[int, int] = {}
    while queue:
        d, u = heapq.heappop(queue)
        if u in settled:
            continue
        settled.add(u)
        if left is not None:
            left.discard(u)
            if not left and (not queue or queue[0][0] > d):
                break
        for e in range(first[u], first[u + 1]):
            if only is not None and not only[e]:
                continue
            v, new = head[e], d + cost[e]
            old = dist.get(v)
            if old is None or new < old:
                dist[v], into[v], tails[v] = new, e, u
                heapq.heappush(queue, (new, v))
            elif new == old and v != source and v not in settled and u < tails[v]:
                into[v], tails[v] = e, u
    return dist, into


def dependencies(lists: tuple[list, list, list], n: int, source: int, total: np.ndarray) -> None:
    """Adds to total[e] the share of shortest paths from source through edge e, over all ends, by Brandes' accumulation.

    Costs are positive; parallel edges of equal cost are paths of their own.
    """
    first, head, cost = lists
    dist = {source: 0.0}
    sigma = {source: 1.0}
    into: dict[int, list[tuple[int, int]]] = {source: []}
    order: list[int] = []
    done: set[int] = set()
    queue = [(0.0, source)]
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        paths = sigma[u]
        for e in range(first[u], first[u + 1]):
            v = head[e]
            new = d + cost[e]
            old = dist.get(v)
            if old is None or new < old:
                dist[v] = new
                sigma[v] = paths
                into[v] = [(u, e)]
                heapq.heappush(queue, (new, v))
            elif new == old and v not in done:
                sigma[v] += paths
                into[v].append((u, e))
    delta = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        share = (1.0 + delta[w]) / sigma[w]
        for u, e in into[w]:
            c = sigma[u] * share
            total[e] += c
            delta[u] += c


def strong_labels(n: int, first: list, head: list) -> list[int]:
    """For each vertex the least vertex of its strong component, by Tarjan's search without recursion."""
    index, low, label = [-1] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = 0
    for start in range(n):
        if index[start] >= 0:
            continue
        work = [(start, first[start])]
        index[start] = low[start] = count
        count += 1
        stack.append(start)
        while work:
            u, e = work[-1]
            if e < first[u + 1]:
                work[-1] = (u, e + 1)
                v = head[e]
                if index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    stack.append(v)
                    work.append((v, first[v]))
                elif label[v] < 0 and index[v] < low[u]:
                    low[u] = index[v]
                continue
            work.pop()
            if work and low[u] < low[work[-1][0]]:
                low[work[-1][0]] = low[u]
            if low[u] == index[u]:
                members = []
                while True:
                    v = stack.pop()
                    members.append(v)
                    if v == u:
                        break
                least = min(members)
                for v in members:
                    label[v] = least
    return label
