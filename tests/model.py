"""A plain-Python model of the graph operators, for comparison."""

from __future__ import annotations

import itertools
from collections import defaultdict


def reachable(edges, start):
    seen, todo = {start}, [start]
    out = defaultdict(set)
    for _, s, t, _ in edges:
        out[s].add(t)
    while todo:
        for v in out[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def vertices(edges):
    return {v for _, s, t, _ in edges for v in (s, t)}


def strong(edges):
    reach = {v: reachable(edges, v) for v in vertices(edges)}
    return {v: min(u for u in reach[v] if v in reach[u]) for v in reach}


def weak(edges):
    both = edges + [(i, t, s, c) for i, s, t, c in edges]
    return {v: min(reachable(both, v)) for v in vertices(edges)}


def distances(edges, start):
    dist = {start: 0.0}
    for _ in range(len(vertices(edges))):
        for _, s, t, c in edges:
            if s in dist and dist[s] + c < dist.get(t, float("inf")):
                dist[t] = dist[s] + c
    return dist


def betweenness(edges):
    """By listing every shortest path."""
    total = [0.0] * len(edges)
    into = defaultdict(list)
    for k, (_, s, t, c) in enumerate(edges):
        into[t].append((k, s, c))
    for start in vertices(edges):
        dist = distances(edges, start)

        def paths(v, start=start, dist=dist):
            if v == start:
                return [[]]
            return [p + [k] for k, u, c in into[v] if u in dist and dist[u] + c == dist[v] for p in paths(u)]

        for end in dist:
            if end != start:
                found = paths(end)
                for k in itertools.chain.from_iterable(found):
                    total[k] += 1 / len(found)
    return total


def path_ids(edges, start, end):
    """Ids of the shortest path that enters each vertex from the predecessor of least id, by the edge of least id."""
    dist, out, v = distances(edges, start), [], end
    while v != start:
        u, k = min((s, i) for i, s, t, c in edges if t == v and s in dist and dist[s] + c == dist[v])
        out.append(k)
        v = u
    return out


def promote(edges, level, num_levels):
    """Final levels, by place in edges."""
    now = list(level)
    for k in range(1, num_levels + 1):
        reps = sorted(set(strong([e for e, x in zip(edges, now, strict=True) if x <= k]).values()))
        ids = {i for a, b in zip(reps, reps[1:] + reps[:1], strict=True) if a != b for i in path_ids(edges, a, b)}
        now = [k if e[0] in ids and x > k else x for e, x in zip(edges, now, strict=True)]
    return now


def labels(edges, level, num_levels):
    """Labels of edges, by place, and of vertices: 1 on the skeleton, else the component's number + 1."""
    of_edges, of_vertices = [[] for _ in edges], {v: [] for v in vertices(edges)}
    for k in range(1, num_levels + 1):
        part = weak([e for e, x in zip(edges, level, strict=True) if x > k])
        number = {c: n for n, c in enumerate(sorted(set(part.values())), 2)}
        on = {v for e, x in zip(edges, level, strict=True) if x <= k for v in e[1:3]}
        for own, e, x in zip(of_edges, edges, level, strict=True):
            own.append(number[part[e[1]]] if x > k else 1)
        for v, own in of_vertices.items():
            own.append(1 if v in on or v not in part else number[part[v]])
    return of_edges, of_vertices


def route(edges, level, num_levels, start, end, k):
    """Edges and vertices of the routed subgraph, and the path's length in it."""
    of_edges, of_vertices = labels(edges, level, num_levels)
    ends = {of_vertices[start][k - 1], of_vertices[end][k - 1]}
    some = [e for e, x, own in zip(edges, level, of_edges, strict=True) if k == num_levels or x <= k or own[k - 1] in ends]
    return len(some), len(vertices(some)), distances(some, start).get(end)
