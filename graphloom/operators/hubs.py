"""Exact shortest-path kernels for graphs all of whose edges touch few vertices, the hubs.

Two other vertices, leaves, share no edge, so a path alternates between hubs and single leaves: the
distances among hubs, in a graph of hubs alone, and each leaf's edges give every distance, number of
paths and path. Work is dense, over leaves and hubs, and leaves of equal edges (twins) are done once.

Sums are regrouped, so the form is taken only where costs add up without rounding; there it gives
the distances, ties and paths of the kernels in csr.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from graphloom.operators.csr import Graph

#: At most so many hubs, and so many cells of leaves by hubs (64 MB an array).
MOST_HUBS, MOST_CELLS = 64, 1 << 23
#: Costs are whole multiples of one part in this many, and longest paths stay below 2^53 of these.
PARTS = 1 << 10
#: Leaves that are worked on at once, and pairs of a start and an end.
BLOCK, PAIRS = 1024, 2048


def cover(tail: np.ndarray, head: np.ndarray, n: int, most: int) -> np.ndarray | None:
    """Vertices, at most ``most``, that every edge touches, by falling numbers of edges left; None if this finds none so few."""
    picked: list[int] = []
    while len(tail):
        degree = np.bincount(tail, minlength=n) + np.bincount(head, minlength=n)
        best = int(np.argmax(degree))
        if int(degree[best]) * (most - len(picked)) < len(tail):
            return None
        picked.append(best)
        left = (tail != best) & (head != best)
        tail, head = tail[left], head[left]
    return np.array(sorted(picked), np.int64)


@dataclass
class Hubs:
    """Least costs between leaves (rows) and hubs, infinite where there is no edge, how many edges have them and the first of these."""

    #: Codes of hubs and leaves, and each code's place among its kind; is_hub tells which.
    hub: np.ndarray
    leaf: np.ndarray
    place: np.ndarray
    is_hub: np.ndarray
    to: np.ndarray
    to_n: np.ndarray
    to_edge: np.ndarray
    back: np.ndarray
    back_n: np.ndarray
    back_edge: np.ndarray
    direct: np.ndarray
    direct_n: np.ndarray
    direct_edge: np.ndarray
    #: From hub to hub by one leaf, the least leaf's code; then by one leaf or edge, and in how many ways; then by any path, and by how many.
    over: np.ndarray
    over_leaf: np.ndarray
    step: np.ndarray
    step_n: np.ndarray
    far: np.ndarray
    far_n: np.ndarray

    @staticmethod
    def of(g: Graph, most: int = MOST_HUBS) -> Hubs | None:
        """None where the graph has no few hubs or its costs might be rounded."""
        n = len(g.ids)
        if not len(g.cost) or not np.isfinite(g.cost).all() or (g.cost <= 0).any() or (g.cost * PARTS % 1).any() or g.cost.max() * PARTS * n >= 2.0**53:
            return None
        new = np.ones(len(g.tail), bool)
        new[1:] = (g.tail[1:] != g.tail[:-1]) | (g.head[1:] != g.head[:-1])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(g.cost, first)
        cheap = g.cost == np.repeat(least, np.diff(np.append(first, len(g.cost))))
        ways = np.add.reduceat(cheap.astype(np.int64), first).astype(float)
        edge = np.minimum.reduceat(np.where(cheap, np.arange(len(g.cost)), len(g.cost)), first)
        tail, head = g.tail[first], g.head[first]
        kept = tail != head
        tail, head, least, ways, edge = (x[kept] for x in (tail, head, least, ways, edge))
        hub = cover(tail, head, n, most)
        if hub is None or not len(hub) or (n - len(hub)) * len(hub) > MOST_CELLS:
            return None
        is_hub = np.zeros(n, bool)
        is_hub[hub] = True
        leaf = np.flatnonzero(~is_hub)
        place = np.zeros(n, np.int64)
        place[hub], place[leaf] = np.arange(len(hub)), np.arange(len(leaf))

        def filled(some: np.ndarray, rows: np.ndarray, columns: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            shape = (height, len(hub))
            out = np.full(shape, np.inf), np.zeros(shape), np.full(shape, -1, np.int32)
            for x, values in zip(out, (least, ways, edge), strict=True):
                x[place[rows[some]], place[columns[some]]] = values[some]
            return out

        to = filled(~is_hub[tail], tail, head, len(leaf))
        back = filled(~is_hub[head], head, tail, len(leaf))
        direct = filled(is_hub[tail] & is_hub[head], tail, head, len(hub))
        return Hubs(hub, leaf, place, is_hub, *to, *back, *direct, *_core(to, back, direct, leaf))

    def first_hops(self, codes: np.ndarray) -> np.ndarray:
        """Distances from each code to all hubs."""
        out = np.empty((len(codes), len(self.hub)))
        on = self.is_hub[codes]
        out[on] = self.far[self.place[codes[on]]]
        out[~on] = (self.to[self.place[codes[~on]]][:, :, None] + self.far).min(axis=1)
        return out

    def distances(self, code: int) -> np.ndarray:
        """From one code to all codes; infinite where no path leads."""
        far = self.first_hops(np.array([code]))[0]
        out = np.empty(len(self.place))
        out[self.hub], out[self.leaf] = far, (far + self.back).min(axis=1)
        out[code] = 0.0
        return out

    def paths(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, hops before the edge, edge) of one shortest path for each pair of codes that has one; every vertex is entered from the predecessor of least code, by the first of its cheapest edges."""
        found = [self._paths(starts[at : at + PAIRS], ends[at : at + PAIRS], at) for at in range(0, len(starts), PAIRS)]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *side]) for side in zip(*found, strict=True)) if found else (none, none, none)

    def _paths(self, starts: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far, at, nobody = self.first_hops(starts), ends.copy(), len(self.place)
        live = np.flatnonzero(starts != ends)
        pairs, edges, back, turn = [], [], [], 0
        while len(live):
            pred, edge = np.full(len(live), nobody), np.full(len(live), -1)
            on = self.is_hub[at[live]]
            some = np.flatnonzero(on)
            pair = live[some]
            d, v = far[pair], self.place[at[pair]]
            goal = d[np.arange(len(pair)), v][:, None]
            near = np.isfinite(goal)
            by_hub = np.where(near & (d + self.direct.T[v] == goal), self.hub, nobody).min(axis=1)
            by_leaf = np.where(near & (d + self.over.T[v] == goal), self.over_leaf.T[v], nobody).min(axis=1)
            s = starts[pair]
            from_leaf = ~self.is_hub[s]
            own = self.to[np.where(from_leaf, self.place[s], 0), v] if len(self.leaf) else np.full(len(pair), np.inf)
            at_once = np.where(from_leaf & near[:, 0] & (own == goal[:, 0]), s, nobody)
            best = np.minimum(np.minimum(by_hub, by_leaf), at_once)
            ok = best < nobody
            u, v = best[ok], v[ok]
            of_hub = self.is_hub[u]
            taken = np.empty(len(u), np.int64)
            taken[of_hub] = self.direct_edge[self.place[u[of_hub]], v[of_hub]]
            taken[~of_hub] = self.to_edge[self.place[u[~of_hub]], v[~of_hub]]
            pred[some[ok]], edge[some[ok]] = u, taken
            some = np.flatnonzero(~on)
            x = self.place[at[live[some]]]
            total = far[live[some]] + self.back[x]
            k = total.argmin(axis=1)
            ok = np.isfinite(total[np.arange(len(some)), k])
            pred[some[ok]], edge[some[ok]] = self.hub[k[ok]], self.back_edge[x[ok], k[ok]]
            walked = pred < nobody
            live = live[walked]
            pairs.append(live)
            edges.append(edge[walked])
            back.append(np.full(len(live), turn))
            at[live] = pred[walked]
            live = live[at[live] != starts[live]]
            turn += 1
        if not pairs:
            return (np.zeros(0, np.int64),) * 3
        pair, edge, behind = (np.concatenate(x) for x in (pairs, edges, back))
        hops = np.bincount(pair, minlength=len(starts))
        return pair + base, hops[pair] - 1 - behind, edge


def _core(to: tuple, back: tuple, direct: tuple, leaf: np.ndarray) -> tuple[np.ndarray, ...]:
    """The graph of hubs alone: over, over_leaf, step, step_n, far, far_n."""
    (a, a_n, _), (b, b_n, _), (c, c_n, _) = to, back, direct
    h = len(c)
    over, over_n, over_leaf = np.full((h, h), np.inf), np.zeros((h, h)), np.zeros((h, h), np.int64)
    for j in range(h if len(leaf) else 0):
        total = b[:, j, None] + a
        over[j] = total.min(axis=0)
        tight = (total == over[j]) & np.isfinite(total)
        over_n[j] = (tight * (b_n[:, j, None] * a_n)).sum(axis=0)
        over_leaf[j] = leaf[tight.argmax(axis=0)]
        over[j, j], over_n[j, j] = np.inf, 0
    step = np.minimum(over, c)
    step_n = over_n * (over == step) + c_n * (c == step)
    far = step.copy()
    np.fill_diagonal(far, 0)
    for k in range(h):
        far = np.minimum(far, far[:, k, None] + far[k])
    far_n = np.eye(h)
    for j in range(h):
        for k in np.argsort(far[j], kind="stable"):
            if k != j and np.isfinite(far[j, k]):
                far_n[j, k] = (far_n[j] * step_n[:, k])[far[j] + step[:, k] == far[j, k]].sum()
    return over, over_leaf, step, step_n, far, far_n


@dataclass
class Twins:
    """What betweenness needs of each class of leaves of equal edges, starts or not, (hub, class) where a table is worked on: class is the last axis."""

    size: np.ndarray
    back: np.ndarray
    back_n: np.ndarray
    #: Rows of starts: a class each, or -1 for a hub; distances to hubs, numbers of paths, and how many starts a row stands for.
    own: np.ndarray
    far: np.ndarray
    far_n: np.ndarray
    weight: np.ndarray

    def mass(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Over all leaves as ends: (row, hub), for one start of a row, the shares of its paths whose last edge leaves the hub; (hub, class), for one leaf, the shares that enter it from the hub as an end."""
        sent, got = np.zeros((len(rows), len(self.back))), np.zeros(self.back.shape)
        for at in range(0, len(self.size), BLOCK):
            cols = slice(at, at + BLOCK)
            back, back_n, size = (np.ascontiguousarray(x[..., cols]) for x in (self.back, self.back_n, self.size))
            total = np.empty_like(back)
            sums = np.zeros_like(back)
            for i, r in enumerate(rows):
                np.add(back, self.far[r][:, None], out=total)
                share = np.multiply(back_n, self.far_n[r][:, None])
                share *= total == total.min(axis=0)
                all_paths = share.sum(axis=0)
                share /= np.where(all_paths > 0, all_paths, 1)
                sent[i] += share @ size
                k = self.own[r] - at
                np.multiply(share, self.weight[r], out=total)
                sums += total
                if self.own[r] >= 0 and 0 <= k < len(size):  # a start is no end of its own
                    sent[i] -= share[:, k]
                    sums[:, k] -= share[:, k]
            got[:, cols] = sums
        return sent, got


def twins(hubs: Hubs, starts: np.ndarray) -> tuple[Twins, np.ndarray]:
    """Classes for starts, a mark on each code, and each leaf's class."""
    h = len(hubs.hub)
    table = np.ascontiguousarray(np.concatenate([hubs.to, hubs.to_n, hubs.back, hubs.back_n, starts[hubs.leaf][:, None]], axis=1, dtype=float))
    _, first, of, size = np.unique(table.view(np.dtype((np.void, table.dtype.itemsize * table.shape[1]))).reshape(-1), return_index=True, return_inverse=True, return_counts=True)
    own = np.flatnonzero(starts[hubs.leaf][first])
    rows, rows_n = hubs.to[first[own]], hubs.to_n[first[own]]
    far, far_n = np.empty((len(own), h)), np.empty((len(own), h))
    for k in range(h):
        total = rows + hubs.far[:, k]
        far[:, k] = total.min(axis=1, initial=np.inf)
        far_n[:, k] = (rows_n * hubs.far_n[:, k] * (total == far[:, k, None])).sum(axis=1)
    from_hubs = np.flatnonzero(starts[hubs.hub])
    both = lambda x, y: np.concatenate([x, y[from_hubs]])
    rows_of = np.concatenate([own, np.full(len(from_hubs), -1)])
    return Twins(size.astype(float), hubs.back[first].T.copy(), hubs.back_n[first].T.copy(), rows_of, both(far, hubs.far), both(far_n, hubs.far_n), np.concatenate([size[own], np.ones(len(from_hubs))])), of.reshape(-1)


def edge_mass(g: Graph, hubs: Hubs, kinds: Twins, of: np.ndarray, starts: np.ndarray, sent: np.ndarray, got: np.ndarray) -> np.ndarray:
    """Each edge's betweenness, from ``Twins.mass`` of all rows."""
    h = len(hubs.hub)
    at = np.concatenate([np.zeros(0, np.int64), np.flatnonzero(starts[hubs.hub])])
    ends = (kinds.far_n > 0).astype(float)
    ends[kinds.own < 0, at] = 0
    sent = sent + ends
    leaves = kinds.own >= 0
    per_path = np.divide(sent, kinds.far_n, out=np.zeros_like(sent), where=kinds.far_n > 0)
    first = np.zeros(len(kinds.size), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    to, to_n, back, back_n = (x[first] for x in (hubs.to, hubs.to_n, hubs.back, hubs.back_n))
    # from hub to hub: what starts there, and what starts at leaves by their first edge
    between = np.zeros((h, h))
    between[at] += sent[~leaves]
    out_of, into = np.zeros(to.shape), got.T.copy()
    own = kinds.own[leaves]
    for j in range(h):
        tight = to[own, j, None] + hubs.far[j] == kinds.far[leaves]
        carried = per_path[leaves] * tight * to_n[own, j, None] * hubs.far_n[j]
        out_of[own, j] = carried.sum(axis=1)
        between[j] += kinds.weight[leaves] @ carried
    np.fill_diagonal(between, 0)
    share = np.divide(between, hubs.far_n, out=np.zeros((h, h)), where=hubs.far_n > 0)
    steps = np.zeros((h, h))
    for a in range(h):
        for b in range(h):
            if np.isfinite(hubs.step[a, b]):
                tight = (hubs.far[:, a, None] + hubs.step[a, b] + hubs.far[b] == hubs.far) & np.isfinite(hubs.far)
                steps[a, b] = (share * tight * hubs.far_n[:, a, None] * hubs.far_n[b]).sum()  # for each way from a to b
        tight = (back[:, a, None] + to == hubs.step[a]) & np.isfinite(to)
        tight[:, a] = False
        carried = tight * (back_n[:, a, None] * to_n) * steps[a]
        into[:, a] += carried.sum(axis=1)
        out_of += carried
    out = np.zeros(len(g.cost))
    u, v = g.tail, g.head
    pu, pv = hubs.place[u], hubs.place[v]
    for some, least, ways, value, rows, columns in (
        (~hubs.is_hub[u] & hubs.is_hub[v], hubs.to, hubs.to_n, out_of[of], pu, pv),
        (hubs.is_hub[u] & ~hubs.is_hub[v], hubs.back, hubs.back_n, into[of], pv, pu),
        (hubs.is_hub[u] & hubs.is_hub[v] & (u != v), hubs.direct, hubs.direct_n, np.where(hubs.direct == hubs.step, steps * hubs.direct_n, 0), pu, pv),
    ):
        cell = rows[some], columns[some]
        out[some] = np.where(g.cost[some] == least[cell], value[cell] / ways[cell], 0)
    return out
