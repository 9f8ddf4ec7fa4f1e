"""Links within groups in bounded tasks: hot groups are cut into blocks, and sorted partitions are read group by group.

``linked`` finds links whose components are those of all similar pairs of each group, with work that
grows with a group's size where its members are alike:

1. each block of a group is searched by itself;
2. of each set of linked rows one represents it in further searches, which deal the representatives
   into blocks anew as long as that halves the number of sets;
3. where a group still has several sets, the rows outside its largest set meet all its rows.

A group of one block takes the first step alone. No step leaves out a pair of different sets, and no
task holds more than two blocks of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import cut
from graphloom.operators.fixpoint import weak_components

#: Which rows a row is like.
Near = Callable[[int], np.ndarray]
#: Of a table's rows, which of those from the second number to before the third are like the first.
Alike = Callable[[int, int, int], np.ndarray]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(n: int, near: Near) -> list[tuple[int, int]]:
    """Links that span the components of all pairs (i, j) with near(i)[j]; near is symmetric.

    Rows that are near an earlier one are not asked again while all rows are one set: a group of
    like rows costs one call. Else the rows outside the largest set are asked, each once.
    """
    sets, links = Forest(n), []
    reached, asked = np.zeros(n, bool), np.zeros(n, bool)

    def ask(i: int) -> None:
        asked[i] = True
        for j in np.flatnonzero(near(i)).tolist():
            reached[j] = True
            if sets.join(i, j):
                links.append((min(i, j), max(i, j)))

    for i in range(n):
        if not reached[i]:
            ask(i)
    roots = np.array([sets.root(i) for i in range(n)], np.int64)
    if n and (roots != roots[0]).any() and not asked.all():
        largest = np.bincount(roots).argmax()
        for i in np.flatnonzero((roots != largest) & ~asked).tolist():
            ask(i)
    return links


def forest_across(labels: np.ndarray, rest: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """The same for pairs of a row of rest and any row of another label."""
    n = len(labels)
    sets, links = Forest(n), []
    _, first, code = np.unique(labels, return_index=True, return_inverse=True)
    for i, k in enumerate(first[code].tolist()):
        sets.join(i, k)
    parts = len(first)
    for i in np.flatnonzero(rest).tolist():
        if parts == 1:
            break
        for j in np.flatnonzero(near(i)).tolist():
            if sets.join(i, j):
                links.append((i, j))
                parts -= 1
    return links


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000, size: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, of some rows rows or size bytes, and the groups' bounds; the input is sorted by its first ``keys`` columns, all long."""
    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            c = t.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        t = pa.Table.from_batches(held)
        starts = bounds(t)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), starts
        held = t.slice(last).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.append(bounds(t), t.num_rows)


def _search(kernel: Callable[[pa.Table], Alike], across: bool, rows: int):
    """(key, a, b, rest, label, node, payload), sorted by unit, to links (source, target) of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, 3, rows):
            node, label, rest = (t.column(c).to_numpy() for c in ("node", "label", "rest"))
            alike, sources, targets = kernel(t), [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                near = lambda i: alike(s + i, s, e)  # noqa: B023, E731
                links = forest_across(label[s:e], rest[s:e], near) if across else forest(e - s, near)
                sources += [s + i for i, _ in links]
                targets += [s + j for _, j in links]
            yield pa.RecordBatch.from_arrays([pa.array(node[np.array(sources, np.int64)]), pa.array(node[np.array(targets, np.int64)])], names=["source", "target"])

    return run


def _in_units(units: DataFrame, key: str, kernel: Callable[[pa.Table], Alike], across: bool, rows: int, payload: tuple[str, ...]) -> DataFrame:
    dealt = units.select(key, "a", "b", "rest", "label", "node", *payload).repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")
    return dealt.mapInArrow(_search(kernel, across, rows), "source long, target long").where("source <> target")


def linked(members: DataFrame, key: str, kernel: Callable[[pa.Table], Alike], payload: tuple[str, ...], block: int, rows: int = 20_000) -> DataFrame:
    """(source, target): links of nodes whose components hold every two similar rows of a group.

    members is a checkpoint of (key, node, parts, payload) with long keys and nodes; ``parts`` says
    into how many blocks the group is cut. ``kernel`` makes the similarity of a table's rows.
    """
    none = F.lit(0).cast("long")
    plain = lambda df: df.withColumns({"b": none, "rest": F.lit(False), "label": none})
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long"))
    links = _in_units(plain(members.withColumn("a", own)), key, kernel, False, rows, payload)
    wide = members.where("parts > 1")
    if wide.isEmpty():
        return links
    links, turn, before = cut(links), 0, None
    while True:
        labels = weak_components(links).select("node", F.col("component").alias("label"))
        named = cut(wide.select(key, "node", "parts").join(labels, "node", "left").select(key, "node", "parts", F.coalesce("label", "node").alias("label")))
        sets = named.groupBy(key, "label").agg(F.min("node").alias("node"))
        many = cut(sets.groupBy(key).agg(F.count("*").alias("sets")).where("sets > 1"))
        left, most = many.agg(F.coalesce(F.sum("sets"), F.lit(0)), F.coalesce(F.max("sets"), F.lit(0))).first()
        if not left:
            return links
        if before and (2 * left > before or most <= block):
            break
        # representatives are dealt anew while that halves the sets, as it does where most are alike
        before, turn = left, turn + 1
        chosen = sets.join(many, key).join(wide.select(key, "node", *payload), [key, "node"])
        chosen = chosen.withColumn("a", F.pmod(F.xxhash64(F.lit(turn), "node"), F.ceil(F.col("sets") / block).cast("long")))
        links = cut(links.union(_in_units(plain(chosen.drop("label")), key, kernel, False, rows, payload)))
    sizes = cut(named.groupBy(key, "label").agg(F.count("*").alias("n")))
    main = sizes.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    open_ = named.join(main, key)
    if open_.isEmpty():
        return links
    open_ = cut(open_.withColumns({"others": F.ceil(F.col("others") / block).cast("long"), "parts": F.col("parts").cast("long")}))
    open_ = open_.join(wide.select(key, "node", *payload), [key, "node"])
    upto = lambda n: F.explode(F.sequence(none, n - 1))
    every = open_.withColumns({"a": own, "rest": F.lit(False)}).withColumn("b", upto(F.col("others")))
    rest = open_.where("label <> main").withColumns({"b": F.pmod(F.xxhash64("node"), F.col("others")), "rest": F.lit(True)}).withColumn("a", upto(F.col("parts")))
    columns = (key, "a", "b", "rest", "label", "node", *payload)
    return links.union(_in_units(every.select(*columns).union(rest.select(*columns)), key, kernel, True, rows, payload))
