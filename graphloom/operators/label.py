"""Component labels of each level's residue; label 1 means "on the skeleton"."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import ONE_TASK_EDGES, cut, forget, numbered, roots, unite, weak_components

#: Levels take this many low bits, so that (vertex, level) is one number and all levels are solved in one pass.
_BITS = 7
#: Vertex ids are smaller than this, on both sides of zero.
MOST_ID = 1 << 63 - _BITS
#: Rows of a batch that a task gives back.
_ROWS = 1 << 16


def _levels(num_levels: int) -> Column:
    if not 0 < num_levels < 1 << _BITS:
        raise ValueError(f"num_levels must lie between 1 and {(1 << _BITS) - 1}")
    return F.sequence(F.lit(1), F.lit(num_levels))


def at_level(vertex: Column, level: Column) -> Column:
    """One number for a vertex at a level; an id that has no room for it raises."""
    return F.when(F.abs(vertex) < MOST_ID, F.shiftleft(vertex, _BITS) + level).otherwise(F.raise_error(F.lit(f"vertex ids must lie within {MOST_ID}")).cast("long"))


def split_level(coded: Column) -> tuple[Column, Column]:
    """The vertex and the level of such a number."""
    return F.shiftright(coded, _BITS), F.pmod(coded, F.lit(1 << _BITS)).cast("int")


def _thin(source: np.ndarray, target: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of edges that give the same components above every level: a spanning forest by falling levels, and each vertex's highest loop."""
    nodes, code = np.unique(np.concatenate([source, target]), return_inverse=True)
    order = np.argsort(-own, kind="stable")
    tail, head = code[: len(source)][order], code[len(source) :][order]
    kept = unite(list(range(len(nodes))), tail, head)
    loops = np.flatnonzero(tail == head)
    kept[loops[np.unique(tail[loops], return_index=True)[1]]] = True
    return order[kept]


def _thinned(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(source, target, own) to the rows that ``_thin`` keeps of a partition, which holds at most size rows, or twice those kept, at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = [np.zeros(0, np.int64)] * 3, [], 0

        def merge() -> list[np.ndarray]:
            every = [np.concatenate(side) for side in zip(held, *waiting, strict=True)]
            kept = _thin(*every)
            return [x[kept] for x in every]

        for batch in batches:
            waiting.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= max(size, len(held[0])):
                held, waiting, n = merge(), [], 0
        if waiting:
            held = merge()
        for at in range(0, len(held[0]), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + _ROWS]) for x in held], names=["source", "target", "own"])

    return run


def _nested(num_levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(source, target, own) of a whole graph to (level, node, component): as residues shrink from level to level, the edges are added by falling levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not parts:
            return
        source, target, own = (np.concatenate(side) for side in zip(*parts, strict=True))
        nodes, code = np.unique(np.concatenate([source, target]), return_inverse=True)
        tail, head = code[: len(source)], code[len(source) :]
        up, on = list(range(len(nodes))), np.zeros(len(nodes), bool)
        for level in range(num_levels, 0, -1):
            new = own > level if level == num_levels else own == level + 1
            unite(up, tail[new], head[new])
            on[tail[new]] = on[head[new]] = True
            some, component = np.flatnonzero(on), nodes[roots(up)]
            for at in range(0, len(some), _ROWS):
                rows = some[at : at + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), level, np.int32)), pa.array(nodes[rows]), pa.array(component[rows])], names=["level", "node", "component"])

    return run


def residue_components(edges: DataFrame, num_levels: int = 10, column: str = "promoted_level", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(level, node, component): weak components of the edges above each level; component is the least vertex.

    An edge is read once, with its own level. Of more than one_task edges each task keeps a spanning
    forest by falling levels, as long as that halves them; what is left is one task's work, or else
    all levels' copies of the edges are contracted in one pass.
    """
    _levels(num_levels)
    bounded = lambda v: F.shiftright(at_level(v, F.lit(0)), _BITS)
    ends = edges.select(bounded(F.col("source")).alias("source"), bounded(F.col("target")).alias("target"), F.col(column).cast("long").alias("own")).where("own > 1")
    ends = cut(ends)
    count = ends.count()
    shape = "source long, target long, own long"
    while count > max(one_task, 1):
        size = max(one_task // 4, 1)
        thin = cut(ends.coalesce(-(-count // size)).mapInArrow(_thinned(size), shape))
        left = thin.count()
        forget(ends)
        ends, halved, count = thin, 2 * left <= count, left
        if not halved:
            break
    if count <= one_task:
        return ends.coalesce(1).mapInArrow(_nested(num_levels), "level int, node long, component long")
    each = ends.select("source", "target", "own", F.explode(_levels(num_levels)).alias("level")).where("own > level")
    found = weak_components(each.select(*[at_level(F.col(c), F.col("level")).alias(c) for c in ("source", "target")]), one_task=one_task)
    (node, level), (component, _) = split_level(F.col("node")), split_level(F.col("component"))
    return found.select(level.alias("level"), node.alias("node"), component.alias("component"))


def residue_labels(edges: DataFrame, num_levels: int = 10, column: str = "promoted_level") -> DataFrame:
    """(level, node, component, label): label numbers a level's components from 1, in order of their least vertices.

    Labels are dense, so that they fit into ints whatever the vertices' ids.
    """
    parts = cut(residue_components(edges, num_levels, column))
    kinds = numbered(parts.select("level", "component").distinct(), [F.col("level").asc(), F.col("component").asc()])
    kinds = cut(kinds)
    first = kinds.groupBy("level").agg(F.min("place").alias("first"))
    ranked = kinds.join(F.broadcast(first), "level").select("level", "component", (F.col("place") - F.col("first") + 1).cast("int").alias("label"))  # a row a level
    return parts.join(ranked, ["level", "component"]).select("level", "node", "component", "label")


def component_members(edges: DataFrame, num_levels: int = 10, column: str = "promoted_level", size: int = 10_000) -> DataFrame:
    """(level, component, part, nodes): the vertices of each residue component in order, in lists of at most size, numbered from 0."""
    rows = numbered(residue_components(edges, num_levels, column), [F.col("level").asc(), F.col("component").asc(), F.col("node").asc()])
    rows = cut(rows)
    first = rows.groupBy("level", "component").agg(F.min("place").alias("first"))
    each = rows.join(first, ["level", "component"]).withColumn("part", F.floor((F.col("place") - F.col("first")) / size))
    return each.groupBy("level", "component", "part").agg(F.array_sort(F.collect_list("node")).alias("nodes"))


def skeleton_vertices(edges: DataFrame, num_levels: int = 10, column: str = "promoted_level") -> DataFrame:
    """(level, node): the ends of each level's skeleton edges, as a union of both ends rather than a join on either."""
    return _least_levels(edges, column).select(F.explode(F.filter(_levels(num_levels), lambda k: k >= F.col("least"))).alias("level"), "node")


def _gather(df: DataFrame, key: list[str], num_levels: int) -> DataFrame:
    """key and an array over levels of ``label``, null where a level has no row."""
    picked = [F.max(F.when(F.col("level") == k, F.col("label"))).cast("int") for k in range(1, num_levels + 1)]
    return df.groupBy(*key).agg(F.array(*picked).alias("component"))


def residue_arrays(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(node, component): an array over levels of the residue component's number + 1, null where the vertex has no residue edge."""
    return _gather(residue_labels(edges, num_levels).select("level", "node", (F.col("label") + 1).alias("label")), ["node"], num_levels)


def _least_levels(edges: DataFrame, column: str = "promoted_level") -> DataFrame:
    """(node, least): the level from which on a vertex lies on the skeleton."""
    return edges.select(F.explode(F.array("source", "target")).alias("node"), column).groupBy("node").agg(F.min(column).alias("least"))


def label(edges: DataFrame, vertices: DataFrame, num_levels: int = 10) -> tuple[DataFrame, DataFrame]:
    """edges and vertices with their component arrays.

    A residue edge's label is its component's number + 1, a skeleton edge's 1. A vertex has the label
    of its residue component unless it touches the skeleton of that level. An edge is joined once, to
    the array of its source.
    """
    parts = cut(residue_arrays(edges, num_levels))

    def labels(own: str) -> Column:
        """Labels of the levels below own."""
        return F.transform(_levels(num_levels), lambda k: F.when(F.col(own) > k, F.coalesce(F.get("component", k - 1), F.lit(1))).otherwise(1))

    new_edges = edges.drop("component").join(parts.withColumnRenamed("node", "source"), "source", "left").withColumn("component", labels("promoted_level"))
    of_vertices = parts.join(_least_levels(edges), "node").select(F.col("node").alias("id"), labels("least").alias("component"))
    new_vertices = vertices.drop("component").join(of_vertices, "id", "left").withColumn("component", F.coalesce("component", F.array_repeat(F.lit(1), num_levels)))
    return new_edges.select(*edges.columns, *[c for c in ("component",) if c not in edges.columns]), new_vertices.select(*vertices.columns, *[c for c in ("component",) if c not in vertices.columns])


def label_legacy(edges: DataFrame, vertices: DataFrame, num_levels: int = 10) -> tuple[DataFrame, DataFrame]:
    """The older labels: zeros where a level has no component, no + 1, and no reset on the skeleton."""
    parts = cut(residue_labels(edges, num_levels))
    each = edges.select("id", "source", "target", "promoted_level", F.explode(_levels(num_levels)).alias("level")).where(F.col("promoted_level") > F.col("level"))
    zeros = F.array_repeat(F.lit(0), num_levels)

    def gather(df: DataFrame, *key: str) -> DataFrame:
        picked = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("label"))), F.lit(0)).cast("int") for k in range(1, num_levels + 1)]
        return df.groupBy(*key).agg(F.array(*picked).alias("component"))

    of_edges = gather(each.join(parts.withColumnRenamed("node", "source"), ["level", "source"]), "id", "source", "target")
    of_vertices = gather(parts, "node").withColumnRenamed("node", "id")
    new_edges = edges.drop("component").join(of_edges, ["id", "source", "target"], "left").withColumn("component", F.coalesce("component", zeros))
    new_vertices = vertices.drop("component").join(of_vertices, "id", "left").withColumn("component", F.coalesce("component", zeros))
    return new_edges, new_vertices


def catalog(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(id, level, num_nodes, num_edges, num_border_nodes) of each residue component; border nodes also touch the skeleton.

    Edges are counted by their source before they meet the components.
    """
    parts = residue_components(edges, num_levels)
    sides = F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(True).alias("out")), F.struct(F.col("target").alias("node"), F.lit(False).alias("out")))).alias("x")
    above = [F.count_if(F.col("x.out") & (F.col("promoted_level") > k)) for k in range(1, num_levels + 1)]
    ends = edges.select("promoted_level", sides).groupBy("x.node").agg(F.min("promoted_level").alias("least"), F.array(*above).alias("above"))
    border, lines = F.count_if(F.col("least") <= F.col("level")), F.sum(F.get("above", F.col("level") - 1))
    found = parts.join(ends, "node").groupBy("component", "level").agg(F.count("*").cast("int").alias("num_nodes"), lines.cast("int").alias("num_edges"), border.cast("int").alias("num_border_nodes"))
    return found.withColumnRenamed("component", "id")


def border_nodes(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(level, node, component): vertices that lie on both a level's skeleton and its residue."""
    return residue_components(edges, num_levels).join(_least_levels(edges), "node").where("least <= level").select("level", "node", "component")
