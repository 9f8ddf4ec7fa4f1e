"""Invariants of a finished hierarchy, each a frame with ``ok``; ``require`` raises on the first that fails."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import STRONG_TASK_EDGES, strong_components, tarjan
from graphloom.operators.fixpoint import cut
from graphloom.operators.label import at_level, residue_arrays, split_level


class Broken(AssertionError):
    """An invariant does not hold."""


def _parts(level: pa.Table) -> pa.Table:
    """(level, n_scc) of one level's (source, target, level)."""
    found = [b.column(1) for b in tarjan(level.select(["source", "target"]).combine_chunks().to_batches())]
    return pa.table({"level": level.column("level").slice(0, 1), "n_scc": [sum(len(c.unique()) for c in found)]})


def skeleton_strongly_connected(edges: DataFrame, num_levels: int = 10, one_task: int = STRONG_TASK_EDGES) -> DataFrame:
    """(level, n_scc, ok): the skeleton of each level is one strong component; a level is a task's work where it can hold all edges, else all levels are solved in one pass."""
    each = edges.select("source", "target", "promoted_level", F.explode(F.sequence(F.lit(1), F.lit(num_levels))).alias("level")).where("promoted_level <= level")
    if edges.count() <= one_task:
        counted = each.select("source", "target", "level").groupBy("level").applyInArrow(_parts, "level int, n_scc long")
        return counted.withColumn("ok", F.col("n_scc") == 1)
    found = strong_components(each.select(*[at_level(F.col(c), F.col("level")).alias(c) for c in ("source", "target")]))
    counted = found.groupBy(split_level(F.col("component"))[1].alias("level")).agg(F.countDistinct("component").alias("n_scc"))
    return counted.withColumn("ok", F.col("n_scc") == 1)


def skeleton_comp_id(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(level, n_wrong, ok): no skeleton edge has a label other than 1; a missing label passes."""
    wrong = [F.count_if((F.col("promoted_level") <= k) & (F.get("component", F.lit(k - 1)) != 1)).alias(str(k)) for k in range(1, num_levels + 1)]
    return _by_level(edges.agg(*wrong), num_levels, "n_wrong").withColumn("ok", F.col("n_wrong") == 0)


def _by_level(one: DataFrame, num_levels: int, name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.col(str(k)).alias(name)) for k in range(1, num_levels + 1)])
    return one.select(F.explode(pairs).alias("x")).select("x.level", f"x.{name}")


def group_count(rows: DataFrame, num_levels: int = 10) -> DataFrame:
    """(level, n_rows, n_grouped, ok): the sizes of the groups of each level's label, a null one too, add up to all rows."""
    each = rows.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(num_levels - 1)), lambda i: F.get("component", i))).alias("at", "label"))
    groups = each.groupBy((F.col("at") + 1).alias("level"), "label").agg(F.count("*").alias("n")).groupBy("level").agg(F.sum("n").alias("n_grouped"))
    return groups.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_rows")))).select("level", "n_rows", "n_grouped", (F.col("n_rows") == F.col("n_grouped")).alias("ok"))


edge_count = group_count
vertex_count = group_count


def promoted_not_above(edges: DataFrame) -> DataFrame:
    """(n_wrong, ok): promotion only lowers a level."""
    return edges.agg(F.count_if(F.col("promoted_level") > F.col("level")).alias("n_wrong")).withColumn("ok", F.col("n_wrong") == 0)


def skeletons_nested(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(level, n_edges, ok): skeletons grow from level to level, up to all edges."""
    sizes = [F.count_if(F.col("promoted_level") <= k).alias(str(k)) for k in range(1, num_levels + 1)]
    one = edges.agg(*sizes, F.count("*").alias("all"))
    pairs = F.array(*[F.struct(F.lit(k).alias("level"), F.col(str(k)).alias("n_edges"), (F.col(str(k)) >= (F.col(str(k - 1)) if k > 1 else F.lit(0))).alias("ok")) for k in range(1, num_levels + 1)])
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def labels_match(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(level, n_wrong, ok): each residue edge has the label of its component as computed anew, with the ends swapped; levels without such edges have no row."""
    fresh = residue_arrays(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "promoted_level"), num_levels)
    both = edges.select("target", "component", "promoted_level").join(fresh.select(F.col("node").alias("target"), F.col("component").alias("fresh")), "target", "left")
    on = [F.col("promoted_level") > k for k in range(1, num_levels + 1)]
    wrong = [F.count_if(x & ~F.get("component", F.lit(k)).eqNullSafe(F.get("fresh", F.lit(k)))) for k, x in enumerate(on)]
    pairs = [F.struct(F.lit(k).alias("level"), F.count_if(x).alias("n"), w.alias("n_wrong")) for k, (x, w) in enumerate(zip(on, wrong, strict=True), 1)]
    each = both.agg(F.array(*pairs).alias("pairs")).select(F.explode("pairs").alias("x")).where("x.n > 0").select("x.level", "x.n_wrong")
    return each.withColumn("ok", F.col("n_wrong") == 0)


def routes_bounded(found: DataFrame, num_levels: int = 10) -> DataFrame:
    """(n_wrong, ok): no route is shorter than the exact one."""
    exact = found.where(F.col("level") == num_levels).select("source", "target", F.col("path_len").alias("exact"))
    return found.join(exact, ["source", "target"]).agg(F.count_if(F.col("path_len") < F.col("exact")).alias("n_wrong")).withColumn("ok", F.col("n_wrong") == 0)


def every_edge_has_level(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """(n_wrong, ok): each edge fell into a bucket."""
    return edges.agg(F.count_if(F.col("level").isNull() | ~F.col("level").between(1, num_levels)).alias("n_wrong")).withColumn("ok", F.col("n_wrong") == 0)


def require(*frames: DataFrame) -> None:
    for frame in frames:
        if bad := frame.where("not ok").take(5):
            raise Broken(str(bad))


def all_checks(edges: DataFrame, vertices: DataFrame, num_levels: int = 10) -> DataFrame:
    """(check, level, ok) of the four basic invariants."""
    edges, vertices = cut(edges), cut(vertices)
    named = {"skeleton_strongly_connected": skeleton_strongly_connected(edges, num_levels), "skeleton_comp_id": skeleton_comp_id(edges, num_levels), "edge_count": edge_count(edges, num_levels), "vertex_count": vertex_count(vertices, num_levels)}
    return reduce(DataFrame.union, [df.select(F.lit(n).alias("check"), "level", "ok") for n, df in named.items()])


