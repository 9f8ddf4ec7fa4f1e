"""Updates as joins: new values by key, first by any row of a key, and by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import numbered


def update_from(into: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """into with columns taken from the row of equal keys, where there is one; of several rows the least counts."""
    fresh = rows.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_new"))
    joined = into.join(fresh, list(keys), "left")
    take = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
    return joined.select(*[take(c) if c in columns else c for c in into.columns])


def load_results(edges: DataFrame, vertices: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges take betweenness, level, promoted_level and component from results by (id, source, target); vertices take component by source."""
    rows = results.withColumn("promoted_level", F.col("level"))
    new = update_from(edges, rows, ("id", "source", "target"), ("betweenness", "level", "promoted_level", "component"))
    return new, update_from(vertices, rows.withColumn("id", F.col("source")), ("id",), ("component",))


def in_components(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end in members (node, component), beside its component: an equi-join on each end rather than a test of membership in arrays."""
    ends = edges.withColumn("_end", F.explode(F.array_distinct(F.array("source", "target"))))
    return ends.join(members, ends["_end"] == members["node"]).drop("_end", "node").distinct()


def touching(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices that are an end of some edge."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return vertices.join(ends, "id", "left_semi")


def zip_pairs(starts: DataFrame, ends: DataFrame, order: Sequence[str]) -> DataFrame:
    """(place, source, target): the i-th of starts (id) with the i-th of ends (id), both in order."""
    keys = [F.col(c).asc() for c in order]
    left, right = (numbered(df, keys).select("place", F.col("id").alias(name)) for df, name in ((starts, "source"), (ends, "target")))
    return left.join(right, "place")
