"""From streets to the directed edges of the largest strong component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators.components import largest_component, strong_components
from graphloom.operators.fixpoint import cut

_PAYLOAD = ("x1", "y1", "x2", "y2", "the_geom")


def directed_edges(ways: DataFrame) -> DataFrame:
    """One row for each open direction of a street, both with the street's id; a direction is open if its cost is positive.

    Coordinates and geometry stay those of the street.
    """
    kept = [c for c in _PAYLOAD if c in ways.columns]
    forward, backward = (F.struct(F.col(s).alias("source"), F.col(t).alias("target"), F.col(c).alias("cost")) for s, t, c in (("source", "target", "cost"), ("target", "source", "reverse_cost")))
    both = ways.select(F.col("gid").alias("id"), F.explode(F.array(forward, backward)).alias("e"), *kept)
    return both.where(F.col("e.cost") > 0).select("id", "e.source", "e.target", "e.cost", *kept)


def street_components(ways: DataFrame) -> DataFrame:
    """Strong components of streets, where a direction is open unless its cost is negative."""
    forward = ways.where("cost >= 0").select("source", "target")
    backward = ways.where("reverse_cost >= 0").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return strong_components(forward.union(backward))


def clean(ways: DataFrame, way_vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of the largest strong component, in the schemas of these tables."""
    kept = cut(largest_component(street_components(ways)))
    edges = directed_edges(ways)
    for end in ("source", "target"):
        edges = edges.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    vertices = kept if way_vertices is None else kept.join(way_vertices.select("id", "the_geom"), "id", "left")
    return schema.conform(edges, schema.EDGES), schema.conform(vertices, schema.VERTICES)
