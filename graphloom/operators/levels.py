"""Percentile levels: 1 holds the largest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.ranking import FEW, quantiles

EPSILON = 1e-10


def caps(values: DataFrame, num_levels: int = 10, column: str = "betweenness", few: int = FEW) -> DataFrame:
    """One row: the num_levels + 1 bounds in falling order, the first raised and the last lowered by 1.

    Level k lies between bound k and bound k + 1. num_levels must divide 100, as the bounds stand at
    whole percents and must reach the largest value.
    """
    if num_levels < 1 or 100 % num_levels:
        raise ValueError("num_levels must divide 100")
    step = 100 // num_levels
    at = quantiles(values, column, [i * step / 100 for i in range(num_levels, -1, -1)], few=few)
    moved = F.transform("q", lambda x, i: x + F.when(i == 0, 1.0).when(i == num_levels, -1.0).otherwise(0.0))
    return at.select(moved.alias("caps"))


def level_of(value: Column, bounds: Column, num_levels: int) -> Column:
    """The first level whose interval holds the value, open below and closed above, each bound raised by EPSILON."""
    out = F.lit(None).cast("int")
    for k in range(num_levels - 1, -1, -1):
        inside = (value - F.get(bounds, F.lit(k + 1)) > EPSILON) & (value - F.get(bounds, F.lit(k)) <= EPSILON)
        out = F.when(inside, k + 1).otherwise(out)
    return out


def with_levels(edges: DataFrame, num_levels: int = 10) -> DataFrame:
    """edges with ``level`` by betweenness, and ``promoted_level`` that starts as the level."""
    bounds = F.broadcast(caps(edges, num_levels))  # one row
    out = edges.drop("level", "promoted_level").crossJoin(bounds)
    return out.withColumn("level", level_of(F.col("betweenness"), F.col("caps"), num_levels)).withColumn("promoted_level", F.col("level")).drop("caps")
