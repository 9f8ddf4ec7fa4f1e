"""Schemas of the road tables, the load table and the results; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _D, _A, _B = T.LongType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.IntegerType()), T.BinaryType()


def _schema(required: tuple[str, ...] = (), **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


#: One row is one street with up to two directions; a negative cost closes a direction. Geometry is opaque WKB.
WAYS = _schema(("gid", "source", "target"), gid=_L, source=_L, target=_L, cost=_D, reverse_cost=_D, x1=_D, y1=_D, x2=_D, y2=_D, the_geom=_B)
WAY_VERTICES = _schema(("id",), id=_L, the_geom=_B)
EDGES = _schema(("id", "source", "target"), id=_L, source=_L, target=_L, cost=_D, x1=_D, y1=_D, x2=_D, y2=_D, betweenness=_D, level=_I, promoted_level=_I, component=_A, the_geom=_B)
VERTICES = _schema(("id",), id=_L, component=_A, the_geom=_B)
COMPONENTS = _schema(id=_L, level=_I, num_nodes=_I, num_edges=_I, num_border_nodes=_I)
RESULTS = _schema(id=_L, source=_L, target=_L, betweenness=_D, level=_I, component=_A)
CONNECTIONS = _schema(source=_L, targets=T.ArrayType(_L))
PERFORMANCE = _schema(source=_L, target=_L, level=_I, num_edges=_I, num_vertices=_I, graph_build_time=_D, avg_computation_time=_D, path_len=_D)

#: What a column holds where an insert leaves it out.
DEFAULTS = {"betweenness": 0.0, "level": 10, "promoted_level": 10}


class DuplicateKey(ValueError):
    """A primary key repeats or is null."""


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """df in the schema's columns and types: absent columns get their default, an empty array or null."""
    defaults = DEFAULTS | (defaults or {})

    def column(f: T.StructField):
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType)
        if f.name in defaults:
            return F.lit(defaults[f.name]).cast(f.dataType)
        return F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit(None).cast(f.dataType)

    return df.select(*[column(f).alias(f.name) for f in schema])


def check_key(df: DataFrame, *keys: str) -> DataFrame:
    """df itself, once its key has been found unique and not null."""
    if not df.groupBy(*keys).agg(F.count("*").alias("n")).where(" OR ".join(["n > 1", *(f"{k} IS NULL" for k in keys)])).isEmpty():
        raise DuplicateKey(f"{keys} is not a key")
    return df
