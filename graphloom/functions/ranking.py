"""Orders, ranks and quantiles of a column.

Orders break ties by ``key``. No ordered window runs over a whole table: ranks by value first count
the values and number what is counted, and orders number the rows, both by range-partitioned sorts
whose partitions' sizes are added up. ``by`` makes groups of their own, also without a task for
each, as a group's places are the places over all groups less those before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.fixpoint import cut, numbered

#: Up to so many rows a quantile is found by one task's sort.
FEW = 1 << 20
METHODS = ("average", "min", "max", "ordinal")


def _order(value: str, descending: bool, by: Sequence[str]) -> list[Column]:
    return [F.col(b).asc() for b in by] + [F.col(value).desc() if descending else F.col(value).asc()]


def _match(df: DataFrame, other: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """df with columns of other, by keys whose nulls are equal; without keys other has one row."""
    renamed = other.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *columns)
    if not keys:
        return df.crossJoin(F.broadcast(renamed))
    return df.join(renamed, [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]).drop(*[f"_k{i}" for i in range(len(keys))])


def _below(df: DataFrame, value: str, descending: bool, by: Sequence[str]) -> DataFrame:
    """(by, value, _n, _below): how many rows have the value and how many of its group come before it."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = _order(value, descending, by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(counts.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part").agg(F.sum("_n").alias("_s")).select("_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))  # a row a partition
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = rows.withColumn("_in", inside).join(F.broadcast(bases), "_part").withColumn("_below", F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")
    if not by:
        return found
    found = cut(found)
    first = found.groupBy(*by).agg(F.min("_below").alias("_first"))
    return _match(found, first, by, "_first").withColumn("_below", F.col("_below") - F.col("_first")).drop("_first")


def ranked(df: DataFrame, value: str, key: str, method: str = "average", descending: bool = False, num: int | None = None, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """df with the rank from 1 of value: min, max or average place of its ties, or, for any other method, the place itself.

    With ``num``, rows beyond the first num get 0, and ties are cut there: average and max look at
    the tied rows among the first num alone. Ranks are doubles.
    """
    placed = num is not None or method not in ("average", "min", "max")
    if placed:
        df = cut(numbered(df, [*_order(value, descending, by), F.col(key).asc()], "_place"))
        if by:
            first = df.groupBy(*by).agg((F.min("_place") - 1).alias("_first"))
            df = _match(df, first, by, "_first").withColumn("_place", F.col("_place") - F.col("_first")).drop("_first")
    if method in ("average", "min", "max"):
        df = _match(df, _below(df, value, descending, by), [*by, value], "_n", "_below")
        low, high = F.col("_below"), F.col("_below") + F.col("_n")
        if num is not None:
            high = F.least(high, F.lit(num))
        rank = {"min": low + 1, "max": high, "average": (low + 1 + high) / 2}[method]
    else:
        rank = F.col("_place")
    rank = rank.cast("double")
    if num is not None:
        rank = F.when(F.col("_place") <= num, rank).otherwise(0.0)
    return df.withColumn(name, rank).drop("_n", "_below", "_place")


def ordered(df: DataFrame, value: str, key: str, descending: bool = False, by: Sequence[str] = (), name: str = "position") -> DataFrame:
    """df with each row's position from 0 in order of value, ties in order of key."""
    return ranked(df, value, key, "ordinal", descending, None, by, "_at").withColumn(name, (F.col("_at") - 1).cast("long")).drop("_at")


def first_in_order(df: DataFrame, value: str, key: str, num: int, descending: bool = False) -> DataFrame:
    """The first num rows in order, by a top-k of each partition; at most all rows."""
    return df.orderBy(F.col(value).desc() if descending else F.col(value).asc(), key).limit(num)


def quantiles(df: DataFrame, value: str, at: Sequence[float], by: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """(by, q): exact quantiles with linear interpolation at (n - 1) q as an array; q is cut to 0..1, an empty column gives zeros.

    Few values are sorted in one task. Of more, the values are counted and numbered by ranges, and
    the two values around each quantile's place are picked by their places.
    """
    at = [min(1.0, max(0.0, float(q))) for q in at]
    none = F.array(*[F.lit(0.0) for _ in at])
    if df.count() <= few:
        exact = F.coalesce(F.percentile(value, F.array(*[F.lit(q) for q in at])), none).alias("q")
        return df.groupBy(*by).agg(exact) if by else df.agg(exact)
    below = cut(_below(df.where(F.col(value).isNotNull()), value, False, by))
    totals = below.groupBy(*by).agg(F.sum("_n").alias("_total")) if by else below.agg(F.sum("_n").alias("_total"))
    placed = _match(below, totals, by, "_total")
    place = [(F.col("_total") - 1) * F.lit(q) for q in at]
    pick = lambda k: F.max(F.when((F.col("_below") <= k) & (k < F.col("_below") + F.col("_n")), F.col(value).cast("double")))
    bounds = [x for i, p in enumerate(place) for x in (pick(F.floor(p)).alias(f"_low{i}"), pick(F.ceil(p)).alias(f"_high{i}"))]
    found = placed.groupBy(*by, "_total").agg(*bounds)
    between = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (p - F.floor(p)) for i, p in enumerate(place)]
    return found.select(*by, F.array(*between).alias("q"))
