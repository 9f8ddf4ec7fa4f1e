"""Lineage cuts for iterative plans, distributed row numbers, and weak components by repeated contraction."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder of ``spark.checkpoint.dir``. Unset, a local session takes a folder of its machine, and a cluster raises."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Files of the checkpoints that each open ``scratch`` has seen.
_OPEN: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in the cluster's shared folder: later reads survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if _OPEN and (path := _file(out)):
        _OPEN[-1].append(path)
    return out


def _file(df: DataFrame) -> str | None:
    """Where a checkpoint lies; None for any other frame."""
    plan = df._jdf.queryExecution().logical()
    if plan.nodeName() != "LogicalRDD" and "LogicalRDD" not in plan.getClass().getName():
        return None
    found = plan.rdd().getCheckpointFile()
    return found.get() if found.isDefined() else None


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Removes the files of checkpoints that nothing reads any more; other frames are left alone."""
    for df in frames:
        if path := _file(df):
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the checkpoints that are made inside, once the block has written what it made of them."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, *_OPEN.pop())


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """df with each row's place from 1 in the order, by a range-partitioned sort: no task holds more than a range of rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)  # the id holds the partition above 33 bits of the row's place in it
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a partition
    placed = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return placed.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_base", "_at")


#: A graph that has shrunk to this many edges is finished by one task, in some 100 MB.
ONE_TASK_EDGES = 1 << 20


def unite(up: list[int], tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Joins the trees of each edge's ends, the lesser root on top; a mark on each edge that joined two."""

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    joined = np.zeros(len(tail), bool)
    for k, (a, b) in enumerate(zip(tail.tolist(), head.tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            joined[k] = True
    return joined


def roots(up: list[int]) -> np.ndarray:
    """The root of each node."""
    found = np.array(up, np.int64)
    while (found[found] != found).any():
        found = found[found]
    return found


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) to (node, component), the least node of its component."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(side) for side in zip(*parts, strict=True)])
    nodes, code = np.unique(ends, return_inverse=True)
    up = list(range(len(nodes)))
    half = len(code) // 2
    unite(up, code[:half], code[half:])
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(up)])], names=["node", "component"])


def weak_components(edges: DataFrame, source: str = "source", target: str = "target", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, component) for every end of an edge; component is the least node of the component.

    While more than ``one_task`` edges are left, each round gives every node the neighbour (or itself) of least random priority and contracts the
    edges to these labels, so that the edges shrink by a constant factor and paths take logarithmically
    many rounds. Nodes of any degree are safe: minima combine before the shuffle, and joins on a hub are
    split by the adaptive planner. Null ends are dropped; loops only make their node appear. At most
    ``one_task`` edges from the start are one bounded task's work, without a shuffle.
    """
    ends = edges.select(F.col(source).cast("long").alias("u"), F.col(target).cast("long").alias("v")).where("u is not null and v is not null")
    ends = cut(ends)
    if ends.count() <= one_task:
        return ends.coalesce(1).mapInArrow(_forest, "node long, component long")
    labels = cut(ends.select("u").union(ends.select("v")).distinct().select(F.col("u").alias("node"), F.col("u").alias("label")))
    live = cut(ends.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    turn = 0
    while live.count() > one_task:
        turn += 1
        priority = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("p"), c.alias("id"))  # noqa: B023, E731
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(priority(F.col("v"))).alias("m"))
        best = cut(best.select(F.col("u").alias("at"), F.least(F.col("m"), priority(F.col("u")))["id"].alias("to")))
        old, first_hop = (labels, live), best
        hop = best.alias("a").join(best.alias("b"), F.col("a.to") == F.col("b.at"), "left").select(F.col("a.at").alias("at"), F.coalesce("b.to", "a.to").alias("to"))
        best = cut(hop)
        moved = labels.join(best, labels["label"] == best["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = cut(moved)
        first = live.join(best, live["u"] == best["at"]).select(F.col("to").alias("u"), "v")
        both_moved = first.join(best, first["v"] == best["at"]).select("u", F.col("to").alias("v"))
        live = cut(both_moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        forget(*old, first_hop, best)
    last = cut(live.coalesce(1).mapInArrow(_forest, "node long, component long").toDF("at", "to"))
    labels = labels.join(last, labels["label"] == last["at"], "left").select("node", F.coalesce("to", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
