"""Exact edge betweenness over directed, weighted shortest paths: ordered pairs, neither halved nor normalised."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.csr import BROADCAST_EDGES, Graph, dependencies
from graphloom.operators.fixpoint import cut
from graphloom.operators.hubs import Hubs, edge_mass, twins
from graphloom.operators.paths import distances_by_joins

#: Sources that the join-based form handles at once.
SOURCE_BATCH = 1024


def sample_sources(vertices: DataFrame, seed: int = 0, n: int | None = None) -> DataFrame:
    """(id): a fixed pseudo-random sample, of the square root of all vertices unless n is given."""
    n = math.ceil(math.sqrt(vertices.count())) if n is None else n
    return vertices.select("id").orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n)


def edge_betweenness(edges: DataFrame, sources: DataFrame | None = None, broadcast_edges: int = BROADCAST_EDGES, parts: int | None = None) -> DataFrame:
    """(id, source, target, cost, betweenness) per row of edges with positive costs.

    ``parts`` says into how many tasks the sources are dealt, one for a sequential run. ``sources`` (id) limits the paths' starts and scales up by their share, as an estimate. Graphs of
    at most broadcast_edges edges go to all tasks as arrays, and sources are dealt out. Where all edges
    touch few vertices, twice as many edges may be, as only classes of like sources go to tasks. Larger
    graphs take joins over batches of sources.
    """
    edges = cut(edges.select("id", "source", "target", "cost"))
    count = edges.count()
    if count > 2 * broadcast_edges:
        return _by_joins(edges, sources)
    spark = edges.sparkSession
    g = Graph.collect(edges)
    starts = edges.select(F.col("source").alias("id")).distinct() if sources is None else sources.select("id").distinct()
    if (hubs := Hubs.of(g)) is not None:
        return _by_hubs(spark, g, hubs, None if sources is None else starts, parts)
    if count > broadcast_edges:
        return _by_joins(edges, sources)
    shared = spark.sparkContext.broadcast(g)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        lists, total = g.lists(), np.zeros(len(g.edge_id))
        for batch in batches:
            for v in batch.column(0).to_pylist():
                if (u := g.code(v)) >= 0:
                    dependencies(lists, len(g.ids), u, total)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "part"])

    sums = starts.repartition(parts, "id").mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("betweenness"))
    scale = 1.0
    if sources is not None:
        scale = len(g.ids) / max(1, starts.count())
    listed = _listed(spark, g, place=np.arange(len(g.edge_id)))
    return listed.join(sums, "place", "left").select("id", "source", "target", "cost", (F.coalesce("betweenness", F.lit(0.0)) * scale).alias("betweenness"))


def _listed(spark: SparkSession, g: Graph, **more: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"id": g.edge_id, "source": g.ids[g.tail], "target": g.ids[g.head], "cost": g.cost, **more}))


def _by_hubs(spark: SparkSession, g: Graph, hubs: Hubs, sources: DataFrame | None, parts: int | None) -> DataFrame:
    """Rows of like sources are dealt out; what comes back is a number for each row and hub and for each class of leaves and hub."""
    marks, scale = np.ones(len(g.ids), bool), 1.0
    if sources is not None:
        asked = sources.toArrow().column(0).to_numpy()
        marks, scale = np.isin(g.ids, asked), len(g.ids) / max(1, len(asked))
    kinds, of = twins(hubs, marks)
    shared = spark.sparkContext.broadcast(kinds)
    n, wide = len(kinds.own), len(hubs.hub)
    parts = min(max(1, n), parts or 2 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = np.arange(k, n, parts)
                sent, got = kinds.mass(rows)
                yield pa.RecordBatch.from_arrays([pa.array((rows[:, None] * wide + np.arange(wide)).reshape(-1)), pa.array(sent.reshape(-1))], names=["place", "part"])
                some = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(some + n * wide), pa.array(got.reshape(-1)[some])], names=["place", "part"])

    dealt = spark.range(0, parts, 1, parts)
    sums = dealt.mapInArrow(run, "place long, part double").groupBy("place").agg(F.sum("part").alias("part")).toArrow()
    flat = np.zeros(n * wide + kinds.back.size)
    flat[sums.column("place").to_numpy()] = sums.column("part").to_numpy()
    shared.destroy()
    total = edge_mass(g, hubs, kinds, of, marks, flat[: n * wide].reshape(n, wide), flat[n * wide :].reshape(kinds.back.shape))
    return _listed(spark, g, betweenness=total * scale)


def _by_joins(edges: DataFrame, sources: DataFrame | None) -> DataFrame:
    """The same sums by relaxation rounds: with s(v) the count of shortest paths to v and x(v) the sum, over the paths
    on from v, of 1 / s(end), an edge u-v of the shortest-path graph carries s(u) x(v)."""
    numbered = cut(edges.withColumn("place", F.monotonically_increasing_id()))
    starts = numbered.select(F.col("source").alias("id")).distinct() if sources is None else sources.select("id").distinct()
    n = starts.count()
    batches = max(1, -(-n // SOURCE_BATCH))
    total = None
    for k in range(batches):
        some = starts.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        dist = cut(distances_by_joins(numbered, some))
        a, b = dist.alias("a"), dist.alias("b")
        e = numbered.alias("e")
        dag = e.join(a, F.col("e.source") == F.col("a.node")).join(b, (F.col("e.target") == F.col("b.node")) & (F.col("a.start") == F.col("b.start")))
        dag = cut(dag.where(F.col("a.distance") + F.col("e.cost") == F.col("b.distance")).select(F.col("a.start").alias("start"), "place", F.col("e.source").alias("u"), F.col("e.target").alias("v")))
        paths = _path_sums(dag, dist.where("start = node").select("start", F.col("node"), F.lit(1.0).alias("w")), "u", "v")
        ends = _path_sums(dag, paths.select("start", "node", (1.0 / F.col("w")).alias("w")), "v", "u")
        carried = dag.join(paths.select("start", F.col("node").alias("u"), F.col("w").alias("s")), ["start", "u"]).join(ends.select("start", F.col("node").alias("v"), F.col("w").alias("x")), ["start", "v"])
        part = cut(carried.groupBy("place").agg(F.sum(F.col("s") * F.col("x")).alias("part")))
        total = part if total is None else cut(total.union(part).groupBy("place").agg(F.sum("part").alias("part")))
    scale = 1.0 if sources is None else numbered.select(F.explode(F.array("source", "target"))).distinct().count() / max(1, n)
    return numbered.join(total, "place", "left").select("id", "source", "target", "cost", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def _path_sums(dag: DataFrame, seeds: DataFrame, tail: str, head: str) -> DataFrame:
    """(start, node, w): the sum of seed weights over all paths that end in node, by one round for each hop."""
    front = total = cut(seeds)
    while True:
        front = cut(dag.join(front.withColumnRenamed("node", tail), ["start", tail]).groupBy("start", F.col(head).alias("node")).agg(F.sum("w").alias("w")))
        if front.isEmpty():
            return total
        total = cut(total.union(front).groupBy("start", "node").agg(F.sum("w").alias("w")))
