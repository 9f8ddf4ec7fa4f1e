"""Every registered query of the engine, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import arrays
from graphloom.functions.ranking import first_in_order, ordered, quantiles, ranked
from graphloom.operators import checks
from graphloom.operators.betweenness import edge_betweenness, sample_sources
from graphloom.operators.components import component_sizes, largest_component, strong_components
from graphloom.operators.fixpoint import cut, numbered, remove, shared_folder, weak_components
from graphloom.operators.label import at_level, border_nodes, catalog, component_members, label, label_legacy, residue_components, skeleton_vertices, split_level
from graphloom.operators.levels import with_levels
from graphloom.operators.paths import distances, path_edges
from graphloom.operators.preprocess import clean, directed_edges
from graphloom.operators.promote import connections, promote, promotion_summary
from graphloom.operators.routing import random_pairs, route_quality, routes
from graphloom.operators.update import in_components, load_results, touching, update_from, zip_pairs
from graphloom.plans import oracles
from graphloom.plans.hierarchy import Hierarchy, build_hierarchy
from graphloom.plans.networks import HOME, NATION_BASE, network, streets, trade
from graphloom.sources.edge_files import adjacency_text, directed, loaded_vertices, parse_edge_lines, print_results, read_results, write_results
from graphloom.sources.tables import drop_temporary, insert, jdbc, replace, scan, temporary

LEVELS = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _plain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed_edges(trade(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_betweenness(_plain_edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(with_levels(cut(_scored(spark, sf_dir)), LEVELS))


def _hierarchy(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return build_hierarchy(trade(spark, sf_dir), LEVELS, verify=False)


# Scans, projections, sources and sinks


@query
def ways_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item's street, in the schema of streets; geometry stays empty."""
    return schema.conform(streets(spark, sf_dir), schema.WAYS).select("gid", "source", "target", "cost", "reverse_cost")


@query
def trade_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade(spark, sf_dir)


@query
def directed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directed_edges(streets(spark, sf_dir))


@query
def vertex_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_vertices(streets(spark, sf_dir))


@query
def adjacency_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With fractional costs, as the dump writes six digits."""
    return adjacency_text(_plain_edges(spark, sf_dir).withColumn("cost", F.col("cost") / 8))


@query
def edge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges with a dense index from 0, in order of id and ends."""
    return numbered(directed_edges(streets(spark, sf_dir)), [F.col(c) for c in ("id", "source", "target")]).select("id", "source", "target", (F.col("place") - 1).alias("idx"))


@query
def vertex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vertex with its dense code."""
    return numbered(loaded_vertices(streets(spark, sf_dir)), [F.col("id")]).select("id", (F.col("place") - 1).alias("idx"))


@query
def csv_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as lines of four or five fields, by the reader's rules, as directed edges."""
    lines = streets(spark, sf_dir).select(F.concat_ws(",", "gid", "source", "target", "cost", F.when(F.col("reverse_cost") >= 0, F.col("reverse_cost"))).alias("value"))
    return directed(parse_edge_lines(lines))


@query
def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as lines of every odd shape: blank, too short, too long, with a trailing separator, with numbers that end in letters or are none, a header, with CRLF."""
    five = ("gid", "source", "target", "cost", "reverse_cost")
    join = lambda *parts: F.concat_ws(",", *parts)
    shapes = [F.lit(""), join(*five[:3]), join(*five, F.lit("7")), join(*five[:4], F.lit("")), join(*five[:3], F.lit("12abc")), join(*five[:3], F.lit("abc")), F.lit("id,source,target,cost"), F.concat(join(*five), F.lit("\r")), join(*five)]
    line = F.element_at(F.array(*shapes), F.pmod("gid", F.lit(len(shapes))).cast("int") + 1)
    return directed(parse_edge_lines(streets(spark, sf_dir).select(line.alias("value"))))


def _path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/results-{uuid.uuid4().hex}"


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file written to the shared folder and read again."""
    edges = _plain_edges(spark, sf_dir).withColumns({"betweenness": F.col("cost") / 8, "level": F.lit(3)})
    path = _path(spark)
    write_results(edges, path, LEVELS)
    out = cut(read_results(spark, path).withColumn("component", F.array_join("component", ",")))
    remove(spark, path)
    return out


@query
def six_digit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file with six significant digits, read again."""
    path = _path(spark)
    write_results(_plain_edges(spark, sf_dir).withColumns({"betweenness": F.col("cost") / 7, "level": F.lit(3)}), path, LEVELS, digits=6)
    out = cut(read_results(spark, path).select("id", "source", "target", "betweenness"))
    remove(spark, path)
    return out


@query
def printed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return print_results(_plain_edges(spark, sf_dir).withColumn("betweenness", reduce(Column.__mul__, [F.col("cost")] * 5) / 7))


@query
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table that is written and then replaced."""
    path = _path(spark)
    edges = _plain_edges(spark, sf_dir).withColumn("part", F.pmod("source", F.lit(4)).cast("int"))
    replace(edges, path, "part")
    replace(edges.where("cost >= 12"), path, "part")
    out = cut(spark.read.parquet(path).select("id", "source", "target", "cost", "part"))
    remove(spark, path)
    return out


@query
def suppliers_by_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through an embedded database, which lies in the memory of one JVM: for local sessions."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    rows = scan(spark, sf_dir, "supplier").select((F.col("s_suppkey").cast("long") + 1).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    rows.write.format("jdbc").options(url=url, dbtable="suppliers").save()
    return cut(jdbc(spark, url, "suppliers").toDF("id", "name", "nation"))


@query
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices of both networks, inserted by name one after the other, through a temporary view."""
    first = schema.conform(loaded_vertices(trade(spark, sf_dir)), schema.VERTICES)
    temporary(insert(first, loaded_vertices(streets(spark, sf_dir))), "all_vertices")
    out = spark.sql("SELECT id, count(*) AS n, max(size(component)) AS longest FROM all_vertices GROUP BY id")
    out = out.select("id", "n", F.coalesce("longest", F.lit(0)).alias("longest"))
    drop_temporary(spark, "all_vertices")
    return out


# Joins


@query
def semi_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges both of whose ends also start an edge."""
    edges = directed_edges(streets(spark, sf_dir))
    starts = edges.select("source").distinct()
    return edges.join(starts, "source", "left_semi").join(starts.withColumnRenamed("source", "target"), "target", "left_semi").select("id", "source", "target", "cost")


@query
def updated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that take their cost, by id, from the cheaper direction of their street."""
    edges = directed_edges(streets(spark, sf_dir))
    return update_from(edges, edges.select("id", "cost"), ("id",), ("cost",))


@query
def loaded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness, level and component of a load table, taken into edges by three keys."""
    edges = schema.conform(_plain_edges(spark, sf_dir), schema.EDGES)
    vertices = schema.conform(edges.select(F.col("source").alias("id")).distinct(), schema.VERTICES)
    results = edges.where("cost >= 12").select("id", "source", "target", (F.col("cost") * 2).alias("betweenness"), F.lit(4).alias("level"), F.array_repeat(F.lit(1), LEVELS).alias("component"))
    new, _ = load_results(edges, vertices, results)
    return new.select("id", "source", "target", "betweenness", "level", "promoted_level", F.size("component").alias("n_component"))


@query
def vertex_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices' side of a load table: many rows a vertex, of which the least counts."""
    edges = schema.conform(_plain_edges(spark, sf_dir), schema.EDGES)
    vertices = schema.conform(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), schema.VERTICES)
    component = F.array(F.col("cost").cast("int"), F.col("cost").cast("int") + 1)
    results = edges.where("cost >= 12").select("id", "source", "target", F.lit(1.0).alias("betweenness"), F.lit(4).alias("level"), component.alias("component"))
    return load_results(edges, vertices, results)[1].select("id", F.array_join("component", ",").alias("component"))


def _drawn_streets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and vertices of the cleaned streets, cleaned with geometry on both; every third vertex has none."""
    ways = streets(spark, sf_dir).withColumn("the_geom", F.concat(F.lit("line "), "gid").cast("binary"))
    ends = loaded_vertices(ways).withColumn("the_geom", F.when(F.pmod("id", F.lit(3)) != 0, F.concat(F.lit("point "), "id")).cast("binary"))
    return clean(ways, ends)


@query
def geometry_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_streets(spark, sf_dir)[0].select("id", "source", "target", F.col("the_geom").cast("string").alias("geom"))


@query
def geometry_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn_streets(spark, sf_dir)[1].select("id", F.col("the_geom").cast("string").alias("geom"))


@query
def touched_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices on either end of a cheap edge: a disjunctive join as a semi-join on the union of ends."""
    edges = directed_edges(streets(spark, sf_dir))
    return touching(edges.select(F.explode(F.array("source", "target")).alias("id")).distinct(), edges.where("cost <= 2"))


@query
def member_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the region of their nation, as members of components on either end."""
    edges = _plain_edges(spark, sf_dir).select("id", "source", "target")
    nations = scan(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 1_000_001).alias("node"), F.col("n_regionkey").alias("component"))
    return in_components(edges, nations)


@query
def zipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th supplier with the i-th nation."""
    suppliers = scan(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("id"))
    nations = scan(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 1_000_001).alias("id"))
    return zip_pairs(suppliers, nations, ("id",)).select(F.col("place").cast("long").alias("place"), "source", "target")


# Arrays


@query
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of each source as a list: positions from 1, out of range as null, replaced, filled and spelt."""
    lists = _plain_edges(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("t"))
    spelt = F.concat(F.lit("{"), F.array_join("t", ", "), F.lit("}"))
    return lists.select(
        "source",
        F.size("t").cast("long").alias("n"),
        arrays.at("t", 2).alias("second"),
        F.array_join(arrays.put("t", 1, F.lit(0).cast("long")), ",").alias("replaced"),
        F.array_join(arrays.filled(0, 3), ",").alias("zeros"),
        arrays.brackets(spelt).alias("spelt"),
        F.size(arrays.long_list(spelt)).cast("long").alias("parsed"),
    )


# Ranks, orders and quantiles


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("long").alias("v"))


def _rank_query(method: str, descending: bool, num: int | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ranked(_orders(spark, sf_dir), "v", "o_orderkey", method, descending, num)


for _method in ("average", "min", "max", "ordinal"):
    QUERIES[f"rank_{_method}"] = _rank_query(_method, False, None)
    QUERIES[f"rankhigh_{_method}"] = _rank_query(_method, True, None)
    QUERIES[f"partial_rank_{_method}"] = _rank_query(_method, False, oracles.PARTIAL)
    QUERIES[f"partial_rankhigh_{_method}"] = _rank_query(_method, True, oracles.PARTIAL)


@query
def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(_orders(spark, sf_dir), "v", "o_orderkey")


@query
def orderhigh_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(_orders(spark, sf_dir), "v", "o_orderkey", descending=True)


@query
def order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_in_order(_orders(spark, sf_dir), "v", "o_orderkey", oracles.PARTIAL)


@query
def orderhigh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_in_order(_orders(spark, sf_dir), "v", "o_orderkey", oracles.PARTIAL, descending=True)


@query
def quantile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scan(spark, sf_dir, "lineitem")
    ends = items.groupBy("l_returnflag").agg(F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    q = quantiles(items, "l_quantity", oracles.QUANTILES, ("l_returnflag",)).join(F.broadcast(ends), "l_returnflag")  # three flags
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(len(oracles.QUANTILES))], "least", "most")


# Components


@query
def scc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strong_components(_plain_edges(spark, sf_dir).select("source", "target"))


@query
def skeleton_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of every level's skeleton before promotion, all in one pass."""
    each = _levelled(spark, sf_dir).select("source", "target", F.explode(F.sequence(F.col("level"), F.lit(LEVELS))).alias("level"))
    found = strong_components(each.select(*[at_level(F.col(c), F.col("level")).alias(c) for c in ("source", "target")]))
    (node, level), (component, _) = split_level(F.col("node")), split_level(F.col("component"))
    return found.select(level.alias("level"), node.alias("node"), component.alias("component"))


@query
def largest_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_component(strong_components(directed_edges(streets(spark, sf_dir)).select("source", "target")))


@query
def cleaned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: directed edges of the largest strong component of all streets."""
    return clean(streets(spark, sf_dir))[0].select("id", "source", "target", "cost", "level", "promoted_level")


@query
def cleaned_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(streets(spark, sf_dir))[1].select("id", F.size("component").alias("n_component"))


@query
def wcc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_components(directed_edges(streets(spark, sf_dir)))


@query
def wcc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_sizes(weak_components(directed_edges(streets(spark, sf_dir))))


# Paths, betweenness, levels


@query
def all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every nation to all vertices."""
    edges = _plain_edges(spark, sf_dir)
    return distances(edges, edges.select(F.col("source").alias("id")).distinct().where(F.col("id") > NATION_BASE))


@query
def sssp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From supplier 1 to every street's end."""
    return distances(directed_edges(streets(spark, sf_dir)), spark.createDataFrame([(1,)], "id long"))


@query
def path_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest path between each supplier and its nation, both ways, edge by edge, summed up; its edges follow one another."""
    edges = cut(_plain_edges(spark, sf_dir))
    asked = network(spark, sf_dir, HOME).groupBy("source").agg(F.collect_set("target").alias("targets"))
    asked = asked.repartition(spark.sparkContext.defaultParallelism, "source")
    found = path_edges(edges, asked)
    linked = F.array_sort(F.collect_list(F.struct("seq", "source", "target")))
    steps = found.groupBy("start", "end").agg(F.sum("cost").alias("distance"), F.count("*").alias("hops"), linked.alias("p"))
    sound = (F.col("p")[0]["source"] == F.col("start")) & (F.element_at("p", -1)["target"] == F.col("end")) & F.forall(F.sequence(F.lit(1), F.col("hops").cast("int")), lambda i: (i == 1) | (F.get("p", i - 1)["source"] == F.get("p", i - 2)["target"]))
    return steps.select("start", "end", "distance", F.coalesce(sound, F.lit(False)).alias("sound"))


@query
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


@query
def betweenness_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in one task."""
    return edge_betweenness(_plain_edges(spark, sf_dir), parts=1).withColumn("betweenness", F.round("betweenness", 6))


@query
def betweenness_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate from a square root of all vertices; a sampling operator."""
    edges = cut(_plain_edges(spark, sf_dir))
    vertices = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return edge_betweenness(edges, sample_sources(vertices)).withColumn("betweenness", F.round("betweenness", 6))


@query
def edge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levelled(spark, sf_dir).select("id", "source", "target", "betweenness", "level")


@query
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levelled(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


# Promotion, labels, routes, checks


@query
def connections_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connections(_levelled(spark, sf_dir), 1).select("source", F.array_join("targets", ",").alias("targets"))


@query
def promoted_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promote(_levelled(spark, sf_dir), LEVELS).select("id", "source", "target", "level", "promoted_level")


@query
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotion_summary(promote(_levelled(spark, sf_dir), LEVELS))


@query
def residue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components above each level, before promotion."""
    return residue_components(_levelled(spark, sf_dir), LEVELS, "level")


@query
def skeleton_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skeleton_vertices(_levelled(spark, sf_dir), LEVELS, "level")


@query
def component_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex labels at each level, before promotion."""
    edges = _levelled(spark, sf_dir)
    vertices = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return label(edges, vertices, LEVELS)[1].select("id", F.array_join("component", ",").alias("component"))


@query
def edge_component_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _levelled(spark, sf_dir)
    vertices = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return label(edges, vertices, LEVELS)[0].select("id", "source", "target", F.array_join("component", ",").alias("component"))


@query
def legacy_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _levelled(spark, sf_dir)
    vertices = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return label_legacy(edges.withColumn("component", F.array().cast("array<int>")), vertices.withColumn("component", F.array().cast("array<int>")), LEVELS)[1].select("id", F.array_join("component", ",").alias("component"))


@query
def component_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(_levelled(spark, sf_dir), LEVELS)


@query
def component_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices of each component above each level, in lists of 50."""
    found = component_members(_levelled(spark, sf_dir), LEVELS, "level", size=50)
    return found.select("level", "component", "part", F.array_join("nodes", ",").alias("nodes"))


@query
def boundary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return border_nodes(_levelled(spark, sf_dir), LEVELS)


@query
def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build, from streets to labels."""
    built = _hierarchy(spark, sf_dir)
    return built.edges.select("id", "source", "target", "cost", F.round("betweenness", 6).alias("betweenness"), "level", "promoted_level", F.array_join("component", ",").alias("component"))


@query
def hierarchy_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir).vertices.select("id", F.array_join("component", ",").alias("component"))


@query
def hierarchy_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of the finished hierarchy."""
    return catalog(_hierarchy(spark, sf_dir).edges, LEVELS)


@query
def build_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a verified build says, in order."""
    said = build_hierarchy(trade(spark, sf_dir), LEVELS).notices
    return spark.createDataFrame(list(enumerate(said, 1)), "place long, stage string")


@query
def assert_scc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.skeleton_strongly_connected(_hierarchy(spark, sf_dir).edges, LEVELS)


@query
def assert_comp_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.skeleton_comp_id(_hierarchy(spark, sf_dir).edges, LEVELS)


@query
def assert_edge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.edge_count(_hierarchy(spark, sf_dir).edges, LEVELS)


@query
def assert_vertex_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.vertex_count(_hierarchy(spark, sf_dir).vertices, LEVELS)


@query
def assert_promoted_not_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.promoted_not_above(_hierarchy(spark, sf_dir).edges)


@query
def assert_skeletons_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.skeletons_nested(_hierarchy(spark, sf_dir).edges, LEVELS).select("level", "ok")


@query
def assert_labels_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.labels_match(_hierarchy(spark, sf_dir).edges, LEVELS).agg(F.sum("n_wrong").alias("n_wrong"), F.bool_and("ok").alias("ok"))


@query
def assert_levels_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.every_edge_has_level(_levelled(spark, sf_dir), LEVELS)


@query
def assert_routes_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _hierarchy(spark, sf_dir)
    return checks.routes_bounded(routes(built.edges, built.vertices, random_pairs(built.vertices, 20, seed=2), list(range(1, LEVELS + 1)), LEVELS), LEVELS)


@query
def full_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The i-th supplier to the i-th nation on the whole graph: the branch of the benchmark for the last level."""
    built = _hierarchy(spark, sf_dir)
    found = routes(built.edges, built.vertices, zipped_pairs(spark, sf_dir).select("source", "target"), [LEVELS], LEVELS)
    return found.select("source", "target", "path_len")


@query
def betweenness_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over edges equals the sum, over reachable pairs, of the mean hops of their shortest paths."""
    return edge_betweenness(_plain_edges(spark, sf_dir)).agg(F.round(F.sum("betweenness"), 4).alias("total"))


@query
def hier_route_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of randomly drawn pairs at every level; a sampling operator."""
    built = _hierarchy(spark, sf_dir)
    pairs = random_pairs(built.vertices, 20, seed=1)
    return routes(built.edges, built.vertices, pairs, list(range(1, LEVELS + 1)), LEVELS).drop("graph_build_time", "avg_computation_time")


@query
def route_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both times of each route, searched three times, were taken."""
    built = _hierarchy(spark, sf_dir)
    found = routes(built.edges, built.vertices, random_pairs(built.vertices, 20, seed=1), [LEVELS], LEVELS, iterations=3)
    return found.select("source", "target", "level", ((F.col("graph_build_time") >= 0) & (F.col("avg_computation_time") >= 0)).alias("timed"))


@query
def hier_route_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _hierarchy(spark, sf_dir)
    return route_quality(cut(routes(built.edges, built.vertices, random_pairs(built.vertices, 20, seed=1), list(range(1, LEVELS + 1)), LEVELS)), LEVELS)


ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
