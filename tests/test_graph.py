import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.ranking import quantiles
from graphloom.operators import betweenness as betweenness_module
from graphloom.operators import label as label_module
from graphloom.operators import promote as promote_module
from graphloom.operators import checks, components, hubs, routing
from graphloom.operators.betweenness import edge_betweenness, sample_sources
from graphloom.operators.components import largest_component, strong_components
from graphloom.operators.csr import Graph, dependencies, shortest_tree, strong_labels
from graphloom.operators.fixpoint import cut, forget, numbered, scratch, shared_folder, weak_components
from graphloom.operators.label import border_nodes, catalog, component_members, label, label_legacy, residue_components
from graphloom.operators.levels import caps, with_levels
from graphloom.operators.paths import distances, path_edges
from graphloom.operators.preprocess import clean, directed_edges
from graphloom.operators.promote import connections, promote, promote_level, promotion_summary
from graphloom.operators.routing import random_pairs, route_quality, routes
from graphloom.operators.update import load_results, zip_pairs
from graphloom.plans import networks
from graphloom.plans.hierarchy import build_hierarchy, ranked_edges
from tests import model

STREETS = [(1, 1, 2, 1, 1), (2, 2, 3, 1, 1), (3, 3, 4, 2, 2), (4, 4, 1, 2, -1), (5, 4, 5, 1, 1), (6, 5, 6, 1, -1), (7, 6, 4, 3, -1), (8, 6, 7, 1, -1), (9, 8, 9, 1, 1), (10, 2, 4, 0, -1)]
WAYS = "gid long, source long, target long, cost double, reverse_cost double"

#: (id, source, target): betweenness, level, promoted_level, component, worked out by hand.
GOLDEN = {
    (1, 1, 2): (6.5, 2, 2, [2, 1, 1, 1, 1]),
    (1, 2, 1): (2.0, 5, 2, [2, 1, 1, 1, 1]),
    (2, 2, 3): (8.0, 2, 2, [2, 1, 1, 1, 1]),
    (2, 3, 2): (3.5, 5, 2, [2, 1, 1, 1, 1]),
    (3, 3, 4): (9.0, 1, 1, [1, 1, 1, 1, 1]),
    (3, 4, 3): (4.5, 4, 1, [1, 1, 1, 1, 1]),
    (4, 4, 1): (4.5, 4, 4, [2, 2, 2, 1, 1]),
    (5, 4, 5): (9.0, 1, 1, [1, 1, 1, 1, 1]),
    (5, 5, 4): (4.0, 5, 1, [1, 1, 1, 1, 1]),
    (6, 5, 6): (5.0, 3, 3, [2, 2, 1, 1, 1]),
    (7, 6, 4): (5.0, 3, 3, [2, 2, 1, 1, 1]),
}


def ways_of(spark, rows):
    return spark.createDataFrame([(i, s, t, float(c), float(r)) for i, s, t, c, r in rows], WAYS)


def edges_of(spark, rows):
    return spark.createDataFrame([(i, s, t, float(c)) for i, s, t, c in rows], "id long, source long, target long, cost double")


@pytest.fixture(scope="module")
def built(spark):
    return build_hierarchy(ways_of(spark, STREETS), 5)


def test_hierarchy_matches_the_worked_example(built):
    got = {(r.id, r.source, r.target): (r.betweenness, r.level, r.promoted_level, list(r.component)) for r in built.edges.collect()}
    assert got == GOLDEN
    labels = {r.id: list(r.component) for r in built.vertices.collect()}
    ones = [1, 1, 1, 1, 1]
    assert labels == {1: [2, 1, 1, 1, 1], 2: [2, 1, 1, 1, 1], 3: ones, 4: ones, 5: ones, 6: [2, 2, 1, 1, 1]}


def test_tables_have_their_schemas(built):
    assert built.edges.schema.simpleString() == schema.EDGES.simpleString()
    assert built.vertices.schema.simpleString() == schema.VERTICES.simpleString()


def test_invariants(built):
    frames = [checks.all_checks(built.edges, built.vertices, 5), checks.promoted_not_above(built.edges), checks.skeletons_nested(built.edges, 5), checks.labels_match(built.edges, 5), checks.every_edge_has_level(built.edges, 5)]
    checks.require(*frames)
    broken = built.edges.withColumn("component", F.array_repeat(F.lit(3), 5))
    with pytest.raises(checks.Broken):
        checks.require(checks.skeleton_comp_id(broken, 5))
    with pytest.raises(checks.Broken):
        checks.require(checks.labels_match(broken, 5))


def test_missing_labels_pass_the_label_check(built):
    assert checks.skeleton_comp_id(built.edges.withColumn("component", F.array().cast("array<int>")), 5).where("not ok").isEmpty()


@pytest.mark.parametrize("limit", [1000, 0])
def test_routes(built, spark, limit):
    pairs = spark.createDataFrame([(4, 1), (1, 6), (6, 2)], "source long, target long")
    levels = [1, 2, 3, 4, 5] if limit else [2, 5]
    found = routes(built.edges, built.vertices, pairs, levels, 5, broadcast_edges=limit).collect()
    got = {(r.source, r.target, r.level): (r.num_edges, r.num_vertices, r.path_len) for r in found}
    want = {(4, 1, 1): (11, 6, 2), (4, 1, 2): (8, 5, 4), (4, 1, 3): (10, 6, 4), (4, 1, 4): (11, 6, 2), (4, 1, 5): (11, 6, 2)}
    for pair in ((1, 6), (6, 2)):
        want |= {(*pair, k): (10 if k == 3 else 11, 6, 6) for k in levels}
    assert got == {k: v for k, v in want.items() if k[2] in levels}


def test_route_quality_and_random_pairs(built):
    pairs = random_pairs(built.vertices, 6, seed=3)
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, random_pairs(built.vertices, 6, seed=3).collect()))
    found = routes(built.edges, built.vertices, pairs, [1, 5], 5)
    checks.require(checks.routes_bounded(found, 5))
    quality = {r.level: r for r in route_quality(found, 5).collect()}
    assert quality[5].exact_pairs == quality[5].pairs and quality[5].stretch == 1.0


def test_catalog_borders_and_legacy_labels(built):
    rows = {(r.id, r.level): (r.num_nodes, r.num_edges, r.num_border_nodes) for r in catalog(built.edges, 5).collect()}
    assert {k: v[1] for k, v in rows.items()} == {(1, 1): 7, (1, 2): 3, (1, 3): 1}
    assert {(r.level, r.node) for r in border_nodes(built.edges, 5).collect()} >= {(1, 3), (1, 4), (1, 5)}
    edges, vertices = label_legacy(built.edges, built.vertices, 5)
    assert {tuple(r.component) for r in edges.where("promoted_level = 1").collect()} == {(0, 0, 0, 0, 0)}
    assert {r.id: r.component[0] for r in vertices.collect()}[3] == 1


def test_zero_cost_streets_and_sinks_disappear(spark):
    edges, vertices = clean(ways_of(spark, STREETS))
    assert edges.count() == 11
    assert sorted(r.id for r in vertices.collect()) == [1, 2, 3, 4, 5, 6]
    assert directed_edges(ways_of(spark, STREETS)).where("id = 10").isEmpty()


def test_reverse_rows_keep_geometry(spark):
    ways = ways_of(spark, STREETS).withColumns({"x1": F.col("gid") * 1.0, "the_geom": F.lit(b"wkb")})
    rows = directed_edges(ways).where("id = 1").collect()
    assert len(rows) == 2 and {r.x1 for r in rows} == {1.0} and {bytes(r.the_geom) for r in rows} == {b"wkb"}


def test_largest_component_tie_goes_to_the_least_id(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    assert sorted(r.id for r in largest_component(parts).collect()) == [1, 2]


def test_empty_graph(spark):
    built = build_hierarchy(ways_of(spark, []), 5)
    assert built.edges.isEmpty() and built.vertices.isEmpty()
    assert weak_components(edges_of(spark, [])).isEmpty()


def test_connections_form_a_circle(spark):
    edges = edges_of(spark, [(1, 1, 2, 1), (2, 2, 1, 1), (3, 3, 4, 1), (4, 4, 3, 1), (5, 5, 6, 1), (6, 6, 5, 1)]).withColumn("promoted_level", F.lit(1))
    assert {r.source: list(r.targets) for r in connections(edges, 1).collect()} == {1: [3], 3: [5], 5: [1]}
    assert connections(edges.where("id <= 2"), 1).isEmpty()


def test_promotion_lowers_both_directions_and_is_monotone(spark):
    rows = [(1, 1, 2, 1), (1, 2, 1, 1), (2, 2, 3, 1), (2, 3, 2, 1), (3, 3, 4, 1), (3, 4, 3, 1)]
    edges = edges_of(spark, rows).withColumn("level", F.when(F.col("id") == 2, 7).otherwise(1)).withColumn("promoted_level", F.col("level"))
    out = promote_level(edges, 1)
    assert {(r.id, r.promoted_level) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {r.level: r.promoted for r in promotion_summary(out).collect()} == {1: 2}


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(100 + k, *rng.sample(range(1, n), 2), rng.randint(1, 4)) for k in range(m)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("one_task", [1000, 0])
def test_components_match_the_model(spark, seed, one_task):
    rows = random_graph(seed, n=16, m=20) + [(1, 50, 50, 1)]
    edges = edges_of(spark, rows)
    assert {r.node: r.component for r in strong_components(edges, one_task).collect()} == model.strong(rows)
    assert {r.node: r.component for r in weak_components(edges, one_task=one_task).collect()} == model.weak(rows)


def test_long_paths_contract_in_few_rounds(spark):
    rows = [(k, k, k + 1, 1) for k in range(300)]
    assert {r.component for r in weak_components(edges_of(spark, rows), one_task=0).collect()} == {0}


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit", [1000, 0])
def test_paths_and_betweenness_match_the_model(spark, seed, limit):
    rows = random_graph(seed, n=9, m=22)
    rows += [(900, rows[0][1], rows[0][2], rows[0][3])]  # a parallel edge of equal cost is a path of its own
    edges = edges_of(spark, rows)
    starts = edges.select(F.col("source").alias("id")).distinct()
    got = {(r.start, r.node): r.distance for r in distances(edges, starts, limit).collect()}
    want = {(s, t): d for s in {r[1] for r in rows} for t, d in model.distances(rows, s).items()}
    assert got == want
    score = {(r.id, r.source, r.target): r.betweenness for r in edge_betweenness(edges, broadcast_edges=limit).collect()}
    assert score == pytest.approx({r[:3]: b for r, b in zip(rows, model.betweenness(rows), strict=True)})


@pytest.mark.parametrize("limit", [1000, 0])
def test_path_edges_tie_breaks(spark, limit):
    # two ways from 1 to 4 of equal cost: the predecessor of least id wins; then the edge of least id
    rows = [(1, 1, 3, 1), (2, 3, 4, 1), (3, 1, 2, 1), (5, 2, 4, 1), (4, 2, 4, 1), (6, 4, 9, 2)]
    asked = spark.createDataFrame([(1, [4, 9, 1, 77])], "source long, targets array<long>")
    got = sorted((r.start, r.end, r.seq, r.id) for r in path_edges(edges_of(spark, rows), asked, limit).collect())
    assert got == [(1, 4, 1, 3), (1, 4, 2, 4), (1, 9, 1, 3), (1, 9, 2, 4), (1, 9, 3, 6)]


def test_sampled_betweenness_is_scaled(spark):
    rows = random_graph(1)
    edges = edges_of(spark, rows)
    everyone = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    full = {r.id: r.betweenness for r in edge_betweenness(edges).collect()}
    all_sampled = {r.id: r.betweenness for r in edge_betweenness(edges, sample_sources(everyone, n=100)).collect()}
    assert all_sampled == pytest.approx(full)
    assert sample_sources(everyone).count() == 4


def test_level_bounds(spark):
    values = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8, 16)], "betweenness double")
    assert caps(values, 4).first()["caps"] == [17.0, 8.0, 4.0, 2.0, 0.0]
    levels = {r.betweenness: r.level for r in with_levels(values, 4).collect()}
    assert levels == {16.0: 1, 8.0: 2, 4.0: 3, 2.0: 4, 1.0: 4}
    with pytest.raises(ValueError):
        caps(values, 7)


def test_equal_values_share_the_level_of_the_last_bound(spark):
    values = spark.createDataFrame([(5.0,)] * 4, "betweenness double")
    assert {r.level for r in with_levels(values, 5).collect()} == {5}


def test_residue_components_are_one_pass_over_levels(built):
    got = {(r.level, r.node): r.component for r in residue_components(built.edges, 5).collect()}
    assert {k for k, _ in got} == {1, 2, 3} and got[(3, 4)] == 1


def test_results_update_edges_and_vertices(spark):
    edges, vertices = ranked_edges(ways_of(spark, STREETS), 5)
    results = edges.where("id = 1 and source = 1").select("id", "source", "target", F.lit(99.0).alias("betweenness"), F.lit(3).alias("level"), F.array(F.lit(7)).alias("component"))
    new, seen = load_results(edges, vertices, results)
    got = {(r.id, r.source): (r.betweenness, r.level, r.promoted_level, list(r.component)) for r in new.collect()}
    assert got[(1, 1)] == (99.0, 3, 3, [7]) and got[(1, 2)][0] == 2.0
    assert {r.id: list(r.component) for r in seen.collect()}[1] == [7]


def ring_with_chords(seed, n=12, m=16):
    """A strongly connected graph with levels."""
    rng = random.Random(seed)
    rows = [(100 + k, k + 1, (k + 1) % n + 1, rng.randint(1, 3)) for k in range(n)] + [(200 + k, *rng.sample(range(1, n + 1), 2), rng.randint(1, 4)) for k in range(m)]
    return rows, [rng.randint(1, 5) for _ in rows]


@pytest.mark.parametrize("seed,limit", [(0, 1000), (1, 1000), (2, 0)])
def test_promotion_and_routes_match_the_model(spark, seed, limit):
    rows, level = ring_with_chords(seed) if limit else ring_with_chords(seed, 6, 5)
    made = [(*r[:3], float(r[3]), x, x) for r, x in zip(rows, level, strict=True)]
    edges = spark.createDataFrame(made, "id long, source long, target long, cost double, level int, promoted_level int")
    out = cut(promote(edges, 5, limit))
    final = model.promote(rows, level, 5)
    assert {(r.id, r.source, r.target): r.promoted_level for r in out.collect()} == {r[:3]: x for r, x in zip(rows, final, strict=True)}
    names = spark.createDataFrame([(v,) for v in model.vertices(rows)], "id long")
    marked, seen = (cut(df) for df in label(out, names, 5))
    of_edges, of_vertices = model.labels(rows, final, 5)
    assert {(r.id, r.source, r.target): list(r.component) for r in marked.collect()} == {r[:3]: x for r, x in zip(rows, of_edges, strict=True)}
    assert {r.id: list(r.component) for r in seen.collect()} == of_vertices
    pairs = [(1, 5), (5, 2), (6, 3)]
    found = routes(marked, seen, spark.createDataFrame(pairs, "source long, target long"), [1, 2, 3, 4, 5], 5, broadcast_edges=limit)
    got = {(r.source, r.target, r.level): (r.num_edges, r.num_vertices, r.path_len) for r in found.collect()}
    assert got == {(a, b, k): model.route(rows, final, 5, a, b, k) for a, b in pairs for k in range(1, 6)}


def test_large_vertex_ids(spark):
    far = 3_000_000_000_000_000
    rows, level = ring_with_chords(3)
    moved = [(i, s * far, t * far, c) for i, s, t, c in rows]
    made = [(*r[:3], float(r[3]), x) for r, x in zip(moved, level, strict=True)]
    edges = spark.createDataFrame(made, "id long, source long, target long, cost double, promoted_level int")
    names = spark.createDataFrame([(v,) for v in model.vertices(moved)], "id long")
    got = {(r.id, r.source, r.target): list(r.component) for r in label(edges, names, 5)[0].collect()}
    assert got == {r[:3]: x for r, x in zip(moved, model.labels(moved, level, 5)[0], strict=True)}
    with pytest.raises(Exception, match="vertex ids must lie within"):
        residue_components(edges.withColumn("source", F.col("source") * 30), 5).collect()


def test_members_come_in_bounded_lists(spark):
    rows, level = ring_with_chords(4)
    made = [(*r[:3], float(r[3]), x) for r, x in zip(rows, level, strict=True)]
    edges = spark.createDataFrame(made, "id long, source long, target long, cost double, promoted_level int")
    lists = sorted(((r.level, r.component, r.part), list(r.nodes)) for r in component_members(edges, 5, size=3).collect())
    got = {}
    for (k, c, part), nodes in lists:
        assert len(nodes) <= 3 and len(got.setdefault((k, c), [])) == 3 * part
        got[k, c] += nodes
    want = {}
    for k in range(1, 6):
        for v, c in model.weak([e for e, x in zip(rows, level, strict=True) if x > k]).items():
            want.setdefault((k, c), []).append(v)
    assert got == {key: sorted(nodes) for key, nodes in want.items()}


@pytest.mark.parametrize("few", [1000, 0])
def test_quantiles_of_any_size(spark, few):
    import numpy as np

    rng = random.Random(2)
    values = {g: [rng.choice([rng.random(), 0.5, 3.0]) for _ in range(n)] for g, n in (("a", 1), ("b", 40), ("c", 77))}
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs], "g string, x double")
    at = [0, 0.1, 0.25, 0.5, 0.99, 1, 2]
    for by in ((), ("g",)):
        for r in quantiles(df, "x", at, by, few).collect():
            own = values[r.g] if by else sum(values.values(), [])
            assert list(r.q) == pytest.approx([np.quantile(own, min(q, 1)) for q in at])


def test_places_and_zipped_pairs(spark):
    df = spark.createDataFrame([(v,) for v in (5, 3, 9, 3, 1)], "id long")
    assert sorted((r.place, r.id) for r in numbered(df, [F.col("id")]).collect()) == [(1, 1), (2, 3), (3, 3), (4, 5), (5, 9)]
    other = spark.createDataFrame([(v,) for v in (7, 6)], "id long")
    assert sorted(map(tuple, zip_pairs(df, other, ("id",)).select("place", "source", "target").collect())) == [(1, 1, 6), (2, 3, 7)]


def test_checkpoints_go_when_they_are_told_to(spark):
    from pathlib import Path

    at = Path(shared_folder(spark).removeprefix("file:"))
    files = lambda: {p for p in at.rglob("rdd-*")}
    before = files()
    one = cut(spark.range(5))
    forget(one, spark.range(3))
    with scratch(spark):
        two = cut(spark.range(7))
        assert two.count() == 7 and len(files() - before) == 1
    assert files() == before


def spokes(seed, leaves=12, most_cost=3, parts=1):
    """Rows of edges between few hubs and leaves, some of them twins, with loops, parallel edges and unreachable ends."""
    draw = random.Random(seed)
    ids = draw.sample(range(100), leaves + 4)
    hub_ids, rows = ids[:4], []
    for _ in range(draw.randint(1, 70)):
        a, b = draw.choice(hub_ids), draw.choice(ids)
        a, b = (a, b) if draw.random() < 0.5 else (b, a)
        rows.append((draw.randint(0, 40), a, b, draw.randint(1, most_cost) / parts))
    twin = lambda v: v if v in hub_ids else v + 1000
    return rows + [(i + 100, twin(s), twin(t), c) for i, s, t, c in rows if seed % 2 and (s in hub_ids) != (t in hub_ids)]


def arrays_of(rows):
    return Graph.of(*(np.array(c, k) for c, k in zip(zip(*rows, strict=True), (np.int64, np.int64, np.int64, float), strict=True)))


@pytest.mark.parametrize("seed", range(40))
def test_hub_kernels_equal_the_plain_ones(seed):
    g = arrays_of(spokes(seed, parts=4 if seed % 3 else 1))
    found, n = hubs.Hubs.of(g), len(g.ids)
    if found is None:
        assert (g.tail == g.head).all()
        return
    starts = np.arange(n) % (1 + seed % 2) == 0
    want = np.zeros(len(g.cost))
    for v in np.flatnonzero(starts):
        dependencies(g.lists(), n, int(v), want)
    kinds, of = hubs.twins(found, starts)
    parts = [kinds.mass(rows) for rows in np.array_split(np.arange(len(kinds.own)), 3)]
    got = hubs.edge_mass(g, found, kinds, of, starts, np.concatenate([p[0] for p in parts]), sum(p[1] for p in parts))
    assert np.allclose(got, want, atol=1e-9)
    pairs = [(a, b) for a in range(n) for b in range(n)]
    walked = {}
    for k, _, e in sorted(zip(*(x.tolist() for x in found.paths(*np.array(pairs).T)), strict=True)):
        walked.setdefault(pairs[k], []).append(e)
    for a in range(n):
        dist, into = shortest_tree(g.lists(), a)
        assert {v: d for v, d in enumerate(found.distances(a).tolist()) if d < float("inf")} == dist
        for b in range(n):
            back, at = [], b
            while at in into and at != a:
                back.append(into[at])
                at = int(g.tail[into[at]])
            assert walked.get((a, b), []) == back[::-1]


def test_costs_that_round_and_graphs_without_few_hubs_have_no_hubs():
    assert hubs.Hubs.of(arrays_of([(1, 1, 2, 0.1)])) is None
    assert hubs.Hubs.of(arrays_of([(k, 2 * k, 2 * k + 1, 1) for k in range(hubs.MOST_HUBS + 1)])) is None
    assert hubs.Hubs.of(arrays_of([(k, 2 * k, 2 * k + 1, 1) for k in range(hubs.MOST_HUBS)])) is not None


@pytest.mark.parametrize("sampled", [False, True])
def test_betweenness_of_few_hubs_searches_no_source_alone(spark, monkeypatch, sampled):
    def never(*_):
        raise AssertionError("a source was searched alone")

    edges = edges_of(spark, spokes(7))
    some = edges.select(F.col("source").alias("id")).distinct().where("id % 2 = 0") if sampled else None
    want = {tuple(r) for r in edge_betweenness(edges, some, broadcast_edges=0).withColumn("betweenness", F.round("betweenness", 6)).collect()}
    monkeypatch.setattr(betweenness_module, "dependencies", never)
    assert {tuple(r) for r in edge_betweenness(edges, some).withColumn("betweenness", F.round("betweenness", 6)).collect()} == want


@pytest.mark.parametrize("passes", [2, 64])
def test_strong_parts_equal_the_plain_search(monkeypatch, passes):
    monkeypatch.setattr(components, "PASSES", passes)
    draw = np.random.default_rng(5)
    for _ in range(300):
        n, m = int(draw.integers(1, 25)), int(draw.integers(1, 50))
        tail, head = draw.integers(0, n, m), draw.integers(0, n, m)
        order = np.argsort(tail, kind="stable")
        first = np.searchsorted(tail[order], np.arange(n + 1))
        assert components.strong_parts(n, tail, head).tolist() == strong_labels(n, first.tolist(), head[order].tolist())


def test_skeletons_are_checked_a_level_a_task(spark):
    rows = [(1, 1, 2, 1), (2, 2, 1, 1), (3, 2, 3, 2), (4, 3, 2, 3), (5, 4, 4, 3), (6, 5, 6, 3)]
    edges = spark.createDataFrame(rows, "id long, source long, target long, promoted_level int")
    want = {(1, 1, True), (2, 2, False), (3, 4, False)}
    for one_task in (0, 100):
        assert {tuple(r) for r in checks.skeleton_strongly_connected(edges, 3, one_task).collect()} == want


@pytest.mark.parametrize("passes", [1, 64])
def test_routes_by_passes_equal_those_vertex_by_vertex(spark, monkeypatch, built, passes):
    pairs = built.vertices.select(F.col("id").alias("source")).crossJoin(built.vertices.select(F.col("id").alias("target"))).where("source <> target")
    shape = ("source", "target", "level", "num_edges", "num_vertices", "path_len")
    want = {tuple(r) for r in routes(built.edges, built.vertices, pairs, [1, 3, 5], 5, broadcast_edges=0).select(*shape).collect()}
    monkeypatch.setattr(routing, "PASSES", passes)
    if passes > 1:
        monkeypatch.setattr(routing, "shortest_tree", None)
    assert {tuple(r) for r in routes(built.edges, built.vertices, pairs, [1, 3, 5], 5).select(*shape).collect()} == want


@pytest.mark.parametrize("one_task", [1 << 20, 8, 0])
def test_residues_of_all_levels_from_edges_read_once(spark, monkeypatch, one_task):
    rng = random.Random(7)
    rows = [(k, rng.randrange(30), rng.randrange(30), 1) for k in range(120)] + [(200, 77, 77, 1), (201, 77, 77, 1), (202, 78, 78, 1), (203, 1, 40, 1), (204, 41, 2, 1)]
    level = [rng.randint(1, 5) for _ in rows[:-5]] + [2, 5, 1, 7, 6]
    made = [(*r[:3], x) for r, x in zip(rows, level, strict=True)]
    edges = spark.createDataFrame(made, "id long, source long, target long, promoted_level int").repartition(3)
    contracted = []
    plain = label_module.weak_components
    monkeypatch.setattr(label_module, "weak_components", lambda *a, **k: contracted.append(1) or plain(*a, **k))
    got = {(r.level, r.node): r.component for r in residue_components(edges, 5, one_task=one_task).collect()}
    want = {(k, v): c for k in range(1, 6) for v, c in model.weak([e for e, x in zip(rows, level, strict=True) if x > k]).items()}
    assert got == want
    assert bool(contracted) == (one_task < 1 << 20)


def test_spanning_forests_spare_the_contraction(spark, monkeypatch):
    """Many edges of few vertices: a forest of each part of them is small enough for one task."""
    monkeypatch.setattr(label_module, "weak_components", lambda *a, **k: pytest.fail("contracted"))
    rng = random.Random(8)
    rows = [(k, rng.randrange(12), rng.randrange(12), 1) for k in range(2000)]
    level = [rng.choice([1, 1, 1, 1, 2, 3]) if min(r[1:3]) % 2 == 0 else rng.choice([1, 4]) for r in rows]
    edges = spark.createDataFrame([(*r[:3], x) for r, x in zip(rows, level, strict=True)], "id long, source long, target long, promoted_level int").repartition(4)
    got = {(r.level, r.node): r.component for r in residue_components(edges, 5, one_task=100).collect()}
    assert got == {(k, v): c for k in range(1, 6) for v, c in model.weak([e for e, x in zip(rows, level, strict=True) if x > k]).items()}


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def levelled_graph(spark, seed):
    rows, level = ring_with_chords(seed)
    made = [(*r[:3], float(r[3]), x) for r, x in zip(rows, level, strict=True)]
    return rows, level, spark.createDataFrame(made, "id long, source long, target long, cost double, promoted_level int")


def test_catalog_counts_edges_before_they_meet_components(spark):
    rows, level, edges = levelled_graph(spark, 5)
    found = catalog(edges, 5)
    assert joins(found) == 1
    want = {}
    for k in range(1, 6):
        above = [e for e, x in zip(rows, level, strict=True) if x > k]
        ends = model.vertices([e for e, x in zip(rows, level, strict=True) if x <= k])
        weak = model.weak(above)
        for c in set(weak.values()):
            nodes = {v for v in weak if weak[v] == c}
            want[c, k] = len(nodes), sum(e[1] in nodes for e in above), len(nodes & ends)
    assert {(r.id, r.level): (r.num_nodes, r.num_edges, r.num_border_nodes) for r in found.collect()} == want


def test_edges_are_labelled_by_one_join(spark):
    """Two rows of one id and ends may differ in level, and each has its own labels."""
    rows, level, edges = levelled_graph(spark, 6)
    rows, level = rows + [rows[0], rows[0]], level + [1, 5]
    edges = edges.union(spark.createDataFrame([(*rows[0][:3], 1.0, 1), (*rows[0][:3], 1.0, 5)], edges.schema))
    names = spark.createDataFrame([(v,) for v in model.vertices(rows)], "id long")
    marked, seen = label(edges, names, 5)
    assert joins(marked) == 1 and "Generate explode" not in marked._jdf.queryExecution().optimizedPlan().toString()
    of_edges, of_vertices = model.labels(rows, level, 5)
    key = lambda e, x, own: (*e[:3], own, list(x))
    got = sorted(key((r.id, r.source, r.target), r.component, r.promoted_level) for r in marked.collect())
    assert got == sorted(key(e, x, own) for e, x, own in zip(rows, of_edges, level, strict=True))
    assert {r.id: list(r.component) for r in seen.collect()} == of_vertices


def test_labels_are_checked_by_one_join(spark, built):
    found = checks.labels_match(built.edges, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # sums are spread over levels, not edges
    assert {(r.level, r.n_wrong, r.ok) for r in found.collect()} == {(k, 0, True) for k in (1, 2, 3)}
    put = F.transform("component", lambda x, i: F.when((i == 1) & (F.col("id") == 6), None).otherwise(x))
    assert {(r.level, r.n_wrong, r.ok) for r in checks.labels_match(built.edges.withColumn("component", put), 5).collect()} == {(1, 0, True), (2, 1, False), (3, 0, True)}


def test_few_hubs_are_promoted_without_a_round_a_level(spark, monkeypatch):
    """Streets of several rows and ids, and a row without a level, which stays so."""
    monkeypatch.setattr(promote_module, "promote_level", lambda *a, **k: pytest.fail("a round a level"))
    rows, level = ring_with_chords(9)
    rows += [(i, t, s, c + 1) for i, s, t, c in rows[:6]]
    level += [5, 4, 5, 3, 5, 2]
    made = [(*r[:3], float(r[3]), x) for r, x in zip(rows, level, strict=True)] + [(100, 1, 2, 9.0, None)]
    out = promote(spark.createDataFrame(made, "id long, source long, target long, cost double, promoted_level int"), 5)
    want = model.promote(rows, level, 5)
    assert sorted((r.id, r.source, r.target, r.cost, r.promoted_level or 0) for r in out.collect()) == sorted([(*r, x) for r, x in zip(rows, want, strict=True)] + [(100, 1, 2, 9.0, 0)])


def test_a_build_reads_its_streets_once(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    built = build_hierarchy(ways_of(spark, STREETS).mapInArrow(told, WAYS), 5, verify=False)
    assert {(r.id, r.source, r.target): r.promoted_level for r in built.edges.collect()} == {k: v[2] for k, v in GOLDEN.items()}
    assert read.value == len(STREETS)


def test_trade_meets_line_items_last(spark, sf_dir):
    found = networks.trade(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in plan[plan.index("Join ") :].splitlines()[0]  # the outermost of both joins
    plain = networks.network(spark, sf_dir, networks.TRADE)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
