"""SQL for the registered queries, independent of the engine's operators.

Distances and path counts are unrolled to a fixed number of rounds, which the trade network's paths
stay well below: every pair of its vertices is joined by a handful of hops at any scale.
"""

from __future__ import annotations

from graphloom.plans.networks import HOME, NATION_BASE, STREETS, TRADE

LEVELS, PARTIAL = 10, 100
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
HOPS = 12

_EDGES = "SELECT gid AS id, source, target, cost FROM {w} WHERE cost > 0 UNION ALL SELECT gid, target, source, reverse_cost FROM {w} WHERE reverse_cost > 0"
_STREETS = f"ways AS ({STREETS}), edges AS ({_EDGES.format(w='ways')})"
_TRADE = f"ways AS ({TRADE}), edges AS ({_EDGES.format(w='ways')})"


def _distances() -> str:
    """d(s, t, x): least cost over at most HOPS hops, s itself at 0."""
    parts = ["links AS (SELECT source, target, min(cost) AS cost FROM edges GROUP BY ALL)", "d0 AS (SELECT DISTINCT source AS s, source AS t, CAST(0 AS DOUBLE) AS x FROM edges)"]
    for k in range(1, HOPS + 1):
        parts.append(f"d{k} AS MATERIALIZED (SELECT s, t, min(x) AS x FROM (SELECT s, t, x FROM d{k - 1} UNION ALL SELECT s, target, x + cost FROM d{k - 1} JOIN links ON t = source) GROUP BY s, t)")
    parts.append(f"d AS (SELECT * FROM d{HOPS})")
    return ", ".join(parts)


def _betweenness(decimals: int = 6, sample: str = "", scale: str = "1") -> str:
    """Counts of shortest paths by hops along the shortest-path graph, then every edge's share of every pair; ``sample`` limits the starts."""
    parts = [
        _distances(),
        "dag AS MATERIALIZED (SELECT a.s, e.source AS u, e.target AS v FROM edges e JOIN d a ON a.t = e.source JOIN d b ON b.s = a.s AND b.t = e.target AND b.x = a.x + e.cost)",
        "p0 AS (SELECT DISTINCT s, s AS t, CAST(1 AS DOUBLE) AS n FROM d)",
    ]
    for k in range(1, HOPS + 1):
        parts.append(f"p{k} AS MATERIALIZED (SELECT dag.s, dag.v AS t, sum(n) AS n FROM p{k - 1} p JOIN dag ON dag.s = p.s AND dag.u = p.t GROUP BY ALL)")
    union = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(HOPS + 1))
    parts += [
        f"sigma AS MATERIALIZED (SELECT s, t, sum(n) AS n FROM ({union}) GROUP BY ALL)",
        "dist AS MATERIALIZED (SELECT d.s, d.t, d.x, sigma.n FROM d JOIN sigma USING (s, t))",
        f"""scored AS (
          SELECT e.id, e.source, e.target, e.cost, round({scale} * coalesce(sum(a.n * coalesce(b.n, 1) / st.n), 0), {decimals}) AS betweenness
          FROM edges e LEFT JOIN dist a ON a.t = e.source {sample}
          LEFT JOIN dist st ON st.s = a.s AND st.t <> st.s
          LEFT JOIN dist b ON b.s = e.target AND b.t = st.t
          WHERE abs(a.x + e.cost + b.x - st.x) < 1e-9 GROUP BY ALL)""",
        "betw AS MATERIALIZED (SELECT e.id, e.source, e.target, e.cost, coalesce(s.betweenness, 0) AS betweenness FROM edges e LEFT JOIN scored s USING (id, source, target))",
    ]
    return ", ".join(parts)


def _levels(decimals: int = 6) -> str:
    bounds = [f"quantile_cont(betweenness, {i * (100 // LEVELS) / 100}) AS q{LEVELS - i}" for i in range(LEVELS + 1)]
    cap = lambda k: f"(q{k} + {1 if k == 0 else -1 if k == LEVELS else 0})"
    cases = " ".join(f"WHEN betweenness - {cap(k + 1)} > 1e-10 AND betweenness - {cap(k)} <= 1e-10 THEN {k + 1}" for k in range(LEVELS))
    return f"{_betweenness(decimals)}, caps AS (SELECT {', '.join(bounds)} FROM betw), levelled AS MATERIALIZED (SELECT id, source, target, cost, betweenness, CASE {cases} END AS level FROM betw, caps)"


#: reach(v, s, t): what s reaches by the edges of each variant v, itself included.
def _closure(links: str) -> str:
    return f"""links_ AS MATERIALIZED (SELECT DISTINCT v, source, target FROM ({links})),
      reach AS (SELECT v, source AS s, source AS t FROM links_ UNION SELECT v, target, target FROM links_
                UNION SELECT reach.v, reach.s, links_.target FROM reach JOIN links_ ON links_.v = reach.v AND links_.source = reach.t)"""


_MUTUAL = "SELECT a.v, a.s AS node, min(a.t) AS component FROM reach a JOIN reach b ON a.v = b.v AND a.s = b.t AND a.t = b.s GROUP BY a.v, a.s"
_WEAK = "SELECT v, s AS node, min(t) AS component FROM reach GROUP BY v, s"


def _both_ways(links: str) -> str:
    return f"SELECT v, source, target FROM ({links}) x1 UNION ALL SELECT v, target, source FROM ({links}) x2"


_RESIDUES = f"SELECT k AS v, source, target FROM levelled, range(1, {LEVELS + 1}) r(k) WHERE level > k"
_PARTS = f"{_TRADE}, {_levels()}, {_closure(_both_ways(_RESIDUES))}, parts AS MATERIALIZED ({_WEAK})"
_ON = f"on_skeleton AS MATERIALIZED (SELECT DISTINCT k AS v, node FROM (SELECT source AS node, level FROM levelled UNION ALL SELECT target, level FROM levelled), range(1, {LEVELS + 1}) r(k) WHERE level <= k)"
_RANKED = "ranked AS MATERIALIZED (SELECT v, node, component, dense_rank() OVER (PARTITION BY v ORDER BY component) AS nth FROM parts)"
_NODES = "nodes AS (SELECT source AS id FROM edges UNION SELECT target FROM edges)"


def _labels(parts: str, none: int) -> str:
    return f"""SELECT n.id, string_agg(CAST(coalesce(p.label, {none}) AS VARCHAR), ',' ORDER BY r.k) AS component
      FROM nodes n CROSS JOIN range(1, {LEVELS + 1}) r(k) LEFT JOIN ({parts}) p ON p.v = r.k AND p.node = n.id GROUP BY n.id"""


def _rank(method: str, descending: bool, num: int | None) -> str:
    order = "v DESC" if descending else "v"
    inner = f"SELECT o_orderkey, v, row_number() OVER (ORDER BY {order}, o_orderkey) AS place, rank() OVER (ORDER BY {order}) AS low, rank() OVER (ORDER BY {order}) + count(*) OVER (PARTITION BY v) - 1 AS high FROM orders_"
    high = "high" if num is None else f"least(high, {num})"
    value = {"average": f"(low + {high}) / 2.0", "min": "low", "max": high, "ordinal": "place"}[method]
    if num is not None:
        value = f"CASE WHEN place <= {num} THEN {value} ELSE 0 END"
    return f"WITH orders_ AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS v FROM orders) SELECT o_orderkey, v, CAST({value} AS DOUBLE) AS rank FROM ({inner})"


_ORDERS = "WITH orders_ AS (SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS v FROM orders)"

#: The largest strong component of the streets: what the busiest vertex reaches and is reached from.
_GIANT = f"""{_STREETS},
  hub AS (SELECT source AS p FROM edges GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
  ahead AS (SELECT p AS n FROM hub UNION SELECT target FROM ahead JOIN edges ON source = n),
  behind AS (SELECT p AS n FROM hub UNION SELECT source FROM behind JOIN edges ON target = n),
  giant AS MATERIALIZED (SELECT n AS id FROM ahead INTERSECT SELECT n FROM behind)"""

ORACLE_SQL: dict[str, str] = {
    "ways_projection": STREETS,
    "trade_projection": TRADE,
    "directed_rows": f"WITH {_STREETS} SELECT id, source, target, cost FROM edges",
    "vertex_list": f"WITH {_STREETS} SELECT source AS id FROM ways UNION SELECT target FROM ways",
    "adjacency_dump": f"""WITH {_TRADE} SELECT source, source || ': ' || string_agg(target || '(' || id || ',' || printf('%g', cost / 8) || ')', ' ' ORDER BY target, id, cost) AS line FROM edges GROUP BY source""",
    "edge_index": f"WITH {_STREETS} SELECT id, source, target, row_number() OVER (ORDER BY id, source, target) - 1 AS idx FROM edges",
    "vertex_index": f"WITH {_STREETS} SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT source AS id FROM ways UNION SELECT target FROM ways)",
    "csv_edges": f"WITH {_STREETS} SELECT id, source, target, cost FROM edges",
    "csv_roundtrip": f"WITH {_TRADE} SELECT id, source, target, cost / 8 AS betweenness, CAST(3 AS INTEGER) AS level, '1,1,1,1,1,1,1,1,1,1' AS component FROM edges",
    "inserted_rows": f"WITH a AS ({TRADE}), b AS ({STREETS}), ids AS ((SELECT source AS id FROM a UNION SELECT target FROM a) UNION ALL (SELECT source FROM b UNION SELECT target FROM b)) SELECT id, count(*) AS n, CAST(0 AS INTEGER) AS longest FROM ids GROUP BY id",
    "semi_joined": f"WITH {_STREETS}, every AS MATERIALIZED (SELECT * FROM edges), starts AS MATERIALIZED (SELECT DISTINCT source AS v FROM every) SELECT e.id, e.source, e.target, e.cost FROM every e JOIN starts a ON a.v = e.source JOIN starts b ON b.v = e.target",
    "updated_edges": f"WITH {_STREETS} SELECT e.id, e.source, e.target, m.cost FROM edges e JOIN (SELECT id, min(cost) AS cost FROM edges GROUP BY id) m USING (id)",
    "loaded_results": f"WITH {_TRADE} SELECT id, source, target, CASE WHEN cost >= 12 THEN cost * 2 ELSE 0 END AS betweenness, CAST(CASE WHEN cost >= 12 THEN 4 ELSE 10 END AS INTEGER) AS level, CAST(CASE WHEN cost >= 12 THEN 4 ELSE 10 END AS INTEGER) AS promoted_level, CAST(CASE WHEN cost >= 12 THEN 10 ELSE 0 END AS INTEGER) AS n_component FROM edges",
    "touched_vertices": f"WITH {_STREETS}, v AS (SELECT source AS id FROM edges UNION SELECT target FROM edges) SELECT id FROM v WHERE EXISTS (SELECT 1 FROM edges e WHERE e.cost <= 2 AND e.source = v.id) OR EXISTS (SELECT 1 FROM edges e WHERE e.cost <= 2 AND e.target = v.id)",
    "member_edges": f"WITH {_TRADE} SELECT DISTINCT id, source, target, n_regionkey AS component FROM edges JOIN nation ON n_nationkey + 1000001 IN (source, target)",
    "zipped_pairs": "SELECT place, source, target FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS place, s_suppkey + 1 AS source FROM supplier) JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS place, CAST(n_nationkey AS BIGINT) + 1000001 AS target FROM nation) USING (place)",
    "array_functions": f"""WITH {_TRADE}, lists AS (SELECT source, list(target ORDER BY target) AS t FROM edges GROUP BY source)
      SELECT source, CAST(len(t) AS BIGINT) AS n, t[2] AS second, array_to_string(list_prepend(0, t[2:]), ',') AS replaced, '0,0,0' AS zeros,
             '[' || array_to_string(t, ', ') || ']' AS spelt, CAST(len(t) AS BIGINT) AS parsed FROM lists""",
    **{f"{'partial_' if num else ''}rank{'high' if high else ''}_{m}": _rank(m, high, num) for m in ("average", "min", "max", "ordinal") for high in (False, True) for num in (None, PARTIAL)},
    "order_positions": f"{_ORDERS} SELECT o_orderkey, v, row_number() OVER (ORDER BY v, o_orderkey) - 1 AS position FROM orders_",
    "orderhigh_positions": f"{_ORDERS} SELECT o_orderkey, v, row_number() OVER (ORDER BY v DESC, o_orderkey) - 1 AS position FROM orders_",
    "order_topk": f"{_ORDERS} SELECT o_orderkey, v FROM orders_ ORDER BY v, o_orderkey LIMIT {PARTIAL}",
    "orderhigh_topk": f"{_ORDERS} SELECT o_orderkey, v FROM orders_ ORDER BY v DESC, o_orderkey LIMIT {PARTIAL}",
    "quantile_values": f"SELECT l_returnflag, {', '.join(f'round(quantile_cont(l_quantity, {q}), 6) AS q{i}' for i, q in enumerate(QUANTILES))}, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY l_returnflag",
    "scc_labels": f"WITH RECURSIVE {_TRADE}, {_closure('SELECT 0 AS v, source, target FROM edges')} SELECT node, component FROM ({_MUTUAL})",
    "largest_scc": f"WITH RECURSIVE {_GIANT} SELECT id FROM giant",
    "cleaned_edges": f"WITH RECURSIVE {_GIANT} SELECT id, source, target, cost, CAST(10 AS INTEGER) AS level, CAST(10 AS INTEGER) AS promoted_level FROM edges WHERE source IN (SELECT id FROM giant) AND target IN (SELECT id FROM giant)",
    "cleaned_vertices": f"WITH RECURSIVE {_GIANT} SELECT id, CAST(0 AS INTEGER) AS n_component FROM giant",
    "wcc_labels": f"""WITH RECURSIVE {_STREETS}, links AS MATERIALIZED (SELECT DISTINCT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges),
      c(node, component) USING KEY (node) AS (SELECT u, u FROM links UNION
        SELECT l.v, min(c.component) FROM c JOIN links l ON l.u = c.node JOIN recurring.c r ON r.node = l.v WHERE c.component < r.component GROUP BY l.v)
      SELECT node, component FROM c""",
    "wcc_sizes": f"""WITH RECURSIVE {_STREETS}, links AS MATERIALIZED (SELECT DISTINCT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges),
      c(node, component) USING KEY (node) AS (SELECT u, u FROM links UNION
        SELECT l.v, min(c.component) FROM c JOIN links l ON l.u = c.node JOIN recurring.c r ON r.node = l.v WHERE c.component < r.component GROUP BY l.v)
      SELECT component, count(*) AS num_nodes FROM c GROUP BY component""",
    "all_distances": f"WITH {_TRADE}, {_distances()} SELECT s AS start, t AS node, x AS distance FROM d WHERE s > {NATION_BASE}",
    "sssp_distances": f"""WITH RECURSIVE {_STREETS}, links AS MATERIALIZED (SELECT source, target, min(cost) AS cost FROM edges GROUP BY ALL),
      f(node, distance) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION
        SELECT n.node, n.distance FROM (SELECT l.target AS node, min(f.distance + l.cost) AS distance FROM f JOIN links l ON l.source = f.node GROUP BY l.target) n
        LEFT JOIN recurring.f r ON r.node = n.node WHERE r.node IS NULL OR n.distance < r.distance)
      SELECT CAST(1 AS BIGINT) AS start, node, distance FROM f""",
    "path_costs": f'WITH {_TRADE}, {_distances()}, pairs AS ({HOME}) SELECT s AS start, t AS "end", x AS distance, true AS sound FROM d JOIN pairs ON s = source AND t = target WHERE s <> t',
    "betweenness": f"WITH {_TRADE}, {_betweenness()} SELECT id, source, target, cost, betweenness FROM betw",
    "edge_levels": f"WITH {_TRADE}, {_levels()} SELECT id, source, target, betweenness, level FROM levelled",
    "level_histogram": f"WITH {_TRADE}, {_levels()} SELECT level, count(*) AS n FROM levelled GROUP BY level",
    "connections_l1": f"""WITH RECURSIVE {_TRADE}, {_levels()}, {_closure('SELECT 0 AS v, source, target FROM levelled WHERE level <= 1')},
      reps AS (SELECT DISTINCT component FROM ({_MUTUAL}))
      SELECT source, CAST(target AS VARCHAR) AS targets FROM (SELECT component AS source, coalesce(lead(component) OVER (ORDER BY component), (SELECT min(component) FROM reps)) AS target FROM reps) WHERE source <> target""",
    "residue_labels": f"WITH RECURSIVE {_PARTS} SELECT CAST(v AS INTEGER) AS level, node, component FROM parts",
    "skeleton_ends": f"WITH {_TRADE}, {_levels()}, {_ON} SELECT CAST(v AS INTEGER) AS level, node FROM on_skeleton",
    "component_arrays": f"WITH RECURSIVE {_PARTS}, {_RANKED}, {_ON}, {_NODES} {_labels('SELECT v, node, nth + 1 AS label FROM ranked WHERE NOT EXISTS (SELECT 1 FROM on_skeleton o WHERE o.v = ranked.v AND o.node = ranked.node)', 1)}",
    "edge_component_arrays": f"""WITH RECURSIVE {_PARTS}, {_RANKED} SELECT e.id, e.source, e.target, string_agg(CAST(CASE WHEN e.level > r.k THEN p.nth + 1 ELSE 1 END AS VARCHAR), ',' ORDER BY r.k) AS component
      FROM levelled e CROSS JOIN range(1, {LEVELS + 1}) r(k) LEFT JOIN ranked p ON p.v = r.k AND p.node = e.target GROUP BY e.id, e.source, e.target""",
    "legacy_arrays": f"WITH RECURSIVE {_PARTS}, {_RANKED}, {_NODES} {_labels('SELECT v, node, nth AS label FROM ranked', 0)}",
    "component_catalog": f"""WITH RECURSIVE {_PARTS}, {_ON},
      sized AS (SELECT p.v, p.component, count(*) AS num_nodes, count(o.node) AS num_border_nodes FROM parts p LEFT JOIN on_skeleton o ON o.v = p.v AND o.node = p.node GROUP BY ALL),
      lines AS (SELECT p.v, p.component, count(*) AS num_edges FROM ({_RESIDUES}) e JOIN parts p ON p.v = e.v AND p.node = e.target GROUP BY ALL)
      SELECT component AS id, CAST(v AS INTEGER) AS level, CAST(num_nodes AS INTEGER) AS num_nodes, CAST(num_edges AS INTEGER) AS num_edges, CAST(num_border_nodes AS INTEGER) AS num_border_nodes FROM sized JOIN lines USING (v, component)""",
    "boundary_nodes": f"WITH RECURSIVE {_PARTS}, {_ON} SELECT CAST(p.v AS INTEGER) AS level, p.node, p.component FROM parts p JOIN on_skeleton o ON o.v = p.v AND o.node = p.node",
    "assert_scc": f"SELECT CAST(k AS INTEGER) AS level, CAST(1 AS BIGINT) AS n_scc, true AS ok FROM range(1, {LEVELS + 1}) r(k)",
    "assert_comp_id": f"SELECT CAST(k AS INTEGER) AS level, CAST(0 AS BIGINT) AS n_wrong, true AS ok FROM range(1, {LEVELS + 1}) r(k)",
    "assert_edge_count": f"WITH RECURSIVE {_TRADE}, {_closure('SELECT 0 AS v, source, target FROM edges')}, m AS MATERIALIZED ({_MUTUAL}), best AS (SELECT component FROM m GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), kept AS (SELECT node FROM m JOIN best USING (component)), n AS (SELECT count(*) AS c FROM edges WHERE source IN (SELECT node FROM kept) AND target IN (SELECT node FROM kept)) SELECT CAST(k AS INTEGER) AS level, c AS n_rows, c AS n_grouped, true AS ok FROM n, range(1, {LEVELS + 1}) r(k)",
    "assert_vertex_count": f"WITH RECURSIVE {_TRADE}, {_closure('SELECT 0 AS v, source, target FROM edges')}, m AS MATERIALIZED ({_MUTUAL}), best AS (SELECT component FROM m GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), n AS (SELECT count(*) AS c FROM m JOIN best USING (component)) SELECT CAST(k AS INTEGER) AS level, c AS n_rows, c AS n_grouped, true AS ok FROM n, range(1, {LEVELS + 1}) r(k)",
    "assert_promoted_not_above": "SELECT CAST(0 AS BIGINT) AS n_wrong, true AS ok",
    "assert_skeletons_nested": f"SELECT CAST(k AS INTEGER) AS level, true AS ok FROM range(1, {LEVELS + 1}) r(k)",
    "assert_labels_match": "SELECT CAST(0 AS BIGINT) AS n_wrong, true AS ok",
    "assert_levels_complete": "SELECT CAST(0 AS BIGINT) AS n_wrong, true AS ok",
    "assert_routes_bounded": "SELECT CAST(0 AS BIGINT) AS n_wrong, true AS ok",
    "betweenness_total": f"""WITH {_TRADE}, {_betweenness()},
      hops AS (SELECT s, t, sum(k * n) / sum(n) AS mean FROM ({" UNION ALL ".join(f"SELECT s, t, {k} AS k, n FROM p{k}" for k in range(HOPS + 1))}) GROUP BY s, t)
      SELECT round(sum(mean), 4) AS total FROM hops""",
}
ORACLE_SQL["full_routes"] = f"WITH pairs AS ({ORACLE_SQL['zipped_pairs']}), {_TRADE}, {_distances()} SELECT source, target, x AS path_len FROM pairs JOIN d ON s = source AND t = target"


# Promotion, level by level, and what is built on it


def _promotion(levelled: str = "levelled") -> str:
    """promoted(id, source, target, cost, betweenness, level, pl): each level's skeleton is tied together by the least paths of a circle of its strong components."""
    parts = [
        "via AS MATERIALIZED (SELECT a.s, e.target AS v, e.source AS u, e.id FROM edges e JOIN d a ON a.t = e.source JOIN d b ON b.s = a.s AND b.t = e.target AND b.x = a.x + e.cost WHERE e.target <> a.s QUALIFY row_number() OVER (PARTITION BY a.s, e.target ORDER BY e.source, e.id) = 1)",
        f"p_0 AS MATERIALIZED (SELECT *, level AS pl FROM {levelled})",
    ]
    for k in range(1, LEVELS + 1):
        parts += [
            f"l_{k} AS MATERIALIZED (SELECT DISTINCT source, target FROM p_{k - 1} WHERE pl <= {k})",
            f"r_{k} AS (SELECT source AS s, source AS t FROM l_{k} UNION SELECT target, target FROM l_{k} UNION SELECT r_{k}.s, l_{k}.target FROM r_{k} JOIN l_{k} ON l_{k}.source = r_{k}.t)",
            f"m_{k} AS MATERIALIZED (SELECT * FROM r_{k})",
            f"c_{k} AS MATERIALIZED (SELECT DISTINCT component FROM (SELECT a.s, min(a.t) AS component FROM m_{k} a JOIN m_{k} b ON a.s = b.t AND a.t = b.s GROUP BY a.s))",
            f"o_{k} AS MATERIALIZED (SELECT component AS s, coalesce(lead(component) OVER (ORDER BY component), (SELECT min(component) FROM c_{k})) AS t FROM c_{k})",
            f"w_{k} AS (SELECT s, t AS at FROM o_{k} WHERE s <> t UNION ALL SELECT w_{k}.s, via.u FROM w_{k} JOIN via ON via.s = w_{k}.s AND via.v = w_{k}.at WHERE w_{k}.at <> w_{k}.s)",
            f"h_{k} AS MATERIALIZED (SELECT DISTINCT via.id FROM w_{k} JOIN via ON via.s = w_{k}.s AND via.v = w_{k}.at)",
            f"p_{k} AS MATERIALIZED (SELECT id, source, target, cost, betweenness, level, CASE WHEN pl > {k} AND id IN (SELECT id FROM h_{k}) THEN {k} ELSE pl END AS pl FROM p_{k - 1})",
        ]
    return ", ".join([*parts, f"promoted AS MATERIALIZED (SELECT * FROM p_{LEVELS})"])


_PROMOTED = f"{_TRADE}, {_levels()}, {_promotion()}"
#: The largest strong component of the trade network, as the build cleans it.
_CLEAN = f"""ways AS ({TRADE}), all_edges AS MATERIALIZED ({_EDGES.format(w='ways')}),
  hub AS (SELECT source AS p FROM all_edges GROUP BY source ORDER BY count(*) DESC, source LIMIT 1),
  ahead AS (SELECT p AS n FROM hub UNION SELECT target FROM ahead JOIN all_edges ON source = n),
  behind AS (SELECT p AS n FROM hub UNION SELECT source FROM behind JOIN all_edges ON target = n),
  giant AS MATERIALIZED (SELECT n AS id FROM ahead INTERSECT SELECT n FROM behind),
  edges AS MATERIALIZED (SELECT * FROM all_edges WHERE source IN (SELECT id FROM giant) AND target IN (SELECT id FROM giant))"""
_BUILT = f"""{_CLEAN}, {_levels(9)}, {_promotion()},
  {_closure(_both_ways(f"SELECT k AS v, source, target FROM promoted, range(1, {LEVELS + 1}) r(k) WHERE pl > k"))}, parts AS MATERIALIZED ({_WEAK}), {_RANKED},
  on_skeleton AS MATERIALIZED (SELECT DISTINCT k AS v, node FROM (SELECT source AS node, pl FROM promoted UNION ALL SELECT target, pl FROM promoted), range(1, {LEVELS + 1}) r(k) WHERE pl <= k),
  {_NODES},
  edge_labels AS MATERIALIZED (SELECT e.id, e.source, e.target, e.cost, e.pl, r.k, CASE WHEN e.pl > r.k THEN p.nth + 1 ELSE 1 END AS label FROM promoted e CROSS JOIN range(1, {LEVELS + 1}) r(k) LEFT JOIN ranked p ON p.v = r.k AND p.node = e.target),
  vertex_labels AS MATERIALIZED (SELECT n.id, r.k, coalesce(p.nth + 1, 1) AS label FROM nodes n CROSS JOIN range(1, {LEVELS + 1}) r(k) LEFT JOIN (SELECT * FROM ranked WHERE NOT EXISTS (SELECT 1 FROM on_skeleton o WHERE o.v = ranked.v AND o.node = ranked.node)) p ON p.v = r.k AND p.node = n.id)"""


def _drawn(n: int, seed: int) -> str:
    """pairs(source, target) as the benchmark draws them."""
    draw = lambda k: f"SELECT id, row_number() OVER (ORDER BY md5(concat_ws(':', id, {seed}, {k})), id) AS place FROM nodes QUALIFY place <= {n}"
    return f"pairs AS MATERIALIZED (SELECT a.id AS source, b.id AS target FROM ({draw(0)}) a JOIN ({draw(1)}) b USING (place) WHERE a.id <> b.id)"


_ROUTES = f"""{_BUILT}, {_drawn(20, 1)},
  asks AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source, target, k) AS ask, source AS s, target AS t, k, cs, ct FROM (
    SELECT p.source, p.target, a.k, a.label AS cs, b.label AS ct FROM pairs p JOIN vertex_labels a ON a.id = p.source JOIN vertex_labels b ON b.id = p.target AND b.k = a.k)),
  routed AS MATERIALIZED (SELECT a.ask, e.source, e.target, e.cost FROM asks a JOIN edge_labels e ON e.k = a.k WHERE a.k = {LEVELS} OR e.pl <= a.k OR e.label IN (a.cs, a.ct)),
  counts AS (SELECT ask, count(*) AS num_edges FROM routed GROUP BY ask),
  met AS (SELECT ask, count(DISTINCT v) AS num_vertices FROM (SELECT ask, source AS v FROM routed UNION ALL SELECT ask, target FROM routed) GROUP BY ask),
  near AS MATERIALIZED (SELECT ask, source, target, min(cost) AS cost FROM routed GROUP BY ALL),
  far(ask, node, x) USING KEY (ask, node) AS (SELECT ask, s, CAST(0 AS DOUBLE) FROM asks UNION
    SELECT n.ask, n.node, n.x FROM (SELECT f.ask, l.target AS node, min(f.x + l.cost) AS x FROM far f JOIN near l ON l.ask = f.ask AND l.source = f.node GROUP BY f.ask, l.target) n
    LEFT JOIN recurring.far r ON r.ask = n.ask AND r.node = n.node WHERE r.node IS NULL OR n.x < r.x),
  found AS MATERIALIZED (SELECT a.s AS source, a.t AS target, CAST(a.k AS INTEGER) AS level, CAST(num_edges AS INTEGER) AS num_edges, CAST(num_vertices AS INTEGER) AS num_vertices, x AS path_len
    FROM asks a JOIN counts USING (ask) JOIN met USING (ask) LEFT JOIN far ON far.ask = a.ask AND far.node = a.t)"""

_SAMPLE = "nodes AS (SELECT source AS id FROM edges UNION SELECT target FROM edges), drawn AS MATERIALIZED (SELECT id FROM nodes QUALIFY row_number() OVER (ORDER BY md5(concat_ws(':', id, 0)), id) <= ceil(sqrt((SELECT count(*) FROM nodes))))"
_DIGITS = "SELECT id, source, target, CAST(printf('%g', cost / 7) AS DOUBLE) AS betweenness FROM edges"

ORACLE_SQL |= {
    "betweenness_sequential": ORACLE_SQL["betweenness"],
    "betweenness_sampled": f"WITH {_TRADE}, {_SAMPLE}, {_betweenness(6, 'AND a.s IN (SELECT id FROM drawn)', '(SELECT count(*) FROM nodes) / (SELECT count(*) FROM drawn)')} SELECT id, source, target, cost, betweenness FROM betw",
    "promoted_levels": f"WITH RECURSIVE {_PROMOTED} SELECT id, source, target, level, CAST(pl AS INTEGER) AS promoted_level FROM promoted",
    "promotions": f"WITH RECURSIVE {_PROMOTED} SELECT CAST(pl AS INTEGER) AS level, count(*) AS rows, count(*) FILTER (WHERE level > pl) AS promoted FROM promoted GROUP BY pl",
    "hierarchy_edges": f"""WITH RECURSIVE {_BUILT} SELECT e.id, e.source, e.target, e.cost, round(e.betweenness, 6) AS betweenness, e.level, CAST(e.pl AS INTEGER) AS promoted_level, l.component
      FROM promoted e JOIN (SELECT id, source, target, string_agg(CAST(label AS VARCHAR), ',' ORDER BY k) AS component FROM edge_labels GROUP BY id, source, target) l USING (id, source, target)""",
    "hierarchy_vertices": f"WITH RECURSIVE {_BUILT} SELECT id, string_agg(CAST(label AS VARCHAR), ',' ORDER BY k) AS component FROM vertex_labels GROUP BY id",
    "hierarchy_catalog": f"""WITH RECURSIVE {_BUILT},
      sized AS (SELECT p.v, p.component, count(*) AS num_nodes, count(o.node) AS num_border_nodes FROM parts p LEFT JOIN on_skeleton o ON o.v = p.v AND o.node = p.node GROUP BY ALL),
      lines AS (SELECT p.v, p.component, count(*) AS num_edges FROM promoted e JOIN parts p ON e.pl > p.v AND p.node = e.target GROUP BY ALL)
      SELECT component AS id, CAST(v AS INTEGER) AS level, CAST(num_nodes AS INTEGER) AS num_nodes, CAST(num_edges AS INTEGER) AS num_edges, CAST(num_border_nodes AS INTEGER) AS num_border_nodes FROM sized JOIN lines USING (v, component)""",
    "hier_route_pairs": f"WITH RECURSIVE {_ROUTES} SELECT * FROM found",
    "hier_route_quality": f"""WITH RECURSIVE {_ROUTES} SELECT f.level, count(*) AS pairs, count(*) FILTER (WHERE f.path_len = x.path_len) AS exact_pairs, round(avg(f.num_edges / x.num_edges), 6) AS edge_share, round(avg(f.path_len / x.path_len), 6) AS stretch
      FROM found f JOIN found x ON x.source = f.source AND x.target = f.target AND x.level = {LEVELS} GROUP BY f.level""",
    "route_timings": f"WITH RECURSIVE {_CLEAN}, {_NODES}, {_drawn(20, 1)} SELECT source, target, CAST({LEVELS} AS INTEGER) AS level, true AS timed FROM pairs",
    "build_notices": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'levels'), (2, 'promotion'), (3, 'labels'), (4, 'checks')) n(place, stage)",
    "skeleton_scc": f"WITH RECURSIVE {_TRADE}, {_levels()}, {_closure(f'SELECT k AS v, source, target FROM levelled, range(1, {LEVELS + 1}) r(k) WHERE level <= k')} SELECT CAST(v AS INTEGER) AS level, node, component FROM ({_MUTUAL})",
    "component_lists": f"WITH RECURSIVE {_PARTS}, placed AS (SELECT v, component, node, (row_number() OVER (PARTITION BY v, component ORDER BY node) - 1) // 50 AS part FROM parts) SELECT CAST(v AS INTEGER) AS level, component, part, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS nodes FROM placed GROUP BY v, component, part",
    "ragged_lines": f"""WITH {_STREETS}, kinds AS (SELECT *, gid % 9 AS k FROM ways), read AS (
        SELECT gid AS id, source, target, CASE k WHEN 4 THEN 12 WHEN 5 THEN 0 ELSE cost END AS cost, CASE WHEN k IN (2, 3, 4, 5) THEN -1 ELSE reverse_cost END AS reverse_cost FROM kinds WHERE k NOT IN (0, 1, 6))
      SELECT id, source, target, cost FROM read WHERE cost >= 0 UNION ALL SELECT id, target, source, reverse_cost FROM read WHERE reverse_cost >= 0""",
    "six_digit_file": f"WITH {_TRADE} {_DIGITS}",
    "printed_results": f"WITH {_TRADE} SELECT id, source, target, concat('id: ', id, ', source: ', source, ', target: ', target, ', betweenness: ', printf('%g', cost * cost * cost * cost * cost / 7)) AS line FROM edges",
    "vertex_components": f"WITH {_TRADE}, rows AS (SELECT source AS id, max(CAST(cost AS INTEGER)) AS most, min(CAST(cost AS INTEGER)) AS least FROM edges WHERE cost >= 12 GROUP BY source), {_NODES} SELECT id, CASE WHEN least IS NULL THEN '' ELSE concat(least, ',', least + 1) END AS component FROM nodes LEFT JOIN rows USING (id)",
    "geometry_edges": f"WITH RECURSIVE {_GIANT} SELECT id, source, target, concat('line ', id) AS geom FROM edges WHERE source IN (SELECT id FROM giant) AND target IN (SELECT id FROM giant)",
    "geometry_vertices": f"WITH RECURSIVE {_GIANT} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE concat('point ', id) END AS geom FROM giant",
    "replaced_table": f"WITH {_TRADE} SELECT id, source, target, cost, CAST(source % 4 AS INTEGER) AS part FROM edges WHERE cost >= 12",
    "suppliers_by_jdbc": "SELECT CAST(s_suppkey AS BIGINT) + 1 AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier",
}
