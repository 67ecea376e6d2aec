"""Graph queries over the character graph and the containment forest."""

from __future__ import annotations

from storyspark.plans.dialect import Dialect

#: Each node with its neighbours, both ways.
BOTH = "both_ways AS (SELECT a AS u, b AS v, w FROM edge UNION ALL SELECT b AS u, a AS v, w FROM edge), deg AS (SELECT u, count(*) AS d, sum(w) AS strength FROM both_ways GROUP BY u)"


def _g(sql):
    return lambda d: f"WITH {d.edges()}, {BOTH} {sql}"


def containment(d: Dialect) -> str:
    """Root and depth of every event in a tree of parents event_id // 10."""
    return f"""WITH RECURSIVE up AS (SELECT event_id AS id, event_id AS node, 0 AS depth FROM @events
UNION ALL SELECT id, {d.idiv('node', '10')} AS node, depth + 1 AS depth FROM up WHERE node >= 10)
SELECT id, CAST(min(node) AS BIGINT) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id"""


QUERIES = {
    "graph_snapshot": _g("SELECT a, b, w FROM edge"),
    "degree_centrality": _g("SELECT u AS node, d AS degree, round(CAST(d AS DOUBLE) / ((SELECT count(*) FROM deg) - 1), 6) AS centrality FROM deg"),
    "weighted_degree": _g("SELECT u AS node, CAST(strength AS BIGINT) AS strength FROM deg"),
    "centralisation": _g("SELECT count(*) AS nodes, CASE WHEN count(*) > 2 THEN round(CAST(max(d) * count(*) - sum(d) AS DOUBLE) / ((count(*) - 1) * (count(*) - 2)), 6) END AS centralisation FROM deg"),
    "clustering": lambda d: f"WITH {d.edges()}, strong AS (SELECT a, b FROM edge WHERE w >= (SELECT avg(w) FROM edge)), bw AS (SELECT a AS u, b AS v FROM strong UNION ALL SELECT b AS u, a AS v FROM strong), dg AS (SELECT u, count(*) AS d FROM bw GROUP BY u), tri AS (SELECT x.u, count(*) AS t FROM bw x JOIN bw y ON x.u = y.u AND x.v < y.v JOIN strong s ON s.a = x.v AND s.b = y.v GROUP BY x.u) SELECT round(avg(CASE WHEN d > 1 THEN 2e0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0e0 END), 6) AS clustering FROM dg LEFT JOIN tri ON dg.u = tri.u",
    "relation_conflicts": lambda d: "WITH r AS (SELECT least(c_nationkey, c_custkey % 25) AS a, greatest(c_nationkey, c_custkey % 25) AS b, c_mktsegment AS kind FROM @customer) SELECT a, b, count(DISTINCT kind) AS kinds FROM r WHERE a <> b GROUP BY a, b HAVING count(DISTINCT kind) >= 2",
    "graph_summary": _g("SELECT (SELECT count(*) FROM deg) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT CAST(max(w) AS BIGINT) FROM edge) AS heaviest"),
    "graph_quality": _g("SELECT least(count(CASE WHEN w < 5 THEN 1 END), 20) AS weak_edges, count(*) AS edges FROM edge"),
    "representative_view": _g("SELECT n.n_nationkey AS node, n.n_name AS name FROM @nation n WHERE EXISTS (SELECT 1 FROM deg WHERE deg.u = n.n_nationkey)"),
    "containment_roots": containment,
    "tree_degrees": lambda d: f"SELECT {d.idiv('event_id', '10')} AS parent, count(*) AS children FROM @events WHERE event_id >= 10 GROUP BY {d.idiv('event_id', '10')}",
    "top_level_page": lambda d: f"SELECT event_id FROM @events e WHERE NOT EXISTS (SELECT 1 FROM @events p WHERE p.event_id = {d.idiv('e.event_id', '10')} AND e.event_id >= 10) ORDER BY event_id LIMIT 20",
    "single_parent_check": lambda d: f"SELECT count(*) AS violations FROM (SELECT event_id FROM (SELECT event_id, {d.idiv('event_id', '10')} AS parent FROM @events) t GROUP BY event_id HAVING count(DISTINCT parent) > 1) v",
    "event_tree_counts": lambda d: "SELECT count(*) AS events, count(DISTINCT user_id) AS trees, count(DISTINCT event_type) AS kinds FROM @events",
    "event_timeline_levels": lambda d: "WITH s AS (SELECT user_id, round(0.4 * count(*) / 100 + 0.3 * avg(value) / 50, 2) AS importance FROM @events GROUP BY user_id), q AS (SELECT user_id, importance, row_number() OVER (ORDER BY importance, user_id) AS i, count(*) OVER () AS n FROM s), c AS (SELECT max(CASE WHEN i = CAST(floor(n * 66 / 100) AS BIGINT) + 1 THEN importance END) AS hi, max(CASE WHEN i = CAST(floor(n * 33 / 100) AS BIGINT) + 1 THEN importance END) AS lo FROM q) SELECT user_id, importance, CASE WHEN importance >= hi THEN 'major' WHEN importance >= lo THEN 'minor' ELSE 'detail' END AS level FROM q CROSS JOIN c",
    "causal_edges": lambda d: "SELECT event_id AS source, nxt AS target FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, EXTRACT(DAY FROM ts) AS ch FROM @events) t WHERE nxt IS NOT NULL AND ch <= 20",
    "event_search": lambda d: "SELECT event_id, event_type FROM @events WHERE lower(concat(event_type, ' ', props)) LIKE '%purch%' ORDER BY event_id LIMIT 50",
}
