"""Views over the fact log and composed reads: what a caller of the engine asks for by one name.

In the examples an entity is a nation, its aliases are the nations of its region and the smallest key represents them; a character
is a customer, a record a conversation, an event an entry of the log.
"""

from __future__ import annotations

from storyspark.operators import facts, graphs, text_metrics, vectors
from storyspark.operators.facts import LOG, _q
from storyspark.plans.dialect import Dialect

_PARTS = text_metrics.QUERIES | facts.QUERIES | graphs.QUERIES | vectors.QUERIES

#: Each nation with its representative.
REP = "rep AS (SELECT n_nationkey AS id, n_name AS name, CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS rep FROM @nation)"
#: Customers that references admit.
ADMITTED = "adm AS (SELECT c_custkey, c_name, c_nationkey FROM @customer WHERE lower(c_mktsegment) NOT IN ('machinery', 'household'))"


def part(d: Dialect, name: str) -> str:
    """Another query as a relation."""
    return f"({_PARTS[name](d)})"


QUERIES = {
    # views of facts
    "annotation_shape": lambda d: f"SELECT event_id, user_id, CASE WHEN value > 25 THEN 'observation' WHEN {d.json_int('props', 'k')} IS NOT NULL THEN 'mention' ELSE 'empty' END AS shape FROM @events e WHERE EXISTS (SELECT 1 FROM @customer c WHERE c.c_custkey = e.user_id)",
    "earliest_evidence": lambda d: f"WITH {LOG} SELECT entity, kind, {d.any_min('ch', d.struct('ts', 'event_id'))} AS first_chapter, min(event_id) AS first_event FROM log GROUP BY entity, kind",
    "foreshadow_edges": lambda d: f"WITH {LOG}, e AS (SELECT event_id AS source, kind, lead(event_id) OVER (PARTITION BY entity ORDER BY ts, event_id) AS target FROM log) SELECT e.source, e.target, s.ch AS source_chapter, coalesce(t.ch, 0) AS target_chapter FROM e LEFT JOIN log s ON e.source = s.event_id LEFT JOIN log t ON e.target = t.event_id WHERE e.kind = 'view'",
    "saved_outputs": lambda d: f"WITH r AS (SELECT DISTINCT conv_id, role FROM @conversations) SELECT conv_id, {d.strings('role', 'role')} AS roles, count(*) = 2 AS complete FROM r GROUP BY conv_id",
    "annotation_bundle": lambda d: f"WITH r AS (SELECT conv_id, turn, concat({d.string('turn')}, ':', role) AS item FROM @conversations WHERE role IS NOT NULL OR text IS NOT NULL) SELECT conv_id, count(*) AS n_children, {d.strings('item', 'turn')} AS children FROM r GROUP BY conv_id",
    "character_observations": lambda d: f"WITH {ADMITTED}, {LOG} SELECT a.c_custkey, a.c_name, l.event_id, l.ch, l.kind FROM adm a JOIN log l ON l.entity = a.c_custkey WHERE l.value IS NOT NULL",
    "character_last_score": lambda d: f"WITH {ADMITTED}, s AS (SELECT user_id, {d.any_max('value', d.struct('ts', 'event_id'))} AS last_score, count(value) AS n_scores FROM @events GROUP BY user_id) SELECT a.c_custkey, a.c_name, coalesce(s.last_score, 0) AS last_score, coalesce(s.n_scores, 0) AS n_scores FROM adm a LEFT JOIN s ON s.user_id = a.c_custkey",
    "character_relations": lambda d: f"WITH {d.edges()}, k AS (SELECT DISTINCT c_nationkey AS id FROM @customer WHERE c_mktsegment = 'BUILDING') SELECT a, b, w FROM edge WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k)",
    "canonical_entities": lambda d: f"WITH {REP} SELECT r.rep AS entity, max(o.name) AS name, {d.strings('r.name', 'r.id')} AS aliases FROM rep r JOIN rep o ON o.id = r.rep GROUP BY r.rep",
    "confirmed_relations": lambda d: f"WITH {REP}, {d.edges()}, m AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, w FROM edge e JOIN rep x ON e.a = x.id JOIN rep y ON e.b = y.id) SELECT a, b, count(*) AS merged, CAST(sum(w) AS BIGINT) AS support FROM m GROUP BY a, b",
    "timeline_authority": lambda d: f"WITH {facts.FOLD} SELECT 'state' AS source, entity, after AS detail, count(*) AS n, min(event_id) AS first_event FROM fold WHERE before IS NOT NULL AND before <> after GROUP BY entity, after UNION ALL SELECT 'relation' AS source, c_nationkey AS entity, c_mktsegment AS detail, count(*) AS n, min(c_custkey) AS first_event FROM @customer GROUP BY c_nationkey, c_mktsegment",
    "participant_states": lambda d: f"WITH {ADMITTED}, s AS (SELECT o_custkey, {d.any_max('o_orderstatus', d.struct('o_orderdate', 'o_orderkey'))} AS status FROM @orders GROUP BY o_custkey) SELECT a.c_custkey, a.c_name, s.status FROM adm a JOIN s ON s.o_custkey = a.c_custkey",
    "relation_exports": lambda d: f"WITH {REP}, {d.edges()} SELECT x.name AS from_name, y.name AS to_name, w FROM edge e JOIN rep x ON e.a = x.id JOIN rep y ON e.b = y.id WHERE x.name IN (SELECT n_name FROM @nation WHERE n_regionkey <> 0) AND y.name IN (SELECT n_name FROM @nation WHERE n_regionkey <> 0)",
    "plotline_evidence": _q("SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN o.o_orderstatus = 'O' THEN 'relation' END, CASE WHEN l.l_returnflag = 'R' THEN 'plotline' END, 'entity') AS owner_kind, substr(o.o_orderpriority, 3, 6) AS quote FROM @lineitem l JOIN @orders o ON l.l_orderkey = o.o_orderkey"),
    "plotline_merge": lambda d: f"WITH {LOG} SELECT ch, 'fact' AS source, event_id AS id, kind FROM log WHERE kind IN ('purchase', 'signup') UNION ALL SELECT ch, 'note' AS source, event_id AS id, kind FROM log WHERE kind = 'error'",
    "event_load": lambda d: f"WITH {LOG} SELECT entity, min(event_id) AS first_position, max(event_id) AS last_position, count(*) AS events, count(CASE WHEN kind = 'purchase' THEN 1 END) AS outcomes, count(CASE WHEN kind = 'error' THEN 1 END) AS breaks FROM log GROUP BY entity",
    "contract_violations": _q("SELECT (SELECT count(*) FROM @lineitem l WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_orderkey = l.l_orderkey)) AS without_order, (SELECT count(*) FROM @orders o WHERE NOT EXISTS (SELECT 1 FROM @customer c WHERE c.c_custkey = o.o_custkey)) AS without_customer, (SELECT count(*) FROM @lineitem WHERE l_quantity IS NULL OR l_quantity <= 0) AS bad_range"),
    "organisation_check": lambda d: f"SELECT (SELECT count(*) FROM (SELECT event_id FROM @events GROUP BY event_id HAVING count(*) > 1) t) AS repeated_ids, (SELECT count(*) FROM @events e WHERE e.event_id >= 10 AND NOT EXISTS (SELECT 1 FROM @events p WHERE p.event_id = {d.idiv('e.event_id', '10')})) AS missing_parents, (SELECT count(*) FROM @events WHERE event_id >= 10 AND {d.idiv('event_id', '10')} >= event_id) AS not_rising",
    "diagnosis_payload": lambda d: "SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END AS report FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id",
    "known_characters": lambda d: f"WITH {REP}, n AS (SELECT rep, count(*) AS aliases FROM rep GROUP BY rep) SELECT r.id, concat(r.name, ' (', {d.string('n.aliases - 1')}, ' aliases)') AS shown FROM rep r JOIN n ON n.rep = r.id",
    "tool_call_reads": lambda d: f"SELECT event_id, user_id, {d.json_int('props', 'k')} AS argument, value FROM @events e WHERE event_type = 'click' AND user_id IN (SELECT c_custkey FROM @customer)",
    "tag_union": lambda d: f"WITH {REP}, t AS (SELECT DISTINCT r.rep, c.c_mktsegment AS tag FROM @customer c JOIN rep r ON c.c_nationkey = r.id) SELECT rep AS entity, {d.strings('tag', 'tag')} AS tags FROM t GROUP BY rep",
    "participant_projection": lambda d: f"WITH {REP} SELECT DISTINCT r.rep AS entity, c.c_mktsegment AS role, CASE WHEN c.c_acctbal >= 0 THEN 'solvent' ELSE 'owing' END AS status FROM @customer c JOIN rep r ON c.c_nationkey = r.id",
    "arc_roster": lambda d: "WITH a AS (SELECT user_id, count(DISTINCT CASE WHEN value > 40 THEN event_type END) AS leads FROM @events GROUP BY user_id) SELECT user_id, leads, CASE WHEN leads = 1 THEN 'single' WHEN leads = 2 THEN 'dual' WHEN leads >= 3 THEN 'ensemble' END AS roster FROM a",
    "instruction_prefix": _q("SELECT conv_id, turn, concat('Instruct: find passages that answer the query', chr(10), 'Query: ', text) AS query_text FROM @conversations WHERE role = 'user'"),
    "first_arguments": lambda d: f"SELECT conv_id, {d.any_min('CASE WHEN role = ' + repr('user') + ' THEN turn END', 'CASE WHEN role = ' + repr('user') + ' THEN turn END')} AS agent, {d.any_min('CASE WHEN role = ' + repr('assistant') + ' THEN turn END', 'CASE WHEN role = ' + repr('assistant') + ' THEN turn END')} AS receiver, count(*) AS degree FROM @conversations GROUP BY conv_id",
    "chapter_continuity": lambda d: f"WITH {LOG}, c AS (SELECT DISTINCT entity, ch FROM log), g AS (SELECT entity, ch, ch - lag(ch) OVER (PARTITION BY entity ORDER BY ch) AS delta FROM c) SELECT entity, ch, delta, round(CASE WHEN delta BETWEEN 1 AND 100 THEN 1.1e0 WHEN delta < 0 THEN 0.8e0 ELSE 1e0 END, 1) AS weight FROM g",
    # composed reads
    "api_chapter_metrics": lambda d: f"SELECT c.*, r.chapters, r.net_density AS book_net_density, r.positive_share FROM {part(d, 'chapter_metrics')} c JOIN {part(d, 'book_rollup')} r ON c.doc_id = r.doc_id",
    "api_characters": lambda d: f"SELECT r.user_id, r.appearances, r.dominant_role, f.focus FROM {part(d, 'character_ranking')} r JOIN {part(d, 'focus_score')} f ON r.user_id = f.user_id ORDER BY r.appearances DESC, r.user_id LIMIT 15",
    "api_topics": lambda d: f"SELECT b.topic, b.weight, e.net, CASE WHEN t.topic IS NULL THEN 0 ELSE 1 END AS top FROM {part(d, 'topic_book')} b JOIN {part(d, 'topic_emotion')} e ON b.topic = e.topic LEFT JOIN {part(d, 'topic_topn')} t ON b.topic = t.topic",
    "api_graph": lambda d: f"SELECT n.node, n.name, g.degree, g.centrality, w.strength FROM {part(d, 'representative_view')} n JOIN {part(d, 'degree_centrality')} g ON n.node = g.node JOIN {part(d, 'weighted_degree')} w ON n.node = w.node",
    "api_timeline": lambda d: f"SELECT s.entity, s.kind, coalesce(c.n, 0) AS changes FROM {part(d, 'latest_state')} s LEFT JOIN (SELECT entity, CAST(sum(changes) AS BIGINT) AS n FROM {part(d, 'relation_change_fold')} f GROUP BY entity) c ON s.entity = c.entity",
    "api_metrics": lambda d: f"SELECT g.doc_id, g.max_net, g.min_net, g.mean_net, z.zero_hit_share, t.trend FROM {part(d, 'global_stats')} g JOIN {part(d, 'zero_hit_share')} z ON g.doc_id = z.doc_id JOIN {part(d, 'trend_class')} t ON g.doc_id = t.doc_id",
    "api_linguistic": lambda d: f"SELECT l.doc_id, l.tokens, l.types, l.ttr, w.mean_word_length, p.exclaim, p.question FROM {part(d, 'lexical_diversity')} l JOIN {part(d, 'word_length')} w ON l.doc_id = w.doc_id JOIN {part(d, 'punctuation_density')} p ON l.doc_id = p.doc_id",
    "api_small_sample": lambda d: f"WITH c AS (SELECT doc_id, count(*) AS n, round(avg(tension), 6) AS mean_tension FROM {part(d, 'chapter_tension')} t GROUP BY doc_id) SELECT doc_id, n, CASE WHEN n >= 10 THEN mean_tension END AS mean_tension FROM c",
}
