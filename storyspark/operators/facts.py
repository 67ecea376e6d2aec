"""Relational reads and the event-sourced fact log: joins, as-of states, folds, paging, set operations, usage statistics.

In the examples the log is ``events``: an entity is a user, the change kind is the event type, the order is (ts, event_id).
"""

from __future__ import annotations

import hashlib

from storyspark.operators.text_metrics import ratio
from storyspark.plans.dialect import Dialect

#: The log in order, with a chapter (day) of each entry.
LOG = "log AS (SELECT event_id, user_id AS entity, event_type AS kind, value, ts, CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS ch FROM @events)"


#: The fraction that a key draws: the first 64 bits of its SHA-256.
FRACTION = int(hashlib.sha256(b"run-1").hexdigest()[:16], 16) / 2**64


def _q(sql):
    return lambda d: sql


def asof_state(d: Dialect) -> str:
    """Newest state of each entity at the boundary of day 15."""
    return f"WITH {LOG} SELECT entity, {d.any_max('kind', d.struct('ts', 'event_id'))} AS kind, {d.any_max('value', d.struct('ts', 'event_id'))} AS value, max(event_id) AS last_event FROM log WHERE ch <= 15 GROUP BY entity"


FOLD = f"{LOG}, fold AS (SELECT event_id, entity, ch, ts, kind AS after, lag(kind) OVER (PARTITION BY entity ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS support FROM log)"

#: Weights of a model's health (all turns: successes, tokens, tokens a turn, time a turn, turns; recent turns: successes, failures, tokens a turn), what halves the parts of tokens and time, and the turns from which a model counts as known.
HEALTH = {"total_success": 0.05, "recent_success": 0.20, "recent_failure": 0.45, "total_token": 0.05, "avg_token": 0.05, "recent_token": 0.05, "time": 0.10, "turns": 0.05}
TOKENS, TOKENS_A_TURN, MS_A_TURN, KNOWN = 2e6, 2e4, 3e4, 50
#: Minutes that are recent, turns of a model that are kept, most points for idle minutes.
RECENT, KEPT, IDLE = 30, 1000, 30


def health(d: Dialect) -> str:
    """Health of each model at the end of the log, 0 to 100: eight weighted parts over all and over recent turns, and a point for each idle minute.

    In the examples a model is a user, a turn fails that is an error, its tokens are a hundred times its value and its time a second for each unit.
    """
    parts = {
        "total_success": "ok / CAST(n AS DOUBLE)", "recent_success": "CASE WHEN rn = 0 THEN 1e0 ELSE rok / CAST(rn AS DOUBLE) END", "recent_failure": "CASE WHEN rn = 0 THEN 1e0 ELSE 1 - (rn - rok) / CAST(rn AS DOUBLE) END",
        "total_token": f"1 / (1 + tokens / {TOKENS})", "avg_token": f"1 / (1 + tokens / n / {TOKENS_A_TURN})", "recent_token": f"1 / (1 + CASE WHEN rn = 0 THEN 0e0 ELSE rtokens / rn END / {TOKENS_A_TURN})", "time": f"1 / (1 + ms / n / {MS_A_TURN})", "turns": f"least(1e0, n / CAST({KNOWN} AS DOUBLE))",
    }
    weighted = " + ".join(f"CAST({HEALTH[k]} AS DOUBLE) * ({x})" for k, x in parts.items())
    kept = f"nth <= {KEPT} AND tm >= now - {RECENT * 60_000_000}"
    return f"""WITH t AS (SELECT user_id, event_type <> 'error' AS good, greatest(coalesce(floor(value * 100), 0e0), 0e0) AS tok, greatest(coalesce(floor(value * 1000), 0e0), 0e0) AS took, {d.micros('ts')} AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM @events),
a AS (SELECT t.*, (SELECT max({d.micros('ts')}) FROM @events) AS now FROM t),
s AS (SELECT user_id, count(*) AS n, count(CASE WHEN good THEN 1 END) AS ok, sum(tok) AS tokens, sum(took) AS ms, count(CASE WHEN {kept} THEN 1 END) AS rn, count(CASE WHEN {kept} AND good THEN 1 END) AS rok, coalesce(sum(CASE WHEN {kept} THEN tok END), 0e0) AS rtokens, max(now) - max(tm) AS idle FROM a GROUP BY user_id)
SELECT user_id, n, rn, round(greatest(0e0, least(1e2, round(({weighted}) * 100 + least({IDLE}e0, idle / 6e7), 9))), 1) AS score FROM s"""


QUERIES = {
    # joins
    "chapter_body_join": _q("SELECT o.o_orderkey, o.o_custkey, c.c_name FROM @orders o LEFT JOIN @customer c ON o.o_custkey = c.c_custkey"),
    "metric_left_join": _q("SELECT d.doc_id, l.quality, l.toxic FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id"),
    "feature_code_join": _q("SELECT d.doc_id, l.quality FROM @documents d LEFT JOIN @labels l ON d.doc_id = l.doc_id AND l.toxic = 0"),
    "star_join": _q("SELECT n.n_name, r.r_name, count(*) AS n, CAST(sum(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM @lineitem l JOIN @orders o ON l.l_orderkey = o.o_orderkey JOIN @customer c ON o.o_custkey = c.c_custkey JOIN @nation n ON c.c_nationkey = n.n_nationkey JOIN @region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name"),
    "six_way_join": _q("SELECT p.p_brand, n.n_name, count(*) AS n FROM @lineitem l JOIN @part p ON l.l_partkey = p.p_partkey JOIN @supplier s ON l.l_suppkey = s.s_suppkey JOIN @nation n ON s.s_nationkey = n.n_nationkey JOIN @region r ON n.n_regionkey = r.r_regionkey JOIN @orders o ON l.l_orderkey = o.o_orderkey WHERE r.r_name LIKE 'A%' GROUP BY p.p_brand, n.n_name"),
    "mixed_outer_join": _q("SELECT e.event_id, coalesce(c.c_name, 'unknown') AS name, o.o_orderkey FROM @events e LEFT JOIN @customer c ON e.user_id = c.c_custkey LEFT JOIN @orders o ON e.event_id = o.o_orderkey WHERE c.c_custkey IS NOT NULL OR o.o_orderkey IS NOT NULL"),
    "semi_join": _q("SELECT c_custkey, c_name FROM @customer WHERE c_custkey IN (SELECT o_custkey FROM @orders WHERE o_orderstatus = 'O')"),
    "anti_join": _q("SELECT c_custkey, c_name FROM @customer c WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_custkey = c.c_custkey)"),
    "missing_embeddings": lambda d: f"SELECT DISTINCT id FROM (SELECT d.doc_id AS id FROM @documents d WHERE NOT EXISTS (SELECT 1 FROM @embeddings e WHERE e.vec_id = d.doc_id) UNION ALL SELECT vec_id AS id FROM @embeddings WHERE embedding IS NULL) t",
    "unreferenced_rows": _q("SELECT p_partkey FROM @part p WHERE NOT EXISTS (SELECT 1 FROM @lineitem l WHERE l.l_partkey = p.p_partkey)"),
    "latest_status": _q("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM @orders) t WHERE rn = 1"),
    "inner_hash_join": _q("SELECT d.doc_id, l.quality, CAST(length(d.text) AS BIGINT) AS chars FROM @documents d JOIN @labels l ON d.doc_id = l.doc_id"),
    "first_row_alignment": _q("SELECT c.conv_id, f.text AS first_text, count(*) AS turns FROM @conversations c JOIN (SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM @conversations) x WHERE rn = 1) f ON c.conv_id = f.conv_id GROUP BY c.conv_id, f.text"),
    "graph_asof": asof_state,
    "asof_boundary": lambda d: f"WITH {LOG}, b AS (SELECT max(ch) AS b FROM log WHERE kind = 'signup') SELECT entity, count(*) AS n FROM log JOIN b ON ch <= b GROUP BY entity",
    "asof_per_row": lambda d: f"WITH {LOG}, m AS (SELECT event_id, entity, kind, max(CASE WHEN kind = 'purchase' THEN event_id END) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_event FROM log) SELECT event_id, entity, state_event FROM m WHERE kind = 'error'",
    "point_in_span": lambda d: f"WITH s AS ({d.explode('doc_id', d.lines('text'), '@documents', 'pid', 'txt')}), o AS (SELECT doc_id, pid, sum(length(txt)) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, length(txt) AS n FROM s) SELECT l.doc_id, o.pid FROM @labels l JOIN o ON l.doc_id = o.doc_id AND 100 >= o.e - o.n AND 100 < o.e",
    "interval_overlap": _q("WITH iv AS (SELECT o_custkey AS k, min(o_orderkey) AS s, max(o_orderkey) AS e FROM @orders GROUP BY o_custkey) SELECT a.k, count(*) AS overlaps FROM iv a JOIN iv b ON a.k <> b.k AND b.s < a.e AND b.e > a.s GROUP BY a.k"),
    "alias_rewrite": _q("WITH rep AS (SELECT n_nationkey AS id, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS rep FROM @nation) SELECT coalesce(r.rep, c.c_nationkey) AS entity, count(*) AS n FROM @customer c LEFT JOIN rep r ON c.c_nationkey = r.id GROUP BY coalesce(r.rep, c.c_nationkey)"),
    "preferred_alias": lambda d: f"SELECT n_regionkey, {d.any_min('n_name', 'n_nationkey')} AS preferred FROM @nation GROUP BY n_regionkey",
    "dangling_references": _q("SELECT e.event_id FROM @events e WHERE EXISTS (SELECT 1 FROM @customer c WHERE c.c_custkey = e.user_id)"),
    # event log
    "graph_changes": lambda d: f"WITH {FOLD} SELECT event_id, entity, before, after, CAST(support AS BIGINT) AS support FROM fold WHERE before IS NULL OR before <> after",
    "graph_changes_page": lambda d: f"WITH {FOLD} SELECT event_id, entity, before, after FROM fold WHERE before IS NULL OR before <> after ORDER BY ch DESC, after, event_id LIMIT 50 OFFSET 100",
    "entity_delta_fold": lambda d: f"WITH f AS (SELECT event_id, user_id AS entity, {d.json_int('props', 'k')} AS v, ts FROM @events), g AS (SELECT event_id, entity, v AS after, lag(v) OVER (PARTITION BY entity ORDER BY ts, event_id) AS before FROM f) SELECT event_id, entity, before, after FROM g WHERE before IS NOT NULL AND before <> after",
    "relation_change_fold": lambda d: f"WITH {FOLD} SELECT entity, after, count(*) AS changes FROM fold WHERE before IS NOT NULL AND before <> after GROUP BY entity, after",
    "latest_state": lambda d: f"WITH {LOG} SELECT entity, {d.any_max('kind', d.struct('ts', 'event_id'))} AS kind FROM log GROUP BY entity",
    "state_runs": lambda d: f"WITH {FOLD}, r AS (SELECT entity, after, ts, event_id, sum(CASE WHEN before IS NULL OR before <> after THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM fold) SELECT entity, CAST(island AS BIGINT) AS island, after AS kind, count(*) AS length, min(event_id) AS first_event FROM r GROUP BY entity, island, after",
    "change_frequency": lambda d: f"WITH {FOLD} SELECT after AS kind, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM fold WHERE before IS NOT NULL AND before <> after GROUP BY after",
    "retracted_support": lambda d: f"WITH {LOG} SELECT entity, count(*) AS facts, CAST(sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) AS BIGINT) AS support, max(CASE WHEN kind <> 'error' THEN event_id END) AS last_active FROM log GROUP BY entity",
    # the first row of a message key keeps its number of the table-wide serial; a repeat of other content is an error
    "durable_append": _q("SELECT run_id, message_key, min(stream_id) AS stream_id, count(*) AS sent, count(DISTINCT content) > 1 AS conflict FROM (SELECT user_id % 20 AS run_id, event_type AS message_key, event_id AS stream_id, props AS content FROM @events) t GROUP BY run_id, message_key"),
    "append_conflicts": _q("SELECT user_id, event_type, count(DISTINCT value) AS contents FROM @events GROUP BY user_id, event_type HAVING count(DISTINCT value) > 1"),
    "replay_page": _q("SELECT event_id, user_id, event_type FROM @events WHERE event_id > 200 ORDER BY event_id LIMIT 128"),
    "keyset_page": _q("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM @documents WHERE doc_id > 50 ORDER BY doc_id LIMIT 40"),
    "trailing_health": lambda d: f"SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {d.micros('ts')} RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS recent FROM @events",
    "health_score": lambda d: health(d),
    "session_idle": lambda d: f"WITH g AS (SELECT user_id, event_id, ts, CASE WHEN {d.micros('ts')} - lag({d.micros('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS opens FROM @events), s AS (SELECT user_id, event_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(event_id) AS first_event FROM s GROUP BY user_id, session",
    "usage_grouping_sets": lambda d: "SELECT event_type, role, count(*) AS calls, CAST(sum(cents) AS BIGINT) AS cents FROM (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'agent' ELSE 'tool' END AS role, CAST(round(value * 100) AS BIGINT) AS cents FROM @events) t GROUP BY GROUPING SETS ((), (event_type), (event_type, role))",
    "usage_gaps": _q("SELECT event_type, count(*) AS n FROM @events WHERE value IS NULL OR value < 1 GROUP BY event_type"),
    "token_total_fallback": lambda d: f"SELECT event_id, coalesce({d.json_int('props', 'total')}, {d.json_int('props', 'k')} + CAST(floor(value) AS BIGINT)) AS tokens FROM @events",
    "duration_projection": lambda d: f"SELECT event_id, CASE WHEN value IS NULL AND {d.json_int('props', 'k')} IS NULL THEN NULL ELSE CAST(coalesce(floor(value), 0) AS BIGINT) + coalesce({d.json_int('props', 'k')}, 0) END AS ms FROM @events",
    "call_union": _q("SELECT source, count(*) AS n FROM (SELECT 'model' AS source, event_id FROM @events WHERE event_type = 'view' UNION ALL SELECT 'tool' AS source, event_id FROM @events WHERE event_type = 'click') t GROUP BY source"),
    "role_union": _q("SELECT user_id FROM @events WHERE event_type = 'signup' UNION SELECT user_id FROM @events WHERE event_type = 'error'"),
    "key_domain_union": _q("SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS tokens, coalesce(b.n, 0) AS in_vocab FROM (SELECT event_type AS k, count(*) AS n FROM @events GROUP BY event_type) a FULL OUTER JOIN (SELECT event_type AS k, count(*) AS n FROM @events WHERE value > 20 GROUP BY event_type) b ON a.k = b.k"),
    "page_interleave": _q("SELECT event_id, max(src) AS src FROM (SELECT event_id, 1 AS src FROM @events WHERE event_id < 300 UNION ALL SELECT event_id, 2 AS src FROM @events WHERE event_id BETWEEN 250 AND 400) t GROUP BY event_id ORDER BY event_id LIMIT 128"),
    "completion_fact": _q("SELECT count(*) AS total, count(CASE WHEN value > 10 THEN 1 END) AS done FROM @events"),
    "label_counts": _q("SELECT quality, toxic, count(*) AS n FROM @labels GROUP BY quality, toxic"),
    "chapter_completion": lambda d: "SELECT conv_id, count(DISTINCT role) AS roles, max(turn) AS last_turn FROM @conversations GROUP BY conv_id HAVING count(DISTINCT role) = 2",
    "role_distribution": _q("SELECT role, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS share FROM @conversations GROUP BY role"),
    "fixed_domain_distribution": _q("SELECT k.kind, round(CAST(coalesce(n, 0) AS DOUBLE) / 1000, 6) AS rate FROM (SELECT 'click' AS kind UNION ALL SELECT 'view' UNION ALL SELECT 'share') k LEFT JOIN (SELECT event_type, count(*) AS n FROM @events GROUP BY event_type) e ON k.kind = e.event_type"),
    "domain_coverage": _q("SELECT round(CAST(count(DISTINCT event_type) AS DOUBLE) / 6, 6) AS coverage FROM @events WHERE event_type IN ('click', 'view', 'purchase', 'share')"),
    "boolean_rate": _q("SELECT coalesce(round(avg(CASE WHEN toxic = 1 THEN 1e0 ELSE 0e0 END), 6), 0) AS rate FROM @labels"),
    "group_gap": _q("SELECT round(abs(avg(CASE WHEN event_type = 'click' THEN abs(value) END) - avg(CASE WHEN event_type = 'purchase' THEN abs(value) END)), 6) AS gap FROM @events"),
    "mean_group_deviation": _q("SELECT round(avg(s), 4) AS arc FROM (SELECT user_id, stddev_samp(value) AS s FROM @events GROUP BY user_id HAVING count(*) >= 2) t"),
    "character_ranking": lambda d: f"WITH r AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_seen FROM @events GROUP BY user_id, event_type) SELECT user_id, CAST(sum(n) AS BIGINT) AS appearances, {d.any_max('event_type', d.struct('n', '-first_seen'))} AS dominant_role FROM r GROUP BY user_id",
    "ranked_characters": _q("SELECT user_id, count(*) AS n FROM @events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 15"),
    "focus_score": _q("WITH a AS (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) AS subject, max(value) AS arc FROM @events GROUP BY user_id) SELECT user_id, round(0.25 * (CAST(n AS DOUBLE) / (SELECT max(n) FROM a) + subject + least(arc, 10) / 10 + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END), 4) AS focus FROM a"),
    "distribution_by_dimension": lambda d: f"WITH {LOG} SELECT ch, kind, count(*) AS n FROM log GROUP BY ch, kind",
    "emotion_event_detail": _q("SELECT user_id, event_type, count(*) AS n FROM @events WHERE value > 20 GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 20"),
    "entity_candidate_counts": _q("SELECT coalesce(CASE WHEN event_type IN ('click', 'view') THEN event_type END, 'unmapped') AS kind, count(*) AS n FROM @events GROUP BY coalesce(CASE WHEN event_type IN ('click', 'view') THEN event_type END, 'unmapped')"),
    "foreshadow_by_chapter": lambda d: f"WITH {LOG} SELECT ch, entity, {d.any_max('kind', d.struct('ts', 'event_id'))} AS action FROM log GROUP BY ch, entity",
    "action_order": lambda d: f"WITH {LOG} SELECT event_id, CAST(row_number() OVER (ORDER BY ch, coalesce(CASE WHEN kind = 'view' THEN event_id END, 2147483648), entity, event_id) - 1 AS BIGINT) AS ordinal FROM log",
    "arc_span_join": _q("SELECT c.conv_id, c.turn AS head, d.turn AS dependent, d.role FROM @conversations c JOIN @conversations d ON c.conv_id = d.conv_id AND d.turn = c.turn + 1"),
    "span_text_slice": _q("SELECT doc_id, substr(text, 11, 20) AS surface FROM @documents WHERE length(text) > 30"),
    "dialogue_facts": _q("SELECT c.conv_id, c.turn, c.role AS speaker, substr(c.text, 1, 40) AS quote FROM @conversations c WHERE length(c.text) >= 40"),
    "evidence_payload": lambda d: f"SELECT doc_id, {'sha2(text, 256)' if d.spark else 'sha256(text)'} AS digest FROM @documents",
    # of any number of rows: sums of two 32-bit parts of each row's digest, in any order
    "snapshot_digest": lambda d: f"WITH r AS (SELECT event_type, md5({d.string('event_id')}) AS h FROM @events) SELECT event_type, count(*) AS n, CAST(sum({d.hex_int('substr(h, 1, 8)')}) AS BIGINT) AS digest_a, CAST(sum({d.hex_int('substr(h, 9, 8)')}) AS BIGINT) AS digest_b FROM r GROUP BY event_type",
    "secret_masking": _q("SELECT c_custkey, concat('****', substr(c_name, length(c_name) - 3, 4)) AS masked FROM @customer"),
    "enum_aliases": _q("SELECT event_id, CASE event_type WHEN 'click' THEN 'subject' WHEN 'view' THEN 'observer' WHEN 'purchase' THEN 'agent' ELSE 'subject' END AS role FROM @events"),
    "score_clamp": _q("SELECT event_id, CAST(greatest(-2, least(2, floor(value / 10) - 2)) AS BIGINT) AS score FROM @events"),
    "coverage_clamp": _q("SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(0e0, least(1e0, round(value / 50, 6))) END AS coverage FROM @events"),
    "coverage_warnings": _q("SELECT doc_id, CASE WHEN count(*) < 2 THEN 'fewer than two labels' END AS warning FROM @labels GROUP BY doc_id"),
    "ilike_filter": _q("SELECT doc_id FROM @documents WHERE lower(text) LIKE '%licens%' OR lower(text) LIKE '%t_ken%'"),
    "id_range_filters": _q("SELECT vec_id, label FROM @embeddings WHERE vec_id BETWEEN 20 AND 300 AND vec_id NOT IN (25, 30, 35) AND label < 7"),
    "reference_admission": _q("SELECT c_custkey, c_name FROM @customer WHERE lower(c_mktsegment) NOT IN ('machinery', 'household') AND c_nationkey <> 0"),
    "reference_slots": lambda d: f"SELECT user_id, event_id, concat('SLOT_C', {d.string('EXTRACT(DAY FROM ts)')}, '_', event_type) AS slot FROM @events",
    "json_fields": lambda d: f"SELECT event_id, {d.json_int('props', 'k')} AS k FROM @events",
    "pivot_sampling": _q("SELECT doc_id FROM @labels WHERE toxic = 1 ORDER BY doc_id LIMIT 20"),
    "change_sampling": lambda d: f"WITH {FOLD} SELECT event_id, before, after FROM fold WHERE before <> after ORDER BY event_id LIMIT 50",
    "event_sort": _q("SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN value > 30 THEN NULL ELSE value END ASC NULLS LAST, event_id) AS BIGINT) AS place FROM @events"),
    "chapter_ordered_read": _q("SELECT conv_id, turn, role FROM @conversations ORDER BY conv_id, turn LIMIT 100"),
    "cascade_purge": _q("SELECT l.l_orderkey, l.l_linenumber FROM @lineitem l WHERE NOT EXISTS (SELECT 1 FROM @orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')"),
    # new rows replace those of their key and the others stay
    "upsert": _q("WITH new AS (SELECT doc_id, 1 - quality AS quality FROM @labels WHERE doc_id % 2 = 0 UNION ALL SELECT -1 - doc_id AS doc_id, quality FROM @labels WHERE doc_id % 5 = 0) SELECT doc_id, quality FROM new UNION ALL SELECT o.doc_id, o.quality FROM @labels o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id)"),
    # spans [event_id, event_id + k) of a user: nulls, negative lengths, and starts before the end of an earlier span
    "span_validation": lambda d: f"WITH s AS (SELECT user_id, event_id AS st, event_id + 20 * {d.json_int('props', 'k')} AS e FROM @events), c AS (SELECT user_id, st, e, max(e) OVER (PARTITION BY user_id ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s) SELECT user_id, count(*) AS n_spans, count(CASE WHEN st IS NULL OR e IS NULL OR e < st THEN 1 END) AS n_bad, count(CASE WHEN st < pe THEN 1 END) AS n_overlaps FROM c GROUP BY user_id",
    "existence_probe": _q("SELECT count(*) > 0 AS present FROM (SELECT 1 AS x FROM @labels WHERE toxic = 1 LIMIT 1) t"),
    "stage_readiness": _q("SELECT (SELECT count(*) FROM @documents) > 0 AND (SELECT count(*) FROM @labels) > 0 AS ready"),
    "id_rewrite": _q("SELECT l.l_orderkey, concat('task-', o.o_orderpriority) AS task FROM @lineitem l JOIN @orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 1"),
    "name_key": _q("SELECT n_nationkey, concat(lower(trim(n_name)), '|nation') AS name_key FROM @nation"),
    # two of the segments stand for relations that go both ways: only their ends are put in order
    "relation_key": _q("WITH r AS (SELECT c_nationkey AS x, c_custkey % 25 AS y, c_mktsegment AS kind, c_mktsegment IN ('BUILDING', 'MACHINERY') AS both_ways FROM @customer) SELECT CASE WHEN both_ways THEN least(x, y) ELSE x END AS a, CASE WHEN both_ways THEN greatest(x, y) ELSE y END AS b, kind, count(*) AS n FROM r GROUP BY CASE WHEN both_ways THEN least(x, y) ELSE x END, CASE WHEN both_ways THEN greatest(x, y) ELSE y END, kind"),
    "weighted_roulette": _q("WITH p AS (SELECT s_suppkey, s_acctbal AS w FROM @supplier WHERE s_acctbal > 0), c AS (SELECT s_suppkey, sum(w) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, sum(w) OVER () AS total FROM p) SELECT min(s_suppkey) AS chosen FROM c WHERE hi >= " + f"{FRACTION!r} * total"),
    "cursor_codec": lambda d: f"SELECT event_id, {d.base64('concat(' + chr(39) + '{' + chr(34) + 'offset' + chr(34) + ':' + chr(39) + ', ' + d.string('event_id') + ', ' + chr(39) + '}' + chr(39) + ')')} AS cursor_text FROM @events",
    # an illegal label, or more than three, makes the whole list null
    "label_normalisation": lambda d: f"WITH l AS (SELECT DISTINCT user_id, event_type FROM @events WHERE value > 35) SELECT user_id, CASE WHEN count(*) <= 3 AND count(CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 1 END) = 0 THEN {d.strings('event_type', 'event_type')} END AS labels FROM l GROUP BY user_id",
}
