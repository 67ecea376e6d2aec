"""Topic distributions and vector queries (examples: eight topics and text vectors from ``embeddings``)."""

from __future__ import annotations

import math

from storyspark.operators.text_metrics import ratio
from storyspark.plans.dialect import Dialect


def _t(sql):
    return lambda d: f"WITH {d.topics()}{sql(d) if callable(sql) else sql}"


def _norm(d: Dialect, x: str) -> str:
    return f"sqrt({d.dot(x, x)})"


def js(p: str, q: str) -> str:
    """One component of the Jensen-Shannon divergence, base 2; 0 log 0 is 0."""
    half = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * ln({x} / (({x} + {y}) / 2)) / {math.log(2)!r} ELSE 0e0 END"
    return f"(({half(p, q)}) + ({half(q, p)})) / 2"


#: Windows of 20 units per chapter, dropped under 60 tokens, with token-weighted topic weights.
WINDOWS = ", o AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY pid) - 1 AS k FROM unit), b AS (SELECT o.ch, CAST(floor(k / 20) AS BIGINT) AS win, topic, sum(w * o.tok) AS wt, sum(o.tok) AS tok, min(o.pid) AS first_unit FROM o JOIN topic ON o.pid = topic.pid GROUP BY o.ch, CAST(floor(k / 20) AS BIGINT), topic), m AS (SELECT ch, win, topic, wt / tok AS p, first_unit FROM b WHERE tok >= 60)"

QUERIES = {
    "topic_book": _t(" SELECT topic, round(sum(w * tok) / (SELECT sum(tok) FROM unit), 6) AS weight FROM topic GROUP BY topic"),
    "topic_chapter": _t(", tot AS (SELECT ch, sum(tok) AS t FROM unit GROUP BY ch) SELECT topic.ch, topic, round(sum(w * tok) / max(t), 6) AS weight FROM topic JOIN tot ON topic.ch = tot.ch GROUP BY topic.ch, topic"),
    "topic_emotion": _t(" SELECT topic, round(sum(w * tok * net) / sum(w * tok), 4) AS net FROM topic WHERE tok > 0 GROUP BY topic"),
    "topic_topn": _t(" SELECT topic, round(sum(w * tok), 6) AS weight FROM topic GROUP BY topic ORDER BY weight DESC, topic LIMIT 3"),
    "topic_series": _t(" SELECT pid, " + ", ".join(f"round(max(CASE WHEN topic = {i} THEN w END), 6) AS t{i}" for i in range(8)) + " FROM topic GROUP BY pid"),
    "topic_shift": _t(WINDOWS + ", x AS (SELECT ch, topic, win, p, lag(p) OVER (PARTITION BY ch, topic ORDER BY win) AS q, first_unit FROM m) SELECT ch, win, min(first_unit) AS start_unit, round(sum(" + js("p", "q") + "), 6) AS divergence FROM x WHERE q IS NOT NULL GROUP BY ch, win"),
    "topic_evolution": _t(", s AS (SELECT pid, ch, sum(tok) OVER (ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tok AS before_it, sum(tok) OVER () AS total FROM unit) SELECT CAST(floor(before_it * 16 / total) AS BIGINT) AS bucket, topic, round(sum(w * tok) / sum(tok), 6) AS weight FROM s JOIN topic ON s.pid = topic.pid GROUP BY CAST(floor(before_it * 16 / total) AS BIGINT), topic"),
    "topic_validation": _t(" SELECT count(*) AS bad FROM (SELECT pid FROM topic GROUP BY pid HAVING count(*) <> 8 OR abs(sum(w) - 1) > 1e-5 OR min(w) < 0) t"),
    "vector_topk": lambda d: f"WITH q AS (SELECT embedding AS qe FROM @embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round({d.dot('embedding', 'qe')} / ({_norm(d, 'embedding')} * {_norm(d, 'qe')}), 6) AS cosine FROM @embeddings CROSS JOIN q WHERE vec_id <> 0) SELECT vec_id, cosine FROM s WHERE cosine >= 0.1 ORDER BY cosine DESC, vec_id LIMIT 20",
    "hybrid_search": lambda d: f"WITH q AS (SELECT embedding AS qe FROM @embeddings WHERE vec_id = 1), s AS (SELECT vec_id AS id, round({d.dot('embedding', 'qe')} / ({_norm(d, 'embedding')} * {_norm(d, 'qe')}), 6) AS cosine FROM @embeddings CROSS JOIN q), k AS (SELECT doc_id AS id, CAST(CASE WHEN lower(text) LIKE '%the%' THEN 1 ELSE 0 END + CASE WHEN lower(text) LIKE '%token%' THEN 1 ELSE 0 END AS BIGINT) AS hits FROM @documents), s2 AS (SELECT id, cosine FROM s WHERE cosine > 0.15), k2 AS (SELECT id, hits FROM k WHERE hits > 0) SELECT coalesce(k2.id, s2.id) AS id, coalesce(hits, 0) AS hits, coalesce(cosine, 0e0) AS cosine FROM k2 FULL OUTER JOIN s2 ON k2.id = s2.id ORDER BY hits DESC, cosine DESC, id LIMIT 30",
    "label_centroid": lambda d: f"WITH e AS ({d.explode('label, vec_id', 'embedding', '@embeddings', 'i', 'v')}) SELECT label, i, round(sum(CAST(v AS DOUBLE) * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) AS weight FROM e GROUP BY label, i",
    "cosine_matrix": lambda d: f"WITH e AS ({d.explode('label', 'embedding', '@embeddings', 'i', 'v')}), c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM e GROUP BY label, i), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label), p AS (SELECT x.label AS a, y.label AS b, sum(x.v * y.v) AS dp FROM c x JOIN c y ON x.i = y.i GROUP BY x.label, y.label) SELECT a, b, round(dp / (m.n * k.n), 6) AS cosine FROM p JOIN n m ON m.label = a JOIN n k ON k.label = b",
    "group_mean_vector": lambda d: f"WITH e AS ({d.explode('label', 'embedding', '@embeddings', 'i', 'v')}) SELECT label, i, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM e GROUP BY label, i",
    "embedding_coverage": lambda d: f"SELECT label, count(*) AS n, {ratio('count(CASE WHEN ' + d.dot('embedding', 'embedding') + ' > 0 THEN 1 END)', 'count(*)')} AS share FROM @embeddings GROUP BY label",
    # a vector's score: its first component by its largest, within -1 and 1; a vector without a largest one has none
    "strong_negative_share": lambda d: f"WITH s AS (SELECT label, CAST({d.at('embedding', '1')} AS DOUBLE) / nullif({d._one('array_max', 'list_max')}({d.transform('embedding', 'x', 'abs(CAST(x AS DOUBLE))')}), 0e0) AS score FROM @embeddings) SELECT label, round(avg(CASE WHEN score IS NULL THEN NULL WHEN score <= -0.8 THEN 1e0 ELSE 0e0 END), 6) AS share FROM s GROUP BY label",
    "linear_score_split": lambda d: f"SELECT vec_id, round(greatest(CAST({d.at('embedding', '1')} AS DOUBLE) - CAST({d.at('embedding', '2')} AS DOUBLE), 0e0), 6) AS pos, round(greatest(CAST({d.at('embedding', '2')} AS DOUBLE) - CAST({d.at('embedding', '1')} AS DOUBLE), 0e0), 6) AS neg FROM @embeddings",
    "kl_divergence": lambda d: "WITH u AS (SELECT CAST(label AS BIGINT) AS k, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p FROM @embeddings GROUP BY label) SELECT round(sum(p * ln(p * 10)) / ln(2e0), 6) AS kl FROM u",
}
