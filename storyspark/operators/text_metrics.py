"""Paragraph, chapter and book metrics of text: counters, densities, dialogue, lexical variety, style."""

from __future__ import annotations

from storyspark.plans.dialect import Dialect

R = "CASE WHEN {d} > 0 THEN round(({n}) / {d}, 6) END"


def ratio(n: str, d: str, digits: int = 6) -> str:
    """Null where the denominator is not positive."""
    return f"CASE WHEN ({d}) > 0 THEN round(CAST({n} AS DOUBLE) / ({d}), {digits}) END"


def _para(body):
    return lambda d: f"WITH {d.paragraphs()}{body(d)}"


def emotion_trend(d: Dialect) -> str:
    """Tumbling windows of 10 paragraphs, after a filter of the position 0..1, with pooled densities."""
    return f"""WITH {d.paragraphs()},
place AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - chars / 2.0 AS mid, sum(chars) OVER (PARTITION BY doc_id) AS total FROM para),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pid) - 1 AS k FROM place WHERE mid / total BETWEEN 0 AND 1)
SELECT doc_id, CAST({d.idiv('k', '10')} AS BIGINT) AS win, min(pid) AS first_paragraph, max(pid) AS last_paragraph, count(*) AS n_paragraphs,
  {ratio('sum(pos)', 'sum(tok)')} AS pos_density, {ratio('sum(neg)', 'sum(tok)')} AS neg_density, {ratio('sum(pos) - sum(neg)', 'sum(tok)')} AS net_density
FROM kept GROUP BY doc_id, {d.idiv('k', '10')}"""


SUMS = "CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(tok) AS BIGINT) AS tokens, CAST(sum(sent) AS BIGINT) AS sentences, CAST(sum(pos) AS BIGINT) AS pos_hits, CAST(sum(neg) AS BIGINT) AS neg_hits, CAST(sum(fight) AS BIGINT) AS fight_hits, CAST(sum(excl) AS BIGINT) AS exclaim, CAST(sum(pause) AS BIGINT) AS pause"


def tension(d: Dialect) -> str:
    """WITH-entries up to ``z``: robust z (median, MAD) of four components over a document, clipped at 3, and their mean."""
    comps = {"c1": "CAST(excl AS DOUBLE) / greatest(sent, 1)", "c2": "CAST(ques AS DOUBLE) / greatest(sent, 1)", "c3": "CAST(fight AS DOUBLE) / greatest(tok, 1)", "c4": "CAST(pause AS DOUBLE) / greatest(chars, 1)"}
    med = ", ".join(f"median({c}) OVER (PARTITION BY doc_id) AS m_{c}" for c in comps)
    mad = ", ".join(f"median(abs({c} - m_{c})) OVER (PARTITION BY doc_id) AS d_{c}" for c in comps)
    clip = ", ".join(f"greatest(-3.0, least(3.0, ({c} - m_{c}) / (1.4826 * d_{c} + 1e-9))) AS z_{c}" for c in comps)
    return f"""{d.paragraphs()}, comp AS (SELECT doc_id, pid, ch, {', '.join(f'{x} AS {c}' for c, x in comps.items())} FROM para),
med AS (SELECT *, {med} FROM comp), mad AS (SELECT *, {mad} FROM med), zs AS (SELECT doc_id, pid, ch, {clip} FROM mad),
z AS (SELECT doc_id, pid, ch, z_c1, z_c2, z_c3, z_c4, CAST(0.3 * z_c1 + 0.2 * z_c2 + 0.3 * z_c3 + 0.2 * z_c4 AS DOUBLE) AS z FROM zs)"""


def ttr_by_chapter(d: Dialect) -> str:
    """Tokens, distinct ones and their ratio; in Spark a paragraph's distinct tokens go to their chapter as one text instead of a row each."""
    if d.spark:
        types = "size(array_distinct(split(array_join(collect_list(CASE WHEN tok > 0 THEN array_join(array_distinct(toks), ' ') END), ' '), ' ')))"
        return f", e AS (SELECT doc_id, ch, sum(tok) AS tokens, CAST({types} AS BIGINT) AS types FROM para GROUP BY doc_id, ch) SELECT doc_id, ch, tokens, types, {ratio('types', 'tokens')} AS ttr FROM e WHERE tokens > 0"
    return f", e AS ({d.explode('doc_id, ch', 'toks', 'para', 'i', 'tk')}) SELECT doc_id, ch, count(*) AS tokens, count(DISTINCT tk) AS types, {ratio('count(DISTINCT tk)', 'count(*)')} AS ttr FROM e GROUP BY doc_id, ch"


def recovery_speed(d: Dialect) -> str:
    """Chapters from a low one to the next that is no longer low.

    The place of a chapter on a threshold (one above three equal ones puts these there) hangs on the last digits of mean and deviation, so Spark
    adds a document's chapters in order, by DuckDB's steps: its own stddev_samp rounds otherwise.
    """
    s = "s AS (SELECT *, avg(v) OVER (PARTITION BY doc_id) AS m, greatest(coalesce(stddev_samp(v) OVER (PARTITION BY doc_id), 0) / 2, 0.005) AS thr FROM c)"
    if d.spark:
        mean = "a.mean + (x.v - a.mean) / (a.n + 1)"
        fold = f"aggregate(chs, named_struct('n', 0D, 'total', 0D, 'mean', 0D, 'squares', 0D), (a, x) -> named_struct('n', a.n + 1, 'total', a.total + x.v, 'mean', {mean}, 'squares', a.squares + (x.v - ({mean})) * (x.v - a.mean)))"
        s = f"g AS (SELECT doc_id, array_sort(collect_list(struct(ch, v))) AS chs FROM c GROUP BY doc_id), t AS (SELECT doc_id, chs, {fold} AS t FROM g), s AS (SELECT doc_id, ch, v, t.total / t.n AS m, greatest(CASE WHEN t.n > 1 THEN sqrt(t.squares / (t.n - 1)) ELSE 0 END / 2, 0.005) AS thr FROM t LATERAL VIEW inline(chs) e AS ch, v)"
    return f", c AS (SELECT doc_id, ch, CAST(sum(pos) - sum(neg) AS DOUBLE) / greatest(sum(tok), 1) AS v FROM para GROUP BY doc_id, ch), {s}, f AS (SELECT doc_id, ch, v, m, thr, min(CASE WHEN v >= m - thr / 2 THEN ch END) OVER (PARTITION BY doc_id ORDER BY ch ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s) SELECT doc_id, count(nxt) AS recoveries, round(avg(nxt - ch), 6) AS mean_chapters FROM f WHERE v < m - thr GROUP BY doc_id"


def cooccurrence(d: Dialect) -> str:
    """Pairs of words in slices of five tokens; in Spark a text's pairs are made from its own array of tokens, without a shuffle of a row a token."""
    if d.spark:
        return f"WITH t AS (SELECT {d.filter(d.tokens('text'), 'x', 'length(x) >= 2')} AS toks FROM @documents), c AS (SELECT toks, {d.size('toks')} AS n FROM t), e AS (SELECT i, n, tk, slice(toks, i + 2, 4) AS after FROM c LATERAL VIEW posexplode(toks) v AS i, tk WHERE n >= 5), p AS (SELECT tk, other, least(i, n - 5) - greatest(0, i + step - 3) + 1 AS slices FROM e LATERAL VIEW posexplode(after) w AS step, other) SELECT least(tk, other) AS u, greatest(tk, other) AS v, CAST(sum(slices) AS BIGINT) AS weight FROM p WHERE tk <> other GROUP BY least(tk, other), greatest(tk, other)"
    return f"WITH t AS (SELECT doc_id, {d.filter(d.tokens('text'), 'x', 'length(x) >= 2')} AS toks FROM @documents), c AS (SELECT doc_id, toks, {d.size('toks')} AS n FROM t), e AS ({d.explode('doc_id, n', 'toks', 'c', 'i', 'tk')}), l AS (SELECT i, n, tk, {', '.join(f'lead(tk, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS l{k}' for k in range(1, 5))} FROM e WHERE n >= 5), p AS (SELECT tk, CASE step WHEN 1 THEN l1 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l4 END AS other, least(i, n - 5) - greatest(0, i + step - 4) + 1 AS slices FROM l CROSS JOIN (VALUES (1), (2), (3), (4)) v(step)) SELECT least(tk, other) AS u, greatest(tk, other) AS v, CAST(sum(slices) AS BIGINT) AS weight FROM p WHERE tk <> other GROUP BY least(tk, other), greatest(tk, other)"


#: Letters of the frequency vector, and the length of text under which it is null.
LETTERS, LEAST_CHARS = "etaoinshrdlcumwfgypb", 100_000
#: Marks of a comparison (anywhere in a sentence), and conjunctions that mark a compound sentence.
METAPHOR, COMPOUND = ("like", "comme", "wie", "como"), ("and", "but", "und", "aber", "et", "mais", "y", "pero")


def sentences(d: Dialect, keys: str, text: str, source: str) -> str:
    """SELECT keys, place and trimmed non-empty sentence (``sn``) of a text column."""
    split = f"split({text}, '[。！？!?.]+')" if d.spark else f"regexp_split_to_array({text}, '[。！？!?.]+')"
    return d.explode(keys, d.filter(d.transform(split, "x", "trim(x)"), "x", "x <> ''"), source, "i", "sn")


def any_word(d: Dialect, x: str, words) -> str:
    """Whether a text holds one of some words, borders being other characters than letters."""
    return f"{d.regex_count(f'lower({x})', '(^|[^a-z])(' + '|'.join(words) + ')($|[^a-z])')} > 0"


SIGMOID = "CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END"

QUERIES = {
    "emotion_trend": emotion_trend,
    "paragraph_metrics": _para(lambda d: " SELECT doc_id, pid, ch, chars, tok, sent, pos, neg, fight, excl, ques, pause, dlg FROM para"),
    "char_count": lambda d: "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars FROM @documents",
    "global_offset": _para(lambda d: ", o AS (SELECT doc_id, pid, chars, sum(chars + 1) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - chars - 1 AS s FROM para) SELECT doc_id, pid, CAST(s AS BIGINT) AS start_offset, CAST(s + chars AS BIGINT) AS end_offset FROM o"),
    "safe_density": _para(lambda d: f" SELECT doc_id, pid, {ratio('pos', 'tok')} AS pos_density, {ratio('neg', 'tok')} AS neg_density FROM para"),
    "net_density": _para(lambda d: f" SELECT doc_id, pid, {ratio('pos - neg', 'tok')} AS net_density FROM para"),
    "chapter_sums": _para(lambda d: f" SELECT doc_id, ch, {SUMS} FROM para GROUP BY doc_id, ch"),
    "chapter_metrics": _para(lambda d: f" SELECT doc_id, ch, count(*) AS n_paragraphs, {ratio('sum(pos)', 'sum(tok)')} AS pos_density, {ratio('sum(neg)', 'sum(tok)')} AS neg_density, {ratio('sum(excl) * 100', 'sum(chars)')} AS exclaim_rate, {ratio('sum(pause) * 100', 'sum(chars)')} AS pause_rate, {ratio('sum(chars)', 'sum(sent)')} AS sentence_length, {ratio('sum(dlg)', 'sum(chars)')} AS dialogue_ratio FROM para GROUP BY doc_id, ch"),
    "book_rollup": _para(lambda d: f", c AS (SELECT doc_id, ch, sum(tok) AS tok, sum(pos) AS pos, sum(neg) AS neg FROM para GROUP BY doc_id, ch) SELECT doc_id, count(*) AS chapters, CAST(sum(tok) AS BIGINT) AS tokens, {ratio('sum(pos) - sum(neg)', 'sum(tok)')} AS net_density, round(avg(CASE WHEN pos > neg THEN 1e0 ELSE 0e0 END), 6) AS positive_share, round(avg(CASE WHEN pos < neg THEN 1e0 ELSE 0e0 END), 6) AS negative_share FROM c GROUP BY doc_id"),
    "global_stats": _para(lambda d: f", c AS (SELECT doc_id, ch, CAST(sum(pos) - sum(neg) AS DOUBLE) / greatest(sum(tok), 1) AS net FROM para GROUP BY doc_id, ch) SELECT doc_id, round(max(net), 6) AS max_net, round(min(net), 6) AS min_net, {d.any_max('ch', d.struct('net', 'ch'))} AS max_chapter, {d.any_min('ch', d.struct('net', '-ch'))} AS min_chapter, round(avg(net), 6) AS mean_net FROM c GROUP BY doc_id"),
    "zero_hit_share": _para(lambda d: f" SELECT doc_id, {ratio('sum(CASE WHEN pos + neg + fight = 0 THEN chars ELSE 0 END)', 'sum(chars)')} AS zero_hit_share FROM para GROUP BY doc_id"),
    "tension_z": lambda d: f"WITH {tension(d)} SELECT doc_id, pid, round(z_c1, 6) AS z_exclaim, round(z_c2, 6) AS z_question, round(z_c3, 6) AS z_fight, round(z_c4, 6) AS z_pause FROM z",
    "stable_sigmoid": lambda d: f"WITH {tension(d)} SELECT doc_id, pid, round({SIGMOID}, 6) AS tension FROM z",
    "chapter_tension": lambda d: f"WITH {tension(d)} SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS tension FROM z GROUP BY doc_id, ch",
    "high_tension_topk": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, pid, round({SIGMOID}, 6) AS tension FROM z) SELECT doc_id, pid, tension FROM t WHERE tension > 0.01 ORDER BY tension DESC, doc_id, pid LIMIT 10",
    "tension_percentile": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch) SELECT doc_id, ch, CAST(floor(100 * cume_dist() OVER (PARTITION BY doc_id ORDER BY v)) AS BIGINT) AS percentile FROM t",
    "dialogue_ratio": _para(lambda d: f" SELECT doc_id, CAST(sum(dlg) AS BIGINT) AS dialogue_chars, {ratio('sum(dlg)', 'sum(chars)')} AS dialogue_ratio FROM para GROUP BY doc_id"),
    "punctuation_density": _para(lambda d: f" SELECT doc_id, {ratio('sum(excl) * 1000', 'sum(chars)')} AS exclaim, {ratio('sum(ques) * 1000', 'sum(chars)')} AS question, {ratio('sum(pause) * 1000', 'sum(chars)')} AS pause FROM para GROUP BY doc_id"),
    "lexical_diversity": lambda d: f"WITH t AS (SELECT doc_id, {d.tokens('text')} AS toks FROM @documents) SELECT doc_id, {d.size('toks')} AS tokens, {d.size(d.distinct('toks'))} AS types, {ratio(d.size(d.distinct('toks')), d.size('toks'))} AS ttr FROM t",
    "ttr_by_chapter": _para(ttr_by_chapter),
    "word_length": lambda d: f"WITH t AS (SELECT doc_id, {d.tokens('text')} AS toks FROM @documents), e AS ({d.explode('doc_id', 'toks', 't', 'i', 'tk')}) SELECT doc_id, round(sum(length(tk)) / (count(*) + 1e-6), 6) AS mean_word_length FROM e GROUP BY doc_id",
    "sentence_len_stats": _para(lambda d: f", s AS ({d.explode('doc_id', d.filter(d.transform(('split(txt, ' + chr(39) + '[。！？!?]+' + chr(39) + ')') if d.spark else ('regexp_split_to_array(txt, ' + chr(39) + '[。！？!?]+' + chr(39) + ')'), 'x', 'trim(x)'), 'x', chr(39) * 2 + ' <> x'), 'para', 'i', 'sn')}) SELECT doc_id, count(*) AS sentences, CAST(sum(length(sn)) AS BIGINT) AS chars, CAST(sum({d.square('length(sn)')}) AS BIGINT) AS square_sum, round(sqrt(greatest(0.0, CAST(sum({d.square('length(sn)')}) AS DOUBLE) / count(*) - pow(CAST(sum(length(sn)) AS DOUBLE) / count(*), 2))), 4) AS sd FROM s GROUP BY doc_id"),
    # single-character frequencies of a language's texts, null where there is too little text
    "function_words": lambda d: f"SELECT lang, {', '.join(f'CASE WHEN sum(length(text)) >= {LEAST_CHARS} THEN round(CAST(sum({d.char_count("lower(text)", c)}) AS DOUBLE) / sum(length(text)), 6) END AS f_{c}' for c in LETTERS)} FROM @documents GROUP BY lang",
    "category_density": _para(lambda d: f" SELECT doc_id, least(1.0, coalesce({ratio('sum(pos)', 'sum(tok)')}, 0)) AS pos, least(1.0, coalesce({ratio('sum(neg)', 'sum(tok)')}, 0)) AS neg, least(1.0, coalesce({ratio('sum(fight)', 'sum(tok)')}, 0)) AS fight FROM para GROUP BY doc_id"),
    "pos_neg_ratio": _para(lambda d: " SELECT doc_id, round(CAST(sum(pos) AS DOUBLE) / (sum(neg) + 1e-6), 4) AS pos_neg_ratio FROM para WHERE neg > 0 GROUP BY doc_id"),
    "normalize_text": lambda d: f"SELECT doc_id, CAST(length(trim({('regexp_replace(regexp_replace(text, ' + chr(39) + '[ 　]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) + ' {2,}' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')') if d.spark else ('regexp_replace(regexp_replace(text, ' + chr(39) + '[ 　]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + ' {2,}' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})) AS BIGINT) AS chars FROM @documents",
    "newline_paragraphs": lambda d: f"WITH p AS ({d.explode('doc_id', d.lines('text'), '@documents', 'pid', 'txt')}) SELECT doc_id, pid, txt FROM p",
    "run_paragraph_identity": lambda d: f"WITH p AS ({d.explode('doc_id', d.lines('text'), '@documents', 'pid', 'txt')}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id), b AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM n) SELECT p.doc_id, pid, CAST(base + pid AS BIGINT) AS paragraph_id FROM p JOIN b ON p.doc_id = b.doc_id",
    "tokenizer": lambda d: f"SELECT doc_id, {d.size(d.tokens('text'))} AS tokens FROM @documents",
    "topic_tokenizer": lambda d: f"SELECT doc_id, {d.size(d.filter(d.tokens('text'), 'x', 'length(x) >= 2 AND lower(x) NOT IN (' + chr(39) + 'the' + chr(39) + ', ' + chr(39) + 'la' + chr(39) + ')'))} AS tokens FROM @documents",
    "metaphor_sentences": lambda d: f"WITH s AS ({sentences(d, 'doc_id', 'text', '@documents')}) SELECT doc_id, count(*) AS n FROM s WHERE {d.regex_count('sn', '|'.join(METAPHOR))} > 0 GROUP BY doc_id",
    "sentence_pattern": lambda d: f"WITH s AS ({sentences(d, 'doc_id', 'text', '@documents')}), c AS (SELECT CASE WHEN length(sn) < 10 THEN 'short' WHEN length(sn) < 30 THEN 'medium' ELSE 'long' END AS pattern, {any_word(d, 'sn', COMPOUND)} AS compound FROM s) SELECT pattern, compound, count(*) AS n FROM c GROUP BY pattern, compound",
    "blank_line_paragraphs": lambda d: f"WITH p AS ({d.explode('doc_id', d.filter(d.transform(('split(text, ' + chr(39) + '[' + chr(92) * 2 + 'n]{2,}' + chr(39) + ')') if d.spark else ('regexp_split_to_array(text, ' + chr(39) + '[' + chr(92) + 'n]{2,}' + chr(39) + ')'), 'x', 'trim(x)'), 'x', chr(39) * 2 + ' <> x'), '@documents', 'pid', 'txt')}) SELECT doc_id, pid, CAST(length(txt) AS BIGINT) AS chars FROM p",
    "contiguous_runs": lambda d: f"SELECT doc_id, CAST({d.regex_count('text', '[一-龥]+|[a-zA-Z]+')} AS BIGINT) AS runs FROM @documents",
    # count maps merged at two levels, book and chapter (here: all and a language); ratios per level
    "linguistic_merge": lambda d: f"WITH t AS (SELECT lang, {d.tokens('text')} AS toks FROM @documents), e AS ({d.explode('lang', 'toks', 't', 'i', 'tk')}), g AS (SELECT grouping(lang) AS whole, lang, least(length(tk), 12) AS feature, count(*) AS n FROM e GROUP BY GROUPING SETS ((least(length(tk), 12)), (lang, least(length(tk), 12)))) SELECT CAST(whole AS BIGINT) AS whole, lang, CAST(feature AS BIGINT) AS feature, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY whole, lang), 6) AS ratio FROM g",
    "parallel_starts": _para(lambda d: ", l AS (SELECT doc_id, pid, substr(txt, 1, 1) AS c0, lag(substr(txt, 1, 1), 1) OVER (PARTITION BY doc_id ORDER BY pid) AS c1, lag(substr(txt, 1, 1), 2) OVER (PARTITION BY doc_id ORDER BY pid) AS c2 FROM para) SELECT doc_id, count(*) AS n FROM l WHERE c0 = c1 AND c1 = c2 GROUP BY doc_id"),
    "recovery_speed": _para(recovery_speed),
    # thirds of a document by characters, a paragraph weighs half the way to its neighbours (a whole step at the ends); without any way, thirds by count
    "trend_class": _para(lambda d: f""", c AS (SELECT doc_id, pid, CAST(pos - neg AS DOUBLE) / greatest(tok, 1) AS v, sum(chars) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - chars / 2e0 AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pid) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM para),
s AS (SELECT *, min(p) OVER (PARTITION BY doc_id) AS lo, max(p) OVER (PARTITION BY doc_id) AS hi, lag(p) OVER (PARTITION BY doc_id ORDER BY pid) AS before, lead(p) OVER (PARTITION BY doc_id ORDER BY pid) AS after FROM c),
t AS (SELECT doc_id, v, n, CASE WHEN hi <= lo THEN CASE WHEN i < floor(n / 3e0) THEN 0 WHEN i < 2 * floor(n / 3e0) THEN 1 ELSE 2 END WHEN p < lo + (hi - lo) / 3 THEN 0 WHEN p < lo + 2 * (hi - lo) / 3 THEN 1 ELSE 2 END AS third,
CASE WHEN hi <= lo THEN 1e0 WHEN before IS NULL THEN after - p WHEN after IS NULL THEN p - before ELSE (after - before) / 2 END AS w FROM s),
g AS (SELECT doc_id, max(n) AS n, {', '.join(f"coalesce(round(sum(CASE WHEN third = {k} THEN v * w END) / nullif(sum(CASE WHEN third = {k} THEN w END), 0e0), 9), 0e0) AS m{k}" for k in range(3))}, round(coalesce(stddev_samp(v), 0e0), 9) AS sd FROM t GROUP BY doc_id)
SELECT doc_id, {', '.join(f"CASE WHEN n < 3 THEN 0e0 ELSE round(m{k}, 6) END AS {name}" for k, name in enumerate(("first_avg", "middle_avg", "last_avg")))}, CASE WHEN n < 3 THEN 0e0 ELSE round(sd, 6) END AS stdev,
CASE WHEN n < 3 THEN 'stable' WHEN sd >= 0.003 THEN 'volatile' WHEN m2 - m0 > 0.002 THEN 'rising' WHEN m2 - m0 < -0.002 THEN 'falling' ELSE 'stable' END AS trend FROM g"""),
    "local_peaks": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch), w AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY ch) AS p, lead(v) OVER (PARTITION BY doc_id ORDER BY ch) AS q FROM t) SELECT doc_id, ch, v AS tension FROM w WHERE v > p AND v > q",
    "climax_spacing": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch), w AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY ch) AS p, lead(v) OVER (PARTITION BY doc_id ORDER BY ch) AS q FROM t), k AS (SELECT doc_id, ch, ch - lag(ch) OVER (PARTITION BY doc_id ORDER BY ch) AS gap FROM w WHERE v > p AND v > q) SELECT doc_id, round(avg(gap), 6) AS spacing FROM k GROUP BY doc_id HAVING count(gap) > 0",
    "global_peak_valley": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch), k AS (SELECT doc_id, {d.any_max('ch', d.struct('v', '-ch'))} AS peak FROM t GROUP BY doc_id) SELECT t.doc_id, max(peak) AS peak, {d.any_min('ch', d.struct('v', 'ch'))} AS valley FROM t JOIN k ON t.doc_id = k.doc_id WHERE ch <= peak GROUP BY t.doc_id",
    "climax_profile": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch), w AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY ch) AS p, lead(v) OVER (PARTITION BY doc_id ORDER BY ch) AS q FROM t), k AS (SELECT doc_id, ch, v, row_number() OVER (PARTITION BY doc_id ORDER BY ch) AS i FROM w WHERE v > p AND v > q), s AS (SELECT doc_id, count(*) AS peaks, CASE WHEN count(*) >= 3 THEN round(regr_slope(v, CAST(i AS DOUBLE)), 4) END AS slope FROM k GROUP BY doc_id) SELECT doc_id, peaks, slope, CASE WHEN slope > 0.05 THEN 'ascending' WHEN slope < -0.05 THEN 'descending' ELSE 'flat' END AS shape FROM s",
    "middle_collapse": lambda d: f"WITH {tension(d)}, t AS (SELECT doc_id, ch, round(avg({SIGMOID}), 6) AS v FROM z GROUP BY doc_id, ch), x AS (SELECT doc_id, v, CAST(ch - 1 AS DOUBLE) / greatest(max(ch) OVER (PARTITION BY doc_id) - 1, 1) AS x, count(*) OVER (PARTITION BY doc_id) AS n FROM t) SELECT doc_id, round(avg(CASE WHEN x >= 0.3 AND x < 0.7 THEN v END) / nullif((avg(CASE WHEN x < 0.3 THEN v END) + avg(CASE WHEN x >= 0.7 THEN v END)) / 2e0, 0e0), 6) AS ratio FROM x WHERE n >= 10 GROUP BY doc_id",
    "quality_gate": _para(lambda d: ", c AS (SELECT doc_id, ch, sum(tok) AS t FROM para GROUP BY doc_id, ch) SELECT doc_id, count(*) AS chapters, round(avg(CASE WHEN t = 0 THEN 1e0 ELSE 0e0 END), 6) AS empty_share FROM c GROUP BY doc_id"),
    "chapter_counts": _para(lambda d: ", c AS (SELECT doc_id, ch, sum(chars) AS n FROM para GROUP BY doc_id, ch) SELECT doc_id, count(*) AS chapters, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY doc_id"),
    "progress_map": _para(lambda d: ", o AS (SELECT doc_id, ch, sum(chars) OVER (PARTITION BY doc_id ORDER BY pid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, sum(chars) OVER (PARTITION BY doc_id) AS t FROM para) SELECT doc_id, ch, round(max(CAST(e AS DOUBLE)) / max(t), 6) AS progress FROM o GROUP BY doc_id, ch"),
    "paragraph_feature_join": _para(lambda d: f", f AS (SELECT doc_id, pid, 'net' AS code, CAST(pos - neg AS DOUBLE) AS v FROM para UNION ALL SELECT doc_id, pid, 'punct' AS code, CAST(excl + ques AS DOUBLE) AS v FROM para) SELECT doc_id, pid, max(CASE WHEN code = 'net' THEN v END) AS net, max(CASE WHEN code = 'punct' THEN v END) AS punct FROM f GROUP BY doc_id, pid HAVING max(CASE WHEN code = 'net' THEN v END) <> 0 OR max(CASE WHEN code = 'punct' THEN v END) <> 0"),
    "keyword_search": _para(lambda d: " , m AS (SELECT doc_id, pid, CASE WHEN lower(txt) LIKE '%token%' THEN 1 ELSE 0 END + CASE WHEN lower(txt) LIKE '%licens%' THEN 1 ELSE 0 END + CASE WHEN lower(txt) LIKE '%the%of%' THEN 1 ELSE 0 END AS hits FROM para) SELECT doc_id, pid, CAST(hits AS BIGINT) AS hits FROM m WHERE hits > 0 ORDER BY hits DESC, doc_id, pid LIMIT 50"),
    "phrase_stats": _para(lambda d: f" SELECT doc_id, CAST(sum({d.regex_count('txt', 'tion')}) AS BIGINT) AS phrase_hits, {ratio(f'sum({d.regex_count("txt", "tion")}) * 1000', 'sum(chars)')} AS per_1000 FROM para GROUP BY doc_id"),
    # a pair counts once for each slice of five tokens that covers it; the slices are those that lie whole in the text
    "cooccurrence": cooccurrence,
    "surface_form_topn": lambda d: f"WITH t AS (SELECT doc_id, {d.tokens('text')} AS toks FROM @documents), e AS ({d.explode('doc_id', 'toks', 't', 'i', 'tk')}) SELECT tk AS surface, count(*) AS n FROM e GROUP BY tk ORDER BY n DESC, surface LIMIT 20",
    "negated_sentences": _para(lambda d: f" SELECT doc_id, count(*) AS n FROM para WHERE {d.regex_count('lower(txt)', '(not|nicht|pas|no) [a-z]')} > 0 GROUP BY doc_id"),
}
