"""One query text, two engines: small expression builders for Spark SQL and for DuckDB, and the base relations that queries share.

A table is written ``@name``: in Spark it becomes a Parquet scan of the data folder (so filters and columns are pushed
down), in DuckDB the view of that name.
"""

from __future__ import annotations

import re

#: The tokenizer's pattern: runs of ASCII letters and digits or of CJK ideographs.
TOKEN = "[A-Za-z0-9]+|[\u4e00-\u9fff]+"
#: Small word lists (kind -> terms) of the examples; operators take any lists.
LEXICONS = {"pos": ("the", "le", "der", "el", "her"), "neg": ("of", "la", "und", "los"), "fight": ("st", "eux", "ge", "rr")}


class Dialect:
    """Expressions that the engines spell differently."""

    def __init__(self, name: str, sf_dir: str = ""):
        self.spark, self.sf_dir = name == "spark", sf_dir

    def _one(self, spark: str, duck: str) -> str:
        return spark if self.spark else duck

    def regex_count(self, x: str, pattern: str) -> str:
        literal = pattern.replace("\\", "\\\\") if self.spark else pattern
        return self._one(f"size(regexp_extract_all({x}, '{literal}', 0))", f"len(regexp_extract_all({x}, '{literal}'))")

    def extract_all(self, x: str, pattern: str, group: int) -> str:
        literal = pattern.replace("\\", "\\\\") if self.spark else pattern
        return f"regexp_extract_all({x}, '{literal}', {group})"

    def tokens(self, x: str) -> str:
        return self._one(f"regexp_extract_all({x}, '{TOKEN}', 0)", f"regexp_extract_all({x}, '{TOKEN}')")

    def lam(self, var: str, body: str) -> str:
        return self._one(f"{var} -> {body}", f"lambda {var}: {body}")

    def filter(self, xs: str, var: str, body: str) -> str:
        return f"{self._one('filter', 'list_filter')}({xs}, {self.lam(var, body)})"

    def transform(self, xs: str, var: str, body: str) -> str:
        return f"{self._one('transform', 'list_transform')}({xs}, {self.lam(var, body)})"

    def size(self, xs: str) -> str:
        return f"CAST({self._one('size', 'len')}({xs}) AS BIGINT)"

    def distinct(self, xs: str) -> str:
        return f"{self._one('array_distinct', 'list_distinct')}({xs})"

    def lines(self, x: str) -> str:
        split = self._one(f"split({x}, '\\n')", f"string_split({x}, chr(10))")
        return self.filter(self.transform(split, "x", "trim(x)"), "x", "x <> ''")

    def explode(self, keys: str, xs: str, source: str, pos: str, item: str) -> str:
        """SELECT keys, 0-based position and item of an array."""
        if self.spark:
            return f"SELECT {keys}, CAST({pos} AS BIGINT) AS {pos}, {item} FROM {source} LATERAL VIEW posexplode({xs}) v AS {pos}, {item}"
        return f"SELECT {keys}, unnest(range(len({xs}))) AS {pos}, unnest({xs}) AS {item} FROM {source}"

    def micros(self, ts: str) -> str:
        return self._one(f"unix_micros(CAST({ts} AS TIMESTAMP))", f"epoch_us({ts})")

    def json_int(self, col: str, key: str) -> str:
        return self._one(f"CAST(get_json_object({col}, '$.{key}') AS BIGINT)", f"CAST(json_extract_string({col}, '$.{key}') AS BIGINT)")

    def hex_int(self, x: str) -> str:
        return self._one(f"CAST(conv({x}, 16, 10) AS BIGINT)", f"CAST(('0x' || {x}) AS BIGINT)")

    def char_count(self, x: str, characters: str) -> str:
        """How many of some characters are in a text."""
        if self.spark:  # replace seeks bytes, translate looks every character up
            rest = x
            for c in characters:
                rest = f"replace({rest}, '{c}', '')"
            return f"(length({x}) - length({rest}))"
        return f"(length({x}) - length(translate({x}, '{characters}', '')))"

    def runs_between(self, x: str, marks: str) -> str:
        """How many runs of characters other than some marks a text has."""
        if self.spark:  # the first mark for all of them, then the pieces between: a negated class with characters beyond Latin is slow
            one = x
            for c in marks[1:]:
                one = f"replace({one}, '{c}', '{marks[0]}')"
            return f"size(filter(split({one}, '[{marks[0]}]'), x -> x <> ''))"
        return self.regex_count(x, f"[^{marks}]+")

    def in_lexicons(self, x: str) -> str:
        """Spark: the tokens of a text that are terms of any list (ASCII words), by one expression with borders."""
        terms = "|".join(t for words in LEXICONS.values() for t in words)
        return f"regexp_extract_all({x}, '(?<![A-Za-z0-9])(?i:{terms})(?![A-Za-z0-9])', 0)"

    def base64(self, x: str) -> str:
        """URL-safe base64 of a text."""
        return f"translate({self._one(f'base64(encode({x}, {chr(39)}UTF-8{chr(39)}))', f'base64(encode({x}))')}, '+/', '-_')"

    def square(self, n: str) -> str:
        """The square of a length, which Spark counts in 32 bits and DuckDB in 64."""
        return self._one(f"CAST({n} AS BIGINT) * {n}", f"{n} * {n}")

    def idiv(self, a: str, b: str) -> str:
        return self._one(f"({a} div {b})", f"({a} // {b})")

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, v) -> s + v)"
        return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"

    def at(self, xs: str, i: str) -> str:
        """1-based element."""
        return self._one(f"element_at({xs}, {i})", f"({xs})[{i}]")

    def any_max(self, value: str, order: str) -> str:
        return self._one(f"max_by({value}, {order})", f"arg_max({value}, {order})")

    def any_min(self, value: str, order: str) -> str:
        return self._one(f"min_by({value}, {order})", f"arg_min({value}, {order})")

    def strings(self, value: str, order: str) -> str:
        """Comma-joined values of a group, in order (bounded groups only)."""
        return self._one(f"listagg({value}, ',') WITHIN GROUP (ORDER BY {order})", f"string_agg({value}, ',' ORDER BY {order})")

    def string(self, x: str) -> str:
        return self._one(f"CAST({x} AS STRING)", f"CAST({x} AS VARCHAR)")

    def struct(self, *parts: str) -> str:
        return self._one(f"struct({', '.join(parts)})", f"row({', '.join(parts)})")

    def count_in(self, toks: str, kind: str) -> str:
        return self.size(self.filter(toks, "x", f"lower(x) IN ({', '.join(repr(t) for t in LEXICONS[kind])})"))

    # base relations -------------------------------------------------------------------------------------------------

    def paragraphs(self) -> str:
        """WITH-entries ``para0`` and ``para``: a document is a run, a non-blank line a paragraph, five paragraphs a chapter."""
        marks = {"excl": "!！", "ques": "?？", "pause": ",;，、；"}
        sums = ", ".join(f"CAST({self.char_count('txt', p)} AS BIGINT) AS {n}" for n, p in marks.items())
        sums += f", CAST({self.runs_between('txt', '。！？!?')} AS BIGINT) AS sent"
        # inner lengths of four kinds of quotes, in passes of their own
        inner = lambda open_, close: self.transform(self.extract_all("txt", f"(?s){open_}(.*?){close}", 1), "x", "length(x)")
        total = " + ".join(self._one(f"aggregate({q}, 0, (s, v) -> s + v)", f"coalesce(list_sum({q}), 0)") for q in (inner("「", "」"), inner("“", "”"), inner('"', '"'), inner("\\x27", "\\x27")))
        # Spark seeks the words of all lists at once and tells the few that it finds apart
        hits, held = (f"{self.in_lexicons('txt')} AS hits, ", "hits") if self.spark else ("", "toks")
        return f"""para0 AS ({self.explode('doc_id', self.lines('text'), '@documents', 'pid', 'txt')}),
para1 AS (SELECT doc_id, pid, {self.idiv('pid', '5')} + 1 AS ch, txt, CAST(length(txt) AS BIGINT) AS chars, {self.tokens('txt')} AS toks, {hits}{sums}, CAST({total} AS BIGINT) AS dlg FROM para0),
para AS (SELECT doc_id, pid, ch, txt, chars, toks, {self.size('toks')} AS tok, {self.count_in(held, 'pos')} AS pos, {self.count_in(held, 'neg')} AS neg, {self.count_in(held, 'fight')} AS fight, excl, ques, pause, sent, dlg FROM para1)"""

    def topics(self) -> str:
        """WITH-entries ``unit`` (one row per paragraph) and ``topic`` (paragraph, topic, weight): eight weights from the first eight components."""
        absolute = lambda i: f"abs(CAST({self.at('embedding', str(i))} AS DOUBLE))"
        total = " + ".join(absolute(i) for i in range(1, 9))
        parts = " UNION ALL ".join(f"SELECT pid, ch, tok, net, {i - 1} AS topic, a{i} / s AS w FROM unit0" for i in range(1, 9))
        cols = ", ".join(f"{absolute(i)} AS a{i}" for i in range(1, 9))
        return f"""unit0 AS (SELECT vec_id AS pid, label AS ch, CAST(1 + vec_id % 10 AS BIGINT) AS tok, (CAST(vec_id % 7 AS DOUBLE) - 3) / 10 AS net, {cols}, {total} AS s FROM @embeddings),
unit AS (SELECT pid, ch, tok, net FROM unit0), topic AS ({parts})"""

    def edges(self) -> str:
        """WITH-entries ``raw`` and ``edge``: the character graph, nations linked by order lines between customer and supplier (a < b)."""
        return """raw AS (SELECT c.c_nationkey AS x, s.s_nationkey AS y, count(*) AS n FROM @lineitem l JOIN @orders o ON l.l_orderkey = o.o_orderkey JOIN @customer c ON o.o_custkey = c.c_custkey JOIN @supplier s ON l.l_suppkey = s.s_suppkey GROUP BY c.c_nationkey, s.s_nationkey),
edge AS (SELECT CAST(least(x, y) AS BIGINT) AS a, CAST(greatest(x, y) AS BIGINT) AS b, CAST(sum(n) AS BIGINT) AS w FROM raw WHERE x <> y GROUP BY least(x, y), greatest(x, y))"""

    def finish(self, sql: str) -> str:
        if self.spark:
            return re.sub(r"@(\w+)", lambda m: f"parquet.`{self.sf_dir}/{m[1]}.parquet`", sql)
        return re.sub(r"@(\w+)", r"\1", sql)
