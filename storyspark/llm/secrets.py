"""Secret scans through a trigram inverted index.

From the syntax tree of every rule's pattern a Boolean query over trigrams is derived that every match must satisfy: a
literal stretch asks for all its trigrams, an alternation for any of its branches' queries, anything open for nothing. The
corpus is indexed segment by segment: a segment (a block of a partition's texts) gets posting lists, trigram to documents,
for the trigrams that some query names; a rule's postings are intersected and united as its query says, and only the
candidate texts are matched. A rule whose query is empty has no mandatory trigram and scans every text. Segments need no shuffle,
are bounded in size, and are rebuilt from the input wherever an executor is lost.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyspark.llm import textkernel as K
from storyspark.llm.common import table, text_blocks, without

#: Kind, pattern, flags, and the shortest value that counts (of the last group, or of the match). The first three are base rules.
RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 8),
    ("access", r"AKIA[A-Z0-9]+", re.A, 16),
    ("hex", r"[0-9a-f]+", re.A, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.A, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", re.A, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", re.A, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", re.A, 0),
]
BASE = ("assign", "access", "hex")
COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
#: A query: None (no condition), a trigram, or ("and" | "or", queries).
Query = None | str | tuple
_SET_LIMIT = 16


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or":
        if not parts or any(p is None for p in parts):
            return None
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(s: str) -> Query:
    return _both("and", [s[i : i + 3] for i in range(len(s) - 2)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query, in lower case, that every text with a match of ``pattern`` satisfies.

    Walks the parsed pattern. A stretch of items that can be only a few strings is kept as that set of strings; an open item
    ends the stretch, whose strings then go into the query.
    """
    import re._constants as c
    import re._parser as p

    def closed(strings: list[str] | None, query: Query) -> Query:
        return _both("and", [query, _both("or", [_grams(s) for s in strings]) if strings else None])

    def item(op, arg) -> tuple[list[str] | None, Query]:
        if op is c.LITERAL:
            return [chr(arg).lower()], None
        if op is c.IN and all(o is c.LITERAL for o, _ in arg):
            return sorted({chr(a).lower() for _, a in arg}), None
        if op is c.AT:
            return [""], None
        if op is c.SUBPATTERN:
            return walk(arg[-1])
        if op is c.BRANCH:
            each = [walk(x) for x in arg[1]]
            if all(strings is not None for strings, _ in each):
                return sorted({s for strings, _ in each for s in strings}), None
            return None, _both("or", [closed(*x) for x in each])
        if op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            strings, query = walk(inner)
            if strings is not None and high == 1:
                return (strings if low else sorted({"", *strings})), None
            return None, closed(strings, query) if low else None
        return None, None

    def walk(items) -> tuple[list[str] | None, Query]:
        """(all strings that the items can be, or None; what else they ask for)"""
        run, query, opened = [""], None, False
        for op, arg in items:
            strings, more = item(op, arg)
            if strings is not None and len(strings) * len(run) <= _SET_LIMIT:
                run = [a + b for a in run for b in strings]
            else:
                query, opened = closed(run, _both("and", [query, more])), True
                run = strings if strings is not None and len(strings) <= _SET_LIMIT else [""]
        return (None, closed(run, query)) if opened else (run, query)

    return closed(*walk(p.parse(pattern)))


def query_trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(query_trigrams, query[1]))


def evaluate(query: Query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Documents (sorted numbers) that satisfy a query, by the posting lists of a segment."""
    if query is None:
        return everything
    if isinstance(query, str):
        return postings.get(query, everything[:0])
    lists = [evaluate(q, postings, everything) for q in query[1]]
    return functools.reduce(np.intersect1d if query[0] == "and" else np.union1d, sorted(lists, key=len))


def segment_postings(col: pa.Array, trigrams: list[str]) -> dict[str, np.ndarray]:
    """Posting lists of the wanted trigrams (ASCII, lower case) over a block of texts, A-Z folded."""
    data, offs = K.buffers(col)
    if len(data) < 3 or not trigrams:
        return {}
    b = K.LOWER[data].astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    wanted = np.array(sorted(int.from_bytes(t.encode(), "big") for t in trigrams), np.uint32)
    member = np.zeros(1 << 16, bool)
    member[(wanted * np.uint32(2654435761)) >> np.uint32(16)] = True
    at = np.flatnonzero(member[(code * np.uint32(2654435761)) >> np.uint32(16)])
    which = np.searchsorted(wanted, code[at])
    which[which == len(wanted)] = 0
    ok = wanted[which] == code[at]
    at, which = at[ok], which[ok]
    doc = np.searchsorted(offs, at, "right") - 1
    inside = at + 3 <= offs[doc + 1]
    pairs = np.unique(which[inside] * len(offs) + doc[inside])
    word, doc = np.divmod(pairs, len(offs))
    cuts = np.searchsorted(word, np.arange(len(wanted) + 1))
    return {int(w).to_bytes(3, "big").decode(): doc[cuts[i] : cuts[i + 1]] for i, w in enumerate(wanted)}


class Rule:
    def __init__(self, kind: str, pattern: str, flags: int, least: int):
        self.kind, self.least = kind, least
        self.query = trigram_query(pattern)
        # runs of one class are maximal, so short ones can be left out by the matcher itself
        self.regex = re.compile(pattern[:-1] + "{%d,}" % least if least and re.fullmatch(r"\[[^\]]+\]\+", pattern) else pattern, flags)
        self.group = self.regex.groups

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m.group(self.group)) >= self.least]


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs(text, ...)`` with n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end`` by start, then rule order).

    Starts and ends count code points, of the whole match. Null texts count as empty: no spans, and base_sha256 of the empty
    string. Repeated rows are scanned each, texts of any length whole, and an empty table gives an empty one; existing columns of the result's names are replaced.
    """
    docs = without(docs, *COLUMNS)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Rule(*r) for r in rules]
        order = {r.kind: i for i, r in enumerate(made)}
        trigrams = sorted(set().union(*(query_trigrams(r.query) for r in made)))
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                everything = np.arange(block.num_rows)
                postings = segment_postings(block.column(at), trigrams)
                texts = block.column(at).to_pylist()
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for r in made:
                    for i in evaluate(r.query, postings, everything).tolist():
                        if texts[i]:
                            found[i] += [(s, order[r.kind], e) for s, e in r.spans(texts[i])]
                rows = [sorted(f) for f in found]
                say = [[f"{made[k].kind}:{s}:{e}" for s, k, e in f] for f in rows]
                base = [",".join(x for x, (_, k, _) in zip(t, f) if made[k].kind in BASE) for t, f in zip(say, rows)]
                cols = [block.column(i) for i in range(len(names))]
                cols += [pa.array([sum(made[k].kind == b for _, k, _ in f) for f in rows], pa.int64()) for b in BASE]
                cols += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([",".join(t) for t in say], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, [*names, *COLUMNS])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{plain}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *COLUMNS)
