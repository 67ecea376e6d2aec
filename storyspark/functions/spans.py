"""Where lexicon terms stand in texts: an Aho-Corasick automaton over all terms, broadcast once, and spans that do not overlap."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of terms that are broadcast at most (the automaton takes some twenty times as many).
LEXICON_BYTES = 16 << 20


class Automaton:
    """All occurrences of many terms in one pass over a text; built once, small enough to be sent to every worker."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted({t.strip() for t in terms if t and t.strip()})
        if sum(len(t.encode()) for t in self.terms) > LEXICON_BYTES:
            raise ValueError(f"a lexicon of more than {LEXICON_BYTES} bytes is not broadcast: look it up by parts")
        self.next: list[dict[str, int]] = [{}]
        self.here: list[int] = [-1]
        for no, t in enumerate(self.terms):
            s = 0
            for c in t:
                if c not in self.next[s]:
                    self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.here.append(-1)
                s = self.next[s][c]
            self.here[s] = no
        self.fail, self.also = [0] * len(self.next), [-1] * len(self.next)
        queue = list(self.next[0].values())
        for s in queue:
            for c, t in self.next[s].items():
                queue.append(t)
                f = self.fail[s]
                while f and c not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(c, 0)
            f = self.fail[s]
            self.also[s] = f if self.here[f] >= 0 else self.also[f]

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, term) of every occurrence, overlapping ones too."""
        s, arcs = 0, self.next
        for i, c in enumerate(text):
            while s and c not in arcs[s]:
                s = self.fail[s]
            s = arcs[s].get(c, 0)
            hit = s if self.here[s] >= 0 else self.also[s]
            while hit > 0:
                term = self.terms[self.here[hit]]
                yield i + 1 - len(term), i + 1, term
                hit = self.also[hit]


def _token_places(text: str, tokens: Sequence[str], known, skips: bool) -> Iterator[tuple[int, int, str] | None]:
    """Where tokens that are terms stand: each sought from the end of the one before, else from the start of the text.

    With ``skips`` other tokens move the cursor too (to their own end, or by their length where they do not occur).
    """
    cursor = 0
    for token in tokens:
        word = (token or "").strip()
        if word not in known:
            if skips and token:
                at = text.find(token, cursor)
                cursor = at + len(token) if at >= 0 else cursor + len(token)
            continue
        start = text.find(word, cursor)
        if start < 0:
            start = text.find(word)
        if start >= 0:
            cursor = start + len(word)
            yield start, cursor, word


def _take(text: str, candidates: Iterable[tuple[int, int, str]], left: Counter | None = None) -> list[tuple[int, int, str]]:
    """Candidates in order that overlap none taken before and, with ``left``, are not more than it says of each term."""
    used, out = bytearray(len(text)), []
    for start, end, term in candidates:
        if (left is None or left[term] > 0) and not any(used[start:end]):
            used[start:end] = b"\x01" * (end - start)
            out.append((start, end, term))
            if left is not None:
                left[term] -= 1
    return out


def locate(text: str | None, tokens: Sequence[str], automaton: Automaton) -> list[tuple[int, int, str]]:
    """Non-overlapping spans of an automaton's terms, by start.

    A term of two characters or more is sought in the text, any term among the tokens. How often each term counts is settled
    first (longest candidates first, then by start); the spans are then placed by term, longest first and each term from
    the left, then by tokens under a moving cursor, and no term stands more often than it counts. Null and empty texts have none.
    """
    if not text or not automaton.terms:
        return []
    known = set(automaton.terms)
    found = [x for x in automaton.find(text) if len(x[2]) >= 2]
    by_length = sorted([*found, *_token_places(text, tokens, known, False)], key=lambda x: (x[0] - x[1], x[0], x[2]))
    counts = Counter(term for *_, term in _take(text, by_length))
    placed = sorted(found, key=lambda x: (-len(x[2]), x[2], x[0]))
    return sorted(_take(text, [*placed, *_token_places(text, tokens, known, True)], counts))


def fixed_phrases(text: str | None, automaton: Automaton, least: int = 2, n: int = 4) -> list[tuple[int, int, str]]:
    """Spans of lexicon phrases (longest first, then from the left) and the ideographs that are left, cut in ``n``; by place."""
    text = text or ""
    hits = _take(text, sorted((x for x in automaton.find(text) if len(x[2]) >= least), key=lambda x: (x[0] - x[1], x[0], x[2])))
    free = bytearray(b"\x01" * len(text))
    for s, e, _ in hits:
        free[s:e] = bytes(e - s)
    out = [(s, e, "lexicon") for s, e, _ in hits]
    for run in re.finditer("[一-鿿]+", text):
        at = run.start()
        while at + n <= run.end():
            if all(free[at : at + n]):
                out.append((at, at + n, "run"))
                at += n
            else:
                at += 1
    return sorted(out)


#: Texts whose spans a task holds at once.
TEXTS = 128


def emotion_spans(texts: DataFrame, terms: Iterable[str], token_pattern: str) -> DataFrame:
    """Rows (doc_id, start, stop, term) of ``texts(doc_id, text)``; tokens are the matches of ``token_pattern``."""
    shared = texts.sparkSession.sparkContext.broadcast(Automaton(terms))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):  # the batch stays in Arrow: only these texts and tokens are objects
                part = batch.slice(at, TEXTS)
                spans = [locate(t, toks or (), shared.value) for t, toks in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                ids = part.column(0).take(pa.array([i for i, x in enumerate(spans) for _ in x], pa.int32()))
                columns = zip(*(s for x in spans for s in x)) if len(ids) else ((), (), ())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string())))], ["doc_id", "start", "stop", "term"])

    toks = texts.select("doc_id", "text", F.regexp_extract_all("text", F.lit(token_pattern), F.lit(0)).alias("tokens"))
    return toks.where("doc_id is not null and text <> ''").mapInArrow(run, f"doc_id {kind}, start int, stop int, term string")
