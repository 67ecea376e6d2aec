"""Text functions with no SQL form: encodings, numerals, headings, dialogue spans, lexicon spans and negation."""

from __future__ import annotations

import bisect
import re
import unicodedata

#: Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "亿": 100_000_000}
#: The encodings tried, in order.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk")
#: Opening quotes and what closes them.
QUOTES = {"「": "」", "『": "』", "“": "”", "‘": "’", "«": "»", '"': '"'}


def decode(raw: bytes, encodings=ENCODINGS) -> str:
    """Text of a file: the first encoding that fits; none is an error."""
    for e in encodings:
        try:
            return raw.decode(e)
        except (UnicodeDecodeError, LookupError):
            continue
    raise ValueError("no encoding fits")


def _run(digits: str) -> int:
    """Value of a run of digits: from its first zero on they stand by place; of those before it the last one counts, in front of them."""
    zero = next((i for i, c in enumerate(digits) if not DIGITS[c]), len(digits))
    low = digits[zero:]
    return (DIGITS[digits[zero - 1]] if zero else 0) * 10 ** len(low) + int("".join(str(DIGITS[c]) for c in low) or 0)


def _value(text: str, unit: int = 1) -> int:
    """Value of a numeral that follows ``unit``: split at its last 亿, then at its last 万, whose left side (1 if empty) they multiply."""
    for mark in "亿万":
        left, found, right = text.rpartition(mark)
        if found:
            return (_value(left) if left else 1) * UNITS[mark] + (_value(right, UNITS[mark]) if right else 0)
    total = 0
    for digits, mark in re.findall(r"([^十百千]*)([十百千]?)", text):
        if mark:
            unit = UNITS[mark]
            total += (_run(digits) or 1) * unit
        elif digits:
            bare = all(DIGITS[c] for c in digits)  # a last digit without a zero before it stands for the next lower unit
            total += _run(digits) * (unit // 10 if bare and unit > 10 else 1)
    return total


def numeral(text: str) -> int | None:
    """Value of an Arabic or Chinese numeral; a last digit after a unit above ten stands for the next unit (二百五 is 250); null if it is none."""
    text = unicodedata.normalize("NFKC", text or "").strip()
    if re.fullmatch(r"\d+", text):
        return int(text)
    if not text or any(c not in DIGITS and c not in UNITS for c in text):
        return None
    return _value(text)


def label_number(label: str) -> int | None:
    """The first numeral in a heading's label."""
    found = (numeral(x) for x in re.findall(r"[零一二三四五六七八九十百千万两〇○\d]+", label or ""))
    return next((n for n in found if n is not None), None)


def normalize(text: str) -> str:
    """Line ends to LF, ideographic space and tab to space, runs of spaces to one, trimmed."""
    text = re.sub(r"\r\n?", "\n", text or "")
    return re.sub(r" {2,}", " ", re.sub("[　\t]", " ", text)).strip()


def preprocess(text: str) -> str:
    """Without byte-order marks and zero-width characters, line separators as LF, blank lines collapsed; idempotent."""
    text = re.sub("[﻿​-‍⁠]", "", text or "")
    text = re.sub("\r\n?|[  ]", "\n", text)
    return re.sub(r"\n[ \t　]*(?:\n[ \t　]*)+", "\n\n", text).strip("\n")


def dialogue_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, closed) of quoted speech: outermost pairs; an unclosed quote runs to its line's end."""
    out, stack = [], []
    for i, c in enumerate(text):
        if stack and c == QUOTES[stack[-1][0]]:
            _, s = stack.pop()
            if not stack:
                out.append((s, i + 1, True))
        elif c in QUOTES:
            stack.append((c, i))
        elif c == "\n" and stack:
            out.append((stack[0][1], i, False))
            stack.clear()
    if stack:
        out.append((stack[0][1], len(text), False))
    return out


def term_spans(text: str, terms, tokens=None, letters: bool = False) -> list[tuple[int, int, str]]:
    """Non-overlapping term spans: longest first, then by start, then by term; one-letter terms must be tokens, or with ``letters`` stand anywhere."""
    if not letters and any(len(t) == 1 for t in terms):  # tokens matter to these terms only
        if tokens is None:
            tokens = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9]+|[一-鿿]+", text)]
        whole = {(s, e) for s, e in tokens}
    candidates = []
    for t in set(terms):
        if not t:
            continue
        at = text.find(t)
        while at >= 0:
            if len(t) >= 2 or letters or (at, at + 1) in whole:
                candidates.append((-len(t), at, t))
            at = text.find(t, at + 1)
    used, out = bytearray(len(text)), []
    for n, s, t in sorted(candidates):
        if not any(used[s : s - n]):
            used[s : s - n] = b"\x01" * -n
            out.append((s, s - n, t))
    return sorted(out)


#: Examples of negators by kind; ``negation_spec`` reads any others.
NEGATORS = {"hard": ("not", "never", "no", "不", "没", "没有"), "modal": ("未必", "莫非", "难以"), "double": ("not un", "不得不"), "scope": ("舍不得", "不舍得")}
#: Ends of sentences, borders of clauses, what may stand between a border and a clause's first word, and the attributive mark.
ENDS, CLAUSES, QUOTED, ATTRIBUTIVE = "。！？!?\n", "，、；：,;:", " \t'\"“”‘’…—", "的"


def negation_spec(lines) -> dict[str, tuple[str, ...]]:
    """Negators by kind from lines in sections: a comment with ``=====`` that names hard, modal, double or scope begins one."""
    spec: dict[str, list[str]] = {k: [] for k in NEGATORS}
    kind = None
    for line in map(str.strip, lines):
        if line.startswith("#"):
            if "=====" in line:
                kind = next((k for k in spec if k in line), None)
        elif line and kind:
            spec[kind].append(line)
    return {k: tuple(dict.fromkeys(v)) for k, v in spec.items()}


def sentence_starts(text: str) -> list[int]:
    """Where sentences begin: at 0 and after each of ``ENDS``."""
    return [0, *(m.end() for m in re.finditer(f"[{ENDS}]", text))]


def negated(text: str, start: int, negators=NEGATORS, begin: int | None = None) -> bool:
    """Whether the term at ``start`` is negated by an odd count of negators before it in its sentence.

    Negators are the longest ones in place. A hard one counts once and a double one twice if one token at most stands between
    it and the term, or if it opens its clause and neither a clause's border nor an attributive comes between; one of
    scope counts at any distance up to a border or an attributive; a modal one doesn't count. ``begin`` is where its sentence begins, if that is known.
    """
    before = text[max(text.rfind(c, 0, start) for c in ENDS) + 1 if begin is None else begin : start].lower()
    kind = {w: k for k, words in negators.items() for w in words}
    if not any(w in before for w in kind):
        return False
    count = 0
    for s, e, word in term_spans(before, kind, letters=True):
        if word.isascii() and (before[s - 1 : s].isalpha() and s or (before[e : e + 1].isalpha() and " " not in word)):
            continue  # part of a longer word
        gap = before[e:]
        apart = any(c in gap for c in CLAUSES) or ATTRIBUTIVE in gap
        if kind[word] == "scope":
            count += not apart
        elif kind[word] != "modal":
            opens = not before[max(before.rfind(c, 0, s) for c in CLAUSES) + 1 : s].strip(QUOTED)
            if len(re.findall(r"[A-Za-z0-9]+|[一-鿿]+", gap)) <= 1 or (opens and not apart):
                count += 2 if kind[word] == "double" else 1
    return count % 2 == 1


def sentiment(text: str, positive, negative) -> tuple[int, int]:
    """(positive, negative) hits; a negated hit counts for the other side."""
    pos = neg = 0
    begins = sentence_starts(text)
    for terms, sign in ((positive, 1), (negative, -1)):
        for s, _, _ in term_spans(text, terms):
            if (sign > 0) != negated(text, s, begin=begins[bisect.bisect_right(begins, s) - 1]):
                pos += 1
            else:
                neg += 1
    return pos, neg


def nth_quote(text: str, quote: str | None, k: int = 1) -> tuple[int, int]:
    """Span of the ``k``-th (overlapping) occurrence of a quote; the whole text without one; an absent occurrence is an error."""
    if not quote:
        return 0, len(text)
    at = -1
    for _ in range(k):
        at = text.find(quote, at + 1)
        if at < 0:
            raise ValueError("no such occurrence")
    return at, at + len(quote)


def query_terms(query: str, whole: int = 20) -> list[str]:
    """Lower-case terms of a query and, up to ``whole`` characters, the query itself; a long query without breaks has none."""
    q = unicodedata.normalize("NFC", query or "").lower().strip()
    parts = [p for p in re.split(r"[\s,，;；、]+", q) if p]
    if len(parts) <= 1 and len(q) > whole:
        return []
    return list(dict.fromkeys([*([q] if q and len(q) <= whole else []), *parts]))
