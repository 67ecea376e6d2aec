"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (text between block-level borders) that know their open elements. Binary features of ancestor
tags, of hints in class and id names, and of the text feed a chain with two labels, content and boilerplate; the most
likely labelling is found by Viterbi. The weights are fitted by maximum likelihood on labelled pages, which
``training_pages`` writes from a fixed seed: articles and every kind of boilerplate in many page layouts, with and without
semantic elements.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from storyspark.llm.common import table, text_blocks, without

#: Labelled pages that the field is fitted on, steps of the fit, and L2 penalty.
TRAINING_PAGES, STEPS, PENALTY = 500, 100, 0.5
COLUMNS = ("text", "n_chars")

#: Element names.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no page text.
UNSEEN = set("script style noscript template svg math iframe object canvas audio video head title".split())
RAW = set("script style noscript template iframe textarea title".split())
#: An opening tag that closes an open element of these names.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = ("ul", "ol", "dl", "table", "select")
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that features name.
_SHOWN = frozenset("article main section nav header footer aside form ul ol li table td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dl dd dt button select option textarea fieldset address details dialog menu label".split())
#: Hint groups and the names (or parts of names of four letters and more) that give them.
HINTS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip sitemap dropdown",
    "header": "header masthead head topper brand logo site-title",
    "footer": "footer foot copyright legal colophon bottom imprint disclaimer",
    "side": "sidebar side aside rail widget related recommended recommendation trending popular more teaser also-read promo-list",
    "ad": "ad ads adv advert advertisement adbox adslot sponsor sponsored promo promotion banner dfp commercial outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner-notice privacy paywall toast warning",
    "form": "form newsletter subscribe subscription signup login search register contact poll",
    "comment": "comment comments commentlist reply replies disqus discussion respond reader-comments feedback thread",
    "share": "share sharing social follow tools byline-tools tags taglist hidden sr-only",
    "main": "article post content entry story body main text page-content post-content entry-content article-body story-body prose",
}
_HINT_OF = {w: g for g, ws in HINTS.items() for w in ws.split()}
_PARTS = [(w, g) for w, g in sorted(_HINT_OF.items(), key=lambda x: -len(x[0])) if len(w) >= 4]
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Parts of a class name that says what a page has or lacks, not what the element is; elements whose names are of the page, and those that only whole names speak of.
_STATES, _OF_PAGE, _WHOLE_ONLY = {"no", "not", "has", "have", "with", "without", "hide", "show", "free", "enabled", "disabled"}, {"html", "body"}, {"article", "main"}


@functools.lru_cache(65536)
def _hints(value: str, whole_only: bool = False) -> frozenset[str]:
    out = set()
    for name in value.lower().split():
        whole = _HINT_OF.get(name)
        if whole:
            out.add(whole)
            continue
        parts = re.split(r"[^a-z0-9]+", name)
        if whole_only or (len(parts) > 1 and not _STATES.isdisjoint(parts)):
            continue
        for part in parts:
            g = _HINT_OF.get(part)
            if g:
                out.add(g)
            else:
                out |= {next((g for w, g in _PARTS if w in part), "")} - {""}
    return frozenset(out)


class Block:
    __slots__ = ("tags", "hints", "own", "parts", "linked", "text")

    def __init__(self, tags, hints, own):
        self.tags, self.hints, self.own, self.parts, self.linked, self.text = tags, hints, own, [], 0, ""


#: A comment may end right after it began, and later at either mark.
_COMMENT_END, _COMMENT_ENDS = re.compile(r"-?>"), re.compile(r"--!?>")
_HEAD, _BLANK, _BARE = re.compile(r"[^>=]*"), re.compile(r"[ \t\n\f\r]*"), re.compile(r"[^\s>]*")


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Place of the ``>`` that ends the tag at ``at``, quoted values aside; -1 if the page ends first.

    A quote opens a value only directly after ``=``; elsewhere, and where it is never closed, it is a character like others.
    ``unclosed`` keeps the quotes that the rest of the page does not hold, so that each page is searched once.
    """
    i = at
    while True:
        i = _HEAD.match(page, i).end()
        if i >= len(page):
            return -1
        if page[i] == ">":
            return i
        i = _BLANK.match(page, i + 1).end()
        q = page[i : i + 1]
        if q in ('"', "'") and q not in unclosed:
            close = page.find(q, i + 1)
            if close >= 0:
                i = close + 1
                continue
            unclosed.add(q)
        i = _BARE.match(page, i).end()


class _Open:
    """An open element with what its blocks see: shown tags and hints of all elements around, its own or next outer block tag."""

    __slots__ = ("name", "tags", "hints", "own", "block")

    def __init__(self, name: str, hints: frozenset[str], at: int, outer: _Open | None):
        self.name = name
        self.tags, self.hints, self.own, self.block = (outer.tags, outer.hints, outer.own, outer.block) if outer else (frozenset(), frozenset(), "", -1)
        if not hints <= self.hints:
            self.hints = self.hints | hints
        if name not in INLINE:
            self.own, self.block = name, at
            if name in _SHOWN and name not in self.tags:
                self.tags = self.tags | {name}


def leaf_blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order; the time is linear in the page at any depth."""
    blocks: list[Block] = []
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
    unclosed: set[str] = set()
    current: Block | None = None
    unseen = links = 0
    at, n = 0, len(page)

    def border() -> None:
        nonlocal current
        current = None

    def push(name: str, hints: frozenset[str]) -> None:
        where.setdefault(name, []).append(len(stack))
        stack.append(_Open(name, hints, len(stack), stack[-1] if stack else None))

    def close_to(i: int) -> None:
        nonlocal unseen, links
        for x in stack[i:]:
            unseen -= x.name in UNSEEN
            links -= x.name == "a"
            if x.name:
                where[x.name].pop()
        del stack[i:]

    def last(names) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((where[x][-1] for x in names if where.get(x)), default=-1)

    def add(raw: str) -> None:
        nonlocal current
        if unseen or not raw:
            return
        if current is None:
            if not raw.strip():
                return
            current = Block(stack[-1].tags, stack[-1].hints, stack[-1].own) if stack else Block(frozenset(), frozenset(), "")
            blocks.append(current)
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        c = page[lt + 1 : lt + 2]
        if not (c.isascii() and c.isalpha()) and c not in ("/", "!", "?"):
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        if page.startswith("<!--", lt):
            close = _COMMENT_END.match(page, lt + 4) or _COMMENT_ENDS.search(page, lt + 4)
            at = close.end() if close else n
            continue
        end = _tag_end(page, lt + 1, unclosed)
        if end < 0:
            break
        at = end + 1
        if c in ("!", "?"):
            continue
        closing = c == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            continue
        name = m[0].lower()
        if closing:
            if where.get(name):
                close_to(where[name][-1])
            if name not in INLINE:
                border()
            continue
        if name not in INLINE or name == "br":
            border()
        if name in VOID:
            continue
        if name in CLOSES_P and where.get("p") and stack[-1].block == where["p"][-1]:  # only inline elements within it
            close_to(where["p"][-1])
        if name in IMPLIED:
            i = last(IMPLIED[name])
            if i >= 0 and i >= last(LISTS):
                close_to(i)
        hints: frozenset[str] = frozenset()
        inside = page[m.end() : end]
        if inside.strip(" /"):
            attrs = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(inside)}
            if name not in _OF_PAGE:
                hints = _hints(f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".strip(), name in _WHOLE_ONLY)
            if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
                hints |= {"hidden"}
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s>/])", re.I).search(page, at)
            body = page[at : close.start() if close else n]
            if name == "textarea":
                push(name, hints)
                add(body)
                close_to(len(stack) - 1)
            at = n if not close else max(page.find(">", close.end()) + 1, close.end())
            continue
        if inside.endswith("/") and name in UNSEEN:
            continue
        push(name, hints)
        unseen += name in UNSEEN
        links += name == "a"
        if name == "body" and unseen and where.get("head"):
            stack[where["head"].pop()].name = ""  # a head that was not closed ends here
            unseen -= 1
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in blocks if b.text]




def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    n = len(blocks)
    heading = False
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        f = ["bias", f"own={b.own if b.own in _SHOWN else 'div'}"]
        f += [f"in={t}" for t in b.tags]
        f += [f"hint={h}" for h in b.hints]
        if not (b.tags & {"article", "main"} or "main" in b.hints):
            f.append("outside")
        f.append(f"words={min(5, words.bit_length())}")
        density = b.linked / max(1, len(b.text))
        f.append("links=" + ("all" if density > 0.8 else "some" if density > 0.2 else "none"))
        f.append("ends=" + ("stop" if b.text[-1] in ".!?:;\"'”»…" else "open"))
        if "©" in b.text or "copyright" in b.text[:80].lower() or "all rights reserved" in b.text.lower():
            f.append("copyright")
        heading |= b.own == "h1"
        f.append("headed" if heading else "before")
        f.append("place=" + ("first" if i == 0 else "last" if i == n - 1 else "mid"))
        out.append(f)
    return out


_WORDS = "time people year work world city water story house river market school music light number paper letter garden winter summer field stone north south small large early late open quiet early bright".split()


def training_pages(n: int = TRAINING_PAGES, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: leaf blocks and their labels (1: content). Content text carries a mark that labels it and is then taken away."""
    rng, mark = random.Random(seed), "\ue000"
    text = lambda lo, hi, stop=".": " ".join(rng.choice(_WORDS) for _ in range(rng.randint(lo, hi))).capitalize() + stop
    pick = lambda *xs: rng.choice(xs)
    links = lambda k: "".join(f'<li><a href="/x">{text(1, 3, "")}</a></li>' for _ in range(k))
    out = []
    for _ in range(n):
        own = lambda s: mark + s
        para = lambda: f"<p>{own(text(*pick((1, 4), (5, 30), (30, 120))))}" + pick("</p>", "</p>", "")
        extra = [
            lambda: f"<h{(k := rng.randint(2, 4))}>{own(text(1, 8, ''))}</h{k}>",
            lambda: f"<ul>{''.join(f'<li>{own(text(2, 20, pick(chr(46), str())))}</li>' for _ in range(rng.randint(2, 5)))}</ul>",
            lambda: f"<ol>{''.join(f'<li>{own(text(2, 20))}</li>' for _ in range(rng.randint(2, 4)))}</ol>",
            lambda: f"<blockquote><p>{own(text(5, 40))}</p></blockquote>",
            lambda: f"<pre><code>{own(text(5, 20, ''))}</code></pre>",
            lambda: f"<table><tr><td>{own(text(1, 4, ''))}</td><td>{own(text(1, 4, ''))}</td></tr></table>",
            lambda: f"<figure><img src=x><figcaption>{own(text(3, 12))}</figcaption></figure>",
            lambda: f"<p>{own(text(8, 30))} <a href=y>{text(1, 3, '')}</a> {text(5, 20)}</p>",
            lambda: f"<div>{own(text(10, 60))}</div>",
            lambda: f"<section><h2>{own(text(1, 6, ''))}</h2>{para()}{para()}</section>",
        ]
        ad = lambda: pick(
            f'<div class="{pick("ad", "ads", "advert", "ad-slot", "sponsored", "promo-box", "banner")}">{text(3, 40)}</div>',
            f'<aside class="advertisement"><p>{text(5, 30)}</p></aside>',
            f'<div id="{pick("ad-top", "ad1", "sponsor")}"><a href=z>{text(3, 10)}</a></div>',
        )
        inner = [para() for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(0, 3)):
            inner.insert(rng.randint(0, len(inner)), rng.choice(extra)())
        if rng.random() < 0.3:
            inner.insert(rng.randint(0, len(inner)), ad())
        for _ in range(rng.randint(0, 2)):
            inner.insert(
                rng.choice([0, len(inner)]),
                pick(
                    f'<div class="{pick("share", "social-share", "tags")}"><ul>{links(3)}</ul></div>',
                    f'<aside class="{pick("related", "sidebar", "more")}"><h3>{text(1, 3, "")}</h3><ul>{links(3)}</ul></aside>',
                    f'<aside><p>{text(5, 40)}</p></aside>',
                    f'<form class="{pick("newsletter", "signup")}"><label>{text(2, 6, "")}</label><p>{text(5, 20)}</p><button>{text(1, 2, "")}</button></form>',
                    f'<div class="{pick("notice", "paywall", "alert")}"><p>{text(4, 25)}</p></div>',
                ),
            )
        title = f"<h1>{own(text(2, 12, pick('', '.')))}</h1>" if rng.random() < 0.9 else ""
        wrap = pick(*[("<article>", "</article>")] * 5, ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body entry">', "</div>"), ('<div class="story">', "</div>"), ("<div>", "</div>"), ('<section class="article-text">', "</section>"))
        comment = lambda: pick(f'<div class="comment"><b>{text(1, 2, "")}</b><p>{text(3, 60)}</p></div>', f'<li class="comment"><p>{text(3, 40)}</p></li>', f'<article class="comment"><p>{text(3, 60)}</p></article>', f"<p>{text(3, 40)}</p>")
        comments = f'<{(t := pick("section", "div", "ul"))} {pick("class", "id")}="{pick("comments", "reader-comments", "comment-list", "discussion", "replies")}"><h2>{text(1, 3, "")}</h2>{"".join(comment() for _ in range(rng.randint(1, 5)))}</{t}>'
        tops = [f"<nav><ul>{links(rng.randint(2, 7))}</ul></nav>", f'<div class="{pick("menu", "navbar", "main-nav", "breadcrumbs")}"><ul>{links(4)}</ul></div>', f"<header><h2>{text(1, 4, '')}</h2><p>{text(3, 12)}</p></header>", f'<div id="header"><a href=q>{text(1, 3, "")}</a><p>{text(2, 8)}</p></div>', f'<div class="{pick("cookie-notice", "consent", "alert", "notice")}"><p>{text(5, 40)}</p><button>{text(1, 2, "")}</button></div>', ad(), f'<form action="/s"><input name=q><button>{text(1, 1, "")}</button><label>{text(1, 4, "")}</label></form>', f'<div hidden><p>{text(5, 20)}</p></div>']
        ends = [f"<footer>&copy; {text(2, 6, '')} &middot; {text(3, 20)}</footer>", f'<div class="footer"><p>{text(3, 30)}</p><ul>{links(3)}</ul></div>', f"<footer><p>{text(5, 30)}</p><ul>{links(3)}</ul></footer>", f'<aside class="sidebar"><h3>{text(1, 4, "")}</h3><p>{text(5, 60)}</p><ul>{links(4)}</ul></aside>', f'<div class="{pick("related", "sidebar", "widget", "trending")}"><h3>{text(1, 3, "")}</h3><p>{text(4, 40)}</p></div>', f"<aside><p>{text(5, 50)}</p></aside>", ad(), f'<div class="newsletter"><form><p>{text(5, 20)}</p><button>{text(1, 2, "")}</button></form></div>']
        tops.append(f'<{(t := pick("header", "div"))} class="{pick("site-header", "header", "masthead")}"><h1>{text(1, 4, "")}</h1></{t}>')
        rng.shuffle(tops), rng.shuffle(ends)
        bare = rng.random() < 0.12  # a page of its article alone
        if bare:
            tops, ends, wrap = [], [], pick(("", ""), ("<div>", "</div>"), wrap)
        body = "".join(tops[: rng.randint(1, 4)]) + wrap[0] + title + "".join(inner)
        inside = rng.random() < 0.3
        body += (comments + wrap[1]) if inside else (wrap[1] + comments * (rng.random() < 0.4))
        page = f"<!DOCTYPE html><html><head><title>{text(2, 8)}</title><script>var a='<p>';</script></head><body>{body}{''.join(ends[: rng.randint(1, 4)])}</body></html>"
        blocks = leaf_blocks(page)
        labels = [int(mark in b.text) for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(mark, " ").split()) or "."
        out.append((blocks, labels))
    return out


@functools.lru_cache(4)
def fit(n: int = TRAINING_PAGES, steps: int = STEPS) -> dict:
    """Weights of the field: per feature for content against boilerplate, per transition, and for the first block."""
    pages = [(features(b), y) for b, y in training_pages(n) if b]
    names = {f: i for i, f in enumerate(sorted({f for x, _ in pages for fs in x for f in fs}))}
    longest = max(len(y) for _, y in pages)
    x = np.zeros((len(pages), longest, len(names)), np.float32)
    y, mask = np.zeros((len(pages), longest), int), np.zeros((len(pages), longest), bool)
    for p, (fs, labels) in enumerate(pages):
        for i, f in enumerate(fs):
            x[p, i, [names[v] for v in f]] = 1
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    w, trans, first = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)
    flat = x[mask]
    state = [np.zeros((2, *v.shape)) for v in (w, trans, first)]
    for step in range(1, steps + 1):
        emit = np.zeros((*mask.shape, 2))
        emit[mask, 1] = flat @ w
        alpha = np.zeros((longest, len(pages), 2))
        alpha[0] = first + emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp.reduce(alpha[t - 1][:, :, None] + trans[None], 1) + emit[:, t]
            alpha[t] = np.where(mask[:, t, None], nxt, alpha[t - 1])
        beta = np.zeros((longest, len(pages), 2))
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(trans[None] + (emit[:, t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[:, t + 1, None], nxt, 0)
        z = np.logaddexp.reduce(alpha[-1], 1)
        prob = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        gw = flat.T @ (y[mask] - prob[mask][:, 1])
        gt = np.zeros((2, 2))
        for t in range(1, longest):
            both = np.exp(alpha[t - 1][:, :, None] + trans[None] + (emit[:, t] + beta[t])[:, None, :] - z[:, None, None])
            m = mask[:, t]
            np.add.at(gt, (y[m, t - 1], y[m, t]), 1)
            gt -= both[m].sum(0)
        gf = np.bincount(y[:, 0], minlength=2) - prob[:, 0].sum(0)
        for v, g, s in ((w, gw, state[0]), (trans, gt, state[1]), (first, gf, state[2])):
            g = (g - PENALTY * v) / len(pages)
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            v += 0.15 * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-9)
    return {"weights": {f: float(w[i]) for f, i in names.items()}, "trans": trans, "first": first}


def viterbi(emit: list[float], model: dict) -> list[int]:
    """Most likely labels, given each block's score for content."""
    if not emit:
        return []
    (t00, t01), (t10, t11) = model["trans"].tolist()
    a, b = float(model["first"][0]), float(model["first"][1]) + emit[0]
    back = []
    for e in emit[1:]:
        back.append((0 if a + t00 >= b + t10 else 1, 0 if a + t01 >= b + t11 else 1))
        a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
    out = [int(b > a)]
    for choice in reversed(back):
        out.append(choice[out[-1]])
    return out[::-1]


def main_text(page: str | None, model: dict) -> str:
    """The blocks labelled content, joined by one space."""
    if not page:
        return ""
    blocks = leaf_blocks(page)
    weights = model["weights"]
    labels = viterbi([sum(weights.get(f, 0.0) for f in fs) for fs in features(blocks)], model)
    return " ".join(b.text for b, y in zip(blocks, labels) if y)


def extract(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` without html, with text and n_chars (code points).

    Null, empty and textless pages give an empty text; an empty table gives an empty one. Repeated rows are extracted each; existing columns named text or
    n_chars are replaced. Whole pages are read, however long.
    """
    pages = without(pages, *COLUMNS)
    names = pages.columns
    at = names.index("html")
    keep = [i for i in range(len(names)) if i != at]
    shared = pages.sparkSession.sparkContext.broadcast(fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, names[at]):
                texts = [main_text(p, shared.value) for p in block.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(block.column(i) for i in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*(names[i] for i in keep), *COLUMNS])

    plain = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for i, f in enumerate(pages.schema) if i != at)
    return pages.mapInArrow(run, f"{plain}text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
