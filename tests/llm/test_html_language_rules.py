"""Pages whose class names speak of the page and not of the element; comment ends; letters; language codes against plain Python."""

import itertools
import math
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from storyspark.llm import html_extract, language_id

SF = "/root/testdata/sf0.001"
TEXT = ["The council met on Monday evening to talk about the new bridge over the river.", "Nobody spoke against the plan, and the mayor thanked all who had worked on it."]
BODY = [
    "has-header-image", "ad-free", "cookies-not-set", "single no-sidebar", "home has-sidebar", "with-sidebar", "no-js no-ads", "page-template-sidebar", "footer-dark", "menu-open", "layout-sidebar-right", "has-banner", "sticky-header", "header-fixed", "logged-out no-comments",
    "newsletter-enabled", "search-no-results", "single-post post-with-comments", "nav-is-open", "tag-promo", "theme-light subscribe-free", "social-sharing-enabled", "gdpr-accepted", "category-advertising", "login-page", "hidden-toolbar", "side-menu", "topbar-visible", "modal-open", "breadcrumbs-on",
]


def extracted(spark, *pages):
    rows = html_extract.extract(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).orderBy("page_id").collect()
    return [r["text"] for r in rows]


def test_classes_of_the_page(spark):
    page = f"<html><head><title>x</title></head><body%s><div class='navbar'><a href='/'>Home</a> <a href='/a'>About</a></div><article%s><p>{TEXT[0]}</p><p>{TEXT[1]}</p></article><div class='footer'>Copyright 2020</div></body></html>"
    want = " ".join(TEXT)
    pages = [page % (f" class='{c}'", "") for c in ["x", *BODY]] + [page % ("", f" class='{c}'") for c in ("post has-sidebar", "post no-comments", "post-with-header", "entry category-ads")]
    got = extracted(spark, *pages)
    assert [c for c, t in zip(["x", *BODY, "a1", "a2", "a3", "a4"], got) if t != want] == []


def test_comment_ends(spark):
    p = f"<article><p>{TEXT[0]}</p>%s<p>{TEXT[1]}</p></article>"
    assert extracted(spark, *[p % c for c in ("<!-->", "<!--->", "<!-- a --!>", "<!-- a -- > -->", "<!---->", "<!-- <p>no</p> -->")]) == [" ".join(TEXT)] * 6
    assert extracted(spark, p % "<!-- never closed") == [TEXT[0]]


def test_letters(spark):
    texts = ["½ ² ① Ⅷ", "12 ... !", "́", "ª", "中", "½ a", "_ _"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(100 + i, "the cat and the dog", "en") for i in range(5)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, True, False, False, False, True]


def test_codes_by_hand(spark):
    """All documents by dictionaries of n-grams: the same buckets, codewords and losses, one text after the other."""
    docs = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "text", "lang"]]

    def grams(text):
        b = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in (text or "").encode()]
        out = Counter()
        for n in language_id.ORDERS:
            for i in range(len(b) - n + 1):
                v = b[i] + (n << 9)
                for c in b[i + 1 : i + n]:
                    v = v * 257 + c
                out[(v * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 51] += 1
        return out

    counts = {}
    for i, t, lang in docs.itertuples(index=False):
        if zlib.crc32(str(i).encode()) % 5 and t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    langs = sorted(counts)
    words = [w for w in itertools.product((1, -1), repeat=len(langs)) if w[0] == 1 and -1 in w]  # a bit a row, a language a column
    share = {x: {b: (counts[x][b] + 1) / (sum(counts[x].values()) + language_id.BUCKETS) for b in range(language_id.BUCKETS)} for x in langs}
    mean = lambda b, w, side: sum(share[x][b] for x, s in zip(langs, w) if s == side) / w.count(side)
    odds = [{b: math.log(mean(b, w, 1)) - math.log(mean(b, w, -1)) for b in range(language_id.BUCKETS)} for w in words]
    got = {r["doc_id"]: r for r in language_id.op3_language_id(spark, SF).collect()}
    for i, t, _ in docs.itertuples(index=False):
        if t is None or not re.search(r"[^\W\d_]", t):
            assert got[i]["lang_pred"] == "und" or t is not None and not re.search("[a-zA-Z]", t)
            continue
        g = grams(t)
        size = max(1, sum(g.values()))
        margin = [sum(n * o[b] for b, n in g.items()) / size * min(size, language_id.EVIDENCE) for o in odds]
        loss = {x: sum(math.log1p(math.exp(-abs(m))) + max(0, -w[k] * m) for w, m in zip(words, margin)) * len(langs) / (2 * len(words)) for k, x in enumerate(langs)}
        best = min(loss.values())
        near = [x for x in langs if loss[x] - best < 1e-3]
        assert got[i]["lang_pred"] in near, (i, loss, got[i])
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(best - v) for v in loss.values()), abs=2e-3)


def test_license_sql_on_wrapped_notices(spark):
    """The registered SQL and the operator on notices that are wrapped, share sentences, repeat and lie next to each other."""
    import duckdb

    from storyspark.llm import licenses

    phrase = dict(licenses.SENTENCES)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    gpl, mit, bsd = phrase["I"] + ", " + phrase["J"] + ".", phrase["O"] + ". " + phrase["P"].upper() + "!", phrase["Q"] + ". " + phrase["R"] + " the holder"
    texts = [None, "", " \n ", wrap(gpl, 7), wrap(mit, 5), wrap(bsd, 6), f"{phrase['A']}. {phrase['B']}. {phrase['C']}:\r\n\r\n x. {phrase['D']}", f"{phrase['T']} {phrase['U']}-{phrase['U']}", f"{phrase['M']} and {phrase['X']}\r{phrase['X']}", "all rights\n\nreserved", "all rights\r\nreserved", "all\x01rights reserved", "xall rights reserved", wrap(phrase["H"], 2) + "\n\n" + gpl, phrase["N"] + phrase["N"], "ÀLL RIGHTS RESERVED. All Rights Reserved"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", *licenses.COLUMNS)
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", documents)
    want = con.sql(f"select doc_id, {', '.join(licenses.COLUMNS)} from ({licenses.SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    by = {r["doc_id"]: r["license"] for r in got.collect()}
    assert (by[3], by[4], by[5], by[6], by[9], by[10]) == ("GPL-3.0-or-later", "MIT", "BSD-3-Clause", "Apache-2.0", "none", "Proprietary")
