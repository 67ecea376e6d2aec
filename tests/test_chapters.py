"""Chapters of invented books, with expectations written by hand; the sequence ratio against a plain reference implementation."""

import difflib
import random

import pytest

from storyspark.functions import sequences
from storyspark.operators import chapters

BODY = "这里是正文，写了很多的事情。\n"


def books(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def parsed(spark, *texts):
    out = [[] for _ in texts]
    for r in chapters.parse(books(spark, *texts)).orderBy("doc_id", "sequence").collect():
        out[r["doc_id"]].append(r)
    return out


def test_chinese_book(spark):
    body = BODY * 20
    text = "楔子\n很久以前的一个夜里，有一件事情发生了。\n第一章 风起云涌之时\n" + body + "第二章 山雨欲来风满\n" + body + "第三章 终于到了结局\n" + body
    (got,) = parsed(spark, text)
    assert [(r["level"], r["number"], r["display_title"], r["index_label"]) for r in got] == [("preface", None, "楔子", None), ("chapter", 1, "风起云涌之时", "第1章"), ("chapter", 2, "山雨欲来风满", "第2章"), ("chapter", 3, "终于到了结局", "第3章")]
    assert [r["sequence"] for r in got] == [1, 2, 3, 4] and got[1]["title"] == "第一章 风起云涌之时"
    assert all(text[r["start"] : r["stop"]].strip() == body.strip() for r in got[1:])
    assert text[got[0]["start"] : got[0]["stop"]] == "楔子\n很久以前的一个夜里，有一件事情发生了。\n"


def test_latin_book_with_other_levels(spark):
    body = "It was a long day and nothing much happened.\n" * 10
    text = f"Volume 1 The Beginning\nChapter 1: A stranger\n{body}Chapter 2 - The letter\n{body}番外 夏天\n{body}"
    (got,) = parsed(spark, text)
    assert [(r["level"], r["number"], r["display_title"]) for r in got] == [("volume", 1, "The Beginning"), ("chapter", 1, "A stranger"), ("chapter", 2, "The letter"), ("extra", None, "夏天")]
    assert text[got[0]["start"] : got[0]["stop"]].strip() == ""  # a heading right before another keeps its place without text


def test_contents_page(spark):
    names = ["开始的地方很远", "路上的人们很多", "回到家乡的时候"]
    body = BODY * 60
    page = "目 录\n" + "".join(f"第{n}章 {t} {p}\n" for n, t, p in zip("一二三", names, (1, 20, 40)))
    text = page + "\n" + "".join(f"第{n}章 {t}\n{body}" for n, t in zip("一二三", names))
    bare = "目录\n" + "".join(f"第{n}章 {t}\n" for n, t in zip("一二三", names)) + "".join(f"第{n}章 {t}\n{body}" for n, t in zip("一二三", names))
    one = "目录\n第一章 开始的地方很远\n\n" + "".join(f"第{n}章 {t}\n{body}" for n, t in zip("一二三", names))
    for got, source in zip(parsed(spark, text, bare), (text, bare)):
        assert [(r["level"], r["number"], r["display_title"]) for r in got] == [("chapter", i + 1, t) for i, t in enumerate(names)]
        assert all(source[r["start"] : r["stop"]].strip() == body.strip() for r in got)
    # one entry is no contents page: its line is a heading without text, and of the two chapters of one name both stay (the empty one is too short to compare)
    assert [(r["number"], r["display_title"]) for r in parsed(spark, one)[0]][:2] == [(1, "开始的地方很远"), (1, "开始的地方很远")]


def test_text_on_the_heading_line(spark):
    text = "第一章 相遇的时候 那天下着雨，他们在桥上遇见了。\n" + BODY * 9 + "第二章 分别的时候到了\n" + BODY * 9 + "第三回合。比赛开始，他先出手，可是没有人看见这一下。\n"
    (got,) = parsed(spark, text)
    assert [(r["number"], r["display_title"]) for r in got] == [(1, "相遇的时候"), (2, "分别的时候到了")]
    assert text[got[0]["start"] :].startswith("那天下着雨") and text[got[1]["start"] : got[1]["stop"]].strip().endswith("没有人看见这一下。")


def test_repeated_chapters(spark):
    rng = random.Random(4)
    words = lambda n: "".join(rng.choice("天地人山水火木金土日月星风云雨雪") for _ in range(n))
    long, other = words(600), words(600)
    text = f"第一章 同一个名字的章\n{long[:400]}\n第一章 同一个名字的章\n{long}\n第二章 另一个名字的章\n{other}\n第二章 另一个名字的章\n{words(500)}\n"
    (got,) = parsed(spark, text)
    assert [(r["number"], r["stop"] - r["start"]) for r in got] == [(1, 602), (2, 602), (2, 502)]


def test_trailing_and_named(spark):
    text = "少年篇\n" + BODY * 5 + "第一章 这一章有正文的\n" + BODY * 5 + "第二章 下一章的预告吧\n"
    got, weak, plain = parsed(spark, text, "的卷\n" + BODY * 3, BODY * 3)
    # a name without number scores 0.8 * 0.6 < 0.5, so its text opens the book; the last heading has no text
    assert [(r["level"], r["number"]) for r in got] == [("preface", None), ("chapter", 1)] and got[0]["title"] == "序言"
    assert [r["level"] for r in weak + plain] == ["auto", "auto"]


def test_automatic_chapters(spark):
    text = ("一二三四五六七八九。" * 150 + "\n\n") + "十" * 3000
    (got, empty, null) = parsed(spark, text, "", None)
    assert [(r["start"], r["stop"]) for r in got] == [(0, 1500), (1500, 3500), (3500, len(text))]
    assert [(r["start"], r["stop"]) for r in empty + null] == [(0, 0), (0, 0)]
    assert chapters.parse(books(spark)).count() == 0


def test_preprocess(spark):
    got = books(spark, "﻿a\r\n \t\r\n\r\nb c​d　e\rf", None).select(chapters.preprocess(chapters.F.col("text")).alias("t")).collect()
    assert [r["t"] for r in got] == ["a\n\nb\ncd e\nf", ""]
    again = spark.createDataFrame([(1, got[0]["t"])], "doc_id long, text string").select(chapters.preprocess(chapters.F.col("text"))).first()[0]
    assert again == got[0]["t"]


@pytest.mark.parametrize("seed", range(4))
def test_matching_blocks(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = "ab" if seed < 2 else "abcdefgh"
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(2))
        if rng.random() < 0.5 and len(a) > 9:
            b = b + a[3 : len(a) // 2] + b[:5] + a[len(a) // 2 :]
        blocks = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert sequences.matching(a, b) == sum(x.size for x in blocks)
    assert sequences.ratio("a" * 199, "a" * 500) is None and sequences.ratio("a" * 200, "a" * 500) == 1.0 and sequences.ratio(None, "a") is None


def test_line_ends_and_openings(spark):
    text = "  序言  \n a \u0085\nab\n\t\n PROLOGUE: x\n他说序言\n b "
    rows = chapters.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos")
    got = [(r["trail"], r["opening"]) for r in rows.collect()]
    assert got == [(2, "序言"), (2, None), (0, None), (0, None), (0, "PROLOGUE"), (0, None), (1, None)]
    assert "(?iuU)^\\s*(?:楔子" in rows._jdf.queryExecution().analyzed().toString()  # no line is stripped to ask that
