"""Chapters of books, as a Spark job over their lines: headings, contents page, scores, final shape.

Every line is read once and leaves a few numbers and, where it may be a heading, its parts; the text itself is not shuffled.
Windows keyed by book then find the contents page, score the headings against their neighbours and close each chapter at
the next heading. Two small helpers see texts: one cuts the books in which no heading holds, the other compares the bodies
of chapters that were published twice. Offsets are characters of the preprocessed text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyspark.functions import cjk, sequences
from storyspark.operators.graph_algorithms import cut

#: What a number, the marks after a label, and the ends of sentences are; where a heading that runs into its text breaks.
NUM, MARKS, ENDS, BREAKS = r"[零一二三四五六七八九十百千万两〇○\p{Nd}]", "[：:、.—-]", "。！？…", " ，。！？；、,.!?;：:"
_TAIL = rf"[ \t]*{MARKS}*[ \t]*(.*)$"
#: Heading patterns (level, pattern, groups of the label, group of the title) in order of priority.
PATTERNS = [
    ("part", rf"^[ \t]*(第{NUM}+部|[上中下]部){_TAIL}", (1,), 2),
    ("volume", rf"^[ \t]*(第?{NUM}+卷|卷{NUM}+|卷[上中下]|[Uu]nit[ \t]*\p{{Nd}}+){_TAIL}", (1,), 2),
    ("volume", rf"^[ \t]*([Vv]olume[ \t]*\p{{Nd}}+){_TAIL}", (1,), 2),
    ("essay", rf"^[ \t]*(第?{NUM}+篇|[Pp]art[ \t]*\p{{Nd}}+){_TAIL}", (1,), 2),
    ("hui", rf"^[ \t]*(第?{NUM}+回){_TAIL}", (1,), 2),
    ("chapter", rf"^[ \t]*(第?{NUM}+章|[Cc]hapter[ \t]*\p{{Nd}}+){_TAIL}", (1,), 2),
    ("section", rf"^[ \t]*(第?{NUM}+节|第?{NUM}+小节){_TAIL}", (1,), 2),
    ("extra", rf"^(番外|后记|尾声|彩蛋|外传|附录|特别篇|终章|结语)(?:({NUM}+)|[ \t]+|{MARKS}|[ \t]*$){_TAIL}", (1, 2), 3),
    ("essay", r"^[ \t]*([^ \t\r\n]{1,4}篇)[ \t]*$", (1,), 1),
    ("volume", r"^[ \t]*([^ \t\r\n]{1,4}卷)[ \t]*$", (1,), 1),
    ("part", r"^[ \t]*([^ \t\r\n]{1,4}部)[ \t]*$", (1,), 1),
]
#: Units of the levels that are numbered.
UNITS = {"part": "部", "volume": "卷", "chapter": "章", "section": "节", "hui": "回", "essay": "篇"}
#: A contents page's title, its entries, an entry's page number; titles of opening texts and the one by default.
CONTENTS, PAGE = r"^[ \t]*目[ \t]*录[ \t]*[:：]?[ \t]*$", r"[ \t]*\p{Nd}+[ \t]*$"
ENTRY = rf"^[ \t]*(?:第?{NUM}+[章节回卷篇]|卷{NUM}+|卷[上中下]|[Cc]hapter[ \t]*\p{{Nd}}+|[Uu]nit[ \t]*\p{{Nd}}+|[Vv]olume[ \t]*\p{{Nd}}+|[Pp]art[ \t]*\p{{Nd}}+|[^ \t\r\n]{{1,4}}[篇卷部][ \t]*\p{{Nd}}+)[ \t]*.*$"
OPENING, OPENING_TITLE = rf"(?iu)^(楔子|序言|前言|引子|序章|序幕|引言|写在前面|Prologue)(?:[ \t]*{MARKS}[ \t]*)?([^。！？…]*)$", "序言"
OPENS = r"(?iuU)^\s*(?:楔子|序言|前言|引子|序章|序幕|引言|写在前面|Prologue)"
#: Particles that a title does not begin with; title of a chapter that was cut automatically.
PARTICLES, AUTO_TITLE = ("的", "了", "是", "在", "有", "和", "就"), "自动分章"
#: Lengths of titles (shortest, longest, longest without text in it, least that may hold a sentence), least opening text, contents within the first part of a book, its fewest entries.
SHORT, LONG, SOUND, MAY_RUN_ON, OPENING_CHARS, CONTENTS_SHARE, ENTRIES = 5, 100, 30, 10, 10, 0.1, 2
#: Score from which a heading holds, largest step of numbers, share from which a chapter is a repeat, and length of automatic chapters.
HOLDS, STEP, REPEAT, AUTO = 0.5, 100, 0.5, 2000

COLUMNS = "level, number, title, display_title, index_label, title_start, start, stop"


def preprocess(text: Column) -> Column:
    """Without byte-order marks and zero-width characters, line ends and separators as LF, ideographic spaces as spaces, blank lines collapsed; null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\uFEFF", "")
    text = F.regexp_replace(text, r"\r\n|[\r\u2028\u2029]", "\n")
    text = F.regexp_replace(F.translate(text, "\u3000", " "), r"[\u200B\u200C\u200D]", "")
    return F.regexp_replace(text, r"\n[ \t]*\n+", "\n\n")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _heading(line: Column) -> Column:
    """The first pattern by which a line is a heading: level, label, display title, offset of the text after it, whether that holds anything."""
    found = []
    for level, pattern, label, title in PATTERNS:
        content = F.regexp_extract(line, pattern, title)
        found.append(F.when(line.rlike(pattern), F.struct(F.lit(level).alias("level"), F.concat(*[F.regexp_extract(line, pattern, g) for g in label]).alias("label"), content.alias("content"))))

    def parts(x: Column) -> Column:
        c = x["content"]
        head = F.regexp_extract(c, f"^[^{BREAKS}]*", 0)
        at, size = F.char_length(head), F.char_length(c)
        runs_on = ((size > SOUND) | ((size > MAY_RUN_ON) & c.rlike(f"[{ENDS}]"))) & (at > 0) & (at < size) & (_strip(head) != "")
        after = F.when(runs_on, F.char_length(line) - size + at + 1).otherwise(F.char_length(line))
        display = F.when(runs_on, _strip(head)).otherwise(_strip(c))
        text_only = c.rlike(f"^[{ENDS}]") | (runs_on & (F.char_length(_strip(head)) <= 1))
        return F.struct(x["level"].alias("level"), x["label"].alias("label"), display.alias("display"), after.alias("after"), (runs_on & F.substring(c, at + 2, size).rlike(r"(?U)\S")).alias("goes_on"), text_only.alias("text_only"))

    # parts of a line that is no heading are never worked out
    able = F.filter(F.transform(F.filter(F.array(*found), lambda x: x.isNotNull()), parts), lambda x: ~x["text_only"])
    return F.get(able, F.lit(0))


def lines(books: DataFrame) -> DataFrame:
    """Lines of ``books(doc_id, text)`` as numbers: place, start, flags, and the heading that each may be."""
    rows = books.select("doc_id", F.posexplode(F.split(preprocess(F.col("text")), "\n")).alias("pos", "line"))
    line = F.col("line")
    may_be = line.rlike(r"(?i)[部卷篇回章节]|chapter|unit|volume|part|番外|后记|尾声|彩蛋|外传|附录|结语")
    lead, trail = F.char_length(line) - F.char_length(F.regexp_replace(line, r"(?U)^\s+", "")), F.when(F.substring(line, -1, 1).rlike(r"(?U)\s"), F.char_length(line) - F.char_length(F.regexp_replace(line, r"(?U)\s+$", ""))).otherwise(0)
    # both ends are stripped only where the line begins as an opening does
    opens = line.rlike(OPENS)
    entry = line.rlike(ENTRY)
    told = rows.select(
        "doc_id", "pos", F.char_length(line).alias("size"), line.rlike(r"(?U)\S").alias("real"), lead.alias("lead"), trail.alias("trail"), line.rlike(CONTENTS).alias("contents"), entry.alias("entry"),
        F.when(entry, F.xxhash64(F.regexp_replace(line, PAGE, ""))).alias("name"), line.rlike(PAGE).alias("paged"),
        F.when(opens & _strip(line).rlike(OPENING), F.regexp_extract(_strip(line), OPENING, 1)).alias("opening"), F.when(may_be, _heading(line)).alias("h"), F.when(may_be, _strip(line)).alias("title"),
    )
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc_id")
    told = told.withColumn("start", F.coalesce(F.sum(F.col("size") + 1).over(upto), F.lit(0))).withColumn("real_before", F.coalesce(F.sum(F.col("real").cast("int")).over(upto), F.lit(0)))
    return told.withColumn("chars", F.max(F.col("start") + F.col("size")).over(whole)).withColumn("reals", F.sum(F.col("real").cast("int")).over(whole))


def without_contents(rows: DataFrame) -> DataFrame:
    """``lines`` with the end of the contents page (null without one) and no headings in it.

    The page begins at its title in the first tenth of a book and holds successive entries, two at least, up to a blank line, a line
    that is none, or an entry without page number that was there before.
    """
    whole = Window.partitionBy("doc_id")
    rows = rows.withColumn("toc", F.min(F.when(F.col("contents") & (F.col("start") < F.floor(F.col("chars") * CONTENTS_SHARE)), F.col("pos"))).over(whole))
    under = F.col("pos") > F.col("toc")
    again = F.row_number().over(Window.partitionBy("doc_id", "name", under).orderBy("pos")) > 1
    ends = under & (~F.col("entry") | (again & ~F.col("paged")))
    rows = rows.withColumn("ends", ends).withColumn("stop_pos", F.min(F.when(F.col("ends"), F.col("pos"))).over(whole)).withColumn("last_pos", F.max("pos").over(whole))
    entries = F.coalesce("stop_pos", F.col("last_pos") + 1) - F.col("toc") - 1
    rows = rows.withColumn("toc_end", F.when(entries >= ENTRIES, F.coalesce(F.min(F.when(F.col("pos") == F.col("stop_pos"), F.col("start"))).over(whole), F.col("chars"))))
    inside = F.coalesce((F.col("pos") >= F.col("toc")) & (F.col("start") < F.col("toc_end")), F.lit(False))
    return rows.withColumn("h", F.when(~inside, F.col("h"))).drop("ends", "stop_pos", "last_pos")


@F.pandas_udf(T.LongType())
def numbers(labels: pd.Series) -> pd.Series:
    """The number in each label, null without one."""
    return labels.map(cjk.label_number).astype("Int64")


def scored(rows: DataFrame) -> DataFrame:
    """Headings (rows of ``without_contents`` that are one) with number and score: a product of factors for title, label, number and neighbours of the level."""
    c = rows.where("h is not null").withColumn("number", numbers(F.col("h.label")))
    level, display = F.col("h.level"), F.col("h.display")
    n = F.char_length(display)
    score = F.when(n < SHORT, 0.8).when(n > LONG, 0.9).otherwise(1.1)
    score *= F.when(level.isin("chapter", "section", "hui", "essay") & F.col("h.label").rlike("[零一二三四五六七八九十百千万两〇○]") & ~F.contains(F.col("h.label"), F.lit("第")), 0.5).otherwise(1.0)
    score *= F.when(F.substring(display, 1, 1).isin(*PARTICLES), 0.4).otherwise(1.0)
    score *= F.when(level.isin("essay", "volume", "part") & F.col("number").isNull(), 0.6).otherwise(1.0)
    kin = Window.partitionBy("doc_id", "h.level")
    step = F.col("number") - F.lag("number").over(kin.orderBy("pos"))
    score *= F.when(step.between(1, STEP), 1.1).when(step < 0, 0.8).otherwise(1.0)
    c = c.withColumn("score", score).withColumn("gap", F.lead("start").over(kin.orderBy("pos")) - F.col("start"))
    c = c.withColumn("mean", F.avg("gap").over(kin)).withColumn("off", F.avg(F.abs(F.col("gap") - F.col("mean"))).over(kin)).withColumn("kin", F.count("*").over(kin))
    even = F.col("off") / F.col("mean")
    return c.withColumn("score", F.col("score") * F.when(F.col("kin") < 3, 1.0).when(even < 0.5, 1.2).when(even < 1.0, 1.0).otherwise(0.8)).drop("gap", "mean", "off", "kin")


def _index_label() -> Column:
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(F.col("number").isNotNull(), F.concat(F.lit("第"), F.col("number").cast("string"), units[F.col("level")]))


def structured(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Chapters of the books in which headings hold: each from its heading to the next, without empty ones at the end, after an opening text."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("pos")
    c = marks.where(F.col("score") >= HOLDS)
    real = F.coalesce(F.lead("real_before").over(order), F.col("reals")) - F.col("real_before") - 1
    c = c.withColumn("i", F.row_number().over(order)).withColumn("stop", F.coalesce(F.lead("start").over(order), F.col("chars"))).withColumn("holds", (real > 0) | F.col("h.goes_on"))
    c = c.withColumn("last", F.coalesce(F.max(F.when(F.col("holds"), F.col("i"))).over(doc), F.lit(1))).where("i <= last")
    first = c.where("i = 1").select("doc_id", F.col("start").alias("first_start"), F.coalesce("toc_end", F.lit(0)).alias("from"))
    lead = rows.join(first, "doc_id").where("start >= from and start < first_start").groupBy("doc_id", "from", "first_start").agg(
        F.min(F.when(F.col("real"), F.col("start") + F.col("lead"))).alias("a"), F.max(F.when(F.col("real"), F.col("start") + F.col("size") - F.col("trail"))).alias("b"), F.min_by("opening", F.when(F.col("opening").isNotNull(), F.col("pos"))).alias("opening"))
    title = F.coalesce("opening", F.lit(OPENING_TITLE))
    lead = lead.where(F.col("b") - F.col("a") > OPENING_CHARS).select("doc_id", F.lit("preface").alias("level"), F.lit(None).cast("long").alias("number"), title.alias("title"), title.alias("display_title"), F.lit(None).cast("string").alias("index_label"), F.col("from").alias("title_start"), F.col("from").alias("start"), F.col("first_start").alias("stop"), F.lit(True).alias("holds"))
    c = c.select("doc_id", F.col("h.level").alias("level"), "number", "title", F.col("h.display").alias("display_title"), F.col("start").alias("title_start"), (F.col("start") + F.col("h.after")).alias("start"), "stop", "holds")
    c = c.withColumn("index_label", _index_label()).unionByName(lead)
    # without any text in its chapters a book is cut automatically
    return c.withColumn("any", F.max("holds").over(doc)).where("any").drop("any", "holds").withColumn("start", F.least("start", "stop"))


def once(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """Of successive chapters of one level, number and title, the longest (of equals, the last), and those whose text it does not mostly contain in order."""
    order = Window.partitionBy("doc_id").orderBy("title_start", "start")
    key = F.struct("level", "number", F.regexp_replace("display_title", r"(?U)\s", ""))
    c = chapters.withColumn("key", F.when(F.col("number").isNotNull(), key))
    c = c.withColumn("new", ~F.coalesce(F.col("key") == F.lag("key").over(order), F.lit(False))).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    run = Window.partitionBy("doc_id", "run")
    c = c.withColumn("best", F.max(F.struct((F.col("stop") - F.col("start")).alias("n"), "start", "stop")).over(run)).drop("new", "key", "run")
    other = (F.col("best.start") != F.col("start")) & (F.col("stop") - F.col("start") >= sequences.LEAST)
    asked = c.where(other).join(books.select("doc_id", preprocess(F.col("text")).alias("text")), "doc_id")
    body = lambda a, b: F.substring("text", a + 1, b - a)
    ratio = sequences.contained(body(F.col("start"), F.col("stop")), body(F.col("best.start"), F.col("best.stop")))
    gone = asked.select("doc_id", "start", ratio.alias("ratio")).where(F.col("ratio") >= REPEAT).select("doc_id", "start")
    return c.join(gone, ["doc_id", "start"], "left_anti").drop("best")


def auto_cuts(text: str) -> list[tuple[int, int]]:
    """Pieces of ``AUTO`` characters at most, each closed at its last blank line, else after its last full stop, where that is past half."""
    if len(text) <= AUTO:
        return [(0, len(text))]
    out, at = [], 0
    while at < len(text):
        end = min(at + AUTO, len(text))
        if end < len(text):
            blank, stop = text.rfind("\n\n", at, end), text.rfind("。", at, end)
            end = blank if blank > at + AUTO / 2 else stop + 1 if stop > at + AUTO / 2 else end
        if text[at:end].strip():
            out.append((at, end))
        at = end
    return out


def automatic(books: DataFrame) -> DataFrame:
    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "stop": b} for a, b in auto_cuts(t)])

    rows = books.select("doc_id", F.explode(pieces(preprocess(F.col("text")))).alias("p")).select("doc_id", "p.*")
    return rows.select("doc_id", F.lit("auto").alias("level"), F.lit(None).cast("long").alias("number"), F.lit(AUTO_TITLE).alias("title"), F.lit(AUTO_TITLE).alias("display_title"), F.lit(None).cast("string").alias("index_label"), F.col("start").alias("title_start"), "start", "stop")


def parse(books: DataFrame) -> DataFrame:
    """Chapters of ``books(doc_id, text)``: doc_id, sequence from 1, level, number, title, display_title, index_label, title_start, start, stop.

    A null text is an empty book, which has one automatic chapter of no length; ids must be unique and not null.
    """
    rows = cut(without_contents(lines(books)))  # some numbers a line: read three times, and the texts only once
    found = cut(once(books, structured(rows, scored(rows))))
    rest = automatic(books.join(found.select("doc_id").distinct(), "doc_id", "left_anti"))
    names = ["doc_id", *COLUMNS.split(", ")]
    out = found.select(names).unionByName(rest.select(names))
    order = Window.partitionBy("doc_id").orderBy("title_start", "start")
    return out.withColumn("sequence", F.row_number().over(order)).select("doc_id", "sequence", *names[1:4], *names[4:6], *[F.col(c).cast("long").alias(c) for c in names[6:]])
