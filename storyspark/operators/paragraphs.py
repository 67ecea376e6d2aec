"""Paragraphs of texts with their places: every line feed is a border, and what is too long is cut at sentence marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest paragraph in characters, marks at which a longer one is cut (past half of that), and white space.
MOST, MARKS = 1500, "。！？…；"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def cuts(line: str) -> list[tuple[int, int]]:
    """Pieces of ``MOST`` characters at most, each up to its last mark where that is past half of ``MOST``."""
    out, at = [], 0
    while at < len(line):
        end = min(at + MOST, len(line))
        if end < len(line):
            mark = max(line.rfind(c, at, end) for c in MARKS)
            end = mark + 1 if mark > at + MOST / 2 else end
        out.append((at, end))
        at = end
    return out


def split(texts: DataFrame) -> DataFrame:
    """(doc_id, paragraph, source, fragment, start, stop, text) of ``texts(doc_id, text)``, numbers from 0, places in characters of the text.

    ``source`` counts the lines, blank ones too, ``fragment`` the pieces of a line; blank pieces are no paragraphs, and space around one is not
    part of it. Null and blank texts have none. Ids must be unique and not null.
    """

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def pieces(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [{"a": a, "b": b} for a, b in cuts(x)])

    rows = texts.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("source", "line"))
    before = Window.partitionBy("doc_id").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("base", F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0)))
    # only lines that are too long go to the helper
    short = F.char_length("line") <= MOST
    whole = rows.where(short).select("doc_id", "source", F.lit(0).alias("fragment"), F.col("base").alias("at"), F.col("line").alias("piece"))
    long = rows.where(~short).select("doc_id", "source", "base", "line", F.posexplode(pieces("line")).alias("fragment", "p"))
    long = long.select("doc_id", "source", "fragment", (F.col("base") + F.col("p.a")).alias("at"), F.substring("line", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")).alias("piece"))
    out = whole.unionByName(long).withColumn("text", F.regexp_replace("piece", f"^{SPACE}+|{SPACE}+$", "")).where("text <> ''")
    start = F.col("at") + F.char_length("piece") - F.char_length(F.regexp_replace("piece", f"^{SPACE}+", ""))
    order = Window.partitionBy("doc_id").orderBy("source", "fragment")
    out = out.withColumn("paragraph", F.row_number().over(order) - 1).withColumn("start", start)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph", "source", "fragment", "start")], (F.col("start") + F.char_length("text")).cast("long").alias("stop"), "text")
