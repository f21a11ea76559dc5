"""Words that an OCR engine read, as tables: blocks to lines, and the words that matches touch.

The engine itself is not part of this package: it gives blocks, array<struct<paragraphs: array<struct<lines:
array<struct<words: array<struct<text, x0, y0, x1, y1>>>>>>>>, in pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.patterns import Pattern
from inkveil.operators import detect

#: Pixels that a burnt box is larger than its word on each side.
PADDING = 2.0


def lines_of_blocks(pages: DataFrame, blocks: str = "blocks", keys: tuple[str, ...] = ("doc_id", "page"), patterns: list[Pattern] | None = None) -> DataFrame:
    """keys, line, word_idx, text, x0, y0, x1, y1: the words that aren't blank, in lines that have one.

    With patterns only lines that one of them matches are given, which spares words_hit() the sorting of all others.
    """
    lines = F.flatten(F.transform(F.flatten(F.transform(F.col(blocks), lambda b: b["paragraphs"])), lambda p: p["lines"]))
    kept = F.filter(F.transform(lines, lambda l: F.filter(l["words"], lambda w: F.trim(w["text"]) != "")), lambda words: F.size(words) > 0)
    rows = pages.select(*keys, F.posexplode(kept).alias("line", "words"))
    if patterns is not None:
        text, some = F.array_join(F.transform("words", lambda w: w["text"]), " "), F.lit(False)
        for p in patterns:
            some = some | (F.col("_text").rlike(p.hint) & F.col("_text").rlike(p.regex) if p.hint else F.col("_text").rlike(p.regex))
        rows = rows.withColumn("_text", text).filter(some).drop("_text")
    return rows.select(*keys, "line", F.posexplode("words").alias("word_idx", "w")).select(*keys, "line", "word_idx", "w.text", "w.x0", "w.y0", "w.x1", "w.y1")


def words_hit(words: DataFrame, patterns: list[Pattern], keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The words (once each) that a match in their line's text touches; a line is its words joined by spaces."""
    line = W.partitionBy(*keys, "line").orderBy("word_idx")
    end = F.sum(F.length("text") + 1).over(line) - 1
    placed = words.withColumns({"to": end, "from": end - F.length("text")})
    parts = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    texts = words.groupBy(*keys, "line").agg(F.array_join(F.transform(parts, lambda s: s["text"]), " ").alias("text"))
    found = detect.matches(texts, patterns, keys=(*keys, "line"))
    same = F.lit(True)
    for k in (*keys, "line"):
        same = same & (F.col(f"w.{k}") == F.col(f"m.{k}"))
    touch = same & (F.col("w.to") > F.col("m.start_off")) & (F.col("w.from") < F.col("m.end_off"))
    return placed.alias("w").join(found.alias("m"), touch, "left_semi").drop("to", "from")


def burnt_boxes(hit: DataFrame) -> DataFrame:
    """The boxes that cover words, in pixels, with padding."""
    return hit.withColumns({"x0": F.col("x0") - PADDING, "y0": F.col("y0") - PADDING, "x1": F.col("x1") + PADDING, "y1": F.col("y1") + PADDING})


def redacted_count(hit: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words covered, not matches: key, redacted_count."""
    return hit.groupBy(key).agg(F.count("*").alias("redacted_count"))
