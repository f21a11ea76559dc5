"""The relational text layer: documents as positioned text items, page texts, and regions of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import PADDING, with_units

#: Lines on a page, the page's height, and where lines stand.
LINES, HEIGHT, TOP, PITCH, LEFT, SIZE = 50, 792.0, 742.0, 14.0, 72.0, 10.0
#: Items whose heights on the page differ by no more stand in one line.
TOLERANCE = 2.0


def text_items(df: DataFrame, text: str = "text", key: str = "doc_id", widths: bool = True) -> DataFrame:
    """One item for each line that is not blank: key, page, item_idx, str, x, y, width, height. Without widths they are 0, which is quicker."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "str"))
    lines = lines.filter(F.length(F.trim("str")) > 0)
    lines = with_units(lines, "str") if widths else lines.withColumn("units", F.lit(0))
    width = F.col("units").cast("double") / 1000 * SIZE
    return lines.select(
        key, (F.floor(F.col("n") / LINES) + 1).cast("int").alias("page"), F.col("n").cast("long").alias("item_idx"), "str",
        F.lit(LEFT).alias("x"), (F.lit(TOP) - PITCH * (F.col("n") % LINES)).alias("y"), width.alias("width"), F.lit(SIZE).alias("height"),
    )


def placed_items(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Items in reading order (down, then right, then as given) with start_off and end_off in their page's text.

    The order is total; items of one line are joined by a space, lines by a line end. A page is one window.
    """
    page = W.partitionBy(key, "page")
    down = page.orderBy(F.desc("y"), "x", "item_idx")
    lines = items.withColumn("break", (F.coalesce(F.lag("y").over(down), F.col("y")) - F.col("y") > TOLERANCE).cast("int"))
    lines = lines.withColumn("line", F.sum("break").over(down))
    order = page.orderBy("line", "x", "item_idx")
    seen = lines.withColumns({"order": F.row_number().over(order), "next": F.lead("line").over(order)})
    glue = F.when(F.col("next").isNull(), "").when(F.col("next") == F.col("line"), " ").otherwise("\n")
    seen = seen.withColumn("glue", glue)
    run = F.sum(F.length("str") + F.length("glue")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    start = run - F.length("str") - F.length("glue")
    return seen.select(*items.columns, "line", "order", "glue", start.cast("long").alias("start_off"), (start + F.length("str")).cast("long").alias("end_off"))


def page_texts(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page, text. A page's items are few: they are collected in order."""
    parts = F.array_sort(F.collect_list(F.struct("order", F.concat("str", "glue").alias("s"))))
    return placed.groupBy(key, "page").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"))


def match_regions(found: DataFrame, placed: DataFrame, key: str = "doc_id", height: float = HEIGHT) -> DataFrame:
    """Regions (top-left, padded) around the whole items that matches touch; found has key, page, type, match_idx, start_off, end_off."""
    m, i = found.alias("m"), placed.alias("i")
    touch = (F.col(f"m.{key}") == F.col(f"i.{key}")) & (F.col("m.page") == F.col("i.page")) & (F.col("i.end_off") > F.col("m.start_off")) & (F.col("i.start_off") < F.col("m.end_off"))
    box = m.join(i, touch).groupBy(f"m.{key}", "m.page", "m.type", "m.match_idx").agg(F.min("i.x").alias("x1"), F.min("i.y").alias("y1"), F.max(F.col("i.x") + F.col("i.width")).alias("x2"), F.max(F.col("i.y") + F.col("i.height")).alias("y2"))
    return box.select(key, "page", "type", "match_idx", (F.col("x1") - PADDING).alias("x"), (F.lit(height) - F.col("y2") - PADDING).alias("y"), (F.col("x2") - F.col("x1") + 2 * PADDING).alias("width"), (F.col("y2") - F.col("y1") + 2 * PADDING).alias("height"))


def normalized(regions: DataFrame, height: float | Column = HEIGHT) -> DataFrame:
    """Regions with x1, y1, x2, y2 in bottom-left coordinates."""
    top = (height if isinstance(height, Column) else F.lit(height)) - F.col("y")
    return regions.withColumns({"x1": F.col("x"), "y1": top - F.col("height"), "x2": F.col("x") + F.col("width"), "y2": top})
