"""Filled rectangles and images of pages from their operations (key, page, op_idx, op, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import canonical

# The operators that fill a path, end it without, and paint images.
FILLS = ("f", "F", "f*", "B", "B*", "b", "b*")
ENDS = ("S", "s", "n")
PATH = ("re", "m", "l", "c", "v", "y")
IMAGES = ("paintImageXObject", "paintInlineImageXObject", "paintImageMaskXObject", "paintJpegXObject", "paintImageXObjectRepeat", "paintImageMaskXObjectRepeat", "paintImageMaskXObjectGroup", "paintInlineImageXObjectGroup", "paintSolidColorImageMask", "BI", "Do image")


def filled_rects(ops: DataFrame, key: str = "doc_id", least: tuple[float, float] = (0.0, 0.0), ends_clear: bool = True) -> DataFrame:
    """Each fill's last rectangle since the fill before: key, page, rect_idx (the fill's place), first_op (where its path begins), x1, y1, x2, y2.

    ends_clear: operators that end a path without filling it take the rectangle away too (the audit's rule; verifying
    keeps it). Corners are put in order; rectangles smaller than least are left out. The rows of a page are one window.
    """
    clears = F.col("op").isin(*FILLS, *(ENDS if ends_clear else ()))
    # a fill belongs to what stands before it, so only earlier ones are counted
    page = W.partitionBy(key, "page").orderBy("op_idx")
    run = F.coalesce(F.sum(clears.cast("int")).over(page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = ops.withColumn("run", run)
    own = W.partitionBy(key, "page", "run").orderBy("op_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    rect = F.last(F.when((F.col("op") == "re") & (F.size("args") >= 4), F.col("args")), ignorenulls=True).over(own)
    first = F.first(F.when(F.col("op").isin(*PATH), F.col("op_idx")), ignorenulls=True).over(own)
    filled = rows.withColumns({"rect": rect, "first_op": first}).filter(F.col("op").isin(*FILLS) & F.col("rect").isNotNull())
    x, y = F.col("rect")[0], F.col("rect")[1]
    x1, y1, x2, y2 = canonical(x, y, x + F.col("rect")[2], y + F.col("rect")[3])
    out = filled.select(key, "page", F.col("op_idx").alias("rect_idx"), "first_op", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return out.filter((F.col("x2") - F.col("x1") >= least[0]) & (F.col("y2") - F.col("y1") >= least[1]))


def without_spans(ops: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The operations outside of spans (key, page, first_op, rect_idx, both ends included)."""
    same = (F.col(f"o.{key}") == F.col(f"s.{key}")) & (F.col("o.page") == F.col("s.page"))
    return ops.alias("o").join(spans.alias("s"), same & F.col("o.op_idx").between(F.col("s.first_op"), F.col("s.rect_idx")), "left_anti")


def paints_image(op: Column) -> Column:
    """Whether an operation paints an image; false for an unknown one."""
    return F.coalesce(op.isin(*IMAGES), F.lit(False))


def image_pages(ops: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each page whether an operation paints an image: key, page, has_image."""
    return ops.groupBy(key, "page").agg(F.bool_or(paints_image(F.col("op"))).alias("has_image"))
