"""Annotations of pages, and regions from a detector of the caller's own.

annotations has key, page, annot_idx, subtype, x1, y1, x2, y2 (bottom-left).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.session import ship

#: The subtype of an annotation that marks text for a redaction which was never applied.
MARK = "Redact"
_ITEM, _BOX = ["str", "x", "y", "width", "height"], ["x", "y", "width", "height"]


def pending_annotations(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    """A CRITICAL finding with its box for each redaction that is marked only."""
    return annotations.filter(F.col("subtype") == MARK).select(key, "page", "annot_idx", F.lit("CRITICAL").alias("severity"), "x1", "y1", "x2", "y2")


def stripped_annotations(annotations: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The annotations that stay, and one finding for each page that loses some: its first mark's box, and how many went.

    Annotations without a subtype stay.
    """
    marks = annotations.filter(F.col("subtype") == MARK)
    stays = annotations.filter(~F.col("subtype").eqNullSafe(MARK))
    page = W.partitionBy(key, "page")
    first = marks.withColumns({"_n": F.row_number().over(page.orderBy("annot_idx")), "removed": F.count("*").over(page)}).filter("_n = 1")
    return stays, first.select(key, "page", "removed", "x1", "y1", "x2", "y2")


def detected_regions(items: DataFrame, detector: Callable[[pd.DataFrame, int], pd.DataFrame], height: float, label: str | None = None, key: str = "doc_id") -> DataFrame:
    """Regions (top-left) of the boxes (x, y, width, height; bottom-left) that a detector returns for each page's items.

    The detector is called once for every page that has an item, with the items in order and the page number; what it
    returns is taken as it is, without padding. A page's items are few, so a page is one group.
    """
    names = [key, "page", "region_idx", *_BOX]
    schema = T.StructType([items.schema[key], items.schema["page"], T.StructField("region_idx", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in _BOX]])

    ship(items.sparkSession)

    def page(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("item_idx")
        found = detector(group[_ITEM].reset_index(drop=True), int(group["page"].iloc[0]))
        found = pd.DataFrame(found, columns=_BOX).astype("float64").reset_index(drop=True)
        return found.assign(**{key: group[key].iloc[0], "page": group["page"].iloc[0], "region_idx": range(len(found))})[names]

    boxes = items.select(key, "page", "item_idx", *_ITEM).filter(F.length(F.trim("str")) > 0).groupBy(key, "page").applyInPandas(page, schema)
    return boxes.withColumns({"y": F.lit(height) - F.col("y") - F.col("height"), "label": F.lit(label).cast("string")})


#: Pages of a document and characters of a page that a model is asked about, and the shortest text it is asked about (limits of the interface).
MODEL_PAGES, MODEL_CHARS, MODEL_LEAST = 12, 6000, 3


def model_entities(texts: DataFrame, model: Callable[[str], list[tuple[str, str]]], key: str = "doc_id") -> DataFrame:
    """What a model of the caller's finds in page texts: key, page, seq, type, text, as detect.supplied() takes it.

    The model gets one page's text and gives (type, text) pairs. A page at which it fails gives nothing and stops no other;
    texts of one character are left out.
    """
    rows = texts.filter(F.col("page") <= MODEL_PAGES).select(key, "page", F.substring("text", 1, MODEL_CHARS).alias("text")).filter(F.length("text") >= MODEL_LEAST)
    schema = T.StructType([rows.schema[key], rows.schema["page"], T.StructField("seq", T.LongType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
    names = schema.names
    ship(texts.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for k, page, text in zip(batch[key], batch["page"], batch["text"], strict=True):
                try:
                    found = list(model(text))
                except Exception:  # noqa: BLE001  (a model may fail in any way)
                    continue
                out += [(k, page, n, kind, value) for n, (kind, value) in enumerate(found) if len(value) > 1]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)
