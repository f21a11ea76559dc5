"""Recovering what false redactions hide: overlays (A), marks that were never applied (B), earlier revisions (C), and notes where text was found (D).

On the text layer these are tables; documents.restored() does the same to files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.geometry import AUDIT_BAR
from inkveil.operators import annotations as notes
from inkveil.operators import paths, redact

CONFIDENCE = {"A": 0.9, "B": 1.0, "C": 0.95, "D": 0.85}
#: Where a note stands: so far right of the region, and so large.
NOTE_GAP, NOTE_SIZE = 5.0, 18.0


def _finding(rows: DataFrame, key: str, scenario: str, text: str | None = None, box: bool = True) -> DataFrame:
    corners = [F.col(c).cast("double").alias(c) if box else F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    page = F.col("page").cast("int").alias("page") if box else F.lit(None).cast("int").alias("page")
    return rows.select(key, F.lit(scenario).alias("scenario"), page, *corners, (F.col(text) if text else F.lit(None).cast("string")).alias("recovered_text"), F.lit(CONFIDENCE[scenario]).alias("confidence"))


def strip_overlays(items: DataFrame, ops: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The operations that stay when filled rectangles over text go, each with its whole path; and a finding a rectangle. Pages without text stay."""
    rects = paths.filled_rects(ops, key, AUDIT_BAR)
    found = redact.text_under_overlays(items, rects, key)
    spans = rects.join(found, [key, "page", "rect_idx"])
    return paths.without_spans(ops, spans, key), _finding(spans, key, "A", "recovered_text")


def strip_annotations(annotations: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The annotations that stay, and a finding for each page that loses some."""
    stays, first = notes.stripped_annotations(annotations, key)
    return stays, _finding(first, key, "B")


def prior_revisions(raw: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A finding for each document with an earlier revision; redact.revision_markers() gives the revision."""
    return _finding(redact.revision_markers(raw, text, key), key, "C", box=False)


def candidate_notes(overlays: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Notes (text, place) beside the regions of overlay findings, and their findings; those without page or box are skipped."""
    rows = overlays.filter("scenario = 'A' and page is not null and x1 is not null")
    text = F.when(F.length("recovered_text") > 0, F.concat(F.lit('[restore] Recovered text: "'), F.col("recovered_text"), F.lit('"'))).otherwise("[restore] Redaction overlay removed - possible hidden content")
    x, y = F.col("x2") + NOTE_GAP, (F.col("y1") + F.col("y2")) / 2
    made = rows.select(key, "page", text.alias("contents"), x.alias("x1"), y.alias("y1"), (x + NOTE_SIZE).alias("x2"), (y + NOTE_SIZE).alias("y2"))
    return made, _finding(rows, key, "D", "recovered_text")


def restore(docs: DataFrame, items: DataFrame, ops: DataFrame, annotations: DataFrame, raw: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """All findings, and for every document overlays_stripped, annotations_removed, prior_revision_recovered."""
    overlays = strip_overlays(items, ops, key)[1]
    found = overlays.unionByName(strip_annotations(annotations, key)[1]).unionByName(prior_revisions(raw, key=key)).unionByName(candidate_notes(overlays, key)[1])
    removed = annotations.filter(F.col("subtype") == notes.MARK).groupBy(key).agg(F.count("*").alias("annotations_removed"))
    per = found.groupBy(key).agg(F.count_if(F.col("scenario") == "A").alias("overlays_stripped"), F.bool_or(F.col("scenario") == "C").alias("prior_revision_recovered"))
    rows = docs.select(key).join(per, key, "left").join(removed, key, "left")
    return found, rows.select(key, F.coalesce("overlays_stripped", F.lit(0)).alias("overlays_stripped"), F.coalesce("annotations_removed", F.lit(0)).alias("annotations_removed"), F.coalesce("prior_revision_recovered", F.lit(False)).alias("prior_revision_recovered"))
