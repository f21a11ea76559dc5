"""What the three requests of the interface do, as plain functions over frames of documents; there is no server here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions.patterns import entity_patterns, handed_patterns
from inkveil.operators import audit, detect, documents
from inkveil.sources import files

#: Strings of a failed self-check that are reported of each document.
RECOVERED = 5


def detected(scanned: DataFrame, key: str = "doc_id", supplied: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all entity types (and those of a model outside, in the shape of detect.supplied), and for each document total and scanned."""
    texts = files.page_texts(files.text_items(scanned, key), key)
    found = detect.first_seen(detect.matches(texts, entity_patterns(), keys=(key, "page")), key).withColumn("tier", F.lit("regex"))
    if supplied is not None:
        found = found.unionByName(supplied)
    whole = texts.groupBy(key).agg(F.concat_ws("", F.collect_list("text")).alias("text"))  # the pages of one document
    totals = found.groupBy(key).agg(F.sum("count").alias("total"))
    rows = scanned.select(key, "status").join(whole, key, "left").join(totals, key, "left")
    return found, rows.select(key, "status", F.coalesce("total", F.lit(0)).alias("total"), detect.scanned(F.col("text")).alias("scanned"))


def redacted(docs: DataFrame, scanned: DataFrame, handoff: str, key: str = "doc_id") -> dict[str, DataFrame]:
    """Documents redacted by a handoff (JSON, see handed_patterns), and response: encoded, redacted_count, verified, recovered (the first few strings that verifying still finds)."""
    found = documents.search_files(docs, handed_patterns(handoff), scanned, key)
    again = documents.verify_files(files.scan(found["files"].select(key, "content"), key=key, parts=("items", "ops")), key)
    left = again["violations"].groupBy(key).agg(F.slice(F.array_sort(F.collect_list("recovered_text")), 1, RECOVERED).alias("recovered"))
    rows = found["files"].join(found["results"], key).join(again["results"].select(key, F.col("clean").alias("verified")), key).join(left, key, "left")
    return found | {"response": rows.select(key, files.encoded(F.col("content")).alias("encoded"), "redacted_count", "pages_affected", "verified", "recovered", "error", "sha256_before", "sha256_after")}


def audited(docs: DataFrame, scanned: DataFrame, glyph_position: bool = False, pattern_oracle: bool = False, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Findings and reports; the request may ask for the slower checks only, the others always run."""
    return documents.audit_files(docs, scanned, audit.Options(glyph_position=glyph_position, pattern_oracle=pattern_oracle), key)
