"""Redaction, verification and audit of the text layer as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import AUDIT_BAR, INSET, VERIFY_BAR, canonical, overlaps, text_units
from inkveil.functions.patterns import METADATA, PLAIN_LABEL, Pattern, entity_patterns, java
from inkveil.operators import detect, layout

# The fields that sanitising blanks, those it sets to the epoch, and how a date is written.
BLANKED, DATES, EPOCH = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer"), ("CreationDate", "ModDate"), "D:19700101000000Z"


def _item(a: str) -> tuple[Column, ...]:
    return F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{a}.x") + F.col(f"{a}.width"), F.col(f"{a}.y") + F.col(f"{a}.height")


def _box(a: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2"))


def _same_page(a: str, b: str, key: str) -> Column:
    return (F.col(f"{a}.{key}") == F.col(f"{b}.{key}")) & (F.col(f"{a}.page") == F.col(f"{b}.page"))


def regions_with_text(regions: DataFrame, items: DataFrame, key: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """Regions (with x1..y2) that text lies under; how left_anti: those that cover no text."""
    return regions.alias("r").join(items.alias("i"), _same_page("r", "i", key) & overlaps(_item("i"), _box("r")), how)


def on_pages(regions: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """The regions whose page there is; the others are skipped and not counted."""
    return regions.join(pages.select(key, "page").distinct(), [key, "page"], "left_semi")


def redaction_summary(docs: DataFrame, regions: DataFrame, key: str = "doc_id", pages: DataFrame | None = None) -> DataFrame:
    """For every document: redacted_count and pages_affected (ascending), of regions on pages that there are if pages are given."""
    regions = regions if pages is None else on_pages(regions, pages, key)
    per = regions.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("p"))
    return docs.select(key).join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("redacted_count"), F.coalesce("p", F.array().cast("array<int>")).alias("pages_affected"))


def redaction_warnings(pages: DataFrame, regions: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """One warning at most for each redacted page: scanned-page, or visual-only-region. pages has has_image."""
    text = items.groupBy(key, "page").agg(F.lit(True).alias("has_text"))
    bare = regions_with_text(regions, items, key, "left_anti").groupBy(key, "page").agg(F.count("*").alias("bare"))
    seen = regions.select(key, "page").distinct().join(pages, [key, "page"]).join(text, [key, "page"], "left").join(bare, [key, "page"], "left")
    has_text, image = F.coalesce("has_text", F.lit(False)), F.coalesce("has_image", F.lit(False))
    kind = F.when(image & ~has_text, "scanned-page").when((F.coalesce("bare", F.lit(0)) > 0) & (image | has_text), "visual-only-region")
    return seen.select(key, "page", kind.alias("type")).filter("type is not null")


def _in_order(bars: DataFrame, key: str) -> DataFrame:
    """Bars with their corners in order: a bar may be drawn with a negative width or height."""
    x1, y1, x2, y2 = canonical(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return bars.select(key, "page", "rect_idx", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def verify_warnings(pages: DataFrame, items: DataFrame, bars: DataFrame, key: str = "doc_id") -> DataFrame:
    """One warning at most for each page with an image: scanned-page if it has no text, else image-under-redaction if it has a bar."""
    text = items.groupBy(key, "page").agg(F.lit(True).alias("has_text"))
    bar = _in_order(bars, key).filter((F.col("x2") - F.col("x1") >= VERIFY_BAR[0]) & (F.col("y2") - F.col("y1") >= VERIFY_BAR[1])).groupBy(key, "page").agg(F.lit(True).alias("has_bar"))
    seen = pages.filter("has_image").select(key, "page").join(text, [key, "page"], "left").join(bar, [key, "page"], "left")
    kind = F.when(F.col("has_text").isNull(), "scanned-page").when(F.col("has_bar"), "image-under-redaction")
    return seen.select(key, "page", kind.alias("type")).filter("type is not null")


def greedy_text_under_box(items: DataFrame, bars: DataFrame, key: str = "doc_id") -> DataFrame:
    """Items in order take the first bar over them (by the inset overlap) that no item before has taken: one finding a bar and an item at most.

    Bars that agree in all corners to one decimal are one. The items of a page that lie under bars are folded in one array.
    """
    bars = _in_order(bars, key).filter((F.col("x2") - F.col("x1") >= AUDIT_BAR[0]) & (F.col("y2") - F.col("y1") >= AUDIT_BAR[1]))
    high = F.coalesce(F.nullif(F.col("i.height"), F.lit(0.0)), F.lit(10.0))
    item = (F.col("i.x"), F.col("i.y"), F.col("i.x") + F.col("i.width"), F.col("i.y") + high)
    met = items.alias("i").join(bars.alias("b"), _same_page("i", "b", key) & overlaps(item, _box("b"), INSET))
    name = F.concat_ws(",", *[F.round(f"b.{c}", 1).cast("string") for c in ("x1", "y1", "x2", "y2")])
    rect = F.struct(F.col("b.rect_idx").alias("rect_idx"), name.alias("name"), *[F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    each = met.groupBy(f"i.{key}", "i.page", "i.item_idx").agg(F.first("i.str").alias("recovered_text"), F.array_sort(F.collect_list(rect)).alias("rects"))
    queue = each.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("item_idx", "recovered_text", "rects"))).alias("queue"))
    none = F.expr("cast(array() as array<struct<item_idx:bigint,recovered_text:string,rect:struct<rect_idx:bigint,name:string,x1:double,y1:double,x2:double,y2:double>>>)")

    def take(found: Column, one: Column) -> Column:
        free = F.filter(one["rects"], lambda r: ~F.exists(found, lambda f: f["rect"]["name"] == r["name"]))
        got = F.struct(one["item_idx"].cast("long").alias("item_idx"), one["recovered_text"].alias("recovered_text"), free[0].cast("struct<rect_idx:bigint,name:string,x1:double,y1:double,x2:double,y2:double>").alias("rect"))
        return F.when(F.size(free) > 0, F.concat(found, F.array(got))).otherwise(found)

    taken = queue.select(key, "page", F.explode(F.aggregate("queue", none, take)).alias("f"))
    return taken.select(key, "page", F.col("f.item_idx").alias("item_idx"), "f.rect.rect_idx", "f.rect.x1", "f.rect.y1", "f.rect.x2", "f.rect.y2", F.col("f.recovered_text").alias("recovered_text"))


def violations(items: DataFrame, bars: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text under bars: each item with the first bar that covers any of it, and the overlap's box."""
    bars = _in_order(bars, key).filter((F.col("x2") - F.col("x1") >= VERIFY_BAR[0]) & (F.col("y2") - F.col("y1") >= VERIFY_BAR[1]))
    a, b = _item("i"), _box("b")
    met = items.alias("i").join(bars.alias("b"), _same_page("i", "b", key) & overlaps(a, b))
    first = F.min(F.struct(F.col("b.rect_idx").alias("rect_idx"), F.greatest(a[0], b[0]).alias("x1"), F.greatest(a[1], b[1]).alias("y1"), F.least(a[2], b[2]).alias("x2"), F.least(a[3], b[3]).alias("y2")))
    return met.groupBy(f"i.{key}", "i.page", "i.item_idx").agg(first.alias("f"), F.first("i.str").alias("recovered_text")).select(key, "page", "item_idx", "f.*", "recovered_text")


def clean_flags(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """For every document whether nothing was found. If docs have a status, only those that could be read (ok) can be clean."""
    per = found.groupBy(key).agg(F.count("*").alias("n"))
    readable = F.col("status") == "ok" if "status" in docs.columns else F.lit(True)
    return docs.join(per, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n_findings"), (F.col("n").isNull() & readable).alias("clean"))


def text_under_box(items: DataFrame, bars: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each bar of the audit's size the first item below it (in item order), by the inset overlap.

    An item without height counts as 10 high. Each bar gives one finding at most; items are not used up, for which there is greedy_text_under_box().
    """
    bars = _in_order(bars, key).filter((F.col("x2") - F.col("x1") >= AUDIT_BAR[0]) & (F.col("y2") - F.col("y1") >= AUDIT_BAR[1]))
    high = F.coalesce(F.nullif(F.col("i.height"), F.lit(0.0)), F.lit(10.0))
    item = (F.col("i.x"), F.col("i.y"), F.col("i.x") + F.col("i.width"), F.col("i.y") + high)
    met = items.alias("i").join(bars.alias("b"), _same_page("i", "b", key) & overlaps(item, _box("b"), INSET))
    return met.groupBy(f"b.{key}", "b.page", "b.rect_idx").agg(F.min(F.struct("i.item_idx", "i.str")).alias("f")).select(key, "page", "rect_idx", F.col("f.str").alias("recovered_text"))


def text_under_overlays(items: DataFrame, bars: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each bar all text below it, joined by spaces in item order."""
    bars = _in_order(bars, key).filter((F.col("x2") - F.col("x1") >= AUDIT_BAR[0]) & (F.col("y2") - F.col("y1") >= AUDIT_BAR[1]))
    high = F.coalesce(F.nullif(F.col("i.height"), F.lit(0.0)), F.lit(10.0))
    item = (F.col("i.x"), F.col("i.y"), F.col("i.x") + F.col("i.width"), F.col("i.y") + high)
    met = items.alias("i").join(bars.alias("b"), _same_page("i", "b", key) & overlaps(item, _box("b"), INSET))
    parts = F.array_sort(F.collect_list(F.struct("i.item_idx", "i.str")))
    return met.groupBy(f"b.{key}", "b.page", "b.rect_idx").agg(F.array_join(F.transform(parts, lambda s: s["str"]), " ").alias("recovered_text"))


def revision_markers(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents saved more than once: markers counted, and the text up to the first (the prior revision)."""
    n = F.regexp_count(F.col(text), F.lit("%%EOF"))
    return df.select(key, n.cast("long").alias("n_markers"), F.substring(F.col(text), F.lit(1), F.instr(F.col(text), "%%EOF") + 4).alias("prior")).filter("n_markers > 1")


def sanitized_metadata(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """The metadata that a redacted document keeps: six fields blank, both dates at the epoch, nothing of the XMP packet."""
    value = F.when(F.col("field").isin(*BLANKED), F.lit("")).when(F.col("field").isin(*DATES), F.lit(EPOCH)).otherwise(F.col("value"))
    return meta.filter("kind = 'info'").withColumn("value", value)


def labelled_bars(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions (x1..y2) with the label that is set in each bar (its code, else its label, else REDACTED), its size and place; null where it doesn't fit."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    text = F.coalesce(F.col("exemption_code"), F.col("label"), F.lit(PLAIN_LABEL))
    rows = regions.withColumns({"text": text, "size": F.least(high * 0.6, F.lit(10.0))})
    rows = rows.withColumns({"text_x": F.col("x1") + (wide - text_units(F.col("text"), "Helvetica") / 1000 * F.col("size")) / 2, "text_y": F.col("y1") + (high - F.col("size")) / 2})
    fits = (F.col("text_x") > F.col("x1")) & (F.col("text_y") > F.col("y1"))
    return rows.withColumns({c: F.when(fits, F.col(c)) for c in ("text", "size", "text_x", "text_y")})


def entries(regions: DataFrame, hashes: DataFrame, key: str = "doc_id", redactor: str | None = None, basis_code: str | None = None, created_at: str | None = None) -> DataFrame:
    """The log: a row for each region, with the document's hashes (sha256_before, sha256_after). created_at is one ISO time for the whole run."""
    rows = regions.join(hashes.select(key, "sha256_before", "sha256_after"), key)
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    code = F.coalesce(F.col("exemption_code"), F.lit(basis_code).cast("string"))
    return rows.select(
        key, "region_idx", "page", box.alias("bbox"), code.alias("basis_code"), F.col("exemption_basis").alias("basis_text"), "label",
        F.lit(redactor).cast("string").alias("redactor_id"), F.lit(created_at).cast("string").alias("timestamp"), "sha256_before", "sha256_after",
    )


def manifests(docs: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each document its manifest: created_at, redactor_id, entries (in order), sha256_input, sha256_output. docs have both hashes; a document without regions has no entries."""
    each = F.struct("page", "region_idx", "bbox", "basis_code", "basis_text", "label", "redactor_id", "timestamp", "sha256_before", "sha256_after")
    per = log.groupBy(key).agg(F.array_sort(F.collect_list(each)).alias("entries"), F.first("timestamp").alias("created_at"), F.first("redactor_id").alias("redactor_id"))
    kind = dict(per.dtypes)["entries"]
    return docs.join(per, key, "left").select(key, "created_at", "redactor_id", F.coalesce("entries", F.array().cast(kind)).alias("entries"), F.col("sha256_before").alias("sha256_input"), F.col("sha256_after").alias("sha256_output"))


def manifest_json(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Manifests as JSON: key, manifest."""
    return found.select(key, F.to_json(F.struct(*[c for c in found.columns if c != key])).alias("manifest"))


def summary_json(results: DataFrame, warnings: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a run says of each document: counts, pages and warnings as JSON: key, summary."""
    per = warnings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "type"))).alias("warnings"))
    kind = dict(per.dtypes)["warnings"]
    rows = results.join(per, key, "left").withColumn("warnings", F.coalesce("warnings", F.array().cast(kind)))
    return rows.select(key, F.to_json(F.struct("redacted_count", "pages_affected", "warnings")).alias("summary"))


def merged(one: DataFrame, other: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two results of the same documents as one (patterns first, then regions on what they left): counts added, pages united."""
    a, b = one.alias("a"), other.alias("b")
    none = F.array().cast("array<int>")
    pages = F.array_sort(F.array_union(F.coalesce("a.pages_affected", none), F.coalesce("b.pages_affected", none)))
    return a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), (F.coalesce("a.redacted_count", F.lit(0)) + F.coalesce("b.redacted_count", F.lit(0))).alias("redacted_count"), pages.alias("pages_affected"))


def redact(docs: DataFrame, pages: DataFrame, items: DataFrame, regions: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Redaction on the text layer: regions (with x1..y2, label, exemption_code, exemption_basis) on pages that there are.

    Gives results (a row a document), warnings, bars (with labels), text (items that stay) and hidden (those that don't).
    """
    regions = on_pages(regions, pages, key)
    under = overlaps(_item("i"), _box("r")) & _same_page("i", "r", key)
    return {
        "results": redaction_summary(docs, regions, key),
        "warnings": redaction_warnings(pages, regions, items, key),
        "bars": labelled_bars(regions, key),
        "text": items.alias("i").join(regions.alias("r"), under, "left_anti"),
        "hidden": items.alias("i").join(regions.alias("r"), under, "left_semi"),
    }


def searched_regions(placed: DataFrame, patterns: list[Pattern], height: float | DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions (top-left) of what patterns find in page texts, with each pattern's label, codes and colour; matches that overlap stay regions of their own.

    placed are items in reading order (layout.placed_items); height is one for all pages, or a frame (key, page, height).
    """
    found = detect.matches(layout.page_texts(placed, key), patterns, keys=(key, "page"))
    boxes = layout.match_regions(found, placed, key, 0.0 if isinstance(height, DataFrame) else height)
    if isinstance(height, DataFrame):
        boxes = boxes.join(height.select(key, "page", F.col("height").alias("_high")), [key, "page"], "left").withColumn("y", F.col("y") + F.coalesce("_high", F.lit(0.0))).drop("_high")
    about = {p.name: p for p in patterns}

    def of(value) -> Column:
        out = F.lit(None)
        for p in about.values():
            out = F.when(F.col("type") == p.name, value(p)).otherwise(out)
        return out

    color = of(lambda p: F.array(*[F.lit(float(c)) for c in p.color or (0, 0, 0)]))
    order = W.partitionBy(key).orderBy("type", "page", "match_idx")  # the regions of one document
    return boxes.withColumns({"label": of(lambda p: F.lit(p.label)).cast("string"), "exemption_code": of(lambda p: F.lit(p.code)).cast("string"), "exemption_basis": of(lambda p: F.lit(p.basis)).cast("string"), "color": color, "region_idx": F.row_number().over(order) - 1})


def search_and_redact(docs: DataFrame, pages: DataFrame, items: DataFrame, patterns: list[Pattern], height: float | DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """redact() for what patterns find; also gives the regions (with x1..y2)."""
    found = searched_regions(layout.placed_items(items, key), patterns, height, key)
    if isinstance(height, DataFrame):
        found = found.join(height.select(key, "page", F.col("height").alias("_high")), [key, "page"], "left")
        regions = layout.normalized(found, F.coalesce("_high", F.lit(0.0))).drop("_high")
    else:
        regions = layout.normalized(found, height)
    return redact(docs, pages, items, regions, key) | {"regions": regions}


def redact_entities(docs: DataFrame, pages: DataFrame, items: DataFrame, types: list[str] | None, height: float | DataFrame, codes: dict[str, str] | None = None, key: str = "doc_id") -> dict[str, DataFrame]:
    """search_and_redact() for entity types, with their labels and exemption codes."""
    return search_and_redact(docs, pages, items, entity_patterns(types, codes), height, key)


def metadata_findings(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """INFO for each field of the Info dictionary that is not blank; MEDIUM with the first sensitive label that matches."""
    full = meta.filter(F.length(F.trim("value")) > 0)
    label = F.lit(None).cast("string")
    for name, pattern in reversed(METADATA.items()):
        label = F.when(F.col("value").rlike(java(pattern)), name).otherwise(label)
    info = full.filter("kind = 'info'").select(key, "field", F.lit("INFO").alias("severity"), F.substring("value", 1, 120).alias("detail"))
    medium = full.select(key, "field", F.lit("MEDIUM").alias("severity"), F.concat(label, F.lit(": "), F.substring("value", 1, 120)).alias("detail")).filter("detail is not null")
    return info.unionByName(medium)


def deduplicated(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first finding of those with equal keys."""
    return findings.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")
