"""The audit: checks for redactions that only look like ones, as rows of one shape.

A finding has key, check, severity, page, x1, y1, x2, y2, detail, recovered_text. Checks take the tables of the
text layer; a document that couldn't be read has no rows there, so report() takes its status and never calls it clean.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkveil.functions.geometry import FALLBACK, FONTS, coded_moments, width_coded
from inkveil.functions.patterns import METADATA, java
from inkveil.operators.annotations import MARK
from inkveil.operators.redact import greedy_text_under_box

#: Thresholds of the glyph check: fewest characters, deviation of the width, coefficient of variation of the advances.
GLYPHS, DEVIATION, UNIFORM = 3, 0.15, 0.01
SHOWN, DETAIL, KEY_DETAIL = 30, 120, 60


@dataclass(frozen=True)
class Options:
    """Which checks run; pattern_oracle is accepted and does nothing."""

    text_under_box: bool = True
    incremental_save: bool = True
    metadata_leak: bool = True
    pending_annotation: bool = True
    glyph_position: bool = False
    pattern_oracle: bool = False


PRESETS = {"quick": Options(), "compliance": Options(glyph_position=True), "forensic": Options(glyph_position=True)}


def preset(name: str | None) -> Options:
    """Options by name; an unknown name means quick."""
    return PRESETS.get(name or "quick", PRESETS["quick"])


def finding(key: str, check: str, severity: str | Column, detail: Column, page: Column | None = None, box: tuple[Column, ...] | None = None, text: Column | None = None) -> list[Column]:
    none = F.lit(None)
    box = box or (none.cast("double"),) * 4
    return [
        F.col(key), F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (none.cast("int") if page is None else page.cast("int")).alias("page"),
        *[c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)], detail.alias("detail"), (none.cast("string") if text is None else text).alias("recovered_text"),
    ]


def check_text_under_box(items: DataFrame, rects: DataFrame, key: str = "doc_id") -> DataFrame:
    page = F.col("page")
    detail = F.concat(F.lit("Text hidden under filled rectangle on page "), page.cast("string"))
    return greedy_text_under_box(items, rects, key).select(*finding(key, "text-under-box", "CRITICAL", detail, page, tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("recovered_text")))


def check_incremental_save(raw: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """raw has the bytes of each document as a string with one character for each."""
    n = F.regexp_count(F.col(text), F.lit("%%EOF"))
    detail = F.concat(n.cast("string"), F.lit(" %%EOF markers found - prior revision may contain unredacted content"))
    return raw.filter(n > 1).select(*finding(key, "incremental-save", "HIGH", detail))


def sensitive_label(value: Column) -> Column:
    """The first label whose pattern a value matches, or null."""
    label = F.lit(None).cast("string")
    for name, pattern in reversed(METADATA.items()):
        label = F.when(value.rlike(java(pattern)), name).otherwise(label)
    return label


def check_metadata_leak(meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """INFO for each field of the Info dictionary that isn't blank, and MEDIUM for each field of either kind with a sensitive value."""
    full = meta.filter(F.length(F.regexp_replace("value", java("[{s}]+"), "")) > 0)
    start, field = F.substring("value", 1, DETAIL), F.col("field")
    info = full.filter("kind = 'info'").select(*finding(key, "metadata-leak", "INFO", F.concat(F.lit('Metadata field "'), field, F.lit('" contains: '), start)))
    where = F.when(F.col("kind") == "info", "Metadata").otherwise("XMP metadata")
    sure = full.withColumn("label", sensitive_label(F.col("value"))).filter("label is not null")
    return info.unionByName(sure.select(*finding(key, "metadata-leak", "MEDIUM", F.concat(where, F.lit(' field "'), field, F.lit('" may expose '), F.col("label"), F.lit(": "), start))))


def check_pending_annotation(annotations: DataFrame, key: str = "doc_id") -> DataFrame:
    page = F.col("page")
    detail = F.concat(F.lit("Unapplied redaction annotation on page "), page.cast("string"))
    return annotations.filter(F.col("subtype") == MARK).select(*finding(key, "pending-annotation", "CRITICAL", detail, page, tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))))


def resolved_font(name: Column) -> Column:
    """The standard font that a name stands for, by itself or by what follows its last underscore; null for others."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), "^/", "")
    tail = F.element_at(F.split(bare, "_"), -1)
    return F.when(bare.isin(*FONTS), bare).when(tail.isin(*FONTS), tail)


def expected_advances(items: DataFrame, metrics: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """items with units and squares: sums of the advances of their characters, by the font's own metrics, its standard table, or a constant.

    metrics are those of embedded fonts (key, font, char, advance); an item whose characters they all have goes by them.
    """
    tables: dict[tuple, list[str]] = {}
    for name, (widths, default) in FONTS.items():
        tables.setdefault((id(widths), default), []).append(name)
    n = F.length("str").cast("long")
    coded, units, squares = F.col("str"), n * FALLBACK, n * FALLBACK**2
    for names in tables.values():
        own = F.col("_font").isin(*names)
        first, second = coded_moments(F.col("_coded"), names[0])
        coded = F.when(own, width_coded(F.col("str"), names[0])).otherwise(coded)
        units, squares = F.when(own, first).otherwise(units), F.when(own, second).otherwise(squares)
    # generated, not projected: so texts are spelled and sums made once a row, however often later expressions name them
    out = items.withColumn("_font", resolved_font(F.col("font")))
    out = out.select("*", F.inline(F.array(F.struct(coded.alias("_coded")))))
    out = out.select("*", F.inline(F.array(F.struct(units.cast("double").alias("units"), squares.cast("double").alias("squares"))))).drop("_font", "_coded")
    if metrics is None:
        return out
    fonts = metrics.groupBy(key, "font").agg(F.map_from_entries(F.collect_list(F.struct("char", "advance"))).alias("advances"))  # no more than a font has characters
    out = out.join(fonts, [key, "font"], "left")
    own = F.transform(F.split("str", ""), lambda c: F.try_element_at("advances", c))
    whole = F.col("advances").isNotNull() & ~F.exists(own, lambda a: a.isNull())
    add = lambda f: F.aggregate(own, F.lit(0.0), lambda s, a: s + f(a))
    return out.withColumns({"units": F.when(whole, add(lambda a: a)).otherwise(F.col("units")), "squares": F.when(whole, add(lambda a: a * a)).otherwise(F.col("squares"))}).drop("advances")


def check_glyph_position(items: DataFrame, metrics: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """MEDIUM where a string's width isn't what its font says, else HIGH where all its characters are as wide.

    items has font and font_size. The second rule finds any text in a monospaced or unknown font, as its definition has it.
    """
    n, size, width = F.length("str"), F.abs("font_size"), F.col("width")
    rows = items.filter((n >= GLYPHS) & (F.length(F.trim("str")) > 0) & (size >= 1) & (width > 0))
    rows = expected_advances(rows, metrics, key).withColumn("expected", F.col("units") / 1000 * size).filter("expected > 0")
    off = F.abs(width - F.col("expected")) / F.col("expected")
    mean = F.col("units") / n
    spread = F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))) / mean
    severity = F.when(off > DEVIATION, "MEDIUM").when((spread < UNIFORM) & (n > GLYPHS), "HIGH")
    page, shown = F.col("page"), F.substring("str", 1, SHOWN)
    detail = F.when(off > DEVIATION, F.format_string('Character spacing deviation of %.1f%% on page %d (actual %.1fpt vs expected %.1fpt for "%s")', off * 100, page, width, F.col("expected"), shown))
    detail = detail.otherwise(F.format_string('Uniform inter-character spacing (CV=%.4f) on page %d for "%s"', spread, page, shown))
    high = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), size)
    box = (F.col("x"), F.col("y"), F.col("x") + width, F.col("y") + high)
    return rows.withColumn("_severity", severity).filter("_severity is not null").select(*finding(key, "glyph-position", F.col("_severity"), detail, page, box, F.col("str")))


def deduplicated(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of the findings that agree in check, page, box and the first characters of their detail, by their whole detail and text."""
    same = [key, "check", "page", "x1", "y1", "x2", "y2", "_start"]
    order = W.partitionBy(*same).orderBy("detail", "severity", "recovered_text")
    return findings.withColumn("_start", F.substring("detail", 1, KEY_DETAIL)).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_start")


def audit(options: Options = Options(), *, items: DataFrame | None = None, rects: DataFrame | None = None, raw: DataFrame | None = None, meta: DataFrame | None = None, annotations: DataFrame | None = None, metrics: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """All findings of the checks that options name, once each. A check that is on needs its tables."""
    parts = []
    if options.incremental_save:
        parts.append(check_incremental_save(raw, key=key))
    if options.metadata_leak:
        parts.append(check_metadata_leak(meta, key))
    if options.text_under_box:
        parts.append(check_text_under_box(items, rects, key))
    if options.pending_annotation:
        parts.append(check_pending_annotation(annotations, key))
    if options.glyph_position:
        parts.append(check_glyph_position(items, metrics, key))
    if not parts:
        raise ValueError(f"no check is on; there are {', '.join(f.name for f in fields(options))}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return deduplicated(out, key)


def report(docs: DataFrame, findings: DataFrame, key: str = "doc_id", checked_at: Column | None = None) -> DataFrame:
    """For each document: n_findings, clean, and sha256 and checked_at where given. docs may have sha256 and status; only readable documents are clean."""
    per = findings.groupBy(key).agg(F.count("*").alias("n_findings"), F.array_sort(F.collect_set("check")).alias("checks"))
    more = [F.col(c) for c in ("status", "sha256") if c in docs.columns]
    readable = F.col("status") == "ok" if "status" in docs.columns else F.lit(True)
    out = docs.join(per, key, "left").select(key, *more, F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("checks", F.array().cast("array<string>")).alias("checks"), (F.col("n_findings").isNull() & readable).alias("clean"))
    return out if checked_at is None else out.withColumn("checked_at", F.date_format(checked_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
