"""Queries over derived text layers, with the SQL that gives the same rows; catalog.py registers them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.geometry import HELVETICA, TIMES
from inkveil.functions.patterns import ENTITIES, EXEMPTIONS, INFO_FIELDS, LABELS, METADATA, entity_patterns, re2
from inkveil.operators import annotations, audit, detect, layout, ocr, paths, redact, restore
from inkveil.plans import catalog as c
from inkveil.sources import files

SCANNED = ["email", "ip-address", "credit-card", "phone"]


def _items(spark, sf_dir) -> DataFrame:
    return layout.text_items(c._docs(spark, sf_dir))


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


def _halves(spark, sf_dir) -> DataFrame:
    """Every line as two items that stand side by side, the right one a little lower."""
    items = c._lines(spark, sf_dir)
    cut = F.floor(F.length("str") / 2).cast("int")
    left = items.select("doc_id", "page", (F.col("item_idx") * 2).alias("item_idx"), F.substring("str", F.lit(1), cut).alias("str"), "x", "y", "width", "height")
    right = items.select("doc_id", "page", (F.col("item_idx") * 2 + 1).alias("item_idx"), F.substring("str", cut + 1, F.length("str")).alias("str"), (F.col("x") + 300.0).alias("x"), (F.col("y") - 1.5).alias("y"), "width", "height")
    return left.unionByName(right).filter(F.length(F.trim("str")) > 0)


_HALVES = """halves AS (SELECT doc_id, page, item_idx AS n, 0 AS k, str[1:length(str) // 2] AS str FROM items UNION ALL SELECT doc_id, page, item_idx, 1, str[length(str) // 2 + 1:] FROM items),
lined AS (SELECT doc_id, page, n, string_agg(str, ' ' ORDER BY k) AS line FROM halves WHERE length(trim(str)) > 0 GROUP BY doc_id, page, n)"""


def halved_page_text(spark, sf_dir):
    return layout.page_texts(layout.placed_items(_halves(spark, sf_dir)))


def shown_page_text(spark, sf_dir):
    """Texts in the order of the items, whatever their places."""
    items = c._lines(spark, sf_dir).withColumn("item_idx", -F.col("item_idx"))
    return files.page_texts(items)


def detect_types(spark, sf_dir):
    """What a detection reports of each document: values in the order seen, samples, pages."""
    texts = files.page_texts(c._lines(spark, sf_dir, entity_patterns(SCANNED)))
    found = detect.first_seen(detect.matches(texts, entity_patterns(SCANNED), keys=("doc_id", "page")))
    join = lambda name: F.array_join(F.col(name).cast("array<string>"), "|").alias(name)
    return found.select("doc_id", "type", "count", join("samples"), join("values"), join("pages"))


def detect_total(spark, sf_dir):
    texts = files.page_texts(c._lines(spark, sf_dir, entity_patterns(SCANNED)))
    return detect.total(detect.first_seen(detect.matches(texts, entity_patterns(SCANNED), keys=("doc_id", "page"))))


def detect_first_pages(spark, sf_dir):
    """Patterns that are sought on first pages only, others everywhere."""
    kinds = [replace(p, pages=(1,)) if p.name == "phone" else p for p in entity_patterns(["phone", "email"])]
    texts = layout.page_texts(layout.placed_items(c._lines(spark, sf_dir, kinds)))
    return detect.matches(texts, kinds, keys=("doc_id", "page")).groupBy("page", "type").agg(F.count("*").alias("n"))


def detect_supplied(spark, sf_dir):
    """Findings of a detector outside, in the shape of those of patterns."""
    ev = c._read(spark, sf_dir, "events")
    rows = ev.select((F.col("user_id") % 50).alias("doc_id"), (F.col("event_id") % 3 + 1).cast("int").alias("page"), F.col("event_id").alias("seq"), F.lit("person").alias("type"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_type")).alias("text"))
    return detect.supplied(rows).select("doc_id", "type", "count", F.array_join("values", "|").alias("values"), F.array_join(F.col("pages").cast("array<string>"), "|").alias("pages"), "tier")


def coded_regions(spark, sf_dir):
    patterns = entity_patterns(["email", "ip-address", "attorney-client-marker"], {"email": "(b)(7)"})
    placed = layout.placed_items(c._items(spark, sf_dir, patterns))
    height = placed.select("doc_id", "page").distinct().filter("page % 5 <> 0").withColumn("height", F.lit(layout.HEIGHT))  # the others have none
    found = redact.searched_regions(placed, patterns, height)
    return _round(found, "x", "y", "width", "height").select("doc_id", "page", "type", "match_idx", "x", "y", "width", "height", "label", "exemption_code", "exemption_basis", F.col("region_idx").cast("long").alias("region_idx"))


def _pages(items: DataFrame) -> DataFrame:
    """The pages of items and one more a document, images on some."""
    pages = items.select("doc_id", "page").distinct().unionByName(items.select("doc_id", F.lit(1000).alias("page")).distinct())
    return pages.withColumn("has_image", (F.col("doc_id") + F.col("page")) % 3 == 0)


_PAGES = "pages2 AS (SELECT doc_id, page, (doc_id + page) % 3 = 0 AS has_image FROM (SELECT doc_id, page FROM items UNION SELECT doc_id, 1000 FROM items))"


def verify_warnings(spark, sf_dir):
    items = c._lines(spark, sf_dir)
    return redact.verify_warnings(_pages(items), items, c._bars(items))


def guarded_counts(spark, sf_dir):
    """Regions on pages beyond the last are skipped."""
    items = c._lines(spark, sf_dir)
    regions = c._regions(items).withColumn("page", F.when(F.col("region_idx") % 2 == 0, F.col("page")).otherwise(F.col("page") + 1))
    out = redact.redaction_summary(c._docs(spark, sf_dir), regions, pages=items.select("doc_id", "page"))
    return out.select("doc_id", F.col("redacted_count").cast("long").alias("redacted_count"), F.array_join(F.col("pages_affected").cast("array<string>"), ",").alias("pages_affected"))


def kept_text(spark, sf_dir):
    """The items that a redaction leaves."""
    items = _items(spark, sf_dir)
    regions = _coded(layout.normalized(c._regions(items)))
    return redact.redact(c._docs(spark, sf_dir), items.select("doc_id", "page").distinct().withColumn("has_image", F.lit(False)), items, regions)["text"].select("doc_id", "page", "item_idx")


def _coded(regions: DataFrame) -> DataFrame:
    k = F.col("region_idx") % 3
    return regions.withColumns({"label": F.when(k != 1, "a label of some length"), "exemption_code": F.when(k == 2, "(b)(5)"), "exemption_basis": F.when(k == 2, "work product")})


_CODED = "coded AS (SELECT *, CASE WHEN rect_idx % 3 <> 1 THEN 'a label of some length' END AS label, CASE WHEN rect_idx % 3 = 2 THEN '(b)(5)' END AS exemption_code, CASE WHEN rect_idx % 3 = 2 THEN 'work product' END AS exemption_basis FROM bars)"


def region_labels(spark, sf_dir):
    out = redact.labelled_bars(_coded(layout.normalized(c._regions(c._lines(spark, sf_dir)))))
    return _round(out, "size", "text_x", "text_y").select("doc_id", "page", "region_idx", "text", "size", "text_x", "text_y")


def manifest_rows(spark, sf_dir):
    docs = c._docs(spark, sf_dir)
    hashes = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256_before"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("#")), 256).alias("sha256_after"))
    log = redact.entries(_coded(layout.normalized(c._regions(c._lines(spark, sf_dir)))), hashes, redactor="r1", basis_code="(b)(6)", created_at="2024-01-01T00:00:00.000Z")
    whole = redact.manifests(hashes, log)
    each = whole.select("doc_id", "sha256_input", "sha256_output", F.size("entries").cast("long").alias("n_entries"), F.explode_outer("entries").alias("e"))
    return each.select("doc_id", "sha256_input", "sha256_output", "n_entries", "e.page", "e.region_idx", F.round(F.col("e.bbox")[1], 4).alias("y1"), "e.basis_code", "e.basis_text", "e.label", "e.redactor_id", "e.timestamp")


def batch_merge(spark, sf_dir):
    docs, regions = c._docs(spark, sf_dir), c._regions(c._lines(spark, sf_dir))
    one = redact.redaction_summary(docs, regions.filter("region_idx % 2 = 0"))
    other = redact.redaction_summary(docs.filter("doc_id % 3 > 0"), regions.filter("region_idx % 2 = 1"))
    out = redact.merged(one, other)
    return out.select("doc_id", F.col("redacted_count").cast("long").alias("redacted_count"), F.array_join(F.col("pages_affected").cast("array<string>"), ",").alias("pages_affected"))


def _meta(spark, sf_dir) -> DataFrame:
    """Fields of an information dictionary, and some of a metadata packet, with values of every sensitive kind."""
    part = c._read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    field = F.element_at(F.array(*[F.lit(f) for f in INFO_FIELDS]), (key % len(INFO_FIELDS) + 1).cast("int"))
    kinds = ["mail a.b@example.org", "call 555-867-5309", "id 123-45-6789", "at 10.0.0.1 or so", "see https://example.org/x", "  ", "plain"]
    value = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(key / 3) % len(kinds) + 1).cast("int"))
    value = F.when(F.length(F.trim(value)) > 0, F.concat(value, F.lit(" "), F.repeat(F.col("p_name"), (key % 9).cast("int")))).otherwise(value)
    return part.select(key.alias("doc_id"), F.when(key % 4 == 3, "xmp").otherwise("info").alias("kind"), field.alias("field"), value.alias("value"))


_META = f"""meta AS (SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 = 3 THEN 'xmp' ELSE 'info' END AS kind, (['{"', '".join(INFO_FIELDS)}'])[p_partkey % {len(INFO_FIELDS)} + 1] AS field, CASE WHEN length(trim(v)) > 0 THEN v || ' ' || repeat(p_name, CAST(p_partkey % 9 AS INT)) ELSE v END AS value
FROM (SELECT *, (['mail a.b@example.org', 'call 555-867-5309', 'id 123-45-6789', 'at 10.0.0.1 or so', 'see https://example.org/x', '  ', 'plain'])[p_partkey // 3 % 7 + 1] AS v FROM part))"""
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(value, {c._quoted(re2(p))}) THEN '{name}'" for name, p in METADATA.items()) + " END"
_NONE = "NULL::INT AS page, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2"
_LEAKS = f"""leaks AS (SELECT doc_id, 'metadata-leak' AS "check", 'INFO' AS severity, {_NONE}, 'Metadata field "' || field || '" contains: ' || value[1:120] AS detail, NULL::VARCHAR AS recovered_text FROM meta WHERE kind = 'info' AND length(trim(value)) > 0
UNION ALL SELECT doc_id, 'metadata-leak', 'MEDIUM', {_NONE}, CASE WHEN kind = 'info' THEN 'Metadata' ELSE 'XMP metadata' END || ' field "' || field || '" may expose ' || {_LABEL} || ': ' || value[1:120], NULL FROM meta WHERE length(trim(value)) > 0 AND {_LABEL} IS NOT NULL)"""


def audit_leaks(spark, sf_dir):
    return audit.check_metadata_leak(_meta(spark, sf_dir)).select("doc_id", "check", "severity", "detail")


def sanitized_metadata(spark, sf_dir):
    return redact.sanitized_metadata(_meta(spark, sf_dir))


def _revised(spark, sf_dir) -> DataFrame:
    """Texts with none to three end markers."""
    return c._docs(spark, sf_dir).select("doc_id", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 40), F.repeat(F.lit("%%EOF x"), (F.col("doc_id") % 4).cast("int"))).alias("text"))


_REVISED = "revised AS (SELECT doc_id, coalesce(text, '')[1:40] || repeat('%%EOF x', CAST(doc_id % 4 AS INT)) AS text FROM documents)"
_SAVES = f"saves AS (SELECT doc_id, 'incremental-save' AS \"check\", 'HIGH' AS severity, {_NONE}, (len(string_split(text, '%%EOF')) - 1) || ' %%EOF markers found - prior revision may contain unredacted content' AS detail, NULL::VARCHAR AS recovered_text FROM revised WHERE len(string_split(text, '%%EOF')) > 2)"


def audit_eof(spark, sf_dir):
    return audit.check_incremental_save(_revised(spark, sf_dir)).select("doc_id", "check", "severity", "detail")


def _notes(spark, sf_dir) -> DataFrame:
    orders = c._read(spark, sf_dir, "orders")
    k, x = F.col("o_orderkey"), (F.col("o_custkey") % 500).cast("double")
    subtype = F.when(k % 4 == 0, "Text").when(k % 4 == 1, F.lit(None)).otherwise("Redact")
    return orders.select((F.col("o_custkey") % 1000).alias("doc_id"), (k % 3 + 1).cast("int").alias("page"), k.cast("int").alias("annot_idx"), subtype.alias("subtype"), x.alias("x1"), (x + 1).alias("y1"), (x + 20).alias("x2"), (x + 30).alias("y2"))


_NOTES = "notes AS (SELECT o_custkey % 1000 AS doc_id, CAST(o_orderkey % 3 + 1 AS INT) AS page, o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 'Text' WHEN 1 THEN NULL ELSE 'Redact' END AS subtype, (o_custkey % 500)::DOUBLE AS x1, (o_custkey % 500 + 1)::DOUBLE AS y1, (o_custkey % 500 + 20)::DOUBLE AS x2, (o_custkey % 500 + 30)::DOUBLE AS y2 FROM orders)"
_PENDING = "pending AS (SELECT doc_id, 'pending-annotation' AS \"check\", 'CRITICAL' AS severity, page, x1, y1, x2, y2, 'Unapplied redaction annotation on page ' || page AS detail, NULL::VARCHAR AS recovered_text FROM notes WHERE subtype = 'Redact')"


def audit_pending(spark, sf_dir):
    return audit.check_pending_annotation(_notes(spark, sf_dir))


def kept_annotations(spark, sf_dir):
    return annotations.stripped_annotations(_notes(spark, sf_dir))[0].select("doc_id", "page", F.col("annot_idx").cast("long").alias("annot_idx"), "subtype")


def stripped_pages(spark, sf_dir):
    found = annotations.stripped_annotations(_notes(spark, sf_dir))[1]
    return found.select("doc_id", "page", F.col("removed").cast("long").alias("removed"), "x1", "y1", "x2", "y2")


_FONTS = ["Helvetica", "Courier", "/Times-Roman", "g_d0_Helvetica", "Unknown"]


def _glyphs(spark, sf_dir) -> DataFrame:
    """Names in several fonts, some stretched, some of equal letters."""
    part = c._read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    text = F.when(k % 11 == 0, "nnnnnnn").when(k % 13 == 0, "ab").otherwise(F.col("p_name"))
    font = F.element_at(F.array(*[F.lit(f) for f in _FONTS]), (k % 5 + 1).cast("int"))
    rows = part.select(k.alias("doc_id"), F.lit(1).alias("page"), k.alias("item_idx"), text.alias("str"), F.lit(10.0).alias("x"), F.lit(20.0).alias("y"), F.lit(0.0).alias("height"), font.alias("font"), F.lit(10.0).alias("font_size"))
    step = F.floor(F.col("doc_id") / 5) % 3
    stretch = F.when(step == 0, 1.0).when(step == 1, 1.1).otherwise(1.2)
    return audit.expected_advances(rows).withColumn("width", F.col("units") / 100 * stretch).drop("units", "squares")


def audit_glyphs(spark, sf_dir):
    return _round(audit.check_glyph_position(_glyphs(spark, sf_dir)), "x2").drop("detail")


def _moment_sql(text: str, widths: dict[str, int], default: int, power: int) -> str:
    parts = [f"{default**power} * length({text})"]
    for w in sorted(set(widths.values()) - {default}):
        letters = "".join(sorted(k for k, v in widths.items() if v == w))
        parts.append(f"({w**power - default**power}) * (length({text}) - length(translate({text}, {c._quoted(letters)}, '')))")
    return "(" + " + ".join(parts) + ")"


def _by_font(power: int) -> str:
    return f"CASE WHEN k % 5 IN (0, 3) THEN {_moment_sql('str', HELVETICA, 556, power)} WHEN k % 5 = 1 THEN {600**power} * length(str) WHEN k % 5 = 2 THEN {_moment_sql('str', TIMES, 500, power)} ELSE {556**power} * length(str) END"


_GLYPHS = f"""glyphs AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'nnnnnnn' WHEN p_partkey % 13 = 0 THEN 'ab' ELSE p_name END AS str FROM part),
sized AS (SELECT *, ({_by_font(1)})::DOUBLE AS units, ({_by_font(2)})::DOUBLE AS squares, length(str)::DOUBLE AS n FROM glyphs),
wide AS (SELECT *, units / 100 * CASE k // 5 % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 1.2::DOUBLE END AS width, units / 1000 * 10 AS expected FROM sized WHERE n >= 3),
judged AS (SELECT *, abs(width - expected) / expected > 0.15 AS off, sqrt(greatest(squares / n - (units / n) * (units / n), 0)) / (units / n) < 0.01 AND n > 3 AS flat FROM wide)"""


def _ops(spark, sf_dir) -> DataFrame:
    """Drawing operations of invented pages, rectangles with sides of either sign."""
    ev = c._read(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.element_at(F.array(*[F.lit(o) for o in ("re", "re", "re", "f", "S", "f*", "m", "n", "B")]), ((k * 7919 + u) % 9 + 1).cast("int"))
    x, side = (k % 50).cast("double"), u % 40 - 12.0
    return ev.select(F.floor(k / 12).alias("doc_id"), F.lit(1).alias("page"), (k % 12).alias("op_idx"), kind.alias("op"), F.when(kind == "re", F.array(x, x + 5, side, side + 7)).otherwise(F.array(x)).alias("args"))


def _op_items(spark, sf_dir) -> DataFrame:
    ev = c._read(spark, sf_dir, "events")
    k = F.col("event_id")
    x = (k % 50).cast("double")
    return ev.select(F.floor(k / 12).alias("doc_id"), F.lit(1).alias("page"), (k % 12).alias("item_idx"), F.col("event_type").alias("str"), x.alias("x"), (x + 4).alias("y"), F.lit(30.0).alias("width"), F.when(k % 2 == 0, 12.0).otherwise(0.0).alias("height"))


_OPS = """ops AS (SELECT event_id // 12 AS d, event_id % 12 AS i, (['re', 're', 're', 'f', 'S', 'f*', 'm', 'n', 'B'])[(event_id * 7919 + user_id) % 9 + 1] AS op, (event_id % 50)::DOUBLE AS x, event_id % 50 + 5::DOUBLE AS y, user_id % 40 - 12::DOUBLE AS w, user_id % 40 - 12::DOUBLE + 7 AS h FROM events),
op_items AS (SELECT event_id // 12 AS d, event_id % 12 AS i, event_type AS str, (event_id % 50)::DOUBLE AS x, event_id % 50 + 4::DOUBLE AS y, CASE WHEN event_id % 2 = 0 THEN 12.0::DOUBLE ELSE 10.0::DOUBLE END AS h FROM events)"""


def _rects_sql(name: str, clears: str, least: str) -> str:
    return f"""{name}_at AS (SELECT f.d, f.i, (SELECT coalesce(max(e.i), -1) FROM ops e WHERE e.d = f.d AND e.i < f.i AND e.op IN ({clears})) AS since FROM ops f WHERE f.op IN ('f', 'f*', 'B')),
{name} AS (SELECT a.d, a.i, (SELECT min(p.i) FROM ops p WHERE p.d = a.d AND p.i < a.i AND p.i > a.since AND p.op IN ('re', 'm')) AS first_op, least(r.x, r.x + r.w) AS x1, least(r.y, r.y + r.h) AS y1, greatest(r.x, r.x + r.w) AS x2, greatest(r.y, r.y + r.h) AS y2
FROM {name}_at a JOIN ops r ON r.d = a.d AND r.i = (SELECT max(q.i) FROM ops q WHERE q.d = a.d AND q.i < a.i AND q.i > a.since AND q.op = 're') WHERE {least})"""


_ALL, _FILL = "'f', 'f*', 'B', 'S', 'n'", "'f', 'f*', 'B'"
_AUDIT_RECTS, _VERIFY_RECTS = _rects_sql("rects", _ALL, "true"), _rects_sql("vrects", _FILL, "abs(r.w) >= 5 AND abs(r.h) >= 2")


def filled_rects(spark, sf_dir):
    return _round(paths.filled_rects(_ops(spark, sf_dir)), "x1", "y1", "x2", "y2")


def verify_rects(spark, sf_dir):
    return _round(paths.filled_rects(_ops(spark, sf_dir), least=(5.0, 2.0), ends_clear=False), "x1", "y1", "x2", "y2").drop("first_op")


def image_pages(spark, sf_dir):
    ops = _ops(spark, sf_dir).withColumn("op", F.when((F.col("op") == "n") & (F.col("doc_id") % 3 == 0), "paintImageXObject").otherwise(F.col("op")))
    return paths.image_pages(ops)


_UNDER = "i.d = r.d AND i.x < r.x2 - 1 AND i.x + 30 > r.x1 + 1 AND i.y < r.y2 - 1 AND i.y + i.h > r.y1 + 1 AND r.x2 - r.x1 >= 5 AND r.y2 - r.y1 >= 5"


def restore_overlays(spark, sf_dir):
    found = restore.strip_overlays(_op_items(spark, sf_dir), _ops(spark, sf_dir))[1]
    return _round(found, "x1", "y1", "x2", "y2")


def restore_kept_ops(spark, sf_dir):
    return restore.strip_overlays(_op_items(spark, sf_dir), _ops(spark, sf_dir))[0].select("doc_id", "op_idx", "op")


def restore_notes(spark, sf_dir):
    overlays = restore.strip_overlays(_op_items(spark, sf_dir), _ops(spark, sf_dir))[1]
    return _round(restore.candidate_notes(overlays)[0], "x1", "y1", "x2", "y2")


def restore_counters(spark, sf_dir):
    docs = c._docs(spark, sf_dir)
    found, counters = restore.restore(docs, _op_items(spark, sf_dir), _ops(spark, sf_dir), _notes(spark, sf_dir), _revised(spark, sf_dir))
    return counters.withColumns({n: F.col(n).cast("long") for n in ("overlays_stripped", "annotations_removed")})


def _crossed_bars(items: DataFrame) -> DataFrame:
    """Bars that cover several lines, and each other."""
    n = F.col("item_idx")
    tall = items.filter(n % 5 == 0).select("doc_id", "page", (n * 2).alias("rect_idx"), F.col("x").alias("x1"), (F.col("y") - 20).alias("y1"), (F.col("x") + 50).alias("x2"), (F.col("y") + 8).alias("y2"))
    flat = items.filter(n % 5 == 1).select("doc_id", "page", (n * 2 + 1).alias("rect_idx"), (F.col("x") + 30).alias("x1"), (F.col("y") + 26).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return tall.unionByName(flat)


def audit_greedy(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.greedy_text_under_box(items, _crossed_bars(items)).select("doc_id", "page", "item_idx", "rect_idx", "recovered_text")


_CROSSED = "crossed AS (SELECT doc_id, page, item_idx * 2 AS rect_idx, x AS x1, y - 20 AS y1, x + 50 AS x2, y + 8 AS y2 FROM items WHERE item_idx % 5 = 0 UNION ALL SELECT doc_id, page, item_idx * 2 + 1, x, y, x + 30, y + 26 FROM items WHERE item_idx % 5 = 1)"
_GREEDY = """queue AS (SELECT i.doc_id, i.page, i.item_idx, any_value(i.str) AS str, list(b.rect_idx ORDER BY b.rect_idx) AS rects, row_number() OVER (PARTITION BY i.doc_id, i.page ORDER BY i.item_idx) AS k FROM items i JOIN crossed b ON i.doc_id = b.doc_id AND i.page = b.page AND i.x < b.x2 - 1 AND i.x + i.width > b.x1 + 1 AND i.y < b.y2 - 1 AND i.y + 10 > b.y1 + 1 GROUP BY i.doc_id, i.page, i.item_idx),
taken AS (SELECT doc_id, page, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS rect_idx, NULL::BIGINT AS item_idx, NULL::VARCHAR AS str FROM queue WHERE k = 1
UNION ALL SELECT q.doc_id, q.page, q.k, CASE WHEN len(list_filter(q.rects, lambda r: NOT list_contains(t.used, r))) > 0 THEN list_append(t.used, list_filter(q.rects, lambda r: NOT list_contains(t.used, r))[1]) ELSE t.used END, list_filter(q.rects, lambda r: NOT list_contains(t.used, r))[1], q.item_idx, q.str FROM taken t JOIN queue q ON q.doc_id = t.doc_id AND q.page = t.page AND q.k = t.k + 1)"""


def audit_findings(spark, sf_dir):
    """Findings of three checks over the same documents, once each."""
    found = audit.check_incremental_save(_revised(spark, sf_dir)).unionByName(audit.check_metadata_leak(_meta(spark, sf_dir))).unionByName(audit.check_pending_annotation(_notes(spark, sf_dir)))
    return audit.deduplicated(found)


def audit_report(spark, sf_dir):
    options = audit.Options(text_under_box=False)
    found = audit.audit(options, raw=_revised(spark, sf_dir), meta=_meta(spark, sf_dir), annotations=_notes(spark, sf_dir))
    docs = c._docs(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.when(F.col("doc_id") % 5 == 0, "unreadable").otherwise("ok").alias("status"))
    return audit.report(docs, found).select("doc_id", "status", "sha256", F.col("n_findings").cast("long").alias("n_findings"), F.array_join("checks", ",").alias("checks"), "clean")


_FOUND = f"{_REVISED}, {_SAVES}, {_META}, {_LEAKS}, {_NOTES}, {_PENDING}, found AS (SELECT DISTINCT * FROM saves UNION SELECT * FROM leaks UNION SELECT * FROM pending), once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, \"check\", page, x1, y1, x2, y2, detail[1:60] ORDER BY detail) AS k FROM found) WHERE k = 1)"


def _blocks(spark, sf_dir) -> DataFrame:
    """Lines of documents as an OCR engine's blocks."""
    word = lambda t, i: F.struct(t.alias("text"), (i * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (i * 10.0 + 8).alias("x1"), F.lit(9.0).alias("y1"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.struct(F.transform(F.split(l, " "), word).alias("words")))
    return c._docs(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs"))).alias("blocks"))


def ocr_lines(spark, sf_dir):
    words = ocr.lines_of_blocks(_blocks(spark, sf_dir))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.countDistinct("line").alias("n_lines"))


def ocr_redacted_count(spark, sf_dir):
    """Words, not matches: a pattern of two words covers two."""
    patterns = entity_patterns(["email", "ip-address"])
    words = ocr.lines_of_blocks(_blocks(spark, sf_dir), patterns=patterns)
    return ocr.redacted_count(ocr.burnt_boxes(ocr.words_hit(words, patterns)))


_WORDS = """lined AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: list_filter(string_split(l, ' '), lambda w: trim(w) <> '')), lambda ws: len(ws) > 0)) AS ws FROM documents)"""
_HIT = " UNION ALL ".join(f"SELECT doc_id, line, unnest(regexp_extract_all(text, {c._quoted(re2(ENTITIES[t]))}, 0)) AS m, {c._quoted(re2(ENTITIES[t]))} AS p FROM numbered" for t in ("email", "ip-address"))


def distinct_files(spark, sf_dir):
    part = c._read(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("name"), (F.col("p_size") % 7).cast("long").alias("n_bytes"), F.encode("p_name", "UTF-8").alias("content"))
    return files.distinct_files(rows).select("doc_id", "name", "n_bytes", F.decode("content", "UTF-8").alias("content"))


def encoded_texts(spark, sf_dir):
    """Contents as a response carries them."""
    return c._docs(spark, sf_dir).select("doc_id", files.encoded(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("encoded"))


def _masked_sql(kinds: list[str]) -> str:
    """Texts with each pattern's matches masked, one after the other."""
    steps, before = ["m0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"], "m0"
    for k, t in enumerate(kinds, 1):
        r = c._quoted(re2(ENTITIES[t]))
        steps.append(f"m{k} AS (SELECT doc_id, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] || coalesce(repeat('█', length(m[i])), '')), '') AS text FROM (SELECT doc_id, string_split_regex(text, {r}) AS b, regexp_extract_all(text, {r}, 0) AS m FROM {before}))")
        before = f"m{k}"
    return ", ".join(steps)


_SEEN = f"""texts2 AS (SELECT doc_id, page, string_agg(str, ' ' ORDER BY item_idx) AS text FROM items GROUP BY doc_id, page), found AS ({c._matches_sql('texts2', 'doc_id, page', SCANNED)}),
once AS (SELECT doc_id, type, trim(value) AS v, min((page, start_off)) AS first, list(DISTINCT page) AS ps FROM found WHERE trim(value) <> '' GROUP BY doc_id, type, trim(value)),
rolled AS (SELECT doc_id, type, count(*) AS "count", list(v ORDER BY first, v) AS vs, list_sort(list_distinct(flatten(list(ps)))) AS pages FROM once GROUP BY doc_id, type)"""
_CODES = " ".join(f"WHEN '{t}' THEN '{'(b)(7)' if t == 'email' else EXEMPTIONS[t][0]}'" for t in ("email", "ip-address", "attorney-client-marker"))
_BASES = " ".join(f"WHEN '{t}' THEN '{EXEMPTIONS[t][1]}'" for t in ("email", "ip-address", "attorney-client-marker"))
_NAMES = " ".join(f"WHEN '{t}' THEN '{LABELS[t]}'" for t in ("email", "ip-address", "attorney-client-marker"))
_PART = "CASE WHEN count(*) = 0 THEN '' ELSE array_to_string(list_sort(list(DISTINCT page)), ',') END"

QUERIES = {
    f.__name__: f
    for f in (
        halved_page_text, shown_page_text, detect_types, detect_total, detect_first_pages, detect_supplied, coded_regions, verify_warnings, guarded_counts, kept_text, region_labels, manifest_rows,
        batch_merge, audit_leaks, sanitized_metadata, audit_eof, audit_pending, kept_annotations, stripped_pages, audit_glyphs, filled_rects, verify_rects, image_pages, restore_overlays, restore_kept_ops, restore_notes, restore_counters,
        audit_greedy, audit_findings, audit_report, ocr_lines, ocr_redacted_count, distinct_files, encoded_texts,
    )
}

ORACLES = {
    "halved_page_text": f"WITH {c._ITEMS_SQL}, {_HALVES} SELECT doc_id, page, string_agg(line, chr(10) ORDER BY n) AS text FROM lined GROUP BY doc_id, page",
    "shown_page_text": f"WITH {c._ITEMS_SQL} SELECT doc_id, page, string_agg(str, ' ' ORDER BY item_idx DESC) AS text FROM items GROUP BY doc_id, page",
    "detect_types": f"WITH {c._ITEMS_SQL}, {_SEEN} SELECT doc_id, type, \"count\", array_to_string(vs[1:4], '|') AS samples, array_to_string(vs[1:100], '|') AS \"values\", array_to_string(pages, '|') AS pages FROM rolled",
    "detect_total": f"WITH {c._ITEMS_SQL}, {_SEEN} SELECT CAST(coalesce(sum(\"count\"), 0) AS BIGINT) AS total FROM rolled",
    "detect_first_pages": f"WITH {c._ITEMS_SQL}, {c._PLACED_SQL} SELECT page, type, count(*) AS n FROM ({c._matches_sql('texts', 'doc_id, page', ['phone', 'email'])}) WHERE type = 'email' OR page = 1 GROUP BY page, type",
    "detect_supplied": """WITH rows AS (SELECT user_id % 50 AS doc_id, CAST(event_id % 3 + 1 AS INT) AS page, event_id AS seq, trim(event_type) AS v FROM events WHERE event_id % 7 <> 0 AND length(trim(event_type)) > 1),
        once AS (SELECT doc_id, v, min((page, seq)) AS first, list(DISTINCT page) AS ps FROM rows GROUP BY doc_id, v)
        SELECT doc_id, 'person' AS type, count(*) AS "count", array_to_string(list(v ORDER BY first, v)[1:100], '|') AS "values", array_to_string(list_sort(list_distinct(flatten(list(ps)))), '|') AS pages, 'ai' AS tier FROM once GROUP BY doc_id""",
    "coded_regions": f"""WITH {c._ITEMS_SQL}, {c._PLACED_SQL}, spans AS (SELECT *, length(so_far) - length(str) AS a, length(so_far) AS z FROM placed), found AS ({c._matches_sql('texts', 'doc_id, page', ['email', 'ip-address', 'attorney-client-marker'])}),
        boxes AS (SELECT f.doc_id, f.page, f.type, f.match_idx, min(x) AS x1, max(y + height) AS y2, max(x + width) AS x2, min(y) AS y1 FROM found f JOIN spans s ON f.doc_id = s.doc_id AND f.page = s.page AND s.z > f.start_off AND s.a < f.end_off GROUP BY f.doc_id, f.page, f.type, f.match_idx)
        SELECT doc_id, page, type, match_idx, round(x1 - 2, 4) AS x, round(CASE WHEN page % 5 = 0 THEN 0 ELSE 792 END - y2 - 2, 4) AS y, round(x2 - x1 + 4, 4) AS width, round(y2 - y1 + 4, 4) AS height, CASE type {_NAMES} END AS label, CASE type {_CODES} END AS exemption_code, CASE type {_BASES} END AS exemption_basis,
        row_number() OVER (PARTITION BY doc_id ORDER BY type, page, match_idx) - 1 AS region_idx FROM boxes""",
    "verify_warnings": f"""WITH {c._ITEMS_SQL}, {c._BARS_SQL}, {_PAGES}, marked AS (SELECT *, EXISTS (SELECT 1 FROM items i WHERE i.doc_id = p.doc_id AND i.page = p.page) AS t, EXISTS (SELECT 1 FROM bars b WHERE b.doc_id = p.doc_id AND b.page = p.page AND x2 - x1 >= 5 AND y2 - y1 >= 2) AS b FROM pages2 p WHERE has_image)
        SELECT doc_id, page, CASE WHEN t THEN 'image-under-redaction' ELSE 'scanned-page' END AS type FROM marked WHERE b OR NOT t""",
    "guarded_counts": f"WITH {c._ITEMS_SQL}, {c._BARS_SQL}, moved AS (SELECT doc_id, page + rect_idx % 2 AS page FROM bars), there AS (SELECT * FROM moved m WHERE EXISTS (SELECT 1 FROM items i WHERE i.doc_id = m.doc_id AND i.page = m.page)), per AS (SELECT doc_id, count(*) AS n, {_PART} AS p FROM there GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0) AS redacted_count, coalesce(p, '') AS pages_affected FROM documents d LEFT JOIN per USING (doc_id)",
    "kept_text": f"WITH {c._ITEMS_SQL}, {c._BARS_SQL} SELECT doc_id, page, item_idx FROM items i WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE {c._W0})",
    "region_labels": f"""WITH {c._ITEMS_SQL}, {c._BARS_SQL}, {_CODED}, named AS (SELECT *, coalesce(exemption_code, label, 'REDACTED') AS t, least((y2 - y1) * 0.6, 10) AS s FROM coded), placed AS (SELECT *, x1 + (x2 - x1 - {c._width_sql('t')} / 1000.0::DOUBLE * s) / 2 AS tx, y1 + (y2 - y1 - s) / 2 AS ty FROM named)
        SELECT doc_id, page, rect_idx AS region_idx, CASE WHEN tx > x1 AND ty > y1 THEN t END AS text, CASE WHEN tx > x1 AND ty > y1 THEN round(s, 4) END AS size, CASE WHEN tx > x1 AND ty > y1 THEN round(tx, 4) END AS text_x, CASE WHEN tx > x1 AND ty > y1 THEN round(ty, 4) END AS text_y FROM placed""",
    "manifest_rows": f"""WITH {c._ITEMS_SQL}, {c._BARS_SQL}, {_CODED} SELECT d.doc_id, sha256(coalesce(d.text, '')) AS sha256_input, sha256(coalesce(d.text, '') || '#') AS sha256_output, count(r.rect_idx) OVER (PARTITION BY d.doc_id) AS n_entries, r.page, r.rect_idx AS region_idx, round(r.y1, 4) AS y1,
        CASE WHEN r.rect_idx IS NOT NULL THEN coalesce(exemption_code, '(b)(6)') END AS basis_code, exemption_basis AS basis_text, label, CASE WHEN r.rect_idx IS NOT NULL THEN 'r1' END AS redactor_id, CASE WHEN r.rect_idx IS NOT NULL THEN '2024-01-01T00:00:00.000Z' END AS timestamp FROM documents d LEFT JOIN coded r ON d.doc_id = r.doc_id""",
    "batch_merge": f"WITH {c._ITEMS_SQL}, {c._BARS_SQL}, per AS (SELECT doc_id, count(*) AS n, {_PART} AS p FROM bars WHERE rect_idx % 2 = 0 OR doc_id % 3 > 0 GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0) AS redacted_count, coalesce(p, '') AS pages_affected FROM documents d LEFT JOIN per USING (doc_id)",
    "audit_leaks": f"WITH {_META}, {_LEAKS} SELECT doc_id, \"check\", severity, detail FROM leaks",
    "sanitized_metadata": f"WITH {_META} SELECT doc_id, kind, field, CASE WHEN field IN ('Title', 'Author', 'Subject', 'Keywords', 'Creator', 'Producer') THEN '' WHEN field IN ('CreationDate', 'ModDate') THEN 'D:19700101000000Z' ELSE value END AS value FROM meta WHERE kind = 'info'",
    "audit_eof": f"WITH {_REVISED}, {_SAVES} SELECT doc_id, \"check\", severity, detail FROM saves",
    "audit_pending": f"WITH {_NOTES}, {_PENDING} SELECT * FROM pending",
    "kept_annotations": f"WITH {_NOTES} SELECT doc_id, page, n AS annot_idx, subtype FROM notes WHERE subtype IS NULL OR subtype = 'Text'",
    "stripped_pages": f"WITH {_NOTES} SELECT doc_id, page, count(*) AS removed, arg_min(x1, n) AS x1, arg_min(y1, n) AS y1, arg_min(x2, n) AS x2, arg_min(y2, n) AS y2 FROM notes WHERE subtype = 'Redact' GROUP BY doc_id, page",
    "audit_glyphs": f"WITH {_GLYPHS} SELECT k AS doc_id, 'glyph-position' AS \"check\", CASE WHEN off THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 1 AS page, 10.0::DOUBLE AS x1, 20.0::DOUBLE AS y1, round(10 + width, 4) AS x2, 30.0::DOUBLE AS y2, str AS recovered_text FROM judged WHERE off OR flat",
    "filled_rects": f"WITH {_OPS}, {_AUDIT_RECTS} SELECT d AS doc_id, 1 AS page, i AS rect_idx, first_op, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM rects",
    "verify_rects": f"WITH {_OPS}, {_VERIFY_RECTS} SELECT d AS doc_id, 1 AS page, i AS rect_idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM vrects",
    "image_pages": f"WITH {_OPS} SELECT d AS doc_id, 1 AS page, bool_or(op = 'n' AND d % 3 = 0) AS has_image FROM ops GROUP BY d",
    "restore_overlays": f"WITH {_OPS}, {_AUDIT_RECTS} SELECT r.d AS doc_id, 'A' AS scenario, 1 AS page, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, string_agg(i.str, ' ' ORDER BY i.i) AS recovered_text, 0.9::DOUBLE AS confidence FROM rects r JOIN op_items i ON {_UNDER} GROUP BY r.d, r.i, x1, y1, x2, y2",
    "restore_kept_ops": f"WITH {_OPS}, {_AUDIT_RECTS}, hid AS (SELECT DISTINCT r.d, r.i, r.first_op FROM rects r JOIN op_items i ON {_UNDER}) SELECT d AS doc_id, i AS op_idx, op FROM ops o WHERE NOT EXISTS (SELECT 1 FROM hid h WHERE h.d = o.d AND o.i BETWEEN h.first_op AND h.i)",
    "restore_notes": f"WITH {_OPS}, {_AUDIT_RECTS}, hid AS (SELECT r.d, x1, y1, x2, y2, string_agg(i.str, ' ' ORDER BY i.i) AS t FROM rects r JOIN op_items i ON {_UNDER} GROUP BY r.d, r.i, x1, y1, x2, y2) SELECT d AS doc_id, 1 AS page, '[restore] Recovered text: \"' || t || '\"' AS contents, round(x2 + 5, 4) AS x1, round((y1 + y2) / 2, 4) AS y1, round(x2 + 23, 4) AS x2, round((y1 + y2) / 2 + 18, 4) AS y2 FROM hid",
    "restore_counters": f"WITH {_OPS}, {_AUDIT_RECTS}, {_NOTES}, hid AS (SELECT DISTINCT r.d, r.i FROM rects r JOIN op_items i ON {_UNDER}) SELECT doc_id, (SELECT count(*) FROM hid h WHERE h.d = o.doc_id) AS overlays_stripped, (SELECT count(*) FROM notes n WHERE n.doc_id = o.doc_id AND subtype = 'Redact') AS annotations_removed, doc_id % 4 > 1 AS prior_revision_recovered FROM documents o",
    "audit_greedy": f"WITH RECURSIVE {c._ITEMS_SQL}, {_CROSSED}, {_GREEDY} SELECT doc_id, page, item_idx, rect_idx, str AS recovered_text FROM taken WHERE k > 0 AND rect_idx IS NOT NULL",
    "audit_findings": f"WITH {_FOUND} SELECT * EXCLUDE (k) FROM once",
    "audit_report": f"WITH {_FOUND}, per AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT \"check\")), ',') AS cs FROM once GROUP BY doc_id) SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'unreadable' ELSE 'ok' END AS status, sha256(coalesce(text, '')) AS sha256, coalesce(n, 0) AS n_findings, coalesce(cs, '') AS checks, n IS NULL AND d.doc_id % 5 <> 0 AS clean FROM documents d LEFT JOIN per USING (doc_id)",
    "ocr_lines": f"WITH {_WORDS} SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS n_words, count(*) AS n_lines FROM lined GROUP BY doc_id",
    "ocr_redacted_count": f"WITH {_WORDS}, numbered AS (SELECT doc_id, row_number() OVER () AS line, array_to_string(ws, ' ') AS text, ws FROM lined) SELECT doc_id, count(DISTINCT (line, i)) AS redacted_count FROM (SELECT doc_id, line, i FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws) + 1)) AS i FROM numbered) WHERE regexp_matches(ws[i], {c._quoted(re2(ENTITIES['email']))}) OR regexp_matches(ws[i], {c._quoted(re2(ENTITIES['ip-address']))})) GROUP BY doc_id",
    "distinct_files": "SELECT min(p_partkey) AS doc_id, p_brand AS name, (p_size % 7)::BIGINT AS n_bytes, arg_min(p_name, p_partkey) AS content FROM part GROUP BY p_brand, p_size % 7",
    "encoded_texts": "SELECT doc_id, base64(encode(coalesce(text, ''))) AS encoded FROM documents",
}

MASKED = {
    "redact_masked_text": f"WITH {_masked_sql(c.PLAIN)} SELECT doc_id, text AS masked FROM m{len(c.PLAIN)}",
    "document_hashes": f"WITH {_masked_sql(c.PLAIN)} SELECT d.doc_id, sha256(coalesce(d.text, '')) AS sha256_before, sha256(m.text) AS sha256_after FROM documents d JOIN m{len(c.PLAIN)} m ON d.doc_id = m.doc_id",
}
