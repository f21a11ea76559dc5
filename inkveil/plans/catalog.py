"""Every query of the library by name, and the SQL that gives the same rows.

Bars, images, annotations and metadata have no table of their own: they are derived from the driver's tables by
arithmetic, the same way in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.geometry import HELVETICA, hex_color, text_units
from inkveil.functions.patterns import ENTITIES, METADATA, Pattern, entity_patterns, re2
from inkveil.operators import detect, layout, redact

#: Entity types that RE2 can express (names need lookarounds).
PLAIN = [t for t in ENTITIES if t != "name"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _items(spark: SparkSession, sf_dir: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """The items; with patterns those of documents that may have matches, for queries that need no others."""
    docs = _docs(spark, sf_dir)
    return layout.text_items(docs if patterns is None else docs.filter(detect.hinted(F.col("text"), patterns)))


def _lines(spark: SparkSession, sf_dir: str, patterns: list[Pattern] | None = None) -> DataFrame:
    """The items, for queries that need no widths."""
    docs = _docs(spark, sf_dir)
    return layout.text_items(docs if patterns is None else docs.filter(detect.hinted(F.col("text"), patterns)), widths=False)


def _bars(items: DataFrame) -> DataFrame:
    """Derived bars: under every seventh line; shifted off the line, or too flat, on some."""
    n = F.col("item_idx")
    low = F.col("y") + F.when(n % 3 == 1, 10.0).otherwise(0.0)
    high = low + F.when(n % 5 == 4, 1.5).otherwise(8.0)
    return items.filter(n % 7 == 0).select("doc_id", "page", F.col("item_idx").alias("rect_idx"), F.col("x").alias("x1"), low.alias("y1"), (F.col("x") + 60.0).alias("x2"), high.alias("y2"))


def _regions(items: DataFrame) -> DataFrame:
    """Derived regions: the same boxes with a top-left origin."""
    return _bars(items).select("doc_id", "page", F.col("rect_idx").alias("region_idx"), F.col("x1").alias("x"), (F.lit(layout.HEIGHT) - F.col("y2")).alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


def detect_summary(spark, sf_dir):
    return detect.summary(detect.matches(_docs(spark, sf_dir), entity_patterns(PLAIN)))


def detect_matches(spark, sf_dir):
    return detect.matches(_docs(spark, sf_dir), entity_patterns(PLAIN))


def detect_names(spark, sf_dir):
    return detect.matches(_docs(spark, sf_dir), entity_patterns(["name"]))


def detect_names_summary(spark, sf_dir):
    """The row of detect_summary for names, which its SQL can't express."""
    return detect.summary(detect.matches(_docs(spark, sf_dir), entity_patterns(["name"])))


def entity_ssn(spark, sf_dir):
    key = F.lpad(F.col("c_custkey").cast("string"), 9, "1")
    three = F.concat_ws("-", F.substring(key, 1, 3), F.substring(key, 4, 2), F.substring(key, 6, 4))
    two = F.concat_ws("-", F.substring(key, 1, 2), F.substring(key, 3, 3), F.substring(key, 6, 4))
    text = F.concat(F.lit("number "), F.when(F.col("c_custkey") % 5 == 0, two).otherwise(three), F.lit("."))
    return detect.matches(_read(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), entity_patterns(["ssn"]), keys=("c_custkey",))


def entity_date(spark, sf_dir):
    text = F.concat(F.lit("on "), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d, yyyy")), F.lit(" or so"))
    return detect.matches(_read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), entity_patterns(["date"]), keys=("o_orderkey",))


def entity_privilege(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    text = F.when(k == 0, "see Attorney-Client  Privilege here").when(k == 1, "PRIVILEGED AND CONFIDENTIAL").when(k == 2, "my work product").when(k == 3, "Privileged Communication!").otherwise("nothing to see")
    return detect.matches(_read(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")), entity_patterns(["attorney-client-marker"]), keys=("o_orderkey",))


def redact_masked_text(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return detect.masked(docs, entity_patterns(PLAIN)).withColumnRenamed("text", "masked")


def scanned_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", detect.scanned(F.col("text")).alias("is_scanned"))


def text_items(spark, sf_dir):
    return _items(spark, sf_dir).withColumn("width", F.round("width", 6))


def page_text(spark, sf_dir):
    return layout.page_texts(layout.placed_items(_lines(spark, sf_dir)))


def match_regions(spark, sf_dir):
    patterns = entity_patterns(["email", "ip-address", "credit-card"])
    placed = layout.placed_items(_items(spark, sf_dir, patterns))
    found = detect.matches(layout.page_texts(placed), patterns, keys=("doc_id", "page"))
    out = layout.match_regions(found, placed)
    return out.select("doc_id", "page", "type", "match_idx", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


def normalize_regions(spark, sf_dir):
    return layout.normalized(_regions(_lines(spark, sf_dir))).select("doc_id", "page", "region_idx", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def regions_with_text(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.regions_with_text(layout.normalized(_regions(items)), items).select("doc_id", "page", "region_idx")


def visual_only(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.regions_with_text(layout.normalized(_regions(items)), items, how="left_anti").select("doc_id", "page", "region_idx")


def redaction_counts(spark, sf_dir):
    out = redact.redaction_summary(_docs(spark, sf_dir), _regions(_lines(spark, sf_dir)))
    return out.select("doc_id", F.col("redacted_count").cast("long").alias("redacted_count"), F.array_join(F.col("pages_affected").cast("array<string>"), ",").alias("pages_affected"))


def redact_warnings(spark, sf_dir):
    items = _items(spark, sf_dir)
    pages = items.select("doc_id", "page").distinct().withColumn("has_image", F.col("doc_id") % 10 == 0)
    return redact.redaction_warnings(pages, layout.normalized(_regions(items)), items)


def verify_violations(spark, sf_dir):
    items = _items(spark, sf_dir)
    out = redact.violations(items, _bars(items))
    return out.select("doc_id", "page", "item_idx", "rect_idx", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], "recovered_text")


def verify_rollup(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.clean_flags(_docs(spark, sf_dir), redact.violations(items, _bars(items)))


def audit_text_under_box(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.text_under_box(items, _bars(items))


def strip_overlays_text(spark, sf_dir):
    items = _items(spark, sf_dir)
    return redact.text_under_overlays(items, _bars(items))


def prior_revision(spark, sf_dir):
    n = (F.col("event_id") % 4).cast("int")
    text = F.concat(F.lit("a"), F.col("event_type"), F.repeat(F.lit("%%EOF x"), n))
    return redact.revision_markers(_read(spark, sf_dir, "events").select("event_id", text.alias("text")), key="event_id")


def audit_metadata(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    value = F.when(key % 4 == 0, F.concat(name, F.lit(" mail a.b@example.org"))).when(key % 4 == 1, F.concat(F.lit("see https://example.org/"), key.cast("string"))).when(key % 4 == 2, F.lit("  ")).otherwise(name)
    return redact.metadata_findings(part.select(key.alias("doc_id"), F.lit("info").alias("kind"), F.lit("Subject").alias("field"), value.alias("value")))


def font_width(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select("p_partkey", text_units(F.col("p_name"), "Helvetica").alias("helvetica"), text_units(F.col("p_name"), "Courier").alias("courier"))


def hex_colors(spark, sf_dir):
    text = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey"))), 6, "0"), F.when(F.col("p_partkey") % 9 == 0, "z").otherwise(""))
    rgb = hex_color(text)
    return _read(spark, sf_dir, "part").select("p_partkey", *[F.round(rgb[k], 6).alias(c) for k, c in enumerate("rgb")])


def document_hashes(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("before", F.sha2("text", 256))
    return detect.masked(docs, entity_patterns(PLAIN)).select("doc_id", F.col("before").alias("sha256_before"), F.sha2("text", 256).alias("sha256_after"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches_sql(table: str, key: str, types: list[str], text: str = "text") -> str:
    """Matches with offsets: what stands between matches is cut out by the same pattern."""
    parts = []
    for t in types:
        r = _quoted(re2(ENTITIES[t]))
        parts.append(
            f"""SELECT {key}, '{t}' AS type, i - 1 AS match_idx, m[i] AS value, CAST(list_sum(list_transform(b[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i-1], lambda s: length(s))), 0) AS BIGINT) AS start_off
            FROM (SELECT {key}, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(coalesce({text}, ''), {r}, 0) AS m, string_split_regex(coalesce({text}, ''), {r}) AS b FROM {table}))"""
        )
    return f"SELECT {key}, type, match_idx, value, start_off, start_off + length(value) AS end_off FROM (" + " UNION ALL ".join(parts) + ") WHERE length(value) > 0"


def _width_sql(text: str) -> str:
    parts = [f"556 * length({text})"]
    for w in sorted(set(HELVETICA.values()) - {556}):
        letters = "".join(sorted(c for c, v in HELVETICA.items() if v == w))
        parts.append(f"({w - 556}) * (length({text}) - length(translate({text}, {_quoted(letters)}, '')))")
    return "(" + " + ".join(parts) + ")"


_ITEMS_SQL = f"""lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS str, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
items AS (SELECT doc_id, CAST(n // 50 + 1 AS INT) AS page, n AS item_idx, str, 72.0::DOUBLE AS x, (742.0 - 14.0 * (n % 50))::DOUBLE AS y, {_width_sql('str')} / 1000.0::DOUBLE * 10 AS width, 10.0::DOUBLE AS height FROM lines WHERE length(trim(str)) > 0)"""
_BARS_SQL = """bars AS (SELECT doc_id, page, item_idx AS rect_idx, x AS x1, low AS y1, x + 60 AS x2, low + CASE WHEN item_idx % 5 = 4 THEN 1.5 ELSE 8.0 END AS y2
FROM (SELECT *, y + CASE WHEN item_idx % 3 = 1 THEN 10.0 ELSE 0.0 END AS low FROM items) WHERE item_idx % 7 = 0)"""
_PLACED_SQL = """placed AS (SELECT *, string_agg(str, chr(10)) OVER w AS so_far FROM items WINDOW w AS (PARTITION BY doc_id, page ORDER BY item_idx)),
texts AS (SELECT doc_id, page, string_agg(str, chr(10) ORDER BY item_idx) AS text FROM items GROUP BY doc_id, page)"""
_UNDER = "i.doc_id = b.doc_id AND i.page = b.page AND i.x < b.x2 - {k} AND i.x + i.width > b.x1 + {k} AND i.y < b.y2 - {k} AND i.y + i.height > b.y1 + {k}"
_W0, _W1 = _UNDER.format(k=0), _UNDER.format(k=1)
_BIG = "b.x2 - b.x1 >= 5 AND b.y2 - b.y1 >= 5"


QUERIES = {
    f.__name__: f
    for f in (
        detect_summary, detect_matches, detect_names, detect_names_summary, entity_ssn, entity_date, entity_privilege, redact_masked_text, scanned_docs, text_items, page_text,
        match_regions, normalize_regions, regions_with_text, visual_only, redaction_counts, redact_warnings, verify_violations, verify_rollup,
        audit_text_under_box, strip_overlays_text, prior_revision, audit_metadata, font_width, hex_colors, document_hashes,
    )
}

_SENSITIVE = " ".join(f"WHEN regexp_matches(value, {_quoted(re2(p))}) THEN '{name}: ' || value[1:120]" for name, p in METADATA.items())
ORACLES = {
    "detect_summary": f"SELECT type, count(*) AS n_matches, count(DISTINCT trim(value)) AS n_distinct, count(DISTINCT doc_id) AS n_docs FROM ({_matches_sql('documents', 'doc_id', PLAIN)}) GROUP BY type",
    "detect_matches": _matches_sql("documents", "doc_id", PLAIN),
    "entity_ssn": "WITH t AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 9, '1') AS k FROM customer), s AS (SELECT c_custkey, 'number ' || CASE WHEN c_custkey % 5 = 0 THEN k[1:2] || '-' || k[3:5] || '-' || k[6:9] ELSE k[1:3] || '-' || k[4:5] || '-' || k[6:9] END || '.' AS text FROM t) " + _matches_sql("s", "c_custkey", ["ssn"]),
    "entity_date": "WITH s AS (SELECT o_orderkey, 'on ' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%-m/%-d/%Y') ELSE strftime(o_orderdate, '%b %-d, %Y') END || ' or so' AS text FROM orders) " + _matches_sql("s", "o_orderkey", ["date"]),
    "entity_privilege": "WITH s AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'see Attorney-Client  Privilege here' WHEN 1 THEN 'PRIVILEGED AND CONFIDENTIAL' WHEN 2 THEN 'my work product' WHEN 3 THEN 'Privileged Communication!' ELSE 'nothing to see' END AS text FROM orders) " + _matches_sql("s", "o_orderkey", ["attorney-client-marker"]),
    "scanned_docs": f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), {_quoted(re2('[{s}]+'))}, '', 'g')) < 24 AS is_scanned FROM documents",
    "text_items": f"WITH {_ITEMS_SQL} SELECT doc_id, page, item_idx, str, x, y, round(width, 6) AS width, height FROM items",
    "page_text": f"WITH {_ITEMS_SQL} SELECT doc_id, page, string_agg(str, chr(10) ORDER BY item_idx) AS text FROM items GROUP BY doc_id, page",
    "match_regions": f"""WITH {_ITEMS_SQL}, {_PLACED_SQL}, spans AS (SELECT *, length(so_far) - length(str) AS a, length(so_far) AS z FROM placed),
        found AS ({_matches_sql('texts', 'doc_id, page', ['email', 'ip-address', 'credit-card'])})
        SELECT f.doc_id, f.page, f.type, f.match_idx, round(min(x) - 2, 4) AS x, round(792 - max(y + height) - 2, 4) AS y, round(max(x + width) - min(x) + 4, 4) AS width, round(max(y + height) - min(y) + 4, 4) AS height
        FROM found f JOIN spans s ON f.doc_id = s.doc_id AND f.page = s.page AND s.z > f.start_off AND s.a < f.end_off GROUP BY f.doc_id, f.page, f.type, f.match_idx""",
    "normalize_regions": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT doc_id, page, rect_idx AS region_idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM bars",
    "regions_with_text": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT doc_id, page, rect_idx AS region_idx FROM bars b WHERE EXISTS (SELECT 1 FROM items i WHERE {_W0})",
    "visual_only": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT doc_id, page, rect_idx AS region_idx FROM bars b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE {_W0})",
    "redaction_counts": f"WITH {_ITEMS_SQL}, {_BARS_SQL}, per AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT page)), ',') AS p FROM bars GROUP BY doc_id) SELECT d.doc_id, coalesce(n, 0) AS redacted_count, coalesce(p, '') AS pages_affected FROM documents d LEFT JOIN per USING (doc_id)",
    "redact_warnings": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT DISTINCT doc_id, page, 'visual-only-region' AS type FROM bars b WHERE NOT EXISTS (SELECT 1 FROM items i WHERE {_W0})",
    "verify_violations": f"""WITH {_ITEMS_SQL}, {_BARS_SQL}, met AS (SELECT i.doc_id, i.page, item_idx, rect_idx, greatest(x, x1) AS x1, greatest(y, y1) AS y1, least(x + width, x2) AS x2, least(y + height, y2) AS y2, str AS recovered_text,
        row_number() OVER (PARTITION BY i.doc_id, i.page, item_idx ORDER BY rect_idx) AS k FROM items i JOIN bars b ON {_W0} AND b.x2 - b.x1 >= 5 AND b.y2 - b.y1 >= 2)
        SELECT doc_id, page, item_idx, rect_idx, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, recovered_text FROM met WHERE k = 1""",
    "verify_rollup": f"""WITH {_ITEMS_SQL}, {_BARS_SQL}, met AS (SELECT DISTINCT i.doc_id, i.page, item_idx FROM items i JOIN bars b ON {_W0} AND b.x2 - b.x1 >= 5 AND b.y2 - b.y1 >= 2)
        SELECT d.doc_id, count(m.doc_id) AS n_findings, count(m.doc_id) = 0 AS clean FROM documents d LEFT JOIN met m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
    "audit_text_under_box": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT b.doc_id, b.page, rect_idx, arg_min(str, item_idx) AS recovered_text FROM items i JOIN bars b ON {_W1} AND {_BIG} GROUP BY b.doc_id, b.page, rect_idx",
    "strip_overlays_text": f"WITH {_ITEMS_SQL}, {_BARS_SQL} SELECT b.doc_id, b.page, rect_idx, string_agg(str, ' ' ORDER BY item_idx) AS recovered_text FROM items i JOIN bars b ON {_W1} AND {_BIG} GROUP BY b.doc_id, b.page, rect_idx",
    "prior_revision": "WITH s AS (SELECT event_id, 'a' || event_type || repeat('%%EOF x', CAST(event_id % 4 AS INT)) AS text FROM events) SELECT event_id, len(string_split(text, '%%EOF')) - 1 AS n_markers, text[1:instr(text, '%%EOF') + 4] AS prior FROM s WHERE len(string_split(text, '%%EOF')) > 2",
    "audit_metadata": f"""WITH m AS (SELECT p_partkey AS doc_id, 'Subject' AS field, CASE p_partkey % 4 WHEN 0 THEN p_name || ' mail a.b@example.org' WHEN 1 THEN 'see https://example.org/' || p_partkey WHEN 2 THEN '  ' ELSE p_name END AS value FROM part)
        SELECT doc_id, field, 'INFO' AS severity, value[1:120] AS detail FROM m WHERE length(trim(value)) > 0
        UNION ALL SELECT doc_id, field, 'MEDIUM' AS severity, detail FROM (SELECT *, CASE {_SENSITIVE} END AS detail FROM m WHERE length(trim(value)) > 0) WHERE detail IS NOT NULL""",
    "font_width": f"SELECT p_partkey, {_width_sql('p_name')} AS helvetica, 600 * length(p_name) AS courier FROM part",
    "hex_colors": "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE round((p_partkey // 65536 % 256) / 255.0::DOUBLE, 6) END AS r, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE round((p_partkey // 256 % 256) / 255.0::DOUBLE, 6) END AS g, CASE WHEN p_partkey % 9 = 0 THEN 0.0 ELSE round((p_partkey % 256) / 255.0::DOUBLE, 6) END AS b FROM part",
}

