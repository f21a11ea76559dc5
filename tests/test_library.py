"""Golden cases of streams and patterns, offsets, and the catalog against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from inkveil.functions.content_stream import blank_all, blank_regions, blank_stream
from inkveil.functions.patterns import entity_patterns, from_script, parse_pattern
from inkveil.operators import detect
from inkveil.plans import catalog, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (b"BT (Hello World) Tj ET", b"BT (           ) Tj ET"),
        (b"(outer (inner) text) Tj", b"(                  ) Tj"),
        (b"BT <48656c6c6f> Tj ET", b"BT <0000000000> Tj ET"),
        (b"<</Type /Page>>", b"<</Type /Page>>"),
        (b"(First) Tj (Second) Tj", b"(     ) Tj (      ) Tj"),
        (b"() Tj", b"() Tj"),
        (b"q 1 0 0 1 100 700 cm Q", b"q 1 0 0 1 100 700 cm Q"),
        (b"", b""),
    ],
)
def test_blank_all(before, after):
    assert blank_all(before) == after


def test_blanking_keeps_lengths():
    for data in (b"BT (Sensitive) Tj ET", rb"(escaped \) paren) Tj", b"(open", b"<4865", b"BT 1 0 0 1 5 5 Tm (a) Tj ET"):
        assert len(blank_all(data)) == len(data) == len(blank_regions(data, [(0, 0, 9, 9)]))


def test_blank_regions():
    data = b"BT 1 0 0 1 100 400 Tm (secret) Tj ET BT 300 50 Td (kept) Tj ET"
    assert blank_regions(data, [(95, 390, 200, 410)]) == data.replace(b"secret", b"      ")


def test_blank_stream_column(spark):
    rows = spark.createDataFrame([(bytearray(b"(ab) Tj"),), (None,)], "content binary").select(blank_stream("content").alias("c")).collect()
    assert [None if r.c is None else bytes(r.c) for r in rows] == [b"(  ) Tj", None]


CASES = [
    ("ssn", "My SSN is 123-45-6789.", 1), ("ssn", "12-345-6789", 0), ("ssn", "é123-45-6789", 1), ("email", "hello@example.com user+tag@sub.domain.org", 2),
    ("phone", "Call us at 555-867-5309", 1), ("credit-card", "4111-1111-1111-1111", 1), ("credit-card", "378282246310005", 0), ("ip-address", "192.168.1.1", 1),
    ("date", "Jan 1, 2024 and 01-31-24", 2), ("name", "saw John Smith there", 1), ("attorney-client-marker", "Attorney–Client privilege", 1),
]


GOLDEN = {
    "ssn": (["123-45-6789"], "a 123-45-6789 b x123-45-6789 123-45-67890 é123-45-6789", 2),
    "phone": (["+1 (555) 867-5309", "555.867.5309", "5558675309"], "+1 (555) 867-5309 or 555.867.5309, 5558675309 and 555-86-5309", 3),
    "email": (["a.b+c@sub.example.org"], "mail a.b+c@sub.example.org, not a@b or @c.de", 1),
    "credit-card": (["4111 1111 1111 1111", "5105-1051-0510-5100", "6011000000000004"], "4111 1111 1111 1111 5105-1051-0510-5100 6011000000000004 7111111111111111", 3),
    "ip-address": (["999.1.22.3"], "at 999.1.22.3 and 1.2.3", 1),
    "date": (["1/2/2024", "12-31-99", "sept. 5, 2020", "MAY 1 1999"], "1/2/2024 12-31-99 sept. 5, 2020 MAY 1 1999 Foo 1, 2000", 4),
    "name": (["John Smith"], "saw John Smith there. Jane Roe left", 1),
    "attorney-client-marker": (["Attorney–Client Privilege", "work  product", "PRIVILEGED AND CONFIDENTIAL"], "Attorney–Client Privilege, work  product; PRIVILEGED AND CONFIDENTIAL; privilege", 3),
}


@pytest.mark.parametrize("kind", sorted(GOLDEN))
def test_golden_matches(spark, kind):
    values, text, n = GOLDEN[kind]
    found = [r.value for r in detect.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), entity_patterns([kind])).orderBy("start_off").collect()]
    assert len(found) == n and set(found) == set(values) if kind != "ssn" else found == values * 2


def test_golden_widths(spark):
    from inkveil.functions.geometry import text_moments, text_units

    df = spark.createDataFrame([("Ab 1.",)], "t string")
    want = {"Helvetica": [667, 556, 278, 556, 278], "Times-Roman": [722, 500, 250, 500, 250], "Courier": [600] * 5, "g_d0_Times-Bold": [722, 500, 250, 500, 250], "Other": [556] * 5}
    for name, widths in want.items():
        first, second = text_moments(df.t, name)
        assert tuple(df.select(text_units(df.t, name), first, second).first()) == (sum(widths), sum(widths), sum(w * w for w in widths)), name


def test_handed_and_typed_patterns():
    from inkveil.functions.patterns import default_code, handed_patterns, loose_pattern, selected_types

    got = handed_patterns('{"groups": [{"values": ["a.b", "a.b", " ", 3], "code": "(b)(6)"}, {"values": ["x"], "label": "L"}], "strings": ["/y+/i"]}')
    assert [(p.regex, p.label, p.code) for p in got] == [(r"a\.b", "(b)(6)", "(b)(6)"), ("x", "L", None), ("(?i)y+", "REDACTED", None)]
    assert len(handed_patterns('{"strings": [' + ",".join(f'"v{k}"' for k in range(700)) + "]}")) == 500
    assert loose_pattern("a.b") == r"(?i)a\.b" and loose_pattern("/(/") is None and loose_pattern(" ") is None
    assert (default_code("attorney-client-marker"), default_code("person")) == ("(b)(5)", "(b)(6)")
    assert selected_types(" SSN, email") == ["ssn", "email"] and len(selected_types(None)) == 8
    with pytest.raises(ValueError, match="unknown"):
        selected_types("ssn,nothing")


def test_patterns_and_offsets(spark):
    for kind, text, n in CASES:
        found = detect.matches(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), entity_patterns([kind])).collect()
        assert len(found) == n, (kind, text)
        assert all(text[r.start_off : r.end_off] == r.value for r in found)


def test_script_dialect(spark):
    df = spark.createDataFrame([("a b&&c",)], "t string")
    for source, good in ((r"a\sb", True), (r"[a&&c]&", True), (r"c$", True), (r"b$", False), (r"a.b", True)):
        assert df.filter(df.t.rlike(from_script(source))).count() == good, source
    assert parse_pattern("a.b") == r"a\.b" and parse_pattern("/a+/i") == "(?i)a+"


def test_masks_hide_what_was_found(spark):
    df = spark.createDataFrame([(1, "mail a@b.org, or c@d.org."), (2, None)], "doc_id long, text string")
    out = [r.text for r in detect.masked(df, entity_patterns(["email"])).collect()]
    assert out == ["mail ███████, or ███████.", None]


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or str(v) in ("nan", "<NA>") else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_names_summary(spark):
    import re

    import pyarrow.parquet as pq

    [name] = entity_patterns(["name"])
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = [(d["doc_id"], m[0]) for d in docs for m in re.finditer(name.regex, d["text"] or "") if m[0]]
    got = catalog.QUERIES["detect_names_summary"](spark, "/root/testdata/sf0.01").collect()
    assert found and [tuple(r) for r in got] == [("name", len(found), len({v.strip(" ") for _, v in found}), len({k for k, _ in found}))]


def test_patterns_of_certain_pages(spark):
    from dataclasses import replace

    [email] = entity_patterns(["email"])
    rows = [(1, page, f"a{page}@x.org and b@x.org") for page in (1, 2, 3)] + [(1, None, "c@x.org")]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    got = detect.matches(df, [replace(email, name="some", pages=(1, 3)), email], keys=("doc_id", "page")).collect()
    assert sorted((r.page, r.start_off) for r in got if r.type == "some") == [(1, 0), (1, 13), (3, 0), (3, 13)]
    assert sum(r.type == "email" for r in got) == 7


def test_ocr_lines_of_matches_only(spark):
    """Only lines that a pattern matches are spread into words; the words hit are the same."""
    from inkveil.functions.patterns import entity_patterns
    from inkveil.operators import ocr

    box = "0D AS x0, 0D AS y0, 1D AS x1, 1D AS y1"
    lines = [["mail", "a.b@example.org", "now"], ["nothing", "here"], ["at@", "no"], ["10.0.0.1", " ", "a.b@example.org"], [" "]]
    words = "array(" + ", ".join("struct(array(" + ", ".join(f"(SELECT struct('{w}' AS text, {box}))" for w in ws) + ") AS words)" for ws in lines) + ")"
    pages = spark.sql(f"SELECT 1 AS doc_id, 1 AS page, array(struct(array(struct({words} AS lines)) AS paragraphs)) AS blocks")
    patterns = entity_patterns(["email", "ip-address"])
    kept, whole = ocr.lines_of_blocks(pages, patterns=patterns), ocr.lines_of_blocks(pages)
    assert sorted((r.line, r.word_idx) for r in kept.collect()) == [(0, 0), (0, 1), (0, 2), (3, 0), (3, 1)]
    hit = lambda rows: sorted((r.line, r.text) for r in ocr.words_hit(rows, patterns).collect())
    assert hit(kept) == hit(whole) == [(0, "a.b@example.org"), (3, "10.0.0.1"), (3, "a.b@example.org")]


def test_documents_without_hints_are_not_laid_out(spark, tmp_path):
    """Only documents that may have matches become items, and none with a match is left out, though it goes over lines and pages."""
    from inkveil.functions.patterns import entity_patterns
    from inkveil.plans import catalog, layers

    rows = [(1, "nothing here\n" * 60), (2, "our Work\n  \nProduct"), (3, "x\n" * 120 + "a.b@example.org"), (4, None), (5, "1.5 is no address"), (6, "no privileges")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = catalog._items(spark, str(tmp_path), entity_patterns(["email", "ip-address", "attorney-client-marker"]))
    assert {r.doc_id for r in kept.select("doc_id").distinct().collect()} == {2, 3, 5, 6}
    assert {r.doc_id for r in catalog._items(spark, str(tmp_path), entity_patterns(["name"])).select("doc_id").distinct().collect()} == {1, 2, 3, 5, 6}
    assert sorted((r.doc_id, r.page, r.type) for r in layers.coded_regions(spark, str(tmp_path)).collect()) == [(2, 1, "attorney-client-marker"), (3, 3, "email")]
