"""Annotations, the detector hook, and streams."""

from inkveil.functions.patterns import entity_patterns
from inkveil.operators import annotations as an
from inkveil.operators import detect
from inkveil.streaming import detection

FIELDS = "doc_id long, page int, annot_idx int, subtype string, x1 double, y1 double, x2 double, y2 double"


def test_pending_and_stripped(spark):
    rows = [(1, 1, 0, "Text", 0.0, 0.0, 1.0, 1.0), (1, 1, 1, "Redact", 1.0, 2.0, 3.0, 4.0), (1, 1, 2, "Redact", 5.0, 6.0, 7.0, 8.0), (1, 2, 0, None, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, FIELDS)
    assert sorted(r.annot_idx for r in an.pending_annotations(df).collect()) == [1, 2]
    stays, findings = an.stripped_annotations(df)
    assert sorted((r.page, r.annot_idx) for r in stays.collect()) == [(1, 0), (2, 0)]
    assert [(r.page, r.removed, r.x1) for r in findings.collect()] == [(1, 2, 1.0)]
    assert an.pending_annotations(df.limit(0)).count() == 0


def test_detector(spark):
    items = spark.createDataFrame(
        [(1, 1, 0, "name", 10.0, 700.0, 40.0, 12.0), (1, 1, 1, "other", 10.0, 600.0, 40.0, 12.0), (1, 2, 0, " ", 0.0, 0.0, 1.0, 1.0), (2, 1, 0, "none", 0.0, 0.0, 1.0, 1.0)],
        "doc_id long, page int, item_idx long, str string, x double, y double, width double, height double",
    )
    found = an.detected_regions(items, lambda page, n: page[page["str"] == "name"][["x", "y", "width", "height"]], 792.0, "PHI").collect()
    assert [(r.doc_id, r.page, r.region_idx, r.x, r.y, r.label) for r in found] == [(1, 1, 0, 10.0, 80.0, "PHI")]


def test_streams_equal_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.org"), (2, None), (3, "none")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = detection.document_stream(spark, str(tmp_path / "in"), docs.schema)
    kinds = entity_patterns(["email"])
    for name, flow, want in (("matches", detection.match_stream(stream, kinds), detect.matches(docs, kinds)), ("masked", detection.masked_stream(stream, kinds), detect.masked(docs, kinds))):
        detection.write_stream(flow, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
