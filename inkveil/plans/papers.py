"""Queries over document files made from the driver's tables, each read back by the parser, with SQL from the tables themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import pdf
from inkveil.operators import audit, documents
from inkveil.plans.catalog import _read, _width_sql
from inkveil.session import Scratch, ship
from inkveil.sources import files

MARK, NOTE = ({"Type": pdf.Name("Annot"), "Subtype": pdf.Name(s), "Rect": [70, 600, 200, 620]} for s in ("Redact", "Text"))

#: Papers that a task makes: a table of many customers is a small file, often of one row group, which one task would read.
DEALT = 2000


def _paper(key: int, name: str, balance: str, segment: str) -> bytes | None:
    """A customer's paper: two pages, an identifier on the first that a bar hides on every third; every eleventh is no document."""
    if key % 11 == 0:
        return b"not a document"
    number = f"{key % 1000:03d}-{key % 100:02d}-{key % 10000:04d}"
    first = pdf.shown_text(f"{name} of {segment}", 72, 700) + b"\n" + pdf.shown_text(f"number {number}", 72, 650, 10)
    first += b"\n0 g 70 646 300 16 re f" if key % 3 == 0 else b"\n70 100 50 20 re S"
    data = pdf.made([first, pdf.shown_text(f"balance {balance}", 100, 500, 8, "F2")], info={"Title": name, "Author": "  " if key % 2 else "a@example.org"}, annotations={0: [NOTE, MARK, MARK]} if key % 4 == 0 else None, images=(1,) if key % 5 == 0 else (), compressed=key % 2 == 0)
    return data + data[data.rindex(b"startxref") :] if key % 7 == 0 else data  # saved twice


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    customers = _read(spark, sf_dir, "customer")
    parts = max(spark.sparkContext.defaultParallelism, -(-customers.count() // DEALT))
    rows = customers.select("c_custkey", "c_name", F.format_string("%.2f", "c_acctbal").alias("balance"), "c_mktsegment").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_paper(*r) for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id long, content binary")


def _saved(spark: SparkSession, sf_dir: str, parts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The papers and their scan, written once, as several tables are taken from each."""
    scratch = Scratch(spark, "papers")
    docs = scratch.save(papers(spark, sf_dir), "papers")
    return docs, scratch.save(files.scan(docs, parts=parts), "scan")


def file_status(spark, sf_dir):
    return files.scan(papers(spark, sf_dir), parts=()).select("doc_id", "status", "n_pages")


def file_items(spark, sf_dir):
    items = files.text_items(files.scan(papers(spark, sf_dir), parts=("items",)))
    return items.select("doc_id", "page", "item_idx", "str", *[F.round(n, 4).alias(n) for n in ("x", "y", "width", "height")], "font", "font_size")


def file_pages(spark, sf_dir):
    return files.pages(files.scan(papers(spark, sf_dir), parts=()))


def file_metadata(spark, sf_dir):
    return files.metadata(files.scan(papers(spark, sf_dir), parts=("metadata",)))


def file_annotations(spark, sf_dir):
    return files.annotations(files.scan(papers(spark, sf_dir), parts=("annotations",)))


def file_verify(spark, sf_dir):
    found = documents.verify_files(_saved(spark, sf_dir, ("items", "ops"))[1])
    warned = found["warnings"].groupBy("doc_id").agg(F.count("*").alias("n_warnings"))
    return found["results"].join(warned, "doc_id", "left").select("doc_id", F.col("n_findings").cast("long").alias("n_findings"), "clean", F.coalesce("n_warnings", F.lit(0)).cast("long").alias("n_warnings"))


def file_audit(spark, sf_dir):
    found, report = documents.audit_files(*_saved(spark, sf_dir, ("items", "ops", "annotations", "metadata")), audit.preset("quick"))
    return report.select("doc_id", "status", F.col("n_findings").cast("long").alias("n_findings"), F.array_join("checks", ",").alias("checks"), "clean")


def file_redacted(spark, sf_dir):
    """Identifiers are redacted, and the files read again: what stays of each string, and how much was covered."""
    docs, scanned = _saved(spark, sf_dir, ("items",))
    done = documents.entity_files(docs, ["ssn"], scanned)
    again = files.scan(done["files"].select("doc_id", "content"), parts=("items",))
    left = files.text_items(again).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "item_idx", "str"))), lambda s: s["str"]), "|").alias("text"))
    return done["results"].join(left, "doc_id", "left").select("doc_id", F.col("redacted_count").cast("long").alias("redacted_count"), "text")


def file_restored(spark, sf_dir):
    out = documents.restore_files(papers(spark, sf_dir))
    kinds = F.array_join(F.transform("findings", lambda f: f["scenario"]), "").alias("scenarios")
    return out.select("doc_id", F.col("overlays_stripped").cast("long").alias("overlays_stripped"), F.col("annotations_removed").cast("long").alias("annotations_removed"), "prior_revision_recovered", kinds, F.get("findings", F.lit(0))["recovered_text"].alias("recovered_text"))


_PAPERS = """papers AS (SELECT c_custkey AS k, c_name || ' of ' || c_mktsegment AS line, 'number ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS id,
'balance ' || printf('%.2f', c_acctbal) AS balance, c_name FROM customer), good AS (SELECT * FROM papers WHERE k % 11 <> 0)"""
_LINES = f"""lines AS (SELECT k AS doc_id, 1 AS page, 0::BIGINT AS item_idx, line AS str, 72.0::DOUBLE AS x, 700.0::DOUBLE AS y, round({_width_sql('line')} / 1000.0::DOUBLE * 12, 4) AS width, 12.0::DOUBLE AS height, 'Helvetica' AS font, 12.0::DOUBLE AS font_size FROM good
UNION ALL SELECT k, 1, 1, id, 72, 650, round({_width_sql('id')} / 1000.0::DOUBLE * 10, 4), 10, 'Helvetica', 10 FROM good UNION ALL SELECT k, 2, 0, balance, 100, 500, round(600 * length(balance) / 1000.0::DOUBLE * 8, 4), 8, 'Courier', 8 FROM good)"""
_CHECKS = "array_to_string(list_filter([CASE WHEN k % 7 = 0 THEN 'incremental-save' END, 'metadata-leak', CASE WHEN k % 4 = 0 THEN 'pending-annotation' END, CASE WHEN k % 3 = 0 THEN 'text-under-box' END], lambda x: x IS NOT NULL), ',')"

QUERIES = {f.__name__: f for f in (file_status, file_items, file_pages, file_metadata, file_annotations, file_verify, file_audit, file_redacted, file_restored)}
ORACLES = {
    "file_status": f"WITH {_PAPERS} SELECT k AS doc_id, CASE WHEN k % 11 = 0 THEN 'unreadable' ELSE 'ok' END AS status, CASE WHEN k % 11 <> 0 THEN 2 END AS n_pages FROM papers",
    "file_items": f"WITH {_PAPERS}, {_LINES} SELECT * FROM lines",
    "file_pages": f"WITH {_PAPERS} SELECT k AS doc_id, page, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, page = 2 AND k % 5 = 0 AS has_image FROM good, (SELECT unnest([1, 2]) AS page)",
    "file_metadata": f"WITH {_PAPERS} SELECT k AS doc_id, 'info' AS kind, 'Title' AS field, c_name AS value FROM good UNION ALL SELECT k, 'info', 'Author', CASE WHEN k % 2 = 1 THEN '  ' ELSE 'a@example.org' END FROM good",
    "file_annotations": f"WITH {_PAPERS} SELECT k AS doc_id, 1 AS page, CAST(i AS INT) AS annot_idx, CASE i WHEN 0 THEN 'Text' ELSE 'Redact' END AS subtype, 70.0::DOUBLE AS x1, 600.0::DOUBLE AS y1, 200.0::DOUBLE AS x2, 620.0::DOUBLE AS y2 FROM good, (SELECT unnest([0, 1, 2]) AS i) WHERE k % 4 = 0",
    "file_verify": f"WITH {_PAPERS} SELECT k AS doc_id, CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN 1 ELSE 0 END AS n_findings, k % 11 <> 0 AND k % 3 <> 0 AS clean, 0::BIGINT AS n_warnings FROM papers",
    "file_audit": f"WITH {_PAPERS} SELECT k AS doc_id, CASE WHEN k % 11 = 0 THEN 'unreadable' ELSE 'ok' END AS status, CASE WHEN k % 11 = 0 THEN 0 ELSE 1 + CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + (k % 7 = 0)::INT + (k % 4 = 0)::INT + (k % 3 = 0)::INT END AS n_findings, CASE WHEN k % 11 = 0 THEN '' ELSE {_CHECKS} END AS checks, false AS clean FROM papers",
    "file_redacted": f"WITH {_PAPERS} SELECT k AS doc_id, (k % 11 <> 0)::BIGINT AS redacted_count, CASE WHEN k % 11 <> 0 THEN line || '|' || balance END AS text FROM papers",
    "file_restored": f"WITH {_PAPERS} SELECT k AS doc_id, CASE WHEN k % 11 <> 0 THEN (k % 3 = 0)::BIGINT END AS overlays_stripped, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END END AS annotations_removed, CASE WHEN k % 11 <> 0 THEN k % 7 = 0 END AS prior_revision_recovered, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 3 = 0 THEN 'A' ELSE '' END || CASE WHEN k % 4 = 0 THEN 'B' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'C' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'D' ELSE '' END END AS scenarios, CASE WHEN k % 11 <> 0 AND k % 3 = 0 THEN id END AS recovered_text FROM papers",
}
