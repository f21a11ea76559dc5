"""Command line: python -m inkveil search|entities|verify|redact|audit|strip FILES... [options].

FILES is a folder or a file; results go to the folder named by --output. Exit status 1 says that verify found something or
warned, that audit found something, or that a document failed.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions.patterns import Pattern, parse_pattern, selected_types
from inkveil.operators import audit, documents, layout, redact
from inkveil.sources import files


def _color(text: str) -> tuple[float, float, float]:
    digits = text.removeprefix("#")
    try:
        return tuple(int(digits[k : k + 2], 16) / 255 for k in (0, 2, 4)) if len(digits) == 6 else (0.0, 0.0, 0.0)
    except ValueError:
        return (0.0, 0.0, 0.0)


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="inkveil", description="Redaction, verification and audit of PDF files.")
    kinds = out.add_subparsers(dest="command", required=True)
    for name in ("search", "entities", "verify", "redact", "audit", "strip"):
        p = kinds.add_parser(name)
        p.add_argument("files")
        p.add_argument("--json", action="store_true")
        if name in ("search", "entities", "redact", "strip"):
            p.add_argument("--output", required=True)
        if name in ("search", "entities", "redact"):
            p.add_argument("--manifest", action="store_true")
            p.add_argument("--color", default="#000000")
            p.add_argument("--label")
        if name == "search":
            p.add_argument("--pattern", action="append", required=True)
            p.add_argument("--exemption")
        if name == "entities":
            p.add_argument("--types")
            p.add_argument("--exemption", action="append", default=[], help="type=code")
        if name == "redact":
            p.add_argument("--regions", required=True, help="JSON, or the path of a JSON file")
        if name == "audit":
            p.add_argument("--preset", default="quick")
    return out


def _written(found: dict[str, DataFrame], docs: DataFrame, args) -> tuple[list[dict], bool]:
    """Write the files, and manifests beside them; what happened to each, and whether all went well."""
    done = found["files"].join(docs.select("doc_id", "name"), "doc_id").persist()
    files.write_files(done.filter("error is null"), args.output).write.format("noop").mode("overwrite").save()
    if args.manifest:
        log = redact.manifests(done.filter("error is null").select("doc_id", "sha256_before", "sha256_after"), redact.entries(found["regions"], done))
        texts = redact.manifest_json(log).join(docs.select("doc_id", "name"), "doc_id")
        files.write_files(texts.select(F.concat(F.regexp_replace("name", r"(?i)\.pdf$", ""), F.lit(".manifest.json")).alias("name"), F.encode("manifest", "UTF-8").alias("content")), args.output).write.format("noop").mode("overwrite").save()
    rows = found["results"].join(redact.summary_json(found["results"], found["warnings"]), "doc_id").join(done.select("doc_id", "name", "error"), "doc_id")
    out = [{"name": r["name"], "error": r["error"], **json.loads(r["summary"])} for r in rows.toLocalIterator()]
    return out, all(r["error"] is None for r in out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    docs = files.distinct_files(files.read_files(spark, args.files))
    scanned = files.scan(docs).persist()
    good = True
    if args.command in ("search", "entities"):
        color = _color(args.color)
        if args.command == "search":
            patterns = [Pattern(f"pattern{k}", parse_pattern(p), args.label, args.exemption, color=color) for k, p in enumerate(args.pattern)]
            found = documents.search_files(docs, patterns, scanned, labels=bool(args.label or args.exemption))
        else:
            found = documents.entity_files(docs, selected_types(args.types), scanned, codes=dict(e.split("=", 1) for e in args.exemption), labels=True)
        lines, good = _written(found, docs, args)
    elif args.command == "redact":
        given = files.regions_from_json(spark, args.regions).withColumn("label", F.coalesce("label", F.lit(args.label)))
        high = files.pages(scanned).select("doc_id", "page", F.col("height").alias("_high"))
        regions = layout.normalized(high.join(given, "page"), F.col("_high")).drop("_high")
        lines, good = _written(documents.redact_files(docs, regions, scanned), docs, args)
    elif args.command == "strip":
        done = documents.restore_files(docs).join(docs.select("doc_id", "name"), "doc_id").persist()
        files.write_files(done.filter("error is null"), args.output).write.format("noop").mode("overwrite").save()
        shown = done.select("name", "error", "overlays_stripped", "annotations_removed", "prior_revision_recovered", "findings", F.concat(F.lit("<"), F.length("prior_revision"), F.lit(" bytes>")).alias("prior_revision"))
        lines = [json.loads(r[0]) for r in shown.select(F.to_json(F.struct("*"))).toLocalIterator()]
        good = not any(x.get("error") for x in lines)
    elif args.command == "verify":
        found = documents.verify_files(scanned)
        per = found["warnings"].groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "type"))).alias("warnings"))
        rows = found["results"].join(per, "doc_id", "left").join(docs.select("doc_id", "name"), "doc_id").drop("doc_id")
        lines = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator()]
        good = all(x["clean"] and not x.get("warnings") for x in lines)
    else:
        found, report = documents.audit_files(docs, scanned, audit.preset(args.preset))
        per = found.groupBy("doc_id").agg(F.collect_list(F.struct("check", "severity", "page", "detail", "recovered_text")).alias("findings"))
        rows = report.join(per, "doc_id", "left").join(docs.select("doc_id", "name"), "doc_id").drop("doc_id")
        lines = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).toLocalIterator()]
        good = all(x["clean"] for x in lines)
    for line in sorted(lines, key=lambda x: x["name"]):
        if args.json:
            print(json.dumps(line))
        else:
            print(", ".join(f"{k}: {v}" for k, v in line.items() if k not in ("warnings", "findings") and v is not None))
            for w in line.get("warnings") or []:
                print(f"  warning on page {w['page']}: {w['type']}", file=sys.stderr)
            for f in line.get("findings") or []:
                print("  " + " ".join(str(v) for v in f.values() if v is not None))
    return 0 if good else 1


if __name__ == "__main__":
    sys.exit(main())
