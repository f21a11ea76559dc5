"""Whole document files: redaction, verification, audit and recovery of bytes, one row a document.

Frames have doc_id, content (binary) and what an operation takes besides, as array columns of the row; what is done to
one document's bytes is a plain function, run in Arrow batches. A document that fails keeps its row, with the reason in error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions import pdf, sfnt
from inkveil.functions.content_stream import blank_all, blank_regions, blank_spans
from inkveil.functions.geometry import AUDIT_BAR, INSET, VERIFY_BAR, font
from inkveil.functions.patterns import PLAIN_LABEL, Pattern, entity_patterns
from inkveil.operators import audit as checks
from inkveil.operators import layout, paths, redact, restore
from inkveil.operators.annotations import MARK
from inkveil.session import ship
from inkveil.sources import files

#: Regions as array columns have them (bottom-left).
REGIONS = "array<struct<page:int,x1:double,y1:double,x2:double,y2:double,color:array<double>,label:string,exemption_code:string,exemption_basis:string>>"


def _overlap(item: pdf.Item, r: dict) -> bool:
    return item.x < r["x2"] and item.x + item.width > r["x1"] and item.y < r["y2"] and item.y + item.height > r["y1"]


def _bar(r: dict, labels: bool) -> bytes:
    """Content that draws a region's bar, and its label if it fits."""
    n = lambda *xs: " ".join(map(pdf.number_text, xs))
    wide, high = r["x2"] - r["x1"], r["y2"] - r["y1"]
    out = f"q {n(*(r.get('color') or (0, 0, 0)))} rg {n(r['x1'], r['y1'], wide, high)} re f Q\n".encode()
    text = r.get("exemption_code") or r.get("label") or PLAIN_LABEL
    size = min(high * 0.6, 10.0)
    widths, default = font("Helvetica")
    x, y = r["x1"] + (wide - sum(widths.get(c, default) for c in text) / 1000 * size) / 2, r["y1"] + (high - size) / 2
    if labels and x > r["x1"] and y > r["y1"]:
        out += f"q 1 1 1 rg BT /InkveilLabel {n(size)} Tf {n(x, y)} Td ".encode() + pdf.serialized(text.encode("cp1252", "replace")) + b" Tj ET Q\n"
    return out


def sanitize(draft: pdf.Draft) -> None:
    """Blank the information dictionary, set its dates to the epoch, and drop the metadata packet."""
    info = draft.trailer.get("Info")
    if isinstance(info, pdf.Ref) and info.number in draft.objects:
        old = draft.objects[info.number]
        draft.objects[info.number] = {k: redact.EPOCH.encode() if k in redact.DATES else b"" if k in redact.BLANKED else v for k, v in old.items()}
    root = draft.trailer["Root"]
    packet = draft.objects[root.number].get("Metadata")
    draft.change(root.number, Metadata=None)
    if isinstance(packet, pdf.Ref):
        draft.objects.pop(packet.number, None)


def redacted(data: bytes, regions: list[dict], labels: bool = True, clean_metadata: bool = True, flatten: bool = True) -> bytes:
    """A document without the text that lies under regions, and with bars over them. Regions on pages that there aren't are skipped.

    A string goes as a whole if any of it lies under a region, or if it begins close to one; of a form that shows such a
    string all text goes, wherever the form is used. flatten drops marks for redactions on the pages touched, as they are done now.
    Metadata are cleaned even without regions.
    """
    file = pdf.Pdf(data)
    draft = pdf.Draft(file)
    for number, (place, page) in enumerate(file.pages(), 1):
        own = [r for r in regions if r["page"] == number]
        if not own:
            continue
        content, seen = file.content(page), pdf.scan_page(file, page)
        hit = [i for i in seen.items if any(_overlap(i, r) for r in own)]
        content = blank_spans(content, [i.span for i in hit if i.span])
        content = blank_regions(content, [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in own])
        for form in {i.form for i in hit if i.form in draft.objects}:
            stream = draft.objects[form]
            draft.objects[form] = pdf.deflated(blank_all(stream.data(file)), **{k: v for k, v in stream.head.items() if k not in ("Filter", "DecodeParms", "Length")})
        resources = dict(file.get(page.get("Resources")) or {})
        fonts = dict(file.get(resources.get("Font")) or {})
        fonts["InkveilLabel"] = {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1"), "BaseFont": pdf.Name("Helvetica"), "Encoding": pdf.Name("WinAnsiEncoding")}
        _replaced(draft, page, place, b"q\n" + content + b"\nQ\n" + b"".join(_bar(r, labels) for r in own), Resources=resources | {"Font": fonts})
        if flatten:
            _without_marks(draft, file, page, place)
    if clean_metadata:
        sanitize(draft)
    return draft.bytes()


def _replaced(draft: pdf.Draft, page: dict, place: int | None, content: bytes, **more) -> None:
    """Give a page new content; streams that no other page uses go away."""
    old = page.get("Contents")
    for ref in old if isinstance(old, list) else [old]:
        others = sum(ref in (c if isinstance(c := p.get("Contents"), list) else [c]) for _, p in draft.file.pages())
        if isinstance(ref, pdf.Ref) and others == 1:
            held = draft.file.get(ref)
            for inner in held if isinstance(held, list) else []:
                if isinstance(inner, pdf.Ref):
                    draft.objects.pop(inner.number, None)
            draft.objects.pop(ref.number, None)
    draft.change(place, Contents=draft.add(pdf.deflated(content)), **more)


def _without_marks(draft: pdf.Draft, file: pdf.Pdf, page: dict, place: int | None) -> list[dict]:
    """Drop a page's redaction marks; those that went."""
    kept, gone = [], []
    for ref in file.get(page.get("Annots")) or []:
        note = file.get(ref)
        (gone if isinstance(note, dict) and note.get("Subtype") == MARK else kept).append(ref)
    if gone:
        draft.change(place, Annots=kept)
        for ref in gone:
            if isinstance(ref, pdf.Ref):
                draft.objects.pop(ref.number, None)
    return [file.get(x) for x in gone]


def _filled(ops: list[tuple[str, list[float]]]) -> Iterator[tuple[int, int, tuple[float, float, float, float]]]:
    """(first, last, corners) of each filled rectangle's path in a page's operations."""
    first, rect = None, None
    for k, (op, args) in enumerate(ops):
        if op in paths.PATH:
            first = k if first is None else first
            rect = args if op == "re" and len(args) >= 4 else rect
        elif op in (*paths.FILLS, *paths.ENDS):
            if op in paths.FILLS and rect:
                x, y, w, h = rect[:4]
                yield first, k, (min(x, x + w), min(y, y + h), max(x, x + w), max(y, y + h))
            first, rect = None, None


def without_overlays(data: bytes) -> tuple[bytes, list[dict]]:
    """A document whose filled rectangles over text are blanked in its content, path and all; and what they hid."""
    file = pdf.Pdf(data)
    draft, found = pdf.Draft(file), []
    for number, (place, page) in enumerate(file.pages(), 1):
        seen, content = pdf.scan_page(file, page), bytearray(file.content(page))
        cut = False
        for first, last, (x1, y1, x2, y2) in _filled(seen.ops):
            if x2 - x1 < AUDIT_BAR[0] or y2 - y1 < AUDIT_BAR[1] or seen.spans[last][0] < 0 or seen.spans[first][0] < 0:
                continue
            under = [i.text for i in seen.items if i.text.strip() and i.x < x2 - INSET and i.x + i.width > x1 + INSET and i.y < y2 - INSET and i.y + (i.height or 10.0) > y1 + INSET]
            if under:
                a, b = seen.spans[first][0], seen.spans[last][1]
                content[a:b], cut = b" " * (b - a), True
                found.append({"scenario": "A", "page": number, "x1": x1, "y1": y1, "x2": x2, "y2": y2, "recovered_text": " ".join(under), "confidence": restore.CONFIDENCE["A"]})
        if cut:
            _replaced(draft, page, place, bytes(content))
    return (draft.bytes() if found else data), found


def without_annotations(data: bytes) -> tuple[bytes, list[dict], int]:
    """A document without marks for redactions; a finding for each page that had some, and how many went."""
    file = pdf.Pdf(data)
    draft, found, count = pdf.Draft(file), [], 0
    for number, (place, page) in enumerate(file.pages(), 1):
        gone = _without_marks(draft, file, page, place)
        if gone:
            count += len(gone)
            box = [float(file.get(x)) for x in file.get(gone[0].get("Rect")) or [0, 0, 0, 0]]
            found.append({"scenario": "B", "page": number, **dict(zip(("x1", "y1", "x2", "y2"), box, strict=True)), "recovered_text": None, "confidence": restore.CONFIDENCE["B"]})
    return (draft.bytes() if found else data), found, count


def prior_revision(data: bytes) -> bytes | None:
    """The bytes up to the first end marker and with it, if there are several."""
    mark = b"%%EOF"
    return data[: data.index(mark) + len(mark)] if data.count(mark) > 1 else None


def annotated(data: bytes, found: list[dict]) -> tuple[bytes, list[dict]]:
    """A document with an outline and a note at each overlay that was found."""
    file = pdf.Pdf(data)
    draft, out, pages = pdf.Draft(file), [], file.pages()
    for number, (place, page) in enumerate(pages, 1):
        own = [f for f in found if f["scenario"] == "A" and f.get("page") == number and f.get("x1") is not None]
        if not own or place is None:
            continue
        notes, drawn = list(file.get(page.get("Annots")) or []), b""
        for f in own:
            text = f'[restore] Recovered text: "{f["recovered_text"]}"' if f.get("recovered_text") else "[restore] Redaction overlay removed - possible hidden content"
            x, y = f["x2"] + restore.NOTE_GAP, (f["y1"] + f["y2"]) / 2
            drawn += b"q 0 0.7 0 RG 1.5 w " + " ".join(map(pdf.number_text, (f["x1"], f["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]))).encode() + b" re S Q\n"
            note = {"Type": pdf.Name("Annot"), "Subtype": pdf.Name("Text"), "Rect": [x, y, x + restore.NOTE_SIZE, y + restore.NOTE_SIZE], "Contents": text.encode("latin-1", "replace"), "Name": pdf.Name("Note"), "C": [0, 0.7, 0], "Open": False}
            notes.append(draft.add(note))
            out.append({**f, "scenario": "D", "confidence": restore.CONFIDENCE["D"]})
        _replaced(draft, page, place, b"q\n" + file.content(page) + b"\nQ\n" + drawn, Annots=notes)
    return (draft.bytes() if out else data), out


def restored(data: bytes) -> dict:
    """Overlays, then marks taken off, notes added; findings, counters, the earlier revision if there is one."""
    work, found = without_overlays(data)
    stripped = len(found)
    work, more, removed = without_annotations(work)
    found = found + more
    prior = prior_revision(data)
    if prior is not None:
        found.append({"scenario": "C", "page": None, "x1": None, "y1": None, "x2": None, "y2": None, "recovered_text": None, "confidence": restore.CONFIDENCE["C"]})
    work, noted = annotated(work, found)
    return {"content": work, "findings": found + noted, "overlays_stripped": stripped, "annotations_removed": removed, "prior_revision_recovered": prior is not None, "prior_revision": prior}


_FOUND = pa.list_(pa.struct([("scenario", pa.string()), ("page", pa.int32()), *[(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")], ("recovered_text", pa.string()), ("confidence", pa.float64())]))


def restore_files(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content (what is left), findings, overlays_stripped, annotations_removed, prior_revision_recovered, prior_revision, error."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("_key"), F.col("content"))
    kinds = (("content", pa.binary()), ("findings", _FOUND), ("overlays_stripped", pa.int32()), ("annotations_removed", pa.int32()), ("prior_revision_recovered", pa.bool_()), ("prior_revision", pa.binary()), ("error", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, files.ROWS):
                part, out = batch.slice(at, files.ROWS), []
                for data in part.column(1):
                    try:
                        out.append(restored(data.as_buffer().to_pybytes()))
                    except Exception as e:  # noqa: BLE001  (one bad document doesn't stop the others)
                        out.append({"error": f"{type(e).__name__}: {e}"[:500]})
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o.get(n) for o in out], t) for n, t in kinds]], names=["_key", *[n for n, _ in kinds]])

    schema = f"_key {dict(rows.dtypes)['_key']}, content binary, findings array<struct<scenario:string,page:int,x1:double,y1:double,x2:double,y2:double,recovered_text:string,confidence:double>>, overlays_stripped int, annotations_removed int, prior_revision_recovered boolean, prior_revision binary, error string"
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)


def redact_files(docs: DataFrame, regions: DataFrame, scanned: DataFrame, key: str = "doc_id", labels: bool = False, clean_metadata: bool = True) -> dict[str, DataFrame]:
    """Files redacted by regions (bottom-left, with region_idx): files (key, content, error, sha256_before, sha256_after), results, warnings and log.

    labels are text that stands over a bar, so verifying finds them there. scanned is files.scan() of the same documents. Save the files before taking the log or the manifests, as each of them reads them.
    """
    pages, items = files.pages(scanned, key), files.text_items(scanned, key)
    regions = redact.on_pages(regions, pages, key)
    fields = ("page", "x1", "y1", "x2", "y2", "color", "label", "exemption_code", "exemption_basis")
    regions = regions.withColumns({c: F.lit(None).cast("array<double>" if c == "color" else "string") for c in fields if c not in regions.columns})
    packed = regions.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("region_idx", *fields))), lambda r: F.struct(*[r[f].alias(f) for f in fields])).cast(REGIONS).alias("regions"))
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # given, so that small bytes aren't put together: rewriting takes longer than they tell
    rows = docs.select(key, "content", F.sha2("content", 256).alias("sha256_before")).repartition(parts, key).join(packed.repartition(parts, key), key, "left")
    done = files.rewritten(rows, lambda data, row: redacted(data, row["regions"] or [], labels, clean_metadata), ["regions"]).drop("regions").withColumn("sha256_after", F.sha2("content", 256))
    return {"files": done, "regions": regions, "results": redact.redaction_summary(docs, regions, key), "warnings": redact.redaction_warnings(pages, regions, items, key), "log": redact.entries(regions, done, key)}


def search_files(docs: DataFrame, patterns: list[Pattern], scanned: DataFrame, key: str = "doc_id", **options) -> dict[str, DataFrame]:
    """redact_files() for what patterns find."""
    pages, items = files.pages(scanned, key), files.text_items(scanned, key)
    found = redact.searched_regions(layout.placed_items(items, key), patterns, pages, key).join(pages.select(key, "page", F.col("height").alias("_high")), [key, "page"], "left")
    return redact_files(docs, layout.normalized(found, F.coalesce("_high", F.lit(0.0))).drop("_high"), scanned, key, **options)


def entity_files(docs: DataFrame, types: list[str] | None, scanned: DataFrame, key: str = "doc_id", codes: dict[str, str] | None = None, **options) -> dict[str, DataFrame]:
    return search_files(docs, entity_patterns(types, codes), scanned, key, **options)


def redact_batch(docs: DataFrame, patterns: list[Pattern], regions: DataFrame, key: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """Patterns first, then regions on what they left. Files (a row a document, with error where it failed), and both results merged.

    Tables of a batch are as many as its documents; nothing is held on the driver.
    """
    first = search_files(docs, patterns, files.scan(docs, key=key, parts=("items",)), key, **options) if patterns else None
    middle = docs if first is None else first["files"].select(key, "content", F.col("error").alias("_error"))
    second = redact_files(middle, regions, files.scan(middle, key=key, parts=("items",)), key, **options)
    done = second["files"] if first is None else second["files"].join(middle.select(key, "_error"), key).withColumn("error", F.coalesce("_error", "error")).drop("_error")
    return done, second["results"] if first is None else redact.merged(first["results"], second["results"], key)


def verify_files(scanned: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """violations, warnings, and results (clean only if the document could be read) of scanned documents."""
    items, pages = files.text_items(scanned, key), files.pages(scanned, key)
    bars = paths.filled_rects(files.page_ops(scanned, key), key, VERIFY_BAR, ends_clear=False)
    found = redact.violations(items, bars, key)
    return {"violations": found, "warnings": redact.verify_warnings(pages, items, bars, key), "results": redact.clean_flags(scanned.select(key, "status"), found, key)}


def font_metrics(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, font, char, advance of the embedded fonts; fonts that can't be read are left to the standard tables."""
    ship(scanned.sparkSession)
    rows = files.fonts(scanned, key).select(F.col(key).alias("_key"), "font", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, name, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    out += [(k, name, c, a) for c, a in sfnt.advances(data).items()]
                except ValueError:
                    continue
            if out:
                kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["_key", "font", "char", "advance"])

    return rows.mapInArrow(run, f"_key {dict(rows.dtypes)['_key']}, font string, char string, advance double").withColumnRenamed("_key", key)


def audit_files(docs: DataFrame, scanned: DataFrame, options: checks.Options = checks.Options(), key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Findings, and a report a document with its hash; only a document that could be read is clean."""
    raw = docs.select(key, files.latin1(F.col("content")).alias("text"))
    rects = paths.filled_rects(files.page_ops(scanned, key), key)
    found = checks.audit(options, items=files.text_items(scanned, key), rects=rects, raw=raw, meta=files.metadata(scanned, key), annotations=files.annotations(scanned, key), metrics=font_metrics(scanned, key) if options.glyph_position else None, key=key)
    about = docs.select(key, F.sha2("content", 256).alias("sha256")).join(scanned.select(key, "status"), key)
    return found, checks.report(about, found, key)
