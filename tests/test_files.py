"""Document files: reading, redaction, verification, audit, recovery, and the command line."""

import json
import struct

import pytest

from inkveil.__main__ import main
from inkveil.functions import pdf, sfnt
from inkveil.functions.content_stream import decimal, is_operator, numbers_before
from inkveil.operators import audit, documents, paths
from inkveil.sources import files

EMPTY = pdf.made([b""])
TEXT = pdf.made([pdf.shown_text("Redact this text", 100, 400)])
SSN = pdf.made([pdf.shown_text("SSN: 123-45-6789", 72, 700)])
SCANNED = pdf.made([b""], images=(0,))
BAR = pdf.made([b"0 0 0 rg 100 350 200 20 re f"])
IMAGE_BAR = pdf.made([b"100 350 200 20 re f"], images=(0,))
FAKE = pdf.made([pdf.shown_text("SSN 123-45-6789", 72, 700, 14) + b"\n0 g 68 696 200 22 re f"], info={"Title": "Case file", "Author": "a.b@example.org", "Subject": " "})
INVALID = bytes(range(10))
MARK = {"Type": pdf.Name("Annot"), "Subtype": pdf.Name("Redact"), "Rect": [70, 695, 200, 715]}
MARKED = pdf.made([pdf.shown_text("under a mark", 72, 700)], annotations={0: [MARK, {"Type": pdf.Name("Annot"), "Subtype": pdf.Name("Text"), "Rect": [0, 0, 9, 9]}, MARK]})


def frame(spark, **contents):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in contents.items()], "doc_id string, content binary")


def texts(data):
    file = pdf.Pdf(data)
    return [[i.text for i in pdf.scan_page(file, page).items] for _, page in file.pages()]


def test_objects_round_trip():
    value = {"A": [1, -2.5, True, None, b"a(b)\\c\r", pdf.Name("x y"), pdf.Ref(3)], "B": {"C": b"\x00\xff"}}
    assert pdf.Lexer(pdf.serialized(value)).value() == value
    for text, want in ((b"(a\\(b\\)\\101\\n)", b"a(b)A\n"), (b"<48 65 6>", b"He`"), (b"/A#20B", "A B"), (b"[1 0 R 2]", [pdf.Ref(1), 2]), (b"% note\n .5", 0.5), (b"(a(b)c)", b"a(b)c")):
        assert pdf.Lexer(text).value() == want
    assert [pdf.number_text(x) for x in (3, 3.0, -0.25, 1 / 3, 1e-9)] == ["3", "3", "-0.25", "0.3333", "0"]
    assert pdf.encoded_operation("Tj", [b"a)b"]) == "(a\\)b) Tj" and pdf.encoded_operation("re", [1, 2.5, 3, 4]) == "1 2.5 3 4 re"


def test_numbers_in_streams():
    assert decimal(b"x -12.5 y", 2) == (-12.5, 7) and decimal(b"abc", 0) is None
    assert numbers_before(b"(s) 1 2 3.5 Td", 11, 2) == [2.0, 3.5] and numbers_before(b"1 (s) 2", 7, 2) is None
    assert is_operator(b"Td ", 0, b"Td") and not is_operator(b"Tdx", 0, b"Td") and is_operator(b"Td", 0, b"Td")


def test_items_and_places():
    file = pdf.Pdf(TEXT)
    [item] = pdf.scan_page(file, file.pages()[0][1]).items
    assert (item.text, item.x, item.y, item.height, item.font) == ("Redact this text", 100, 400, 12, "Helvetica")
    units = 722 + 556 + 556 + 556 + 500 + 278 + 278 + 278 + 556 + 222 + 500 + 278 + 278 + 556 + 500 + 278
    assert abs(item.width - units * 12 / 1000) < 1e-9
    moved = pdf.made([b"q 2 0 0 2 10 20 cm BT /F2 10 Tf 1 0 0 1 5 6 Tm 14 TL [(ab) -500 (c)] TJ T* (d) ' ET Q 1 0 0 1 3 4 cm 1 2 3 4 re f"])
    seen = pdf.scan_page(pdf.Pdf(moved), pdf.Pdf(moved).pages()[0][1])
    assert [(i.text, i.x, i.y, i.width, i.height) for i in seen.items] == [("abc", 20, 32, 46, 20), ("d", 20, 32 - 56, 12, 20)]
    assert ("re", [4.0, 6.0, 3.0, 4.0]) in seen.ops


def incremental(data):
    """The same document with a second revision, in which page content 11 is another."""
    add = b"11 0 obj\n" + pdf.serialized(pdf.Stream({}, pdf.shown_text("second", 72, 700))) + b"\nendobj\n"
    at = len(data)
    head = pdf.serialized({"Root": pdf.Ref(1), "Size": 20, "Prev": int(data.split(b"startxref\n")[-1].split(b"\n")[0])})
    return data + add + b"xref\n11 1\n%010d 00000 n \ntrailer\n" % at + head + b"\nstartxref\n%d\n%%%%EOF\n" % (at + len(add))


def packed(data):
    """The same document with its objects in a compressed stream and a compressed cross reference, predicted rows and all."""
    import zlib

    file = pdf.Pdf(data)
    inner = [n for n in file.numbers() if not isinstance(file.get(pdf.Ref(n)), pdf.Stream)]
    bodies, places, at = [], [], 0
    for n in inner:
        body = pdf.serialized(file.get(pdf.Ref(n)))
        places += [n, at]
        bodies.append(body)
        at += len(body) + 1
    first = " ".join(map(str, places)).encode() + b" "
    out, index = bytearray(b"%PDF-1.5\n"), {}
    streams = {n: file.get(pdf.Ref(n)) for n in file.numbers() if n not in inner} | {50: pdf.deflated(first + b"\n".join(bodies), Type=pdf.Name("ObjStm"), N=len(inner), First=len(first))}
    for n, s in streams.items():
        index[n] = (1, len(out), 0)
        out += b"%d 0 obj\n" % n + pdf.serialized(s) + b"\nendobj\n"
    index |= {n: (2, 50, k) for k, n in enumerate(inner)}
    index[51] = (1, len(out), 0)
    rows = [struct.pack(">BHB", *index.get(n, (0, 0, 0))) for n in range(52)]
    up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(r, before)) for r, before in zip(rows, [b"\0" * 4, *rows]))
    head = {"Type": pdf.Name("XRef"), "W": [1, 2, 1], "Size": 52, "Root": pdf.Ref(1), "Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 4}}
    begin = len(out)
    return bytes(out + b"51 0 obj\n" + pdf.serialized(pdf.Stream(head, zlib.compress(up))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % begin)


def test_revisions_and_packed_objects():
    assert texts(incremental(TEXT)) == [["second"]] and texts(packed(TEXT)) == [["Redact this text"]]
    assert texts(TEXT.replace(b"startxref\n", b"startxref\n9")) == [["Redact this text"]]  # a reference that points elsewhere
    for bad in (INVALID, b"", b"%PDF-1.4 nothing", TEXT.replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt 3 0 R")):
        with pytest.raises(pdf.PdfError):
            pdf.Pdf(bad)


def test_scan_tables(spark):
    scanned = files.scan(frame(spark, empty=EMPTY, text=TEXT, image=SCANNED, fake=FAKE, bad=INVALID, none=None, marked=MARKED)).persist()
    assert {r.doc_id: r.status for r in scanned.collect()} == {"empty": "ok", "text": "ok", "image": "ok", "fake": "ok", "bad": "unreadable", "none": "unreadable", "marked": "ok"}
    assert {r.doc_id: r.has_image for r in files.pages(scanned).collect()} == {"empty": False, "text": False, "image": True, "fake": False, "marked": False}
    assert sorted(r.str for r in files.text_items(scanned).collect()) == ["Redact this text", "SSN 123-45-6789", "under a mark"]
    assert sorted((r.field, r.value) for r in files.metadata(scanned).collect()) == [("Author", "a.b@example.org"), ("Subject", " "), ("Title", "Case file")]
    assert [r.subtype for r in files.annotations(scanned).orderBy("annot_idx").collect()] == ["Redact", "Text", "Redact"]
    assert [(r.x1, r.y1, r.x2, r.y2) for r in paths.filled_rects(files.page_ops(scanned)).collect()] == [(68.0, 696.0, 268.0, 718.0)]
    assert {r.doc_id for r in files.unreadable(scanned).collect()} == {"bad", "none"}
    assert [r.text for r in files.page_texts(files.text_items(scanned)).filter("doc_id = 'text'").collect()] == ["Redact this text"]
    assert files.scan(frame(spark, a=EMPTY).limit(0)).count() == 0


def test_rectangle_rules(spark):
    rows = [(1, 1, k, op, args) for k, (op, args) in enumerate([("re", [0.0, 0.0, 9.0, 9.0]), ("S", []), ("f", []), ("re", [9.0, 9.0, -4.0, -6.0]), ("m", [1.0, 1.0]), ("f*", []), ("f", []), ("re", [0.0, 0.0, 1.0, 1.0]), ("B", [])])]
    ops = spark.createDataFrame(rows, "doc_id long, page int, op_idx long, op string, args array<double>")
    box = lambda df: sorted((r.rect_idx, r.first_op, r.x1, r.y1, r.x2, r.y2) for r in df.collect())
    assert box(paths.filled_rects(ops)) == [(5, 3, 5.0, 3.0, 9.0, 9.0), (8, 7, 0.0, 0.0, 1.0, 1.0)]
    assert box(paths.filled_rects(ops, least=(4.0, 2.0), ends_clear=False)) == [(2, 0, 0.0, 0.0, 9.0, 9.0), (5, 3, 5.0, 3.0, 9.0, 9.0)]


def test_redaction_takes_the_text_away(spark):
    docs = frame(spark, ssn=SSN, text=TEXT, bad=INVALID, form=packed(SSN))
    found = documents.entity_files(docs, ["ssn"], files.scan(docs))
    done = {r.doc_id: r for r in found["files"].collect()}
    assert done["bad"].content is None and "PdfError" in done["bad"].error
    for k in ("ssn", "form"):
        out = bytes(done[k].content)
        assert b"123-45-6789" not in out and not any("123" in t for page in texts(out) for t in page) and done[k].error is None
    assert texts(bytes(done["text"].content)) == [["Redact this text"]]
    assert {r.doc_id: r.redacted_count for r in found["results"].collect()} == {"ssn": 1, "form": 1, "text": 0, "bad": 0}
    checked = documents.verify_files(files.scan(found["files"].select("doc_id", "content")))
    clean = {r.doc_id: r.clean for r in checked["results"].collect()}
    assert clean == {"ssn": True, "form": True, "text": True, "bad": False}  # what can't be read isn't clean
    log = found["log"].collect()
    assert len(log) == 2 and all(r.basis_code == "(b)(6)" and r.basis_text == "Personal privacy" and len(r.sha256_after) == 64 and r.sha256_before != r.sha256_after for r in log)


def test_redaction_inside_forms_and_metadata():
    form = pdf.Stream({"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Form"), "BBox": [0, 0, 612, 792]}, pdf.shown_text("hidden in a form", 72, 500))
    draft = pdf.Draft(pdf.Pdf(FAKE))
    ref = draft.add(form)
    page = draft.file.pages()[0][0]
    draft.change(page, Resources=draft.objects[page]["Resources"] | {"XObject": {"Fm": ref}}, Contents=draft.add(pdf.Stream({}, b"/Fm Do " + pdf.shown_text("kept", 72, 100))))
    data = draft.bytes()
    assert texts(data) == [["hidden in a form", "kept"]]
    out = documents.redacted(data, [{"page": 1, "x1": 80, "y1": 498, "x2": 90, "y2": 510, "label": "x"}, {"page": 9, "x1": 0, "y1": 0, "x2": 1, "y2": 1}])
    assert [t.strip() for t in texts(out)[0]] == ["", "kept", "x"] and b"hidden" not in out
    assert pdf.Pdf(out).info() == {"Title": "", "Author": "", "Subject": ""}
    assert pdf.Pdf(documents.redacted(FAKE, [])).info()["Author"] == ""  # metadata go without regions too


def test_labels_fit():
    big, small = ({"page": 1, "x1": 50, "y1": 500, "x2": x, "y2": 520, "exemption_code": "(b)(6)", "label": "SSN"} for x in (250, 60))
    assert texts(documents.redacted(EMPTY, [big])) == [["(b)(6)"]] and texts(documents.redacted(EMPTY, [small])) == [[]]
    assert texts(documents.redacted(EMPTY, [big], labels=False)) == [[]]
    assert texts(documents.redacted(EMPTY, [big | {"exemption_code": None, "label": None}])) == [["REDACTED"]]


def test_verify(spark):
    docs = frame(spark, empty=EMPTY, bar=BAR, fake=FAKE, image=SCANNED, both=IMAGE_BAR)
    found = documents.verify_files(files.scan(docs))
    assert {r.doc_id: r.clean for r in found["results"].collect()} == {"empty": True, "bar": True, "fake": False, "image": True, "both": True}
    assert sorted((r.doc_id, r.type) for r in found["warnings"].collect()) == [("both", "scanned-page"), ("image", "scanned-page")]
    assert [r.recovered_text for r in found["violations"].collect()] == ["SSN 123-45-6789"]


def test_audit_and_restore(spark):
    twice = incremental(FAKE)
    docs = frame(spark, fake=FAKE, empty=EMPTY, marked=MARKED, twice=twice, bad=INVALID)
    found, report = documents.audit_files(docs, files.scan(docs), audit.preset("forensic"))
    kinds = {(r.doc_id, r.check, r.severity) for r in found.collect()}
    assert {("fake", "text-under-box", "CRITICAL"), ("fake", "metadata-leak", "INFO"), ("fake", "metadata-leak", "MEDIUM"), ("marked", "pending-annotation", "CRITICAL"), ("twice", "incremental-save", "HIGH")} <= kinds
    assert {r.doc_id: r.clean for r in report.collect()} == {"fake": False, "empty": True, "marked": False, "twice": False, "bad": False}
    assert audit.preset("no such") == audit.preset("quick")
    out = {r.doc_id: r for r in documents.restore_files(docs).collect()}
    assert out["bad"].error and out["empty"].findings == []
    fake = out["fake"]
    assert (fake.overlays_stripped, [f.scenario for f in fake.findings], fake.findings[0].recovered_text) == (1, ["A", "D"], "SSN 123-45-6789")
    left = files.scan(frame(spark, x=bytes(fake.content)))
    assert [r.str for r in files.text_items(left).collect()] == ["SSN 123-45-6789"] and documents.verify_files(left)["results"].first().clean
    assert [r.subtype for r in files.annotations(left).collect()] == ["Text"]
    assert (out["marked"].annotations_removed, [f.scenario for f in out["marked"].findings]) == (2, ["B"])
    assert out["twice"].prior_revision_recovered and texts(bytes(out["twice"].prior_revision)) == texts(FAKE)


def test_batch(spark):
    three = pdf.made([pdf.shown_text(f"mail a{k}@b.org here", 72, 700) for k in range(3)])
    docs = frame(spark, three=three, bad=INVALID, ssn=SSN)
    from inkveil.functions.patterns import entity_patterns

    regions = spark.createDataFrame([("three", 0, 3, 60.0, 690.0, 300.0, 720.0), ("three", 1, 5, 0.0, 0.0, 9.0, 9.0), ("ssn", 0, 1, 70.0, 695.0, 200.0, 715.0)], "doc_id string, region_idx int, page int, x1 double, y1 double, x2 double, y2 double")
    done, results = documents.redact_batch(docs, entity_patterns(["email"]), regions)
    rows = {r.doc_id: r for r in done.collect()}
    assert rows["bad"].error and rows["three"].error is None
    assert {r.doc_id: (r.redacted_count, r.pages_affected) for r in results.collect()} == {"three": (4, [1, 2, 3]), "ssn": (1, [1]), "bad": (0, [])}


def font_file():
    """A font of two characters: A is 700 of 1000 units wide, B 350."""
    tables = {
        b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 34, b"hhea": b"\0" * 34 + struct.pack(">H", 3), b"hmtx": struct.pack(">HhHhHh", 500, 0, 700, 0, 350, 0),
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 4, 1, 0) + struct.pack(">HHHHHhhHH", 66, 0xFFFF, 0, 65, 0xFFFF, -64, 1, 0, 0),
    }
    out, at = bytearray(struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0)), 12 + 16 * len(tables)
    for name, body in tables.items():
        out += name + struct.pack(">III", 0, at, len(body))
        at += len(body)
    return bytes(out + b"".join(tables.values()))


def test_embedded_fonts(spark):
    assert sfnt.advances(font_file()) == {"A": 700.0, "B": 350.0}
    with pytest.raises(ValueError, match="not a font"):
        sfnt.advances(b"nothing")
    draft = pdf.Draft(pdf.Pdf(pdf.made([pdf.shown_text("ABAB", 10, 10, 10, "F9")])))
    about = draft.add({"Type": pdf.Name("FontDescriptor"), "FontFile2": draft.add(pdf.deflated(font_file()))})
    page = draft.file.pages()[0][0]
    own = {"Type": pdf.Name("Font"), "Subtype": pdf.Name("TrueType"), "BaseFont": pdf.Name("Own"), "FontDescriptor": about, "FirstChar": 65, "Widths": [700, 350]}
    draft.change(page, Resources={"Font": {"F9": draft.add(own)}})
    scanned = files.scan(frame(spark, x=draft.bytes()))
    metrics = documents.font_metrics(scanned)
    assert {(r.font, r.char, r.advance) for r in metrics.collect()} == {("Own", "A", 700.0), ("Own", "B", 350.0)}
    items = files.text_items(scanned)
    assert audit.check_glyph_position(items, metrics).count() == 0  # by its own widths the string is as it should be
    assert [r.severity for r in audit.check_glyph_position(items).collect()] == ["HIGH"] or audit.check_glyph_position(items).count() == 1


def test_regions_from_json(spark, tmp_path):
    text = '[{"page": 1, "x": 1, "y": 2, "width": 3, "height": 4, "exemptionCode": "(b)(6)"}, {"page": 2, "x": 0, "y": 0, "width": 1, "height": 1}]'
    (tmp_path / "r.json").write_text(text)
    for source in (text, str(tmp_path / "r.json")):
        assert [(r.region_idx, r.page, r.x, r.exemption_code) for r in files.regions_from_json(spark, source).collect()] == [(0, 1, 1.0, "(b)(6)"), (1, 2, 0.0, None)]
    with pytest.raises(ValueError, match="array"):
        files.regions_from_json(spark, "{}")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for name, data in (("ssn.pdf", SSN), ("fake.pdf", FAKE)):
        (tmp_path / "in" / name).write_bytes(data)
    run = lambda *a: main([a[0], str(tmp_path / "in"), "--json", *a[1:]], spark)
    lines = lambda: {x["name"]: x for x in map(json.loads, capsys.readouterr().out.strip().splitlines())}
    assert run("verify") == 1 and {k: v["clean"] for k, v in lines().items()} == {"ssn.pdf": True, "fake.pdf": False}
    assert run("audit") == 1 and lines()["fake.pdf"]["n_findings"] >= 4
    assert run("entities", "--types", "ssn", "--output", str(tmp_path / "out"), "--manifest") == 0
    assert {k: v["redacted_count"] for k, v in lines().items()} == {"ssn.pdf": 1, "fake.pdf": 1}
    assert texts((tmp_path / "out" / "ssn.pdf").read_bytes()) == [["                ", "(b)(6)"]]
    log = json.loads((tmp_path / "out" / "ssn.manifest.json").read_text())
    assert len(log["entries"]) == 1 and log["sha256_input"] != log["sha256_output"]
    assert run("search", "--pattern", "/ssn:?/i", "--output", str(tmp_path / "s")) == 0
    assert run("redact", "--regions", '[{"page":1,"x":70,"y":70,"width":200,"height":30}]', "--output", str(tmp_path / "r")) == 0
    assert run("strip", "--output", str(tmp_path / "t")) == 0
    capsys.readouterr()
    assert main(["verify", str(tmp_path / "t")], spark) == 0


def test_requests(spark):
    from inkveil.operators import annotations, detect, routes

    docs = frame(spark, ssn=SSN, image=SCANNED, bad=INVALID)
    scanned = files.scan(docs).persist()
    model = lambda text: [("person", "Ann Lee"), ("person", "x")] if "SSN" in text else 1 / 0
    outside = detect.supplied(annotations.model_entities(files.page_texts(files.text_items(scanned)), model))
    found, about = routes.detected(scanned, supplied=outside)
    assert sorted((r.doc_id, r.type, r["count"], r.tier) for r in found.collect()) == [("ssn", "person", 1, "ai"), ("ssn", "ssn", 1, "regex")]
    assert {r.doc_id: (r.status, r.total, r.scanned) for r in about.collect()} == {"ssn": ("ok", 2, True), "image": ("ok", 0, True), "bad": ("unreadable", 0, True)}
    out = routes.redacted(docs, scanned, json.dumps({"groups": [{"values": ["123-45-6789", " "], "code": "(b)(6)"}], "strings": ["SSN"]}))
    rows = {r.doc_id: r for r in out["response"].collect()}
    assert rows["ssn"].verified and rows["ssn"].redacted_count == 2 and not rows["bad"].verified and rows["bad"].error
    import base64

    assert texts(base64.b64decode(rows["ssn"].encoded)) == [["                "]]
    assert {r.doc_id: r.clean for r in routes.audited(docs, scanned, True)[1].collect()} == {"ssn": True, "image": True, "bad": False}


def test_sinks_and_uploads(spark, tmp_path):
    import zipfile

    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a.txt", bytearray(b"one"), 3), ("b.txt", bytearray(b"%PDF-1"), 5 << 20), ("c.txt", bytearray(b"%PDF-1"), 6), ("d.txt", None, 0)], "name string, content binary, n long")
    assert sorted((r.name, r.s) for r in rows.select("name", files.upload_status(F.col("n"), F.col("content")).alias("s")).collect()) == [("a.txt", 415), ("b.txt", 413), ("c.txt", 200), ("d.txt", 415)]
    assert sum(r.n_files for r in files.write_zips(rows.repartition(2), str(tmp_path / "z")).collect()) == 3
    held = {n: z.read(n) for p in (tmp_path / "z").glob("*.zip") for z in [zipfile.ZipFile(p)] for n in z.namelist()}
    assert held == {"a.txt": b"one", "b.txt": b"%PDF-1", "c.txt": b"%PDF-1"}
    assert files.write_files(rows, str(tmp_path / "w")).count() == 4 and (tmp_path / "w" / "a.txt").read_bytes() == b"one"
    (tmp_path / "p").mkdir()
    for n in ("x.pdf", "y.pdf"):
        (tmp_path / "p" / n).write_bytes(EMPTY)
    assert sorted((r.name, r.n_bytes) for r in files.read_files(spark, str(tmp_path / "p")).collect()) == [("x.pdf", len(EMPTY)), ("y.pdf", len(EMPTY))]


def test_papers_are_dealt_to_all_tasks(spark, tmp_path):
    from inkveil.plans import papers

    rows = spark.range(3 * papers.DEALT * 4).selectExpr("id AS c_custkey", "'n' AS c_name", "1.5D AS c_acctbal", "'s' AS c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))  # one file of one row group, as the driver's
    made = papers.papers(spark, str(tmp_path))
    sizes = [n for n in made.select("doc_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == rows.count() and len(sizes) == 12 and max(sizes) <= papers.DEALT * 1.1


def test_reading_of_odd_tokens():
    """Blanks, comments and cross references, read by patterns, are what they were read byte for byte."""
    for text, want in ((b"%a\n%b\r\n\0 /A", "A"), (b"%all", None), (b"+7", 7), (b"-.5", -0.5), (b"nan", pdf.Keyword("nan")), (b"(a\\\r\nb\\(\\8)", b"ab(8"), (b"((", b"("), (b"/A#2fB#", "A/B#"), (b"[true null]", [True, None])):
        assert pdf.Lexer(text).value() == want
    for name in ("plain", "a b", "a#b", "a/b", "\xe9", ""):
        raw = pdf.serialized(pdf.Name(name))
        assert pdf.Lexer(raw).value() == name and not set(raw[1:]) & set(b"()<>[]{}/% ")
    loose = SSN.replace(b" 00000 n \n", b" 00000 n%c\n")
    assert texts(loose) == texts(SSN)


def test_redacting_is_dealt_to_all_tasks(spark):
    docs = spark.range(200).selectExpr("CAST(id AS STRING) AS doc_id").crossJoin(frame(spark, a=SSN).select("content")).coalesce(1)
    done = documents.entity_files(docs, ["ssn"], files.scan(docs, parts=("items",)))
    sizes = [n for n in done["files"].select("doc_id").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 200 and len(sizes) >= 4 and max(sizes) < 100
