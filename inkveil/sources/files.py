"""Document files as tables, and tables as document files.

scan() reads each document once, in Arrow batches, and gives one row a document with what was found in it; the functions
below it take that frame and give one table each. A document that can't be read has status "unreadable" and the
reason in error, and rows in no other table: nothing calls it clean. Save the scan (Parquet, or checkpoint()) where
several tables are wanted of many documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import pdf
from inkveil.functions.patterns import INFO_FIELDS
from inkveil.session import as_uri, ship

#: Operators that paint an image, and those of paths that a scan keeps.
PATHS = ("re", "m", "l", "c", "v", "y", "h", "f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n")
#: Documents that a batch of the scan takes at a time.
ROWS = 16

_PAGE = pa.struct([("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("has_image", pa.bool_())])
_ITEM = pa.struct([("page", pa.int32()), ("item_idx", pa.int64()), ("str", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("width", pa.float64()), ("height", pa.float64()), ("font", pa.string()), ("font_size", pa.float64())])
_OP = pa.struct([("page", pa.int32()), ("op_idx", pa.int64()), ("op", pa.string()), ("args", pa.list_(pa.float64()))])
_NOTE = pa.struct([("page", pa.int32()), ("annot_idx", pa.int32()), ("subtype", pa.string()), ("x1", pa.float64()), ("y1", pa.float64()), ("x2", pa.float64()), ("y2", pa.float64())])
_META = pa.struct([("kind", pa.string()), ("field", pa.string()), ("value", pa.string())])
_FONT = pa.struct([("font", pa.string()), ("content", pa.binary())])
_PARTS = {"pages": _PAGE, "items": _ITEM, "ops": _OP, "annotations": _NOTE, "metadata": _META, "fonts": _FONT}
_SQL = (
    "status string, error string, n_pages int, pages array<struct<page:int,width:double,height:double,has_image:boolean>>, "
    "items array<struct<page:int,item_idx:bigint,str:string,x:double,y:double,width:double,height:double,font:string,font_size:double>>, "
    "ops array<struct<page:int,op_idx:bigint,op:string,args:array<double>>>, annotations array<struct<page:int,annot_idx:int,subtype:string,x1:double,y1:double,x2:double,y2:double>>, "
    "metadata array<struct<kind:string,field:string,value:string>>, fonts array<struct<font:string,content:binary>>"
)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """The files below a folder: doc_id (their path), name, n_bytes, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), "content")


def distinct_files(files: DataFrame) -> DataFrame:
    """Of files that share name and size the one with the smallest doc_id."""
    return files.groupBy("name", "n_bytes").agg(F.min(F.struct("doc_id", "content")).alias("f")).select("f.doc_id", "name", "n_bytes", "f.content")


def latin1(content: Column) -> Column:
    """Bytes as a string with one character for each."""
    return F.decode(content, "ISO-8859-1")


def encoded(content: Column) -> Column:
    """Bytes as base64 without line ends, as a response carries them."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


#: The most bytes that an upload may have.
UPLOAD_BYTES = 4 << 20


def upload_status(n_bytes: Column, content: Column) -> Column:
    """200 for an upload that is taken, 413 for one that is too large, 415 for one that is no PDF."""
    return F.when(n_bytes > UPLOAD_BYTES, 413).when(F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False)), 200).otherwise(415)


def write_zips(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write contents to archives in folder (a URI that all executors reach), one for each partition: archive, n_files, n_bytes. Rows without content are left out."""
    ship(df.sparkSession)
    folder = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zipfile

        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        own, n, size = f"{root}/.{uuid.uuid4().hex}", 0, 0
        with files.open_output_stream(own) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if data.is_valid:
                        archive.writestr(file, data.as_buffer().to_pybytes())
                        n, size = n + 1, size + len(data.as_buffer())
        final = f"part-{TaskContext.get().partitionId():05d}.zip"
        if not n:
            files.delete_file(own)
            return
        files.move(own, f"{root}/{final}")
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "n_files", "n_bytes"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "archive string, n_files long, n_bytes long")


def embedded_fonts(file: pdf.Pdf) -> dict[str, bytes]:
    """Names and bytes of the fonts that the pages use and the file holds; the first of a name counts."""
    out: dict[str, bytes] = {}
    for _, page in file.pages():
        fonts = (file.get(page.get("Resources")) or {}).get("Font")
        for head in map(file.get, (file.get(fonts) or {}).values()):
            if not isinstance(head, dict):
                continue
            inner = file.get((file.get(head.get("DescendantFonts")) or [None])[0]) or head
            about = file.get(inner.get("FontDescriptor")) or {}
            stream = next((s for k in ("FontFile2", "FontFile3", "FontFile") if isinstance(s := file.get(about.get(k)), pdf.Stream)), None)
            if stream is not None:
                out.setdefault(str(file.get(head.get("BaseFont"))), stream.data(file))
    return out


def _read(content: bytes, wanted: frozenset[str]) -> dict:
    """What one document holds."""
    file = pdf.Pdf(content)
    pages = file.pages()
    out: dict = {k: [] for k in _PARTS} | {"n_pages": len(pages)}
    for number, (_, page) in enumerate(pages, 1):
        width, height = file.size(page)
        seen = pdf.scan_page(file, page) if wanted & {"pages", "items", "ops"} else pdf.Scan()
        out["pages"].append({"page": number, "width": width, "height": height, "has_image": seen.has_image})
        if "items" in wanted:
            out["items"] += [{"page": number, "item_idx": k, "str": i.text, "x": i.x, "y": i.y, "width": i.width, "height": i.height, "font": i.font, "font_size": i.size} for k, i in enumerate(seen.items)]
        if "ops" in wanted:
            out["ops"] += [{"page": number, "op_idx": k, "op": op, "args": args} for k, (op, args) in enumerate(seen.ops) if op in PATHS]
        if "annotations" in wanted:
            for k, note in enumerate(file.annotations(page)):
                box = [float(file.get(x)) for x in file.get(note.get("Rect")) or [0, 0, 0, 0]]
                subtype = file.get(note.get("Subtype"))
                out["annotations"].append({"page": number, "annot_idx": k, "subtype": None if subtype is None else str(subtype)} | dict(zip(("x1", "y1", "x2", "y2"), box, strict=False)))
    if "metadata" in wanted:
        info = file.info()
        out["metadata"] = [{"kind": "info", "field": f, "value": info[f]} for f in INFO_FIELDS if f in info] + [{"kind": "xmp", "field": f, "value": v} for f, v in file.xmp()]
    if "fonts" in wanted:
        out["fonts"] = [{"font": k, "content": v} for k, v in embedded_fonts(file).items()]
    return out


def scan(docs: DataFrame, content: str = "content", key: str = "doc_id", parts: tuple[str, ...] = tuple(_PARTS)) -> DataFrame:
    """One row a document: key, status (ok or unreadable), error, n_pages, and arrays of its parts.

    Null contents are unreadable. Only the parts named are looked for; pages always are. Items that are blank are kept
    here; text_items() leaves them out.
    """
    ship(docs.sparkSession)
    rows, wanted = docs.select(F.col(key).alias("_key"), F.col(content).alias("_content")), frozenset((*parts, "pages"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, found = batch.slice(at, ROWS), []
                for data in part.column(1):
                    try:
                        if not data.is_valid:
                            raise pdf.PdfError("no content")
                        found.append(_read(data.as_buffer().to_pybytes(), wanted) | {"status": "ok"})
                    except Exception as e:  # noqa: BLE001  (a document may be broken in any way; it becomes an error row)
                        found.append({k: [] for k in _PARTS} | {"status": "unreadable", "error": f"{type(e).__name__}: {e}"[:500]})
                columns = [pa.array([f.get(n) for f in found], t) for n, t in (("status", pa.string()), ("error", pa.string()), ("n_pages", pa.int32()), *((k, pa.list_(t)) for k, t in _PARTS.items()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["_key", "status", "error", "n_pages", *_PARTS])

    return rows.mapInArrow(run, f"_key {kind}, {_SQL}").withColumnRenamed("_key", key)


def _table(scanned: DataFrame, part: str, key: str) -> DataFrame:
    return scanned.filter("status = 'ok'").select(key, F.explode(part).alias("_")).select(key, "_.*")


def unreadable(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return scanned.filter("status <> 'ok'").select(key, "error")


def text_items(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The items that hold more than white space."""
    from inkveil.functions.patterns import java

    return _table(scanned, "items", key).filter(F.length(F.regexp_replace("str", java("[{s}]+"), "")) > 0)


def pages(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table(scanned, "pages", key)


def page_ops(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table(scanned, "ops", key)


def annotations(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table(scanned, "annotations", key)


def metadata(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table(scanned, "metadata", key)


def fonts(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    return _table(scanned, "fonts", key)


def page_texts(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each page's items in the order in which they are shown, joined by spaces: key, page, text."""
    parts = F.array_sort(F.collect_list(F.struct("item_idx", "str")))
    return items.groupBy(key, "page").agg(F.array_join(F.transform(parts, lambda s: s["str"]), " ").alias("text"))


def regions_from_json(spark: SparkSession, source: str) -> DataFrame:
    """Regions (top-left) of a JSON array, given inline or as a path: page, x, y, width, height, color, label, exemption_code, exemption_basis."""
    fields = "page int, x double, y double, width double, height double, color array<double>, label string, exemptionCode string, exemptionBasis string"
    text = source if source.lstrip().startswith(("[", "{")) else spark.read.text(source, wholetext=True).first()[0]
    if not text.strip().startswith("["):
        raise ValueError("regions must be a JSON array")
    rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(text), f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")).alias("region_idx", "r"))
    return rows.select("region_idx", "r.*").withColumnsRenamed({"exemptionCode": "exemption_code", "exemptionBasis": "exemption_basis"})


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's content to a file in folder (a URI that all executors reach): name, n_bytes of what was written.

    A file is written under another name first and then renamed, so a second attempt at a task leaves whole files.
    """
    ship(df.sparkSession)
    folder = as_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow.fs import FileSystem

        files, root = FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if "/" in file or file in ("", ".", ".."):
                    raise ValueError(f"not a file name: {file!r}")
                own = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(own) as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                files.move(own, f"{root}/{file}")
                sizes.append(len(data.as_buffer()) if data.is_valid else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["name", "n_bytes"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(content).alias("content")).mapInArrow(run, "name string, n_bytes long")


def rewritten(docs: DataFrame, change: Callable[[bytes, dict], bytes], columns: list[str], content: str = "content") -> DataFrame:
    """docs with content changed by a function of its bytes and the row's other named columns, and error (null where it worked).

    A row whose content can't be changed has a null content and the reason in error; the others go on.
    """
    ship(docs.sparkSession)
    docs = docs.drop("error")
    names = docs.columns
    where = names.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, out, errors = batch.slice(at, ROWS), [], []
                given = part.select([c for c in columns if c in names]).to_pylist()
                for data, row in zip(part.column(where), given, strict=True):
                    try:
                        if not data.is_valid:
                            raise pdf.PdfError("no content")
                        out.append(change(data.as_buffer().to_pybytes(), row))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001  (one bad document doesn't stop the others)
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}"[:500])
                arrays = [pa.array(out, pa.binary()) if k == where else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(errors, pa.string())], names=[*names, "error"])

    return docs.mapInArrow(run, docs.limit(0).withColumn("error", F.lit(None).cast("string")).schema)
