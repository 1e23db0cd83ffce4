"""Business files as labelled records.

Files are read as binaries by Spark and parsed by an Arrow map, one file at a
time; every format yields records (label, value, location, record_scope) and
chunks of text, or a reason why it was not indexed. Formats are told by their
first bytes, so a misleading extension is parsed as what it is and reported.
"""

from __future__ import annotations

import csv
import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import Decimal
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import column_name

# The extensions that are discovered.
EXTENSIONS = ["txt", "md", "csv", "xlsx", "xls", "docx", "doc", "pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp", "heic"]
IMAGES = {"png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp", "heic"}
CHUNK_BYTES, LABEL_BYTES, HEADER_ROWS = 1400, 120, 25  # fixed values
BATCH_CHARS = 1 << 22  # of chunks that leave Python together
NO_LABEL = r"\d{1,2}|https?"  # of a time or an address
LINE = r"^\s*[-*#>]*\s*(?:\*\*)?([^:\n]{1,120}?)(?:\*\*)?\s*:\s*(?:\*\*)?\s*(.+?)\s*$"
PARSED = "path string, extension string, parser string, content_hash string, size_bytes long, ocr_status string, mismatch string, reason string, warnings array<string>, records array<struct<label:string,value:string,location:string,record_scope:string>>, chunks array<struct<ordinal:int,location:string,content:string>>"


@dataclass
class Parsed:
    parser: str
    text: str = ""
    records: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    ocr_status: str = "not_required"

    def add(self, label: str, value: str, location: str, scope: str | None = None) -> None:
        if label.strip() and value.strip():
            self.records.append({"label": label.strip(), "value": value.strip(), "location": location, "record_scope": scope})


class Unreadable(Exception):
    """The file cannot be indexed; the message is the reason."""


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime and content of all files of known extensions below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(EXTENSIONS))


def sniff(data: bytes) -> str | None:
    """Format by the first bytes."""
    head = data[:4096]
    if b"%PDF-" in head[:1024]:
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        names = set()
        try:
            names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            pass
        return "docx" if any(n.startswith("word/") for n in names) else "xlsx" if any(n.startswith("xl/") for n in names) else "zip"
    for magic, kind in ((b"\xd0\xcf\x11\xe0", "ole"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpg")):
        if head.startswith(magic):
            return kind
    return None


def label_lines(chunks: DataFrame) -> DataFrame:
    """(document_id, label, value) of `label: value` lines; the same rule as for text files."""
    lines = chunks.select("document_id", F.explode(F.split("content", "\n")).alias("line"))
    found = lines.select("document_id", F.trim(F.regexp_extract("line", LINE, 1)).alias("label"), F.trim(F.regexp_extract("line", LINE, 2)).alias("value"))
    return found.where((F.col("label") != "") & (F.octet_length("label") <= LABEL_BYTES) & ~F.col("label").rlike(f"^(?:{NO_LABEL})$"))


def parse_text(data: bytes, parser: str = "text") -> Parsed:
    out = Parsed(parser, data.decode("utf-8-sig", "replace"))
    for i, line in enumerate(out.text.splitlines(), 1):
        m = re.match(LINE, line)
        if m and len(m[1].encode()) <= LABEL_BYTES and not re.fullmatch(NO_LABEL, m[1]):
            out.add(m[1], m[2], f"línea {i}")
    return out


def tabular(out: Parsed, rows: list[list[str]], place: str) -> None:
    """Header is the fullest of the first rows; two-cell rows before it are cover pairs; each later row is a record."""
    filled = [sum(bool(c.strip()) for c in r) for r in rows]
    if not rows or not max(filled):
        return
    if max(filled) <= 2 and all(n in (0, 2) for n in filled) and len([n for n in filled if n]) > 1 and ":" not in place:
        for i, row in enumerate(rows, 1):  # a cover sheet: only label and value
            cells = [c for c in row if c.strip()]
            if len(cells) == 2:
                out.add(cells[0].rstrip(":"), cells[1], f"{place}fila {i}")
        return
    header = max(range(min(len(rows), HEADER_ROWS)), key=lambda i: (filled[i], -i))
    for i in range(header):
        cells = [c for c in rows[i] if c.strip()]
        if len(cells) == 2:
            out.add(cells[0].rstrip(":"), cells[1], f"{place}fila {i + 1}")
    names = rows[header]
    for i in range(header + 1, len(rows)):
        scope = f"{place}fila {i + 1}"
        for k, cell in enumerate(rows[i]):
            name = names[k] if k < len(names) and names[k].strip() else f"columna {k + 1}"
            out.add(name, cell, f"{scope}, columna {column_name(k)}", scope)


def parse_csv(data: bytes) -> Parsed:
    """Comma-separated; where no record of the whole file has two cells by it, the first other separator that gives any."""
    text = data.decode("utf-8-sig", "replace")
    rows: list[list[str]] = []
    for mark in ",;\t|":
        rows = list(csv.reader(io.StringIO(text), delimiter=mark))
        if any(len(r) > 1 for r in rows):
            break
    out = Parsed("csv", text)
    tabular(out, rows, "")
    return out


def _xml(archive: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(archive.read(name))
    except KeyError:
        return None


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(element) -> str:
    return "".join(t.text or "" for t in element.iter() if _tag(t) == "t")


def parse_docx(data: bytes) -> Parsed:
    """Paragraphs as lines; tables of three columns or more as records, others as pairs."""
    try:
        body = _xml(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml")
    except (zipfile.BadZipFile, ElementTree.ParseError):
        raise Unreadable("documento dañado") from None
    if body is None:
        raise Unreadable("documento sin contenido")
    lines, tables = [], []
    for block in next(e for e in body.iter() if _tag(e) == "body"):
        if _tag(block) == "p":
            lines.append(_texts(block))
        elif _tag(block) == "tbl":
            tables.append([["\n".join(_texts(p) for p in cell.iter() if _tag(p) == "p") for cell in row if _tag(cell) == "tc"] for row in block if _tag(row) == "tr"])
    out = parse_text("\n".join(lines).encode(), "docx")
    for k, rows in enumerate(tables, 1):
        lines += [" | ".join(r) for r in rows]
        if max(map(len, rows), default=0) >= 3:
            tabular(out, rows, f"tabla {k}, ")
        else:
            for i, row in enumerate(rows, 1):
                if len(row) == 2:
                    out.add(row[0].rstrip(":"), row[1], f"tabla {k}, fila {i}")
    out.text = "\n".join(lines)
    return out


# Built-in number formats of workbooks that are percentages.
PERCENT_FORMATS = {9, 10}


def format_meaning(code: str, index: int) -> tuple[str, str | None]:
    """percentage, money with its ISO code, or plain."""
    if index in PERCENT_FORMATS or "%" in re.sub(r'"[^"]*"', "", code):
        return "percentage", None
    m = re.search(r"\[\$([A-Z]{3})", code) or re.search(r'"?\b([A-Z]{3})\b"?', re.sub(r"\[[A-Z][a-z]+\]", "", code))
    return ("money", m[1]) if m and re.search("[0#]", code) else ("plain", None)


def shifted_percent(raw: str) -> str:
    """Times 100 by moving the point: no binary fractions."""
    return f"{(Decimal(raw) * 100).normalize():f}%"


def parse_xlsx(data: bytes) -> Parsed:
    """Each sheet as a table. Formulas without a stored value, or with stale ones, are left out with a warning."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        book = _xml(archive, "xl/workbook.xml")
    except (zipfile.BadZipFile, ElementTree.ParseError):
        raise Unreadable("libro dañado") from None
    if book is None:
        raise Unreadable("libro sin contenido")
    strings_xml, styles = _xml(archive, "xl/sharedStrings.xml"), _xml(archive, "xl/styles.xml")
    strings = [_texts(si) for si in strings_xml if _tag(si) == "si"] if strings_xml is not None else []
    codes, formats = {}, []
    if styles is not None:
        codes = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.iter() if _tag(e) == "numFmt"}
        for xfs in (e for e in styles if _tag(e) == "cellXfs"):
            formats = [int(x.get("numFmtId", 0)) for x in xfs]
    calc = next((e for e in book.iter() if _tag(e) == "calcPr"), None)
    stale = calc is not None and (calc.get("fullCalcOnLoad") == "1" or calc.get("calcCompleted") == "0")
    links = _xml(archive, "xl/_rels/workbook.xml.rels")
    targets = {e.get("Id"): e.get("Target") for e in links} if links is not None else {}
    out, lines = Parsed("xlsx"), []
    for k, sheet in enumerate((e for e in book.iter() if _tag(e) == "sheet"), 1):
        name = sheet.get("name")
        target = targets.get(next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None), f"worksheets/sheet{k}.xml")
        page = _xml(archive, "xl/" + target.removeprefix("/xl/"))
        rows: list[list[str]] = []
        for row in (e for e in page.iter() if _tag(e) == "row") if page is not None else ():
            cells: dict[int, str] = {}
            for cell in row:
                place = cell.get("r", "")
                letters = re.match("[A-Z]*", place)[0]
                column = sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1 if letters else len(cells)
                value = next((e.text for e in cell if _tag(e) == "v"), None)
                if any(_tag(e) == "f" for e in cell) and (value is None or stale):
                    out.warnings.append(f"hoja {name}, celda {place}: fórmula sin valor vigente")
                    continue
                if cell.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif cell.get("t") == "inlineStr":
                    value = _texts(cell)
                elif value is not None and cell.get("t") in (None, "n"):
                    style = int(cell.get("s", 0))
                    index = formats[style] if style < len(formats) else 0
                    meaning, currency = format_meaning(codes.get(index, ""), index)
                    value = shifted_percent(value) if meaning == "percentage" else f"{Decimal(value):f} {currency}" if meaning == "money" else value
                cells[column] = value or ""
            number = int(row.get("r", len(rows) + 1))
            rows += [[] for _ in range(number - len(rows) - 1)]
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        tabular(out, rows, f"hoja {name}, ")
        lines += ["\t".join(r) for r in rows]
    out.text = "\n".join(lines)
    return out


def pdf_text(data: bytes) -> str:
    """Text that simple PDFs show: literal and hex strings of their (deflated) content streams; pages end in a form feed."""
    pages = []
    for m in re.finditer(rb"(<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>)\s*stream\r?\n(.*?)\r?\nendstream", data, re.S):
        body = m[2]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        shown = []
        for s in re.finditer(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]+)>|(T\*|'|Td|TD|Tm|ET)", body):
            if s[3]:
                shown.append("\n")
            elif s[1] is not None:
                shown.append(re.sub(rb"\\([()\\])", rb"\1", s[1]).decode("latin-1"))
            else:
                raw = bytes.fromhex(re.sub(rb"\s", b"", s[2]).decode())
                shown.append(raw.decode("utf-16-be", "ignore") if raw[:1] == b"\0" else raw.decode("latin-1"))
        text = re.sub(r"\n+", "\n", "".join(shown)).strip()
        if text:
            pages.append(text)
    return "\f".join(pages)


def parse_pdf(data: bytes, ocr: Callable[[bytes], tuple[str, float]] | None = None) -> Parsed:
    """Native text of at least 20 characters, else OCR if there is a provider."""
    text = pdf_text(data)
    if len(text.strip()) >= 20:
        out = parse_text(text.replace("\f", "\n").encode(), "pdf")
        out.text = text
        return out
    return by_ocr(data, "pdf", ocr)


def by_ocr(data: bytes, parser: str, ocr) -> Parsed:
    if ocr is None:
        raise Unreadable(NO_OCR)
    text, confidence = ocr(data)
    out = parse_text(text.encode(), parser)
    out.ocr_status = "complete" if confidence >= 0.55 else "low_confidence"
    return out


def chunks_of(text: str) -> list[dict]:
    """Lines packed until the next, without its line feed, would pass the limit; a longer line stays whole."""
    out, held, size, first = [], [], 0, 1
    lines = text.splitlines()
    for i, line in enumerate(lines, 1):
        n = len(line.encode())
        if held and size + n > CHUNK_BYTES:
            out.append((first, i - 1, "\n".join(held)))
            held, size, first = [], 0, i
        held.append(line)
        size += n + 1
    if held:
        out.append((first, len(lines), "\n".join(held)))
    return [{"ordinal": k, "location": f"líneas {a}-{b}", "content": c} for k, (a, b, c) in enumerate(out) if c.strip()]


def chunk_rows(texts: DataFrame) -> DataFrame:
    """(document_id, ordinal, location, content) of texts (document_id, text)."""

    return texts.select("document_id", "text").mapInArrow(chunk_batches, "document_id long, ordinal int, location string, content string")


def chunk_batches(batches):
    """The chunks of Arrow batches (document_id, text), one text at a time, in batches of a few MB whatever the texts' lengths."""
    import pyarrow as pa

    names = ["document_id", "ordinal", "location", "content"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows, size = [], 0
    for batch in batches:
        for d, t in zip(*batch.columns):
            for c in chunks_of(t.as_py() or ""):
                rows.append((d.as_py(), c["ordinal"], c["location"], c["content"]))
                size += len(c["content"])
                if size > BATCH_CHARS:
                    yield made(rows)
                    rows, size = [], 0
    if rows:
        yield made(rows)


def parse(path: str, extension: str, data: bytes, ocr=None) -> dict:
    actual = sniff(data)
    declared = {"jpeg": "jpg"}.get(extension, extension)
    real = actual if actual and actual != "zip" and actual != declared and not (actual == "ole" and declared in ("xls", "doc")) else declared
    row = {"path": path, "extension": extension, "parser": None, "content_hash": hashlib.sha256(data).hexdigest(), "size_bytes": len(data), "ocr_status": None, "mismatch": real if real != declared else None, "reason": None, "warnings": [], "records": [], "chunks": []}
    try:
        if real in ("txt", "md"):
            parsed = parse_text(data, "text")
        elif real in ("csv", "docx", "xlsx"):
            parsed = {"csv": parse_csv, "docx": parse_docx, "xlsx": parse_xlsx}[real](data)
        elif real == "pdf":
            parsed = parse_pdf(data, ocr)
        elif real in IMAGES:
            parsed = by_ocr(data, "image", ocr)
        else:
            raise Unreadable(f"formato no soportado: {real}")
        if not parsed.text.strip():
            raise Unreadable("sin texto")
        row |= {"parser": parsed.parser, "ocr_status": parsed.ocr_status, "warnings": parsed.warnings, "records": parsed.records, "chunks": chunks_of(parsed.text)}
    except Unreadable as why:
        row["reason"] = str(why)
    except Exception as why:  # noqa: BLE001  one bad file must not end the job; its reason is kept
        row["reason"] = f"error de lectura: {type(why).__name__}"
    return row


#: Why a file without text is unread when nothing reads pictures.
NO_OCR = "OCR no disponible"


def parse_files(files: DataFrame, ocr: Callable[[bytes], tuple[str, float]] | None = None) -> DataFrame:
    """One row a file, read or not; ``files`` has path, extension, content, and text and confidence where OCR has read it already."""
    known = [c for c in ("text", "confidence") if c in files.columns]

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for at, (p, e, c) in enumerate(zip(batch["path"], batch["extension"], batch["content"])):
                said = (batch["text"][at], float(batch["confidence"][at])) if known and isinstance(batch["text"][at], str) else None
                rows.append(parse(p, e, bytes(c), (lambda _, s=said: s) if said else ocr))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ("path x, extension x, parser x, content_hash x, size_bytes x, ocr_status x, mismatch x, reason x, warnings x, records x, chunks x").split(", ")])

    return files.select("path", "extension", "content", *known).mapInPandas(run, PARSED)


def parse_cached(files: DataFrame, ocr: Callable[[bytes], tuple[str, float]], cache: str, batch: str, staging: str) -> DataFrame:
    """As ``parse_files``; what needs OCR is read through the cache, so that no content is read twice."""
    from .ocr_cache import recognise

    spark = files.sparkSession
    parse_files(files).write.mode("overwrite").parquet(f"{staging}/native")
    native = spark.read.parquet(f"{staging}/native")
    pictures = files.join(native.where(F.col("reason") == NO_OCR).select("path"), "path", "left_semi")
    read = recognise(pictures.select("path", "extension", "content"), ocr, cache, batch)
    failed = F.when(F.col("status") == "failed", F.lit("OCR fallido"))
    parse_files(read).write.mode("overwrite").parquet(f"{staging}/read")
    again = spark.read.parquet(f"{staging}/read").join(read.select("path", failed.alias("__failed")), "path")
    again = again.withColumn("reason", F.coalesce("__failed", "reason")).drop("__failed")
    return native.where(~F.col("reason").eqNullSafe(NO_OCR)).unionByName(again)
