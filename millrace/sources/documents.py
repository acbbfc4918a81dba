"""Word-processor files without a library: a file is a zip archive whose main part is XML."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.session import arrow_map

#: Namespace and part name of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PART = "word/document.xml"


def _text(node) -> str:
    pieces = []
    for x in node.iter():
        if x.tag == f"{W}t":
            pieces.append(x.text or "")
        elif x.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            pieces.append("\t" if x.tag == f"{W}tab" else "\n")
    return "".join(pieces).strip()


def docx_text(content: bytes) -> str:
    """Non-empty paragraphs, then each table under a heading of its number, a row a line, non-empty cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read(PART)).find(f"{W}body")
    out = [t for p in body.findall(f"{W}p") if (t := _text(p))]
    for i, table in enumerate(body.findall(f"{W}tbl"), 1):
        out.append(f"\n[Table {i}]")
        for row in table.findall(f"{W}tr"):
            cells = ["\n".join(_text(p) for p in cell.findall(f"{W}p")).strip() for cell in row.findall(f"{W}tc")]
            if any(cells):
                out.append(" | ".join(c for c in cells if c))
    return "\n".join(out)


def docx_file(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    """A minimal file with the given paragraphs and tables of cells."""
    p = lambda t: f"<w:p><w:r><w:t xml:space=\"preserve\">{escape(t)}</w:t></w:r></w:p>"
    rows = lambda table: "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    body = "".join(map(p, paragraphs)) + "".join(f"<w:tbl>{rows(t)}</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(PART, f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def parse_docx(files: DataFrame) -> DataFrame:
    """``path, body, error`` of ``path, content`` rows, as the binary-file source gives them; a broken file has an error."""

    def run(batches):
        for batch in batches:
            body, error = [], []
            for content in batch.column(1).to_pylist():
                try:
                    body.append(docx_text(content))
                    error.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError, AttributeError) as e:
                    body.append("")
                    error.append(f"Error reading Word document: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.string()), pa.array(error, pa.string())], names=["path", "body", "error"])

    return arrow_map(files.select("path", "content"), run, "path string, body string, error string")


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """All word-processor files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(folder)
    return parse_docx(files)
