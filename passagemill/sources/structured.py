"""Readers for formats that need a parser: one table function over file bytes.

A file's parts stream out one by one. Text is left raw; cleaning happens in
column functions afterwards.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from typing import Any, BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

PART_SCHEMA = (
    "part_order bigint, raw_text string, content_type string, conversion_source string, page_number int, "
    "sheet_name string, row_index bigint, line_number bigint, json_path string, epub_item_id string, "
    "epub_item_name string, epub_book_title string, error string"
)
PART_TYPES = dict(f.split() for f in PART_SCHEMA.split(","))
FIELDS = list(PART_TYPES)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
ARROW_PARTS = {name: _ARROW[kind] for name, kind in PART_TYPES.items()}
INFERENCE_ROWS = 1000

# Bytes of a PDF to the text of each page.
PdfExtractor = Callable[[bytes], Iterable[str]]
Parts = Iterator[dict[str, Any]]


class Pairs(list):
    """The names and values of a JSON object, a repeated name each time."""


def read_json(text: str) -> Any:
    return json.loads(text, object_pairs_hook=Pairs)


def leaves(value: Any) -> Iterator[tuple[str, str]]:
    """(path, text) of the scalar leaves of a JSON value, in source order."""
    waiting = [("root", value)]
    while waiting:
        path, here = waiting.pop()
        if isinstance(here, (dict, Pairs)):
            steps = list(here.items()) if isinstance(here, dict) else here
        elif isinstance(here, list):
            steps = [(f"[{i}]", v) for i, v in enumerate(here)]
        else:
            if here is not None:
                yield path, str(here)
            continue
        waiting.extend((s if path == "root" else f"{path}.{s}", v) for s, v in reversed(steps))


def cells_text(names: list[str], values: Iterable[Any]) -> str:
    """``name: value`` of the filled cells of a row; cells beyond the names are named by their place."""
    shown = ((names[i] if i < len(names) else f"column_{i}", str(v)) for i, v in enumerate(values) if v is not None)
    return " | ".join(f"{n}: {v}" for n, v in shown if v.strip())


def json_parts(content: bytes) -> Parts:
    for path, text in leaves(read_json(content.decode("utf-8", "replace"))):
        yield {"raw_text": text, "json_path": path, "content_type": "json_text_value"}


_LINE_END = re.compile(rb"\r\n|\r|\n")


def byte_lines(stream: BinaryIO, at: int = 0, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each line from ``at`` on, without its end."""
    stream.seek(at)
    held, more = b"", True
    while more:
        data = stream.read(max(block, len(held)))
        more = bool(data)
        held += data
        # A carriage return at the end of the block may be half of a line end.
        sure = len(held) - (1 if more and held.endswith(b"\r") else 0)
        done = 0
        for end in _LINE_END.finditer(held, 0, sure):
            yield at + done, held[done : end.start()]
            done = end.end()
        at, held = at + done, held[done:]
    if held:
        yield at, held


def jsonl_parts(stream: BinaryIO, first: int = 0, records: int | None = None, before: int = 0) -> Parts:
    """Leaves of ``records`` lines (or all) from the place ``first`` on, with ``before`` lines ahead of it.

    A part's order is the place of its line in the file, plus its number in the
    line; a leaf takes a byte at least, so orders of two lines do not meet.
    """
    for number, (place, raw) in enumerate(itertools.islice(byte_lines(stream, first), records), before + 1):
        line = raw.decode("utf-8", "replace")
        if not line.strip():
            continue
        try:
            value = read_json(line)
        except ValueError:
            yield {"raw_text": line, "line_number": number, "content_type": "jsonl_malformed_line_text", "part_order": place}
            continue
        for order, (path, leaf) in enumerate(leaves(value), place):
            yield {
                "raw_text": leaf, "line_number": number, "json_path": path, "content_type": "jsonl_text_value", "part_order": order,
            }


def _cell_types() -> list[tuple[Callable[[str], bool], Callable[[str], Any]]]:
    def parses(convert: Callable[[str], Any]) -> Callable[[str], bool]:
        def check(s: str) -> bool:
            try:
                convert(s)
            except ValueError:
                return False
            return "_" not in s
        return check

    flags = {"true": True, "false": False}
    return [(lambda s: s in flags, flags.get), (parses(int), int), (parses(float), float)]


def delimited_parts(
    stream: BinaryIO, separator: str, first: int = 0, records: int | None = None, before: int = 0
) -> Parts:
    """Rows of ``records`` records (or all) from the place ``first`` on, with ``before`` records ahead of it.

    The first record of the file is the header. Each column takes the narrowest type that the
    first rows of the file fit, and later values that do not fit stay as they are written.
    """
    csv.field_size_limit(1 << 30)

    def rows_from(place: int) -> Iterator[list[str]]:
        stream.seek(place)
        # The stream stays open for the next reading.
        held = io.BufferedReader(_Unclosed(stream), 1 << 18)
        text = io.TextIOWrapper(held, encoding="utf-8-sig" if place == 0 else "utf-8", errors="replace", newline="")
        return csv.reader(text, delimiter=separator)

    head = list(itertools.islice(rows_from(0), INFERENCE_ROWS + 1))
    if not head or not head[0]:
        return
    names: list[str] = []
    for name in head[0]:
        copies = sum(n == name or n.startswith(f"{name}_duplicated_") for n in names)
        names.append(f"{name}_duplicated_{copies - 1}" if copies else name)
    types = _cell_types()
    converters = []
    for i in range(len(names)):
        seen = [row[i] for row in head[1:] if i < len(row) and row[i] != ""]
        fitting = [t for t in types if seen and all(t[0](s) for s in seen)]
        converters.append(fitting[0] if fitting else (lambda s: True, str))
    as_written = (lambda s: True, str)
    for index, row in enumerate(itertools.islice(rows_from(first), records), before - 1):
        if index < 0:
            continue
        values = [
            None if s == "" else convert(s) if fits(s) else s
            for s, (fits, convert) in zip(row, itertools.chain(converters, itertools.repeat(as_written)))
        ]
        yield {"raw_text": cells_text(names, values), "row_index": index, "part_order": index}


class _Unclosed(io.RawIOBase):
    """A stream whose end of use does not close it."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        data = self.stream.read(len(room))
        room[: len(data)] = data
        return len(data)


def parquet_parts(stream: BinaryIO) -> Parts:
    import pyarrow.parquet as pq

    table = pq.ParquetFile(stream)
    index = 0
    for batch in table.iter_batches(batch_size=4096):
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            yield {"raw_text": cells_text(batch.schema.names, row), "row_index": index}
            index += 1


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _targets(archive: zipfile.ZipFile, rels: str, base: str) -> dict[str, str]:
    return {
        r.get("Id"): posixpath.normpath(posixpath.join(base, r.get("Target"))).lstrip("/")
        if not r.get("Target").startswith("/")
        else r.get("Target").lstrip("/")
        for r in _xml(archive, rels)
    }


# Number formats of the workbook standard that show a date.
DATE_FORMATS = {14, 15, 16, 17, 22}


def shows_date(code: str) -> bool:
    """Whether a number format of the workbook's own has a day, month or year; times alone stay numbers."""
    plain = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()
    return bool(re.search("[dy]", plain)) or ("m" in plain and not re.search("[hs]", plain))


def xlsx_parts(stream: BinaryIO) -> Parts:
    """Rows of every sheet; the first row names the columns."""
    archive = zipfile.ZipFile(stream)
    names = set(archive.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for item in _xml(archive, "xl/sharedStrings.xml"):
            # Without the phonetic runs.
            runs = [run for run in item if _local(run.tag) != "rPh"]
            shared.append("".join(t.text or "" for run in runs for t in run.iter() if _local(t.tag) == "t"))
    dated: list[bool] = []
    if "xl/styles.xml" in names:
        groups = {_local(group.tag): group for group in _xml(archive, "xl/styles.xml")}
        own = {int(x.get("numFmtId")) for x in groups.get("numFmts", ()) if shows_date(x.get("formatCode", ""))}
        dated = [int(x.get("numFmtId", "0")) in DATE_FORMATS | own for x in groups.get("cellXfs", ())]
    targets = _targets(archive, "xl/_rels/workbook.xml.rels", "xl")
    for sheet in _xml(archive, "xl/workbook.xml").iter():
        if _local(sheet.tag) != "sheet":
            continue
        link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        header: list[str] | None = None
        index = 0
        for row in _sheet_rows(archive, targets[link], shared, dated):
            if header is None:
                header = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(row)]
                continue
            yield {"raw_text": cells_text(header, row), "sheet_name": sheet.get("name"), "row_index": index}
            index += 1


def _sheet_rows(archive: zipfile.ZipFile, name: str, shared: list[str], dated: list[bool]) -> Iterator[list[Any]]:
    with archive.open(name) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) != "row":
                continue
            row: list[Any] = []
            for cell in node:
                letters = "".join(ch for ch in cell.get("r", "") if ch.isalpha())
                place = len(row)
                if letters:
                    place = 0
                    for ch in letters:
                        place = place * 26 + ord(ch.upper()) - 64
                    place -= 1
                row.extend([None] * (place - len(row)))
                row.append(_cell_value(cell, shared, dated))
            yield row
            node.clear()


def _cell_value(cell: ElementTree.Element, shared: list[str], dated: list[bool]) -> Any:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    raw = next((v.text for v in cell if _local(v.tag) == "v"), None)
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind in ("str", "e", "d"):
        return raw
    style = int(cell.get("s", "0"))
    if style < len(dated) and dated[style]:
        return datetime(1899, 12, 30) + timedelta(days=float(raw))
    return float(raw) if any(c in raw for c in ".eE") else int(raw)


# Elements of a document body that hold paragraphs.
PARAGRAPH_HOLDERS = {"tbl", "tr", "tc", "sdt", "sdtContent", "customXml", "ins"}


def _paragraphs(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    for child in node:
        if _local(child.tag) == "p":
            yield child
        elif _local(child.tag) in PARAGRAPH_HOLDERS:
            yield from _paragraphs(child)


def docx_parts(stream: BinaryIO) -> Parts:
    """The filled paragraphs of the document body, table cells included, as one part."""
    body = next(n for n in _xml(zipfile.ZipFile(stream), "word/document.xml") if _local(n.tag) == "body")
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    texts = []
    for paragraph in _paragraphs(body):
        runs = (
            (n.text or "") if _local(n.tag) == "t" else marks.get(_local(n.tag), "")
            for n in paragraph.iter()
        )
        texts.append("".join(runs))
    yield {
        "raw_text": "\n".join(t for t in texts if t.strip()),
        "content_type": "docx_plain_text",
        "conversion_source": "paragraphs",
    }


def epub_parts(stream: BinaryIO) -> Parts:
    """One part per XHTML item of the package, with the book's title."""
    archive = zipfile.ZipFile(stream)
    package = next(
        n.get("full-path") for n in _xml(archive, "META-INF/container.xml").iter() if _local(n.tag) == "rootfile"
    )
    root = _xml(archive, package)
    title = next((n.text for n in root.iter() if _local(n.tag) == "title" and n.text), None)
    for item in root.iter():
        if _local(item.tag) != "item" or item.get("media-type") != "application/xhtml+xml":
            continue
        name = unquote(item.get("href"))
        data = archive.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), name)))
        try:
            markup = data.decode("utf-8")
        except UnicodeDecodeError:
            markup = data.decode("latin-1")
        yield {
            "raw_text": markup, "content_type": "epub_xhtml_content", "epub_item_id": item.get("id"),
            "epub_item_name": name, "epub_book_title": title,
        }


def pdf_parts(content: bytes, extractor: PdfExtractor | None) -> Parts:
    if extractor is None:
        raise ValueError("no PDF extractor was given")
    for number, text in enumerate(extractor(content), 1):
        yield {"raw_text": text, "page_number": number, "content_type": "pdf_page_text"}


# Readers of a stream that can seek.
STREAMED: dict[str, Callable[[BinaryIO], Parts]] = {
    ".jsonl": jsonl_parts,
    ".csv": lambda s: delimited_parts(s, ","),
    ".tsv": lambda s: delimited_parts(s, "\t"),
    ".parquet": parquet_parts,
    ".xlsx": xlsx_parts,
    ".docx": docx_parts,
    ".epub": epub_parts,
}


def structured_reader(pdf_extractor: PdfExtractor | None = None):
    """Table function ``(parser key, bytes) -> parts``; a failure is a row with an error."""
    readers: dict[str, Callable[[bytes], Parts]] = {
        ".json": json_parts,
        ".pdf": lambda c: pdf_parts(c, pdf_extractor),
        **{key: (lambda c, read=read: read(io.BytesIO(c))) for key, read in STREAMED.items()},
    }

    class ReadStructured:
        def eval(self, parser: str, content: bytes):
            if content is None or parser not in readers:
                yield (0,) + (None,) * (len(FIELDS) - 1)
                return
            order = -1
            try:
                for part in readers[parser](bytes(content)):
                    order = part.setdefault("part_order", order + 1)
                    yield tuple(part.get(name) for name in FIELDS)
            except Exception as e:  # noqa: BLE001 - kept as an error row
                yield (order + 1,) + (None,) * (len(FIELDS) - 2) + (f"{type(e).__name__}: {e}"[:500],)

    return udtf(ReadStructured, returnType=PART_SCHEMA)


def json_leaves(df: DataFrame, text: Column) -> DataFrame:
    """One row per scalar leaf: adds ``leaf_order``, ``json_path``, ``raw_text``.

    Text that is not JSON gives no rows.
    """

    class JsonLeaves:
        def eval(self, source: str):
            try:
                value = read_json(source)
            except (TypeError, ValueError):
                return
            for order, (path, leaf) in enumerate(leaves(value)):
                yield order, path, leaf

    table = udtf(JsonLeaves, returnType="leaf_order bigint, json_path string, raw_text string")
    held = df.withColumn("__json", text)
    return held.lateralJoin(table(F.col("__json").outer())).drop("__json")
