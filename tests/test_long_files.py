"""Files read in ranges or as streams give the rows of a whole read."""

from __future__ import annotations

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from passagemill.sources import splits
from passagemill.sources.documents import parse_errors, parse_folder, parts_of
from passagemill.sources.files import list_source_files
from passagemill.sources.structured import byte_lines, delimited_parts, jsonl_parts, leaves, read_json

CELLS = ["", "a", "12", "007", '"', '""', 'x"y', "a,b", "line\nfeed", "\r\n", "\r", "é", '","', "  ", "true"]


def delimited(draw, rows, ends):
    out = []
    for i in range(rows):
        cells = []
        for _ in range(draw.randrange(1, 5)):
            cell = draw.choice(CELLS)
            if draw.random() < 0.3 and not set(cell) & set(',"\r\n'):
                cells.append(cell + draw.choice(["", '"', 'q"q']))  # a bare quote inside a cell
            else:
                cells.append('"' + cell.replace('"', '""') + '"' + draw.choice(["", "", "tail"]))
        out.append(",".join(cells))
    return draw.choice(["", "﻿"]) + "".join(r + draw.choice(ends) for r in out) + draw.choice(["", '"open, cell\n', "last"])


def whole_and_split(path, kind, split_bytes, read):
    """Rows of one whole read, and of all ranges by their scans, joined as Spark joins them."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        whole = list(read(f))
    got, inside, before = [], False, 0
    for begin in range(0, max(size, 1), split_bytes):
        told = splits.scan_file_range(f"file:{path}", begin, min(size, begin + split_bytes), size, splits.SEPARATORS.get(kind))
        ends, records, first = told[3:] if inside else told[:3]
        if records:
            with open(path, "rb") as f:
                got += read(f, first, records, before)
        inside, before = ends, before + records
    return whole, got


@pytest.mark.parametrize("seed", range(12))
def test_ranges_of_delimited_files(tmp_path, seed):
    draw = random.Random(seed)
    path = str(tmp_path / "t.csv")
    content = delimited(draw, 40, ["\n"] if seed % 3 else ["\n", "\r\n", "\r", "\n\n"])
    with open(path, "wb") as f:
        f.write(content.encode() + (b"\xff\xfe" if seed % 4 == 0 else b""))
    for split_bytes in (1, 2, 3, 7, 50, 10_000):
        whole, got = whole_and_split(path, ".csv", split_bytes, lambda f, *at: list(delimited_parts(f, ",", *at)))
        assert got == whole and (len(whole) > 10 or '"' in content)


@pytest.mark.parametrize("seed", range(6))
def test_ranges_of_json_lines(tmp_path, seed):
    draw = random.Random(seed)
    ends = ["\n", "\r\n", "\r", "\n\n", "\n \n"]
    lines = [draw.choice(['{"a": 1, "b": [1, null, {"c": "é"}]}', "not json", "", "[1, 2]", '{"a": 1, "a": 2}', '"x y"']) for _ in range(60)]
    path = str(tmp_path / "t.jsonl")
    with open(path, "wb") as f:
        f.write("".join(x + draw.choice(ends) for x in lines).encode() + draw.choice([b"", b"\xff{", b"7"]))
    for split_bytes in (1, 2, 5, 40, 10_000):
        whole, got = whole_and_split(path, ".jsonl", split_bytes, lambda f, *at: list(jsonl_parts(f, *at)))
        assert got == whole and len(whole) > 20
    orders = [p["part_order"] for p in whole]
    assert orders == sorted(set(orders))


def test_lines_of_any_block():
    data = b"a\r\n\r\n\rb\n\nc\r"
    for block in (1, 2, 3, 100):
        assert [x for _, x in byte_lines(io.BytesIO(data), 0, block)] == [b"a", b"", b"", b"b", b"", b"c"]


def test_a_line_of_many_leaves():
    """More than a million leaves in a line, and a line behind it."""
    data = (b"[" + b"1," * 1_100_000 + b"1]\n") + b'{"k": 2}\n'
    parts = list(jsonl_parts(io.BytesIO(data)))
    assert len(parts) == 1_100_002 and parts[-1]["line_number"] == 2
    assert parts[-1]["part_order"] > parts[-2]["part_order"]


TEXTS = ['{"a": {"b": [1, 2.5, "x\\"]}", [], {}], "root": {"c": true}}, "a": null, "d": "e\\u00e9"}', "[]", "7", ' "s" ', "[[[1], {}]]",
         '{"root": {"inner": 1}}', "1e5", "[NaN, -0.0]"]
BROKEN = ["", "{", "[1,]", '{"a" 1}', '{"a": 1,}', "[1 2]", "[1]]", "{]", '"open', "tru", "[1}", "{1: 2}", '{"a": 1} x', ",", "[,1]"]


def test_json_streams(monkeypatch):
    for block in (1, 3, 1 << 20):
        monkeypatch.setattr(splits, "BLOCK", block)
        for text in TEXTS:
            assert list(splits.json_stream_leaves(io.BytesIO(text.encode()))) == list(leaves(read_json(text)))
        for text in BROKEN:
            with pytest.raises(ValueError):
                list(splits.json_stream_leaves(io.BytesIO(text.encode())))
            with pytest.raises(ValueError):
                read_json(text)


MARKUP = (
    "<!doctype html><html><body class='a > b'> one two <!-- no > <p> no --> three&amp;four <script>if (a < b) { x = '</p>' }</script>"
    " five <style>p {}</style>six <b title=\"x > y\">seven</b> < eight <i>nine ten</i></body> eleven twelve </html> end <"
)


def test_markup_pieces(monkeypatch):
    for block in (1, 5, 1 << 20):
        monkeypatch.setattr(splits, "BLOCK", block)
        for size in (1, 20, 10_000):
            pieces = list(splits.markup_pieces(io.BytesIO(MARKUP.encode()), size))
            assert b"".join(pieces).decode() == MARKUP
            assert all(p.endswith(b" ") for p in pieces[:-1]) and (size > 1000 or len(pieces) > 3)


def workbook() -> bytes:
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(f'<row><c t="inlineStr"><is><t>name{i}</t></is></c><c><v>{i}</v></c></row>' for i in range(30))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S 1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return held.getvalue()


@pytest.fixture
def varied(folder):
    draw = random.Random(3)
    extra = {
        "_private/__init__.py": b"import os\nvalue = 1\n",
        "_notes.txt": "found as well, with é and more words\n".encode() * 3,
        "a # b %20+c.csv": delimited(draw, 30, ["\n", "\r\n"]).encode(),
        "quoted.tsv": b'a\tb\n"x\ny\tz"\t1\n"q ""r"""\t2\n',
        "more.jsonl": b'{"a": [1, 2, 3]}\r\n\r\nbroken\r{"b": "x"}\n',
        "page.html": MARKUP.encode(),
        "deep.json": json.dumps({"list": [{"n": i, "t": "x" * i} for i in range(40)]}).encode(),
        "book.xlsx": workbook(),
        "doc.xml": b"<?xml version='1.0'?><a> one two <![CDATA[ a < b > c ]]> three <!-- > no --> four &lt; five</a>",
    }
    for name, content in extra.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)
    return folder


def test_every_format_in_ranges(spark, varied):
    pieces = (".txt", ".md", ".py", ".html", ".xml", ".log")
    columns = ["source_file", "part_id", "line_number", "row_index", "json_path", "sheet_name", "text", "content_type",
               "detected_type", "parsing_type_used", "extraction_method", "file_size_bytes", "file_last_modified"]

    def rows(**options):
        parsed = parse_folder(spark, varied, **options)
        parts = parts_of(parsed)
        cut = F.lower("source_file").rlike(r"\.(txt|md|py|html|xml|log)$")
        records = sorted(map(str, parts.filter(~cut).select(*columns).collect()))
        joined: dict[str, list] = {}
        for r in parts.filter(cut).orderBy("source_file", "part_order").collect():
            joined.setdefault(r["source_file"], []).append(r["text"])
        errors = sorted(r[0] for r in parse_errors(parsed).collect())
        return records, {k: " ".join(v) for k, v in joined.items()}, errors, max(len(v) for v in joined.values())

    whole = rows()
    assert len(whole[0]) > 150 and whole[3] == 1 and "_private/__init__.py" in whole[1] and whole[2] == ["bad.json"]
    assert all(name.endswith(pieces) for name in whole[1])
    for split_bytes in (1, 30):
        split = rows(split_bytes=split_bytes)
        assert split[:3] == whole[:3] and split[3] > 3


def test_listing_walks_in_tasks(spark, tmp_path):
    for i in range(40):
        for name in ("a.txt", "_b.txt", ".c.txt", "d.tmp"):
            path = tmp_path / f"f{i % 4}" / "__x" / f"{i}" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("x" * i)
    (tmp_path / "f0" / ".git").mkdir()
    (tmp_path / "f0" / ".git" / "x.txt").write_text("no")
    got = {(r.source_file, r.length) for r in list_source_files(spark, str(tmp_path)).collect()}
    assert got == {(f"f{i % 4}/__x/{i}/{n}", i) for i in range(40) for n in ("a.txt", "_b.txt")}
    listed = list_source_files(spark, str(tmp_path / "f0" / ".git" / "none"))
    assert listed.count() == 0
